"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .bpe import encode_documents
from .common import materialize, table
from .licenses import scan_licenses
from .minhash import near_duplicates
from .packing import pack_documents
from .quality import judge
from .secrets import find_secrets
from .substrings import cut_repeats
from .urls import judge_urls
from .vectors import nearest


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).drop("kept", "kept_text")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("ids")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).drop("ids", "decoded")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), labels=table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *(F.col("_q_" + c).alias(c) for c in counts), F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_distance").alias("distance"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
#: The listing of the query, told by rule and apart from ``pages``: on each host that these parts make, every other number from 1000 on of two languages.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_PREFIXES, LISTED_TOPS, LISTED_PATHS = ["", "m."], ["com", "net", "org"], ["en", "de"]
LISTED_NUMBERS = (1000, 10_000, 2)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql(f"select * from values {_RULES_SQL} as rules(rule_host, rule_path, verdict)")
    listed = spark.range(*LISTED_NUMBERS).withColumn("path", F.explode(F.array(*map(F.lit, LISTED_PATHS))))
    hosts = [f"https://{prefix}{label}.example.{top}/" for prefix in LISTED_PREFIXES for label in LISTED_LABELS for top in LISTED_TOPS]
    listed = listed.withColumn("host", F.explode(F.array(*map(F.lit, hosts)))).select(F.concat("host", "path", F.lit("/"), "id").alias("url"))
    return judge_urls(pages, rules, listed)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rank = F.array(*(F.lit(k) for k in ("assign", "access", "hex", "format")))

    def joined(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]).alias("r"), s["end"], s["kind"])))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("_s_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = joined(F.concat("_s_base", "_s_added")).alias("spans")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("_s_base")), 256).alias("base_sha256"), spans)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from transcripts of all conversations; ``n_right`` counts lines whose role was recovered."""
    lines = materialize(chat.parse(chat.transcript_lines(table(spark, sf_dir, "conversations"))), "transcripts")
    found = materialize(chat.recover_roles(lines, chat.fit(lines)), "roles")
    right = found.select("conv_id", "n", F.col("role").alias("found")).join(lines.select("conv_id", "n", "role"), ["conv_id", "n"]).groupBy("conv_id")
    right = right.agg(F.count(F.lit(1)).alias("n_lines"), F.sum((F.col("found") == F.col("role")).cast("long")).alias("n_right"))
    turns = chat.render(found).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("rendered")).alias("n_chars"), F.sum(F.crc32("rendered")).alias("rendered_sum"))
    return turns.join(right, "conv_id")


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_suffix_array": op2_suffix_array,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_urls": op7_urls,
    "op8_secrets": op8_secrets,
    "op9_chat": op9_chat,
    "op10_nearest": op10_nearest,
    "pipeline": corpus_pipeline.run,
}

_LOWERED_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWERED_SQL}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))
                                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
        g as (select doc_id, unnest(s) as g from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as n from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
        links as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
        edges as (select a, b from links union all select b, a from links),
        reach(doc_id, other) as (select a, b from edges union select r.doc_id, e.b from reach r join edges e on r.other = e.a),
        least_of as (select doc_id, min(other) as other from reach group by 1)
        select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id, doc_id <= coalesce(other, doc_id) as kept
        from s left join least_of using (doc_id)
    """,
    "op7_urls": rf"""
        with parsed as (
            select page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        keyed as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/+)$', '') as key from parsed),
        listed as (
            select prefix || label || '.example.' || top || '/' || lang || '/' || n as key
            from unnest({LISTED_PREFIXES}) as a(prefix), unnest({LISTED_LABELS}) as b(label), unnest({LISTED_TOPS}) as c(top), unnest({LISTED_PATHS}) as d(lang),
                 range({LISTED_NUMBERS[0]}, {LISTED_NUMBERS[1]}, {LISTED_NUMBERS[2]}) as e(n)),
        rules(rule_host, rule_path, v) as (values {_RULES_SQL}),
        named as (select distinct host, path from parsed where host <> ''),
        ranked as (
            select host, path, rule_host || rule_path as rule, v,
                   row_number() over (partition by host, path order by length(rule_host || rule_path) desc, rule_host || rule_path, v) as r
            from named join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
        best as (select host, path, rule, v from ranked where r = 1)
        select page_id, host, path, rule,
               coalesce(v, case when host <> '' and key in (select key from listed) then 'block' else 'allow' end) as verdict
        from keyed left join best using (host, path)
    """,
}
