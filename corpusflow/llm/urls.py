"""URL rules and lists: a blocked Bloom filter before an exact hash join.

All steps are DataFrame expressions.  The filter has 64-bit blocks; a key sets
four bits of one block, so a probe reads one word.  Blocks are as many as the
list needs for twelve bits a key.  A filter of up to ``BROADCAST_BLOCKS`` blocks is
broadcast, a larger one is joined by block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits that a key sets, and bits of the filter for each key.
BITS, BITS_A_KEY = 4, 12
#: Blocks of the smallest filter, and of the largest that is broadcast (a row of a number and a word each).
LEAST_BLOCKS, BROADCAST_BLOCKS = 1 << 10, 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query, fragment, ``www.`` and slashes or ``.html`` at the end do not tell pages apart."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html|/+)\z", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    second = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(BITS)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def blocks_for(keys: int) -> int:
    """Blocks of a filter for so many keys: a power of two."""
    return max(LEAST_BLOCKS, 1 << (-(-keys * BITS_A_KEY // 64) - 1).bit_length()) if keys else LEAST_BLOCKS


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """``(block, word)`` of the non-null keys: at most ``blocks`` rows, combined before the shuffle."""
    return keys.where(F.col(column).isNotNull()).groupBy(_block(F.col(column), blocks).alias("block")).agg(F.bit_or(_mask(F.col(column))).alias("word"))


def possible(rows: DataFrame, column: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter may hold; no listed key is lost."""
    word = bloom.withColumnRenamed("block", "_block").withColumnRenamed("word", "_word")
    word = F.broadcast(word) if blocks <= BROADCAST_BLOCKS else word
    hit = rows.withColumn("_block", _block(F.col(column), blocks)).join(word, "_block")
    mask = _mask(F.col(column))
    return hit.where(F.col("_word").bitwiseAND(mask) == mask).drop("_block", "_word")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``.

    ``rules(rule_host, rule_path, verdict)``: a rule fits its host and all
    subdomains where the page's path starts with the rule's; of those that fit
    the longest ``host + path`` wins, then the smaller, then ``allow``.  Without
    a rule a page is blocked if its canonical URL is in ``listed(url)``, else
    allowed.  Null urls and urls without ``://`` have an empty host and path; no
    rule and no list holds those.  Repeated rows come back as often as they
    occur; other columns are ignored; null list entries and rules without a host
    or verdict count for nothing (a null path is empty).  The rules of one host
    and its parents must fit into a row; a host's own listing belongs in ``listed``.
    """
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    names = pages.select("host").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    suffixes = names.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))))
    known = rules.where("rule_host is not null and verdict is not null").select(
        F.translate("rule_host", _UPPER, _LOWER).alias("suffix"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    n_rules = blocks_for(known.count())
    # Rules by host: names are distinct, so a common host or suffix is few rows.
    fitting = possible(suffixes, "suffix", bloom_filter(known, "suffix", n_rules), n_rules).join(known, "suffix")
    fitting = fitting.groupBy("host").agg(F.collect_set(F.struct("suffix", "rule_path", "rule_verdict")).alias("rules"))
    urls = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n"))
    urls = urls.join(fitting, "host", "left")
    ranked = F.transform(
        F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])),
        lambda r: F.struct((-F.length(r["suffix"]) - F.length(r["rule_path"])).alias("o"), F.concat(r["suffix"], r["rule_path"]).alias("rule"), r["rule_verdict"].alias("v")),
    )
    urls = urls.withColumn("best", F.array_min(ranked)).withColumn("key", canonical(F.col("host"), F.col("path")))
    keys = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).where("key <> ''").distinct()
    keys = materialize(keys, "listed")
    blocks = blocks_for(keys.count())
    hits = possible(urls.where("host <> '' and best is null").select("key").distinct(), "key", bloom_filter(keys, "key", blocks), blocks).join(keys, "key", "left_semi")
    urls = urls.join(hits.withColumn("hit", F.lit(True)), "key", "left")
    verdict = F.coalesce("best.v", F.when(F.col("hit"), "block").otherwise("allow"))
    urls = materialize(urls.select("host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")), "urls")
    return pages.join(urls, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
