"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame expressions only.

Texts become their words joined by single spaces.  A rule is a regular
expression over them with keywords, a priority and a confidence.  A document
is looked at only if the gate finds a word that some rule needs, and meets only
the rules of which it contains a keyword; every match holds one.  Detections are intervals of words; one
that lies within another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Phrases of the contract and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, keywords of which every match holds one (``*``: a word that starts so), names (over lower-case words), in natural order.
NAMES = [
    ("0bsd", "0bsd|bsd", r"(?:0bsd|0 clause bsd|bsd zero clause|zero clause bsd)"),
    ("afl", "academic", r"academic free(?: license)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public(?: license)?"),
    ("agpl", "agpl*", r"(?:gnu )?agpl(?:v?3)?"),
    ("apache", "apache", r"apache(?: software)?(?: license)?(?: version)?(?: 1 0| 1 1| 2 0| 2)?"),
    ("apsl", "apple", r"apple public source"),
    ("artistic", "artistic", r"(?:perl )?artistic"),
    ("beerware", "beerware", r"beerware"),
    ("bitstream", "bitstream", r"bitstream vera(?: font)?"),
    ("blueoak", "blue", r"blue oak model"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)"),
    ("bsd", "bsd|berkeley", r"(?:berkeley software distribution|bsd(?: style)?)"),
    ("bsl", "boost", r"boost software"),
    ("busl", "business", r"business source"),
    ("cc-by", "attribution", r"(?:creative commons |cc )?attribution(?: international)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] 0)?"),
    ("cc-by-nc", "noncommercial", r"(?:creative commons |cc )?attribution noncommercial"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "noderivatives", r"(?:creative commons |cc )?attribution noderivatives"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "sharealike", r"(?:creative commons |cc )?attribution sharealike"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] 0)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc", "creative", r"creative commons"),
    ("cddl", "cddl", r"cddl"),
    ("cddl", "development", r"common development and distribution"),
    ("cecill", "cecill", r"cecill(?: [abc])?"),
    ("cpl", "common", r"common public"),
    ("ecl", "educational", r"educational community"),
    ("epl", "eclipse", r"eclipse public"),
    ("eupl", "european", r"european union public"),
    ("eupl", "eupl", r"eupl"),
    ("fair", "fair", r"fair source"),
    ("fdl", "documentation", r"(?:gnu )?free documentation"),
    ("gpl", "general", r"(?:gnu )?general public(?: license)?"),
    ("gpl", "gpl*", r"(?:gnu )?gpl(?: ?v?[123])?"),
    ("isc", "isc", r"isc"),
    ("json", "json", r"json"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public(?: license)?"),
    ("lgpl", "library", r"(?:gnu )?library general public(?: license)?"),
    ("lgpl", "lgpl*", r"(?:gnu )?lgpl(?: ?v?[23])?"),
    ("llama", "llama", r"llama(?: 2| 3)? community"),
    ("lppl", "latex", r"latex project public"),
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("mpl", "mozilla", r"mozilla public"),
    ("mpl", "mpl*", r"mpl(?: ?[12](?: [01])?)?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl", "database", r"open (?:data commons )?database"),
    ("ofl", "font", r"(?:sil )?open font"),
    ("osl", "open", r"open software"),
    ("php", "php", r"php"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf", "python", r"python(?: software foundation)?"),
    ("qpl", "q", r"q public"),
    ("rail", "rail|responsible ai", r"(?:open )?(?:responsible ai|rail(?: m)?)"),
    ("ruby", "ruby", r"ruby"),
    ("sspl", "server", r"server side public"),
    ("sleepycat", "sleepycat", r"sleepycat"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl", "universal", r"universal permissive"),
    ("vim", "vim", r"vim"),
    ("w3c", "w3c", r"w3c(?: software)?"),
    ("wtfpl", "wtfpl|fuck", r"(?:wtfpl|do what the fuck you want to public)"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng)"),
    ("zpl", "zope", r"zope public"),
]
#: Forms in which a name states a license: pattern, priority, confidence.
FORMS = [
    (r"spdx license identifier {name}(?: only| or later)?", 3, 1.0),
    (r"(?:licensed|released|distributed|published|offered|available|provided|used|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:either )?{name}(?: license)?(?: (?:version|v) ?[0-9]+(?: [0-9]+)?)?", 2, 0.95),
    (r"{name} (?:public )?licen[cs]ed?(?: (?:version|v) ?[0-9]+(?: [0-9]+)?)?", 1, 0.8),
    (r"licen[cs]e (?:is |name |type )?(?:the )?{name}", 1, 0.7),
]
#: Wording of license texts: label, keywords, pattern, priority, confidence.
WORDING = [
    ("apache", "perpetual", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 2, 0.95),
    ("apache", "compliance", r"you may not use this file except in compliance with the license", 2, 0.9),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 2, 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 2, 0.9),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 2, 0.95),
    ("bsl", "boost", r"boost software license version 1 0", 2, 0.95),
    ("cc0", "waive|waives", r"waives? (?:all )?(?:of )?(?:his or her|their|its) rights to the work", 2, 0.8),
    ("epl", "eclipse", r"the accompanying materials are made available under the terms of the eclipse public license", 2, 0.95),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 2, 0.98),
    ("isc", "copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 2, 0.95),
    ("lgpl", "lesser", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license", 2, 0.98),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 2, 0.95),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license", 2, 0.98),
    ("no-warranty", "warranty", r"without (?:any )?warranty(?: of any kind)?", 0, 0.3),
    ("proprietary", "rights", r"all rights reserved", 0, 0.4),
    ("proprietary", "confidential", r"confidential and proprietary", 1, 0.7),
    ("public-domain", "domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain", 2, 0.9),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 3, 0.98),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 2, 0.9),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 2, 0.9),
]
#: A text without any of these holds no rule's match.
GATE = r"(?i)licen|spdx|permission|warrant|redistribut|public[\W_]+domain|all[\W_]+rights|confidential|waive|endorse|altered|perpetual|fuck|(?:released|distributed|published|offered|available|provided|used)[\W_]+under"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """``(number, label, keywords, pattern, priority, confidence)`` of every rule, in order."""
    named = [(label, word, form.replace("{name}", name), priority, sure) for label, word, name in NAMES for form, priority, sure in FORMS]
    based = [(label, "license", phrase, 0, 0.6) for phrase, label in BASE]
    return [(k, *rule[:2], rf"(?<= )(?:{rule[2]})(?= )", *rule[3:]) for k, rule in enumerate([*named, *WORDING, *based])]


def keywords() -> dict[str, list[int]]:
    """What a normal text may hold, and the numbers of the rules that are tried then."""
    out: dict[str, list[int]] = {}
    for k, _, words, *_ in rules():
        for word in words.split("|"):
            out.setdefault(f" {word[:-1]}" if word.endswith("*") else f" {word} ", []).append(k)
    return out


def _normal(text: Column) -> Column:
    """The words of a text, each after one space, and a space at the end."""
    words = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _detections(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``(row, first, last, label, priority, sure)``: what the rules find in ``rows(row, words)``, before suppression."""
    table = ", ".join(f"named_struct('rule', {k}, 'label', '{label}', 'pattern', r'{pattern}', 'priority', {priority}, 'sure', {sure}D)" for k, label, _, pattern, priority, sure in rules())
    gates = ", ".join(f"named_struct('keyword', '{word}', 'rules', array({', '.join(map(str, numbers))}))" for word, numbers in keywords().items())
    open_ = F.filter(F.expr(f"array({gates})"), lambda g: F.contains(F.col("words"), g["keyword"]))
    tried = rows.withColumn("k", F.explode(F.array_distinct(F.flatten(F.transform(open_, lambda g: g["rules"])))))
    hit = tried.withColumn("rule", F.get(F.expr(f"array({table})"), F.col("k"))).drop("k")
    found = hit.withColumn("matches", F.regexp_extract_all("words", F.col("rule.pattern"), F.lit(0))).where(F.size("matches") > 0)
    found = found.withColumn("parts", F.split("words", F.col("rule.pattern"), -1))
    each = found.select("row", "rule", F.posexplode(F.arrays_zip("parts", "matches")).alias("k", "at")).where("at.matches is not null")
    through = Window.partitionBy("row", "rule.rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(_spaces(F.col("at.parts")) + _spaces(F.col("at.matches"))).over(through) - 1
    return each.select("row", (end - _spaces(F.col("at.matches"))).alias("first"), end.alias("last"), "rule.*")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row of ``docs(doc_id, text)``.

    Words are runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z lower-cased.  ``n_base`` counts the places of the base
    phrases, ``first_word`` and ``last_word`` are the smallest and largest start
    (null without any).  ``labels`` adds those of the detections that are not
    suppressed; ``score`` is the largest confidence of these, else 0.  Null texts
    count as empty; repeated rows and null ids are no special case.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = docs.where(~F.col("text").rlike(GATE)).select("doc_id", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"))
    gated = docs.where(F.col("text").rlike(GATE)).select("doc_id", _normal(F.col("text")).alias("words"))
    gated = materialize(gated.withColumn("row", F.monotonically_increasing_id()), "licenses")
    found = _detections(spark, gated)
    nested = Window.partitionBy("row").orderBy("first", F.desc("last"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("last"))).over(nested) for p in range(4)]
    within = F.coalesce(*(F.when(F.col("priority") == p, reach[p]) for p in range(4)))
    kept = found.withColumn("within", within).where("within is null or within < last")
    told = kept.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("sure").alias("score"))
    n, first, last, labels = F.lit(0).cast("long"), [], [], []
    n_words = F.greatest(_spaces(F.col("words")) - 1, F.lit(0))
    for phrase, label in BASE:
        held = F.contains(F.col("words"), F.lit(f" {phrase} "))
        n = n + F.when(held, F.regexp_count("words", F.lit(f"(?<= ){phrase}(?= )")).cast("long")).otherwise(0)
        before = F.locate(f" {phrase} ", F.col("words"))
        first.append(F.when(held, _spaces(F.substring(F.col("words"), F.lit(1), before)) - 1))
        turned = F.locate(f" {phrase[::-1]} ", F.reverse("words"))
        after = _spaces(F.substring(F.reverse("words"), F.lit(1), turned)) - 1
        last.append(F.when(held, n_words - after - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    gated = gated.join(told, "row", "left").select(
        "doc_id",
        n_words.alias("n_words"),
        n.alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    none = F.lit(None).cast("long")
    return gated.unionByName(
        plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    )
