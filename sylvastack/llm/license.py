"""License scans by diagonal voting: word bigrams meet template positions in a join, and votes are counted by offset diagonal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a text are runs of digits, letters a-z and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever they stand, and the label of each.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Wordings of the method's own, of any length, and the label of each.
WORDINGS = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "mit-full",
    ),
]
#: Diagonals this far apart, or this share of the wording's words, belong to one passage with words put in or left out.
SLACK, SLACK_SHARE = 2, 1 / 32
#: A span is longer than its wording by at most 2 x SLACK and this share of its words.
LONGER = 0.2
#: Share of a wording's bigrams that a span must hold; those that tell versions apart (``telling``) must be among them.
COVERAGE = 0.7


def _every(wordings: list[tuple[str, str]]) -> list[tuple[int, list[str], str, bool]]:
    """(template, words, label, base) of base phrases and wordings."""
    every = [(t, phrase.split(), label, base) for t, (phrase, label, base) in enumerate([(p, x, True) for p, x in PHRASES] + [(p, x, False) for p, x in wordings])]
    if short := [" ".join(w) for _, w, _, _ in every if len(w) < 2]:
        raise ValueError(f"a wording has two words at least: {short}")
    return every


def telling(words: list[str], others: list[list[str]]) -> list[int]:
    """Places of the bigrams without which a wording would pass for another: those that hold a number, and the last one if another wording has nearly all the rest."""
    pairs = list(zip(words, words[1:]))
    must = [i for i, pair in enumerate(pairs) if any(w.isdigit() for w in pair)]
    like = [set(zip(o, o[1:])) for o in others if o != words]
    sibling = any(pairs[-1] not in o and sum(p in o for p in pairs) >= COVERAGE * len(pairs) for o in like)
    return sorted({*must, len(pairs) - 1}) if sibling else must


def _must(wordings: list[tuple[str, str]]) -> dict[int, list[int]]:
    every = [(t, w) for t, w, _, base in _every(wordings) if not base]
    found = {t: telling(w, [o for _, o in every]) for t, w in every}
    return {t: places for t, places in found.items() if places}


def _bigrams(wordings: list[tuple[str, str]] = WORDINGS) -> list[tuple]:
    return [(t, label, base, len(words), i, a, b) for t, words, label, base in _every(wordings) for i, (a, b) in enumerate(zip(words, words[1:]))]


def templates(spark: SparkSession, wordings: list[tuple[str, str]] = WORDINGS) -> DataFrame:
    rows = spark.createDataFrame(_bigrams(wordings), "template int, label string, base boolean, size int, pos int, a string, b string")
    return rows.withColumn("h", F.xxhash64("a", "b"))


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wordings: list[tuple[str, str]] = WORDINGS) -> DataFrame:
    """(id, text_key, label, base, start, end, coverage): spans of words from 0, end exclusive; coverage in (0, 1].

    Base phrases are exact: all their bigrams on one diagonal. Wordings may lack words or hold others: diagonals within
    ``SLACK`` or a share of the wording merge, and the span is kept from ``COVERAGE`` on, if it isn't too long and holds the
    bigrams that tell versions apart. text_key is a hash of the text; rows that repeat an id
    and a text give their spans once. Null text: no span. Ids may be null. Other columns are not read. ``wordings``:
    (words in lower case with single blanks, label), two words each at least, of any length.

    The templates' bigrams do not grow with the corpus and are broadcast. Votes are bits, one for each bigram of a
    template, in as many longs as the longest template needs. Upper and lower case of letters outside ASCII may fall
    together; of ASCII letters they can reach k and i only (Kelvin sign, dotted I).
    """
    longs = 1 + max(len(p.split()) - 2 for p, _ in [*PHRASES, *wordings]) // 64
    votes = [f"votes{k}" for k in range(longs)]
    bit = F.expr("shiftleft(1L, pos % 64)")
    w = F.col("w")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), words(text_col).alias("w"))
    grams = rows.select("id", "text_key", F.posexplode(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")))).where("col.b is not null")
    grams = grams.select("id", "text_key", F.col("pos").alias("at"), F.col("col.a").alias("da"), F.col("col.b").alias("db"), F.xxhash64("col.a", "col.b").alias("dh"))
    t = F.broadcast(templates(docs.sparkSession, wordings))
    hits = grams.join(t, (F.col("dh") == F.col("h")) & (F.col("da") == F.col("a")) & (F.col("db") == F.col("b")))
    diagonal = hits.groupBy("id", "text_key", "template", "label", "base", "size", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        *(F.bit_or(F.when(F.floor(F.col("pos") / 64) == k, bit).otherwise(F.lit(0).cast("long"))).alias(v) for k, v in enumerate(votes)), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    by = Window.partitionBy("id", "text_key", "template").orderBy("diagonal")
    apart = F.col("base") | F.lag("diagonal").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > F.greatest(F.lit(SLACK), F.floor(F.col("size") * SLACK_SHARE)))
    merged = diagonal.withColumn("passage", F.sum(apart.cast("int")).over(by)).groupBy("id", "text_key", "template", "label", "base", "size", "passage").agg(
        *(F.bit_or(v).alias(v) for v in votes), F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high") + 2).alias("end")
    )
    coverage = reduce(lambda x, y: x + y, map(F.bit_count, votes)) / (F.col("size") - 1)
    told = F.lit(True)
    for template, places in _must(wordings).items():
        masks = {p // 64: 0 for p in places}
        for p in places:
            masks[p // 64] |= 1 << p % 64
        signed = {k: m - (1 << 64) if m >> 63 else m for k, m in masks.items()}
        told &= (F.col("template") != template) | reduce(lambda x, y: x & y, (F.col(votes[k]).bitwiseAND(F.lit(m)) == m for k, m in signed.items()))
    kept = F.when(F.col("base"), coverage == 1).otherwise((coverage >= COVERAGE) & told & (F.col("end") - F.col("start") <= F.col("size") * (1 + LONGER) + 2 * SLACK))
    return merged.withColumn("coverage", coverage).where(kept).select("id", "text_key", "label", "base", F.col("start").cast("long"), F.col("end").cast("long"), "coverage")


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the best coverage of a span, 0 without one. Texts without spans have empty label strings. A repeated row
    shows its spans each time.
    """
    spans = license_spans(docs, id_col, text_col)
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("id", "text_key").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.size(words(text_col)).cast("long").alias("n_words"))
    out = rows.join(found, rows.doc_id.eqNullSafe(found.id) & (rows.key == found.text_key), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The rows of op3_license in DuckDB SQL."""
    values = ",\n".join(f"({t}, '{label}', {str(base).lower()}, {size}, {i}, '{a}', '{b}')" for t, label, base, size, i, a, b in _bigrams())
    told = "case template " + " ".join(f"when {t} then list_has_all(votes, {places})" for t, places in _must(WORDINGS).items()) + " else true end"
    return rf"""
with t as (select * from (values {values}) as t(template, label, base, size, pos, a, b)),
w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
g as (select doc_id, unnest(range(1, len(ws))) i, ws from w),
h as (select doc_id, template, label, base, size, (i - 1 - pos) dg, pos from (select doc_id, i, ws[i] x, ws[i+1] y from g) q join t on t.a = q.x and t.b = q.y),
dgl as (select doc_id, template, label, base, size, dg, list(distinct pos) votes, min(pos) lo, max(pos) hi from h group by all),
m as (select *, case when base or lag(dg) over wd is null or dg - lag(dg) over wd > greatest({SLACK}, floor(size * {SLACK_SHARE}::double)) then 1 else 0 end ap from dgl window wd as (partition by doc_id, template order by dg)),
n as (select *, sum(ap) over (partition by doc_id, template order by dg rows unbounded preceding) pa from m),
p as (select doc_id, template, label, base, size, pa, list_distinct(flatten(list(votes))) votes, len(list_distinct(flatten(list(votes)))) / (size - 1) cov, min(dg + lo) st, max(dg + hi + 2) en from n group by doc_id, template, label, base, size, pa),
s as (select * from p where case when base then cov = 1 else cov >= {COVERAGE} and {told} and en - st <= size * {1 + LONGER}::double + {2 * SLACK} end),
f as (select doc_id, count(*) filter (base) nb, min(st) filter (base) fw, max(st) filter (base) lw,
  coalesce(string_agg(distinct label, ',' order by label) filter (base), '') bl, string_agg(distinct label, ',' order by label) lb, max(cov) sc from s group by 1)
select w.doc_id, len(ws)::bigint n_words, coalesce(nb, 0)::bigint n_base, fw::bigint first_word, lw::bigint last_word, coalesce(bl, '') base_labels, coalesce(lb, '') labels, coalesce(sc, 0)::double score
from w left join f on w.doc_id = f.doc_id"""
