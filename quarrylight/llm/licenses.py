"""License scan as an exact set-similarity join in DataFrame operations only.

Every line of every text is a block, every template a set of words. So is, in texts of several lines, every run of twice the longest
template's words that starts at a multiple of its length: a template that is wrapped over lines lies whole in one of them. A block meets a template when it holds at least `threshold`
of the template's words. Template words are ordered by how many documents hold them, rarest first, counted over the whole
corpus; the join runs on the words of the prefixes that a match must share, keeps pairs that pass the length and positional
bounds, and verifies each pair once. The template side is a fixed list, so what is broadcast is bounded by that list.

Base labels come from phrases whose words stand consecutively.

Texts are tokenised in one pass, which writes a row for each document: its number of words, those words of templates and phrases
that it holds, and its text only if it holds as many words of a template as a match asks for, or all words of a phrase. What
follows (document counts, order, blocks, join) reads that table.

Defined results: null text counts as empty; repeated rows get a row each; a null doc_id stays null; texts of any length are
tokenised whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Usual license sentences and the label each stands for.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a template's words that a block must hold: all but one word of a short template would mistake one for another.
THRESHOLD = 0.9


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""

    def here(word: Column, i: Column) -> Column:
        same = word == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            same = same & (F.get(words, i + k) == other)
        return F.when(same, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def templates(threshold: float, chosen: list[tuple[str, str]] | None = None) -> list[dict]:
    """Word sets with the overlap each one asks for (computed in whole numbers)."""
    import math

    out = []
    for k, (label, sentence) in enumerate(chosen or TEMPLATES):
        words = sorted(set(sentence.split()))
        out.append({"tid": k, "label": label, "words": words, "length": len(sentence.split()), "need": max(1, math.ceil(round(threshold * len(words), 9)))})
    return out


def _runs(lines: Column, longest: int) -> Column:
    """Runs of 2 * longest words of a text's lines, a step of `longest` apart; none where there is one line."""
    words = F.flatten(lines)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - longest, F.lit(1)), F.lit(longest))
    return F.when(F.size(lines) > 1, F.transform(starts, lambda i: F.slice(words, i, 2 * longest))).otherwise(F.array().cast("array<array<string>>"))


def tokenised(docs: DataFrame, sets: list[dict]) -> DataFrame:
    """One row per document, numbered: doc_id, n_words, held (the words of templates and phrases in it, each once), text (lower
    case; null where neither a template nor a phrase can be met)."""
    phrases = [p.split() for p in PHRASES]
    vocabulary = sorted({w for t in sets for w in t["words"]} | {w for p in phrases for w in p})
    # lower() may turn other letters than A-Z into ASCII ones too: n_words stays, held can only grow
    d = docs.select("doc_id", "text", _words(F.lower(F.coalesce("text", F.lit("")))).alias("words"))
    d = d.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), F.array_intersect(F.array(*map(F.lit, vocabulary)), "words").alias("held"))
    asked = [(t["words"], t["need"]) for t in sets] + [(p, len(set(p))) for p in phrases]
    enough = F.lit(False)
    for words, need in asked:
        enough = enough | (F.size(F.array_intersect("held", F.array(*map(F.lit, words)))) >= need)
    text = F.when(enough, F.translate("text", UPPER, LOWER)).alias("text")
    return d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "held", text)


def document_frequency(read: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of the given words stands; as many rows as words reach the driver."""
    found = read.select(F.explode("held").alias("word")).where(F.col("word").isin(words))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def block_matches(read: DataFrame, sets: list[dict]) -> DataFrame:
    """(row, label, containment): one line for each block and template that meet. read: as tokenised() gives it."""
    spark = read.sparkSession
    vocabulary = sorted({w for t in sets for w in t["words"]})
    counts = document_frequency(read, vocabulary)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}  # rarest first
    index = []  # prefix word -> template, its place there
    for t in sets:
        ranks = sorted(order[w] for w in t["words"])
        for at, rank in enumerate(ranks[: len(ranks) - t["need"] + 1]):
            index.append((rank, t["tid"], t["label"], at, len(ranks), t["need"], ranks))
    least = min(t["need"] for t in sets)
    leading = [w for w in vocabulary if order[w] in {i[0] for i in index}]
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, tid int, label string, t_at int, t_size int, need int, t_ranks array<int>"))
    rank_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])

    lines = read.where("text is not null").select("row", F.transform(F.split("text", "\n"), _words).alias("lines"))
    blocks = lines.select("row", F.posexplode(F.concat("lines", _runs(F.col("lines"), max(t["length"] for t in sets)))).alias("block_no", "words"))
    blocks = blocks.select("row", "block_no", F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("words"))
    blocks = blocks.where((F.size("words") >= least) & F.arrays_overlap("words", F.array(*map(F.lit, leading))))
    blocks = blocks.select("row", "block_no", F.array_sort(F.transform("words", lambda w: F.element_at(rank_of, w))).alias("ranks"))
    tokens = blocks.select("*", F.size("ranks").alias("size"), F.posexplode("ranks").alias("at", "rank"))
    near = tokens.join(prefixes, "rank").where(
        (F.col("size") >= F.col("need"))  # length
        & (F.col("at") <= F.col("size") - F.col("need"))  # the block's prefix
        & (F.least("at", "t_at") + F.least(F.col("size") - F.col("at"), F.col("t_size") - F.col("t_at")) >= F.col("need"))  # position
    )
    common = F.array_intersect("ranks", "t_ranks")
    # a pair is verified at its first common prefix word only
    near = near.where(F.array_min(common) == F.col("rank"))
    return near.withColumn("common", F.size(common)).where(F.col("common") >= F.col("need")).select("row", "label", (F.col("common") / F.col("t_size")).alias("containment"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, chosen: list[tuple[str, str]] | None = None) -> DataFrame:
    """License labels of every document."""
    sets = templates(threshold, chosen)
    read = written(tokenised(docs, sets), "words")
    words = F.when(F.contains("text", F.lit("license")), _words(F.col("text")))
    places = F.concat(*[_labelled(_places(F.col("words"), p.split()), label) for p, label in PHRASES.items()])
    base = read.where("text is not null").select("row", words.alias("words")).where("words is not null").select("row", places.alias("places")).where(F.size("places") > 0)
    base = base.select(
        "row",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        F.sort_array(F.array_distinct(F.col("places.label"))).alias("base"),
    )
    own = block_matches(read, sets).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    j = read.select("row", "doc_id", "n_words").join(own, "row", "left").join(base, "row", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("own", none)))
    return j.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.concat_ws(",", F.coalesce("base", none)).alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the same result by comparing every line, and every run across lines, with every template."""
    longest = max(t["length"] for t in templates(threshold))
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    rows = ", ".join(f"('{t['label']}', {t['words']!r}, {t['need']})" for t in templates(threshold))
    places = " UNION ALL ".join(
        f"SELECT k, i - 1 AS place, '{label}' AS label FROM spots WHERE " + " AND ".join(f"words[i + {n}] = '{w}'" for n, w in enumerate(p.split())) for p, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {low} AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{cls}') AS words FROM d),
spots AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE t LIKE '%license%'),
places AS ({places}),
base AS (SELECT k, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS base FROM places GROUP BY k),
tpl(label, tw, need) AS (VALUES {rows}),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
wrapped AS (SELECT k, list_distinct(words[i:i + {2 * longest - 1}]) AS words FROM (SELECT k, words, unnest(range(1, greatest(len(words) - {longest}, 1) + 1, {longest})) AS i FROM w WHERE contains(t, chr(10)))),
sets AS (SELECT k, list_distinct(regexp_extract_all(line, '{cls}')) AS words FROM lines UNION ALL SELECT * FROM wrapped),
hits AS (SELECT k, label, len(list_intersect(words, tw)) / len(tw) AS containment FROM sets, tpl WHERE len(list_intersect(words, tw)) >= need),
own AS (SELECT k, list(DISTINCT label) AS own, max(containment) AS best FROM hits GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  CAST(greatest(coalesce(best, 0.0), CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN own USING (k)
"""
