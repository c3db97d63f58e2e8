"""Licence notices in texts, found by diagonal voting.

Every rolling pair of words of a text is joined to the places of that pair in the templates. A hit at word
``i`` of the text and word ``j`` of a template votes for the diagonal ``i - j``. Votes are summed by diagonal,
diagonals that lie next to each other (words put in or left out) are merged, and a merged run counts when its best
window, of about the template's length, covers enough of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases looked for word by word, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices that may be found with changes, with their labels. No notice has over 60 words.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}

#: Share of a notice's word pairs that a run must hold.
COVERAGE = 0.8
#: Diagonals at most this far apart are merged.
GAP = 2
#: Words that a window of a run may span, as a multiple of the notice's words.
STRETCH = 1.5

#: Words that a notice's run may span, at most.
_REACH = 90
# Words are runs of a-z, 0-9 and characters beyond ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Gram of the row that stands for the text itself; its place is the number of words.
_TEXT = 0


def _words(text: Column) -> Column:
    # lower() maps the Kelvin sign to an ASCII k, where only A-Z are to be lowered.
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("º")))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _pairs(words: Column) -> Column:
    """A 64-bit hash for each word and its follower; the last has none."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """A row for each word pair of each template: gram, place, template, label, exact, n_pairs."""
    every = [(p, label, True) for p, label in phrases.items()]
    every += [(n, label, False) for n, label in notices.items()]
    for words, _, _ in every:
        if not 2 <= len(words.split()) <= 60:
            raise ValueError(f"a template has 2 to 60 words: {words!r}")
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("template"),
                F.lit(words).alias("words"),
                F.lit(label).alias("label"),
                F.lit(exact).alias("exact"),
            )
            for i, (words, label, exact) in enumerate(every)
        ]
    )
    grams = F.slice(_pairs(F.col("parts")), F.lit(1), F.size("parts") - 1)
    return (
        spark.range(1)
        .select(F.inline(rows))
        .withColumn("parts", F.split("words", " "))
        .select(
            "template", "label", "exact", (F.size("parts") - 1).alias("n_pairs"), F.posexplode(grams).alias("place", "gram")
        )
    )


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    coverage: float = COVERAGE,
    tell_apart: bool = True,
) -> DataFrame:
    """The licence notices of each text, as ``spans``: array of (label, exact, start, end, covered), places
    counted in words from 0, end exclusive; with ``n_words``.

    ``phrases`` count where their words stand one after the other; ``notices`` where diagonals of a run of neighbouring
    ones, that lie within half as many words again as the notice has, hold ``coverage`` of its pairs. Of a run the best
    covered window is given, of these the first, so a notice that is there in full is always found. Notices that
    differ in less than ``coverage`` are both found at one place; with ``tell_apart`` one that is not there in full goes
    if one with another label overlaps it and is covered as well or better.

    One row per row of ``docs``, repeated ones too. A null id is an id of its own. A null text is empty; an empty text
    has no words and no spans. Texts are read whole. Ties do not arise, as the places of all runs are reported; an
    empty table gives no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    templates = _templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    # Repeats within a partition are put together before the shuffle, those of different partitions stay apart, so no
    # row is hot, however often it occurs.
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("copy"),
        F.spark_partition_id().alias("part"),
        _words(F.col(text_col)).alias("words"),
    )
    text = ["id", "copy", "part"]
    placed = texts.select(
        *text, F.posexplode(F.concat(_pairs(F.col("words")), F.array(F.lit(_TEXT).cast("long")))).alias("at", "gram")
    )
    itself = spark.range(1).select(
        F.lit(-1).alias("template"),
        F.lit(None).cast("string").alias("label"),
        F.lit(True).alias("exact"),
        F.lit(1).alias("n_pairs"),
        F.lit(0).alias("place"),
        F.lit(_TEXT).cast("long").alias("gram"),
    )
    # The templates are constants, so their side is small at any size of the texts.
    hits = placed.join(F.broadcast(templates.unionByName(itself)), "gram")
    by_template = [*text, "template", "label", "exact", "n_pairs"]
    votes = (
        hits.withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy(*by_template, "diagonal")
        .agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("held"),
            F.min("at").cast("long").alias("start"),
            (F.max("at") + 2).cast("long").alias("end"),
            F.count("*").alias("rows"),
        )
    )
    along = Window.partitionBy(*text, "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal", 1).over(along) > GAP)
    ahead = Window.partitionBy(*text, "template", "run").orderBy("start").rangeBetween(0, _REACH)
    fits = lambda v: v["end"] <= F.col("start") + STRETCH * (F.col("n_pairs") + 1)
    held = lambda vs: F.bit_count(F.aggregate(vs, F.lit(0).cast("long"), lambda b, v: b.bitwiseOR(v["held"])))
    runs = (
        votes.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along))
        .withColumn("ahead", F.collect_list(F.struct("held", "end")).over(ahead))
        .withColumn("ahead", F.filter("ahead", fits))
        .withColumn("best", F.struct((-held(F.col("ahead"))).alias("less"), "start", F.array_max(F.transform("ahead", lambda v: v["end"])).alias("end")))
        .groupBy(*by_template, "run")
        .agg(F.min("best").alias("best"), F.max("rows").alias("rows"))
        .select(*by_template, "rows", "best.start", "best.end", (-F.col("best.less")).alias("held"))
        .withColumn("covered", F.col("held") / F.col("n_pairs"))
    )
    full = F.col("held") == F.col("n_pairs")
    whole = full | (~F.col("exact") & (F.col("covered") >= coverage))
    if tell_apart:
        near = Window.partitionBy(*text).orderBy("start").rangeBetween(-_REACH, _REACH)
        found = F.when(~F.col("exact") & whole, F.struct("label", "start", "end", "covered"))
        beaten = F.exists(
            "near",
            lambda r: (r["label"] != F.col("label"))
            & (r["start"] < F.col("end"))
            & (r["end"] > F.col("start"))
            & (r["covered"] >= F.col("covered")),
        )
        runs = runs.withColumn("near", F.collect_list(found).over(near))
        whole = full | (whole & ~beaten)
    return (
        runs.groupBy(*text)
        .agg(
            F.max(F.when(F.col("template") == -1, F.col("start"))).alias("n_words"),
            F.array_sort(F.collect_list(F.when((F.col("template") >= 0) & whole, F.struct("start", "end", "label", "exact", "covered")))).alias("spans"),
            F.coalesce(F.max(F.when((F.col("template") >= 0) & (whole | ~F.col("exact")), F.col("covered"))), F.lit(0.0)).alias("score"),
            F.max(F.when(F.col("template") == -1, F.col("rows"))).alias("rows"),
        )
        .select(F.col("id").alias(id_col), "n_words", "spans", "score", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth"))
        .drop("nth")
    )


def license_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last place of the phrases, and the labels as sorted lists."""
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        "score",
    )


def license_sql() -> str:
    """The digest in DuckDB SQL over the table ``documents``."""
    values = ", ".join(
        f"({i}, string_split('{words}', ' '), '{label}', {exact})"
        for i, (words, label, exact) in enumerate(
            [(p, x, "true") for p, x in PHRASES.items()] + [(n, x, "false") for n, x in NOTICES.items()]
        )
    )
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {values}) AS v(template, parts, label, exact_)),
grams AS (
  SELECT template, label, exact_, len(parts) - 1 AS n_pairs, j - 1 AS place, parts[j] AS w0, parts[j + 1] AS w1
  FROM (SELECT *, unnest(range(1, len(parts))) AS j FROM templates)
),
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
placed AS (
  SELECT row_, i - 1 AS at_, words[i] AS w0, words[i + 1] AS w1
  FROM (SELECT *, unnest(range(1, len(words))) AS i FROM texts)
),
hits AS (SELECT p.row_, p.at_, g.* FROM placed p JOIN grams g USING (w0, w1)),
votes AS (
  SELECT row_, template, label, exact_, n_pairs, at_ - place AS diagonal, list(place) AS held,
    min(at_) AS start_, max(at_) + 2 AS end_
  FROM hits GROUP BY ALL
),
marked AS (
  SELECT *, CASE WHEN exact_ OR coalesce(diagonal - lag(diagonal) OVER w > {GAP}, true) THEN 1 ELSE 0 END AS apart
  FROM votes WINDOW w AS (PARTITION BY row_, template ORDER BY diagonal)
),
numbered AS (
  SELECT *, sum(apart) OVER (PARTITION BY row_, template ORDER BY diagonal) AS run FROM marked
),
windows AS (
  SELECT a.row_, a.template, a.label, a.exact_, a.n_pairs, a.run, a.diagonal, a.start_, max(b.end_) AS end_,
    len(list_distinct(flatten(list(b.held)))) AS held
  FROM numbered a JOIN numbered b ON a.row_ = b.row_ AND a.template = b.template AND a.run = b.run
    AND b.start_ >= a.start_ AND b.end_ <= a.start_ + {STRETCH} * (a.n_pairs + 1)
  GROUP BY a.row_, a.template, a.label, a.exact_, a.n_pairs, a.run, a.diagonal, a.start_
),
runs AS (
  SELECT *, held / n_pairs AS covered FROM windows
  QUALIFY row_number() OVER (PARTITION BY row_, template, run ORDER BY held DESC, start_, end_) = 1
),
found AS (SELECT * FROM runs WHERE NOT exact_ AND covered >= {COVERAGE}),
judged AS (
  SELECT *, held = n_pairs OR (NOT exact_ AND covered >= {COVERAGE} AND NOT EXISTS (
    FROM found f WHERE f.row_ = r.row_ AND f.label <> r.label AND f.start_ < r.end_ AND f.end_ > r.start_
      AND f.covered >= r.covered)) AS whole
  FROM runs r
),
by_text AS (
  SELECT row_, count(*) FILTER (exact_ AND whole) AS n_base, min(start_) FILTER (exact_ AND whole) AS first_word,
    max(start_) FILTER (exact_ AND whole) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (exact_ AND whole))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label) FILTER (whole))), ',') AS labels,
    max(covered) FILTER (whole OR NOT exact_) AS score
  FROM judged GROUP BY row_
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts t LEFT JOIN by_text b USING (row_)
"""
