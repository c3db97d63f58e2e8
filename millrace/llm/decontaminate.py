"""Benchmark items inside documents, by MinHash containment search.

Items are partitioned by size. A document that holds 80 % of an item's shingles holds at least one of its k
smallest hashes, with k = n - ceil(0.8 n) + 1 for an item of n shingles: a MinHash sketch as long as the item's
partition needs, that misses nothing. Documents, however long, are looked up by all their shingles, because a
short item leaves no trace in a bounded sketch of a long text. Hits are checked by exact containment of shingles.

An item of fewer words than a shingle has is one shingle of its own width. Documents get the shingles of each width
that such items have, so that they are found inside texts as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import WordHashes, add_columns, mixed, raw_text, rolling
from millrace.llm.graph import written
from millrace.llm.signature_join import WIDTH, shingles

#: Share of an item's shingles that a document must hold.
CONTAINED = 0.8
#: Shingles of all items, at most, for the index to be sent to every task; beyond, it is joined.
SENT_SHINGLES = 2_000_000


def sketch_length(n: int, contained: float = CONTAINED) -> int:
    """Smallest hashes of an item of ``n`` shingles of which any document that contains it holds one."""
    return n - int(np.ceil(contained * n - 1e-9)) + 1


def sketch(grams: np.ndarray, contained: float = CONTAINED) -> np.ndarray:
    """The shingles of an item whose hashes, in an order of their own, are smallest."""
    return grams[np.argsort(mixed(grams ^ np.uint64(0xA0761D6478BD642F)))[: sketch_length(len(grams), contained)]]


@dataclass
class SizePartition:
    """Items of up to ``upper`` shingles: sketch hashes, sorted, and the place of the item each belongs to."""

    upper: int
    hashes: np.ndarray
    of: np.ndarray


def partitions(items: list[np.ndarray], contained: float = CONTAINED) -> list[SizePartition]:
    """Sketches of the items by size, each partition up to twice the size of the one before."""
    by_size: dict[int, list[int]] = {}
    for place, grams in enumerate(items):
        if len(grams):
            by_size.setdefault(1 << (len(grams) - 1).bit_length(), []).append(place)
    out = []
    for upper, places in sorted(by_size.items()):
        found = [sketch(items[p], contained) for p in places]
        hashes, of = np.concatenate(found), np.repeat(places, [len(f) for f in found])
        order = np.argsort(hashes, kind="stable")
        out.append(SizePartition(upper, hashes[order], of[order]))
    return out


def search(
    grams: np.ndarray, items: list[np.ndarray], index: list[SizePartition], contained: float = CONTAINED
) -> list[tuple[int, int]]:
    """(place, shared shingles) of the items that a document's shingles contain."""
    hits: set[int] = set()
    for part in index:
        low = np.searchsorted(part.hashes, grams, side="left")
        found = np.flatnonzero(part.hashes[np.minimum(low, len(part.hashes) - 1)] == grams)
        for i in found:
            k = low[i]
            while k < len(part.hashes) and part.hashes[k] == grams[i]:
                hits.add(int(part.of[k]))
                k += 1
    out = []
    for place in sorted(hits):
        shared = int(np.isin(items[place], grams, assume_unique=True).sum())
        if shared >= contained * len(items[place]) - 1e-9:
            out.append((place, shared))
    return out


def runs_of_words(raw: bytes, hashes: WordHashes, widths: list[int]) -> np.ndarray:
    """Sorted hashes of a document's distinct shingles and of its runs of as many words as short items have. A run
    has the hash that :func:`shingles` gives an item of these words."""
    if not widths:
        return shingles(raw, hashes)
    ids = hashes.of(raw.lower().split())
    found = [mixed(rolling(ids, w) + np.uint64(w)) for w in widths]
    return np.unique(np.concatenate([rolling(ids, WIDTH), *found]))


def _short_widths(items: DataFrame) -> list[int]:
    return sorted(r.width for r in items.filter(F.col("width").between(1, WIDTH - 1)).select("width").distinct().collect())


def _item_sets():
    hashes = WordHashes()

    def of(texts: list[bytes]) -> list:
        found = [shingles(raw, hashes) for raw in texts]
        return [[g.view(np.int64).tolist() for g in found], [len(raw.split()) for raw in texts]]

    return of


def _by_index(docs: DataFrame, kept: dict[str, Column], items: DataFrame, contained: float, text_col: str) -> DataFrame:
    widths = _short_widths(items)
    rows = items.collect()
    rows.sort(key=lambda r: (r.item is None, r.item, r.grams))
    names = [r.item for r in rows]
    sent = docs.sparkSession.sparkContext.broadcast([np.array(r.grams, np.int64).view(np.uint64) for r in rows])

    def make():
        hashes, held = WordHashes(), sent.value
        index = partitions(held, contained)

        def leaks(texts: list[bytes]) -> list:
            found = [search(runs_of_words(raw, hashes, widths), held, index, contained) if index else [] for raw in texts]
            return [[[(names[p], n, len(held[p])) for p, n in hits] for hits in found]]

        return leaks

    kind = items.schema["item"].dataType.simpleString()
    return add_columns(docs, kept, [raw_text(text_col)], make, f"leaks array<struct<item:{kind},shared:bigint,n:bigint>>")


def _by_join(docs: DataFrame, kept: dict[str, Column], items: DataFrame, contained: float, text_col: str) -> DataFrame:
    """The same for benchmarks of any size: sketches are joined to all shingles of all documents, then the items
    hit are joined to the document's shingles again for the exact check."""
    widths = _short_widths(items)

    def documents():
        hashes = WordHashes()
        return lambda texts: [[runs_of_words(raw, hashes, widths).view(np.int64).tolist() for raw in texts]]

    sets = add_columns(docs, {**kept, "row": F.monotonically_increasing_id()}, [raw_text(text_col)], documents, "grams array<bigint>")
    sets = written(sets, "shingles")

    def make():
        return lambda grams: [[sketch(np.array(g, np.int64).view(np.uint64), contained).view(np.int64).tolist() if g else [] for g in grams]]

    numbered = written(items.withColumn("place", F.monotonically_increasing_id()), "items")
    keys = add_columns(numbered, {"place": F.col("place")}, [F.col("grams")], make, "keys array<bigint>")
    keys = keys.select("place", F.explode("keys").alias("gram"))
    each = sets.select("row", F.explode("grams").alias("gram"))
    hits = each.join(keys, "gram").select("row", "place").distinct()
    wanted = hits.join(numbered.select("place", F.explode("grams").alias("gram")), "place")
    shared = wanted.join(each, ["row", "gram"]).groupBy("row", "place").agg(F.count("*").alias("shared"))
    found = (
        shared.join(numbered.select("place", "item", F.size("grams").alias("n")), "place")
        .filter(F.col("shared") >= contained * F.col("n") - 1e-9)
        .select("row", F.struct("item", "shared", F.col("n").cast("long").alias("n")).alias("leak"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("leak")).alias("leaks"))
    )
    empty = F.array().cast(found.schema["leaks"].dataType)
    return sets.join(found, "row", "left").select(*kept, F.coalesce("leaks", empty).alias("leaks"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    kept: dict[str, Column],
    contained: float = CONTAINED,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    sent_shingles: int = SENT_SHINGLES,
) -> DataFrame:
    """The ``kept`` columns of each row of ``docs`` with ``leaks``: (item, shared shingles, shingles of the item)
    of every benchmark item that its text contains.

    Null and empty texts and items hold and match nothing; an item of fewer words than a shingle is found where all its
    words stand one after the other. Repeated rows are each searched; repeated items are reported once an id. Null ids
    stay null. Whole texts are read however long; empty tables give no leaks; other columns are
    ignored, whatever their names.
    """
    chosen = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("words")).distinct()
    items = add_columns(chosen, {"item": F.col("item")}, [raw_text("words")], _item_sets, "grams array<bigint>, width bigint")
    total = items.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    way = _by_index if total <= sent_shingles else _by_join
    return way(docs, kept, items, contained, text_col)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """A row for each document and benchmark item it contains: ids, shared shingles, the item's, and their share.
    Cases as in :func:`leaks`."""
    found = leaks(docs, benchmark, {"id": F.col(id_col)}, **settings)
    return (
        found.select(F.col("id").alias(id_col), F.inline("leaks"))
        .select(id_col, F.col("item").alias("item_id"), F.col("shared").alias("n_shared"), F.col("n").alias("n_shingles"))
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, in all their columns. Cases as in :func:`leaks`."""
    kept = {f"c{i}": F.col(f"`{name}`") for i, name in enumerate(docs.columns)}
    found = leaks(docs, benchmark, kept, **settings)
    return found.filter(F.size("leaks") == 0).select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


#: The pairs in DuckDB SQL over ``documents`` and ``benchmark``.
CONTAMINATED_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, string_split_regex(trim(w, ' '), ' ') AS parts, w FROM (
    SELECT doc_id, array_to_string(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents)
  UNION ALL
  SELECT 'i', item_id, string_split_regex(w, ' '), w FROM (
    SELECT item_id, array_to_string(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM benchmark)
),
widths AS (SELECT DISTINCT least(len(parts), 5) AS width FROM words WHERE side = 'i' AND w <> ''),
grams AS (
  SELECT DISTINCT side, id, array_to_string(parts[k : k + 4], ' ') AS gram
  FROM (SELECT side, id, parts, unnest(range(1, greatest(len(parts) - 3, 2))) AS k FROM words WHERE side = 'i' AND w <> '')
  UNION ALL
  SELECT DISTINCT side, id, array_to_string(parts[k : k + width - 1], ' ') AS gram
  FROM (SELECT side, id, parts, width, unnest(range(1, len(parts) - width + 2)) AS k FROM words, widths WHERE side = 'd' AND w <> '')
),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM grams d JOIN grams i ON d.gram = i.gram AND d.side = 'd' AND i.side = 'i' GROUP BY 1, 2
)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE n_shared >= 0.8 * n
"""
