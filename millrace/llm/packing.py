"""Packing documents into sequences of one length, best fit first, without conflicts in a sequence.

A bin never holds two documents of one source, nor two of one cluster of duplicates. Bins are kept in the order of
the room they have left, each with a bitmap of its sources and one of its clusters; the search starts at the first
bin with enough room and goes on until it meets the tightest that is compatible. A bit that several sources or clusters
share only tells where to look at their ids. Documents are dealt to shards by
a hash of their id and text, so that a frequent source or a large cluster is spread over all shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import add_columns, raw_text
from millrace.llm.graph import written
from millrace.llm.signature_join import row_hash

#: Words in a sequence.
CAPACITY = 2048
#: Documents in a shard, about.
SHARD = 8192
#: Bins looked at in one step of the search.
_STRIDE = 64
#: Sources, and clusters, of a shard that have a bit of their own.
_OWN = 32


def _bits(values: pd.Series, own: int) -> np.ndarray:
    """A bit for each value, none for a value that is there once. The ``own`` most frequent ones have a bit of their
    own, from the lowest up; the others share those above."""
    codes, _ = pd.factorize(values)
    counts = np.bincount(codes)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    place = np.where(rank < own, rank, own + rank % (64 - own))
    bits = np.where(counts > 1, np.uint64(1) << place.astype(np.uint64), np.uint64(0))
    return bits[codes]


def best_fit(
    sizes: np.ndarray,
    sources: np.ndarray,
    clusters: np.ndarray,
    capacity: int,
    source_ids: np.ndarray | None = None,
    cluster_ids: np.ndarray | None = None,
    own: int = 64,
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given. ``sources`` and ``clusters`` are bits. Values share those from
    the bit ``own`` up, so a bin that holds one of them is asked for the ids themselves."""
    n = len(sizes)
    room, held_sources, held_clusters, names = np.empty(n, np.int64), np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.int64)
    columns = (room, held_sources, held_clusters, names)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    open_bins = made = 0
    sure = np.uint64((1 << own) - 1)
    # The ids of shared bits that each bin holds, by name.
    held_ids: list[set[tuple[bool, int]]] = []

    def shift(start: int, end: int, by: int) -> None:
        for c in columns:
            c[start + by : end + by] = c[start:end].copy()

    for i in range(n):
        size, source, cluster = sizes[i], sources[i], clusters[i]
        shared = []
        if source > sure:
            shared.append((True, int(source_ids[i])))
        if cluster > sure:
            shared.append((False, int(cluster_ids[i])))
        at = int(np.searchsorted(room[:open_bins], size))
        found = -1
        stride = _STRIDE
        while at < open_bins and found < 0:
            end = min(open_bins, at + stride)
            of_sources, of_clusters = held_sources[at:end] & source, held_clusters[at:end] & cluster
            if shared:
                # Those that hold the id of a bit of its own are out; the others, up to the first sure one, are asked.
                fits = ((of_sources | of_clusters) & sure) == 0
                for k in np.flatnonzero(fits):
                    if not (of_sources[k] | of_clusters[k]) or held_ids[names[at + k]].isdisjoint(shared):
                        found = at + int(k)
                        break
            else:
                fits = (of_sources | of_clusters) == 0
                k = int(fits.argmax())
                if fits[k]:
                    found = at + k
            at, stride = end, 2 * stride
        if found < 0:
            name, left, s, c = made, capacity - size, source, cluster
            held_ids.append(set())
            made += 1
        else:
            name, left = names[found], room[found] - size
            s, c = held_sources[found] | source, held_clusters[found] | cluster
            shift(found + 1, open_bins, -1)
            open_bins -= 1
        held_ids[name].update(shared)
        bins[i], offsets[i] = name, capacity - left - size
        if left > 0:
            to = int(np.searchsorted(room[:open_bins], left))
            shift(to, open_bins, 1)
            room[to], held_sources[to], held_clusters[to], names[to] = left, s, c, name
            open_bins += 1
    return bins, offsets


def _pack(capacity: int, piece: pd.DataFrame) -> pd.DataFrame:
    piece = piece.sort_values(["size", "copy", "row", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    source, cluster = piece["source"], piece["cluster"]
    bins, offsets = best_fit(
        piece["size"].to_numpy(np.int64), _bits(source, _OWN), _bits(cluster, _OWN), capacity, source.to_numpy(np.int64), cluster.to_numpy(np.int64), _OWN
    )
    return pd.DataFrame({"row": piece["row"], "start": piece["start"], "size": piece["size"], "bin": (piece["shard"].to_numpy(np.int64) << 32) + bins, "offset": offsets})


def _measure():
    def of(texts: list[bytes]) -> list:
        words = [raw.split() for raw in texts]
        return [[len(w) for w in words], [xxhash.xxh64_intdigest(b" ".join(w).lower()) >> 1 for w in words]]

    return of


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    shard: int = SHARD,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Where each document lies: its id, ``start`` and ``n_words`` of the piece, ``bin_id`` and ``bin_offset``.

    A document longer than ``capacity`` is cut into pieces of that many words and the rest, and no word is lost.
    ``cluster`` tells duplicates apart, or ``clusters`` does, a table of :func:`near_clusters`; without them documents
    of equal words (A-Z in either case) are duplicates.
    A text without words, or null, has one row with no bin. A null source is a source of its own; null ids are
    packed as well; repeated rows are each packed, in different bins as they are duplicates; ties in size go by a
    hash of id and text, then by their order in the input. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    kept = {"id": F.col(id_col), "source": F.xxhash64(F.col(source_col)), "copy": F.xxhash64(F.col(id_col), F.col(text_col))}
    if cluster is not None:
        kept["given"] = F.xxhash64(cluster)
    if clusters is not None:
        kept["of_row"] = row_hash(id_col, text_col)
    measured = add_columns(docs, kept, [raw_text(text_col)], _measure, "words bigint, equal bigint")
    if clusters is not None:
        # Of a row in no cluster, the hash of its words is as good as any.
        measured = measured.join(clusters, "of_row", "left").withColumn("given", F.coalesce("cluster", "equal"))
    given = "equal" if cluster is None and clusters is None else "given"
    # A document's own row: its place among rows is fixed once written.
    rows = written(
        measured.select("id", "source", "copy", F.col(given).alias("cluster"), "words").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "lengths",
    )
    n_shards = max(1, -(-rows.count() // shard))
    starts = F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(capacity).cast("long"))
    pieces = (
        rows.filter("words > 0")
        .withColumn("shard", F.pmod(F.xxhash64("copy", "row"), F.lit(n_shards)))
        .select("row", "copy", "source", "cluster", "shard", "words", F.explode(starts).alias("start"))
        .withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start")))
        .drop("words")
    )
    placed = pieces.groupBy("shard").applyInPandas(
        lambda piece: _pack(capacity, piece), "row bigint, start bigint, size bigint, bin bigint, offset bigint"
    )
    return (
        rows.select("row", "id")
        .join(placed, "row", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("start", F.lit(0).cast("long")).alias("start"),
            F.coalesce("size", F.lit(0).cast("long")).alias("n_words"),
            F.col("bin").alias("bin_id"),
            F.col("offset").alias("bin_offset"),
        )
    )
