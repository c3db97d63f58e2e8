"""A language model by deleted interpolation: word pairs, words and a floor, mixed by how often the context was seen.

Texts are packed into units. A unit asks for the counts of its distinct words and word pairs, sending its own ones
along; requests meet in buckets by the words' hashes, where they are summed, and every unit gets its totals back. So
each count covers the whole corpus, but no word is sent more than once a unit, and no table of all words is held
anywhere. The weights are learnt by expectation-maximisation on a fold of the training texts that is held out: its
own counts are taken away (deleted) from the estimates that it is predicted with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.batches import ROWS, WordHashes, id_remainder, mixed, packed, raw_text, unpacked
from millrace.llm.graph import written

#: Remainders of crc32(doc_id as text) modulo 7: never learnt from, and the fold that the weights are learnt on.
HELD_OUT, FOLD = 2, 3
#: Bytes of text in a unit, about; a longer text is a unit of its own.
UNIT = 8_000_000
#: Distinct words and pairs that meet in one bucket, about.
BUCKET = 1_500_000
#: Steps of the histogram that weights are learnt on, to a doubling.
STEPS = 8
WORDS, PAIRS = 0, 1

_END, _START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _packing(id_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as units; those of the fold apart from the others."""
    task, made = TaskContext.get().partitionId(), 0
    pools = {False: ([], [], [], []), True: ([], [], [], [])}

    def flush(fold: bool) -> pa.RecordBatch:
        nonlocal made
        ids, learnt, rest, texts = pools[fold]
        made += 1
        raw = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        row = [[(task << 32) + made], [fold], [ids], [learnt], [rest], [[len(x) for x in texts]], [raw]]
        types = [pa.int64(), pa.bool_(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        pools[fold] = ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=_UNIT_NAMES)

    size = {False: 0, True: 0}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            for key, remainder, raw in zip(*[c.to_pylist() for c in part.columns]):
                fold = remainder == FOLD
                for pool, value in zip(pools[fold], (key, remainder != HELD_OUT, remainder == HELD_OUT, raw)):
                    pool.append(value)
                size[fold] += len(raw) + 64
                if size[fold] >= UNIT:
                    yield flush(fold)
                    size[fold] = 0
    for fold in (False, True):
        if pools[fold][0]:
            yield flush(fold)


_UNIT_NAMES = ["unit", "fold", "ids", "learnt", "held_out", "sizes", "raw"]


@dataclass
class Tokens:
    """A unit's tokens: hashes of words and ends, of each with its predecessor, and where each text starts."""

    words: np.ndarray
    pairs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def unit_tokens(raw: bytes, sizes: list[int], hashes: WordHashes) -> Tokens:
    text = zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, sum(sizes)))
    found, at = [], 0
    for size in sizes:
        found.append(np.append(hashes.of(text[at : at + size].lower().split()), _END))
        at += size
    lengths = np.array([len(x) for x in found])
    words = np.concatenate(found)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    before = np.concatenate(([_START], words[:-1]))
    before[starts] = _START
    return Tokens(words, mixed(before * _FACTOR + words), starts, lengths)


def _bucket(grams: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes, so that a sorted list of hashes is sorted by bucket as well."""
    return ((grams >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def _requests(n_buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for i in range(batch.num_rows):
            unit, fold, learnt, sizes, raw = [c[i].as_py() for c in batch.columns]
            tokens = unit_tokens(raw, sizes, hashes)
            counted = np.repeat(np.array(learnt, bool), tokens.lengths)
            for kind, grams in ((WORDS, tokens.words), (PAIRS, tokens.pairs)):
                held, place = np.unique(grams, return_inverse=True)
                counts = np.bincount(place[counted], minlength=len(held))
                bucket = _bucket(held, n_buckets).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                spans = list(zip(cuts[:-1], cuts[1:]))
                steps = [np.diff(held[s:e], prepend=np.uint64(0)) for s, e in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([2 * int(bucket[s]) + kind for s, _ in spans], pa.int64()),
                        pa.array([unit] * len(spans), pa.int64()),
                        pa.array([fold] * len(spans), pa.bool_()),
                        pa.array([packed(x) for x in steps], pa.binary()),
                        pa.array([packed(counts[s:e]) for s, e in spans], pa.binary()),
                    ],
                    names=["bucket", "unit", "fold", "grams", "counts"],
                )


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals for each request, in its order; units of the fold get its totals as well. The first row of a bucket
    tells its distinct words, tokens, and tokens of the fold. Rows come sorted by bucket."""

    def answer(bucket: int, units: list, folds: list, grams: list, counts: list) -> pa.RecordBatch:
        sizes = [len(g) for g in grams]
        held, place = np.unique(np.concatenate(grams), return_inverse=True)
        counted = np.concatenate(counts).astype(np.int64)
        in_fold = np.repeat(folds, sizes)
        totals = np.bincount(place, counted, len(held)).astype(np.int64)
        of_fold = np.bincount(place[in_fold], counted[in_fold], len(held)).astype(np.int64)
        cuts = np.cumsum(sizes)[:-1]
        words = bucket % 2 == WORDS
        first = lambda n: [int(n) if words else 0] + [0] * (len(units) - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([bucket] * len(units), pa.int64()),
                pa.array(units, pa.int64()),
                pa.array(folds, pa.bool_()),
                pa.array([packed(p) for p in np.split(totals[place], cuts)], pa.binary()),
                pa.array([packed(p) if f else None for p, f in zip(np.split(of_fold[place], cuts), folds)], pa.binary()),
                pa.array(first((totals > 0).sum()), pa.int64()),
                pa.array(first(totals.sum()), pa.int64()),
                pa.array(first(of_fold.sum()), pa.int64()),
            ],
            names=["bucket", "unit", "fold", "totals", "of_fold", "distinct", "tokens", "fold_tokens"],
        )

    at, rows = None, ([], [], [], [])
    for batch in batches:
        for bucket, unit, fold, grams, counts in zip(*[c.to_pylist() for c in batch.columns]):
            if bucket != at and rows[0]:
                yield answer(at, *rows)
                rows = ([], [], [], [])
            at = bucket
            for held, value in zip(rows, (unit, fold, np.cumsum(unpacked(grams), dtype=np.uint64), unpacked(counts))):
                held.append(value)
    if rows[0]:
        yield answer(at, *rows)


@dataclass
class Corpus:
    """Distinct words, tokens, and tokens of the fold, in the training texts."""

    distinct: int
    tokens: int
    fold_tokens: int


def _counts(replies: list, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a unit's distinct words and pairs, from its replies in the order of their buckets."""
    ordered = sorted(replies, key=lambda r: r["bucket"])
    both = [[unpacked(r[name]).astype(np.int64) for r in ordered if r["bucket"] % 2 == kind] for kind in (WORDS, PAIRS)]
    return np.concatenate(both[0]), np.concatenate(both[1])


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket to each doubling of their count."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def _estimates(tokens: Tokens, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """For each token: its count, its context's bucket, and the estimates from words and from pairs."""
    held_words, word_at = np.unique(tokens.words, return_inverse=True)
    _, pair_at = np.unique(tokens.pairs, return_inverse=True)
    count = words[word_at]
    before = np.concatenate(([0], count[:-1]))
    before[tokens.starts] = words[np.searchsorted(held_words, _END)]  # as many texts start as end
    return count, context_bucket(before), count / max(1, total), pairs[pair_at] / np.maximum(before, 1)


def _histogram(corpus: Corpus, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, raw, replies = [c[i].as_py() for c in batch.columns]
            tokens = unit_tokens(raw, sizes, hashes)
            every, own = _counts(replies, "totals"), _counts(replies, "of_fold")
            _, bucket, one, two = _estimates(
                tokens, every[0] - own[0], every[1] - own[1], corpus.tokens - corpus.fold_tokens
            )
            step = lambda p: np.where(p > 0, np.floor(np.log2(np.maximum(p, 1e-30)) * STEPS), 1).astype(np.int64)
            cells = np.stack([bucket, step(one), step(two)], axis=1)
            held, place = np.unique(cells, axis=0, return_inverse=True)
            place = place.reshape(-1)
            columns = [held[:, 0], held[:, 1], held[:, 2], np.bincount(place), np.bincount(place, one), np.bincount(place, two)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "s1", "s2", "n", "one", "two"])


def learn_weights(cells: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights of floor, words and pairs for each context bucket, by expectation-maximisation on held-out cells of
    (bucket, tokens, estimate from words, estimate from pairs). A bucket without cells takes the one below it."""
    n_buckets = 64
    weights = np.tile([0.1, 0.4, 0.5], (n_buckets, 1))
    weights[0] = [0.2, 0.8, 0.0]
    for b in range(n_buckets):
        mine = cells[cells[:, 0] == b]
        if not len(mine) or not mine[:, 1].sum():
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        parts = np.stack([np.full(len(mine), floor), mine[:, 2], mine[:, 3]], axis=1)
        for _ in range(rounds):
            share = parts * weights[b]
            share /= share.sum(axis=1, keepdims=True)
            weights[b] = (share * mine[:, 1:2]).sum(axis=0) / mine[:, 1].sum()
        # The floor keeps every word possible.
        weights[b, 0] = max(weights[b, 0], 1e-6)
        weights[b] /= weights[b].sum()
    return weights


def _scores(corpus: Corpus, weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    floor = 1 / (corpus.distinct + 1)
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, raw, replies = [batch.column(k)[i].as_py() for k in (2, 3, 4)]
            tokens = unit_tokens(raw, sizes, hashes)
            count, bucket, one, two = _estimates(tokens, *_counts(replies, "totals"), corpus.tokens)
            mix = weights[bucket]
            score = np.log10(mix[:, 0] * floor + mix[:, 1] * one + mix[:, 2] * two)
            base = np.log10((count + 1) / (corpus.tokens + corpus.distinct + 1))
            total = lambda x: np.add.reduceat(x, tokens.starts)
            columns = [batch.column(0)[i].values, batch.column(1)[i].values]
            columns += [pa.array(x) for x in (tokens.lengths.astype(np.int64), total((count > 0).astype(np.int64)), total(base), total(score))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its id, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (words alone, each count raised by one) and ``score``, the model's log10
    probability of the text.

    A null or empty text is one token, the end. A null id is learnt from and scored like others, as the empty text
    for its remainder. Repeated rows are each counted and scored. Whole texts are read however long; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    chosen = docs.select(F.col(id_col).alias("id"), id_remainder(id_col, 7).alias("remainder"), raw_text(text_col).alias("raw"))
    name = kind.simpleString()
    units = written(
        chosen.mapInArrow(
            partial(_packing, to_arrow_type(kind)),
            f"unit bigint, fold boolean, ids array<{name}>, learnt array<boolean>, held_out array<boolean>, sizes array<bigint>, raw binary",
        ),
        "units",
    )
    size = units.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    n_buckets = int(min(32_768, max(8, size // 8 // BUCKET + 1)))
    asked = units.select("unit", "fold", "learnt", "sizes", "raw").mapInArrow(
        partial(_requests, n_buckets), "bucket bigint, unit bigint, fold boolean, grams binary, counts binary"
    )
    replies = written(
        asked.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(
            _replies,
            "bucket bigint, unit bigint, fold boolean, totals binary, of_fold binary, distinct bigint, tokens bigint, fold_tokens bigint",
        ),
        "replies",
    )
    sums = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "tokens", "fold_tokens")]).first()
    corpus = Corpus(sums.distinct, sums.tokens, sums.fold_tokens)

    def answered(only: Column, *columns: str) -> DataFrame:
        # A unit has a reply from each bucket, of counts of its own words alone.
        found = replies.filter(only).groupBy("unit").agg(F.collect_list(F.struct(*columns)).alias("replies"))
        return units.filter(only).join(found, "unit")

    cells = (
        answered(F.col("fold"), "bucket", "totals", "of_fold")
        .select("sizes", "raw", "replies")
        .mapInArrow(partial(_histogram, corpus), "bucket bigint, s1 bigint, s2 bigint, n bigint, one double, two double")
        .groupBy("bucket", "s1", "s2")
        .agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
        .select("bucket", "n", F.col("one") / F.col("n"), F.col("two") / F.col("n"))
        .toPandas()
        .sort_values(["bucket", "n"])
        .to_numpy(float)
    )
    weights = learn_weights(cells.reshape(-1, 4), 1 / (corpus.distinct + 1))
    scored = (
        answered(F.lit(True), "bucket", "totals")
        .select("ids", "held_out", "sizes", "raw", "replies")
        .mapInArrow(
            partial(_scores, corpus, weights),
            f"id {name}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
        )
    )
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
