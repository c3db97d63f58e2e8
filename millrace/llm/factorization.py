"""A quality classifier: a factorisation machine over hashed words, text statistics and metadata."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import add_columns, id_remainder, raw_text
from millrace.llm.labelled import labelled_sample
from millrace.llm.statistics import SHARES, text_statistics

#: Buckets that words are hashed into.
BUCKETS = 4096
#: Rank of the pairwise interactions.
RANK = 8
#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 8_000
#: Documents with this remainder of crc32(doc_id as text) modulo 3 are never learnt from.
HELD_OUT = 1
# Inputs besides words: the statistics, the metadata's length, and whether it is missing.
_MORE = len(SHARES) + 2


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their weights: damped counts, scaled to length 1."""
    words = raw.lower().split()
    buckets = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
    counts = np.bincount(buckets, minlength=BUCKETS)
    held = np.flatnonzero(counts)
    weights = 1 + np.log(counts[held])
    return held, weights / max(1e-9, np.sqrt((weights**2).sum()))


def more_inputs(raw: bytes, length: int | None) -> list[float]:
    """The text's statistics and what the metadata says of its length."""
    return [*text_statistics(raw)[1], float(np.log1p(max(0, length or 0))), float(length is None)]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, words: list[tuple[np.ndarray, np.ndarray]], more: np.ndarray) -> np.ndarray:
        x = np.zeros((len(words), BUCKETS + _MORE), np.float32)
        for i, (held, weights) in enumerate(words):
            x[i, held] = weights
        x[:, BUCKETS:] = np.clip((more - self.mean) / self.scale, -4, 4)
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds. The pairs' sum is half of (sum of squares' difference), so it costs as much as the inputs:
        sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)."""
        summed = x @ self.factors
        pairs = 0.5 * (summed**2 - (x**2) @ (self.factors**2)).sum(axis=1)
        return self.bias + x @ self.linear + pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(words: list, more: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Minimise log-loss by AdaGrad over shuffled batches; the seed is fixed, so equal samples give equal machines."""
    draw = np.random.default_rng(11)
    size = BUCKETS + _MORE
    more = more.reshape(len(words), _MORE)
    mean = more.mean(axis=0) if len(words) else np.zeros(_MORE)
    scale = np.maximum(more.std(axis=0), 1e-3) if len(words) else np.ones(_MORE)
    m = Machine(0.0, np.zeros(size, np.float32), draw.normal(0, 0.02, (size, RANK)).astype(np.float32), mean, scale)
    if not len(words) or y.min() == y.max():
        m.bias = 0.0 if not len(words) else float(np.log((y.mean() + 0.01) / (1.01 - y.mean())))
        m.factors[:] = 0
        return m
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = draw.permutation(len(words))
        for start in range(0, len(order), 128):
            rows = order[start : start + 128]
            x = m.dense([words[i] for i in rows], more[rows])
            error = ((m.score(x) - y[rows]) / len(rows)).astype(np.float32)
            gw = x.T @ error + decay * m.linear
            summed = x @ m.factors
            gv = x.T @ (error[:, None] * summed) - m.factors * ((x**2).T @ error)[:, None] + decay * m.factors
            seen_w += gw**2
            seen_v += gv**2
            seen_b += float(error.sum()) ** 2
            m.linear -= rate * gw / np.sqrt(seen_w)
            m.factors -= rate * 0.5 * gv / np.sqrt(seen_v)
            m.bias -= rate * float(error.sum()) / seen_b**0.5
    return m


def fit_machine(
    docs: DataFrame,
    labels: DataFrame,
    only: Column | None = None,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = "n_chars",
) -> Machine:
    """A machine for ``labels.quality``, fitted on at most ``sample`` labelled documents; ``only`` says which
    labels may be used. Without labels every score is one half."""

    def make():
        def inputs(texts: list[bytes], lengths: list) -> list:
            found = [hashed_words(raw) for raw in texts]
            return [
                [held.astype(np.uint16).tobytes() for held, _ in found],
                [weights.astype(np.float32).tobytes() for _, weights in found],
                [more_inputs(raw, n) for raw, n in zip(texts, lengths)],
            ]

        return inputs

    texts = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw"), _length(length_col).alias("length"))
    chosen = labelled_sample(texts, labels, "quality", sample, only, id_col)
    rows = add_columns(
        chosen,
        {"id": F.col("id"), "y": F.col("y")},
        [F.col("raw"), F.col("length")],
        make,
        "held binary, weights binary, more array<double>",
    ).collect()
    rows.sort(key=lambda r: (r.id, r.more))
    words = [(np.frombuffer(r.held, np.uint16).astype(np.int64), np.frombuffer(r.weights, np.float32)) for r in rows]
    return fit(words, np.array([r.more for r in rows], float), np.array([r.y for r in rows], float))


def _length(name: str | None) -> Column:
    return F.lit(None).cast("bigint") if name is None else F.col(name).cast("bigint")


def quality_scores(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """A row for each row of ``docs``: its id and ``score``, the probability that its quality is 1.

    A null text counts as empty, and empty texts are scored; a missing length is an input of its own. A null id
    stays null; repeated rows are each scored. Whole texts are read however long; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """

    def make():
        def scores(texts: list[bytes], lengths: list) -> list:
            more = np.array([more_inputs(raw, n) for raw, n in zip(texts, lengths)], float)
            return [machine.score(machine.dense([hashed_words(raw) for raw in texts], more)).astype(float).tolist()]

        return scores

    return add_columns(docs, {id_col: F.col(id_col)}, [raw_text(text_col), _length(length_col)], make, "score double")


def learnable(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 3) != HELD_OUT


def score_digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(
        id_col, (~learnable(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
