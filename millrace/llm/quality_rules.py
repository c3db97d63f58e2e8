"""Which documents to keep, by fixed rules and by boosted trees over document statistics."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import boosting
from millrace.llm.batches import add_columns, raw_text
from millrace.llm.labelled import labelled_sample
from millrace.llm.statistics import COUNTS, SHARES, text_statistics

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 12_000
# Features in which the score may only fall: more symbols, repeated lines or repeated words never help.
FALLING = ["symbol_share", "symbol_word_share", "dup_line_share", "repeat_share", "top_share"]
#: Probability of good quality under which a document goes.
KEEP_AT = 0.5

# A text fails with fewer words than this, or with more than this percentage of repeated words.
MIN_WORDS = 20
MAX_REPEATED = 30

_COUNT_FIELDS = ", ".join(f"{name} bigint" for name in COUNTS)


def _features(texts: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    found = [text_statistics(raw) for raw in texts]
    return [x[0] for x in found], np.array([x[1] for x in found]).reshape(len(texts), len(SHARES))


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> boosting.Trees:
    """Trees for ``labels.quality``, fitted on at most ``sample`` labelled documents. Without any labels the
    trees keep every document."""

    def make():
        return lambda texts: [_features(texts)[1].tolist()]

    texts = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw"))
    chosen = labelled_sample(texts, labels, "quality", sample, id_col=id_col)
    rows = add_columns(chosen, {"id": F.col("id"), "y": F.col("y")}, [F.col("raw")], make, "x array<double>").collect()
    rows.sort(key=lambda r: (r.id, r.y, r.x))
    x = np.array([r.x for r in rows]).reshape(len(rows), len(SHARES))
    return boosting.fit(x, np.array([r.y for r in rows], float), {SHARES.index(f): -1 for f in FALLING})


def quality_rules(
    docs: DataFrame, trees: boosting.Trees, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each row of ``docs``: its id, the counts, ``base_failed``, the trees' ``score`` (probability of
    good quality) and ``kept``.

    A null or empty text has no words and fails. A null id stays null; repeated rows are each judged. Whole
    texts are read however long; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return add_columns(docs, {id_col: F.col(id_col)}, [raw_text(text_col)], partial(_judge, trees, keep_at), _VERDICT)


_VERDICT = f"{_COUNT_FIELDS}, base_failed boolean, kept boolean, score double"


def _judge(trees: boosting.Trees, keep_at: float):
    def judge(texts: list[bytes]) -> list:
        counts, x = _features(texts)
        score = trees.probability(x) if len(trees.feature) else np.ones(len(texts))
        failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEATED * c[0] for c in counts]
        kept = [not f and bool(s >= keep_at) for f, s in zip(failed, score)]
        return [*map(list, zip(*counts)), failed, kept, score.tolist()]

    return judge


def keep_good(docs: DataFrame, trees: boosting.Trees, keep_at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, in all their columns; one pass, nothing is shuffled."""
    kept = {name: F.col(f"`{name}`") for name in docs.columns}
    judged = add_columns(
        docs, {f"c{i}": c for i, c in enumerate(kept.values())}, [raw_text(text_col)], partial(_judge, trees, keep_at), _VERDICT
    )
    return judged.filter("kept").select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(kept)])
