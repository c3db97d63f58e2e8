"""Words of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import plot_call
from millrace.functions.words import split_words


def tokenize(df: DataFrame, col: str, *keep: str, name: str = "word") -> DataFrame:
    """One row per word of ``col``, with the columns ``keep``. Null and empty texts give none."""
    words = df.select(*keep, F.explode(split_words(F.col(col))).alias(name))
    return words.filter(F.col(name) != "")


def word_lengths(df: DataFrame, col: str) -> DataFrame:
    """``(word, length)`` for every word."""
    return df.select(F.col(col).alias("word"), F.length(col).alias("length"))


def lines_with(df: DataFrame, col: str, keyword: str) -> DataFrame:
    """Rows whose text contains the keyword, case included."""
    return df.filter(F.col(col).contains(keyword))


def word_count(words: DataFrame, col: str = "word") -> DataFrame:
    """Non-null count per word; counted in each map task before the shuffle, so frequent words do
    not gather in one task."""
    return words.groupBy(col).agg(F.count(col).alias("word_count"))


def top_word(words: DataFrame, col: str = "word", n: int = 1) -> DataFrame:
    """The most frequent words; equal counts are ordered by the word."""
    return word_count(words, col).orderBy(F.desc("word_count"), F.asc(col)).limit(n)


def plot_call_counts(df: DataFrame, col: str) -> DataFrame:
    """How many texts name each plotting function first."""
    return (
        df.select(plot_call(F.col(col)).alias("plot"))
        .filter(F.col("plot").isNotNull())
        .groupBy("plot")
        .agg(F.count(F.lit(1)).alias("n"))
    )
