"""Phrases whose words stand together more often than their parts suggest, by suffix trees cut at four words.

The suffixes of all pieces of text, truncated to four words, form one tree for each language whose nodes are phrases and
whose leaf totals are counts. It is never built in one place. Word prefixes are partitioned as follows: a prefix of one word stands
for the subtree under it; where more suffixes lie there than the budget of a group, the prefix is extended by the next word, and
again by one more. Prefixes are put together into groups of about the budget, each group's suffixes are sorted into its
own subtrees, and a node's count is the sum of the leaves under it. Counts of one and two words come from the counts
of prefixes that partitioning needs anyway.

A phrase is never more frequent than a part of it, so suffixes end before a word or pair below the least count. What is
frequent is told to the tasks by bitmaps of hashes of bounded size; a bit set by mistake costs a few rows, never a count.
Words travel as 64-bit hashes, with a seed for which no two of them have the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.batches import REMEMBERED, ROWS, mixed, raw_text
from millrace.llm.graph import written

LEAST = 30
DEPTH = 4
TOP = 2_000
#: A phrase goes if a longer one holds at least this share of its places, in percent.
COVERED = 80
SCALE = 2_000_000
NO_LANG = "und"
#: Suffixes under the prefixes of one group.
BUDGET = 2_000_000
#: Buckets of prefix hashes that groups are made of.
BUCKETS = 65_536
#: Bits of a bitmap for each of its members, and at most.
BITS_EACH = 16
MOST_BITS = 1 << 30
#: Rows that a task puts together before it sends them on.
_HELD = 1_000_000
_SEGMENT = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BREAK = b"."
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + _BREAK * len(_ENDS))
_H = ("h1", "h2", "h3", "h4")


def tokens(raw: bytes) -> list[bytes]:
    """Words in order, and a full stop, which is in no word, between pieces."""
    return raw.translate(_TABLE).replace(_BREAK, b" . ").split()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(raw_text(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))


def word_hash(lang: str, word: bytes, seed: int) -> int:
    """Never zero, which marks the end of a piece."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed) or 1


def _some(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages, ``ROWS`` at a time: what a task makes of texts takes several times their room."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _counted_words(seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
            counts.clear()
            hashes = np.array([word_hash(lang, word, seed) for lang, word, _ in rows], np.uint64)
            columns = [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1].decode() for r in rows], pa.string()),
                _signed(hashes),
                pa.array([r[2] for r in rows], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])

        for texts, names in _some(batches):
            for raw, lang in zip(texts, names):
                words = counts.setdefault(lang, Counter())
                words.update(tokens(raw))
                del words[_BREAK]
                if sum(map(len, counts.values())) >= REMEMBERED:
                    yield flush()
        yield flush()

    return run


def count_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """``lang, word, h, n`` for every word, and the seed of ``h``, under which no two words are equal."""
    for seed in range(100):
        rows = texts.mapInArrow(_counted_words(seed), "lang string, word string, h bigint, n bigint")
        words = written(rows.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("h").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


class Bitmap:
    """Which hashes may be members: one bit for each hash's leading bits."""

    def __init__(self, bits: np.ndarray, size: int) -> None:
        self.bits, self.raw = bits, bits.tobytes()
        self.shift = np.uint64(64 - size.bit_length() + 1)

    def holds_one(self, hashed: int) -> int:
        at = hashed >> int(self.shift)
        return self.raw[at >> 3] >> (at & 7) & 1

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bitmap(members: DataFrame, column: str, n: int) -> Bitmap:
    """A bitmap of the hashes in ``column``. It is put together segment by segment in the tasks; the driver gets at most
    ``MOST_BITS`` bits, whatever the number of members."""
    size = min(MOST_BITS, max(_SEGMENT, 1 << (BITS_EACH * n).bit_length()))
    shift = 64 - size.bit_length() + 1

    def segment(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(_SEGMENT, np.uint8)
        bits[rows.column("bit").to_numpy() % _SEGMENT] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([packed], pa.binary())})

    bit = F.shiftrightunsigned(F.col(column), shift).alias("bit")
    kept = members.select(bit).distinct().withColumn("segment", F.expr(f"bit div {_SEGMENT}"))
    bits = np.zeros(size // 8, np.uint8)
    for row in kept.groupBy("segment").applyInArrow(segment, "segment bigint, bits binary").collect():
        at = row.segment * (_SEGMENT // 8)
        bits[at : at + _SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return Bitmap(bits, size)


class FrequentHashes(dict):
    """Words of one language to their hashes; zero for those that are surely not frequent."""

    def __init__(self, lang: str, seed: int, frequent: Bitmap) -> None:
        self.lang, self.seed, self.holds = lang, seed, frequent.holds_one
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        found = word_hash(self.lang, word, self.seed)
        self[word] = found = found if self.holds(found) else 0
        return found


def _streams(batches: Iterable[pa.RecordBatch], seed: int, frequent: Bitmap) -> Iterator[np.ndarray]:
    """The hashes of some texts one after the other, with a zero where no phrase goes on."""
    langs: dict[str, FrequentHashes] = {}
    for texts, names in _some(batches):
        out = []
        for raw, lang in zip(texts, names):
            if sum(map(len, langs.values())) >= REMEMBERED:
                langs.clear()
            known = langs.get(lang)
            if known is None:
                known = langs[lang] = FrequentHashes(lang, seed, frequent)
            words = tokens(raw)
            words.append(_BREAK)
            out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        yield np.concatenate(out)


def runs(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal neighbouring rows as one, with the sum of their weights."""
    if not len(weights):
        return columns, weights
    new = np.ones(len(weights), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.nonzero(new)[0]
    return [c[first] for c in columns], np.add.reduceat(weights, first)


def combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows and how often each stands there. Sorted by one hash: where two rows share it, one may come back in parts."""
    hashed = columns[0]
    for column in columns[1:]:
        hashed = mixed(hashed * _FACTOR + column)
    order = np.argsort(hashed)
    return runs([c[order] for c in columns], np.ones(len(order), np.int64))


def _combined_batches(parts: Iterable[list[np.ndarray]], names: list[str], extra=None) -> Iterator[pa.RecordBatch]:
    """Rows put together before they are sent, ``_HELD`` at a time."""
    held, rows = [], 0

    def flush() -> pa.RecordBatch:
        columns, n = combined([np.concatenate(c) for c in zip(*held)])
        arrays = [*map(_signed, columns), pa.array(n)]
        if extra is not None:
            arrays.append(pa.array(extra(columns)))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= _HELD:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def pair_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mixed(mixed(h1) * _FACTOR + h2)


def count_pairs(texts: DataFrame, seed: int, frequent: Bitmap, least: int) -> DataFrame:
    """``h1, h2, p, n``: neighbouring words with at least ``least`` places, and a hash of the two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for a in _streams(batches, seed, frequent):
                at = np.nonzero((a[:-1] > 0) & (a[1:] > 0))[0]
                yield [a[at], a[at + 1]]

        yield from _combined_batches(pairs(), ["h1", "h2", "n"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _signed(pair_hash(_unsigned(batch.column(0)), _unsigned(batch.column(1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=["h1", "h2", "n", "p"])

    rows = texts.mapInArrow(run, "h1 bigint, h2 bigint, n bigint")
    often = rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return written(often.mapInArrow(hashed, "h1 bigint, h2 bigint, n bigint, p bigint"), "pairs")


class Groups:
    """To which group a suffix belongs, by its first word or, where that holds too much, by two or three words."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, of_bucket: np.ndarray) -> None:
        self.words, self.pairs, self.of_bucket = np.sort(words), np.sort(pairs), of_bucket

    def of(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
        prefix = mixed(h1)
        long = np.isin(h1, self.words)
        prefix[long] = pair_hash(h1[long], h2[long])
        longer = long & np.isin(prefix, self.pairs)
        prefix[longer] = mixed(prefix[longer] * _FACTOR + h3[longer])
        return self.of_bucket[(prefix >> np.uint64(48)).astype(np.int64)]


def partitioned(pairs: DataFrame, budget: int) -> Groups:
    """Prefixes put into groups of about ``budget`` suffixes.

    The driver gets the prefixes that must be extended, which are at most the number of suffixes over the budget, and
    sums of suffixes for ``BUCKETS`` ranges of prefix hashes. Neighbouring ranges make a group until its budget is full.
    """
    under = pairs.groupBy("h1").agg(F.sum("n").alias("under"))
    heavy = under.filter(F.col("under") > budget)
    words = np.array([r.h1 for r in heavy.collect()], np.int64).view(np.uint64)
    heavy_pairs = pairs.join(heavy, "h1", "left_semi").filter(F.col("n") > budget)
    longest = np.array([r.p for r in heavy_pairs.collect()], np.int64).view(np.uint64)
    whole = Groups(words, longest, np.arange(BUCKETS, dtype=np.int32))

    def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = _unsigned(batch.column(0)), _unsigned(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(whole.of(h1, h2, h2)), batch.column(2)], names=["bucket", "n"])

    sums = pairs.select("h1", "h2", "n").mapInArrow(buckets, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    held = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():
        held[row.bucket] = row.n
    of_bucket, group, filled = np.zeros(BUCKETS, np.int32), 0, 0
    for bucket, n in enumerate(held.tolist()):
        if filled and filled + n > budget:
            group, filled = group + 1, 0
        filled += n
        of_bucket[bucket] = group
    return Groups(words, longest, of_bucket)


def _suffixes(texts: DataFrame, seed: int, frequent: Bitmap, pairs: Bitmap, groups: Groups) -> DataFrame:
    """``h1, h2, h3, h4, n, part``: suffixes of three words, or of four, that lie under frequent pairs, by group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def suffixes():
            for a in _streams(batches, seed, frequent):
                a = np.concatenate((a, np.zeros(DEPTH, np.uint64)))
                ok = (a[:-1] > 0) & (a[1:] > 0)
                at = np.nonzero(ok)[0]
                ok[at] = pairs.holds(pair_hash(a[at], a[at + 1]))
                at = np.nonzero(ok[:-2] & ok[1:-1])[0]
                yield [a[at], a[at + 1], a[at + 2], np.where(ok[at + 2], a[at + 3], np.uint64(0))]

        yield from _combined_batches(suffixes(), [*_H, "n", "part"], lambda c: groups.of(*c[:3]))

    return texts.mapInArrow(run, "h1 bigint, h2 bigint, h3 bigint, h4 bigint, n bigint, part int")


def subtree_counts(columns: list[np.ndarray], n: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Nodes of three and four words of the subtrees of sorted suffixes, with at least ``least`` places. A node of three
    words sums its leaves, the one that ends there included, whose fourth word is zero."""
    leaves, leaf = runs(columns, n)
    inner, total = runs(leaves[:3], leaf)
    full = (leaf >= least) & (leaves[3] > 0)
    often = total >= least
    nodes = [np.concatenate((c[full], i[often])) for c, i in zip(leaves, [*inner, np.zeros(len(total), np.uint64)])]
    return nodes, np.concatenate((leaf[full], total[often]))


def _subtrees(least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted suffixes to nodes, batch by batch. The suffixes under the last node of three words wait for the next one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [np.empty(0, np.uint64)] * DEPTH, np.empty(0, np.int64)

        def nodes(columns, n) -> pa.RecordBatch:
            found, total = subtree_counts(columns, n, least)
            return pa.RecordBatch.from_arrays([*map(_signed, found), pa.array(total)], names=[*_H, "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate((h, _unsigned(batch.column(i)))) for i, h in enumerate(held)]
            count = np.concatenate((count, batch.column(DEPTH).to_numpy()))
            last = np.logical_and.reduce([c == c[-1] for c in columns[:3]])
            yield nodes([c[~last] for c in columns], count[~last])
            # Equal leaves are added up, so that what waits are distinct fourth words.
            held, count = runs([c[last] for c in columns], count[last])
        yield nodes(held, count)

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """``lang, word, h, n`` for every word, and ``h1, h2, h3, h4, n`` for every phrase of two to four words with at least
    ``least`` places; a phrase's words are given by hashes, zero after the last."""
    texts = _texts(docs, text_col, lang_col)
    words, seed = count_words(texts)
    often = words.filter(F.col("n") >= least)
    frequent = bitmap(often, "h", often.count())
    pairs = count_pairs(texts, seed, frequent, least)
    # Words that only share a bit with a frequent one do not pass here, for the pair itself must be frequent.
    groups = partitioned(pairs, budget)
    suffixes = _suffixes(texts, seed, frequent, bitmap(pairs, "p", pairs.count()), groups)
    sorted_ = suffixes.repartition("part").sortWithinPartitions("part", *_H).select(*_H, "n")
    deep = sorted_.mapInArrow(_subtrees(least), "h1 bigint, h2 bigint, h3 bigint, h4 bigint, n bigint")
    zero = F.lit(0).cast("bigint")
    shallow = pairs.select("h1", "h2", zero.alias("h3"), zero.alias("h4"), "n")
    return words, written(shallow.unionByName(deep), "phrases")


def _part(first: int, last: int) -> Column:
    """The phrase of words ``first`` to ``last - 1`` of a row."""
    names = [_H[i] if first + i < last else None for i in range(DEPTH)]
    zero = F.lit(0).cast("bigint")
    return F.struct(*[(F.col(_H[first + i]) if name else zero).alias(_H[i]) for i, name in enumerate(names)])


def _cuts() -> Column:
    """``k, left, right`` for each way to cut a phrase."""
    of_length = {
        n: F.array(*[F.struct(F.lit(k).alias("k"), _part(0, k).alias("left"), _part(k, n).alias("right")) for k in range(1, n)])
        for n in range(2, DEPTH + 1)
    }
    return F.when(F.col("h3") == 0, of_length[2]).when(F.col("h4") == 0, of_length[3]).otherwise(of_length[4])


def _inner_parts() -> Column:
    """The shorter phrases within one of three or four words."""
    of_length = {
        n: F.array(*[_part(i, j) for i in range(n) for j in range(i + 2, n + 1) if j - i < n]) for n in range(3, DEPTH + 1)
    }
    return F.when(F.col("h4") == 0, of_length[3]).otherwise(of_length[4])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase of two to four words has ``a`` places; cut in two, its parts have ``l`` and ``r``, and the score is two
    million times a over their sum, rounded down, at the cut where that is least (the first of such). Phrases with at least
    80 % of their places within a longer one go. ``n`` is the number of words of the language. Ties go to the more frequent
    phrase, then to the first in byte order.

    A null text is empty and a null language is ``und``; repeated rows count as often as they are; texts without words
    and empty tables give nothing. Other columns are not looked at.
    """
    words, phrases = phrase_counts(docs, text_col, lang_col, least, budget)
    zero = F.lit(0).cast("bigint")
    single = words.filter(F.col("n") >= least).select(F.col("h").alias("h1"), *[zero.alias(h) for h in _H[1:]], "n")
    counts = single.unionByName(phrases).select(F.struct(*_H).alias("phrase"), "n")
    cuts = phrases.select(F.struct(*_H).alias("phrase"), F.col("n").alias("a"), F.explode(_cuts()).alias("cut")).select("phrase", "a", "cut.*")
    # These tables hold distinct phrases, not places; a word that very many of them begin or end with is left to adaptive skew joins.
    cuts = cuts.join(counts.select(F.col("phrase").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("phrase").alias("right"), F.col("n").alias("r")), "right")
    exact = "(CAST({0} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"
    scored = cuts.withColumn("score", F.expr(exact.format(SCALE)).cast("bigint"))
    best = scored.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("phrase", "a", "best.*")
    longer = phrases.filter("h3 != 0").select(F.explode(_inner_parts()).alias("phrase"), "n").groupBy("phrase").agg(F.max("n").alias("longer"))
    covered = F.expr(f"CAST(100 AS DECIMAL(7,0)) * CAST(longer AS DECIMAL(19,0)) >= CAST({COVERED} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))")
    kept = best.join(longer, "phrase", "left").filter(F.col("longer").isNull() | ~covered).select("phrase.*", "a", "l", "r", "score")
    names = words.filter(F.col("n") >= least).select("h", "lang", "word")
    first = names.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"))
    # Ties with the last place stay until the phrases are spelled out.
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    near = kept.join(first, "h1").withColumn("rank", F.rank().over(by_score)).filter(F.col("rank") <= top)
    for i, h in enumerate(_H[1:], 2):
        near = near.join(names.select(F.col("h").alias(h), F.col("word").alias(f"w{i}")), h, "left")
    spelled = near.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, DEPTH + 1)]))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB.
COLLOCATIONS_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{NO_LANG}') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split
), grams AS (
    SELECT lang, words[i : i + k - 1] AS p, count(*) AS f
    FROM places, range(1, {DEPTH + 1}) AS sizes(k)
    WHERE i + k - 1 <= len(words)
    GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(p) = 1 GROUP BY lang
), frequent AS (
    SELECT lang, p, f FROM grams WHERE f >= {LEAST}
), cuts AS (
    SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, len(p))) AS k FROM frequent WHERE len(p) > 1) c
    JOIN frequent l ON l.lang = c.lang AND l.p = c.p[1 : k]
    JOIN frequent r ON r.lang = c.lang AND r.p = c.p[k + 1 :]
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, p[i : j] AS p, max(f) AS longer
    FROM (SELECT lang, p, f, unnest(range(1, len(p))) AS i FROM frequent WHERE len(p) > 2), range(2, {DEPTH + 1}) AS ends(j)
    WHERE j > i AND j <= len(p) AND j - i + 1 < len(p)
    GROUP BY ALL
), kept AS (
    SELECT best.* FROM best LEFT JOIN inner_parts USING (lang, p) WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED} * a
), ranked AS (
    SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
    FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
