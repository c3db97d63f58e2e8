"""Near duplicates by SimHash fingerprints, found by pigeonring filtering.

The 64 bits of a fingerprint are a ring of five segments. Where two fingerprints differ in four bits at most, some segment
starts a chain along the ring whose first j segments differ in j - 1 bits at most, for every j (the proportional
budget 4j/5, rounded down). Candidates share a key that a chain of ``length`` segments cannot miss: its first segment, and of the
others all halves but as many as the budgets let differ. The bits that really differ are then counted segment by
segment along the chain, and a pair falls at the first budget it breaks; the last budget is the limit itself.

Longer chains have more bits in a key but more keys, so the length follows the number of fingerprints. It changes the
work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import add_columns, mixed, raw_text, split_words
from millrace.llm.graph import components, written
from millrace.plans.spread import spread_join

WORDS = 4
LIMIT = 4
SEED = 42
#: First bit of each segment of the ring, and of its second half.
STARTS = (0, 13, 26, 39, 52, 64)
MIDDLES = (7, 20, 33, 46, 58)
RING = len(MIDDLES)
#: A group of fingerprints with one key is compared in one piece up to this size.
GROUP = 1_024
#: Fingerprints of a larger group that all its others are compared with first.
HUBS = 16
#: Shingles whose bits are counted at a time.
_SLAB = 65_536
#: Fingerprints and groups handled at a time in a task, and fingerprints compared with the rest of a group at a time.
_ROWS = 4_096
_FRONT = 64
#: Groups up to this size are compared together, others one by one.
_SMALL = 32
#: Rows of one key that a task gets in a join.
_PER_TASK = 65_536
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(raw: bytes) -> int:
    """The SimHash of a text; zero without words."""
    words = split_words(raw.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[WORDS - 1 :] or ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), _SLAB):
        spans = zip(starts[at : at + _SLAB], last[at : at + _SLAB])
        hashes = b"".join([xxhash.xxh64_digest(joined[s : e - 1], SEED) for s, e in spans])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, place``: the fingerprint of each row as a signed number, and a number of the row's own."""

    def make():
        def work(texts: list[bytes]) -> list:
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            return [found.view(np.int64).tolist()]

        return work

    rows = add_columns(docs, {"doc_id": F.col(id_col)}, [raw_text(text_col)], make, "fp bigint")
    return rows.withColumn("place", F.monotonically_increasing_id())


def _bits(first: int, last: int) -> int:
    return (1 << last) - (1 << first)


def chain_masks(start: int, length: int) -> list[int]:
    """The bits of each key of a chain: all of the first segment, and of the others those halves that stay equal. Of the
    first j segments j - 1 halves may differ, so ``length - 1`` do in the whole chain."""
    ring = [(start + i) % RING for i in range(length)]
    halves = [h for s in ring[1:] for h in (_bits(STARTS[s], MIDDLES[s]), _bits(MIDDLES[s], STARTS[s + 1]))]
    whole = sum(_bits(STARTS[s], STARTS[s + 1]) for s in ring)
    masks = []
    for differ in combinations(range(len(halves)), length - 1):
        # The k-th half that differs (from 0) lies in segment differ[k] // 2 + 1 and needs a budget of k + 1 there.
        if all(k + 1 <= at // 2 + 1 for k, at in enumerate(differ)):
            masks.append(whole - sum(halves[at] for at in differ))
    return masks


def chain_length(fingerprints: int) -> int:
    """The length at which keys and chance pairs of so many fingerprints cost least."""

    def cost(length: int) -> float:
        masks = chain_masks(0, length)
        bits = sum(m.bit_count() for m in masks) / len(masks)
        return RING * len(masks) * (1 + fingerprints / 2**bits)

    return min(range(2, RING + 1), key=cost)


def chain_keys(fps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every key of every fingerprint (one row each), and the segment each column of keys starts at. Keys are hashed:
    equal ones that should differ only add pairs to compare."""
    columns, begin = [], []
    for start in range(RING):
        for mask in chain_masks(start, length):
            code = np.uint64(len(begin) + 1)
            columns.append(mixed(mixed(fps & np.uint64(mask)) * _FACTOR + code))
            begin.append(start)
    return np.stack(columns, 1), np.array(begin, np.int8)


def within(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs keep every budget of the chain from segment ``start`` on; the last one is the limit."""
    left = np.arange(len(a))
    differ, cost, at = a ^ b, np.zeros(len(a), np.int64), start.astype(np.int64)
    segments = np.array([_bits(STARTS[s], STARTS[s + 1]) for s in range(RING)], np.uint64)
    for j in range(RING):
        cost = cost + np.bitwise_count(differ & segments[(at + j) % RING])
        keep = cost <= (j + 1) * LIMIT // RING
        left, differ, cost, at = left[keep], differ[keep], cost[keep], at[keep]
    return left


def tree_links(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group that connect all that its links connect, at most one for each fingerprint."""
    found_a, found_b = [], []
    front, rest = np.empty(0, np.int64), np.arange(len(fps))
    while len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
        now, front = front[:_FRONT], front[_FRONT:]
        a, b = np.repeat(now, len(rest)), np.tile(rest, len(now))
        hit = within(fps[a], fps[b], np.full(len(a), start, np.int8))
        new, first = np.unique(b[hit], return_index=True)
        found_a.append(a[hit][first])
        found_b.append(new)
        front, rest = np.concatenate((front, new)), rest[~np.isin(rest, new)]
    return fps[np.concatenate(found_a)], fps[np.concatenate(found_b)]


def near_links(sizes: np.ndarray, fps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of groups that lie one after the other in ``fps``: of small ones all, by comparing rows 1, 2, ... apart for
    all groups at once; of others as many as connect the same."""
    small = np.repeat(sizes <= _SMALL, sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    row, found = np.nonzero(small)[0], []
    apart = 1
    while len(row):
        row = row[row + apart < ends[row]]
        hit = row[within(fps[row], fps[row + apart], start[row])]
        found.append((fps[hit], fps[hit + apart]))
        apart += 1
    for size, end in zip(sizes.tolist(), np.cumsum(sizes).tolist()):
        if size > _SMALL:
            found.append(tree_links(fps[end - size : end], int(start[end - size])))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _links_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _all_keys(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                fps = _numbers(batch.column(0).slice(at, _ROWS))
                keys, begin = chain_keys(fps, length)
                n = keys.shape[1]
                columns = [keys.ravel().view(np.int64), np.tile(begin, len(fps)), np.repeat(fps, n).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "fp"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``start, fps``: one group a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            fps = _numbers(part.column(1).flatten())
            start = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)
            yield _links_batch(*near_links(sizes, fps, start))


def _hub_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, start, fp, n, hubs`` to ``key, start, fp, n, near, class``: the hubs within the limit, and the class of the first
    of them, which is the first hub that it is connected with through hubs; -1 if there is none."""
    seen, hubs, classes = None, np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        near, class_of = [], []
        for fp, names in zip(_numbers(batch.column(2)), batch.column(4).to_pylist()):
            if names != seen:
                seen, hubs = names, np.array(names, np.int64).view(np.uint64)
                reach = np.bitwise_count(hubs[:, None] ^ hubs[None, :]) <= LIMIT
                for _ in hubs:
                    reach = reach @ reach
                classes = reach.argmax(1)
            hit = np.nonzero(np.bitwise_count(hubs ^ fp) <= LIMIT)[0]
            near.append(hubs[hit].view(np.int64).tolist())
            class_of.append(int(classes[hit[0]]) if len(hit) else -1)
        columns = [*[batch.column(i) for i in range(4)], pa.array(near, pa.list_(pa.int64())), pa.array(class_of, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "fp", "n", "near", "class"])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``start, left, right``: two blocks of one group a row, compared as one set."""
    for batch in batches:
        for start, left, right in zip(*[batch.column(c).to_pylist() for c in range(3)]):
            fps = np.unique(np.array(left + right, np.int64).view(np.uint64))
            yield _links_batch(*tree_links(fps, start))


def _large_group_links(large: DataFrame) -> DataFrame:
    """Links of groups too large to compare in one piece.

    A few hubs of a group are compared with all of it, and hubs are connected among each other. What lies near hubs of
    the class that holds most is connected already, so only the others (the rest) are compared with the whole group, block
    by block. The work grows with the group's size times that of its rest; where a family of copies makes the group
    large, the rest is small. Every table here is dealt by blocks, so no task gets a whole group.
    """
    by_hash = Window.partitionBy("key").orderBy(F.xxhash64("fp"), "fp")
    hubs = (
        large.withColumn("rank", F.row_number().over(by_hash))
        .filter(F.col("rank") <= HUBS)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("fp")).alias("hubs"))
    )
    told = written(
        spread_join(large, hubs, ["key"], ["fp"], how="inner", rows_per_chunk=_PER_TASK)
        .select("key", "start", "fp", "n", "hubs")
        .mapInArrow(_hub_classes, "key bigint, start tinyint, fp bigint, n bigint, near array<bigint>, class int"),
        "hubs",
    )
    sizes = told.filter("class >= 0").groupBy("key", "class").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("key").agg(F.max_by("class", F.struct("size", "class")).alias("most"))
    told = spread_join(told, most, ["key"], ["fp"], rows_per_chunk=_PER_TASK)
    told = told.withColumn("in_rest", F.col("class") != F.coalesce("most", F.lit(-2)))
    near = told.filter("NOT in_rest").select(F.col("fp").alias("a"), F.explode("near").alias("b"))
    block = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / GROUP)).alias("block")
    blocks = written(told.groupBy("key", "start", "in_rest", block).agg(F.collect_list("fp").alias("fps")), "blocks")
    rest = blocks.filter("in_rest").select("key", "block", F.col("fps").alias("left"))
    wanted = rest.groupBy("key").agg(F.collect_list("block").alias("wanted"))
    sent = spread_join(blocks, wanted, ["key"], ["in_rest", "block"], how="inner", rows_per_chunk=_SMALL).select(
        "key", "start", "in_rest", F.col("block").alias("other"), F.col("fps").alias("right"), F.explode("wanted").alias("block")
    )
    sent = sent.filter("NOT in_rest OR block <= other")
    pairs = spread_join(sent, rest, ["key", "block"], ["in_rest", "other"], how="inner", rows_per_chunk=_SMALL)
    return near.union(pairs.select("start", "left", "right").mapInArrow(_block_pairs, "a bigint, b bigint"))


def links(points: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``fp`` within the limit that connect all that any such pair connects. ``fp`` is unique."""
    length = chain_length(points.count())
    keyed = written(points.select("fp").mapInArrow(_all_keys(length), "key bigint, start tinyint, fp bigint"), "keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(spread_join(keyed, sizes, ["key"], ["fp"], how="inner", rows_per_chunk=_PER_TASK), "shared")
    small = shared.filter(F.col("n") <= GROUP).groupBy("key", "start").agg(F.collect_list("fp").alias("fps"))
    found = small.select("start", "fps").mapInArrow(_whole_groups, "a bigint, b bigint")
    large = shared.filter(F.col("n") > GROUP)
    if not large.isEmpty():
        found = found.union(_large_group_links(large))
    return found


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row: the fingerprint as 16 hexadecimal digits, and the
    smallest id of the rows reached by links, where fingerprints that differ in four bits at most are linked.

    A null or empty text, or one without words, has fingerprint zero and is linked like any other. Repeated rows come back
    as often as they are. A null id counts as no id: a component of such rows only has a null ``component_id``. Other
    columns of ``docs`` are not looked at; an empty table gives an empty one.

    Equal fingerprints are one point from here on, so that copies cost nothing in the search. A point with very
    many rows, and a component with very many points, are dealt over tasks where they are joined.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    classes = components(links(points)).withColumnRenamed("node", "fp")
    linked = written(points.join(classes, "fp"), "linked")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_linked = spread_join(linked, named, ["component"], ["fp"], rows_per_chunk=_PER_TASK).select("fp", "component_id")
    alone = points.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    of_point = of_linked.union(alone)
    out = spread_join(rows, of_point, ["fp"], ["place"], how="inner", rows_per_chunk=_PER_TASK)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
