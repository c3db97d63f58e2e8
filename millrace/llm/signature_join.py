"""Near-duplicate documents: components of word-shingle sets with a Jaccard similarity of 80 % or more. Links tell what
is connected; they are not all similar pairs.

Equal sets are one class. Classes meet by keys that lose no pair: a set's shingles are dealt by their hashes into
parts, and two similar sets differ in so few shingles that enough parts must be equal in both. Classes with the same
first key lie in one block, split where there are many, and two blocks are compared if they share enough keys.

In a task, each block is a signature tree: nodes hold the OR of their sets' bitmaps and the range of their sizes. Two
trees are searched against each other, and pairs of nodes, then of sets, go on only if their largest possible overlap
is enough. What is left is checked on the sets themselves, unless the two are connected already; so a task tells a
forest of links, not all pairs of a large group. Blocks are first compared with themselves and with one neighbour; of
the other pairs of blocks, those that are connected by then are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import ROWS, WordHashes, add_columns, mixed, packed, raw_text, rolling, unpacked, word_hashes
from millrace.llm.graph import components, written

#: Words in a shingle.
WIDTH = 5
#: 64-bit words of a bitmap.
SIGNATURE = 16
#: Sets in a leaf node of a tree, and nodes in a node above.
LEAF, FAN = 64, 8
#: Sets in a block, and bytes of their shingles, about.
BLOCK, BLOCK_BYTES = 1024, 2_000_000
#: Keys that a task gathers before it sends them on.
GATHERED = 1_000_000
#: Sets of one key that a task sends where the key is counted; it has found the key shared already, so the rest
#: go elsewhere and no task gets all sets of a key.
SENT = 16
#: Keys that meet in one bucket, about.
BUCKET = 1_000_000


def shingles(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words than one has, of all words as one."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes.of(words)
    if len(ids) < WIDTH:
        return mixed(rolling(ids, len(ids)) + np.uint64(len(ids)))
    return np.unique(rolling(ids, WIDTH))


def size_groups(largest: int) -> list[int]:
    """Upper bounds of the size groups up to the one that holds ``largest``; each is twice the one before."""
    bounds = [1]
    while bounds[-1] < largest:
        bounds.append(2 * bounds[-1])
    return bounds


def spare(upper: int) -> int:
    """Keys that similar sets of a size group share besides the first."""
    return (2 * upper // 9 + 1) // 5


def part_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of a set such that any two sets of similarity 0.8 or more share ``1 + spare`` of their size group.

    Similar sets of sizes a <= b have b <= a / 0.8 and differ in at most (a + b) / 9 shingles. The pair's group is
    that of b. There both deal their shingles into the same number of parts, and each gives, in the order of the
    parts, 1 + spare more non-empty parts than it can differ in. Up to the part where the first of the two ends, so
    many parts more are equal than are empty in that set. A set that runs out of parts also gives the prefix of its
    sorted hashes, which meets one of other such sets. A key's last six bits tell its group, plus 32 for a prefix.
    """
    return keys_of_sets(grams, np.array([len(grams)]))[0]


def keys_of_sets(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of :func:`part_keys` for many sets, whose sorted shingles stand one set after the other, and the place
    of the set that each belongs to. A shingle's part follows from its leading bits, so sorted shingles lie by part."""
    out, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    longest = sizes * 10 // 8
    lower = 0
    for g, upper in enumerate(size_groups(int(longest.max(initial=1)))):
        chosen = np.flatnonzero((sizes > 0) & (sizes <= upper) & (longest > lower))
        lower = upper
        if not len(chosen):
            continue
        n = sizes[chosen]
        inside = np.zeros(len(sizes), bool)
        inside[chosen] = True
        held = grams[np.repeat(inside, sizes)]
        of = np.repeat(np.arange(len(chosen)), n)
        wanted = (n + np.minimum(upper, longest[chosen])) // 9 + 1 + spare(upper)
        n_parts = (2 * upper // 9 + 1 + spare(upper)) * 9 // 8
        part = ((held >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (of[1:] != of[:-1]))))
        sums = np.add.reduceat(mixed(held + np.uint64(g + 1)), starts)
        keys = mixed(sums ^ mixed(part[starts] + np.uint64((g + 1) << 40)))
        owner = of[starts]
        made = np.bincount(owner, minlength=len(chosen))
        rank = np.arange(len(keys)) - np.repeat(np.cumsum(made) - made, made)
        taken = rank < wanted[owner]
        out.append(keys[taken] << np.uint64(6) | np.uint64(min(g, 31)))
        owners.append(chosen[owner[taken]])
        if (made < wanted).any():
            length = np.where(made < wanted, n - (8 * n + 9) // 10 + 1, 0)
            taken = np.arange(len(held)) - np.repeat(np.cumsum(n) - n, n) < length[of]
            prefix = mixed(held[taken] ^ np.uint64((g + 1) << 50))
            out.append(prefix << np.uint64(6) | np.uint64(32 + min(g, 31)))
            owners.append(chosen[of[taken]])
    return np.concatenate(out), np.concatenate(owners)


def _enough(key: str) -> Column:
    """Keys of the group of ``key`` that similar sets share at least."""
    least = [1 + spare(2**g) for g in range(32)] + [1] * 32
    return F.element_at(F.array(*[F.lit(x) for x in least]), (F.col(key).bitwiseAND(F.lit(63)) + 1).cast("int"))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles, one text after the other, and the number of each. A
    text with fewer words than a shingle has all its words as one."""
    ids, n_words = word_hashes(texts)
    first = np.cumsum(n_words) - n_words
    runs = np.zeros(len(ids), np.uint64)
    if len(ids) >= WIDTH:
        runs[: len(ids) - WIDTH + 1] = rolling(ids, WIDTH)
    # Of runs that reach into the next text only that at the start of a short text stays, for the text as a whole.
    held = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    for i in np.flatnonzero((n_words > 0) & (n_words < WIDTH)):
        words = ids[first[i] : first[i] + n_words[i]]
        runs[first[i]] = mixed(rolling(words, len(words)) + np.uint64(len(words)))[0]
    of = np.repeat(np.arange(len(texts)), n_words)
    runs = runs[np.arange(len(ids)) - first[of] < held[of]]
    ends = np.cumsum(held)
    for start, end in zip((ends - held).tolist(), ends.tolist()):
        runs[start:end].sort()
    of = np.repeat(np.arange(len(texts)), held)
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    return runs[fresh], np.bincount(of[fresh], minlength=len(texts))


def fingerprints(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each of the sets that stand one after the other."""
    sums = np.zeros(len(sizes), np.uint64)
    held = np.flatnonzero(sizes)
    if len(held):
        sums[held] = np.add.reduceat(mixed(grams ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(sizes) - sizes)[held])
    return mixed(sums + sizes.astype(np.uint64)).view(np.int64)


def _make_full_sets():
    def sets(texts: list[bytes]) -> list:
        grams, sizes = shingle_sets(texts)
        each = np.split(grams, np.cumsum(sizes)[:-1])
        return [sizes, fingerprints(grams, sizes), [g.tobytes() for g in each]]

    return sets


def _key_rows(n_buckets: int, key: np.ndarray, place: np.ndarray, names: np.ndarray) -> Iterator[dict]:
    """Columns of rows of (bucket, keys, sets, places): sorted keys by their steps, and the set beside each by its place
    in the list of sets, all as bytes. ``place`` tells each key's set in ``names``."""
    order = np.argsort(key)
    key, place = key[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    more = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key))) >= SENT

    def scaled(x: np.ndarray) -> np.ndarray:
        return (((x >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)

    # Known to be shared: dealt by set to buckets of their own.
    known_bucket = n_buckets + scaled(mixed(names[place[more]].view(np.uint64)))
    order = np.argsort(known_bucket, kind="stable")
    parts = [(scaled(key[~more]), key[~more], place[~more]), (known_bucket[order], key[more][order], place[more][order])]
    there, number = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    for bucket, key, place in parts:
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
        for i in range(0, len(cuts) - 1, 512):
            rows = {"bucket": [], "keys": [], "sets": [], "places": []}
            for start, end in zip(cuts[i : i + 512], cuts[i + 1 : i + 513]):
                of = place[start:end]
                there[of] = True
                distinct = np.flatnonzero(there)
                number[distinct] = np.arange(len(distinct))
                there[distinct] = False
                rows["bucket"].append(bucket[start])
                rows["keys"].append(packed(np.diff(key[start:end], prepend=np.uint64(0))))
                rows["sets"].append(names[distinct].tobytes())
                rows["places"].append(packed(number[of]))
            yield rows


def _scan(n_buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows for texts read once: documents, with their set's size and name and how often they are
    repeated here, and keys, as :func:`_key_rows` gives them. Documents have buckets beyond those of keys."""
    docs, keys, places, names, seen, held = [], [], [], [], {}, 0
    schema = None

    def filled(rows: dict) -> pa.RecordBatch:
        length = len(rows["bucket"])
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(length, f.type) for f in schema], schema=schema
        )

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(docs)
        of_row, at, times = np.unique(table["of_row"].to_numpy(), return_index=True, return_counts=True)
        table = table.take(at)
        bucket = 2 * n_buckets + (mixed(of_row.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        yield filled(
            {"bucket": bucket, "times": times} | {n: table[n].combine_chunks() for n in ("id", "copy", "of_row", "n", "set")}
        )
        if keys:
            for rows in _key_rows(n_buckets, np.concatenate(keys), np.concatenate(places), np.array(names, np.int64)):
                yield filled(rows)

    for batch in batches:
        if schema is None:
            long, blob = pa.int64(), pa.binary()
            schema = pa.schema(
                [("bucket", long), ("id", batch.schema.field("id").type), ("copy", long), ("of_row", long), ("n", long)]
                + [("set", long), ("times", long), ("keys", blob), ("sets", blob), ("places", blob)]
            )
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            grams, sizes = shingle_sets(piece.column("raw").to_pylist())
            of = fingerprints(grams, sizes)
            # The numbers of rows are columns of their own: a slice would keep the batch with its texts.
            columns = [piece.column(n).take(pa.array(np.arange(piece.num_rows))) for n in ("id", "copy", "of_row")]
            docs.append(
                pa.RecordBatch.from_arrays(columns + [pa.array(sizes, pa.int64()), pa.array(of)], names=["id", "copy", "of_row", "n", "set"])
            )
            fresh = np.zeros(len(sizes), bool)
            base = len(names)
            for i, (name, size) in enumerate(zip(of.tolist(), sizes.tolist())):
                if size and name not in seen:
                    seen[name] = len(names)
                    names.append(name)
                    fresh[i] = True
            if fresh.any():
                key, owner = keys_of_sets(grams[np.repeat(fresh, sizes)], sizes[fresh])
                keys.append(key)
                places.append(base + owner)
                held += len(key)
            held += piece.num_rows
            if held >= GATHERED:
                yield from flush()
                docs, keys, places, names, seen, held = [], [], [], [], {}, 0
    if docs:
        yield from flush()


def _meet(n_buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, set) for the keys of two sets or more, and those of documents as they are. Rows come sorted by
    bucket."""
    schema = None

    def shared(key: np.ndarray, of: np.ndarray, known: bool) -> pa.RecordBatch:
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        key, of = key[fresh], of[fresh]
        if not known:
            same = key[1:] == key[:-1]
            twice = np.zeros(len(key), bool)
            twice[1:] |= same
            twice[:-1] |= same
            key, of = key[twice], of[twice]
        made = {"key": pa.array(key.view(np.int64)), "set": pa.array(of)}
        return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(key), f.type)) for f in schema], schema=schema)

    at, keys, sets = None, [], []
    for batch in batches:
        if schema is None:
            long = pa.int64()
            schema = pa.schema(
                [("key", long), ("id", batch.schema.field("id").type)] + [(n, long) for n in ("copy", "of_row", "n", "set", "times")]
            )
        n_keys = int(np.searchsorted(batch.column("bucket").to_numpy(), 2 * n_buckets))
        if n_keys < batch.num_rows:
            docs = batch.slice(n_keys)
            columns = [pa.nulls(docs.num_rows, pa.int64())] + [docs.column(f.name) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        packs = batch.slice(0, n_keys)
        for bucket, key, of, places in zip(*[packs.column(n).to_pylist() for n in ("bucket", "keys", "sets", "places")]):
            if bucket != at and keys:
                yield shared(np.concatenate(keys), np.concatenate(sets), at >= n_buckets)
                keys, sets = [], []
            at = bucket
            keys.append(np.cumsum(unpacked(key), dtype=np.uint64))
            sets.append(np.frombuffer(of, np.int64)[unpacked(places).astype(np.int64)])
    if keys:
        yield shared(np.concatenate(keys), np.concatenate(sets), at >= n_buckets)


class Tree:
    """Sets with their bitmaps, and levels of nodes above them: bitmaps combined by OR, the sizes' range, and by how
    many shingles a set can exceed its bits. Sets lie by component and size, so that nodes hold alike ones."""

    def __init__(self, members: list[dict]):
        members = sorted(members, key=lambda m: (m["component"], len(m["grams"]), m["set"]))
        self.names = [m["set"] for m in members]
        self.components = [m["component"] for m in members]
        self.grams = [np.frombuffer(m["grams"], np.uint64) for m in members]
        self.sizes = np.array([len(g) for g in self.grams])
        bits = np.zeros((len(members), 64 * SIGNATURE), np.uint8)
        for row, grams in zip(bits, self.grams):
            row[(grams >> np.uint64(7)) % np.uint64(64 * SIGNATURE)] = 1
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        level = (self.bits, self.sizes, self.sizes, self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64))
        self.levels = []
        step = LEAF
        while not self.levels or len(self.levels[-1][1]) > 1:
            starts = np.arange(0, len(level[1]), step)
            level = (
                np.bitwise_or.reduceat(level[0], starts, axis=0),
                np.minimum.reduceat(level[1], starts),
                np.maximum.reduceat(level[2], starts),
                np.maximum.reduceat(level[3], starts),
            )
            self.levels.append(level)
            step = FAN


def _needed(a, b):
    """The least overlap of similar sets of these sizes: 9 * overlap >= 4 * (sum of sizes)."""
    return -(-4 * (a + b) // 9)


def leaf_pairs(x: Tree, y: Tree) -> Iterator[tuple[int, int]]:
    """Pairs of leaf nodes that may hold a similar pair. A tree with itself gives each pair once."""
    same = x is y
    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        i, m, j, n = todo.pop()
        (x_bits, x_least, x_most, x_beyond), (y_bits, y_least, y_most, y_beyond) = x.levels[i], y.levels[j]
        if 10 * x_most[m] < 8 * y_least[n] or 10 * y_most[n] < 8 * x_least[m]:
            continue
        # A set's overlap is at most its common bits and the shingles that share a bit with another one.
        common = int(np.bitwise_count(x_bits[m] & y_bits[n]).sum())
        if common + min(x_beyond[m], y_beyond[n]) < _needed(x_least[m], y_least[n]):
            continue
        if i == j == 0:
            yield m, n
            continue
        below_x = [m] if i < j else range(m * FAN, min((m + 1) * FAN, len(x.levels[i - 1][1])))
        below_y = [n] if j < i else range(n * FAN, min((n + 1) * FAN, len(y.levels[j - 1][1])))
        todo += [(i - (i >= j), a, j - (j >= i), b) for a in below_x for b in below_y if not same or a <= b]


def search(x: Tree, y: Tree) -> list[tuple[int, int]]:
    """Links between sets of the two trees (or of one with itself) that connect all that is similar and not
    connected yet: each joins two components."""
    offset = 0 if x is y else len(x.names)
    _, root = np.unique(x.components if x is y else x.components + y.components, return_inverse=True)
    links = []
    for m, n in leaf_pairs(x, y):
        a = np.arange(m * LEAF, min((m + 1) * LEAF, len(x.names)))
        b = np.arange(n * LEAF, min((n + 1) * LEAF, len(y.names)))
        apart = root[a][:, None] != root[offset + b][None, :]
        if x is y and m == n:
            apart &= a[:, None] < b[None, :]
        if not apart.any():
            continue
        left, right = x.bits[a][:, None, :], y.bits[b][None, :, :]
        most = np.minimum(
            x.sizes[a][:, None] - np.bitwise_count(left & ~right).sum(axis=2, dtype=np.int64),
            y.sizes[b][None, :] - np.bitwise_count(right & ~left).sum(axis=2, dtype=np.int64),
        )
        over = most - _needed(x.sizes[a][:, None], y.sizes[b][None, :])
        found = np.argwhere(apart & (over >= 0))
        # The likeliest first: once a pair is linked, many others need no check.
        for i, j in found[np.argsort(-over[found[:, 0], found[:, 1]], kind="stable")]:
            p, q = a[i], b[j]
            if root[p] == root[offset + q]:
                continue
            both = len(np.intersect1d(x.grams[p], y.grams[q], assume_unique=True))
            if 100 * both >= 80 * (x.sizes[p] + y.sizes[q] - both):
                links.append((x.names[p], y.names[q]))
                root[root == root[offset + q]] = root[p]
    return links


def _searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each row's block of members, with the others where there are some, or with itself."""
    for batch in batches:
        for i in range(batch.num_rows):
            blocks = [Tree(c[i].as_py()) for c in batch.columns]
            links = search(blocks[0], blocks[-1])
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _group(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(63))


def _homes(met: DataFrame, sets: DataFrame) -> DataFrame:
    """``set, block``: sets with the same first key are in one block, or in several if they are many."""
    first = met.groupBy("set").agg(F.min("key").alias("first")).join(sets.select("set", "n"), "set")
    room = first.groupBy("first").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).alias("slots")
    )
    slot = F.pmod(F.xxhash64("set"), F.col("slots"))
    return first.join(room, "first").select("set", F.xxhash64("first", slot).alias("block"))


def _neighbours(met: DataFrame, homes: DataFrame) -> DataFrame:
    """``x, y`` (x < y) of blocks that share at least as many keys as any similar pair of sets."""
    spots = written(met.join(homes, "set").select("key", "block").distinct(), "spots")
    x, y = spots.withColumnRenamed("block", "x"), spots.withColumnRenamed("block", "y")
    return (
        x.join(y, "key")
        .filter("x < y")
        .groupBy("x", "y", _group("key").alias("group"))
        .agg(F.count("*").alias("shared"), F.max(_enough("key")).alias("enough"))
        .filter("shared >= enough")
        .select("x", "y")
        .distinct()
    )


def _links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of similar sets that connect all that is similar."""
    homes = written(_homes(met, sets), "homes")
    near = written(_neighbours(met, homes), "near")

    def contents(known: DataFrame) -> DataFrame:
        member = F.struct("set", "component", "grams")
        return known.join(sets.select("set", "grams"), "set").groupBy("block").agg(F.collect_list(member).alias("members"))

    def compared(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        x, y = blocks.toDF("x", "members"), blocks.toDF("y", "others")
        return pairs.join(x, "x").join(y, "y").select("members", "others").mapInArrow(_searching, "a bigint, b bigint")

    alone = written(contents(homes.withColumn("component", F.col("set"))), "blocks")
    hubs = written(near.groupBy("y").agg(F.min("x").alias("x")), "hubs")
    within = alone.filter(F.size("members") > 1).select("members").mapInArrow(_searching, "a bigint, b bigint")
    first = written(within.union(compared(hubs, alone)), "links")
    known = homes.join(components(first).withColumnRenamed("node", "set"), "set", "left").withColumn(
        "component", F.coalesce("component", "set")
    )
    known = written(known, "known")
    ends = known.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    apart = (F.col("x_lo") != F.col("x_hi")) | (F.col("y_lo") != F.col("y_hi")) | (F.col("x_lo") != F.col("y_lo"))
    rest = written(
        near.join(hubs, ["x", "y"], "left_anti")
        .join(ends.toDF("x", "x_lo", "x_hi"), "x")
        .join(ends.toDF("y", "y_lo", "y_hi"), "y")
        .filter(apart)
        .select("x", "y"),
        "rest",
    )
    wanted = rest.select(F.col("x").alias("block")).union(rest.select("y")).distinct()
    blocks = written(contents(known.join(wanted, "block", "left_semi")), "blocks")
    return first.union(written(compared(rest, blocks), "links"))


def _copy(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row_hash(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.col(id_col), _copy(text_col))


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row: id, a hash of the text (copy), of both (of_row), the set's size (n), component_id, and a hash that
    names the component (component)."""
    of_row = row_hash(id_col, text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(raw_text(text_col))), F.lit(0))).first()[0]
    n_buckets = int(min(65_536, max(16, size // 18 // BUCKET + 1)))
    rows = docs.select(F.col(id_col).alias("id"), _copy(text_col).alias("copy"), of_row.alias("of_row"), raw_text(text_col).alias("raw"))
    id_type = T.StructField("id", rows.schema["id"].dataType)

    def fields(*names: str, kind: T.DataType) -> list[T.StructField]:
        return [T.StructField(name, kind) for name in names]

    long, blob = T.LongType(), T.BinaryType()
    of_docs = [id_type, *fields("copy", "of_row", "n", "set", "times", kind=long)]
    sent = T.StructType([*fields("bucket", kind=long), *of_docs, *fields("keys", "sets", "places", kind=blob)])
    both = written(
        rows.mapInArrow(partial(_scan, n_buckets), sent)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(partial(_meet, n_buckets), T.StructType([*fields("key", kind=long), *of_docs])),
        "shared",
    )
    each = both.filter("key IS NULL").drop("key")
    shared = both.filter("key IS NOT NULL").select("key", "set")
    # A set with fewer shared keys than any similar pair has is similar to none.
    shared = shared.withColumn("group", _group("key"))
    busy = shared.groupBy("set", "group").agg(F.count("*").alias("n"), F.max(_enough("key")).alias("enough")).filter("n >= enough")
    met = written(shared.join(busy, ["set", "group"], "left_semi").select("key", "set"), "met")
    classes = each.filter("n > 0").groupBy("set").agg(F.min("id").alias("least"), F.min("of_row").alias("of_row"))
    wanted = classes.join(met.select("set").distinct(), "set", "left_semi").select(F.col("set").alias("wanted"), "of_row")
    text = docs.select(of_row.alias("of_row"), raw_text(text_col).alias("raw"))
    once = Window.partitionBy("of_row").orderBy("wanted")
    found = wanted.join(text, "of_row").withColumn("place", F.row_number().over(once)).filter("place = 1")
    sets = written(
        add_columns(found, {"wanted": F.col("wanted")}, [F.col("raw")], _make_full_sets, "n bigint, set bigint, grams binary")
        .filter("wanted = set")
        .drop("wanted"),
        "sets",
    )
    joined = components(_links(met, sets))
    groups = (
        classes.join(joined.withColumnRenamed("node", "set"), "set")
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
        .join(joined, "component")
        .select(F.col("node").alias("set"), "component_id", "component")
    )
    named = written(
        classes.join(groups, "set", "left").select(
            "set", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "set").alias("component")
        ),
        "named",
    )
    # Rows that are repeated were put together where they were read.
    repeats = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))
    return each.join(named, "set", "left").withColumn("one", repeats).select(
        "id", "copy", "of_row", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "component"
    )


def near_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``of_row``, the hash of id and text, and ``cluster`` of the documents that have near duplicates: a row for each
    id and text. Clusters are the components of :func:`similar_documents`. Null and empty texts, and those without a
    near duplicate, have no row; repeated rows have one; an empty table gives none; other columns are ignored, whatever
    their names."""
    rows = written(
        _linked(docs, id_col, text_col).filter("n > 0").groupBy("of_row").agg(F.min("component").alias("cluster")), "clusters"
    )
    several = rows.groupBy("cluster").agg(F.count("*").alias("held")).filter("held > 1").select("cluster")
    return rows.join(several, "cluster", "left_semi").select("of_row", "cluster")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, ``n_shingles``, and ``component_id``, the smallest id that it is linked
    with directly or over others, itself included.

    A null or empty text has no shingles and no links. A null id counts as larger than all others, so it names a
    component only if no other id is in it (as null). Repeated rows are each returned, with one component; rows of
    one id with different texts are compared as different documents. An empty table gives no rows. Whole texts are
    read however long; other columns are ignored, whatever their names.
    """
    return _linked(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in all their columns, without near duplicates: of the documents linked with one another
    the one with the smallest id stays (of two texts under that id, the one with the smaller hash), once. Texts
    without words are linked with nothing; each id keeps its own. Other cases as in :func:`similar_documents`."""
    rows = _linked(docs, id_col, text_col)
    first = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("copy").alias("copy"))
    stays = (
        rows.filter("n > 0")
        .groupBy("component_id")
        .agg(F.min(first).alias("first"))
        .select("first.id", "first.copy", F.lit(True).alias("stays"))
    )
    # One row for each id and text that goes, or that stays but is repeated; most documents have none.
    each = rows.groupBy("id", "copy", (F.col("n") > 0).alias("worded")).agg(F.count("*").alias("times"))
    on = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.copy") == F.col("r.copy"))
    marked = written(
        each.alias("l")
        .join(stays.alias("r"), on, "left")
        .select("l.id", "l.copy", "times", (~F.col("worded") | F.coalesce("stays", F.lit(False))).alias("stays"))
        .filter("times > 1 OR NOT stays"),
        "marked",
    )
    names = docs.columns
    kept = docs.select(
        *[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(names)],
        F.col(id_col).alias("id"),
        _copy(text_col).alias("copy"),
    ).alias("l")
    # Of rows that repeat id and text any may stay; their other columns decide, so that it is always the same.
    rest = [F.col(f"c{i}").cast("string") for i, f in enumerate(docs.schema.fields) if isinstance(f.dataType, T.AtomicType)]
    once = Window.partitionBy("id", "copy").orderBy(F.xxhash64(*rest))
    repeated = kept.join(marked.filter("stays").alias("r"), on, "left_semi")
    repeated = repeated.withColumn("place", F.row_number().over(once)).filter("place = 1").drop("place")
    out = kept.join(marked.alias("r"), on, "left_anti").unionByName(repeated)
    return out.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
