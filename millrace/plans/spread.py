"""Keyed windows and joins that survive hot keys.

A plain ``Window.partitionBy(key)`` sends one key to one task. When a key owns a third of a 100 TB
table, that task never ends. Here each hot key is cut into *chunks* along its own order, so a window
runs over ``(key, chunk)``, and what a chunk needs from the chunks before it (a row count, the last
row, a running maximum) comes from a per-chunk summary that is small enough to broadcast.

The layout is estimated from a hash sample of the key and order columns with about
``SAMPLE_PER_CHUNK`` rows for every ``rows_per_chunk`` input rows; every ``SAMPLE_PER_CHUNK``-th
sample row of a key is a cut point. The sample only decides the layout: every row lies in exactly
one chunk, so results do not depend on it, and it is a function of the row's own values, so a
recomputed task always sees the same layout. Cold keys have no cut point, stay in one chunk and pay
a broadcast lookup, not another shuffle.

Size bound: the cut points are counted, and thinned when there are more than ``max_chunks``. Every
table broadcast here has at most one row per hot key or per chunk of a hot key, so it holds at most
``2 * max_chunks`` rows whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 1_000_000
MAX_CHUNKS = 50_000
SAMPLE_PER_CHUNK = 16

# Rows per chunk for slices: a hot key sends the rows of the chunks that hold the slice, however many map tasks
# there are, so small chunks keep the one task that ranks them small.
SLICE_ROWS_PER_CHUNK = 65_536

CHUNK = "_chunk"
_HOT = "_hot"
_POS = "_pos"


def _sampled(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int, least_rate: Column | None = None
) -> DataFrame:
    rate = F.lit(max(1, rows_per_chunk // SAMPLE_PER_CHUNK)).cast("long")
    if least_rate is not None:
        rate = F.greatest(rate, least_rate)
    rows = df.select(*keys, F.struct(*order).alias(_POS))
    return rows.filter(F.pmod(F.xxhash64(_POS), rate) == 0)


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
) -> DataFrame:
    """Keys with more rows than one task should hold, and over how many tasks to deal them:
    ``keys, _parts``. The parts of all keys sum to at most ``max_chunks``.
    """
    parts = (
        _sampled(df, keys, order, rows_per_chunk)
        .groupBy(*keys)
        .agg(F.floor(F.count(F.lit(1)) / SAMPLE_PER_CHUNK).alias("_parts"))
        .filter(F.col("_parts") > 0)
    )
    thinner = _thinning(parts, F.sum("_parts"), max_chunks)
    return parts.withColumn("_parts", F.floor(F.col("_parts") / thinner)).filter(F.col("_parts") > 0)


def _thinning(df: DataFrame, total: Column, max_chunks: int) -> Column:
    """By how much an aggregate over ``df`` must shrink to be at most ``max_chunks``."""
    counted = df.agg(F.coalesce(total, F.lit(0)).alias("n"))
    return counted.select(F.greatest(F.lit(1), F.ceil(F.col("n") / max_chunks))).scalar()


def _on(keys: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality, so that a null key is a key like any other."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _lookup(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a bounded table (one row per hot key or chunk) by broadcast, without its key columns."""
    extra = [c for c in small.columns if c not in keys]
    return (
        df.alias("l")
        .join(F.broadcast(small).alias("r"), _on(keys, "l", "r"), how)
        .select("l.*", *[F.col(f"r.{c}") for c in extra])
    )


def _cut_points(df, keys, order, rows_per_chunk, max_chunks, least_rate: Column | None = None) -> DataFrame:
    """``keys, _pos``: the positions at which hot keys are cut, at most ``max_chunks`` rows."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(_POS))
    cuts = (
        _sampled(df, keys, order, rows_per_chunk, least_rate)
        .withColumn("_rank", rank)
        .filter(F.pmod("_rank", F.lit(SAMPLE_PER_CHUNK)) == 0)
    )
    step = _thinning(cuts, F.count(F.lit(1)), max_chunks) * SAMPLE_PER_CHUNK
    return cuts.filter(F.pmod("_rank", step) == 0).select(*keys, _POS)


def _with_chunk(df: DataFrame, cuts: DataFrame, order: Sequence[str], max_chunks: int) -> DataFrame:
    """Add ``_chunk``: how many of the key's cut points are at or before the row.

    ``df`` has the columns ``_from`` and ``_till``, the part of the sorted list of all cut points
    that belongs to the row's key (both null for a cold key, whose chunk is 0). The list is a scalar
    subquery, so it is held once per task and never copied into rows.

    The search halves the part, one projection per halving. Each result is used more than once by
    the next, so Spark keeps the projections apart and compiles them into one loop body; the same
    search by lambda functions would be interpreted, and takes five times as long. The result is
    never null.
    """
    at = cuts.agg(F.array_sort(F.collect_list(F.col("_cut"))).alias("at")).scalar()
    rows = df.withColumns({"_at": at, _POS: F.struct(*order)})
    found, halvings = "0", []
    # Enough halvings to search max_chunks cut points.
    for bit in range(max(1, max_chunks.bit_length()) - 1, -1, -1):
        probe, jump = f"_from + {found}", 1 << bit
        further = f"{probe} + {jump} <= _till AND get(_at, {probe} + {jump - 1}).pos <= {_POS}"
        halvings.append(f"CASE WHEN {further} THEN {found} + {jump} ELSE {found} END AS _found{bit}")
        found = f"_found{bit}"
    # Generated, so that the optimizer does not follow the column back through the projections when it
    # looks for filters to derive from joins on it; that would write the search out in full.
    kept = [c for c in df.columns if c not in ("_from", "_till")]
    return rows.selectExpr("*", *halvings).select(*kept, F.explode(F.array(found)).alias(CHUNK))


def _numbered(cuts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The cut points as ``_cut`` structs that sort by key, then position; and per key its part
    ``_from, _till`` of that sorted list."""
    cut = F.struct(*keys, F.col(_POS).alias("pos"))
    per_key = cuts.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    # One row per hot key passes this window.
    before = F.sum("_n").over(Window.orderBy(*keys)).cast("int")
    parts = per_key.withColumn("_till", before).withColumn("_from", F.col("_till") - F.col("_n"))
    return cuts.select(cut.alias("_cut")), parts.drop("_n")


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
    least_rate: Column | None = None,
) -> DataFrame:
    """Add ``_chunk`` (0, 1, ... along ``order`` within a hot key; 0 for cold keys) and ``_hot``.

    ``order`` must end in a unique column. With ``least_rate`` at most one row in so many is sampled.
    """
    cuts, parts = _numbered(_cut_points(df, keys, order, rows_per_chunk, max_chunks, least_rate), keys)
    rows = _lookup(df, parts, keys).withColumn(_HOT, F.col("_till").isNotNull())
    return _with_chunk(rows, cuts, order, max_chunks)


def chunk_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _per_chunk(rows: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return (
        rows.filter(_HOT)
        .groupBy(*keys, CHUNK)
        .agg(*[a.alias(name) for name, a in aggs.items()])
    )


def _earlier(keys: Sequence[str]) -> WindowSpec:
    """All earlier chunks of the key; runs over the per-chunk summary only."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", **layout
) -> DataFrame:
    """Add the row's 0-based position within its key."""
    rows = chunked(df, keys, order, **layout)
    before = (
        _per_chunk(rows, keys, _n=F.count(F.lit(1)))
        .withColumn("_before", F.sum("_n").over(_earlier(keys)))
        .drop("_n")
    )
    local = F.row_number().over(chunk_window(keys, order)).cast("long") - 1
    return (
        _lookup(rows.withColumn(name, local), before, [*keys, CHUNK])
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_before", CHUNK, _HOT)
    )


def previous(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add ``value`` of the row before this one within its key (null on the first row).

    ``rows`` comes from :func:`chunked`, possibly filtered; its ``_chunk`` columns are kept.
    """
    last = _per_chunk(rows, keys, _last=F.max_by(F.struct(value), F.struct(*order)))
    carried = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = last.withColumn("_carry", F.lag("_last").over(carried)).drop("_last")
    w = chunk_window(keys, order)
    return (
        _lookup(
            rows.withColumn(name, F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w)),
            carry,
            [*keys, CHUNK],
        )
        .withColumn(name, F.when(F.col("_rn") == 1, F.col(f"_carry.{value}")).otherwise(F.col(name)))
        .drop("_carry", "_rn")
    )


def latest_before(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Add, for each ``name: value`` of ``columns``, the last non-null ``value`` of the rows before this one within
    its key (null if there is none). One window, and one summary row per chunk, whatever the number of columns.

    ``rows`` comes from :func:`chunked`, possibly filtered; its ``_chunk`` columns are kept.
    """
    at = F.struct(*order)
    last = {f"_last_{n}": F.max_by(v, F.when(F.col(v).isNotNull(), at)) for n, v in columns.items()}
    before = _earlier(keys)
    carry = _per_chunk(rows, keys, **last).select(
        *keys, CHUNK, *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in columns]
    )
    w = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in columns.items()})
    return (
        _lookup(local, carry, [*keys, CHUNK])
        .withColumns({n: F.coalesce(n, f"_carry_{n}") for n in columns})
        .drop(*[f"_carry_{n}" for n in columns])
    )


def running_before(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add the maximum of ``value`` over all rows before this one within its key (null on the first).

    ``rows`` comes from :func:`chunked`, possibly filtered; its ``_chunk`` columns are kept.
    """
    carry = (
        _per_chunk(rows, keys, _top=F.max(value))
        .withColumn("_carry", F.max("_top").over(_earlier(keys)))
        .drop("_top")
    )
    w = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(name, F.max(value).over(w))
    # greatest skips nulls, so a missing carry or an empty frame does not hide the other side.
    return (
        _lookup(local, carry, [*keys, CHUNK])
        .withColumn(name, F.greatest(F.col(name), F.col("_carry")))
        .drop("_carry")
    )


def key_slice(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    start: int = 0,
    from_end: bool = False,
    name: str = "position",
    **layout,
) -> DataFrame:
    """Rows at positions ``[start, start + size)`` of each key, counted from its first row, or from
    its last row (0 = newest) with ``from_end``. ``name`` holds that position.

    Keys are counted first. If none has more rows than a chunk, a plain window ranks them. Else chunks of hot keys
    that cannot reach the slice are dropped by a broadcast lookup before the shuffle, so the task that ranks a hot
    key gets about the slice and two chunks at most. Of these, Spark keeps only the best ``start + size`` rows per key
    of each map task.
    """
    layout = {"rows_per_chunk": SLICE_ROWS_PER_CHUNK, "max_chunks": MAX_CHUNKS, **layout}
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = per_key.agg(F.max("_n").alias("largest"), F.sum("_n").alias("rows")).first()
    if (counted.largest or 0) <= layout["rows_per_chunk"]:
        near = df.withColumn("_skipped", F.lit(0))
    else:
        # The rate follows the number of rows, so that the sample of all keys has a size of its own.
        rate = -(-counted.rows // (layout["max_chunks"] * SAMPLE_PER_CHUNK))
        near = _near_chunks(df, keys, order, size, start, from_end, {**layout, "least_rate": F.lit(rate).cast("long")})
    by = [F.col(c).desc() if from_end else F.col(c).asc() for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return (
        near.withColumn("_rank", rank)
        .filter(F.col("_rank") <= start + size)
        .withColumn(name, (F.col("_rank") - 1 + F.col("_skipped")).cast("bigint"))
        .filter((F.col(name) >= start) & (F.col(name) < start + size))
        .drop("_rank", "_skipped")
    )


def _near_chunks(df, keys, order, size, start, from_end, layout) -> DataFrame:
    """The rows of cold keys, and of the chunks of hot keys that hold a part of the slice, with
    ``_skipped``: how many rows of the key lie in the chunks dropped ahead of them."""
    rows = chunked(df, keys, order, **layout)
    direction = F.col(CHUNK).desc() if from_end else F.col(CHUNK).asc()
    passed = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        _per_chunk(rows, keys, _n=F.count(F.lit(1)))
        .withColumn("_ahead", F.coalesce(F.sum("_n").over(passed), F.lit(0)))
        .filter((F.col("_ahead") < start + size) & (F.col("_ahead") + F.col("_n") > start))
    )
    # Chunks are skipped whole, so rank restarts after the rows that the skipped chunks held.
    skipped = ahead.groupBy(*keys).agg(F.min("_ahead").alias("_skipped"))
    wanted = ahead.select(*keys, CHUNK, F.lit(True).alias("_wanted"))
    return (
        _lookup(_lookup(rows, wanted, [*keys, CHUNK]), skipped, keys)
        .filter(~F.col(_HOT) | F.col("_wanted"))
        .drop("_wanted", CHUNK, _HOT)
        .withColumn("_skipped", F.coalesce("_skipped", F.lit(0)))
    )


def in_even_tasks(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """Deal ``df`` by a hash of the columns ``by`` over tasks of about ``SLICE_ROWS_PER_CHUNK`` rows (over ``MAX_CHUNKS`` tasks, when these
    get more). A file that holds many rows in few bytes is one task otherwise. ``rows`` is about how many there are."""
    tasks = min(MAX_CHUNKS, -(-rows // SLICE_ROWS_PER_CHUNK))
    return df.repartition(tasks, *by) if tasks > 1 else df


def spread_join(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    how: str = "left",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
) -> DataFrame:
    """Join ``df`` with a table of at most one row per key when some keys of ``df`` are hot.

    The rows of a hot key are dealt over salts by a hash of ``order``; its one ``per_key`` row is
    copied to each salt. Cold keys use salt 0 on both sides. ``per_key`` may be of any size.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    hot = hot_keys(df, keys, order, rows_per_chunk, max_chunks)
    # A hot key of n parts is dealt over n + 1 salts, a cold key over one.
    last = F.coalesce("_parts", F.lit(0))
    big = _lookup(df, hot, keys).withColumn("_salt", F.pmod(F.xxhash64(*order), last + 1))
    small = _lookup(per_key, hot, keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    joined = big.alias("l").join(small.alias("r"), _on([*keys, "_salt"], "l", "r"), how)
    extra = [] if how in ("left_semi", "left_anti") else [c for c in per_key.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{c}") for c in extra])


def whole_chunks(
    df: DataFrame,
    order: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``_chunk``: 0, 1, ... along ``order`` over the whole set. Rows that are equal in ``order`` share a chunk.

    With ``rows``, how many there are at most, they are not counted here, and the search for a row's chunk is shorter.
    """
    whole = df.withColumn("_all", F.lit(0))
    # The rate follows the number of rows, so that the sample sorted in one task has a size of its own.
    if rows is None:
        rate = F.ceil(F.count(F.lit(1)) / (max_chunks * SAMPLE_PER_CHUNK)).cast("long")
        least_rate = df.agg(rate.alias("rate")).scalar()
    else:
        least_rate = F.lit(-(-rows // (max_chunks * SAMPLE_PER_CHUNK))).cast("long")
        max_chunks = min(max_chunks, 2 * (rows // rows_per_chunk) + SAMPLE_PER_CHUNK)
    cuts = _cut_points(whole, ["_all"], order, rows_per_chunk, max_chunks, least_rate)
    cuts = cuts.select(F.struct(F.col(_POS).alias("pos")).alias("_cut"))
    everything = {"_from": F.lit(0), "_till": F.lit(max_chunks)}
    return _with_chunk(df.withColumns(everything), cuts, order, max_chunks)


def global_slice(
    df: DataFrame,
    order: Sequence[str],
    start: int,
    size: int | None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
) -> DataFrame:
    """Rows at positions ``[start, start + size)`` of the whole set (to the end with ``None``).

    The set is cut into chunks along ``order`` and the chunks are counted; only chunks that hold a
    part of the slice are read on and sorted, each in a task of its own. For all rows from a position on, the row
    there is found in this way, and those from it on are sorted; each is moved once.
    """
    if size is None:
        first = global_slice(df, order, start, 1, rows_per_chunk, max_chunks).select(F.struct(*order).alias("at"))
        return df.filter(F.struct(*order) >= first.scalar()).orderBy(*order)
    rows = whole_chunks(df, order, rows_per_chunk, max_chunks)
    # One row per chunk: at most max_chunks + 1 rows pass this window and are broadcast.
    ahead = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        rows.groupBy(CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .filter(F.col("_ahead") + F.col("_n") > start)
    )
    reach = reach.filter(F.col("_ahead") < start + size)
    inside = (F.col("_position") >= start) & (F.col("_position") < start + size)
    rank = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    return (
        rows.join(F.broadcast(reach.drop("_n")), CHUNK)
        .withColumn("_position", rank - 1 + F.col("_ahead"))
        .filter(inside)
        .drop(CHUNK, "_ahead", "_position")
        .orderBy(*order)
    )
