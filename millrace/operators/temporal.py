"""Joins by time: the latest earlier row, and intervals that overlap.

Neither compares every row of a key with every other. The as-of join is one ordered pass over both sides together, in
the chunks of :mod:`millrace.plans.spread`; the overlap join is an equi-join on the buckets of a time grid, or counts its
pairs in order of time where only their number is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.instants import instant, instants_per_second
from millrace.plans import chunked, latest_before, whole_chunks
from millrace.plans.spread import CHUNK, MAX_CHUNKS, SLICE_ROWS_PER_CHUNK

#: Share of intervals that are at most as long as a bucket of the finest grid, and accuracy of that quantile.
_SHORT = 0.9
_ACCURACY = 1_000
#: Buckets of a grid are this many times as long as those of the next finer one.
_STEP = 16
_LONGEST = 1 << 62


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    take: Mapping[str, str],
    tie: Sequence[str] | None = None,
    tolerance_s: float | None = None,
    direction: str = "backward",
    exact: bool = True,
    how: str = "left",
    **layout,
) -> DataFrame:
    """Each row of ``left`` with the nearest row of ``right`` of the same keys that is not later (``backward``) or not earlier
    (``forward``), at most ``tolerance_s`` seconds away (units, where times are numbers). ``take`` maps the names of added
    columns to columns of ``right``; they are null where no row matches, or the row is left out with ``how="inner"``.

    With ``exact=False`` a row of the same time does not match. Of rows of ``right`` at one time the one with the greatest ``tie``
    columns counts (default: the taken ones). A null key or time matches nothing. Every row of ``left``, repeated ones too,
    comes back once.

    Both sides are put one after the other in order of time, once; a row of ``left`` needs the last row of ``right`` before
    it. A hot key is cut into chunks, of which each hands its last row of ``right`` to the next.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError(f"unsupported: {direction}, {how}")
    sign = 1 if direction == "backward" else -1
    ties = list(take.values() if tie is None else tie)
    sides = {"left": 1 if exact else 0, "right": 0 if exact else 1}
    own = left.select(
        *on,
        (instant(left, left_time) * sign).alias("_time"),
        F.lit(sides["left"]).alias("_side"),
        *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(ties)],
        F.struct(*left.columns).alias("_left"),
    )
    other = right.select(
        *on,
        (instant(right, right_time) * sign).alias("_time"),
        F.lit(sides["right"]).alias("_side"),
        *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)],
        F.struct(F.col(right_time).alias("at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(take.values())]).alias("_right"),
    ).dropna(subset=[*on, "_time"])
    order = ["_time", "_side", *[f"_tie{i}" for i in range(len(ties))]]
    both = own.unionByName(other, allowMissingColumns=True)
    rows = latest_before(chunked(both, on, order, **layout), on, order, {"_match": "_right"})
    found = rows.filter(F.col("_side") == sides["left"])
    if tolerance_s is not None:
        reach = tolerance_s * instants_per_second(left, left_time)
        away = F.col("_time") - instant(right, right_time, F.col("_match.at")) * sign
        found = found.withColumn("_match", F.when(away <= reach, F.col("_match")))
    if how == "inner":
        found = found.filter(F.col("_match").isNotNull())
    return found.select("_left.*", *[F.col(f"_match.c{i}").alias(name) for i, name in enumerate(take)])


def _floor(value: Column, width: Column) -> Column:
    """The bucket of a whole number; buckets of negative ones count on below zero."""
    return F.call_function("div", value - F.pmod(value, width), width)


def _level(length: Column, width: int) -> Column:
    """The finest grid whose buckets are at least as long as an interval of ``length``."""
    level, reach = F.lit(0), width
    while reach < _LONGEST:
        level = level + (length > reach).cast("int")
        reach *= _STEP
    return level


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    take: Mapping[str, str] | None = None,
    closed: bool = True,
    where: Column | None = None,
    apart: tuple[str, str] | None = None,
    per: Sequence[str] | None = None,
    **layout,
) -> DataFrame:
    """Pairs of rows with equal keys whose intervals have a point in common: all columns of ``left``, and those of ``right`` that
    ``take`` maps names to. ``left_span`` and ``right_span`` name the columns where an interval starts and ends, which
    may be one column twice for a point in time. With ``closed=False`` ends do not belong to intervals (and points to none).
    ``where`` is a condition on the result's columns. ``apart`` names a column of each side; a pair in which these are equal or
    one is null is left out. Times are whole numbers, dates or timestamps.

    With ``per``, columns of ``left``, pairs are counted and not made: ``per, pairs, until`` for each value of these columns that
    has a pair, with the latest end of what a pair has in common. That takes neither ``take`` nor ``where``, and the
    work grows with the rows of both sides, not with the pairs (see :func:`_overlap_totals`).

    Null keys, starts or ends match nothing, nor does an interval that ends before it starts. Repeated rows make pairs of their own.

    Time is cut into buckets, about as long as nine of ten intervals, and into coarser grids of buckets 16 times as long
    each. An interval lies in the finest grid where it touches two buckets at most, and is told to the coarser grids
    that hold intervals of the other side; so a long one costs no more rows than a short one. A pair meets in the
    coarser grid of the two and is reported in one bucket only, that of the later start. With no common keys to join on, the
    bucket alone spreads the work; a hot key is spread by its buckets.
    """
    if per is not None:
        if take or where is not None:
            raise ValueError("pairs that are counted have no columns to take or test")
        return _overlap_totals(left, right, on, left_span, right_span, per, closed, apart, **layout)

    def side(df: DataFrame, span: tuple[str, str], columns: dict[str, str], own: str | None) -> DataFrame:
        kept = df.select(
            *[F.col(k).alias(f"_on{i}") for i, k in enumerate(on)],
            instant(df, span[0]).alias("_from"),
            instant(df, span[1]).alias("_till"),
            F.struct(*[F.col(c).alias(name) for name, c in columns.items()]).alias("_row"),
            *([] if own is None else [F.col(own).alias("_apart")]),
        )
        valid = F.col("_from") <= F.col("_till") if closed else F.col("_from") < F.col("_till")
        return kept.dropna(subset=[f"_on{i}" for i in range(len(on))]).filter(valid)

    theirs = apart or (None, None)
    a, b = side(left, left_span, {c: c for c in left.columns}, theirs[0]), side(right, right_span, dict(take or {}), theirs[1])
    length = (F.col("_till") - F.col("_from")).alias("length")
    lengths = a.select(length).union(b.select(length)).filter("length > 0")
    width = lengths.agg(F.percentile_approx("length", _SHORT, _ACCURACY)).first()[0] or 1
    level = _level(F.col("_till") - F.col("_from"), width).alias("_own")
    a, b = a.select("*", level), b.select("*", level)
    of_a, of_b = (sorted(r[0] for r in df.select("_own").distinct().collect()) for df in (a, b))

    def spread(df: DataFrame, others: list[int], mark: str) -> DataFrame:
        """A row for each grid where the interval may meet one of ``others``, and each bucket that it touches there."""
        own = F.col("_own")
        grids = F.array(*[F.lit(i) for i in sorted({*of_a, *of_b})])
        # Its own grid if the other side has intervals as short; a coarser one if the other side has some of that grid.
        coarser = F.filter(grids, lambda g: (g > own) & g.isin(others)) if others else F.array().cast("array<int>")
        here = F.when(own >= min(others, default=_LONGEST), F.array(own)).otherwise(F.array().cast("array<int>"))
        told = df.select("*", F.explode(F.concat(here, coarser)).alias("_grid"))
        size = F.lit(width) * F.pow(F.lit(_STEP), F.col("_grid")).cast("bigint")
        told = told.withColumn("_first", _floor(F.col("_from"), size)).withColumn("_last", _floor(F.col("_till"), size))
        kept = [c for c in df.columns if not c.startswith("_on")]
        return told.select(
            *[F.col(f"_on{i}") for i in range(len(on))],
            "_grid",
            F.explode(F.sequence("_first", "_last")).alias("_bucket"),
            F.struct("_first", *kept).alias(mark),
        )

    x, y = spread(a, of_b, "_a"), spread(b, of_a, "_b")
    pairs = x.join(y, [*[f"_on{i}" for i in range(len(on))], "_grid", "_bucket"])
    meet = (
        (F.greatest("_a._own", "_b._own") == F.col("_grid"))
        & (F.greatest("_a._first", "_b._first") == F.col("_bucket"))
    )
    if closed:
        meet = meet & (F.col("_a._from") <= F.col("_b._till")) & (F.col("_b._from") <= F.col("_a._till"))
    else:
        meet = meet & (F.col("_a._from") < F.col("_b._till")) & (F.col("_b._from") < F.col("_a._till"))
    if apart is not None:
        meet = meet & (F.col("_a._apart") != F.col("_b._apart"))
    found = pairs.filter(meet).select("_a._row.*", "_b._row.*")
    return found if where is None else found.filter(where)


def _overlap_totals(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    per: Sequence[str],
    closed: bool,
    apart: tuple[str, str] | None,
    rows_per_chunk: int = SLICE_ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
) -> DataFrame:
    """How many pairs :func:`overlap_join` has for each value of ``per``, and until when the last one lasts: ``per, pairs, until``.

    An interval overlaps all that start before it ends but those that end before it starts. So both sides are put in order of
    time once, as points, and each interval needs the number of starts before its end, less that of ends before its
    start. The latest end among these starts tells how long. Pairs that must be left out are counted in the same way among the
    rows of one value of ``apart`` and subtracted; the latest end is kept with that of the best other value. The whole is cut
    into buckets along that order, of which each hands its sums to the next.
    """
    keys = [f"_on{i}" for i in range(len(on))]

    def side(df: DataFrame, span: tuple[str, str], own: str | None) -> DataFrame:
        kept = df.select(
            "*",
            *[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)],
            F.col(span[1]).alias("_end"),
            *([] if own is None else [F.col(own).alias("_apart")]),
            # Generated, so that the optimizer does not write them out anew wherever they are used.
            F.explode(F.array(F.struct(instant(df, span[0]).alias("_start"), instant(df, span[1]).alias("_stop")))).alias("_span"),
        ).select("*", "_span.*").drop("_span")
        valid = F.col("_start") <= F.col("_stop") if closed else F.col("_start") < F.col("_stop")
        return kept.dropna(subset=[*keys, *([] if own is None else ["_apart"])]).filter(valid)

    # At one time, intervals that may only touch have their ends first; a closed one still meets what starts there.
    start, stop = (0, 2) if closed else (2, 0)
    same = F.lit(None).cast("int") if apart is None else F.col("_apart")
    tie = F.xxhash64("_start", "_stop", same)

    def points(df: DataFrame, at_start: tuple[int, int], at_stop: tuple[int, int], columns: list[str]) -> DataFrame:
        """A row for each end of an interval (its side at one time, its sign), among all and among those of its own value."""
        ends = [
            F.struct(own.alias("_own"), F.col(time).alias("_time"), F.lit(s).alias("_side"), F.lit(n).alias("_sign"))
            for own in ([same] if apart is None else [F.lit(None).cast(df.schema["_apart"].dataType), same])
            for time, (s, n) in (("_start", at_start), ("_stop", at_stop))
        ]
        return df.select(*keys, *columns, tie.alias("_tie"), F.explode(F.array(*ends)).alias("_p")).select(
            *keys, "_p.*", "_tie", *columns
        )

    value = [] if apart is None else ["_apart"]
    asking = side(left, left_span, None if apart is None else apart[0]).withColumn("_per", F.struct(*per))
    asking = points(asking, (1, -1), (1, 1), ["_start", "_end", "_per", *value])
    told = side(right, right_span, None if apart is None else apart[1]).withColumn("_reach", F.struct("_stop", "_end"))
    told = points(told, (start, 0), (stop, 0), ["_reach", *value])
    begins = (F.col("_side") == start) & F.col("_own").isNull()
    told = told.withColumn("_reach", F.when(begins, F.col("_reach")))

    order = [*keys, "_own", "_time", "_side", "_tie"]
    ends = (2 if apart is None else 4) * left.select(F.lit(1)).union(right.select(F.lit(1))).count()
    rows = whole_chunks(asking.unionByName(told, allowMissingColumns=True), order, rows_per_chunk, max_chunks, ends)
    rows = rows.withColumnRenamed(CHUNK, "_bucket")
    group = [*keys, "_own"]
    w = Window.partitionBy("_bucket", *group).orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, -1)

    def leading(lead: Column, rest: Column) -> Column:
        """The latest end among values other than the row's own, of those that a leader and the best other one stand for."""
        return lead["_reach"] if apart is None else F.when(lead["_apart"] != F.col("_apart"), lead["_reach"]).otherwise(rest)

    def beaten(before: str, lead: str) -> Column:
        """The lesser of the ends of two leaders of different values: a candidate for the best other one."""
        if apart is None:
            return F.lit(None).cast(rows.schema["_reach"].dataType)
        ends = F.least(F.col(f"{before}._reach"), F.col(f"{lead}._reach"))
        return F.when(F.col(f"{before}._apart") != F.col(f"{lead}._apart"), ends)

    rows = rows.withColumn("_lead", F.when(F.col("_reach").isNotNull(), F.struct("_reach", *value)))
    rows = rows.withColumns(
        {
            "_starts": F.count(F.when(F.col("_side") == start, 1)).over(w),
            "_stops": F.count(F.when(F.col("_side") == stop, 1)).over(w),
            "_first": F.max("_lead").over(w),
        }
    ).withColumn("_beaten", beaten("_first", "_lead"))

    # One row for each bucket and key; those that have rows in an earlier bucket, of which a bucket has one at most, are sent.
    sums = rows.groupBy("_bucket", *group).agg(
        F.count(F.when(F.col("_side") == start, 1)).alias("_starts"),
        F.count(F.when(F.col("_side") == stop, 1)).alias("_stops"),
        F.max("_lead").alias("_lead"),
        F.max("_beaten").alias("_rest"),
    )
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.max("_lead").over(earlier))
    sums = sums.withColumn("_rest", F.greatest("_rest", beaten("_before", "_lead")))
    carried = sums.select(
        *[F.col(k).alias(f"{k}_of") for k in group],
        F.col("_bucket").alias("_bucket_of"),
        F.sum("_starts").over(earlier).alias("_starts_before"),
        F.sum("_stops").over(earlier).alias("_stops_before"),
        F.col("_before"),
        F.max("_rest").over(earlier).alias("_rest_before"),
    ).filter(F.col("_starts_before").isNotNull())

    asked = rows.withColumn("_second", F.max("_beaten").over(w)).filter(F.col("_side") == 1)
    here = F.col("_bucket") == F.col("_bucket_of")
    for k in group:
        here = here & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    asked = asked.join(F.broadcast(carried), here, "left")
    starts = F.col("_starts") + F.coalesce("_starts_before", F.lit(0))
    stops = F.col("_stops") + F.coalesce("_stops_before", F.lit(0))
    counted = F.when(F.col("_sign") > 0, starts).otherwise(-stops)
    reach = F.greatest(leading(F.col("_first"), F.col("_second")), leading(F.col("_before"), F.col("_rest_before")))
    meets = reach["_stop"] >= F.col("_start") if closed else reach["_stop"] > F.col("_start")
    among_all = F.col("_own").isNull()
    return (
        asked.select(
            "_per.*",
            F.when(among_all, counted).otherwise(-counted).alias("_pairs"),
            F.when(among_all & (F.col("_sign") > 0) & meets, F.least(F.col("_end"), reach["_end"])).alias("_until"),
        )
        .groupBy(*per)
        .agg(F.sum("_pairs").alias("pairs"), F.max("_until").alias("until"))
        .filter("pairs > 0")
    )
