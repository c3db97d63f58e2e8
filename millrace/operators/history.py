"""Rules over state histories: numbering, transitions, state folds, expiry and live spans.

A history is a table of ``(key, order..., state)`` rows; ``order`` ends in a unique column. A fold
over a key's rows is never run as one sequential task: it is either reduced to one candidate per key
and state before the shuffle, or runs over the chunks of :mod:`millrace.plans.spread`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.codes import (
    JOB_FINAL_FROM,
    JOB_STATES,
    SESSION_FINISHED,
    STATEMENT_PREDECESSORS,
    is_active,
    job_ordinal,
)
from millrace.plans import chunked, latest_before, positions, previous, spread_join

IDLE_TIMEOUT_S = 3600
STATE_RETAIN_S = 600


def number_rows(df: DataFrame, key: str, order: Sequence[str], name: str = "id", **layout) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in submission order."""
    return positions(df, [key], order, name, **layout)


def illegal_transitions(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    state: str = "state",
    predecessors: Mapping[str, Sequence[str]] = STATEMENT_PREDECESSORS,
    **layout,
) -> DataFrame:
    """State changes that the table of predecessors does not allow, with the state before.

    A row without a state changes nothing and is left out. A key's first row with one is no change. A state
    without predecessors may only be the first; any change to or from a state that the table does not know is
    not allowed.
    """
    known = df.filter(F.col(state).isNotNull())
    before = previous(chunked(known, [key], order, **layout), [key], order, state, "from_state")
    pairs = [(p, s) for s, earlier in predecessors.items() for p in earlier]
    allowed = F.struct("from_state", state).isin(
        [F.struct(F.lit(p), F.lit(s)) for p, s in pairs]
    )
    return before.filter(F.col("from_state").isNotNull() & ~allowed).select(
        *df.columns, "from_state"
    )


def accepted_job_states(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str = "state"
) -> DataFrame:
    """The state changes a job handle takes: only to a later state, and none after a final one. The
    job starts as SENT.

    A state can only be taken at its first row, so each key is first reduced to one row per state
    (six at most), in the map tasks; the fold then runs over these.
    """
    first = (
        df.withColumn("_ordinal", job_ordinal(F.col(state)))
        .filter(F.col("_ordinal").isNotNull())
        .groupBy(*keys, "_ordinal")
        .agg(F.min(F.struct(*order)).alias("_at"))
    )
    w = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    current = F.coalesce(F.max("_ordinal").over(w), F.lit(0))
    names = F.array(*[F.lit(s) for s in JOB_STATES])
    return (
        first.withColumn("_current", current)
        .filter((F.col("_current") < JOB_FINAL_FROM) & (F.col("_ordinal") > F.col("_current")))
        .select(*keys, "_at.*", F.get(names, F.col("_ordinal")).alias(state))
    )


def accepted_session_states(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str = "state",
    initial: str = "starting",
    **layout,
) -> DataFrame:
    """The state changes a session takes: no change to the same state, and none from an inactive to
    an active state. Rows without a state, or with one that sessions do not have, change nothing and are left out.

    Until a session has ended, the state before a row is that of the row before it; later it is the last inactive
    one, since no active state is taken any more. So one pass over the rows before gives all that is needed.
    """
    known = df.withColumn("_active", is_active(F.col(state))).filter(F.col("_active").isNotNull())
    rows = chunked(known, keys, order, **layout).withColumn("_end", F.when(~F.col("_active"), F.col(state)))
    seen = latest_before(rows, keys, order, {"_before": state, "_ended": "_end"})
    taken = ~F.col("_active") | F.col("_ended").isNull()
    current = F.coalesce("_ended", "_before", F.lit(initial))
    return seen.filter(taken & (F.col(state) != current)).select(*df.columns)


def effective_state(server: DataFrame, repl: DataFrame, key: str) -> DataFrame:
    """``key, state``: the interpreter's state (``busy`` when unknown) while the server's state is
    ``running``, else the server's. Both inputs have one row per key with a ``state``."""
    theirs = repl.select(key, F.col("state").alias("_repl"))
    return server.join(theirs, key, "left").select(
        key,
        F.when(F.col("state") == "running", F.coalesce("_repl", F.lit("busy")))
        .otherwise(F.col("state"))
        .alias("state"),
    )


def expired(
    df: DataFrame,
    key: str,
    ts: str,
    order: Sequence[str],
    now: Column,
    batch: Column,
    timeout_s: int = IDLE_TIMEOUT_S,
    retain_s: int = STATE_RETAIN_S,
    check: bool = True,
) -> DataFrame:
    """Keys to collect at time ``now``: ``key, state, last_activity``.

    A finished key (error, dead, success) goes once it is older than the retain time. Others go when
    idle longer than the timeout, unless checking is off or they are batch keys. ``batch`` is a
    boolean Column that is constant per key.
    """
    last = df.groupBy(key).agg(
        F.max_by("state", F.struct(*order)).alias("state"),
        F.max(ts).alias("last_activity"),
        F.max(batch).alias("_batch"),
    )
    age = now - F.col("last_activity")
    idle = F.lit(check) & ~F.col("_batch") & (age > F.make_dt_interval(secs=F.lit(timeout_s)))
    gone = F.when(
        F.col("state").isin(*SESSION_FINISHED), age > F.make_dt_interval(secs=F.lit(retain_s))
    ).otherwise(idle)
    return last.filter(gone).select(key, "state", "last_activity")


def live_spans(df: DataFrame, key: str, ts: str, timeout_s: int) -> DataFrame:
    """Spans during which a key was alive: ``key, first_beat, expires_at, beats``.

    A beat extends the span until ``timeout_s`` later; a beat at that very moment still counts. With
    timeout 0 a key never expires: one span per key without an end. A key that has never beaten (only null
    times) never expires either: it has one span without beats, start or end.

    Beats are first combined per key and tumbling window of the timeout's length, in the map tasks:
    two beats of one window are never further apart than the timeout, so no span is cut. The window
    function then sees at most one row per key and timeout, however many beats a key has.
    """
    if timeout_s == 0:
        return df.groupBy(key).agg(
            F.min(ts).alias("first_beat"),
            F.lit(None).cast(df.schema[ts].dataType).alias("expires_at"),
            F.count(ts).alias("beats"),
        )
    timeout = F.make_dt_interval(secs=F.lit(timeout_s))
    # A window drops rows without a time; with a stand-in, they are their key's first slot.
    at = F.coalesce(F.col(ts), F.lit("1970-01-01").cast(df.schema[ts].dataType))
    slots = df.groupBy(key, F.window(at, f"{timeout_s} seconds").alias("_slot"), F.col(ts).isNull().alias("_none")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(ts).alias("_beats")
    )
    beating = F.max(~F.col("_none")).over(Window.partitionBy(key))
    slots = slots.withColumn("_beating", beating).filter(~F.col("_none") | ~F.col("_beating"))
    w = Window.partitionBy(key).orderBy("_first")
    silence = F.col("_first") - F.lag("_last").over(w)
    marked = slots.withColumn("_new", F.when(silence > timeout, 1).otherwise(0))
    return (
        marked.withColumn("_span", F.sum("_new").over(w))
        .groupBy(key, "_span")
        .agg(
            F.min("_first").alias("first_beat"),
            (F.max("_last") + timeout).alias("expires_at"),
            F.sum("_beats").alias("beats"),
        )
        .drop("_span")
    )


def first_terminal(
    df: DataFrame, key: str, order: Sequence[str], terminal: Column, **layout
) -> DataFrame:
    """Terminal rows with ``delivered``: true for the first of each key, false for later ones, whose
    reading would fail."""
    ends = df.filter(terminal)
    first = ends.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        spread_join(ends, first, [key], order, "inner", **layout)
        .withColumn("delivered", F.struct(*order) == F.col("_first"))
        .drop("_first")
    )


