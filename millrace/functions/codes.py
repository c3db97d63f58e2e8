"""Codes, aliases and the state tables shared by the history operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of session kinds.
KINDS = {
    "spark": "spark",
    "scala": "spark",
    "pyspark": "pyspark",
    "python": "pyspark",
    "pyspark3": "pyspark3",
    "python3": "pyspark3",
    "sparkr": "sparkr",
    "r": "sparkr",
}

# Cluster state to application state, where the final status does not matter.
CLUSTER_STATES = {
    "NEW": "starting",
    "NEW_SAVING": "starting",
    "SUBMITTED": "starting",
    "ACCEPTED": "starting",
    "RUNNING": "running",
    "FAILED": "failed",
    "KILLED": "killed",
}

# Final status of a FINISHED application to application state; others are failed.
FINAL_STATUSES = {"SUCCEEDED": "finished", "FAILED": "failed", "KILLED": "killed"}

# Application state to batch session state; others change nothing.
APP_TO_SESSION = {
    "running": "running",
    "finished": "success",
    "killed": "dead",
    "failed": "dead",
}

# Session states, whether they are active, and which are finished.
SESSION_ACTIVE = {
    "not_started": True,
    "starting": True,
    "recovering": True,
    "idle": True,
    "running": True,
    "busy": True,
    "shutting_down": False,
    "error": True,
    "dead": False,
    "success": False,
}
SESSION_FINISHED = ("error", "dead", "success")

# Job states in ordinal order; CANCELLED and later are final.
JOB_STATES = ("SENT", "QUEUED", "STARTED", "CANCELLED", "FAILED", "SUCCEEDED")
JOB_FINAL_FROM = JOB_STATES.index("CANCELLED")

# Statement states and the states each may follow.
STATEMENT_PREDECESSORS = {
    "waiting": (),
    "running": ("waiting",),
    "available": ("running",),
    "cancelling": ("running",),
    "cancelled": ("waiting", "cancelling"),
}


def map_codes(code: Column, mapping: Mapping[str, object]) -> Column:
    """The value of a code under a fixed mapping; null for an unknown or missing code.

    The mapping is a literal of the plan: nothing is joined or shipped apart from it.
    """
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, code)


def session_kind(name: Column) -> Column:
    """Canonical session kind, or null when invalid."""
    return map_codes(name, KINDS)


def app_state(cluster_state: Column, final_status: Column) -> Column:
    """Application state of a cluster report; an unknown final status counts as failed."""
    finished = F.coalesce(map_codes(final_status, FINAL_STATUSES), F.lit("failed"))
    return F.when(cluster_state == "FINISHED", finished).otherwise(
        map_codes(cluster_state, CLUSTER_STATES)
    )


def session_state(app: Column, current: Column) -> Column:
    """Batch session state after its application reached ``app``."""
    return F.coalesce(map_codes(app, APP_TO_SESSION), current)


def job_ordinal(state: Column) -> Column:
    return map_codes(state, {s: i for i, s in enumerate(JOB_STATES)})


def is_active(state: Column) -> Column:
    return map_codes(state, SESSION_ACTIVE)
