"""Path checks before files are handed to a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import let

# Messages about paths that cannot be used.
ILLEGAL_MESSAGE = "Illegal character in path: "
RELATIVE_MESSAGE = ("Path '", "' is not absolute.")
LOCAL_MESSAGE = ("Local path ", " cannot be added to user sessions.")

# Characters that no URI may hold: white space and controls, quotes, brackets, and a bare percent.
_ILLEGAL = r"""[\x00-\x20"<>\\^`{|}\x7f]|%(?![0-9A-Fa-f]{2})"""
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# Path of a reference: after an optional scheme and //authority, up to ? or #.
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def _decoded_path(ref: Column) -> Column:
    """Path of a reference with percent codes decoded (a plus sign stays one)."""
    raw = F.regexp_extract(ref, _PATH, 1)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def resolve_path(path: Column, default_fs: str, allowed: Sequence[str]) -> Column:
    """``struct(resolved, error)`` for a path or URI.

    Without a scheme an absolute path is put under ``default_fs`` (query and fragment are not part
    of the path and are dropped) and a relative one is an error. A ``file:`` path must start with
    one of the ``allowed`` directories. Others pass unchanged.
    """
    base = default_fs.removesuffix("/")
    own_path = _decoded_path(path)
    has_scheme = path.rlike(_SCHEME)
    full = F.when(has_scheme, path).otherwise(F.concat(F.lit(base), own_path))
    full_path = _decoded_path(full)
    local = F.regexp_extract(full, _SCHEME, 1) == "file"
    inside = F.lit(False)
    for folder in allowed:
        inside = inside | full_path.startswith(folder.rstrip("/") + "/")
    # A bare path is decoded before it is put under the default, so it must be legal after that too.
    illegal = path.rlike(_ILLEGAL) | (~has_scheme & own_path.rlike(_ILLEGAL))
    error = (
        F.when(illegal, F.concat(F.lit(ILLEGAL_MESSAGE), path))
        .when(
            ~has_scheme & ~own_path.startswith("/"),
            F.concat(F.lit(RELATIVE_MESSAGE[0]), own_path, F.lit(RELATIVE_MESSAGE[1])),
        )
        .when(
            local & ~inside,
            F.concat(F.lit(LOCAL_MESSAGE[0]), own_path, F.lit(LOCAL_MESSAGE[1])),
        )
    )
    return F.struct(F.when(error.isNull(), full).alias("resolved"), error.alias("error"))


def merge_lists(user_list: Column, conf_text: Column, default_fs: str, allowed: Sequence[str]) -> Column:
    """``struct(value, error)``: the user's array first, then the configured text split on commas and spaces,
    each resolved by :func:`resolve_path`, joined by commas. Empty entries are dropped; the value is null when
    nothing is left. The first path that cannot be used gives the error, and no value."""
    conf_list = F.coalesce(F.split(conf_text, "[, ]+"), F.array().cast("array<string>"))
    own_list = F.coalesce(user_list, F.array().cast("array<string>"))
    both = F.filter(F.concat(own_list, conf_list), lambda p: p != "")
    return let(F.transform(both, lambda p: resolve_path(p, default_fs, allowed)), _joined)


def _joined(paths: Column) -> Column:
    error = F.get(F.filter(F.transform(paths, lambda p: p["error"]), F.isnotnull), F.lit(0))
    value = F.array_join(F.transform(paths, lambda p: p["resolved"]), ",")
    return F.struct(F.when(error.isNull() & (F.size(paths) > 0), value).alias("value"), error.alias("error"))
