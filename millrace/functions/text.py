"""Errors, stack traces, terminal output and notebook cells, one text or array per row.

A text is handled whole inside its row by array expressions, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import let

# How internal frames of the Scala shell are recognised and renamed.
FRAME_MARKER = "$iwC$$iwC.<init>"
AT_LINE = r"^[\x00-\x20]*at"
USER_CLASS = r"(\$iwC\$)*\$iwC"
USER_CLASS_NAME = "<user code>"

# Fixed value: the frame of the Python shell that runs a user's top-level code.
PYTHON_TOP_FRAME = r'^\s*File "<stdin>".*in <module>'

# Fixed value: terminal colour and cursor codes.
ANSI_CODE = "\u001b\\[[0-9;]*[mG]"

# Plotting functions, in the order in which they are tried.
PLOT_NAMES = (
    "bagplot",
    "barplot",
    "boxplot",
    "dotchart",
    "hist",
    "lines",
    "pie",
    "pie3D",
    "plot",
    "qqline",
    "qqnorm",
    "scatterplot",
    "scatterplot3d",
    "scatterplot.matrix",
    "splom",
    "stripchart",
    "vioplot",
)

# Fixed value: a command line of the Scala shell.
MAGIC_LINE = r"^%(\w+)\W*(.*)"

# Commands a notebook cell may start a line with, after the percent sign.
MAGICS = ("table", "json", "matplot")

_SPACES = "\t\n\x0b\f\r "


def _trim_control(text: Column) -> Column:
    """Strip white space and control characters (code points up to 32) from both ends."""
    return F.btrim(text, F.lit("".join(chr(c) for c in range(33))))


def error_name(text: Column) -> Column:
    """First line of an error report, trimmed; empty for an empty report."""
    return _trim_control(F.substring_index(text, "\n", 1))


def error_traceback(text: Column) -> Column:
    """The lines after the first one, each with its newline."""
    lines = F.split(F.substr(text, F.instr(text, "\n") + 1), r"(?<=\n)")
    return F.when(
        text.isNotNull(),
        F.when(text.contains("\n"), F.array_remove(lines, "")).otherwise(_no_lines()),
    )


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _rest(lines: Column, start: Column) -> Column:
    """Elements from the 1-based ``start`` on."""
    return F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))


def _first_match(lines: Column, test) -> Column:
    """1-based position of the first matching element, 0 if none."""
    return F.array_position(F.transform(lines, test), True).cast("int")


def clean_trace(lines: Column) -> Column:
    """Drop the shell's internal frames from an array of trace lines.

    The run goes from the first line with the marker to the first later line that does not start
    with ``at``; in the rest the shell's generated class chains are shown as user code. A trace
    without the marker is left as it is.
    """

    def cut(trace: Column, start: Column) -> Column:
        tail = _rest(trace, start)
        after = let(
            tail,
            lambda t: let(
                _first_match(t, lambda x: ~x.rlike(AT_LINE)),
                lambda end: F.when(end > 0, _rest(t, end)).otherwise(_no_lines()),
            ),
        )
        kept = F.concat(F.slice(trace, 1, start - 1), after)
        return F.transform(kept, lambda x: F.regexp_replace(x, USER_CLASS, USER_CLASS_NAME))

    return let(
        lines,
        lambda trace: let(
            _first_match(trace, lambda x: x.contains(FRAME_MARKER)),
            lambda start: F.when(start > 0, cut(trace, start)).otherwise(trace),
        ),
    )


def clean_python_trace(lines: Column) -> Column:
    """Keep the header line and drop everything up to and with the first top-level shell frame."""
    return let(
        lines,
        lambda trace: let(
            _first_match(trace, lambda x: x.rlike(PYTHON_TOP_FRAME)),
            lambda top: F.when(
                top > 0, F.concat(F.slice(trace, 1, 1), _rest(trace, F.greatest(top, F.lit(1)) + 1))
            ).otherwise(trace),
        ),
    )


def strip_ansi(text: Column) -> Column:
    """Remove terminal colour codes, also those with several numbers."""
    return F.regexp_replace(text, ANSI_CODE, "")


def cell_chunks(code: Column) -> Column:
    """Chunks of a notebook cell: ``array<struct<chunk, kind, name, argument>>``.

    A line that starts with ``%`` is a chunk of its own; the lines between are one chunk of code.
    ``name`` runs to the first space and ``argument`` is the rest. ``kind`` is ``code``, one of the
    known commands, ``empty`` (a bare ``%``) or ``unknown``. Splitting does not depend on whether
    the cell parses as a program; trailing white space is ignored.
    """
    return let(F.split(F.rtrim(code, F.lit(_SPACES)), "\n"), _chunks)


def _chunks(lines: Column) -> Column:
    magic = F.transform(lines, lambda x: x.startswith("%"))

    def starts(flags: Column) -> Column:
        """0-based lines at which a chunk starts: a command, or the line after one."""
        return F.filter(
            F.sequence(F.lit(0), F.size(flags) - 1),
            lambda i: (i == 0) | F.get(flags, i) | F.coalesce(F.get(flags, i - 1), F.lit(False)),
        )

    def cut(first: Column) -> Column:
        return F.transform(
            first,
            lambda s, n: F.array_join(
                F.slice(lines, s + 1, F.coalesce(F.get(first, n + 1), F.size(lines)) - s), "\n"
            ),
        )

    return F.transform(let(let(magic, starts), cut), _chunk)


def magic_line(line: Column) -> Column:
    """``struct(name, argument)`` of a command line by the Scala shell's rule: the name is a run of
    word characters and the argument starts at the next one. Null for any other line."""
    name = F.regexp_extract(line, MAGIC_LINE, 1)
    argument = F.regexp_extract(line, MAGIC_LINE, 2)
    return F.when(
        line.rlike(MAGIC_LINE + r"\z"), F.struct(name.alias("name"), argument.alias("argument"))
    )


def _chunk(text: Column) -> Column:
    magic = text.startswith("%")
    space = F.instr(text, " ")
    name = F.substring_index(F.substr(text, F.lit(2)), " ", 1)
    kind = (
        F.when(~magic, "code")
        .when(name == "", "empty")
        .when(name.isin(*MAGICS), name)
        .otherwise("unknown")
    )
    return F.struct(
        text.alias("chunk"),
        kind.alias("kind"),
        F.when(magic, name).alias("name"),
        F.when(magic & (space > 0), F.substr(text, space + 1)).alias("argument"),
    )


def plot_call(code: Column) -> Column:
    """First plotting function named in a piece of code, or null.

    At the leftmost position the first name of the list wins, with no word boundary: ``pie3D`` is
    reported as ``pie`` and ``scatterplot3d`` as ``scatterplot``.
    """
    pattern = "(" + "|".join(n.replace(".", r"\.") for n in PLOT_NAMES) + ")"
    return F.nullif(F.regexp_extract(code, pattern, 1), F.lit(""))
