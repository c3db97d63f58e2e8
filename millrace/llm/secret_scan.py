"""Secrets in texts: fixed patterns, and strings that look like the credentials found by them.

Probabilistic automata are inferred from a sample of the credentials that the patterns find, one for each kind,
and one from ordinary strings. Every candidate string of every text is then scored by how much likelier it is
under a credential's automaton than under the ordinary one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.automata import Automaton, infer
from millrace.llm.batches import add_columns, raw_text

# Kinds in the order of spans that start together, and their patterns.
KINDS = ["assign", "access", "hex"]
ADDED = "format"
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_DIGIT = re.compile(r"[0-9]")

#: Credentials of each kind, and ordinary strings, that the automata are inferred from, at most.
SAMPLE = 500
#: Longer strings are not learnt from; they are scored like any others.
LONGEST = 512
#: Natural logarithm by which a character must be likelier in a credential than in an ordinary string.
MARGIN = 0.35
#: Shares of credentials between which a string is as likely as they are.
TYPICAL = (0.01, 0.99)

_SPANS = "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"


@dataclass
class Formats:
    """Automata of the credentials by kind, and of ordinary strings."""

    secret: dict[str, Automaton]
    ordinary: Automaton | None


def pattern_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, secret itself) of every match of the fixed patterns, by start and rank."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of 16 and more credential characters with a digit, apart from the spans found already."""
    if not _DIGIT.search(text):
        return []
    out = []
    for m in _CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in spans):
            out.append((m.start(), m.end(), m[0]))
    return out


def infer_formats(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Formats:
    """Automata from at most ``sample`` distinct strings of each kind: those whose hashes are smallest."""

    def make():
        def strings(texts: list[bytes]) -> list:
            out = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                spans = pattern_spans(text)
                named = [(KINDS[rank], value) for _, rank, _, value in spans]
                out.append(named + [("ordinary", value) for _, _, value in candidates(text, spans)])
            return [out]

        return strings

    found = add_columns(docs, {}, [raw_text(text_col)], make, "strings array<struct<kind:string,value:string>>")
    each = found.select(F.inline("strings")).filter(F.length("value") <= LONGEST).distinct().withColumn("h", F.xxhash64("value"))
    # First the smallest of each of 64 parts, so that a frequent kind is not sorted in one task.
    for keys in (["kind", F.pmod("h", F.lit(64))], ["kind"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "value"))
        each = each.withColumn("rank", rank).filter(F.col("rank") <= sample).drop("rank")
    chosen = {kind: [] for kind in [*KINDS, "ordinary"]}
    for row in each.collect():
        chosen[row.kind].append(row.value)
    plain = chosen.pop("ordinary")
    secret = {kind: infer(values) for kind, values in chosen.items() if values}
    # Credentials without a name are among the ordinary strings, so those that are as likely as credentials are do not count.
    for kind, automaton in secret.items():
        low, high = np.quantile([mean_likelihood(automaton, x) for x in chosen[kind]], TYPICAL)
        plain = [x for x in plain if not low <= mean_likelihood(automaton, x) <= high]
    return Formats(secret, infer(plain) if plain else None)


def mean_likelihood(automaton: Automaton, value: str) -> float:
    return automaton.log_likelihood(value) / len(value)


def format_score(formats: Formats, value: str) -> float:
    """By how much a character of ``value`` is likelier under the best credential automaton than in ordinary
    strings, as a mean over its characters."""
    plain = formats.ordinary.log_likelihood(value) if formats.ordinary else -2.0 * len(value)
    return max((a.log_likelihood(value) - plain) / len(value) for a in formats.secret.values())


def secret_spans(text: str, formats: Formats, margin: float = MARGIN) -> list[tuple[str, int, int, float]]:
    spans = pattern_spans(text)
    out = [(start, rank, end, 1.0) for start, rank, end, _ in spans]
    if formats.secret:
        for start, end, value in candidates(text, spans):
            score = format_score(formats, value)
            if score >= margin:
                out.append((start, len(KINDS), end, score))
    names = [*KINDS, ADDED]
    return [(names[rank], start, end, score) for start, rank, end, score in sorted(out)]


def secret_scan(docs: DataFrame, formats: Formats, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its id and ``spans`` of (kind, start, end, score), in code points, end
    exclusive, by start and then kind as listed. A pattern's span is its whole match, with score 1.

    A null or empty text has no spans. A null id stays null; repeated rows are each scanned. Whole texts are read
    however long; an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def make():
        return lambda texts: [[secret_spans(raw.decode("utf-8", "replace"), formats, margin) for raw in texts]]

    return add_columns(docs, {id_col: F.col(id_col)}, [raw_text(text_col)], make, _SPANS)


def redacted(text: str, spans: list[tuple[str, int, int, float]], mark: str) -> str:
    out, done = [], 0
    for _, start, end, _ in spans:
        if end > done:
            out += [text[done : max(start, done)], mark if start >= done else ""]
            done = end
    return "".join([*out, text[done:]])


def redact_secrets(
    docs: DataFrame,
    formats: Formats,
    mark: str = "[secret]",
    margin: float = MARGIN,
    text_col: str = "text",
    length_col: str = "n_chars",
) -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark`` and the length column set to the new text's
    code points. Rows without secrets stay as they are, null texts too; repeated rows are each cleaned, an empty table gives an
    empty one, and other columns are carried along whatever their names. One pass, nothing is shuffled."""

    def make():
        def clean(texts: list[bytes]) -> list:
            out = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                spans = secret_spans(text, formats, margin)
                out.append(redacted(text, spans, mark) if spans else None)
            return [out]

        return clean

    names = docs.columns
    kept = {f"c{i}": F.col(f"`{name}`") for i, name in enumerate(names)}
    made = add_columns(docs, kept, [raw_text(text_col)], make, "clean string")
    out = []
    for i, name in enumerate(names):
        column = F.col(f"c{i}")
        if name == text_col:
            column = F.coalesce("clean", column)
        elif name == length_col:
            column = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[name].dataType)).otherwise(column)
        out.append(column.alias(name))
    return made.select(*out)


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the patterns' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, *[count(kind) for kind in KINDS], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans")
    )
