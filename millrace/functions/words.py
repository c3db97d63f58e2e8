"""Word splitting."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


# Characters that stay: ASCII letters and digits, and white space. Letters are lowercase by then, and
# single characters match several times faster than ranges and named classes.
_SPACE = r" \t\n\x0B\f\r"
_OTHER = f"[^{string.ascii_lowercase}{string.digits}{_SPACE}]"


def split_words(text: Column) -> Column:
    """As :func:`word_array`, with an empty string at either end where white space was."""
    return F.split(F.regexp_replace(F.lower(text), _OTHER, ""), f"[{_SPACE}]+")


def word_array(text: Column) -> Column:
    """Lowercased words of a text: everything but ASCII letters, digits and white space is deleted
    (accented letters too; they are not folded), then the text is split on white space.

    Empty strings from leading or trailing white space are no words and are dropped.
    """
    return F.array_remove(split_words(text), "")
