"""Running numpy code over whole texts, batch by batch, inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handled at a time; bounds what a task holds besides the Arrow batch itself.
ROWS = 256
#: Distinct words whose hashes a task remembers.
REMEMBERED = 400_000

#: Bytes of a word that are hashed in step with those of other words; longer ones are hashed one by one.
STEPPED = 64

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class WordHashes(dict):
    """The 64-bit hash of each word. Forgets all when it holds ``REMEMBERED`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def split_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() splits at exactly these characters."""
    return raw.split()


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` hashes, put together from runs of one, two, four, ... of them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, piece, size = None, 0, hashes.astype(np.uint64), 1
    while True:
        if width & size:
            part = piece[done : done + n]
            out = mixed(part) if out is None else mixed(out * _FACTOR + part)
            done += size
        if 2 * size > width:
            return out
        piece = mixed(piece[:-size] * _FACTOR + piece[size:])
        size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, one text after the other, and each text's number of
    words. Eight bytes of every word are taken at a time."""
    joined = b"\n".join([*texts, bytes(8)]).lower()
    raw = np.frombuffer(joined, np.uint8)
    room = len(raw) - 8
    gap = np.ones(room + 1, bool)
    gap[1:] = _SPACE[raw[:room]]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    lengths = ends - starts
    # All places of the texts as numbers of eight bytes each.
    eights = np.ndarray(room + 1, "<u8", joined, strides=(1,))
    hashes = mixed(lengths.astype(np.uint64) + _FACTOR)
    todo = np.arange(len(starts))
    for step in range(0, STEPPED, 8):
        if step:
            todo = todo[lengths[todo] > step]
        if not len(todo):
            break
        unused = np.maximum(8 - (lengths[todo] - step), 0).astype(np.uint64) * np.uint64(8)
        # What lies behind the word's end is shifted out.
        piece = eights[starts[todo] + step] << unused
        hashes[todo] = mixed(hashes[todo] * _FACTOR + piece)
    for i in np.flatnonzero(lengths > STEPPED):
        hashes[i] = xxhash.xxh64_intdigest(joined[starts[i] : ends[i]])
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal weight, compressed: small ones and small steps take little room."""
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def add_columns(
    df: DataFrame,
    kept: dict[str, Column],
    inputs: list[Column],
    make: Callable[[], Callable[..., list]],
    fields: str,
) -> DataFrame:
    """``kept`` columns beside new ``fields``. ``make()`` runs once a task and gives the function that maps
    lists of the ``inputs`` (texts best as binary) to a list for each field. Row order and number stay."""
    names = list(kept)
    chosen = df.select(
        *[c.alias(f"k{i}") for i, c in enumerate(kept.values())], *[c.alias(f"x{i}") for i, c in enumerate(inputs)]
    )
    n_kept, n_inputs = len(names), len(inputs)
    schema = T.StructType(chosen.schema.fields[:n_kept] + T.StructType.fromDDL(fields).fields)
    new = T.StructType.fromDDL(fields).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work, types = make(), [to_arrow_type(f.dataType) for f in new]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                made = work(*[part.column(n_kept + i).to_pylist() for i in range(n_inputs)])
                columns = [part.column(i) for i in range(n_kept)]
                columns += [pa.array(values, type=t) for values, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    out = chosen.mapInArrow(run, schema)
    return out.select(
        *[F.col(f"k{i}").alias(name) for i, name in enumerate(names)], *[F.col(f.name) for f in new]
    )


def raw_text(text: str | Column) -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")).cast("binary")


def id_remainder(ids: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(ids).cast("string"), F.lit("")).cast("binary")) % divisor
