"""Words of many texts at once, as numpy arrays of 64-bit hashes.

A text is handled as UTF-8 bytes. One byte table lower-cases A-Z (or leaves case alone) and turns
every byte that is no part of a word into a space; bytes from 0x80 on always belong to words.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_SECOND = U(0xD6E8FEB86659FD93)

SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
LOWER_SPACES = bytes(b + 32 if 65 <= b <= 90 else s for b, s in enumerate(SPACES))
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _MULT)
_BYTE[32] = 0


def _powers(n: int, base: np.uint64 = _MULT) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of several texts: `hash`, `start`, `end` by word, `first[i]` .. `first[i + 1]` the words of text i."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.bytes = b"\n".join(texts).translate(table)
        raw = np.frombuffer(self.bytes, np.uint8)
        inside = np.concatenate(([False], raw != 32, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)
        self.first[-1] = len(self.start)
        if not len(self.start):
            self.hash = np.empty(0, U)
            return
        room = np.diff(self.start, append=len(raw))
        place = np.arange(self.start[0], len(raw)) - np.repeat(self.start, room)
        value = _BYTE[raw[self.start[0] :]] * _powers(int(room.max()))[place]
        self.hash = mix(np.add.reduceat(value, self.start - self.start[0]) + (self.end - self.start).astype(U) * _SECOND)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]]


def rolled(h: np.ndarray, length: int, base: np.uint64 = _MULT) -> np.ndarray:
    """The hash of each run of `length` values, by joining runs of doubled lengths."""
    if len(h) < length:
        return np.empty(0, U)
    out, have, power = None, 0, None
    part, size, step = h, 1, base
    while True:
        if length & size:
            if out is None:
                out, have = part, size
            else:
                n = len(h) - have - size + 1
                out, have = out[:n] * step + part[have : have + n], have + size
        if have == length:
            return mix(out * _SECOND + U(length))
        n = len(part) - size
        part, size, step = part[:n] * step + part[size : size + n], size * 2, U(int(step) ** 2 & (1 << 64) - 1)


def windows(words: Words, length: int) -> np.ndarray:
    """The words at which a run of `length` words of one text starts."""
    last = np.repeat(words.first[1:], words.counts)
    return np.flatnonzero(np.arange(len(words)) + length <= last)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of `length` from one of the starts."""
    change = np.zeros(n + length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n]) > 0


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8; null as the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, most: int = 1 << 21):
    """Parts of a record batch with about `most` bytes of text each (one longer text makes a part of its own)."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False), np.int64)
    if not len(size):
        return
    part = np.cumsum(size) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpacked(parts) -> np.ndarray:
    """The 64-bit values of several packed runs."""
    parts = [p for p in parts or () if p]
    return np.frombuffer(b"".join(parts), U) if parts else np.empty(0, U)


def sheltered(df, used: tuple = ("doc_id", "text")):
    """df with all but the used columns under names that no operator has, and a function that gives a result its own names back.

    Columns that the result has besides stand after them.
    """
    plain = df.toDF(*(c if c in used else f"_own_{i}" for i, c in enumerate(df.columns)))

    def own(out):
        more = [c for c in out.columns if c not in plain.columns]
        return out.select(*plain.columns, *more).toDF(*df.columns, *more)

    return plain, own


def append(df, make, fields: str, need: tuple = ()):
    """df with the columns that make(record batch) returns as arrays, in `fields` order.

    make gets parts of partitions, bounded by bytes of text, with the columns text and `need`, and must
    give an array for each field. A column of df with the name of a field gives way to it.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(fields)
    named = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in named and c != "text"]
    with_text = "text" not in named
    source = df.select("text", *need, *(df[c].alias(f"_in_{i}") for i, c in enumerate(kept)))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                arrays = [*([part.column("text")] if with_text else []), *(part.column(f"_in_{i}") for i in range(len(kept))), *make(part)]
                yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    types = [*([df.schema["text"].dataType] if with_text else []), *(df.schema[c].dataType for c in kept), *(f.dataType for f in new)]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    return source.mapInArrow(run, schema).toDF(*(["text"] if with_text else []), *kept, *new.names)
