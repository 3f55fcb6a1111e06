"""Helpers shared by the text operators: word and line expressions, numpy views of Arrow text, row identity."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for an empty text."""
    bare = F.btrim(text, F.lit(_SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_tasks(df: DataFrame) -> int:
    """Tasks that Spark reads ``df`` with: grows with the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside; long texts make large batches otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --- numpy views of text -------------------------------------------------------------------------------------

_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[[32, 9, 10, 11, 12, 13]] = True
_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and their inverses."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            out.append(np.cumprod(step, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have


def sums_before(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


class Words:
    """Words of some consecutive texts: ``first[d]:first[d + 1]`` are those of text d."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, table: np.ndarray | None = None):
        self.buf = _LOWER_TABLE[buf] if lower else buf
        word = ~(_SPACE_TABLE if table is None else table)[buf]
        n = len(buf)
        start, end = np.empty(n, bool), np.empty(n, bool)
        if n:
            start[0], start[1:] = word[0], word[1:] & ~word[:-1]
            end[-1], end[:-1] = word[-1], word[:-1] & ~word[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            start[inner] |= word[inner]
            end[inner - 1] |= word[inner - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @functools.cached_property
    def _sums(self) -> np.ndarray:
        pw, _ = powers(_BASE, len(self.buf) + 1)
        return sums_before(_BYTE_VALUES[self.buf] * pw[: len(self.buf)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        sums, (_, inv) = self._sums, powers(_BASE, len(self.buf) + 1)
        return mix64((sums[self.ends] - sums[self.starts]) * inv[self.starts])

    def prefix_hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words longer than ``length`` bytes, and hashes of their first bytes."""
        which = np.flatnonzero(self.ends - self.starts > length)
        sums, (_, inv) = self._sums, powers(_BASE, len(self.buf) + 1)
        at = self.starts[which]
        return which, mix64((sums[at + length] - sums[at]) * inv[at] + np.uint64(length))


def rolling(hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of ``hashes[i : i + width]`` for every i at which a whole window starts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    pw, inv = powers(base, len(hashes) + 1)
    sums = sums_before(hashes * pw[: len(hashes)])
    return mix64((sums[width:] - sums[:-width]) * inv[:n])


def text_blocks(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in blocks of about ``limit`` bytes: (first row, end row, bytes, offsets of the texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# --- packed exchange -----------------------------------------------------------------------------------------

PACKED_SCHEMA = "bucket long, keys binary, places binary, texts binary, counts binary"


def _narrow(values: np.ndarray) -> bytes:
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


class Packer:
    """Gathers (bucket, key, place in a text, text) and gives them out as one row per bucket.

    A row holds thousands of entries as bytes, so that a shuffle moves 10 bytes an entry and no row objects, or less if
    only the low ``key_bytes`` of the keys are sent.
    """

    def __init__(self, buckets: int, key_bytes: int = 8, limit: int = 1_000_000):
        self.buckets, self.key_bytes, self.limit, self.parts, self.size = buckets, key_bytes, limit, [], 0

    def add(self, bucket: np.ndarray, key: np.ndarray, place: np.ndarray, text: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``text``: a 64-bit name of each entry's text, entries of a text being neighbours."""
        self.parts.append((bucket.astype(np.int64), key, place.astype(np.uint32), text))
        self.size += len(key)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        bucket, key, place, text = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, key, place, text = bucket[order], key[order], place[order], text[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        cols = ([], [], [], [], [])
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = text[lo:hi]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for c, v in zip(cols, (int(bucket[lo]), key[lo:hi].view(np.uint8).reshape(-1, 8)[:, : self.key_bytes].tobytes(), _narrow(place[lo:hi]), own[at].tobytes(), _narrow(np.diff(at, append=hi - lo)))):
                c.append(v)
        kinds = (pa.int64(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "keys", "places", "texts", "counts"])


def pack_places(bucket: np.ndarray, place: np.ndarray, text: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """(bucket, places, texts, counts) rows of places without keys; entries of a text must be neighbours."""
    order = np.argsort(bucket, kind="stable")
    bucket, place, text = bucket[order], place[order], text[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = text[lo:hi]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows.append((int(bucket[lo]), _narrow(place[lo:hi]), own[at].tobytes(), _narrow(np.diff(at, append=hi - lo))))
    return rows


def unpack_places(places: Iterator[bytes], texts: Iterator[bytes], counts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of all entries of some rows of ``pack_places``."""
    place, text = [], []
    for p, t, c in zip(places, texts, counts):
        names = np.frombuffer(t, np.uint64)
        each = _wide(c, len(names))
        place.append(_wide(p, int(each.sum())))
        text.append(np.repeat(names, each))
    return np.concatenate(place), np.concatenate(text)


def unpack(keys: Iterator[bytes], places: Iterator[bytes], texts: Iterator[bytes], counts: Iterator[bytes], key_bytes: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, text) of all entries of some packed rows."""
    key, place, text = [], [], []
    for k, p, t, c in zip(keys, places, texts, counts):
        n = len(k) // key_bytes
        names = np.frombuffer(t, np.uint64)
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :key_bytes] = np.frombuffer(k, np.uint8).reshape(n, key_bytes)
        key.append(whole.view(np.uint64).reshape(-1))
        place.append(_wide(p, n))
        text.append(np.repeat(names, _wide(c, len(names))))
    return np.concatenate(key), np.concatenate(place), np.concatenate(text)


def sequence_names(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each text's sequence of words; equal sequences have equal names."""
    pw, inv = powers(0xA24BAED4963EE407, len(hashes) + 1)
    sums = sums_before(hashes * pw[: len(hashes)])
    n = np.diff(first)
    return mix64((sums[first[1:]] - sums[first[:-1]]) * inv[first[:-1]] + n.astype(np.uint64))
