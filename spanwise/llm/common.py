"""Helpers that several training-data operators share: reading, folds, written tables, word hashing.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. They are found and hashed for a whole
Arrow batch at once, in pieces of about a megabyte, so memory follows the piece and not the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small when every text of a batch is long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def held_out(doc_id: Column) -> Column:
    """The fold nothing is learned from; a row without an id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """The one large object that a worker process keeps from task to task; one of another key takes its place."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Give back what this worker process holds from earlier tasks: kept objects, free memory of Arrow and of the allocator."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def letter_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code for each byte; upper-case ASCII shares the code of its lower case if asked."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    out = []
    for base in (_MULTIPLIER, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_kept_powers = cache(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers below n; only those for a usual piece are kept."""
    return _kept_powers(PIECE) if n <= PIECE else _powers(n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column and the n + 1 offsets of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that start and end between words."""
    at, end = 0, len(data)
    while at < end:
        stop = min(at + PIECE, end)
        if stop < end:
            after = int(offsets[np.searchsorted(offsets, stop)])
            step, cut = 4096, None
            while cut is None and stop < after:
                gap = np.flatnonzero(_SPACE[data[stop : min(stop + step, after)]])
                if len(gap):
                    cut = stop + int(gap[0])
                else:
                    stop, step = min(stop + step, after), step * 2
            stop = after if cut is None else cut
        yield at, stop
        at = stop


def words(data: np.ndarray, offsets: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word; a word never crosses the end of its text."""
    codes, found = letter_codes(fold_case), ([], [], [])
    inner = offsets[1:-1]
    for lo, hi in pieces(data, offsets):
        part = data[lo:hi]
        solid = ~_SPACE[part]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cuts = inner[np.searchsorted(inner, lo, "right") : np.searchsorted(inner, hi)] - lo
        begins[cuts] = solid[cuts]
        ends[cuts - 1] = solid[cuts - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * down[: len(part)], out=sums[1:])
        for kept, new in zip(found, (s + lo, e + lo, mix((sums[e] - sums[s]) * up[s])), strict=True):
            kept.append(new)
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in found)


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text that each position belongs to."""
    return np.searchsorted(offsets, starts, "right") - 1


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, and is this one its first occurrence?"""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    if len(same):
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        first[order[1:]] = ~same
    return twice, first


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of one key after the other, from input sorted by key; a key's rows are few by construction."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not len(batch):
            continue
        columns = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            key = tuple(columns[lo])
            if held and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
