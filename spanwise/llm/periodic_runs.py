"""Periodic runs: stretches of consecutive words that repeat with a period, found while the words go by.

A *run* is a stretch with smallest period q (words q apart are identical) of at least ``exponent * q`` and at
least ``least`` words that neither neighbouring word extends. On the diagonal of lag q such a run is a
series of matches, one longer with each word; where the series breaks, the run is complete and is emitted.

Diagonals are kept sparse, because a frequent word lies on as many diagonals as it has earlier occurrences.
A diagonal of lag q matters only from its (exponent - 1) * q-th match on, so a word touches it only once
the context before the word recurs too: with contexts of C words, q <= C < 2q, the nearest earlier
occurrence of a context inside a run is exactly one period away. (A nearer one would give the context a
shorter period than q, and the whole run with it.) Each word therefore touches one diagonal per power of two C,
the one of its context's nearest earlier occurrence; series at multiples of the smallest period never arise.
Contexts double from C to 2C for those words only whose context occurs twice, which are few in ordinary text.
Work grows as words times the logarithm of the longest repeated context, whatever the frequency of a word. This
holds for an exponent of at least 3.

Texts are judged one by one where they lie: no shuffle, no state between texts, so a lost task is run
again by itself. Memory follows the Arrow batch, or one text where it is longer (about 20 times its bytes).

Defined results: a null or empty text has no word and no run, and collapses to an empty text; rows without a
doc_id and repeated rows are judged like any other, one row out for each row in; runs of one text may
overlap, and equal stretches at several places are several runs; other columns are not read. Very long texts are
judged whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPONENT, LEAST = 4, 6
#: White space between words, as a Java pattern.
GAPS = r"[\x20\x09-\x0D]+"
_SCHEMA = "doc_id {doc_id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(words: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run in a sequence of word numbers, by start and period.

    Several texts may follow one another if none shares a number with another: a context across their border
    then occurs once only.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, context, width = np.arange(len(words)), np.asarray(words, np.int64), 1
    while len(at):
        order = np.argsort(context, kind="stable")
        ranked, place = context[order], at[order]
        same = ranked[1:] == ranked[:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(same, place[1:] - place[:-1], 0)
        touched = np.flatnonzero((lag > width // 2) & (lag <= width))
        if len(touched):
            where, period = at[touched], lag[touched]
            breaks = np.flatnonzero((np.diff(where) != 1) | (np.diff(period) != 0)) + 1
            first, last = np.append(0, breaks), np.append(breaks, len(where)) - 1
            period = period[first]
            start = where[first] - (width - 1) - period
            length = where[last] + 1 - start
            good = length >= np.maximum(least, exponent * period)
            found.append((start[good], length[good], period[good]))
        # Contexts twice as wide: this one, and the one that ends where it begins.
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(np.append(True, ~same)) - 1
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at, number = at[twice], number[twice]
        before = np.searchsorted(at, at - width)
        joined = before < len(at)
        joined[joined] = at[before[joined]] == at[joined] - width
        context = number[joined] * (len(words) + 1) + number[before[joined]]
        at, width = at[joined], width * 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _judged(texts: list[bytes | None], exponent: int, least: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts of some texts."""
    words = [(t or b"").split() for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    begins = ends - np.array([len(w) for w in words], np.int64)
    numbers = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    following = count()
    for w, lo, hi in zip(words, begins, ends, strict=True):
        numbers[lo:hi] = np.fromiter(map(defaultdict(following.__next__).__getitem__, w), np.int64, len(w))
    start, length, period = find_runs(numbers, exponent, least)
    owner = np.searchsorted(ends, start, "right")
    borders = np.searchsorted(owner, np.arange(len(texts) + 1))
    depth = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth)[:-1] == 0
    collapsed = [
        b" ".join(w if a == b else compress(w, kept[lo:hi].tolist()))
        for w, lo, hi, a, b in zip(words, begins, ends, borders[:-1], borders[1:], strict=True)
    ]
    values = pa.StructArray.from_arrays([pa.array(x) for x in (start - begins[owner], length, period)], fields=list(_RUN))
    return ends - begins, pa.ListArray.from_arrays(pa.array(borders, pa.int32()), values), pa.array(collapsed, pa.binary()).cast(pa.string())


def runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start and period in words, by start and period) and the collapsed text of every row.

    The collapsed text keeps of each run its first period only: words joined by single spaces, without those that
    some run holds after its own first period.
    """
    if exponent < 3:
        raise ValueError("runs shorter than three periods are not found by recurring contexts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n_words, found, collapsed = _judged(texts, exponent, least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), found, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, _SCHEMA.format(doc_id=rows.schema["doc_id"].dataType.simpleString()))


def strongest(found: Column) -> Column:
    """The run with the greatest length in periods; ties: smallest start, then period; none: null."""
    return F.aggregate(found, F.get(found, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def listing(found: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents is made periodic from some word on.

    With h = crc32(decimal doc_id) and g = floor(h / 10): if h % 10 = 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A row without a doc_id stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", GAPS), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    planted = F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))
