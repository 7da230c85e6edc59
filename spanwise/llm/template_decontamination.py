"""Benchmark decontamination by template canonicalisation.

Words are runs of bytes outside white space, reduced to letters, digits and non-ASCII bytes. Numbers, names
(capitalised words inside a sentence) and units (after a number) become typed placeholders; the rest is
lower-cased, as is everything in lines without lower-case letters. Whether a capitalised word opens a sentence depends on
what stands before it, so one that opens a window is read both ways. Windows of WINDOW canonical words with at least LITERAL literal ones are hashed, those with fewer
by their very words (those of items and those in capitals also), and windows of the documents are joined with those of the benchmark by hash. For every document and item the matching
windows are put together by copy: windows at one distance between the places in document and item, up to
SHIFT words put in or left out. Inside a copy they have to agree on the slots: one item value always stands at
one document value, and the other way round, which also catches re-parameterised questions and separates them
from accidental templates. Copies do not mix; the best one counts.

A document is contaminated by an item when windows that agree cover at least COVER of the item's words (of those
in windows with enough literal words, if that is more) and WINDOW words (the whole of shorter items), or RUN words
in a row. So one changed word hides no item of 12 words or more; in one of 9 to 11 words it does unless WINDOW words
in a row are left. ``coverage`` is the covered share of the words. ``kind`` is ``verbatim`` when every slot holds the item's own value, else ``reparameterised``.

The benchmark's window hashes filter the documents inside the scan while there are at most FILTER_MAX of
them (counted first; 8 bytes each are broadcast); beyond that all windows go through the shuffled join. Both
ways give the same rows. An item shorter than WINDOW words is one window of all its words, looked for at
every place of every document. An item of one word is no evidence inside a text: it is found in texts of that word alone.

Defined results: null and empty texts match nothing; rows without an id are ignored on both sides; rows that
repeat an id count as one document (or item) that holds all of them; items with the same text are each
reported; empty input gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spanwise.llm.common import letter_codes, mix, owners, pieces, powers, text_bytes, words

WINDOW, LITERAL, COVER, RUN = 8, 5, 0.5, 13
FILTER_MAX = 4_000_000
SHIFT = 2

#: Words that measure, after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams ton tons lb lbs oz ounce ounces pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years percent dollar dollars cent cents euro euros usd eur mph kmh degree degrees watt watts kw volt volts hz"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's letters and digits, lower-cased; other bytes do not count (0 when none is left)."""
    solid = _SOLID[data]
    place = np.cumsum(solid) - solid
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(solid, letter_codes(True)[data] * down[place], np.uint64(0)), out=sums[1:])
    raw = (sums[end] - sums[start]) * up[place[start]]
    return np.where(raw == 0, raw, mix(raw))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, canonical hash and slot value (0 for a literal word) of every word of a batch."""
    return _readings(data, offsets)[:3]


def _readings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``canonical``; also the value of every word, can it be a name or a literal, and has it a lower-case letter."""
    start, end, _ = words(data, offsets)
    of = owners(offsets, start)
    value = np.zeros(len(start), np.uint64)
    small = np.zeros(len(start), bool)
    for lo, hi in pieces(data, offsets):
        i, j = np.searchsorted(start, (lo, hi))
        if i < j:
            value[i:j] = _hashes(data[lo:hi], start[i:j] - lo, end[i:j] - lo)
            lower = np.concatenate([[0], np.cumsum(_LOWER[data[lo:hi]], dtype=np.int32)])
            small[i:j] = lower[end[i:j] - lo] > lower[start[i:j] - lo]
    some = value != 0
    # A word of marks only closes a sentence if one of its marks does; then it is gone.
    closes = np.zeros(len(start), bool)
    if len(start):
        closes = _STOP[data[end - 1]] | (_STOP[data[start]] & ~some)
    opens = np.ones(len(start), bool)
    loud = np.zeros(len(start), bool)
    if len(start):
        line = np.searchsorted(np.flatnonzero(data == 10), start)
        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (line[1:] != line[:-1])])
        opens[1:] = fresh[1:] | closes[:-1]
        loud = ~np.logical_or.reduceat(small, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    first = data[start] if len(start) else np.zeros(0, np.uint8)
    after = data[np.minimum(start + 1, len(data) - 1)] if len(start) else first
    capital = _UPPER[first] | ((first == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    number = _DIGIT[first] | (~_SOLID[first] & _DIGIT[after] & (end - start > 1))
    either = capital & ~number & ~loud
    name = either & ~opens
    of, value, number, name, either, small = of[some], value[some], number[some], name[some], either[some], small[some]
    unit = np.zeros(len(of), bool)
    if len(of) > 1:
        known = np.sort(np.array([_word_hash(u) for u in UNITS], np.uint64))
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        unit[1:] = (known[at] == value)[1:] & number[:-1] & (of[1:] == of[:-1])
    token = np.select([number, unit, name], [NUMBER, UNIT, NAME], value).astype(np.uint64)
    return of, token, np.where(number | unit | name, value, np.uint64(0)), value, either & ~unit, small


def _own_width(n: np.ndarray, k: int, width: int) -> np.ndarray:
    """Which items of ``n`` words have windows of ``k`` words.

    One changed word leaves 12 to 15 words without enough whole windows; of the parts beside it, one holds ``width``
    words or both hold ``n - width``.
    """
    return (np.minimum(n, width) == k) | ((n >= width + width // 2) & (n < 2 * width) & (k == n - width))


def windows(data: np.ndarray, offsets: np.ndarray, width: int, widths: tuple[int, ...], own: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """For every width: text, words of the text, place, hash and slots (one row of values) of every window.

    Windows with LITERAL literal words are hashed by their canonical words, twice when the first word can be a name or
    a literal. Others, and also all windows below ``width``, of an item or without lower-case letters, are hashed by
    their very words, which are all slots then. ``own``: only the windows of an item.
    """
    of, token, slot, value, either, small = _readings(data, offsets)
    n = len(of)
    if not n:
        return
    first = np.searchsorted(of, np.arange(len(offsets)))
    place = np.arange(n) - first[of]
    size = (first[1:] - first[:-1])[of]
    literal = np.concatenate([[0], np.cumsum(slot == 0)])
    lower = np.concatenate([[0], np.cumsum(small)])
    two = np.flatnonzero(either)
    was = slot[two] == 0
    other = np.zeros(len(two), np.uint64)
    chained = own or min(widths) < width
    loose, exact = np.zeros(n, np.uint64), np.full(n, 1, np.uint64)
    for k in range(1, max(widths) + 1):
        starts = max(n - k + 1, 0)
        step = np.uint64(k)
        loose[:starts] = mix(loose[:starts] + token[k - 1 :] + step)
        other = mix(other + (np.where(was, NAME, value[two]) if k == 1 else token[np.minimum(two + k - 1, n - 1)]) + step)
        if chained:
            exact[:starts] = mix(exact[:starts] + value[k - 1 :] + step)
        if k not in widths:
            continue
        use = size - place >= k
        if own:
            use &= _own_width(size, k, width)
        at = np.flatnonzero(use)
        enough = literal[at + k] - literal[at] >= LITERAL
        by_words = at if own or k < width else at[~enough | (lower[at + k] == lower[at])]
        for some, key, words_ in ((at[enough], loose, slot), (by_words, exact, value)):
            if not len(some):
                continue
            keys = key[some]
            if key is exact and not chained:
                # Few windows are short of literal words, so theirs are hashed alone.
                keys = np.full(len(some), 1, np.uint64)
                for j in range(k):
                    keys = mix(keys + value[some + j] + np.uint64(j + 1))
            yield of[some], size[some], place[some], keys, words_[some[:, None] + np.arange(k)]
        fits = use[two]
        fits[fits] = literal[two[fits] + k] - literal[two[fits]] + np.where(was[fits], -1, 1) >= LITERAL
        some = two[fits]
        if len(some):
            slots = slot[some[:, None] + np.arange(k)]
            slots[:, 0] = np.where(was[fits], value[some], np.uint64(0))
            yield of[some], size[some], place[some], other[fits], slots


def _window_rows(frame: DataFrame, name: str, width: int, widths: tuple[int, ...], own: bool, wanted=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            part_of = batch.column("part")
            for of, size, place, key, slots in windows(*text_bytes(batch.column("text")), width, widths, own):
                if known is not None:
                    at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                    hit = known[at] == key if len(known) else np.zeros(len(key), bool)
                    of, size, place, key, slots = of[hit], size[hit], place[hit], key[hit], slots[hit]
                for k in range(0, len(of), 50_000):
                    part = slice(k, k + 50_000)
                    rows = pa.array(of[part])
                    listed = pa.FixedSizeListArray.from_arrays(pa.array(slots[part].view(np.int64).ravel()), slots.shape[1]).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(name).take(rows), part_of.take(rows), pa.array(size[part].astype(np.int64)), pa.array(place[part].astype(np.int64)), pa.array(key[part].view(np.int64)), listed],
                        [name, "part", "size", "place", "key", "slots"],
                    )

    rows = frame.where(F.col(name).isNotNull()).select(name, F.xxhash64("text").alias("part"), "text")
    return rows.mapInArrow(run, f"{name} {dict(frame.dtypes)[name]}, part bigint, size bigint, place bigint, key bigint, slots array<bigint>")


def _consistent(rows: list[tuple]) -> list[tuple]:
    """The windows of one copy whose slots agree: one item value always stands at one document value, and back."""
    votes: Counter = Counter()
    for _, _, slots, item_slots in rows:
        votes.update({(v, w) for v, w in zip(slots, item_slots, strict=True) if v})
    best: dict[int, tuple] = {}
    for (v, w), c in votes.items():
        best[v] = max(best.get(v, (0, False, 0)), (c, v == w, w))
    top: dict[int, tuple] = {}
    for v, (c, same, w) in best.items():
        top[w] = max(top.get(w, (0, False, 0)), (c, same, v))
    agreed = {v: w for w, (_, _, v) in top.items()}
    return [r for r in rows if all(not v or agreed.get(v) == w for v, w in zip(r[2], r[3], strict=True))]


def _covered(starts_ends: Iterable[tuple[int, int]]) -> tuple[int, int]:
    """Words in the union of ranges, and in its longest stretch."""
    total, longest, lo, hi = 0, 0, 0, 0
    for a, b in sorted(starts_ends):
        if a > hi:
            total, longest, lo, hi = total + hi - lo, max(longest, hi - lo), a, b
        hi = max(hi, b)
    return total + hi - lo, max(longest, hi - lo)


def best_copy(rows: list[tuple]) -> tuple[int, int, int, int, bool]:
    """Words of the item covered in its best copy, those covered by windows with enough literal words, the longest run
    of consecutive words in any copy, the windows, and are all slots the item's own.

    ``rows``: places in a document and an item, and slots of both, of all windows that one text shares with an item's.
    A copy is what lies at one distance between the places, give or take SHIFT words put in or left out.
    """
    by_distance: dict[int, list] = defaultdict(list)
    for row in rows:
        by_distance[row[0] - row[1]].append(row)
    best, run = (0, 0, 0, False), 0
    for d in by_distance:
        copy = _consistent([r for k in range(SHIFT + 1) for r in by_distance.get(d + k, ())])
        held = [(r[1], r[1] + len(r[3])) for r in copy]
        loose = [x for x, r in zip(held, copy, strict=True) if 0 in r[3]]
        best = max(best, (_covered(held)[0], _covered(loose)[0], len(set(held)), all(r[2] == r[3] for r in copy)))
        run = max(run, _covered([x for x, r in zip(held, copy, strict=True) if r[0] - r[1] == d])[1])
    words_, loose_words, n_windows, same = best
    return words_, loose_words, run, n_windows, same


def _copies(both: DataFrame) -> DataFrame:
    """Windows in the best copy of each item text in each document text."""
    pair = ["doc_id", "item_id", "item_part", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged() -> Iterator[tuple]:
            for key, group in groupby(flat(), key=itemgetter(0)):
                yield (*key, *best_copy([r for _, r in group]))

        def flat() -> Iterator[tuple]:
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in pair), strict=True)
                values = zip(*(batch.column(c).to_pylist() for c in ("place", "item_place", "slots", "item_slots")), strict=True)
                yield from zip(keys, values, strict=True)

        found = judged()
        while some := list(islice(found, 10_000)):
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    kinds = dict(both.dtypes)
    text = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, item_part bigint, part bigint, n_words bigint, n_loose bigint, run bigint, n_windows bigint, same boolean"
    schema = to_arrow_schema(both.sparkSession.createDataFrame([], text).schema)
    return both.repartition(*pair).sortWithinPartitions(*pair).select(*pair, "place", "item_place", "slots", "item_slots").mapInArrow(run, text)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, cover: float = COVER, run_of: int = RUN, filter_max: int = FILTER_MAX) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, coverage and kind of every contaminated pair."""
    spark = docs.sparkSession
    if width < LITERAL:
        raise ValueError("windows must hold the literal words asked for")
    windowed = _window_rows(benchmark, "item_id", width, tuple(range(1, width + 1)), True)
    items = windowed.select("item_id", F.col("part").alias("item_part"), F.col("place").alias("item_place"), "key", F.col("slots").alias("item_slots")).distinct()
    widths = tuple(sorted(r["k"] for r in items.select(F.size("item_slots").alias("k")).distinct().collect())) or (width,)
    hashes = items.select("key").distinct()
    wanted = None
    if hashes.limit(filter_max + 1).count() <= filter_max:
        wanted = spark.sparkContext.broadcast(np.sort(hashes.toPandas()["key"].to_numpy(np.int64).view(np.uint64)))
    found = _window_rows(docs, "doc_id", width, widths, False, wanted).select("doc_id", "part", "size", "place", "key", "slots")
    # Windows of one word are those of items of one word.
    copies = _copies(found.join(items, "key").where((F.size("item_slots") > 1) | (F.col("size") == 1)))
    # Of the texts of one document the best copy counts; the texts of one item add up.
    best = copies.groupBy("doc_id", "item_id", "item_part").agg(F.max(F.struct("n_words", "n_loose", "n_windows", "same")).alias("best"), F.max("run").alias("run"))
    sums = [F.sum(f"best.{c}").alias(c) for c in ("n_words", "n_loose", "n_windows")]
    counted = best.groupBy("doc_id", "item_id").agg(*sums, F.max("run").alias("run"), F.min("best.same").alias("same"))
    place = F.explode(F.sequence("item_place", F.col("item_place") + F.size("item_slots") - 1)).alias("word")
    each = items.select("item_id", "item_part", F.array_contains("item_slots", 0).alias("loose"), place).groupBy("item_id", "item_part", "word").agg(F.max("loose").alias("loose"))
    item_words = each.groupBy("item_id").agg(F.count("*").alias("item_words"), F.count_if("loose").alias("loose_words"))
    sizes = items.select("item_id", "item_part", "item_place", F.size("item_slots")).distinct().groupBy("item_id").agg(F.count("*").alias("item_windows")).join(item_words, "item_id")
    # A re-parameterised copy cannot hold the words that only windows of few literal words cover.
    coverage = F.greatest(F.col("n_words") / F.col("item_words"), F.try_divide("n_loose", "loose_words"))
    enough = (F.col("coverage") >= cover) & (F.col("n_words") >= F.least("item_words", F.lit(width)))
    return (
        counted.join(sizes, "item_id").withColumn("coverage", coverage).where(enough | (F.col("run") >= run_of))
        .select("doc_id", "item_id", "n_windows", "item_windows", "coverage", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"))
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, all columns unchanged; rows without an id stay."""
    bad = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
