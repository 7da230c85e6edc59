"""Removal of byte strings that also start earlier in the corpus, by external induced suffix sorting.

A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller
doc_id, or further left in the same one. Strings never cross documents and are judged on the input.

The corpus is cut into shards that hold every pair of equal strings, and only what can be equal is sorted:

1. Every LENGTH-byte window is owned by its smallest hashed ANCHOR-byte substring, so equal windows have the
   same anchor at the same place. Windows in a row with one anchor form a *phrase*, their bytes a context.
2. Phrases are dealt by anchor. Phrases with equal contexts are one dictionary entry: the first stays, the
   others repeat it wholly. This happens inside each batch first, so a passage that a third of the corpus
   shares reaches its shard once per batch and not once per copy. Anchors with one entry need nothing more.
3. The remaining dictionary entries of a shard are fetched and all their suffixes are sorted by external
   induced sorting (``induced_sort``); runs of suffixes whose common prefix reaches LENGTH are equal windows,
   and all but the first of a run repeat it.
4. An anchor with more contexts than fit a quarter of a shard (a line shorter than LENGTH between ever other
   neighbours) is dealt on: each window of its contexts goes by its own hashes, and the first of equal ones stays.

Contexts and windows count as equal when two independent 64-bit hashes agree. Shards hold about SHARD bytes of
text and no anchor weighs more than a quarter of that. The sorter spills its text and queues, but keeps types
and places of a shard in memory, at tens of bytes a symbol: a shard has to fit in memory, the corpus has not.

Defined results: a null or empty text has no bytes and none removed; rows without a doc_id come before all
others; rows that repeat a doc_id with the same text count as one document and come back each, with other
texts they are documents at the same place (neither is earlier at equal offsets; ties go to the smaller crc32);
empty input gives no rows; columns other than doc_id and text are not read by ``spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import PIECE, letter_codes, mix, owners, powers, runs, text_bytes
from spanwise.llm.induced_sort import CAP, suffix_order
from spanwise.session import keep

LENGTH, ANCHOR = 100, 32
SHARD = 8 << 20
NO_ID = -(1 << 63)
PHRASE = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("tie", "<u4"), ("size", "<u4")])
_PLACE = np.uint64((1 << 20) - 1)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of bytes, anchor hash and context hash of every phrase of a batch of texts."""
    codes, total = letter_codes(False), len(data)
    reach = length - anchor + 1
    found: tuple[list, ...] = ([], [], [], [])
    step = PIECE - 2 * length
    for lo in range(0, max(0, total - length + 1), step):
        hi = min(lo + step, total - length + 1)
        part = data[lo : hi + length - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * down[: len(part)], out=sums[1:])
        grams = mix((sums[anchor:] - sums[:-anchor]) * up[: len(part) - anchor + 1])
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width < reach:
            more = min(width, reach - width)
            least = np.minimum(least[: len(least) - more], least[more:])
            width += more
        owner = (least & _PLACE).astype(np.int64)
        inside = np.ones(hi - lo, bool)
        for end in offsets[1:][(offsets[1:] > lo) & (offsets[1:] < hi + length - 1)] - lo:
            inside[max(0, end - length + 1) : end] = False
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1])
        s, e = np.flatnonzero(first), np.flatnonzero(last) + length
        context = mix((sums[e] - sums[s]) * up[s] + (owner[s] - s).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + (e - s).astype(np.uint64))
        for kept, new in zip(found, (s + lo, e - s, grams[owner[s]], context), strict=True):
            kept.append(new)
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in found)


def _key(docs: DataFrame) -> DataFrame:
    """doc (doc_id, the smallest long for none), tie (crc32 of the text) and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.crc32(text.cast("binary")).alias("tie"), text.alias("text"))


def _first_of_each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (h, c, doc, at, tie), and which of them is the first of its (h, c)."""
    rows = rows[np.lexsort((rows["tie"], rows["at"], rows["doc"], rows["c"], rows["h"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    return rows, new


def _repeats(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows that repeat the first of their entry (an equal row of a repeated document does not repeat itself)."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    same = (rows["doc"] == rows["doc"][head]) & (rows["at"] == rows["at"][head])
    return rows[~new & ~same]


def _merged(rows: np.ndarray) -> np.ndarray:
    """Overlapping or touching phrases of one document as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["at"], rows["tie"], rows["doc"]))]
    end = rows["at"].astype(np.int64) + rows["size"]
    cut = np.ones(len(rows), bool)
    cut[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1])
    group = np.cumsum(cut) - 1
    # Ends grow with starts inside a document only after a running maximum.
    high = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
    cut[1:] |= rows["at"][1:] > high[:-1]
    at = np.flatnonzero(cut)
    out = rows[at].copy()
    out["size"] = np.maximum.reduceat(high, at) - rows["at"][at]
    return out


def _interval_batch(rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(rows[c].astype(np.int64)) for c in ("doc", "tie", "at", "size")]


def _dealt(docs: DataFrame, shards: int, length: int, anchor: int) -> DataFrame:
    """Phrases in blocks per shard; what repeats inside a batch is a block of shard -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            start, size, h, c = phrases(data, offsets, length, anchor)
            of = owners(offsets, start)
            rows = np.zeros(len(start), PHRASE)
            rows["h"], rows["c"], rows["size"] = h, c, size
            rows["doc"], rows["tie"] = batch.column("doc").to_numpy()[of], batch.column("tie").to_numpy()[of]
            rows["at"] = start - offsets[of]
            rows, new = _first_of_each(rows)
            again = _merged(_repeats(rows, new))
            rows = rows[new]
            shard = (rows["h"] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            rows, shard = rows[order], shard[order]
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            blocks = np.split(rows, cuts) if len(rows) else []
            names = [int(shard[k]) for k in [0, *cuts]] if len(rows) else []
            if len(again):
                blocks.append(again)
                names.append(-1 - int(rows["h"][0] % np.uint64(shards)))
            for k in range(0, len(blocks), 256):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 256], pa.int64()), pa.array([b.tobytes() for b in blocks[k : k + 256]], pa.binary())], ["shard", "block"])

    return _key(docs).mapInArrow(run, "shard bigint, block binary")


def _resolved(dealt: DataFrame) -> DataFrame:
    """Repeating phrases (h null) and, for anchors with several entries, the first phrase of each entry (h set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("shard",)):
            rows = np.frombuffer(b"".join(group.column("block").to_pylist()), PHRASE)
            local = group.column("shard")[0].as_py() < 0
            if local:
                again, open_ = rows, rows[:0]
            else:
                rows, new = _first_of_each(rows)
                again = _repeats(rows, new)
                firsts = rows[new]
                several = np.zeros(len(firsts), bool)
                same = firsts["h"][1:] == firsts["h"][:-1]
                several[1:] |= same
                several[:-1] |= same
                open_ = firsts[several]
            for part, open_part in ((again, False), (open_, True)):
                for k in range(0, len(part), 100_000):
                    some = part[k : k + 100_000]
                    h = pa.array(some["h"].view(np.int64)) if open_part else pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([*_interval_batch(some), h], ["doc", "tie", "at", "size", "h"])

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "doc bigint, tie bigint, at bigint, size bigint, h bigint")


def _contexts(open_: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """The bytes of the phrases left open, with their shard; rows that repeat a document ask once."""
    asked = open_.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "size", "h")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            asked = batch.column("asked")
            bounds = asked.offsets.to_numpy() - asked.offsets[0].as_py()
            flat = asked.flatten()
            at, size, h = (flat.field(c).to_numpy() for c in ("at", "size", "h"))
            of = np.repeat(np.arange(len(batch)), np.diff(bounds))
            begin = offsets[of] + at
            shard = (h.view(np.uint64) % np.uint64(shards)).astype(np.int64)
            for k in range(0, len(of), 20_000):
                part = slice(k, k + 20_000)
                cut = [raw[b : b + n] for b, n in zip(begin[part].tolist(), size[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[part]), batch.column("doc").take(pa.array(of[part])), batch.column("tie").take(pa.array(of[part])), pa.array(at[part]), pa.array(cut, pa.binary())],
                    ["shard", "doc", "tie", "at", "context"],
                )

    return _key(docs).join(asked, ["doc", "tie"]).dropDuplicates(["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(run, "shard bigint, doc bigint, tie bigint, at bigint, context binary")


def repeated_windows(contexts: list[bytes], length: int = LENGTH, memory: int = 1 << 22) -> np.ndarray:
    """For contexts in corpus order: which windows (start in the joined, separated text) also start earlier.

    Returns (context, start) pairs of windows of ``length`` bytes.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    place = np.arange(len(joined)) + np.repeat(np.arange(len(contexts)), sizes)
    text = np.zeros(len(joined) + len(contexts), np.uint16)
    text[place] = joined.astype(np.uint16) + 1
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    order, shared = suffix_order(text, memory, cap=max(CAP, length))
    linked = shared >= length
    run = np.cumsum(~linked)
    again = linked.copy()
    again[:-1] |= linked[1:]
    at = np.flatnonzero(again)
    order, run = order[at], run[at]
    by = np.lexsort((order, run))
    order, run = order[by], run[by]
    later = np.zeros(len(order), bool)
    later[1:] = run[1:] == run[:-1]
    starts = np.sort(order[later])
    of = np.searchsorted(first, starts, "right") - 1
    return np.column_stack([of, starts - first[of]])


def _sorted_shards(contexts: DataFrame, length: int, memory: int) -> DataFrame:
    """Intervals that repeat earlier windows, from the suffix order of each shard's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("shard",)):
            group = group.combine_chunks()
            doc, tie, at = (group.column(c).to_numpy() for c in ("doc", "tie", "at"))
            found = repeated_windows(group.column("context").to_pylist(), length, memory)
            if not len(found):
                continue
            rows = np.zeros(len(found), PHRASE)
            of = found[:, 0]
            rows["doc"], rows["tie"], rows["at"], rows["size"] = doc[of], tie[of], at[of] + found[:, 1], length
            rows = _merged(rows)
            for k in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays(_interval_batch(rows[k : k + 100_000]), ["doc", "tie", "at", "size"])

    ordered = contexts.repartition("shard").sortWithinPartitions("shard", "doc", "at", "tie")
    return ordered.mapInArrow(run, "doc bigint, tie bigint, at bigint, size bigint")


def _hashed(contexts: DataFrame, length: int) -> DataFrame:
    """Intervals that repeat earlier windows, from two 64-bit hashes of every window of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letter_codes(False)
        for batch in batches:
            for lo in range(0, len(batch), 5_000):
                part = batch.slice(lo, 5_000)
                data, offsets = text_bytes(part.column("context").cast(pa.large_binary()).cast(pa.binary()))
                sizes = np.diff(offsets) - length + 1
                of = np.repeat(np.arange(len(part)), sizes)
                inside = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                start = offsets[of] + inside
                up, down = powers(len(data) + 1)
                keys = []
                for table in (codes, mix(codes)):
                    sums = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum(table[data] * down[: len(data)], out=sums[1:])
                    keys.append(pa.array(mix((sums[start + length] - sums[start]) * up[start]).view(np.int64)))
                rows = pa.array(of)
                at = part.column("at").to_numpy()[of] + inside
                yield pa.RecordBatch.from_arrays([*keys, part.column("doc").take(rows), pa.array(at), part.column("tie").take(rows)], ["h", "c", "doc", "at", "tie"])

    windows = contexts.select("doc", "tie", "at", "context").mapInArrow(run, "h bigint, c bigint, doc bigint, at bigint, tie bigint")
    own = F.struct("doc", "at", "tie")
    first = windows.groupBy("h", "c").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(first, ["h", "c"]).where(own != F.col("first")).select("doc", "tie", "at", F.lit(length).cast("bigint").alias("size"))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD, memory: int = 1 << 22) -> DataFrame:
    """doc, tie and the intervals (at, size) of bytes to remove, one row per document that has any."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    found = keep(_resolved(_dealt(docs, shards, length, anchor)), "suffix-phrases")
    open_, settled = found.where("h is not null"), found.where("h is null").select("doc", "tie", "at", "size")
    most = max(1, shard_bytes // (4 * (2 * length - anchor)))
    hot = keep(open_.groupBy("h").count().where(F.col("count") > most).select("h"), "suffix-hot")
    if not hot.isEmpty():
        settled = settled.unionByName(_hashed(keep(_contexts(open_.join(hot, "h", "left_semi"), docs, shards), "suffix-hot-contexts"), length))
        open_ = open_.join(hot, "h", "left_anti")
    sorted_ = keep(_sorted_shards(_contexts(open_, docs, shards), length, memory), "suffix-intervals")
    every = settled.unionByName(sorted_)
    return every.groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "size")).alias("gone"))


def _cut(raw: bytes, gone: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and what is left."""
    spans: list[list[int]] = []
    for at, size in sorted(gone):
        if spans and at <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], at + size)
        else:
            spans.append([at, at + size])
    left, at = [], 0
    for a, b in spans:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return [(a, b) for a, b in spans], b"".join(left)


def _with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Every row of ``docs`` as one struct ``row``, whatever its columns are called, and what is gone from its text."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.crc32(text.cast("binary")).alias("tie"),
    )
    return keyed.join(gone.select("doc", "tie", "gone"), ["doc", "tie"], "left")


def _pairs(gone: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(x["at"], x["size"]) for x in own] if own else [] for own in gone.to_pylist()]


def spans(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for a, b, own in zip(offsets[:-1], offsets[1:], _pairs(batch.column("gone")), strict=True):
                found, left = _cut(raw[a:b], own)
                for kept, value in zip(rows, (b - a, b - a - len(left), len(found), hashlib.sha256(left).hexdigest(), [x for s in found for x in s]), strict=True):
                    kept.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"
    return _with_gone(docs.select("doc_id", "text"), gone).select("row.doc_id", "row.text", "gone").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The same rows and columns with the text that is left (bytes of a character cut in two go as well).

    A text that is null stays null; n_chars, where present, is the length of the new text.
    """

    @F.arrow_udf("string")
    def left(text: pa.Array, gone: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        raw = data.tobytes()
        return pa.array([_cut(raw[a:b], own)[1].decode("utf-8", "ignore") for a, b, own in zip(offsets[:-1], offsets[1:], _pairs(gone), strict=True)], pa.string())

    whole = F.col("gone").isNull()
    out = _with_gone(docs, gone).withColumn("left", left("row.text", "gone"))
    changed = {"text": F.when(whole, F.col("row.text")).otherwise(F.col("left"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.char_length("left").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
