"""Phrases whose words keep together: counts from depth-truncated suffix subtrees, built group by group.

Text is cut into pieces at marks and line ends, pieces into words, A-Z lower-cased; every language is on its own.

1. *Coding.* Text is tokenised once, in chunks of some megabytes: the distinct words with their counts, and the
   sequence as numbers into them. The counts give the vocabulary; a chunk's distinct words (not its text) are looked
   up among the frequent ones, sent to the tasks where they are counted to be few bytes and joined else, and the
   sequence is rewritten in their numbers. Words below the least count become 0, as
   piece ends do: no phrase that counts holds them.
2. *Vertical partitioning.* Every position is a suffix, cut at ``DEPTH`` words or the next 0. Suffixes are grouped by
   their first word. A prefix with more than an eighth of a group's budget is extended by its next word, and
   again, until each part is smaller or the whole suffix is the prefix; the counts of extended prefixes are exact
   and known from then on. Prefixes are dealt by hash into twice as many groups as budgets are needed.
3. *Subtrees.* Equal suffixes of a chunk are sent once with their number, so a passage of any frequency is one leaf
   per chunk. A group's suffixes are sorted; the subtree's inner nodes are the places where neighbours part
   at each depth, and a node's count is the total of the leaves below it. No group needs another.
4. *Scores.* Counts of a candidate's first and last parts are joined to it for each cut. A candidate with a longer one
   of the same count around it has one of the next length, so only that length is looked up.

Sizes: a group is held as a whole and bounded by ``budget`` suffixes (24 bytes each, some ten times that while sorting).
The lists of extended prefixes go to every task. They are counted first: where more than ``PREFIXES`` of one
length (8 bytes each) pass an eighth of the budget, the bound and with it the budget are doubled until they fit. Memory of coding follows the batch and its
distinct words, or one text where it is longer (a few times its bytes: it is split into words block by block). Written tables and shuffles follow the input.

Defined results: a null or empty text has no words; a null language is ``und`` (and one with those that are named
so); rows without a doc_id and repeated rows count like others; ties in score and count are ordered by the phrase's UTF-8
bytes; no candidate gives no rows; other columns are not read. Very long texts are read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.llm.common import let_go, mix, runs
from spanwise.llm.source_mix import numbered
from spanwise.session import run_folder

DEPTH, LEAST, PERCENT, TOP = 5, 100, 100, 2000
BUDGET = 4_000_000
PREFIXES = 4_000_000
#: Bytes of text that share a list of distinct words, positions that are dealt together, and bytes split into words at once.
CODED, CHUNK, BLOCK = 32 << 20, 1_000_000, 1 << 20
#: Bytes of vocabulary up to which it is sent to every task.
SHIPPED = 32 << 20
#: Suffixes (24 bytes each) after which a batch of dealt groups is handed on.
SENT = 200_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n \n\n\n\n")


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = run_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text in parts of about BLOCK bytes that start at the space or line end after one."""
    at = 0
    while len(text) - at > BLOCK:
        space = text.find(b" ", at + BLOCK)
        line = text.find(b"\n", at + BLOCK, space if space >= 0 else len(text))
        stop = max(space, line) if min(space, line) < 0 else line
        if stop < 0:
            break
        yield text[at:stop]
        at = stop
    yield text[at:]


def coded(docs: DataFrame) -> DataFrame:
    """One row per chunk of text and language: its distinct words, their counts, and the words in sequence as places from 1 (0: a cut)."""

    def flushed(places: dict[str, dict], codes: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, own in places.items():
            sequence = np.concatenate(codes[lang])
            if len(own) > 1:
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang], "words": pa.array([[w.decode() for w in own][1:]], pa.list_(pa.string())),
                    "counts": pa.array([np.bincount(sequence)[1:]], pa.list_(pa.int64())), "codes": pa.array([sequence.tobytes()], pa.binary()),
                })

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, codes, size = {}, defaultdict(list), 0
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    by_lang[lang].append(text)
                    size += len(text)
            for lang, texts in by_lang.items():
                if lang not in places:
                    places[lang] = defaultdict(count(1).__next__)
                    places[lang][b"\n"] = 0
                for part in _blocks(b"\n".join([b"", *texts]).translate(_FOLD)):
                    tokens = filter(None, part.replace(b"\n", b" \n ").split(b" "))
                    codes[lang].append(np.fromiter(map(places[lang].__getitem__, tokens), np.uint32))
            if size >= CODED:
                yield from flushed(places, codes)
                places, codes, size = {}, defaultdict(list), 0
        yield from flushed(places, codes)
        places, codes = {}, {}
        let_go()

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(code, "lang string, words array<string>, counts array<long>, codes binary")
    return _written(rows.withColumn("chunk", F.monotonically_increasing_id()), "phrase-coded")


def _recoded(codes: pa.Scalar, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in _between_cuts(table[np.frombuffer(codes.as_buffer(), np.uint32)]):
        yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], ["words"])


def sequences(batches: DataFrame, vocabulary: DataFrame, shipped: int = SHIPPED) -> DataFrame:
    """The coded sequences in numbers of the vocabulary, as unsigned 32-bit integers.

    A vocabulary measured to be of at most ``shipped`` bytes goes to every task; a larger one is joined with the chunks'
    words. The sequences are the same.
    """
    size = vocabulary.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    frame = _by_lookup(batches, vocabulary) if size <= shipped else _by_join(batches, vocabulary)
    return _written(frame, "phrase-words")


def _by_lookup(batches: DataFrame, vocabulary: DataFrame) -> DataFrame:
    known = vocabulary.select("lang", "word", "id").toArrow().combine_chunks()
    by_lang = {lang: known.filter(pc.equal(known["lang"], lang)) for lang in pc.unique(known["lang"]).to_pylist()}
    shared = batches.sparkSession.sparkContext.broadcast({lang: (t["word"].combine_chunks(), t["id"].to_numpy()) for lang, t in by_lang.items()})

    def recode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lang, words, codes in zip(*(batch.column(c) for c in ("lang", "words", "codes")), strict=True):
                if lang.as_py() in shared.value:
                    names, ids = shared.value[lang.as_py()]
                    at = pc.index_in(words.values, names.cast(words.values.type)).fill_null(-1).to_numpy()
                    table = np.zeros(len(at) + 1, np.uint32)
                    table[1:] = np.where(at >= 0, ids[at], 0)
                    yield from _recoded(codes, table)
        let_go()

    return batches.select("lang", "words", "codes").mapInArrow(recode, "words binary")


def _by_join(batches: DataFrame, vocabulary: DataFrame) -> DataFrame:
    def recode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for codes, size, places, ids in zip(*(batch.column(c) for c in ("codes", "size", "places", "ids")), strict=True):
                table = np.zeros(size.as_py() + 1, np.uint32)
                table[places.values.to_numpy()] = ids.values.to_numpy()
                yield from _recoded(codes, table)
        let_go()

    words = batches.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    known = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(
        F.collect_list(F.struct((F.col("place") + 1).alias("place"), "id")).alias("k")
    )
    joined = batches.select("chunk", "codes", F.size("words").alias("size")).join(known, "chunk")
    return joined.select("codes", "size", F.col("k.place").alias("places"), F.col("k.id").alias("ids")).mapInArrow(recode, "words binary")


def _between_cuts(words: np.ndarray) -> Iterator[np.ndarray]:
    """A sequence in parts of about CHUNK positions, each but the last ending with a 0."""
    at = 0
    while len(words) - at > CHUNK:
        zeros = np.flatnonzero(words[at : at + CHUNK] == 0)
        if not len(zeros):
            zeros = CHUNK + np.flatnonzero(words[at + CHUNK :] == 0)[:1]
        stop = at + int(zeros[-1]) + 1 if len(zeros) else len(words)
        yield words[at:stop]
        at = stop
    yield words[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The sequences of a task, about CHUNK positions at a time, with a cut between any two."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column("words"):
            for words in _between_cuts(np.frombuffer(value.as_buffer(), np.uint32)):
                if size + len(words) > CHUNK and held:
                    yield np.concatenate(held)
                    held, size = [], 0
                held += [words, np.zeros(1, np.uint32)]
                size += len(words) + 1
    if held:
        yield np.concatenate(held)


def suffixes(words: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """The distinct suffixes of at least two words, cut at ``depth`` words or before a 0, as columns, and their numbers."""
    padded = np.concatenate([words, np.zeros(depth, np.uint32)])
    columns = [words]
    for d in range(1, depth):
        columns.append(np.where(columns[-1] != 0, padded[d : d + len(words)], np.uint32(0)))
    some = np.flatnonzero(columns[1])
    columns = [c[some] for c in columns]
    key = np.zeros(len(some), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(3) + c)
    order = np.argsort(key, kind="stable")
    columns = [c[order] for c in columns]
    # Neighbours are compared word by word, so suffixes that only share a hash stay apart.
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [*(c[first] for c in columns), np.diff(np.append(first, len(order))).astype(np.uint32)]


def packed(table: np.ndarray) -> bytes:
    """A table of 32-bit numbers, its rows split into planes of equal bytes and compressed."""
    rows, n = table.shape
    planes = np.ascontiguousarray(table).view(np.uint8).reshape(rows, n, 4).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: pa.Buffer | bytes, rows: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * rows * n, "zstd"), np.uint8).reshape(rows, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32).reshape(rows, n)


def _looked_up(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is not in there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    place = np.searchsorted(table, keys)
    place[place == len(table)] = 0
    return np.where(table[place] == keys, place, -1)


def split_depth(columns: list[np.ndarray], extended: list[np.ndarray]) -> np.ndarray:
    """How many words of each suffix tell its part: one more than the words of its longest extended prefix.

    ``extended[d]`` is the sorted list of extended prefixes of d + 1 words: the first word, or the place of the prefix
    one shorter in its list (upper half) with the next word (lower half).
    """
    depth = np.ones(len(columns[0]), np.int64)
    place, rows = None, np.arange(len(columns[0]))
    for d, table in enumerate(extended):
        key = columns[d][rows].astype(np.uint64)
        if place is not None:
            key |= place.astype(np.uint64) << np.uint64(32)
        place = _looked_up(key, table)
        hit = place >= 0
        rows, place = rows[hit], place[hit]
        depth[rows] = d + 2
    return depth


def _passing(counted: DataFrame, above: int) -> tuple[DataFrame, int, int]:
    """The rows with f above a bound that rises until no more than PREFIXES are left, their number, and the bound."""
    counted = counted.where(F.col("f") > above)
    while (n := counted.count()) > PREFIXES:
        above *= 2
        counted = counted.where(F.col("f") > above)
    return counted, n, above


def _extend(words: DataFrame, vocabulary: DataFrame, above: int, depth: int) -> tuple[list[np.ndarray], DataFrame, int]:
    """Lists of the prefixes to extend (see split_depth), a table (ids, f) of those of two and more words, and the bound they pass."""
    spark = words.sparkSession
    known = spark.createDataFrame([], "ids array<long>, f long")
    hot, _, reached = _passing(vocabulary.select(F.col("id").alias("key"), "f"), above)
    extended = [np.sort(hot.select("key").toArrow().column("key").to_numpy()).astype(np.uint64)]
    while len(extended) < depth - 1 and len(extended[-1]):
        level = len(extended)
        shared = spark.sparkContext.broadcast(extended)

        def longer(batches: Iterator[pa.RecordBatch], shared=shared, level=level) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches):
                padded = np.concatenate([chunk, np.zeros(level, np.uint32)])
                rows, place = np.arange(len(chunk)), None
                for d in range(level):
                    key = padded[rows + d].astype(np.uint64)
                    if place is not None:
                        key |= place.astype(np.uint64) << np.uint64(32)
                    place = _looked_up(key, shared.value[d])
                    rows, place = rows[place >= 0], place[place >= 0]
                # A phrase is no more frequent than the one that lacks its first word.
                both = np.flatnonzero(np.diff(rows) == 1)
                keys = place[both].astype(np.uint64) << np.uint64(32) | padded[rows[both] + level]
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "f"])

        def named(batches: Iterator[pa.RecordBatch], shared=shared, level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, columns = batch.column("key").to_numpy().astype(np.uint64), []
                for d in range(level - 1, -1, -1):
                    columns.append(key & np.uint64(0xFFFFFFFF))
                    key = shared.value[d][(key >> np.uint64(32)).astype(np.int64)]
                ids = np.stack([key, *reversed(columns)], axis=1).astype(np.int64)
                offsets = np.arange(0, ids.size + 1, level + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.ravel())), batch.column("f")], ["ids", "f"])

        counted = words.mapInArrow(longer, "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") > above)
        found, _, bound = _passing(_written(counted, "phrase-prefixes"), above)
        known = known.unionByName(found.mapInArrow(named, "ids array<long>, f long"))
        extended = [*extended, np.sort(found.select("key").toArrow().column("key").to_numpy()).astype(np.uint64)]
        reached = max(reached, bound)
    return extended, known, reached


def subtree(columns: list[np.ndarray], numbers: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth, first leaves and counts of the nodes of two and more words over sorted leaves that reach the least count."""
    new = np.zeros(len(numbers), bool)
    new[:1] = True
    for depth, c in enumerate(columns, 1):
        new[1:] |= c[1:] != c[:-1]
        if depth > 1 and len(numbers):
            first = np.flatnonzero(new)
            total = np.add.reduceat(numbers, first)
            good = (total >= least) & (c[first] != 0)
            yield depth, first[good], total[good]


def frequent(words: DataFrame, vocabulary: DataFrame, positions: int, least: int = LEAST, depth: int = DEPTH, budget: int = BUDGET) -> DataFrame:
    """ids and f of every phrase of one to ``depth`` words with f >= least."""
    extended, known, above = _extend(words, vocabulary, max(budget // 8, least), depth)
    groups = max(1, -(-2 * positions // max(budget, 8 * above)))
    shared = words.sparkSession.sparkContext.broadcast(extended)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            *columns, numbers = suffixes(chunk, depth)
            part = split_depth(columns, shared.value)
            key = np.zeros(len(numbers), np.uint64)
            for d, c in enumerate(columns):
                key = np.where(part > d, mix(key * np.uint64(3) + c), key)
            # A suffix that ends with an extended prefix adds nothing to what is known.
            alive = np.choose(np.minimum(part, depth) - 1, columns) != 0
            group = np.where(alive, (key % np.uint64(groups)).astype(np.int64), groups)
            # Sorted leaves pack well: neighbours share their first words.
            order = np.lexsort((*columns[::-1], group))[: int(alive.sum())]
            group = group[order]
            table = np.empty((depth + 1, len(order)), np.uint32)
            for row, c in zip(table, (*columns, numbers), strict=True):
                np.take(c, order, out=row)
            del columns, numbers, part, key, alive, order
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            ends = np.append(starts[1:], len(group))[: len(starts)]
            # A batch ends with the group that fills it.
            for some in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(ends // SENT)) + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[starts[some]]), pa.array(ends[some] - starts[some]), pa.array([packed(table[:, starts[i] : ends[i]]) for i in some], pa.binary())],
                    ["group", "n", "leaves"],
                )
        let_go()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ("group",)):
            ends = np.cumsum(rows.column("n").to_numpy())
            leaves = np.empty((depth + 1, ends[-1]), np.uint32)
            for end, n, value in zip(ends, rows.column("n").to_pylist(), rows.column("leaves"), strict=True):
                leaves[:, end - n : end] = unpacked(value.as_buffer(), depth + 1, n)
            leaves = leaves[:, np.lexsort(leaves[depth - 1 :: -1])]
            columns, part = list(leaves[:depth]), split_depth(list(leaves[:depth]), shared.value)
            for d, first, total in subtree(columns, leaves[depth].astype(np.int64), least):
                own = part[first] <= d
                first, total = first[own], total[own]
                ids = np.stack([c[first] for c in columns[:d]], axis=1).astype(np.int64)
                offsets = np.arange(0, d * len(first) + 1, d, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.ravel())), pa.array(total)], ["ids", "f"])
        let_go()

    dealt = words.mapInArrow(deal, "group long, n long, leaves binary").repartition("group").sortWithinPartitions("group")
    found = dealt.mapInArrow(build, "ids array<long>, f long")
    single = vocabulary.select(F.array("id").alias("ids"), "f")
    return _written(found.unionByName(known).unionByName(single), "phrase-counts")


def phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, percent: int = PERCENT, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases.

    a, l and r count the phrase, its first part and its rest at the lowest-scoring cut (the first of them),
    n all words; score = floor(1000 * a * n / (l * r)). Phrases inside a longer candidate with at least ``percent`` % of
    their count are left out.
    """
    batches = coded(docs)
    totals = batches.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    counted = batches.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    vocabulary = numbered(counted.where(F.col("f") >= least), "id", "lang", "word")
    vocabulary = _written(vocabulary.withColumn("id", F.col("id") + 1), "phrase-vocabulary")
    if vocabulary.count() >= 1 << 32:
        raise ValueError("more than 2**32 frequent words: raise the least count")
    totals = _written(totals, "phrase-totals")
    words = sequences(batches, vocabulary)
    counts = frequent(words, vocabulary, totals.agg(F.sum("n")).first()[0] or 0, least, depth, budget)

    found = counts.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    named = found.select("ids", "a", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "lang", "word"), "id").groupBy("ids", "a").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")
    )
    length = F.size("ids")
    around = found.where(length > 2).select(
        F.explode(F.array(F.slice("ids", F.lit(1), length - 1), F.slice("ids", F.lit(2), length - 1))).alias("ids"), F.col("a").alias("longer")
    ).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = named.join(around, "ids", "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), length - 1)))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, length - F.col("k")))
    cuts = cuts.join(counts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    exact = lambda name: F.col(name).cast("decimal(18,0)")
    cuts = cuts.join(totals, "lang").withColumn("product", exact("a") * exact("n") * F.lit(1000)).withColumn("parts", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("product div parts"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def oracle(least: int = LEAST, depth: int = DEPTH, percent: int = PERCENT, top: int = TOP) -> str:
    """The same list by counting every phrase of every piece (for DuckDB)."""
    return f"""
    with pieces as (select coalesce(lang, 'und') as lang,
                           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    cut as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
    totals as (select lang, sum(len(w))::hugeint as n from cut group by lang),
    grams as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) as g from cut, range(1, {depth + 1}) as sizes(m)),
    f as (select lang, g, m, count(*)::hugeint as f from grams group by lang, g, m having count(*) >= {least}),
    cuts as (select c.lang, c.g, c.f as a, n, k, l.f as l, r.f as r, 1000 * c.f * n // (l.f * r.f) as score
             from f c, range(1, {depth}) as ks(k), f l, f r, totals t
             where c.m > k and l.lang = c.lang and l.g = c.g[1:k] and r.lang = c.lang and r.g = c.g[k + 1 :] and t.lang = c.lang),
    best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
    inner_ones as (select distinct s.lang, s.g from f s, f c, range(1, {depth}) as starts(i)
                   where c.lang = s.lang and c.m > s.m and i + s.m - 1 <= c.m and s.g = c.g[i : i + s.m - 1] and 100 * c.f >= {percent} * s.f),
    ranked as (select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from best anti join inner_ones using (lang, g))
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r,
           n::bigint as n, score::bigint as score
    from ranked qualify rank <= {top}"""
