"""Near-duplicate documents by circulant MinHash.

A document's set holds its distinct 5-word shingles (the whole sequence when it has fewer words). One
random permutation scatters the shingles over the universe; a second one, shifted circularly by
1, 2, ... K, then gives all K coordinates: coordinate k is the minimum of ``pi[(sigma(x) + k) mod U]``,
so a shingle's K values are one contiguous slice of the table ``pi``. Bands of coordinates propose
pairs, and a pair counts only after the exact Jaccard similarity of the full sets reaches the bound.

Large groups are never expanded into pairs: documents with equal sets are one node; in every round each
node proposes to one node per band bucket, of the bucket's smallest component, and links are followed. Only
nodes of *different* components that still share a bucket are then compared, signature with signature, in
blocks of bounded size; a node goes on when its signature agrees with another component's in ESTIMATE of the
coordinates (a pair of similarity 0.75 misses that with probability below 1e-4). Among these nodes the exact
prefix rule finds every pair that can still reach the similarity: two such sets share one of the rarest
shingles, at places that leave room for the overlap. Both sets of a pair meet at a salted leader, so a hot
leader is spread over many tasks and two sets at a time are in memory.

Defined results: a null text, an empty text and a text of white space have the empty set (n_shingles 0)
and link with nothing; rows without a doc_id are ignored by linking and come back with their own null
id, component_id null and kept true; rows that repeat a doc_id count as one document, whose set is that
of the row with the greatest signature, and come back once; empty input gives no rows; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import mix, owners, runs, text_bytes, words
from spanwise.llm.components import components
from spanwise.session import keep

WORDS, PERCENT = 5, 75
#: 32 bands of 4 coordinates miss a pair of similarity 0.75 with probability (1 - 0.75 ** 4) ** 32 < 6e-6.
BANDS, ROWS = 32, 4
UNIVERSE_BITS = 22
STAR_ROUNDS = 3
#: Nodes per salted part of a leader's proposals, and per block of a bucket.
PART, BLOCK = 500, 1024
ESTIMATE = 0.6
#: Counters that order shingles by rarity; any order is exact, a good one leaves fewer pairs.
SLOTS = 1 << 18


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as (text, hash) sorted by text and hash, and the bounds of each text."""
    n = len(offsets) - 1
    start, _, word = words(data, offsets, fold_case=True)
    of = owners(offsets, start)
    per = np.bincount(of, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(len(word))
    left = first[of + 1] - at if len(word) else at
    whole = (left >= width) | ((at == first[of]) if len(word) else at == at)
    total = np.zeros(len(word), np.uint64)
    for k in range(width):
        reach = left > k
        total[reach] = mix(total[reach] + word[np.flatnonzero(reach) + k] + np.uint64(k + 1))
    of, total = of[whole], total[whole]
    order = np.lexsort((total, of))
    of, total = of[order], total[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (total[1:] != total[:-1])
    of, total = of[new], total[new]
    return of, total, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


@cache
def _table(size: int, seed: int) -> np.ndarray:
    """The permutation pi, with its first ``size`` entries repeated at the end for the circular shift."""
    pi = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return np.concatenate([pi, pi[:size]])


def signature(hashes: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """All coordinates of one set from two permutations."""
    sigma = (mix(hashes + np.uint64(seed)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    slices = np.lib.stride_tricks.sliding_window_view(_table(size, seed), size)
    low = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(sigma), 512):
        np.minimum(low, slices[sigma[k : k + 512]].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts, key = low.reshape(bands, rows).astype(np.uint64), np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, two words that identify the set, band keys and signature (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, total, bounds = shingles(*text_bytes(batch.column("text")))
            n = len(batch)
            id1, id2, keys, lows = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for i in range(n):
                own = total[bounds[i] : bounds[i + 1]]
                if not len(own):
                    keys.append(None)
                    lows.append(None)
                    continue
                id1[i], id2[i] = _identity(own)
                low = signature(own, bands * rows)
                keys.append(band_keys(low, bands, rows))
                lows.append(low.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(id1), pa.array(id2), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())],
                ["doc_id", "n_shingles", "id1", "id2", "bands", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, id1 bigint, id2 bigint, bands array<bigint>, signature binary")


def _identity(own: np.ndarray) -> tuple[int, int]:
    """Two words that identify a set."""
    return int(np.add.reduce(mix(own ^ np.uint64(0xA5A5))).view(np.int64)), int(np.add.reduce(mix(own + np.uint64(0x5A5A5A))).view(np.int64))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted distinct shingles of the whole text, as bytes; one row per doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, total, bounds = shingles(*text_bytes(batch.column("text")))
            held = [total[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ids = [_identity(own) for own in held]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([i for i, _ in ids], pa.int64()), pa.array([i for _, i in ids], pa.int64()),
                pa.array([own.tobytes() for own in held], pa.binary()),
            ], ["doc_id", "n", "id1", "id2", "shingles"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, id1 bigint, id2 bigint, shingles binary")
    return rows.groupBy("doc_id").agg(F.max(F.struct("n", "id1", "id2", "shingles")).alias("s")).select("doc_id", "s.shingles")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (leader, node) whose full sets reach the similarity.

    A leader's nodes are dealt in parts of about PART; every part gets one copy of the leader's set and
    streams the nodes' sets past it, so a task holds two sets however many nodes a leader has.
    """
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "leader").select("leader", "node", (F.abs(F.hash("node")) % F.col("parts")).alias("part"))
    nodes = dealt.join(sets.withColumnRenamed("doc_id", "node"), "node").select("leader", "part", "node", "shingles")
    heads = (
        parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .join(sets.withColumnRenamed("doc_id", "leader"), "leader").select("leader", "part", F.lit(None).cast("bigint").alias("node"), "shingles")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            out = ([], [])
            for leader, part, node, raw in zip(*(batch.column(c).to_pylist() for c in ("leader", "part", "node", "shingles")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if node is None:
                    at, head = (leader, part), own
                elif at == (leader, part):
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(own) - both):
                        out[0].append(leader)
                        out[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["leader", "node"])

    return (
        nodes.unionByName(heads).repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node").asc_nulls_first())
        .mapInArrow(run, "leader bigint, node bigint")
    )


def unlinked_nodes(member: DataFrame, signed: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """Nodes that share a bucket with a node of another component whose signature is close enough.

    ``member`` has bucket, node, n_shingles and component_id. A bucket of more than BLOCK nodes is compared
    block against block, each combination of blocks in a group of its own.
    """
    open_ = member.groupBy("bucket").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b"), F.count("*").alias("size")).where("a < b")
    left = member.join(open_.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket")
    left = left.join(signed.select("node", "signature"), "node").withColumn("own", F.abs(F.hash("node", F.lit(5))) % F.col("blocks"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node", "component_id", "n_shingles", "signature",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("bucket", "lo", "hi")):
            node, component, size, side = (group.column(c).to_numpy() for c in ("node", "component_id", "n_shingles", "side"))
            low = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(node), bands * rows)
            inside = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
            first = np.arange(len(node)) if inside else np.flatnonzero(side == 0)
            second = first if inside else np.flatnonzero(side == 1)
            close = np.zeros(len(node), bool)
            for at in first:
                to = second[second > at] if inside else second
                to = to[component[to] != component[at]]
                if len(to):
                    to = to[100 * np.minimum(size[to], size[at]) >= percent * np.maximum(size[to], size[at])]
                    to = to[(low[to] == low[at]).mean(axis=1) >= ESTIMATE]
                    close[to] = True
                    close[at] |= len(to) > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[close])], ["node"])

    keys = ("bucket", "lo", "hi")
    return left.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node bigint").distinct()


def prefix_pairs(close: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every pair (leader, node) of different components that can reach the similarity, from full sets.

    ``close`` has node, component_id and shingles. With shingles ordered from rare to frequent, two sets x and
    y, x not larger, reach the similarity t only if one of the first |x| - ceil(2t/(1+t)|x|) + 1 shingles of x
    is among the first |y| - ceil(t|y|) + 1 of y, and at the first such place enough of both is left.
    """
    spark = close.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column("shingles").to_pylist():
                np.add.at(total, (np.frombuffer(raw, np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    slots = close.select("shingles").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    held = spark.sparkContext.broadcast(table)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for node, component, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "component_id", "shingles")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                often = held.value[(own % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((own, often))
                n = len(own)
                probe, index = n + 1 + (-percent * n) // 100, n + 1 + (-2 * percent * n) // (100 + percent)
                place = np.arange(min(probe, n))
                place = place[often[order[place]] > 1]
                for kept, new in zip(out, (own[order[place]].view(np.int64), place, place < index, [node] * len(place), [component] * len(place), [n] * len(place)), strict=True):
                    kept.append(np.asarray(new))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else [], k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["shingle", "place", "indexed", "node", "component_id", "n"],
            )

    rows = keep(close.mapInArrow(prefix, "shingle bigint, place bigint, indexed boolean, node bigint, component_id bigint, n bigint"), "near-prefixes")
    mixed = rows.groupBy("shingle").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b").select("shingle")
    rows = rows.join(mixed, "shingle")
    x = rows.where("indexed").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "component_id", "n", "place")])
    y = rows.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("node", "component_id", "n", "place")])
    room = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    fits = (
        (F.col("x_component_id") != F.col("y_component_id")) & (F.struct("x_n", "x_node") < F.struct("y_n", "y_node"))
        & (100 * F.col("x_n") >= percent * F.col("y_n")) & (room * (100 + percent) >= percent * (F.col("x_n") + F.col("y_n")))
    )
    pairs = x.join(y, "shingle").where(fits)
    return pairs.select(F.least("x_node", "y_node").alias("leader"), F.greatest("x_node", "y_node").alias("node")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = keep(signatures(docs, bands, rows), "near-signatures")
    named = signed.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "id1", "id2", "bands", "signature")).alias("s")).select("doc_id", "s.*")
    solid = named.where("n_shingles > 0")
    nodes = solid.groupBy("n_shingles", "id1", "id2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = keep(nodes, "near-nodes")
    buckets = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    buckets = keep(buckets.join(shared, "bucket"), "near-buckets")
    sets = keep(_sets(docs.join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id")), "near-sets")

    similar = F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    links, member = None, buckets.withColumn("component_id", F.col("node"))
    for turn in range(STAR_ROUNDS):
        # The first leader of a bucket is its smallest node, the later ones any node of its smallest component.
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        lead = member.groupBy("bucket").agg(F.min(F.struct("component_id", order.alias("o"), "node", "n_shingles")).alias("h"), F.max("component_id").alias("top"))
        lead = lead.where("h.component_id < top").select("bucket", F.col("h.component_id").alias("a_c"), F.col("h.node").alias("leader"), F.col("h.n_shingles").alias("a_n"))
        pairs = member.join(lead, "bucket").withColumnRenamed("n_shingles", "b_n").where((F.col("component_id") != F.col("a_c")) & similar).select("leader", "node").distinct()
        found = keep(verified(pairs, sets, percent), "near-links")
        links = found if links is None else links.unionByName(found)
        member = keep(_relabel(buckets, links), "near-members")
    apart = unlinked_nodes(member, nodes, percent, bands, rows).join(member.select("node", "component_id").distinct(), "node")
    close = keep(apart.join(sets.withColumnRenamed("doc_id", "node"), "node"), "near-close")
    links = links.unionByName(keep(verified(prefix_pairs(close, percent), sets, percent), "near-links"))
    groups = components(links.select(F.col("leader").alias("a"), F.col("node").alias("b")))

    labelled = nodes.join(groups, "node", "left").select("n_shingles", "id1", "id2", F.coalesce("component_id", "node").alias("component_id"))
    whole = solid.select("doc_id", "n_shingles", "id1", "id2").join(labelled, ["n_shingles", "id1", "id2"]).select("doc_id", "n_shingles", "component_id")
    bare = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = signed.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = whole.unionByName(bare).unionByName(nameless)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _relabel(buckets: DataFrame, links: DataFrame) -> DataFrame:
    groups = components(links.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    return buckets.join(groups, "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
