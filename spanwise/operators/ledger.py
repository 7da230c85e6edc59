"""Hash chains over conclusions, and money shared inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.identity import canonical_json
from spanwise.operators.ordered import last_known, log_block, newest_per_key, running_total

GENESIS = "0" * 64
SEGMENT = 1000


def ledger_append(
    conclusions: DataFrame, chain: str, order: Sequence[str], content: Sequence[str], existing: DataFrame | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """The new hash-chained blocks per chain key: (chain, block_index, payload, previous_hash, hash).

    Every block depends on all blocks before it. Inside a segment of ``segment`` blocks it holds the hash of
    the one before; the first block of a segment holds the chain's *anchor*, a running hash over the digests
    of all earlier segments. Digests are made in parallel and only they (``segment`` times fewer than blocks)
    are folded in order. With ``existing``, numbering and anchors go on from its last segment, the only part
    of it that is read besides its highest index.
    """
    c = F.col
    keys = [c(k) for k in order]
    rows = conclusions.select(
        c(chain).alias("chain"), *order, canonical_json({k: c(k) for k in content}).alias("payload")
    )
    indexed = running_total(rows, ["chain"], keys, F.lit(1).cast("bigint"), _order_block(order), "block_index").select("chain", "block_index", "payload")
    if existing is None:
        return _link(indexed, None, segment)
    heads = existing.groupBy("chain").agg(F.max("block_index").alias("top"))
    fresh = indexed.join(heads, "chain", "left").select("chain", (c("block_index") + F.coalesce(c("top") + 1, F.lit(0))).alias("block_index"), "payload")
    tail = existing.join(heads, "chain").filter(c("block_index") >= F.floor(c("top") / segment) * segment)
    starts = tail.filter(c("block_index") % segment == 0).select("chain", F.floor(c("block_index") / segment).alias("first"), c("previous_hash").alias("start"))
    made = _link(fresh.unionByName(tail.select("chain", "block_index", "payload")), starts, segment)
    return made.join(heads, "chain", "left").filter(c("top").isNull() | (c("block_index") > c("top"))).drop("top")


def _segments(blocks: DataFrame, segment: int) -> DataFrame:
    parts = blocks.withColumn("segment", F.floor(F.col("block_index") / segment)).groupBy("chain", "segment").agg(
        F.sort_array(F.collect_list(F.struct("block_index", "payload"))).alias("blocks")
    )
    digest = F.sha2(F.array_join(F.transform("blocks", lambda b: F.sha2(b["payload"], 256)), ""), 256)
    return parts.withColumn("digest", digest)


def _anchors(parts: DataFrame, starts: DataFrame | None) -> DataFrame:
    """chain, segment and the anchor its first block holds: a fold over the digests of the segments before."""
    digests = parts.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("segment", "digest"))).alias("digests"))
    if starts is None:
        digests = digests.withColumn("start", F.lit(GENESIS))
    else:
        digests = digests.join(starts, "chain", "left").withColumn("start", F.coalesce("start", F.lit(GENESIS)))
    made = F.aggregate(
        "digests", F.array("start"),
        lambda acc, d: F.concat(acc, F.array(F.sha2(F.concat_ws("|", F.element_at(acc, -1), d["digest"]), 256))),
    )
    zipped = F.arrays_zip(F.transform("digests", lambda d: d["segment"]).alias("segment"), F.slice(made, 1, F.size("digests")).alias("anchor"))
    return digests.select("chain", F.explode(zipped).alias("z")).select("chain", "z.segment", "z.anchor")


def _link(blocks: DataFrame, starts: DataFrame | None, segment: int) -> DataFrame:
    c = F.col
    parts = _segments(blocks, segment)
    anchored = parts.join(_anchors(parts, starts), ["chain", "segment"])
    empty = F.array().cast("array<struct<block_index:bigint,payload:string,previous_hash:string,hash:string>>")

    def link(acc: Column, b: Column) -> Column:
        previous = F.coalesce(F.try_element_at(acc, F.lit(-1))["hash"], c("anchor"))
        made = F.struct(
            b["block_index"].alias("block_index"),
            b["payload"].alias("payload"),
            previous.alias("previous_hash"),
            block_hash(c("chain"), b["block_index"], previous, b["payload"]).alias("hash"),
        )
        return F.concat(acc, F.array(made))

    chained = anchored.withColumn("made", F.aggregate("blocks", empty, link))
    return chained.select("chain", F.explode("made").alias("b")).select("chain", "b.*")


def _order_block(order: Sequence[str]) -> Column:
    # Blocks follow the first (numeric) order column; ten thousand units each.
    return F.floor(F.col(order[0]) / 10_000)


def block_hash(chain: Column, index: Column, previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", chain.cast("string"), index.cast("string"), previous, payload), 256)


def ledger_verify(ledger: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per chain: is it intact, and if not, the first bad block and why. Every block is checked alone.

    Anchors are worked out anew from all payloads, so re-hashing a forged block and its neighbours moves the
    break to the next segment or, when everything after it is re-hashed, changes ``head_hash``.
    """
    c = F.col
    before = ledger.select("chain", (c("block_index") + 1).alias("block_index"), c("hash").alias("linked_hash"))
    anchors = _anchors(_segments(ledger, segment), None).select("chain", (c("segment") * segment).alias("block_index"), "anchor")
    rows = ledger.join(before, ["chain", "block_index"], "left").join(anchors, ["chain", "block_index"], "left")
    opens = c("block_index") % segment == 0
    expected = F.when(opens, c("anchor")).otherwise(c("linked_hash"))
    problem = (
        F.when(~c("previous_hash").eqNullSafe(expected), "LINK_BROKEN").when(
            ~c("hash").eqNullSafe(block_hash(c("chain"), c("block_index"), c("previous_hash"), c("payload"))),
            "CONTENT_CHANGED",
        )
    )
    checked = rows.withColumn("problem", problem)
    bad = c("problem").isNotNull()
    return checked.groupBy("chain").agg(
        F.count(F.lit(1)).alias("blocks"),
        (F.sum(bad.cast("bigint")) == 0).alias("intact"),
        F.min(F.when(bad, c("block_index"))).alias("first_bad_index"),
        F.min_by("problem", F.when(bad, c("block_index"))).alias("problem"),
        F.max_by("hash", "block_index").alias("head_hash"),
    )


def group_balances(expenses: DataFrame) -> DataFrame:
    """Balance per group and member in minor units.

    ``expenses``: group_id, paid_by, split_with (array), amount_cents. The payer is credited in
    full; each participant owes the floor share and the first few one unit more.
    """
    c = F.col
    n = F.size("split_with")
    owed = expenses.select(
        "group_id",
        F.posexplode("split_with").alias("at", "member"),
        F.floor(c("amount_cents") / n).cast("bigint").alias("share"),
        (c("amount_cents") % n).alias("rest"),
    ).select("group_id", "member", (-(c("share") + F.when(c("at") < c("rest"), 1).otherwise(0))).alias("cents"))
    paid = expenses.select("group_id", c("paid_by").alias("member"), c("amount_cents").alias("cents"))
    return paid.unionByName(owed).groupBy("group_id", "member").agg(F.sum("cents").alias("balance_cents"))


def balance_invariant(balances: DataFrame) -> DataFrame:
    """Balances of a group must add up to zero."""
    return balances.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("balance_cents").alias("total_cents"),
        (F.sum("balance_cents") == 0).alias("valid"),
    )


def settlements(balances: DataFrame) -> DataFrame:
    """Who pays whom: the largest debtor to the largest creditor, never more than is owed.

    Debtors and creditors laid end to end cover the same range of money. Its borders cut it into
    pieces that belong to one debtor and one creditor each; a piece is one payment.
    """
    c = F.col
    size = F.abs("balance_cents")
    sided = balances.filter(c("balance_cents") != 0).select(
        "group_id", "member", (c("balance_cents") < 0).alias("debtor"), size.alias("cents")
    )
    placed = running_total(
        sided, ["group_id", "debtor"], [F.desc("cents"), c("member")], c("cents"), -log_block(c("cents")), "from_cents"
    )
    events = placed.select(
        "group_id", "from_cents",
        F.when(c("debtor"), c("member")).alias("d"), F.when(~c("debtor"), c("member")).alias("k"),
    )
    # A debtor and a creditor may start at the same point; they open one piece together.
    points = events.groupBy("group_id", "from_cents").agg(F.max("d").alias("d"), F.max("k").alias("k"))
    order = [c("from_cents")]
    with_d = last_known(points, ["group_id"], order, c("d"), log_block(c("from_cents")), "debtor")
    with_k = last_known(with_d, ["group_id"], order, c("k"), log_block(c("from_cents")), "creditor")
    ends = placed.filter("debtor").groupBy("group_id").agg(F.max(c("from_cents") + c("cents")).alias("end_cents"))
    # The next border, read backwards in order.
    upcoming = last_known(
        with_k, ["group_id"], [-c("from_cents")], c("from_cents"), -log_block(c("from_cents")), "next_cents", inclusive=False
    )
    amount = F.coalesce("next_cents", "end_cents") - c("from_cents")
    return (
        upcoming.join(ends, "group_id")
        .select("group_id", c("debtor").alias("from_member"), c("creditor").alias("to_member"), amount.alias("amount_cents"))
        .filter(c("amount_cents") > 0)
    )


def apply_offline_queue(queue: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """First operation per idempotency key that the ledger does not hold yet.

    ``queue``: idempotency_key, queued_seq and the operation. Chain the result with ``ledger_append``,
    giving it the ledger as ``existing``.
    """
    first = newest_per_key(queue, ["idempotency_key"], [F.asc("queued_seq")], 1)
    if ledger is None:
        return first
    return first.join(ledger.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
