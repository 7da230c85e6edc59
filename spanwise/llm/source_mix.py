"""Mix sources to target weights: how often each document is taken, by thresholds on a hash.

Sources share ``share`` of all words by weight; a source is taken at most ``most`` times over, and what it
cannot give is shared among the others by weight, until no source is above that. A target of q whole copies
of the source and a rest takes every document q times, and once more those whose key lies below the source's
threshold. The thresholds are nested: a smaller budget takes a subset of a larger one.

A key is the MD5 of doc_id and text in hexadecimal digits, followed by the row's number, so that equal rows differ.
The threshold of a source is found digit by digit: words are summed by source and bucket (the next three
digits), the bucket that the budget ends in is looked up in the sums, and only its rows are summed again by the
next three. No row is sorted; what is left of the rows shrinks by a factor of 4,096 each round. The last bucket
holds one row, which is taken if that brings the source nearer to its target, so a source misses its target
by half a document's words at most.

Every step is built-in expressions. Sums are made before the shuffle, so a source with a third of all rows is one
partial row per task and bucket. Keys, sizes and sources are written once (some 100 bytes a document); the
rounds and the final filter read that table, and lost executors do not change the keys.

Defined results: a null text has size 0 and counts as empty; documents of size 0 are taken with 0 words; a null
source is a source of its own, the last one; rows without a doc_id take part, and their keys come from the text
alone; of equal rows (doc_id and text) the budget may take some, so which of them is open but the rows returned are not;
no documents, or none with words, give targets of 0; other columns are not read. Very long texts are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.session import keep

WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
DIGITS = 3
_SPACES = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """The number of runs outside 0x20 and 0x09-0x0D; each is replaced by one letter, so no array of words is built."""
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(text, F.lit(_SPACES)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def numbered(frame: DataFrame, name: str, *order: str) -> DataFrame:
    """Written rows with a number from 0 in the given order; only a count per partition is looked at in one place."""
    placed = keep(frame.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    bases = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_base"))
    local = F.col("_place") - F.shiftleft(F.shiftright("_place", 33), 33)
    return placed.join(bases, part == F.col("_part")).withColumn(name, F.col("_base") + local).drop("_place", "_part", "_base")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with their weight by code point order (null last) and their target."""
    ranked = numbered(sources.withColumn("_unnamed", F.col("source").isNull()), "_rank", "_unnamed", "source").drop("_unnamed")
    ranked = keep(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank"), "mix-sources")
    big = lambda x: F.lit(x).cast("decimal(38,0)")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    if share[0] > most * share[1]:
        raise ValueError("the sources cannot give more than the most copies of everything")
    capped, weight = 0, None
    while True:
        # What is left for the open sources, in units of 1 / (share[1] * weight).
        amount = share[0] * total - share[1] * most * capped
        above = F.lit(False) if weight is None else F.col("weight") * big(amount) > F.col("source_size") * big(most * share[1] * weight)
        r = ranked.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        after = (r[0] or 0, r[1] or 1)
        if (capped, weight) == after:
            break
        capped, weight = after
    fair = (F.col("weight") * big(amount)).cast("double") / F.lit(float(share[1] * weight))
    return ranked.withColumn("target", F.when(above, most * F.col("source_size").cast("double")).otherwise(fair))


def thresholds(rows: DataFrame, budgets: DataFrame, digits: int = DIGITS) -> DataFrame:
    """nr, threshold: keys below it hold the words nearest to the budget of each source.

    ``rows`` (nr, key, size), ``budgets`` (nr, budget).
    """
    state = budgets.select("nr", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    closed, at = [], 0
    while True:
        bucket = F.substring("key", 1, at + digits).alias("bucket")
        if at:
            ended = state.select(F.col("nr").alias("_nr"), "prefix")
            rows = keep(rows.join(ended, (F.col("nr") == F.col("_nr")) & (F.substring("key", 1, at) == F.col("prefix")), "left_semi"), "mix-boundary")
        sums = rows.groupBy("nr", bucket).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("words").over(Window.partitionBy("nr").orderBy("bucket"))
        placed = sums.join(state, "nr").withColumn("after", F.col("before") + upto).withColumn("before", F.col("after") - F.col("words"))
        # The first bucket that is not wholly within the budget; none where the budget takes all of them.
        ends = placed.where(F.col("after") > F.col("budget")).groupBy("nr").agg(
            F.min(F.struct("bucket", "before", "after", "n", "budget")).alias("b")
        ).select("nr", "b.*")
        whole = (F.col("n") == 1) & (F.col("before") + F.col("after") <= 2 * F.col("budget"))
        done = (F.col("n") == 1) | (F.col("before") >= F.col("budget"))
        ends = keep(ends.select("nr", "budget", F.col("bucket").alias("prefix"), "before", done.alias("done"), whole.alias("whole")), "mix-cuts")
        # "g" follows every digit, so a bucket that is taken lies below the threshold as a whole.
        closed.append(ends.where("done").select("nr", F.when(F.col("whole"), F.concat("prefix", F.lit("g"))).otherwise(F.col("prefix")).alias("threshold")))
        state, at = ends.where("not done").select("nr", "budget", "prefix", "before"), at + digits
        if state.isEmpty():
            break
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return found


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, digits: int = DIGITS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every document; ``share`` is a fraction of all words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    number = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    rows = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.concat(own, number).alias("key")), "mix-rows")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("nr", F.monotonically_increasing_id()).withColumn("whole", copies)
    sources = keep(sources.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    at_source = F.col("source").eqNullSafe(F.col("_source"))
    open_sources = sources.where("budget > 0")
    sized = rows.where("size > 0").join(open_sources.select("nr", F.col("source").alias("_source")), at_source).select("nr", "key", "size")
    cuts = thresholds(sized, open_sources.select("nr", "budget"), digits)
    plan = sources.join(cuts, "nr", "left").select(F.col("source").alias("_source"), "source_size", "target", "whole", "threshold")
    once_more = F.coalesce(F.col("key") < F.col("threshold"), F.lit(False)).cast("long")
    taken = rows.join(plan, at_source).withColumn("copies", F.col("whole") + once_more)
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def oracle(weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> str:
    """The same mix by sorting all documents of a source by their keys (for DuckDB)."""
    return f"""
    with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
                          md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as key from documents),
    sources as (select source, sum(size)::bigint as s, (row_number() over (order by source nulls last) - 1) % {len(weights)} as nr from sized group by source),
    weighted as (select *, {list(weights)}[nr + 1] as w, row_number() over (order by s / {list(weights)}[nr + 1], source) as place from sources),
    -- Sources in the order in which they reach their most copies; the first ones do, up to the first that does not.
    levels as (select *, {share[0]} * (sum(s) over ()) - {share[1] * most} * coalesce(sum(s) over (order by place rows between unbounded preceding and 1 preceding), 0) as amount,
                      {share[1]} * sum(w) over (order by place rows between current row and unbounded following) as below from weighted),
    level as (select amount::bigint as amount, below::bigint as below, place from levels where w * amount <= {most} * s * below order by place limit 1),
    target as (select l.source, l.s, case when l.place < v.place then {most} * l.s::double else (l.w * v.amount)::double / v.below::double end as target from levels l, level v),
    budget as (select *, case when s > 0 then floor(target / s)::bigint else 0 end as copies from target),
    ranked as (select d.*, b.s, b.target, b.copies, b.target - b.copies * b.s as rest,
                      sum(size) over (partition by d.source order by key rows between unbounded preceding and current row) as upto
               from sized d join budget b on d.source is not distinct from b.source)
    select doc_id, size, s as source_size, target, size * (copies + (rest > 0 and 2 * upto - size <= 2 * rest)::bigint) as taken
    from ranked"""
