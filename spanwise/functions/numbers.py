"""Rounding and ratio helpers with the reference rules spelled out once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Nearest integer, ties upwards (also for negative numbers)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def round_exact(x: Column | str, digits: int) -> Column:
    """Round half up in decimal arithmetic, so that a tie does not depend on binary noise."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("decimal(28,10)"), digits).cast("double")


def saturation_pct(active: Column, maximum: Column) -> Column:
    """Whole percent of the maximum; NULL where there is no ceiling to be a percentage of."""
    return F.when(
        active.isNotNull() & maximum.isNotNull() & (maximum > 0),
        # Multiplied first: 23 of 40 is 57.5 %, but 23 / 40 * 100 falls short of it in binary.
        round_half_up(active.cast("double") * 100 / maximum),
    )


def buffer_hit_ratio(logical: Column, physical: Column) -> Column:
    """Reads served from memory, in percent to one decimal; NULL where nothing was read."""
    share = (logical.cast("double") - physical) / logical * 1000
    return F.when(logical.isNotNull() & physical.isNotNull() & (logical > 0), round_half_up(share) / 10)


def assess_queue(depth: Column, maximum: Column, open_inputs: Column) -> Column:
    """Struct (status, reason) for a message queue; an unreported depth stays UNKNOWN."""
    saturation = F.when(maximum != 0, round_half_up(depth.cast("double") / maximum * 100))

    def verdict(status: str, *reason: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.concat(*reason).alias("reason"))

    text = depth.cast("string")
    return (
        F.when(depth.isNull(), verdict("UNKNOWN", F.lit("Queue depth was not reported")))
        .when(
            (depth > 0) & (open_inputs == 0),
            verdict("FAILED", text, F.lit(" message(s) queued and no open input handle: nothing is consuming")),
        )
        .when(
            saturation >= 80,
            verdict("DEGRADED", F.lit("Queue is "), saturation.cast("string"), F.lit("% of its maximum depth")),
        )
        .when(
            saturation.isNull() & (depth > 500),
            verdict("DEGRADED", F.lit("Queue depth "), text, F.lit("; maximum unknown, saturation not computed")),
        )
        .otherwise(verdict("SUCCESS", F.lit("Queue depth "), text))
    )
