"""Provenance labels carried on result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.schema import SOURCE_TYPES, STAGES


def labelled(df: DataFrame, stage: str, source_type: str) -> DataFrame:
    if stage not in STAGES or source_type not in SOURCE_TYPES:
        raise ValueError(f"unknown provenance {stage}/{source_type}")
    return df.withColumns({"stage": F.lit(stage), "source_type": F.lit(source_type)})


def label_errors(stage: Column, source_type: Column) -> Column:
    """Array of what is wrong with a row's labels; empty when both are known."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(stage.isin(*STAGES), F.lit(False)), "unknown stage"),
            F.when(~F.coalesce(source_type.isin(*SOURCE_TYPES), F.lit(False)), "unknown source type"),
        )
    )
