"""Canonical forms and content hashes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a resend may change without becoming new evidence.
ARRIVAL_FIELDS = ("received_ms", "observed_ms", "ingest_seq", "obs_key")


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON with keys in sorted order; a NULL field is absent."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def canonical_map(entries: Column) -> Column:
    """JSON of a map with its keys sorted."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(entries))))


def content_hash(fields: Mapping[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def sorted_attributes(attributes: Column) -> Column:
    """Attributes in canonical order; duplicates and ordered value arrays are kept."""
    return F.sort_array(F.transform(attributes, lambda a: F.to_json(a)))


def observation_key(df: DataFrame) -> Column:
    """Equality of the retained evidence of a span, whatever the order of its attributes."""
    fields = {c: F.col(c) for c in df.columns if c not in ARRIVAL_FIELDS}
    if "attributes" in fields:
        fields["attributes"] = sorted_attributes(fields["attributes"])
    return content_hash(fields)
