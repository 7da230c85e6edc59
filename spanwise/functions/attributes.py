"""Reading span attributes, which are a list: duplicates and conflicts are evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP_STATUS_KEYS = ("http.response.status_code", "http.status_code")

# Attribute tiers, in order of precedence.
ATTRIBUTE_TIERS = {
    "IDENTITY": ("trace_id", "span_id", "parent_span_id"),
    "SERVICE": ("service.name", "service.version", "service.namespace"),
    "RESOURCE": ("host.name", "k8s.pod.name", "k8s.node.name", "container.id"),
    "REQUEST": ("http.method", "http.status_code", "http.route", "rpc.method"),
    "BUSINESS": ("business.journey", "transaction.type", "tenant.tier"),
    "HIGH_CARDINALITY": ("customer.id", "user.session_id", "order.uuid", "random.nonce", "raw.query_params"),
    "SENSITIVE": ("auth.token", "user.password", "card.pan", "user.ssn"),
}


def _matching(attributes: Column, key: str) -> Column:
    return F.filter(attributes, lambda a: a["key"] == key)


def _value(attribute: Column) -> Column:
    v = attribute["value"]
    return F.coalesce(
        v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string")
    )


def attr(attributes: Column, key: str) -> Column:
    """Value of the first attribute with this key, as text; NULL when absent."""
    return _value(F.get(_matching(attributes, key), F.lit(0)))


def attr_number(attributes: Column, key: str) -> Column:
    return attr(attributes, key).try_cast("double")


def attr_strict(attributes: Column, key: str) -> Column:
    """Text value, only where exactly one attribute has the key (or a vendor-prefixed form of it)."""
    found = F.filter(attributes, lambda a: (a["key"] == key) | a["key"].endswith("." + key))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))["value"]["stringValue"])


def http_status(attributes: Column) -> Column:
    """Struct (value, conflict): one agreed valid status code, or a conflict, or neither."""
    codes = F.transform(
        F.filter(attributes, lambda a: a["key"].isin(*HTTP_STATUS_KEYS)),
        lambda a: F.when(a["value"]["intValue"].rlike("^[0-9]{3}$"), a["value"]["intValue"].cast("int")),
    )
    agreed = F.forall(codes, lambda c: F.coalesce(c.between(100, 599), F.lit(False))) & (
        F.size(F.array_distinct(codes)) == 1
    )
    none = attributes.isNull() | (F.size(codes) == 0)
    return F.struct(
        F.when(~none & agreed, F.get(codes, F.lit(0))).alias("value"),
        F.when(none, F.lit(False)).otherwise(~agreed).alias("conflict"),
    )


def is_db_hop(service: Column, name: Column, attributes: Column | None = None) -> Column:
    """Declared by ``db.system``, or self-describing by name (a plain substring test)."""
    s, n = F.lower(F.coalesce(service, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    by_name = s.contains("db") | s.contains("postgres") | n.contains("db") | n.contains("query")
    if attributes is None:
        return by_name
    return F.coalesce(attr(attributes, "db.system").isNotNull(), F.lit(False)) | by_name


def attribute_tier(key: Column) -> Column:
    lower = F.lower(key)
    result = None
    for tier, names in ATTRIBUTE_TIERS.items():
        hit = F.lit(False)
        for name in names:
            hit = hit | (key == name) | lower.contains(name)
        result = F.when(hit, tier) if result is None else result.when(hit, tier)
    return result.otherwise("UNCLASSIFIED")


def index_policy(keys: Column) -> Column:
    """Split an array of attribute keys by where they may be indexed."""

    def having(*tiers: str, negate: bool = False) -> Column:
        def test(k: Column) -> Column:
            inside = attribute_tier(k).isin(*tiers)
            return ~inside if negate else inside

        return F.filter(keys, test)

    return F.struct(
        having("SENSITIVE", "HIGH_CARDINALITY", negate=True).alias("primary_keys"),
        having("HIGH_CARDINALITY").alias("unindexed_keys"),
        having("SENSITIVE").alias("masked_keys"),
    )
