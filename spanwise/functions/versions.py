"""Versions and the closed vocabulary of constraints over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwise.functions.binding import let

OPERATORS = ("exact", "majorEquals", "minorMatch", "gte", "gt", "lte", "lt", "boolEquals")

_VERSION = r"^v?([0-9]+(?:\.[0-9]+)*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
_FLOOR = r"^(?:[\^~]?\s*|>=\s*)v?([0-9]+(?:\.[0-9]+)*(?:-[0-9A-Za-z.-]+)?)$"


def parse_version(text: Column) -> Column:
    """Struct (seg, pre, raw) for an exact version, NULL for a range or anything else."""

    def build(p: Column) -> Column:
        good = p["raw"].rlike(_VERSION) & F.forall(p["seg"], lambda s: s.isNotNull())
        return F.when(
            good,
            F.struct(p["seg"].alias("seg"), F.nullif(p["pre"], F.lit("")).alias("pre"), p["raw"].alias("raw")),
        )

    raw = F.trim(text)
    seg = F.transform(F.split(F.regexp_extract(raw, _VERSION, 1), r"\."), lambda s: s.try_cast("bigint"))
    parts = F.struct(seg.alias("seg"), F.regexp_extract(raw, _VERSION, 2).alias("pre"), raw.alias("raw"))
    return let(parts, build)


def coerce_declared_range(text: Column) -> Column:
    """Struct (version, exact, reason): a declared range yields its floor, flagged inexact."""
    raw = F.trim(text)
    exact = parse_version(raw)
    floor = parse_version(F.regexp_extract(raw, _FLOOR, 1))
    return (
        F.when(text.isNull(), _coerced(F.lit(None), False, F.lit("not a string")))
        .when(exact.isNotNull(), _coerced(exact["raw"], True, F.lit(None)))
        .when(
            raw.rlike(_FLOOR) & floor.isNotNull(),
            _coerced(floor["raw"], False, F.lit("floor of a declared range; installed version unknown")),
        )
        .otherwise(_coerced(F.lit(None), False, F.concat(F.lit("unsupported range syntax: "), raw)))
    )


def _coerced(version: Column, exact: bool, reason: Column) -> Column:
    return F.struct(
        version.cast("string").alias("version"), F.lit(exact).alias("exact"), reason.cast("string").alias("reason")
    )


def _padded(v: Column, other: Column) -> Column:
    missing = F.greatest(F.size(other["seg"]) - F.size(v["seg"]), F.lit(0))
    return F.concat(v["seg"], F.array_repeat(F.lit(0).cast("bigint"), missing))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 over parsed versions; missing segments are 0, a release outranks its prerelease."""

    def order(v: Column) -> Column:
        pre_a, pre_b = v["a"]["pre"], v["b"]["pre"]
        return (
            F.when(v["x"] < v["y"], -1)
            .when(v["x"] > v["y"], 1)
            .when(pre_a.eqNullSafe(pre_b), 0)
            .when(pre_a.isNull(), 1)
            .when(pre_b.isNull(), -1)
            .when(pre_a < pre_b, -1)
            .otherwise(1)
        )

    def padded(v: Column) -> Column:
        x, y = _padded(v["a"], v["b"]), _padded(v["b"], v["a"])
        both = F.struct(v["a"].alias("a"), v["b"].alias("b"), x.alias("x"), y.alias("y"))
        return F.when(v["a"].isNotNull() & v["b"].isNotNull(), let(both, order))

    return let(F.struct(a.alias("a"), b.alias("b")), padded)


def _answer(result: str, *reason) -> Column:
    parts = [r if isinstance(r, Column) else F.lit(r) for r in reason]
    return F.struct(F.lit(result).alias("result"), F.concat(*parts).alias("reason"))


def _quoted(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))


def eval_constraint(op: Column, value: Column, actual: Column, actual_type: Column | None = None) -> Column:
    """Struct (result, reason), result one of SATISFIED, VIOLATED, UNKNOWN.

    Anything that cannot be evaluated is UNKNOWN. ``actual_type`` names the type the actual value
    was observed with ('boolean', 'string', ...); without it, every value counts as text.
    """
    kind = F.lit("string") if actual_type is None else F.coalesce(actual_type, F.lit("nothing"))
    parsed = F.struct(
        parse_version(F.when(kind == "string", actual)).alias("a"),
        parse_version(value).alias("want"),
        parse_version(F.concat(value, F.lit(".0"))).alias("line"),
    )

    def compared(p: Column) -> Column:
        order = compare_versions(p["a"], p["want"])
        line = F.coalesce(p["line"], p["want"])
        step = F.struct(p["a"].alias("a"), p["want"].alias("want"), line.alias("line"), order.alias("order"))
        return let(step, lambda s: _judge(s, op, value, actual, kind))

    return let(parsed, compared)


def _judge(step: Column, op: Column, value: Column, actual: Column, kind: Column) -> Column:
    a, want, line, order = step["a"], step["want"], step["line"], step["order"]
    major = value.try_cast("bigint")

    def part(v: Column, i: int) -> Column:
        return F.coalesce(F.get(v["seg"], F.lit(i)), F.lit(0))

    same_line = (part(a, 0) == part(line, 0)) & (part(a, 1) == part(line, 1))
    line_text = F.concat(part(line, 0).cast("string"), F.lit("."), part(line, 1).cast("string"), F.lit(".x"))
    holds = (
        F.when(op == "exact", order == 0)
        .when(op == "gte", order >= 0)
        .when(op == "gt", order > 0)
        .when(op == "lte", order <= 0)
        .when(op == "lt", order < 0)
    )
    unknown_value = _answer("UNKNOWN", "rule value ", _quoted(value), " is not a version")
    return (
        F.when(op.isNull(), _answer("UNKNOWN", "no constraint supplied"))
        .when(~op.isin(*OPERATORS), _answer("UNKNOWN", "unsupported operator '", op, "'"))
        .when(
            op == "boolEquals",
            F.when(kind != "boolean", _answer("UNKNOWN", "expected a boolean, observed ", kind))
            .when(F.lower(actual) == F.lower(value), _answer("SATISFIED", "is ", value))
            .otherwise(_answer("VIOLATED", "is ", actual, ", expected ", value)),
        )
        .when(a.isNull(), _answer("UNKNOWN", "observed value ", _quoted(actual), " is not an exact version"))
        .when(
            op == "minorMatch",
            F.when(line.isNull(), unknown_value)
            .when(same_line, _answer("SATISFIED", a["raw"], " is in the ", line_text, " line"))
            .otherwise(_answer("VIOLATED", a["raw"], " is not in the ", line_text, " line")),
        )
        .when(
            op == "majorEquals",
            F.when(major.isNull(), _answer("UNKNOWN", "rule value ", _quoted(value), " is not an integer major"))
            .when(part(a, 0) == major, _answer("SATISFIED", "major is ", major.cast("string")))
            .otherwise(
                _answer("VIOLATED", "major is ", part(a, 0).cast("string"), ", expected ", major.cast("string"))
            ),
        )
        .when(want.isNull(), _answer("UNKNOWN", "rule value ", _quoted(value), " is not an exact version"))
        .when(holds, _answer("SATISFIED", a["raw"], " ", op, " ", want["raw"]))
        .otherwise(_answer("VIOLATED", a["raw"], " is not ", op, " ", want["raw"]))
    )


def is_exact(text: Column) -> Column:
    """Digits and dots only, every segment representable."""
    return F.coalesce(text.rlike(r"^[0-9]+(\.[0-9]+)*$") & parse_version(text).isNotNull(), F.lit(False))
