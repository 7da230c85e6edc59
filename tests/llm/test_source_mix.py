"""Source mixing against a plain version that sorts, and its targets on hot, tiny and missing sources."""

import hashlib
import os
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spanwise.llm import queries, source_mix

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    amount, capped = share * sum(sizes.values()), set()
    while True:
        left = amount - sum(most * sizes[s] for s in capped)
        total = sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] > most * sizes[s] * total}
        if not over:
            return {s: most * sizes[s] if s in capped else left * weight[s] / total for s in names}
        capped |= over


def plain_mix(rows):
    """A multiset of (doc_id, source, size, source size, target, taken)."""
    sized = [(d, t, s, len(WORD.findall(t or ""))) for d, t, s in rows]
    sizes = Counter()
    for _, _, s, n in sized:
        sizes[s] += n
    want = plain_targets(sizes)
    by_source = defaultdict(list)
    for d, t, s, n in sized:
        by_source[s].append((hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest(), d, n))
    out = Counter()
    for s, docs in by_source.items():
        whole = int(want[s] // sizes[s]) if sizes[s] else 0
        rest, before = want[s] - whole * sizes[s], 0
        for _, d, n in sorted(docs, key=lambda r: r[0]):
            more = int(rest > 0 and 2 * before + n <= 2 * rest)
            out[d, s, n, sizes[s], round(float(want[s]), 6), n * (whole + more)] += 1
            before += n
    return out


def rows():
    out = [(i, " ".join(["w"] * (i * 37 % 23)), ("hot", "hot", "B", "a", None, "tiny" if i == 5 else "hot")[i % 6]) for i in range(400)]
    out += [(900, "same text here", "copies")] * 301
    return [*out, (None, "no id", "a"), (None, None, None), (1, "\t\x0b two  words\r\n", "ä"), (2, "", "only empty"), (3, None, "only empty"), (4, "x" * 100_000, "z")]


@pytest.mark.parametrize("digits", [2, 3])
def test_mix(spark, digits):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(5)
    docs = docs.withColumns({c: F.lit("clash") for c in ("size", "key", "nr", "_source", "target", "budget", "threshold", "_place")})
    got = Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in source_mix.mix(docs, digits=digits).collect())
    assert got == plain_mix(data)
    words = Counter()
    for (_, s, n, _, _, taken), times in got.items():
        assert taken <= 2 * n
        words[s] += taken * times
    for (_, s, _, size, target, _) in got:
        assert abs(words[s] - target) <= max(n for (_, t, n, *_rest) in got if t == s) / 2 + 1e-9
    assert 98 < words["copies"] / 3 < 2 * 301


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert source_mix.mix(docs).collect() == []
    silent = spark.createDataFrame([(1, None, "a"), (2, "", "b")], docs.schema)
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in source_mix.mix(silent).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    with pytest.raises(ValueError):
        source_mix.mix(silent, share=(5, 2))


@pytest.mark.parametrize("words", [10**6, 1_500_000_000, 10**17])
def test_targets_of_many_words(spark, words):
    """Weights times amounts need more than 32 bits long before there are 2**31 words."""
    sizes = {"a": words // 3, "b": words // 2, "c": words // 10, None: words // 15}
    got = source_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx({s: float(t) for s, t in plain_targets(sizes).items()})


def test_no_python_and_no_sort_of_rows(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, source string")
    plan = source_mix.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no benchmark tables")
def test_op11(spark):
    ok, message = oracle.compare(spark, oracle.duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", "op11_source_mix", queries.QUERIES["op11_source_mix"], queries.ORACLES["op11_source_mix"])
    assert ok, message
