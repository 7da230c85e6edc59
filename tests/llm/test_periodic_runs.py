"""Periodic runs against plain loops over all periods and starts."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import periodic_runs, queries
from spanwise.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, exponent=4, least=6):
    """(start, length, period) of every run: all stretches of matches on every diagonal, smallest period only."""
    n, smallest = len(words), {}
    for q in range(1, n // exponent + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - at >= max(least, exponent * q):
                smallest.setdefault((at, end - at), q)
            at = end - q + 1
    return sorted((s, length, q) for (s, length), q in smallest.items())


def plain_collapse(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def nested(rnd):
    """Periodic blocks inside periodic blocks, with breaks."""
    block = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 4))]
    for _ in range(rnd.randint(1, 3)):
        block = (block * rnd.randint(1, 6))[: rnd.randint(1, 60)] + [rnd.randint(0, 3) for _ in range(rnd.randint(0, 2))]
    return block * rnd.randint(1, 5) + block[: rnd.randint(0, len(block))]


def test_kernel():
    rnd = random.Random(7)
    for case in range(1500):
        words = nested(rnd) if case % 2 else [rnd.randint(0, 1) for _ in range(rnd.randint(0, 80))]
        for exponent, least in ((4, 6), (3, 1)):
            got = periodic_runs.find_runs(np.array(words, np.int64), exponent, least)
            assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_runs(words, exponent, least), words


def test_kernel_on_hot_words():
    words = np.zeros(400_000, np.int64)
    assert [x.tolist() for x in periodic_runs.find_runs(words)] == [[0], [400_000], [1]]
    words[::1000] = 1
    start, length, period = periodic_runs.find_runs(words)
    assert (0, 400_000, 1000) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) and len(start) == 401


def test_messy_rows(spark):
    rows = [
        (1, "a b c d e f"), (2, "x x x x x x"), (3, "\tx\n x x x\x0bx"), (4, None), (5, ""), (6, " \n "), (None, "z " * 9), (None, None),
        (7, "la di la di la di la di la end"), (7, "la di la di la di la di la end"), (8, "é 日 " * 4), (9, "w" * 100_000), (10, "no " + "so so much " * 40_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("runs", "n_words", "collapsed", "start", "best")})
    got = periodic_runs.runs(docs.repartition(3)).collect()
    want = []
    for d, t in rows:
        words = WORD.findall(t or "")
        found = [(1, 120_000, 3)] if d == 10 else plain_runs(words)
        want.append((d, len(words), tuple(found), plain_collapse(words, found)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got), key=key) == sorted(want, key=key)
    assert periodic_runs.runs(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.runs(docs, exponent=2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")
def test_op13(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    some = 0
    for d, t in texts.items():
        words = planted(d, t)
        found = plain_runs(words)
        some += bool(found)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        milli = 1000 * best[1] // best[2] if best else None
        listing = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want = (len(found), *(best or (None, None, None)), milli, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(plain_collapse(words, found).encode()).hexdigest())
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == want, d
    assert some > 10
