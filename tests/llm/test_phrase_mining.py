"""Phrase mining against plain counts, with budgets that force prefixes of every length to be extended."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import phrase_mining, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string"


def plain_phrases(rows, least=100, depth=5, percent=100, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(depth, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        good = {g: a for g, a in counts.items() if a >= least and len(g) > 1}
        inside = set()
        for g, a in good.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    if 100 * a >= percent * counts[g[i : i + m]]:
                        inside.add(g[i : i + m])
        scored = []
        for g, a in good.items():
            if g not in inside:
                cuts = [(1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                scored.append((score, a, " ".join(g), counts[g[:k]], counts[g[k:]]))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(scored[:top], 1)]
    return sorted(out)


def rows():
    rnd, out = random.Random(3), []
    letters = "abcdefghij"
    for i in range(300):
        words = [rnd.choice(letters[: 3 + i % 8]) + rnd.choice("xyzé") * rnd.randint(0, 1) for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            words += "the very same long passage of words".split()
        text = "".join(w.upper() if rnd.random() < 0.1 else w for w in (x + rnd.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "  "]) for x in words))
        out.append((i, text, ("en", "de", None, "und", "en")[i % 5]))
    out += [(500, "hot words " * 30_000, "en"), (None, "the very same", "en"), (None, None, None), (501, "", "de"), (502, " .\n", None), (7, "the very same", "en"), (7, "the very same", "en")]
    return out


@pytest.mark.parametrize(("budget", "least", "percent"), [(4_000_000, 20, 100), (160, 20, 80), (2000, 12, 100)])
def test_phrases(spark, budget, least, percent):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("words", "id", "f", "ids", "chunk", "n")})
    got = phrase_mining.phrases(docs, least=least, percent=percent, budget=budget, top=150).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows(), least, percent=percent, top=150)


def test_more_prefixes_than_the_lists_may_hold(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "PREFIXES", 5)
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(tuple, phrase_mining.phrases(docs, least=20, budget=160).collect())) == plain_phrases(rows(), 20)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert phrase_mining.phrases(docs).collect() == []
    assert phrase_mining.phrases(spark.createDataFrame([(1, None, None), (2, " ", "en"), (3, "a b c", "en")], SCHEMA)).collect() == []


def test_suffixes():
    words = np.array([1, 2, 3, 0, 1, 2, 3, 0, 5, 0, 1, 2], np.uint32)
    *columns, numbers = phrase_mining.suffixes(words, 3)
    got = Counter({tuple(int(x) for x in row[:3]): int(row[3]) for row in zip(*columns, numbers, strict=True)})
    assert got == Counter({(1, 2, 3): 2, (2, 3, 0): 2, (1, 2, 0): 1})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no benchmark tables")
def test_op12(spark):
    ok, message = oracle.compare(spark, oracle.duck("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op12_phrase_mining", queries.QUERIES["op12_phrase_mining"], queries.ORACLES["op12_phrase_mining"])
    assert ok, message


def test_blocks_cut_between_words_only(monkeypatch):
    monkeypatch.setattr(phrase_mining, "BLOCK", 16)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bcd", " ", "\n", "efghijklmnopqrstuvw"]) for _ in range(rng.randrange(60))).encode()
        parts = list(phrase_mining._blocks(text))
        assert b"".join(parts) == text
        assert all(p[:1] in (b" ", b"\n") for p in parts[1:])
        split = [t for p in parts for t in p.replace(b"\n", b" \n ").split(b" ") if t]
        assert split == [t for t in text.replace(b"\n", b" \n ").split(b" ") if t]


def test_leaves_pack_and_unpack():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 1000):
        table = rng.integers(0, 1 << 32, (6, n), dtype=np.uint64).astype(np.uint32)
        whole = np.concatenate([table, table], axis=1)
        assert (phrase_mining.unpacked(phrase_mining.packed(whole[:, :n]), 6, n) == table).all()


def test_looked_up_and_joined_vocabulary_give_the_same_sequences(spark):
    texts = [(1, "a b c. d é a", "en"), (2, "a b", None), (3, "x y", "de"), (4, None, "en"), (5, "", "fr"), (6, "b " * 50, "und")]
    batches = phrase_mining.coded(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    vocabulary = spark.createDataFrame([("en", "a", 1), ("en", "é", 2), ("und", "b", 3)], "lang string, word string, id long")
    kinds = []
    for shipped in (1 << 20, 0):
        rows = phrase_mining.sequences(batches, vocabulary, shipped).collect()
        kinds.append(sorted(tuple(np.frombuffer(r.words, np.uint32)) for r in rows if np.frombuffer(r.words, np.uint32).any()))
    assert kinds[0] == kinds[1] and sum(map(sum, kinds[0])) == 1 + 2 + 1 + 3 + 150
