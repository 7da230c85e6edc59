"""The registered queries on the smallest benchmark tables, against plain versions and held-out labels."""

import hashlib
import os
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanwise.llm import queries, quality_qda
from spanwise.llm.common import small_batches, table

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def rows(spark, name, folder=SF):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder).collect()}


def left(raw, flags):
    return bytes(b for b, f in zip(raw, flags, strict=True) if not f)


def test_op1(spark, texts):
    flags = brute.removed_bytes(texts)
    for d, r in rows(spark, "op1_suffix_dedup").items():
        raw = texts[d].encode()
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(raw), sum(flags[d]), hashlib.sha256(left(raw, flags[d])).hexdigest())


def test_op3(spark, texts):
    library, at, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, rows(spark, "op3_token_files")
    for d in sorted(texts):
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6(spark, texts):
    got = rows(spark, "op6_minhash_circulant")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.near_duplicates(texts)


def test_op9(spark, texts):
    library, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows(spark, "op9_bpe_segment_tree")
    for d, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(("name", "column", "at_least"), [("op7_quality_qda", "quality", 0.95), ("op8_toxicity_kn", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, column, at_least):
    marks = {r["doc_id"]: r[column] for r in table(spark, LARGER, "labels").collect()}
    held = [(r["predicted"], marks[d]) for d, r in rows(spark, name, LARGER).items() if r["held_out"] and d in marks]
    assert sum(a == b for a, b in held) >= at_least * len(held) > 0


def test_op4_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    held = [(r["lang_pred"], langs[d]) for d, r in rows(spark, "op4_language_hd").items() if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0


def passages(texts, items):
    return {(d, i) for d, t in texts.items() for i, x in items.items() if " ".join(x.split()) in " ".join(t.split())}


def test_op10(spark, texts):
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    got = queries.QUERIES["op10_template_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == passages(texts, items)


def test_pipeline(spark, texts):
    """Every stage worked out plainly on what the one before kept; only the scores come from the classifier."""
    small_batches(spark)
    docs = table(spark, SF, "documents")
    vectors = quality_qda.features(docs)
    scores = {r["doc_id"]: r["score"] for r in quality_qda.score(vectors, quality_qda.fit(vectors, table(spark, SF, "labels"))).collect()}
    kept = {d: t for d, t in texts.items() if scores[d] >= 0.3}
    groups = brute.near_duplicates(kept)
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    flags = brute.removed_bytes(kept)
    kept = {d: left(t.encode(), flags[d]).decode("utf-8", "ignore") for d, t in kept.items()}
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    bad = {d for d, _ in passages(kept, items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for d, t in kept.items() if d not in bad}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want
