"""Every operator and stage on small messy tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanwise.llm import (
    bpe_segment_tree, components, language_hd, license_minhash, minhash_circulant, quality_qda, quality_sketch, suffix_dedup,
    template_decontamination, token_files, toxicity_kn,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("score", "predicted", "held_out", "label", "node", "bucket", "component_id", "kept", "doc", "tie", "at", "gone", "ids", "key", "word", "n", "x", "__doc")


def prose(seed: int, n: int, letters: str = "abcdefgh") -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def rows():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["zzz"] + words[61:])
    far = " ".join(words[:60]) + " " + prose(2, 60)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, far, None, "a", None),
        (5, None, "en", None, None), (6, "", "de", "a", 0), (7, " \n\t ", None, None, 3), (8, "one two", "de", "b", 7), (9, "One TWO", "de", "b", 7),
        (10, prose(3, 3000), "de", "a", 1), (11, "ab" * 4000, "de", "c", 8000), (12, prose(4, 80, "éüßñ日") + " 🎉", "de", "c", 1),
        (13, "x" + base[5:400] + "é", "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None), (14, prose(5, 70), "en", "a", 1), (14, prose(5, 70), "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return frame.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0)) for i in range(1, 15)] + [(1, 0, 0), (None, 1, 1), (8, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int"
    )


def known():
    return {d: t for d, t, *_ in rows() if d is not None}


def test_near_duplicates(spark, docs, empty):
    got = minhash_circulant.near_duplicates(docs).collect()
    want = brute.near_duplicates(known())
    own = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in own.items()} == want
    assert all(r["kept"] == (r["component_id"] == d) for d, r in own.items())
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert len(got) == len(want) + 2
    assert minhash_circulant.near_duplicates(empty).collect() == []


def test_a_hot_group_in_small_blocks(spark, monkeypatch):
    """Chains of near copies that no leader links directly, with blocks and parts of a few nodes."""
    monkeypatch.setattr(minhash_circulant, "BLOCK", 3)
    monkeypatch.setattr(minhash_circulant, "PART", 2)
    monkeypatch.setattr(minhash_circulant, "STAR_ROUNDS", 1)
    words, texts = prose(11, 100).split(" "), {}
    for i in range(24):
        words[3 * i % 100] = f"new{i}"
        texts[100 - i] = " ".join(words)
    frame = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_circulant.near_duplicates(frame).collect()}
    assert got == brute.near_duplicates(texts)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 9), (20, 21), (21, 22), (20, 22), (30, 31), (30, 31)]
    got = {r["node"]: r["component_id"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 2, 9: 2, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("memory", [1 << 22, 64])
def test_suffix_dedup(spark, docs, empty, memory):
    gone = suffix_dedup.repeats(docs, shard_bytes=2000, memory=memory)
    got = suffix_dedup.spans(docs, gone).collect()
    order = {-1: rows()[0][1]} | known()
    want = brute.removed_bytes(order)
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            continue
        raw, flags = (known()[r["doc_id"]] or "").encode(), want[r["doc_id"]]
        left = bytes(b for b, f in zip(raw, flags, strict=True) if not f)
        runs = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(flags), runs, hashlib.sha256(left).hexdigest()), r["doc_id"]
    assert sorted(r["n_removed"] for r in got if r["doc_id"] is None) == [0, 0]
    assert suffix_dedup.spans(empty, suffix_dedup.repeats(empty)).collect() == []


def test_a_repeated_row_that_shares_a_passage(spark):
    """Rows of one document are no later copies of each other, also where another document opens its anchors."""
    passage = prose(21, 60)
    texts = {1: prose(22, 40) + passage + prose(23, 40), 2: prose(24, 40) + passage + prose(25, 40)}
    frame = spark.createDataFrame([(1, texts[1]), (2, texts[2]), (1, texts[1]), (2, texts[2])], "doc_id bigint, text string").repartition(4)
    want = {d: sum(flags) for d, flags in brute.removed_bytes(texts).items()}
    got = suffix_dedup.spans(frame, suffix_dedup.repeats(frame, shard_bytes=2000)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == sorted([*want.items()] * 2) and want[2] > 0


def test_a_hot_line_between_other_neighbours(spark, monkeypatch):
    """No shard gets the contexts of a line that is in every document; windows longer than the line are still found."""
    lines, shards = (prose(41, 16)[:70], prose(42, 30)[:120]), []
    texts = {d: f"{prose(500 + d, 40)}\n{lines[d % 2]}\n{prose(500 + d - d % 5, 40)}" for d in range(60)}
    frame = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    sort = suffix_dedup._sorted_shards
    monkeypatch.setattr(suffix_dedup, "_sorted_shards", lambda contexts, *rest: (shards.append(contexts.groupBy("shard").agg(F.sum(F.length("context"))).collect()), sort(contexts, *rest))[1])
    got = suffix_dedup.spans(frame, suffix_dedup.repeats(frame, shard_bytes=4000)).collect()
    want = brute.removed_bytes(texts)
    for r in got:
        raw, flags = texts[r["doc_id"]].encode(), want[r["doc_id"]]
        assert (r["n_removed"], r["kept_sha256"]) == (sum(flags), hashlib.sha256(bytes(b for b, f in zip(raw, flags, strict=True) if not f)).hexdigest()), r["doc_id"]
    assert max((size for _, size in shards[0]), default=0) <= 4000


def test_text_without_repeats_keeps_columns(spark, docs):
    out = suffix_dedup.without_repeats(docs, suffix_dedup.repeats(docs))
    assert out.columns == docs.columns
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[2]["text"] is None or by_id[2]["text"] == ""
    assert by_id[5]["text"] is None and by_id[8]["n_chars"] == 7 and by_id[13]["n_chars"] == len(by_id[13]["text"])


def test_columns_of_any_name_pass_with_their_values(spark):
    names = ("__doc", "__tie", "__gone", "__left", "row", "doc", "tie", "gone", "left", "a.b")
    same = prose(61, 60)
    frame = spark.createDataFrame([(1, same, 9), (2, f"x {same}", 9), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    frame = frame.withColumns({f"{c}": F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    out = suffix_dedup.without_repeats(frame, suffix_dedup.repeats(frame))
    assert out.columns == frame.columns and dict(out.dtypes) == dict(frame.dtypes)
    got = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert {d: (r["text"], r["n_chars"]) for d, r in got.items()} == {1: (same, 9), 2: ("x ", 2), 3: (None, None)}
    assert all(r[c] == f"{c} of {d}" for d, r in got.items() for c in names)


@pytest.mark.parametrize("length", [100, 130, 260])
def test_repeats_of_any_length(spark, length):
    """Common prefixes reach as far as the length asked for."""
    same = prose(62, 90)[:350]
    texts = {d: f"{prose(700 + d, 8)}{same}{prose(800 + d, 8)}" for d in range(6)} | {7: same[:length], 8: same[5 : length + 4], 9: same[:200] + "!" + same[200:]}
    frame = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.spans(frame, suffix_dedup.repeats(frame, length)).collect()}
    want = {d: sum(flags) for d, flags in brute.removed_bytes(texts, length).items()}
    assert got == want


def test_quality_rules(spark, docs, empty):
    got = quality_sketch.quality_rules(docs).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["n_words"] == 0 and by_id[5]["base_failed"] and not by_id[5]["kept"]
    assert by_id[1]["kept"] and by_id[10]["kept"] and by_id[4]["kept"]
    assert quality_sketch.quality_rules(empty).collect() == []


def test_fences_follow_their_group(spark):
    """Marks are ordinary in one source and break the rule in another."""
    texts = [(i, " ".join(f"w{i}x{k}" + ("" if i % 4 else "#") for k in range(60)), "en", "news" if i % 4 else "code") for i in range(400)]
    texts += [(1000, texts[0][1].replace("w0x", "v9y"), "en", "news")]
    got = {r["doc_id"]: r for r in quality_sketch.quality_rules(spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[1]["kept"] and got[0]["kept"] and got[1000]["broken"] == ["symbol_share"]


def test_quality_classifier(spark, docs, labels, empty):
    vectors = quality_qda.features(docs)
    got = quality_qda.score(vectors, quality_qda.fit(vectors, labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    one = quality_qda.fit(vectors, labels.where("quality = 1"))
    assert len({r["score"] for r in quality_qda.score(vectors, one).collect()}) == 1
    assert quality_qda.score(vectors, quality_qda.fit(vectors, labels.where("false"))).first()["score"] == 0.5
    assert quality_qda.score(quality_qda.features(empty), one).collect() == []
    assert quality_qda.accepted(docs, one).columns == docs.columns


def test_language(spark, docs, empty):
    model = language_hd.prototypes(docs)
    got = {r["doc_id"]: r for r in language_hd.predict(docs, *model).collect()}
    assert model[0] == ["de", "en"]
    assert [got[d]["lang_pred"] for d in (1, 3, 5, 6, 7, 12)] == ["en", "en", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_hd.prototypes(empty)
    assert none[0] == [] and {r["lang_pred"] for r in language_hd.predict(docs, *none).collect()} == {"und"}
    assert language_hd.predict(empty, *model).collect() == []


def test_toxicity(spark, docs, labels, empty):
    texts = [(i, prose(i, 60) + (" vile%s vile%s" % (i % 7, i % 5) if i % 3 == 0 else ""), None, None, 1) for i in range(240)]
    many = spark.createDataFrame(texts, SCHEMA)
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int")
    model = toxicity_kn.fit(many, marks)
    got = toxicity_kn.score(many, model).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) >= 0.8 * len(held) > 20
    messy = toxicity_kn.score(docs, model).collect()
    assert len(messy) == len(rows()) and all(0 <= r["score"] <= 1 for r in messy)
    assert len({r["score"] for r in messy if r["doc_id"] in (5, 6, 7)}) == 1
    assert toxicity_kn.score(empty, model).collect() == []
    assert len({r["score"] for r in toxicity_kn.score(docs, toxicity_kn.fit(docs, labels.where("toxic = 1"))).collect()}) == 1
    toxicity_kn.fit(docs, labels)


def test_toxicity_learns_from_every_label(spark):
    """Ten ordinary texts to one toxic: words of most ordinary texts only teach as well (a sample would miss them)."""
    texts = [(k, f"vile filth common {'abcdefghij'[k % 10] * 3}" if k < 200 else f"common {'klmnopqrst'[k % 10] * 4}") for k in range(2200)]
    many = spark.createDataFrame(texts, "doc_id long, text string")
    marks = many.selectExpr("doc_id", "int(doc_id < 200) as toxic")
    chosen = toxicity_kn.teaching_labels(marks, "toxic")
    teach = {r["doc_id"]: r["aside"] for r in chosen.collect()}
    usable = toxicity_kn.usable_labels(marks, "toxic")
    assert len(teach) == usable.count() > 1600
    counts = {r["word"]: (r["toxic"], r["ordinary"]) for r in toxicity_kn.word_counts(many, chosen).collect()}
    assert counts["common"] == tuple(sum(not aside and (k < 200) == toxic for k, aside in teach.items()) for toxic in (True, False))
    model = toxicity_kn.fit(many, marks)
    n1, n0 = counts["common"]
    # Whole-class counts, weighed down to the size of the smaller class.
    assert model.gram_counts[:, 1].max() == pytest.approx(n1, rel=1e-5) and n0 > 5 * n1
    got = {r["doc_id"]: r["score"] for r in toxicity_kn.score(many, model).collect()}
    assert min(got[k] for k in range(200)) > 0.5 > max(got[k] for k in range(200, 2200))
    assert {r["doc_id"]: r["score"] for r in toxicity_kn.fit_score(many, marks).collect()} == pytest.approx(got)


def test_toxicity_counts_every_gram(spark, docs):
    """No gram is left out, however rare; more grams than tasks may hold are joined, with the same evidence for odd rows too."""
    texts = [(i, prose(i, 30) + (f" vile{i % 7} rare{'klmnopqrstuvw'[i % 13] * (1 + i % 4)}" if i % 3 == 0 else "")) for i in range(120)]
    many = spark.createDataFrame(texts, "doc_id long, text string")
    marks = many.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic")
    teach = {r["doc_id"] for r in toxicity_kn.teaching_labels(marks, "toxic").where("not aside").collect()}
    words = {toxicity_kn.expression(c) for i, t in texts if i in teach for c in t.lower().split()}
    spelled = {f"\x01{w}\x02" for w in words}
    model = toxicity_kn.fit(many, marks)
    assert len(model.grams) == len({w[k - n : k] for w in spelled for n in toxicity_kn.ORDERS for k in range(n, len(w) + 1)})
    joined = toxicity_kn.fit(many, marks, max_grams=10)
    assert joined.tables is not None and len(joined.grams) == 0
    assert (joined.bias, joined.slope) == pytest.approx((model.bias, model.slope), rel=1e-3)
    odd = docs.select("doc_id", "text").unionByName(many).unionByName(many.where("doc_id < 3"))
    rank = lambda m: sorted((r["doc_id"] or -1, r["evidence"]) for r in toxicity_kn.with_evidence(odd, m).collect())
    want, got = rank(model), rank(joined)
    assert [d for d, _ in got] == [d for d, _ in want] and [e for _, e in got] == pytest.approx([e for _, e in want], rel=1e-4, abs=1e-4)
    scores = {r["doc_id"]: r["score"] for r in toxicity_kn.fit_score(many, marks, max_grams=10).collect()}
    assert scores == pytest.approx({r["doc_id"]: r["score"] for r in toxicity_kn.score(many, joined).collect()})



def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    parts = token_files.finish(token_files.write(docs, path))
    got = token_files.read(parts, path).collect()
    sums = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_files.checksums(parts, path).collect()}
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for d, t, *_ in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, ids))
        assert sums[d, at] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["ids"]) for r in got), key=lambda r: r[1]) == want
    assert token_files.checksums(token_files.finish(token_files.write(empty, path)), path).collect() == []


def test_bpe_round_trip(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = {d: t or "" for d, t, *_ in rows() if d is not None}
    for r in bpe_segment_tree.encoded(docs, path).where("doc_id is not null").collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == texts[r["doc_id"]]
    for r in bpe_segment_tree.digests(docs, path).where("doc_id is not null").collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), texts[r["doc_id"]])]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *digest]
    assert bpe_segment_tree.digests(empty, path).collect() == []


def test_licences(spark, docs, empty):
    long = license_minhash.TEMPLATES["mit-grant"]
    broken = long.replace("charge", "cost")
    texts = [(1, f"{prose(1, 40)}\n{long}, and so on. {prose(2, 50)}"), (2, prose(3, 30) + " Released  under the MIT-License! " + prose(4, 9)), (3, broken), (4, "released under license"),
             (5, None), (6, ""), (None, long), (7, "Licensed under CC BY-NC 4.0."), (7, "nothing here"), (8, " ".join(long.split(" ")[:12]))]
    got = {(r["doc_id"], r["template"], round(r["containment"], 2)) for r in license_minhash.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {(1, "mit-grant", 1.0), (2, "mit-notice", 1.0), (3, "mit-grant", 0.78), (7, "cc-by-nc-4.0-notice", 1.0)}
    assert license_minhash.scan(docs).collect() == [] and license_minhash.scan(empty).collect() == []
    assert license_minhash.scan(docs, {}).collect() == []


def test_decontamination(spark, docs, empty):
    item = "On monday the baker Anna sold 12 loaves for 3 dollars each and then Anna paid 7 dollars for flour so how much money is left at the end of the day"
    other = item.replace("12", "40").replace("7 d", "9 d").replace("Anna", "Bruno")
    crossed = item.replace("Anna sold", "Bruno sold").replace("12", "40")
    texts = [(1, prose(1, 30) + ". " + item + " " + prose(2, 10)), (2, other), (3, prose(3, 80)), (4, None), (5, ""), (None, item), (6, " ".join(item.split(" ")[:11])), (7, crossed)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, prose(9, 6))], "item_id bigint, text string")
    for filter_max in (1_000_000, 0):
        got = {r["doc_id"]: (r["item_id"], r["kind"]) for r in template_decontamination.matches(frame, items, filter_max=filter_max).collect()}
        assert {d: got.get(d) for d in (1, 2, 3, 4, 5, 6)} == {1: (1, "verbatim"), 2: (1, "reparameterised"), 3: None, 4: None, 5: None, 6: None}
    assert {r["doc_id"] for r in template_decontamination.clean(frame, items).collect()} >= {3, 4, 5, None}
    assert template_decontamination.clean(docs, items).count() == len(rows())
    assert template_decontamination.matches(empty, items).collect() == [] and template_decontamination.matches(docs, empty.selectExpr("doc_id item_id", "text")).collect() == []


def test_short_and_wordless_items_inside_documents(spark):
    """Items below a window, and items of names and numbers, stand in ordinary documents; their parts and likes do not count."""
    items = {1: "17 + 25 = 42", 2: "Ada Bela Cora Dora Emma Fred Gina Hans Ines Jan Kurt Lena", 3: "what do red apples cost", 4: "42 17"}
    around = lambda seed, x: f"{prose(seed, 30)} {x} {prose(seed + 1, 30)}"
    texts = {d: around(30 + 2 * d, x) for d, x in items.items()}
    texts |= {11: "17", 12: "Ada Bela Cora Dora Emma Fred Gina Hans", 13: around(60, "Otto Bela Cora Olga Emma Paul Gina Hans Rosa Jan Kurt Lena"), 14: around(62, "18 + 25 = 43"), 15: prose(64, 5)}
    frame = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([*items.items()], "item_id bigint, text string")
    for filter_max in (1_000_000, 0):
        got = {(r["doc_id"], r["item_id"], r["kind"]) for r in template_decontamination.matches(frame, bench, filter_max=filter_max).collect()}
        assert {x for x in got if x[0] != 12} == {(d, d, "verbatim") for d in items}
    short = {r["doc_id"]: r["coverage"] for r in template_decontamination.matches(frame, bench).where("item_id = 2").collect()}
    assert short[2] == 1 and short.get(12, 0) < 1


def test_items_of_one_word_sentence_starts_and_capitals(spark):
    """One word is no evidence, an excerpt from an item's start is found inside a sentence, and capitals hide nothing."""
    item = "A train leaves the old station at noon with 12 heavy cars and the driver Anna must cross 3 long bridges before her evening meal with Bruno"
    loud = "THE TALL SHIP CARRIED SEVEN BARRELS OF SALT ACROSS THE NARROW STRAIT WHILE THE CAPTAIN SLEPT BELOW"
    named = "Anna gave each of her quiet neighbours two small baskets of ripe plums and asked for nothing back"
    items = {1: item, 2: "the", 3: "42", 4: loud, 5: named}
    start = " ".join(item.split(" ")[:13])
    texts = {
        11: f"{prose(71, 20)} the {prose(72, 20)} 42", 12: f"{prose(73, 20)} and {start} {prose(74, 20)}", 13: item.upper(),
        14: f"{prose(75, 20)} {item.upper()} {prose(76, 20)}", 15: f"{prose(77, 20)}\n{loud.lower()}\n{prose(78, 20)}", 16: " The ", 17: "42 42",
        18: f"{prose(79, 20)} {named.replace('Anna', 'Bruno')} {prose(80, 20)}", 19: f"{prose(81, 20)}. {named.replace('Anna', 'Bruno')}", 20: loud.capitalize(), 21: prose(82, 40).upper(),
    }
    frame = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([*items.items()], "item_id bigint, text string")
    want = {(12, 1, "verbatim"), (13, 1, "verbatim"), (14, 1, "verbatim"), (15, 4, "verbatim"), (16, 2, "verbatim"), (18, 5, "reparameterised"), (19, 5, "verbatim"), (20, 4, "verbatim")}
    for filter_max in (1_000_000, 0):
        got = {(r["doc_id"], r["item_id"], r["kind"]) for r in template_decontamination.matches(frame, bench, filter_max=filter_max).collect()}
        assert {x[:2] for x in got} == {x[:2] for x in want}
        assert {x for x in got if x[0] not in (18, 19)} == {x for x in want if x[0] not in (18, 19)}
    assert {r["doc_id"] for r in template_decontamination.clean(frame, bench).collect()} == {11, 17, 21}


def test_several_copies_of_one_item(spark):
    """Copies with other slot values are judged one by one, however many a document holds."""
    item = "On monday the baker Anna sold 12 loaves for 3 dollars each and then Anna paid 7 dollars for flour so how much money is left at the end of the day"
    like = lambda name, a, b, c: item.replace("Anna", name).replace("12", a).replace("for 3", f"for {b}").replace("paid 7", f"paid {c}")
    copies = [like("Bruno", "40", "5", "9"), like("Carla", "41", "6", "8"), like("Dora", "9", "40", "5"), like("Emil", "5", "9", "40"), like("Gina", "6", "41", "12")]
    texts = [(1, ". ".join(copies)), (2, f"{copies[0]}. {item}"), (3, ". ".join(copies * 3))]
    frame, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["coverage"], r["kind"]) for r in template_decontamination.matches(frame, bench).collect()}
    assert got == {1: (1, "reparameterised"), 2: (1, "verbatim"), 3: (1, "reparameterised")}


def test_changed_words_and_excerpts(spark):
    """One changed ordinary word anywhere in an item of 12 to 22 words, and excerpts of 13 words, are found; 12 words of 31 are not."""
    items = {n: prose(100 + n, n) for n in (*range(12, 23), 31)}
    texts, want = [], set()
    for n, item in items.items():
        own = item.split(" ")
        for k in range(n):
            texts.append((n * 100 + k, f"{prose(7, 20)} {' '.join([*own[:k], 'zzz', *own[k + 1 :]])} {prose(8, 20)}"))
            want.add((n * 100 + k, n))
    own = items[31].split(" ")
    texts += [(1, f"{prose(7, 20)} {' '.join(own[9:22])} {prose(8, 20)}"), (2, f"{prose(7, 20)} {' '.join(own[9:21])} {prose(8, 20)}")]
    frame, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([*items.items()], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in template_decontamination.matches(frame, bench).collect()} == want | {(1, 31)}


def test_stages_on_messy_and_empty_documents(spark, docs, empty, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(50, 30))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, empty):
            out = stage(spark, frame, folder)
            assert out.columns == frame.columns, name
            assert out.count() <= frame.count()
    assert corpus_pipeline.tokens(spark, docs, folder).count() == len(rows())
    assert corpus_pipeline.tokens(spark, empty, folder).count() == 0
