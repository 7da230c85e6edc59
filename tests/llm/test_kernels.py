"""The in-task kernels against plain versions, without Spark."""

import random
import re
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanwise.llm import bpe_segment_tree, common, induced_sort, language_hd, license_minhash, minhash_circulant, suffix_dedup, template_decontamination, textstats, token_files

MESSY = ["", " ", "\n", "one", "a b c d", "a b c d e", "a b c d e f g", "Ä é 日本 🎉 x\u0085y z", "\x1c \x1d", "la la la la la la", "x" * 5000, "A\tB\vC\fD\rE\nF", "end\n\nend\n", "  lead", "trail  "]


def batch(texts):
    return common.text_bytes(pa.array(texts, pa.string()))


@pytest.fixture
def tiny_pieces(monkeypatch):
    for module in (common, textstats):
        monkeypatch.setattr(module, "PIECE", 16)


def test_words_are_found_and_hashed_alike_in_any_piece(tiny_pieces):
    texts = MESSY + [None, "same word same", "word same"]
    data, offsets = batch(texts)
    start, end, hashes = common.words(data, offsets)
    raw = data.tobytes()
    found = [raw[a:b] for a, b in zip(start, end, strict=True)]
    assert found == [w for t in texts for w in brute.WORD.findall((t or "").encode())]
    by_word = {}
    for w, h in zip(found, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_text_statistics(tiny_pieces):
    texts = MESSY + [None, "a b c\na b c\n#$ <x> | 1", "up UP up! up, up"]
    got = textstats.count(*batch(texts))
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(set(words)))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == want, t


def test_suffix_order_and_common_prefixes_in_memory_and_on_disk():
    rnd = random.Random(5)
    for _ in range(150):
        n, letters = rnd.randint(1, rnd.choice([5, 40, 200])), rnd.choice([1, 2, 4, 40])
        text = [rnd.randint(1, letters) for _ in range(n)]
        for _ in range(rnd.randint(0, 4)):
            text[rnd.randrange(n)] = 0
        text = text * rnd.choice([1, 1, 2])
        unlike = [i - 10**9 if c == 0 else c for i, c in enumerate(text)]
        order = sorted(range(len(text)), key=lambda i: unlike[i:])
        shared = [0]
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while max(a, b) + k < len(text) and unlike[a + k] == unlike[b + k]:
                k += 1
            shared.append(min(k, induced_sort.CAP))
        for memory in (1 << 20, 5):
            got = induced_sort.suffix_order(np.array(text, np.uint16), memory)
            assert got[0].tolist() == order and got[1].tolist() == shared


def test_equal_windows_belong_to_equal_anchors():
    rnd = random.Random(7)
    alphabet = ["ab", "b", "abc", " "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(60)) for _ in range(30)]
    data, offsets = batch(texts)
    start, size, anchor, _ = suffix_dedup.phrases(data, offsets, 20, 6)
    owner = {}
    for s, n, h in zip(start, size, anchor, strict=True):
        for w in range(s, s + n - 19):
            assert owner.setdefault(data[w : w + 20].tobytes(), h) == h
    windows = [t.encode()[i : i + 20] for t in texts for i in range(len(t.encode()) - 19)]
    assert sum(int(n) - 19 for n in size) == len(windows) and set(owner) == set(windows)


def test_circulant_signature_is_the_minimum_over_shifted_permutations():
    hashes = common.mix(np.arange(40, dtype=np.uint64))
    low = minhash_circulant.signature(hashes, 12)
    table = minhash_circulant._table(12, 7)
    sigma = common.mix(hashes + np.uint64(7)) >> np.uint64(64 - minhash_circulant.UNIVERSE_BITS)
    assert low.tolist() == [min(int(table[int(s) + k]) for s in sigma) for k in range(12)]


def test_signatures_estimate_similarity():
    a = common.mix(np.arange(0, 900, dtype=np.uint64))
    b = common.mix(np.arange(100, 1000, dtype=np.uint64))
    same = (minhash_circulant.signature(a, 128) == minhash_circulant.signature(b, 128)).mean()
    assert abs(same - 0.8) < 0.12


def test_shingles_match_the_plain_sets():
    texts = MESSY + [None, "A b C d E f", "a B c D e F"]
    _, _, bounds = minhash_circulant.shingles(*batch(texts))
    assert np.diff(bounds).tolist() == [len(brute.shingle_set(t)) for t in texts]


@pytest.fixture(scope="module")
def bytes_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_segment_tree_bpe_equals_the_library(bytes_library):
    own = bpe_segment_tree.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    texts = [t for t in MESSY] + ["a  b   c", " \n a", "<|endoftext|> x<|endoftext|>", "don't 's  's", "a" * 3000, "\n" * 40, "x\n y \n\n z"]
    texts += ["".join(rnd.choice("ab \n\t'.,1é日🎉<|") for _ in range(rnd.randint(1, 50))) for _ in range(600)]
    for t in texts:
        ids = bytes_library.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == ids, t
        assert own.decode(ids) == bytes_library.decode(ids, skip_special_tokens=False)


def test_word_pieces_equal_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rnd = Tokenizer.from_file(path), random.Random(2)
    texts = MESSY + ["<|endoftext|>x <|startoftext|>", "é ́x ΑΣ İ ſ"]
    texts += ["".join(rnd.choice("abAB \n\t'.,1é日🎉́Σ\x85\xa0\x1c<|") for _ in range(rnd.randint(1, 50))) for _ in range(600)]
    encoder = token_files.Encoder(path)
    for t, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, encoder.kind).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_trigram_counts_do_not_depend_on_the_span(monkeypatch):
    text = "Größe und Maß: Ünder the brídge, 12 x"
    whole = language_hd.trigrams(text)
    monkeypatch.setattr(language_hd, "SPAN", 5)
    cut = language_hd.trigrams(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()
    assert language_hd.trigrams("12 !?")[0].tolist() == []


def test_binding_depends_on_order_and_is_nearly_orthogonal():
    one, two = language_hd.bound(np.array([[97, 98, 99], [99, 98, 97]]), 1024, 11).astype(int)
    assert abs(int(one @ two)) < 200 and int(one @ one) == 1024


def test_canonical_words():
    text = "We paid Anna 12.50 dollars. Then 3 km to Bern!\nOK 7"
    _, token, slot = template_decontamination.canonical(*batch([text]))
    kinds = {int(template_decontamination.NUMBER): "#", int(template_decontamination.NAME): "N", int(template_decontamination.UNIT): "U"}
    assert "".join(kinds.get(int(t), ".") for t in token) == "..N#U.#U.N.#"
    assert [bool(s) for s in slot] == [k != "." for k in "..N#U.#U.N.#"]


def test_key_words_cover_every_template():
    for text in license_minhash.TEMPLATES.values():
        left = [s for s in license_minhash.template_shingles(text) if not set(license_minhash.key_words(text)) & set(s.split(" "))]
        assert len(left) < 0.75 * len(license_minhash.template_shingles(text))


def test_caches_are_bounded_in_bytes(monkeypatch):
    import sys

    monkeypatch.setattr(bpe_segment_tree, "CACHED", 1 << 20)
    bpe = bpe_segment_tree.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"w{i}x{i * 7}" for i in range(60_000)) + " " + "longest" * 5000
    assert bpe.decode(bpe.ids(text)) == text
    held = [c for c in (bpe.known, bpe.old)]
    assert sum(sys.getsizeof(c) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in c.items()) for c in held) < 3 << 20
    assert all(len(k) <= bpe_segment_tree.LONGEST for c in held for k in c)


def test_other_vocabularies_encode_whole():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.Encoder(public_tokenizers.path("word_bpe_49k.json")).cuts and not encoder.cuts
    library, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ["Two words, it's", "", "a  b\n"]
    assert [np.frombuffer(raw, encoder.kind).tolist() for raw in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_gaps_of_a_piece_list_are_found_in_order():
    from spanwise.llm.token_files import _gaps

    assert _gaps([]) == [] and _gaps([b""]) == []
    assert _gaps([None, b"a", b"", None, None]) == [0, 3, 4]
