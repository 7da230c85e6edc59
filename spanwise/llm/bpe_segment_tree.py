"""Byte-level BPE encoding and decoding, merging through a segment tree over adjacent pair ranks.

The leaves of the tree hold (rank, position) of every adjacent pair of a pretoken; the root is the
leftmost pair of lowest rank. A merge rewrites at most three leaves, each in a logarithmic number of
steps, until the root says that no pair can merge. A pretoken of n bytes costs O(n log n), so a text
without white space is no special case.

Texts are cut where a single space is next to a character that is not white space; no pretoken crosses
such a place, so the pieces are encoded on their own. Pieces and pretokens of up to ``LONGEST`` characters are
remembered in one cache with their ids in packed form; it is bounded in bytes (``CACHED`` a generation, two
generations), whatever a text holds. Longer pieces are encoded each time, with the same ids. Very long texts are
encoded whole; memory follows the text.

Defined results: a null text is the empty text (no ids, empty decoded text); the added token's own
string inside a text becomes its single id, as the tokenizer file says; repeated rows are each encoded;
null doc_ids pass through; empty input gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanwise.llm.common import held

#: Fixed value: how this kind of vocabulary cuts a text into pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of one generation of the cache (the generation before it is kept as well), of one entry beside its text
#: and ids, and the length up to which a piece is remembered.
CACHED, ENTRY, LONGEST = 48 << 20, 170, 128
_NONE = 1 << 62
_SHIFT = 32
_PLACE = (1 << _SHIFT) - 1
_SPACES_TOUCH = re.compile(r"\s \s")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


class Bpe:
    """A vocabulary file and a bounded cache of pieces already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.special = regex.compile("|".join(sorted(map(regex.escape, added), key=len, reverse=True))) if added else None
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added} | {i: t.encode() for t, i in added.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        # A pair of ids, packed, has a rank (shifted, so that a position fits below it); a rank has a merged id.
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << _SHIFT | vocab[right]] = rank << _SHIFT
            self.merged.append(vocab[left + right])
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def merge(self, raw: bytes) -> bytes:
        """The packed ids of one pretoken."""
        ids = [self.byte_id[b] for b in raw]
        n = len(ids)
        if n < 2:
            return array("I", ids).tobytes()
        rank, merged, pairs = self.ranks.get, self.merged, n - 1
        size = 1 << (pairs - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(pairs):
            tree[size + i] = rank(ids[i] << _SHIFT | ids[i + 1], _NONE) | i
        for k in range(size - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x < y else y
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) < _NONE:
            i = root & _PLACE
            j = after[i]
            ids[i], ids[j] = merged[root >> _SHIFT], -1
            k = after[i] = after[j]
            # The leaves of the merged pair, of the pair it ends and of the pair before it; then their ancestors.
            a = b = c = size + i
            if k < n:
                before[k] = i
                tree[b] = rank(ids[i] << _SHIFT | ids[k], _NONE) | i
            else:
                tree[b] = _NONE
            if j < pairs:
                c = size + j
                tree[c] = _NONE
            h = before[i]
            if h >= 0:
                a = size + h
                tree[a] = rank(ids[h] << _SHIFT | ids[i], _NONE) | h
            while a > 1:
                a >>= 1
                b >>= 1
                c >>= 1
                x, y = tree[2 * a], tree[2 * a + 1]
                tree[a] = x if x < y else y
                if b != a:
                    x, y = tree[2 * b], tree[2 * b + 1]
                    tree[b] = x if x < y else y
                if c != b:
                    x, y = tree[2 * c], tree[2 * c + 1]
                    tree[c] = x if x < y else y
        return array("I", [t for t in ids if t >= 0]).tobytes()

    def _remembered(self, text: str, make: Callable[[str], bytes]) -> bytes:
        out = self.known.get(text)
        if out is None:
            out = self.old.get(text) or make(text)
            if len(text) <= LONGEST:
                self.known[text] = out
                self.held += ENTRY + len(text) + len(out)
                if self.held > CACHED:
                    self.old, self.known, self.held = self.known, {}, 0
        return out

    def _pretoken(self, text: str) -> bytes:
        return self.merge(text.encode())

    def _pieced(self, text: str) -> bytes:
        tokens = self.pattern.findall(text)
        if len(tokens) == 1:
            return self.merge(text.encode())
        return b"".join([self.known.get(t) or self._remembered(t, self._pretoken) for t in tokens])

    def piece(self, text: str) -> bytes:
        """The packed ids of a piece."""
        return self._remembered(text, self._pieced)

    def _ordinary(self, text: str, out: list[bytes]) -> None:
        # The cache may start a new generation meanwhile; what is known here then still holds.
        known, piece = self.known, self.piece
        if _SPACES_TOUCH.search(text):
            cuts = regex.split(r"(?<=\S) | (?=\S)", text)
            # The split eats the space it stands at; put it back in front of what follows.
            out.extend(known.get(x) or piece(x) for x in [cuts[0], *(" " + c for c in cuts[1:])] if x)
            return
        first, *rest = text.split(" ")
        if first:
            out.append(known.get(first) or piece(first))
        for c in rest:
            c = " " + c
            out.append(known.get(c) or piece(c))

    def ids(self, text: str) -> list[int]:
        """The ids of a whole text; special strings are one id each."""
        out: list[bytes] = []
        if self.special is None or not self.special.search(text):
            self._ordinary(text, out)
        else:
            at = 0
            for m in self.special.finditer(text):
                if m.start() > at:
                    self._ordinary(text[at : m.start()], out)
                out.append(array("I", [self.added[m[0]]]).tobytes())
                at = m.end()
            if at < len(text):
                self._ordinary(text[at:], out)
        return array("I", b"".join(out)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def vocabulary(path: str) -> Bpe:
    """One vocabulary per worker process, so that what it remembers serves the next task too."""
    return held(("bpe", path), lambda: Bpe(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = [bpe.ids(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids])], ["doc_id", "ids", "decoded"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [])
            decimal = bpe.decimal.__getitem__
            for text in batch.column("text"):
                ids = bpe.ids(text.as_py() or "")
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                rows[2].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


