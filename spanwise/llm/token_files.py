"""Token-id files: flat unsigned integers, 64-bit document offsets, read back through memory maps.

Format, one set per part, all little-endian:

- ``<part>.ids``: the ids of the part's documents one after the other, uint16 when every id of the
  vocabulary fits, else uint32;
- ``<part>.docs``: the doc_ids, int64 (a missing doc_id is the smallest int64);
- ``<part>.offsets``: uint64, one more than documents: where each document starts among the ids of *all*
  parts, and where the last one ends.

Documents are dealt over parts by ranges of doc_id and sorted inside. A task writes its files under a name
of its own attempt and returns one manifest row, so the files of a lost or repeated attempt are never read.
A part's base is the prefix sum of the id counts of the parts before it, taken over the manifest; offsets
are written once the bases are known. Executors reach the files through the file system of the folder's
own address; on a local or mounted one they are memory-mapped.

A text is cut at white space before the library encodes it, and a piece further between letters, digits and
marks where that is certain: this vocabulary drops white space and case, and no pretoken crosses such a
place, so parts can be remembered (bounded caches per task). Texts with the separators 0x1C-0x1F, on which
libraries differ, are encoded whole.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are written each, in
the order of their texts; rows without a doc_id come first; empty input writes nothing and gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import held
from spanwise.session import keep, run_folder

END_ID = 1
#: Bytes of one generation of the cache (the generation before it is kept as well), of one entry beside its text
#: and ids, and the length up to which a piece is remembered.
CACHED, ENTRY, LONGEST = 64 << 20, 170, 128
NO_ID = -(1 << 63)
#: The kind of vocabulary file whose texts may be cut into pieces; texts are encoded whole with any other.
NORMALIZERS = ["NFC", ("\\s+", " "), "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"
_DIFFER = re.compile("[\x1c-\x1f]")
_RUNS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")


def parts_of(piece: str) -> list[str]:
    """Strings that encode on their own to the ids of the piece: it holds no white space."""
    if piece.isascii():
        low = piece.lower()
        # Apostrophes and special strings have rules that look across marks.
        return [piece] if "'" in low or "<|" in low else _RUNS.findall(low)
    # Some letters become a letter and a mark, which would join the mark that follows.
    if piece[-1] in ".,;:!?" and unicodedata.normalize("NFC", piece[:-1]).lower().isalpha():
        return [piece[:-1], piece[-1]]
    return [piece]


def _gaps(values: list) -> list[int]:
    """The places of None."""
    places, at = [], -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        places.append(at)
    return places


def _place(folder: str, name: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, os.path.join(path, name)


def _read(folder: str, name: str, kind: str) -> np.ndarray:
    system, path = _place(folder, name)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _write(folder: str, name: str, values: np.ndarray) -> None:
    system, path = _place(folder, name)
    with system.open_output_stream(path) as f:
        f.write(values.tobytes())


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def _may_be_cut(spec: dict) -> bool:
    """Whether words of such a file never depend on what is beyond white space or a change of kind of character."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    found = [(n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in steps]
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    patterns = [c["pattern"].get("Regex") for c in cutters if c["type"] == "Split" and c["behavior"] == "Removed" and c["invert"]]
    levels = [c for c in cutters if c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"]]
    model = spec["model"]
    plain = not model.get("dropout") and not model.get("fuse_unk") and not model.get("continuing_subword_prefix")
    return found == NORMALIZERS and patterns == [PATTERN] and len(levels) == 1 and len(cutters) == 2 and model.get("end_of_word_suffix") == END_OF_WORD and plain


class Encoder:
    """The library's ids of whole texts, as bytes of the file's integer kind."""

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        self.kind = kind_of(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        words = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith(END_OF_WORD)]] = True
        self.cuts = _may_be_cut(json.loads(self.library.to_str()))
        self.code = "H" if self.kind == "<u2" else "I"

    def _whole(self, pieces: list[str]) -> Iterator[bytes]:
        for e in self.library.encode_batch_fast(pieces, add_special_tokens=False):
            ids = array(self.code, e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            yield ids.tobytes()

    def _fresh(self, parts: list[str]) -> list[bytes]:
        """The ids of strings without white space: many in one text, cut after each id that ends a word."""
        ids = np.array(self.library.encode(" ".join(parts), add_special_tokens=False).ids, self.kind)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            # Some string is more than one word.
            return list(self._whole(parts))
        raw, at = ids.tobytes(), (np.append(0, ends) * ids.itemsize).tolist()
        return [raw[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHED:
            self.old, self.known, self.held = self.known, {}, 0
        known, old = self.known, self.old
        out, fresh, open_texts = [], set(), []
        for i, t in enumerate(texts):
            if not self.cuts or _DIFFER.search(t):
                out.append(next(self._whole([t])))
                continue
            own = t.split()
            got = list(map(known.get, own))
            places = _gaps(got)
            if places:
                # Only the gaps are looked at again; a second lookup of every piece would cost as much as the first.
                missing = [own[j] for j in places]
                fresh.update(missing)
                open_texts.append((i, got, places, missing))
            out.append(None if places else b"".join(got))
        cuts = {}
        for p in fresh:
            if p in old:
                known[p] = old[p]
            else:
                cuts[p] = parts_of(p)
        single = {q for own in cuts.values() if len(own) == 1 and not own[0].isascii() for q in own}
        new = {q for own in cuts.values() for q in own if q not in known}
        # Strings of other scripts or with apostrophes may be several words; they are encoded one by one.
        odd = [q for q in new if q in single or "'" in q or "<" in q or not q.isalpha()]
        plain = list(new.difference(odd))
        made = dict(zip(odd, self._whole(odd), strict=True))
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            made.update(zip(some, self._fresh(some), strict=True))
        short = {q: v for q, v in made.items() if len(q) <= LONGEST}
        known.update(short)
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY * len(short)
        long = {}
        for p, own in cuts.items():
            if p not in known:
                ids = b"".join([made[q] if q in made else known[q] for q in own])
                if len(p) <= LONGEST:
                    known[p] = ids
                    self.held += ENTRY + len(p) + len(ids)
                else:
                    long[p] = ids
        for i, got, places, missing in open_texts:
            for j, p in zip(places, missing, strict=True):
                got[j] = known[p] if p in known else long[p]
            out[i] = b"".join(got)
        return out


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process, so that what it remembers serves the next task too."""
    return held(("encoder", path), lambda: Encoder(path))


@lru_cache(4)
def kind_of(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def write(docs: DataFrame, vocabulary: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all files; the manifest: folder, part, first_doc, n_docs, n_ids, base."""
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, out, ids, lengths = None, None, [], []
        for batch in batches:
            if not len(batch):
                continue
            if encoder is None:
                encoder = encoder_of(vocabulary)
                end = np.array([end_id], encoder.kind).tobytes()
                width = np.dtype(encoder.kind).itemsize
                system, path = _place(folder, part + ".ids")
                system.create_dir(os.path.dirname(path), recursive=True)
                out = system.open_output_stream(path)
            texts = batch.column("text").to_pylist()
            # Nothing here is cyclic; the collector would only walk the words of a text again and again.
            gc.disable()
            for k in range(0, len(texts), 500):
                for raw in encoder.encode([t or "" for t in texts[k : k + 500]]):
                    out.write(raw + end)
                    lengths.append(len(raw) // width + 1)
            gc.enable()
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
        if out is not None:
            out.close()
            names = np.concatenate(ids).astype("<i8")
            _write(folder, part + ".docs", names)
            _write(folder, part + ".lengths", np.array(lengths, "<u8"))
            yield pa.RecordBatch.from_pylist([{"folder": folder, "part": part, "first_doc": int(names[0]), "n_docs": len(names), "n_ids": int(sum(lengths))}])

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    schema = "folder string, part string, first_doc bigint, n_docs bigint, n_ids bigint"
    manifest = keep(ordered.mapInArrow(run, schema), "token-manifest")
    # One row per file: the window is as small as a directory listing.
    before = Window.orderBy("first_doc", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def finish(manifest: DataFrame) -> DataFrame:
    """Write each part's global offsets from its base; one row per part. Repeating it writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = _read(row["folder"], row["part"] + ".lengths", "<u8")
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(row["base"])
                _write(row["folder"], row["part"] + ".offsets", offsets)
            yield batch

    files = manifest.count()
    spread = manifest.repartition(max(1, min(files, 10_000)), "part")
    return keep(spread.mapInArrow(run, manifest.schema), "token-parts")


def read(parts: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start, ids in _documents(batches, vocabulary):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([start]), pa.array([len(ids)], pa.int64()), pa.array([ids.astype(np.int64)])], ["doc_id", "start", "n_tokens", "ids"])

    return parts.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>")


def _documents(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    kind = kind_of(vocabulary)
    for batch in batches:
        for row in batch.to_pylist():
            names, offsets, ids = (_read(row["folder"], f"{row['part']}.{x}", k) for x, k in (("docs", "<i8"), ("offsets", "<u8"), ("ids", kind)))
            local = (offsets - offsets[0]).astype(np.int64)
            for i, name in enumerate(names.tolist()):
                yield None if name == NO_ID else name, int(offsets[i]), ids[local[i] : local[i + 1]]


def checksums(parts: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian uint32, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for name, start, ids in _documents(batches, vocabulary):
            rows.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if len(rows) == 10_000:
                yield _table(rows)
                rows = []
        yield _table(rows)

    return parts.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
