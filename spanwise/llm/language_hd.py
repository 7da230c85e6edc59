"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product (binding) of its letters'
vectors, permuted (rotated) by their place; a text bundles its trigrams into one sum; a language's
prototype bundles the normalised vectors of its training texts, less the mean of all prototypes. The
answer is the prototype with the highest cosine.

Letters are lower-cased; everything else counts as one boundary sign, so the trigrams hold word starts
and ends. Distinct trigrams of a batch are bound once and multiplied with their counts, in blocks, so
memory does not follow the text.

Defined results: a null text or one without a letter is ``und`` with score 0; rows whose lang or doc_id
is null teach nothing; equal cosines go to the alphabetically first language; with no training rows
every text is ``und`` with score 0; repeated rows are each predicted and each teach; empty input gives
no rows; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import held_out, mix

DIMENSIONS = 1024
GRAM = 3
BLOCK = 2048
#: Characters looked at together.
SPAN = 1 << 18
_BOUNDARY = 0


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(1 << 16)
def _letter(code: int, dimensions: int, seed: int) -> np.ndarray:
    words = mix(np.arange(dimensions // 64, dtype=np.uint64) + np.uint64((code * 0x9E3779B97F4A7C15 + seed) % (1 << 64)))
    bits = np.unpackbits(words.view(np.uint8))
    return (bits.astype(np.int8) << 1) - 1


def bound(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vector of each trigram (one row of GRAM code points each)."""
    out = None
    for place in range(GRAM):
        codes, at = np.unique(grams[:, place], return_inverse=True)
        table = np.stack([np.roll(_letter(int(c), dimensions, seed), GRAM - 1 - place) for c in codes])
        out = table[at] if out is None else out * table[at]
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text (packed code points, 21 bits each) and their counts."""
    keys, counts = [], []
    for at in range(0, len(text), SPAN):
        # A piece starts two characters early, so that no trigram is lost at a seam.
        codes = np.frombuffer(text[max(0, at - 2) : at + SPAN].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter()[codes]
        codes = np.where(letter, codes, _BOUNDARY)
        if at == 0:
            codes, letter = np.concatenate([[_BOUNDARY], codes]), np.concatenate([[False], letter])
        if at + SPAN >= len(text):
            codes, letter = np.concatenate([codes, [_BOUNDARY]]), np.concatenate([letter, [False]])
        if len(codes) < GRAM:
            continue
        codes = codes.astype(np.int64)
        use = letter[1:-1]
        found, n = np.unique((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[use], return_counts=True)
        keys.append(found)
        counts.append(n)
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64)


def profiles(texts: list[str | None], dimensions: int = DIMENSIONS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector per text (zero without letters), and which texts have a letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for lo in range(0, len(texts), 64):
        found = [trigrams(t or "") for t in texts[lo : lo + 64]]
        grams, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        row = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        count = np.concatenate([n for _, n in found]).astype(np.float32)
        for b in range(0, len(grams), BLOCK):
            part = grams[b : b + BLOCK]
            here = (at >= b) & (at < b + BLOCK)
            weights = np.zeros((len(found), len(part)), np.float32)
            weights[row[here], at[here] - b] = count[here]
            split = np.column_stack([part >> 42, part >> 21 & 0x1FFFFF, part & 0x1FFFFF])
            out[lo : lo + len(found)] += weights @ bound(split, dimensions, seed).astype(np.float32)
    norms = np.linalg.norm(out, axis=1)
    some = norms > 0
    out[some] /= norms[some, None]
    lettered = np.fromiter((any(map(str.isalpha, t)) if t and not s else bool(s) for t, s in zip(texts, some, strict=True)), bool, len(texts))
    return out, lettered


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from every row outside the held-out fold.

    A task adds up its own texts; the sums meet in one aggregation, and the driver receives one vector
    per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, _ = profiles(batch.column("text").to_pylist(), dimensions)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()])], ["lang", "total"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    partial = rows.mapInArrow(run, "lang string, total array<double>").select("lang", F.posexplode("total").alias("place", "value"))
    summed = partial.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    learned = sorted((r["lang"], [x["value"] for x in r["v"]]) for r in summed.collect())
    if not learned:
        return [], np.zeros((0, dimensions))
    table = np.array([v for _, v in learned])
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    if len(table) > 1:
        table -= table.mean(axis=0)
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    return [lang for lang, _ in learned], table


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score ((1 + cosine) / 2) and the margin to the second language."""
    dimensions = table.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, lettered = profiles(batch.column("text").to_pylist(), dimensions)
            use = lettered & bool(langs)
            cosine = vectors @ table.T if langs else np.zeros((len(batch), 1))
            best = cosine.argmax(axis=1)
            top = cosine.max(axis=1)
            second = np.partition(cosine, -2, axis=1)[:, -2] if cosine.shape[1] > 1 else np.full(len(batch), -1.0)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([langs[b] if u else "und" for b, u in zip(best, use, strict=True)], pa.string()),
                pa.array(np.where(use, np.clip((1 + top) / 2, 0, 1), 0.0).astype(float)),
                pa.array(np.where(use, top - second, 0.0).astype(float)),
            ], ["doc_id", "lang_pred", "score", "margin"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, margin double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin")
