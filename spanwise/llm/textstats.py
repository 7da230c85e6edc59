"""Counts of a whole text that the quality rules and the quality classifier both build on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanwise.llm.common import PIECE, mix, owners, repeated, text_bytes, words

#: Words, code points in words, characters of ``#*$%&|<>``, lines with a word that equal an earlier line,
#: words in 3-word windows found twice or more, lines, ASCII letters by case, digits, ``!?.,;:``,
#: words equal to the word before, and distinct words.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits",
    "n_marks", "n_same_next", "n_distinct",
)
_BLANKS = b" \t\n\v\f\r"


def _bytes_of(characters: str) -> np.ndarray:
    chosen = np.zeros(256, bool)
    chosen[list(characters.encode())] = True
    return chosen


_SETS = {
    "n_symbols": _bytes_of("#*$%&|<>"), "n_marks": _bytes_of("!?.,;:"), "n_digits": _bytes_of("0123456789"),
    "n_upper": _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_lower": _bytes_of("abcdefghijklmnopqrstuvwxyz"),
    "n_lines": _bytes_of("\n"),
    "word_chars": ((np.arange(256) & 0xC0) != 0x80) & ~_bytes_of(_BLANKS.decode()),
}


def _per_text(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    running, total = np.zeros(len(offsets), np.int64), 0
    for lo in range(0, len(data), PIECE):
        part = np.cumsum(chosen[data[lo : lo + PIECE]], dtype=np.int32)
        i, j = np.searchsorted(offsets, (lo, lo + len(part)), "right")
        running[i:j] = total + part[offsets[i:j] - lo - 1]
        total += int(part[-1])
    return np.diff(running)


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    return n


def count(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of every text of a batch."""
    n = len(offsets) - 1
    start, _, word = words(data, offsets)
    of = owners(offsets, start)
    out = {name: _per_text(data, offsets, chosen) for name, chosen in _SETS.items()}
    out["n_words"] = np.bincount(of, minlength=n)
    out["n_lines"] += 1
    raw = data.tobytes()
    out["n_dup_lines"] = np.array([_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
    own = mix(of.astype(np.uint64) + np.uint64(0x51ED27))
    keyed = mix(word ^ own)
    _, first = repeated(keyed)
    out["n_distinct"] = np.bincount(of[first], minlength=n)
    same = np.zeros(len(word), bool)
    same[1:] = keyed[1:] == keyed[:-1]
    out["n_same_next"] = np.bincount(of[same], minlength=n)
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        inside = of[2:] == of[:-2]
        triple = mix(mix(keyed[:-2]) + mix(keyed[1:-1] + np.uint64(1)) * np.uint64(3) + mix(keyed[2:] + np.uint64(2)) * np.uint64(5))
        twice = np.zeros(len(word) - 2, bool)
        twice[inside] = repeated(triple[inside])[0]
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
    out["n_repeat_words"] = np.bincount(of[covered], minlength=n)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def with_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in ``keep`` and COUNTS of the whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(counts[c], pa.int64()) for c in COUNTS], [*keep, *COUNTS]
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{c} bigint" for c in COUNTS])
    return docs.select(*keep, "text").mapInArrow(run, schema)
