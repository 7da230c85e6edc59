"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, lower-cased and reduced to its letters. Each class (toxic, ordinary) has an
interpolated Kneser-Ney model over the letters of its words, orders 3 to 5, whose counts are the numbers
of documents of that class with the word; the counts of the larger class weigh less, so that both classes speak as if
they had equally many documents; every gram of a labelled document counts, and each context gets STRENGTH documents of its backoff besides (the
concentration of a Pitman-Yor model). Both classes
back off to one shared model, the continuation
counts of letter trigrams over the distinct words of *all* documents, so a word that neither class knows
well gets nearly the same probability from both. A text's evidence is the mean log-likelihood difference
per word, mapped to 0..1 by a logistic curve that is fitted on labelled texts the counts did not see.

Sizes: every usable label teaches, three of four the counts and the fourth the curve. Counts cover every
document and are aggregated in Spark; labels meet the texts that may teach a count in one shuffle. The curve is
fitted to counts of texts per label and step of evidence (1 / STEPS of its asinh). What reaches the driver and
the tasks is bounded: the class grams if they are counted to be at most MAX_GRAMS, a fixed table of trigram slots, and
those steps. More class grams stay in Spark: the distinct windows of letters, then the distinct words, then the texts
are joined to what they need, with the same results.

Defined results: null texts, and texts without a letter, have evidence 0 and the score of that evidence;
labels that are null or contradict each other for one doc_id, and rows without a doc_id, teach nothing;
rows that repeat a doc_id teach each and are scored each; with one class or none in the labels every
score is the smoothed share of toxic labels; empty input gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import held_out, mix
from spanwise.llm.quality_qda import usable_labels
from spanwise.session import keep

ORDERS = (3, 4, 5)
DISCOUNT = 0.75
#: Documents' worth of the backoff in every context, so that a gram of few documents moves a probability little.
STRENGTH = 20.0
STEPS = 1024
MAX_GRAMS = 1_500_000
SLOTS = 1 << 18
CACHED = 400_000
RIDGE = 1.0
CUT = 0.5
_START, _END = 1, 2


def expression(chunk: str) -> str:
    return chunk if chunk.isalpha() else "".join(filter(str.isalpha, chunk))


def _chain(expressions: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all expressions between start and end signs, the place of each in its word, and the word."""
    text = "".join("\x01" + e + "\x02" for e in expressions)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(codes == _START)
    word = np.cumsum(codes == _START) - 1
    return codes, np.arange(len(codes)) - starts[word], word


def _keys(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of the ``order`` letters that end at each position (those that reach back far enough)."""
    key = np.full(len(codes), order, np.uint64)
    for back in range(order - 1, -1, -1):
        # Before the first word stands what stands before every other one.
        letter = np.full(len(codes), _END, np.uint64)
        letter[back:] = codes[: len(codes) - back] if back else codes
        key = mix(key * np.uint64(0x100000001B3) + letter)
    return key


def _contexts(codes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the order - 1 letters before each position."""
    key = _keys(codes, order - 1)
    out = np.zeros(len(codes), np.uint64)
    out[1:] = mix(key[:-1] ^ np.uint64(0xC0FFEE))
    return out


def teaching_labels(labels: DataFrame, column: str) -> DataFrame:
    """Every usable label; a quarter of them, by a hash of the id, is set aside for the curve."""
    return usable_labels(labels, column).withColumn("aside", _aside())


def _aside() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0


def word_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every distinct expression of all documents, with its number of toxic and ordinary documents.

    Only texts whose id may teach a count are shuffled to their labels, and never sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain: set[str] = set()
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                chunks = set((text or "").lower().split())
                if label is None:
                    plain |= chunks
                    continue
                for e in {expression(c) for c in chunks}:
                    counts.setdefault(e, [0, 0])[label] += 1
            for e in {expression(c) for c in plain}:
                counts.setdefault(e, [0, 0])
            counts.pop("", None)
            values = np.array(list(counts.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(values[:, 1]), pa.array(values[:, 0])], ["word", "toxic", "ordinary"])

    may = F.coalesce(~held_out(F.col("doc_id")) & ~_aside(), F.lit(False))
    marks = chosen.where("not aside").select("doc_id", "label").hint("shuffle_hash")
    taught = docs.where(may).select("doc_id", "text").join(marks, "doc_id", "left").select("text", "label")
    rest = docs.where(~may).select("text", F.lit(None).cast("int").alias("label"))
    schema = "word string, toxic bigint, ordinary bigint"
    found = taught.mapInArrow(run, schema).unionByName(rest.mapInArrow(run, schema))
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _slot_rows(counted: DataFrame) -> DataFrame:
    """Continuation counts of the shared model: trigrams, their contexts and letters, over distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, SLOTS), np.int64)
        for batch in batches:
            codes, place, _ = _chain(batch.column("word").to_pylist())
            for kind, keys in enumerate(_slots(codes)):
                total[kind] += np.bincount(keys[place > 0], minlength=SLOTS)
        kind, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[kind, slot])], ["kind", "slot", "n"])

    return counted.select("word").mapInArrow(run, "kind int, slot int, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n"))


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.uint64(SLOTS - 1)
    return tuple((k & mask).astype(np.int64) for k in (_keys(codes, 3), _contexts(codes, 3), _keys(codes, 1)))


def _grams(counted: DataFrame) -> DataFrame:
    """Class grams of the words that a labelled document has: key, context, toxic, ordinary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, place, word = _chain(batch.column("word").to_pylist())
            toxic, ordinary = (batch.column(c).to_numpy().astype(float) for c in ("toxic", "ordinary"))
            for order in ORDERS:
                use = place >= order - 1
                if not use.any():
                    continue
                keys, contexts, of = _keys(codes, order)[use], _contexts(codes, order)[use], word[use]
                found, first, at = np.unique(keys, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(contexts[first].view(np.int64))]
                    + [pa.array(np.bincount(at, n[of], len(found)).astype(np.int64)) for n in (toxic, ordinary)],
                    ["key", "context", "toxic", "ordinary"],
                )

    rows = counted.where("toxic + ordinary > 0").mapInArrow(run, "key bigint, context bigint, toxic bigint, ordinary bigint")
    return rows.groupBy("key", "context").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _low(shared: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The shared model's probability of each letter after the two before it."""
    tri, pair, single = _slots(codes)
    letters = shared[2]
    low = (letters[single] + 0.5) / (letters.sum() + 0.5 * SLOTS)
    around = shared[1][pair]
    seen = shared[0][tri]
    return (np.maximum(seen - DISCOUNT, 0) + (DISCOUNT * np.minimum(around, 30) + 1) * low) / (np.maximum(around, seen) + DISCOUNT * np.minimum(around, 30) + 1)


def _windows(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of what the class models see at each position: as many letters as the highest order has, or all since the start of the word."""
    out = _keys(codes, ORDERS[-1])
    for order in range(2, ORDERS[-1]):
        at = place == order - 1
        out[at] = _keys(codes, order)[at]
    return out


@dataclass
class Model:
    grams: np.ndarray
    gram_counts: np.ndarray
    contexts: np.ndarray
    context_counts: np.ndarray
    shared: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    #: Grams (key, n1, n0) and contexts (context, t1, t0, f1, f0) that are too many for one task; the arrays are empty then.
    tables: tuple[DataFrame, DataFrame] | None = None

    def evidence(self, expressions: list[str]) -> np.ndarray:
        """Log-likelihood difference of each expression, toxic less ordinary."""
        if not expressions or not len(self.grams):
            return np.zeros(len(expressions))
        codes, place, word = _chain(expressions)
        low = _low(self.shared, codes)
        p = np.column_stack([low, low])
        for order in ORDERS:
            at = np.flatnonzero(place >= order - 1)
            context, known = _find(self.contexts, _contexts(codes, order)[at])
            at, context = at[known], context[known]
            gram, has = _find(self.grams, _keys(codes, order)[at])
            n = np.where(has[:, None], self.gram_counts[np.where(has, gram, 0)], 0)
            total, free = self.context_counts[context, :2], self.context_counts[context, 2:]
            some = total > 0
            smoothed = (np.maximum(n - DISCOUNT, 0) + free * p[at]) / np.where(some, total, 1)
            p[at] = np.where(some, smoothed, p[at])
        gain = np.log(p[:, 0]) - np.log(p[:, 1])
        gain[place == 0] = 0
        return np.bincount(word, gain, len(expressions))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * evidence, -500, 500)))


def _find(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return at, ordered[at] == keys


def _counts(model: Model):
    """A function from texts to their evidence; word values are remembered in a bounded cache."""
    known: dict[str, float] = {}

    def run(texts: list[str | None]) -> np.ndarray:
        chunks = [(t or "").lower().split() for t in texts]
        fresh = list({c for own in chunks for c in own if c not in known})
        if len(known) + len(fresh) > CACHED:
            known.clear()
            fresh = list({c for own in chunks for c in own})
        for k in range(0, len(fresh), 20_000):
            part = [(c, expression(c)) for c in fresh[k : k + 20_000]]
            values = model.evidence([e for _, e in part])
            known.update((c, float(v) if e else 0.0) for (c, e), v in zip(part, values, strict=True))
        return np.array([sum([known[c] for c in own]) / len(own) if own else 0.0 for own in chunks])

    return run


def with_evidence(docs: DataFrame, model: Model, words: DataFrame | None = None) -> DataFrame:
    """doc_id and the mean evidence per word of the whole text; ``words``: the distinct expressions of the texts, if they are known."""
    if model.tables is not None:
        return _joined_evidence(docs, _word_values(_distinct_words(docs) if words is None else words, model))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _counts(held.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = np.concatenate([evidence(texts[k : k + 200]) for k in range(0, len(texts), 200)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, evidence double")


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: float) -> tuple[float, float]:
    """Logistic curve by damped Newton steps; a ridge draws it to the log odds ``start`` where few texts speak."""
    mean = np.average(x, weights=w)
    scale = max(float(np.sqrt(np.average((x - mean) ** 2, weights=w))), 1e-9)
    design = np.column_stack([np.ones(len(x)), x / scale])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(start + design @ beta, -30, 30)))
        slope = design.T @ (w * (y - p)) - RIDGE * beta
        bend = (design * (w * p * (1 - p))[:, None]).T @ design + RIDGE * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += step * min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-9))
    return float(start + beta[0]), float(beta[1] / scale)


def _distinct_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = {c for t in batch.column("text").to_pylist() for c in (t or "").lower().split()}
            yield pa.RecordBatch.from_arrays([pa.array(list({expression(c) for c in chunks} - {""}), pa.string())], ["word"])

    return docs.select("text").mapInArrow(run, "word string").distinct()


def _word_values(words: DataFrame, model: Model) -> DataFrame:
    """word and its evidence, ``Model.evidence`` by joins: each distinct window of letters meets its contexts and grams once."""
    words = words.select("word")
    held = words.sparkSession.sparkContext.broadcast(model.shared)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, place, _ = _chain(batch.column("word").to_pylist())
            letter = np.flatnonzero(place > 0)
            found, first = np.unique(_windows(codes, place)[letter], return_index=True)
            at = letter[first]
            columns = [pa.array(found.view(np.int64)), pa.array(_low(held.value, codes)[at].astype(float))]
            for order in ORDERS:
                short = place[at] < order - 1
                columns += [pa.array(k[at].view(np.int64), mask=short) for k in (_keys(codes, order), _contexts(codes, order))]
            yield pa.RecordBatch.from_arrays(columns, names)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, place, word = _chain(batch.column("word").to_pylist())
            letter = np.flatnonzero(place > 0)
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(word[letter])), pa.array(_windows(codes, place)[letter].view(np.int64))], ["word", "window"])

    names = ["window", "low", *(f"{kind}{order}" for order in ORDERS for kind in ("key", "context"))]
    rows = words.mapInArrow(seen, ", ".join(f"{n} {'double' if n == 'low' else 'bigint'}" for n in names))
    rows = keep(rows.groupBy("window").agg(*[F.first(n).alias(n) for n in names[1:]]).withColumns({"p1": F.col("low"), "p0": F.col("low")}), "toxicity-windows")
    grams, contexts = model.tables
    for order in ORDERS:
        rows = rows.join(contexts.withColumnRenamed("context", f"context{order}"), f"context{order}", "left")
        rows = rows.join(grams.withColumnRenamed("key", f"key{order}"), f"key{order}", "left")
        kept = [c for c in rows.columns if c not in (f"key{order}", f"context{order}", "n1", "n0", "t1", "t0", "f1", "f0", "p1", "p0")]
        rows = rows.select(*kept, *[
            F.when(F.col(f"t{k}") > 0, (F.greatest(F.coalesce(f"n{k}", F.lit(0.0)) - DISCOUNT, F.lit(0.0)) + F.col(f"f{k}") * F.col(f"p{k}")) / F.col(f"t{k}"))
            .otherwise(F.col(f"p{k}")).alias(f"p{k}") for k in (1, 0)
        ])
    gains = rows.select("window", (F.log("p1") - F.log("p0")).alias("gain"))
    return keep(words.mapInArrow(spelled, "word string, window bigint").join(gains, "window").groupBy("word").agg(F.sum("gain").alias("value")), "toxicity-values")


def _joined_evidence(docs: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id and evidence of every row; equal rows are put together on the way and dealt out again."""
    kind = dict(docs.dtypes)["doc_id"]

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 50):
                own, digest, word, times, of, one = [], [], [], [], [], []
                for i, t in enumerate(texts[k : k + 50], k):
                    chunks = (t or "").lower().split()
                    counts = Counter()
                    for c, n in Counter(chunks).items():
                        counts[expression(c)] += n
                    counts = counts or {"": 0}
                    own += [i] * len(counts)
                    digest += [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()] * len(counts)
                    word += counts.keys()
                    times += counts.values()
                    of += [len(chunks)] * len(counts)
                    one += [1] + [0] * (len(counts) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(own, pa.int64())), pa.array(digest, pa.binary()), pa.array(word, pa.string())]
                    + [pa.array(x, pa.int64()) for x in (times, of, one)],
                    ["doc_id", "digest", "word", "times", "of", "one"],
                )

    rows = docs.select("doc_id", "text").mapInArrow(spoken, f"doc_id {kind}, digest binary, word string, times bigint, of bigint, one bigint")
    value = F.col("times") * F.coalesce("value", F.lit(0.0))
    texts = rows.join(values, "word", "left").groupBy("doc_id", "digest").agg(F.sum(value).alias("sum"), F.sum("one").alias("copies"), F.first("of").alias("of"))
    mean = F.when(F.col("of") > 0, F.col("sum") / (F.col("of") * F.col("copies"))).otherwise(F.lit(0.0))
    return texts.select("doc_id", mean.alias("evidence"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("doc_id", "evidence")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_grams: int = MAX_GRAMS) -> Model:
    chosen = keep(teaching_labels(labels, column), "toxicity-labels")
    model, _ = _models(docs, chosen, max_grams)
    return _with_curve(model, with_evidence(docs.where(_aside()), model), chosen)


def fit_score(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_grams: int = MAX_GRAMS, cut: float = CUT) -> DataFrame:
    """``score(docs, fit(docs, labels))``; the evidence of every text is found once, for the curve and the scores."""
    chosen = keep(teaching_labels(labels, column), "toxicity-labels")
    model, words = _models(docs, chosen, max_grams)
    evidence = keep(with_evidence(docs, model, words), "toxicity-evidence")
    return _scored(evidence, _with_curve(model, evidence.where(_aside()), chosen), cut)


def _models(docs: DataFrame, chosen: DataFrame, max_grams: int) -> tuple[Model, DataFrame | None]:
    """The class models and the shared one, with no curve yet: every score is the share of toxic labels; and the distinct expressions."""
    tally = {0: 0, 1: 0}
    taught = {0: 0, 1: 0}
    for r in chosen.groupBy("label", "aside").agg(F.count("*").alias("n")).collect():
        tally[r["label"]] += r["n"]
        taught[r["label"]] += 0 if r["aside"] else r["n"]
    n1, n0 = tally[1], tally[0]
    none = Model(*[np.zeros(0)] * 4, np.zeros((3, SLOTS)), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not n0 or not n1:
        return none, None
    counted = keep(word_counts(docs, chosen), "toxicity-words")
    grams = keep(_grams(counted), "toxicity-grams")
    weight = min(taught.values()) / np.maximum([taught[1], taught[0]], 1)
    shared = np.zeros((3, SLOTS), np.float32)
    for r in _slot_rows(counted).toPandas().itertuples():
        shared[r.kind, r.slot] = r.n
    if grams.count() > max_grams:
        n1, n0 = (F.col(c) * float(w) for c, w in zip(("toxic", "ordinary"), weight, strict=True))
        sums = [(F.sum(x) + STRENGTH).alias(f"{what}{k}") for k, n in ((1, n1), (0, n0)) for what, x in (("t", n), ("f", F.least(n, F.lit(DISCOUNT))))]
        tables = grams.select("key", n1.alias("n1"), n0.alias("n0")), keep(grams.groupBy("context").agg(*sums), "toxicity-contexts")
        return replace(none, shared=shared, tables=tables), counted
    table = grams.toPandas()
    if not len(table):
        return none, counted
    key, context = (table[c].to_numpy().view(np.uint64) for c in ("key", "context"))
    n = (table[["toxic", "ordinary"]].to_numpy() * weight).astype(np.float32)
    order = np.argsort(key)
    contexts, at = np.unique(context, return_inverse=True)
    free = np.minimum(n, DISCOUNT)
    totals = np.column_stack([np.bincount(at, v, len(contexts)) for v in (n[:, 0], n[:, 1], free[:, 0], free[:, 1])]).astype(np.float32) + np.float32(STRENGTH)
    return Model(key[order], n[order], contexts, totals, shared, none.bias), counted


def _with_curve(model: Model, evidence: DataFrame, chosen: DataFrame) -> Model:
    """The model with the curve of its evidence on the labelled texts that are set aside."""
    if not len(model.grams) and model.tables is None:
        return model
    step = F.round(F.asinh("evidence") * STEPS).cast("bigint").alias("step")
    marks = chosen.where("aside").select("doc_id", "label")
    seen = evidence.join(marks, "doc_id").groupBy("label", step).agg(F.count("*").alias("n")).toPandas().sort_values(["label", "step"])
    y, n = seen["label"].to_numpy(float), seen["n"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(*[np.zeros(0)] * 4, model.shared, model.bias)
    bias, slope = _curve(np.sinh(seen["step"].to_numpy(float) / STEPS), y, n, model.bias)
    return replace(model, bias=bias, slope=slope)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence behind the score."""
    return _scored(with_evidence(docs, model), model, cut)


def _scored(evidence: DataFrame, model: Model, cut: float) -> DataFrame:
    @F.arrow_udf("double")
    def curve(evidence: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(bias + slope * evidence.to_numpy(), -500, 500))))

    bias, slope = model.bias, model.slope
    out = evidence.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), curve("evidence").alias("score"), "evidence")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
