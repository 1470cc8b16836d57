"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed words and word beginnings.
A later model also sees the probabilities of the categories before it; in training these are
out-of-fold, made by models that did not see the document, so that they are as good as they will be
on new texts. Models are fitted on a bounded sample of labelled rows (``SAMPLE``), the folds of a
category in parallel; scoring covers every text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stable_hash, stored, table
from tidemark.llm.words import Words, chunks

SAMPLE = 10_000  # labelled rows that models are fitted on, about
FOLDS = 4
BITS = 20  # hashed features
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word that are a feature, besides the whole word
CHOSEN = 400  # features of a model, by how far their count among positives is from chance
LEAST_ROWS = 4  # labelled texts that a feature must occur in
STEPS, RIDGE = 200, 1.0


@dataclass
class Model:
    """Log odds: bias + weights of the features present + gains times earlier log odds."""

    features: np.ndarray
    weights: np.ndarray
    gains: np.ndarray
    bias: float

    def pack(self) -> bytes:
        return b"".join((np.array([len(self.features), len(self.gains)], np.int64).tobytes(), self.features.tobytes(),
                         self.weights.tobytes(), self.gains.tobytes(), np.array([self.bias]).tobytes()))

    @classmethod
    def unpack(cls, raw: bytes) -> Model:
        n, m = np.frombuffer(raw, np.int64, 2)
        parts = np.split(np.frombuffer(raw, np.float64, offset=16 + 8 * n), [n, n + m])
        return cls(np.frombuffer(raw, np.int64, n, 16), parts[0], parts[1], float(parts[2][0]))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every word and word beginning; repeats are left in."""
    text = np.repeat(np.arange(len(words)), np.diff(words.of_text))
    found = [words.hashes]
    for n in BEGINNINGS:
        found.append(words.hash_spans(words.starts, np.minimum(words.starts + n, words.ends)) * np.uint64(2 * n + 1))
    return np.tile(text, len(found)), np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in found])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sum_of(text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=weight, minlength=n)


def _slices(ends: np.ndarray, values: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place in ``rows`` and feature of the stored pairs, some hundred texts at a time."""
    for s in range(0, len(rows), 500):
        part = rows[s:s + 500]
        yield (np.repeat(np.arange(s, s + len(part)), ends[part + 1] - ends[part]),
               np.concatenate([values[ends[r]:ends[r + 1]] for r in part]))


def _held(ends: np.ndarray, values: np.ndarray, rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose feature has a place, with that place."""
    texts, columns = [], []
    for text, feature in _slices(ends, values, rows):
        column = place[feature]
        texts.append(text[column >= 0])
        columns.append(column[column >= 0])
    none = np.zeros(0, np.int64)
    return np.concatenate(texts) if texts else none, np.concatenate(columns) if columns else none


def fit(ends: np.ndarray, values: np.ndarray, use: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression with a ridge over the rows ``use``. values[ends[r]:ends[r + 1]] are the
    features of row r, without repeats; earlier (n x categories) and y are of the rows ``use``."""
    n, positive = len(y), float(y.sum())
    if positive in (0.0, float(n)):
        certain = 0.0 if not n else (1.0 if positive else 0.0)
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(log_odds(np.array([certain]))[0]))
    rows, hits = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for text, feature in _slices(ends, values, use):
        rows += np.bincount(feature, minlength=1 << BITS)
        hits += np.bincount(feature, weights=y[text], minlength=1 << BITS)
    share = positive / n
    spread = np.sqrt(np.maximum(rows * share * (1 - share) * (1 - rows / n), 0.25))
    far = np.where(rows >= LEAST_ROWS, np.abs(hits - rows * share) / spread, 0)
    chosen = np.sort(np.argsort(-far, kind="stable")[:CHOSEN])
    chosen = chosen[far[chosen] > 4]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    text, column = _held(ends, values, use, place)
    before = log_odds(earlier)
    w, g, b = np.zeros(len(chosen)), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))
    vw, vg, vb = np.zeros_like(w), np.zeros_like(g), 0.0
    step_w = 1 / (0.25 * np.bincount(column, minlength=len(chosen)) + RIDGE)
    step_g = 1 / (0.25 * (before ** 2).sum(axis=0) + RIDGE)
    for _ in range(STEPS):
        z = _sum_of(text, w[column], n) + before @ g + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        vw = 0.9 * vw - 0.3 * step_w * (_sum_of(column, error[text], len(chosen)) + RIDGE * w)
        vg = 0.9 * vg - 0.1 * step_g * (before.T @ error + RIDGE * g)
        vb = 0.9 * vb - 0.3 * float(error.mean())
        w, g, b = w + vw, g + vg, b + vb
    return Model(chosen.astype(np.int64), w, g, b)


def predict(model: Model, text: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Probabilities; repeats of a feature in a text count once."""
    weight = np.zeros(1 << BITS)
    weight[model.features] = model.weights
    held = weight[feature] != 0
    pairs = np.unique((text[held] << BITS) + feature[held])
    z = _sum_of(pairs >> BITS, weight[pairs & (1 << BITS) - 1], len(earlier)) + log_odds(earlier) @ model.gains + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sampled(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """row, fold, features and labels of the labelled texts that models are fitted on."""
    truth = (labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(*(F.max(F.coalesce(c, F.lit(0))).cast("double").alias(c) for c in categories)))
    every = max(1, truth.count() // SAMPLE)
    picked = lambda df: df.filter(F.pmod(stable_hash("doc_id"), F.lit(every)) == 0)
    rows = picked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).join(picked(truth), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in chunks(batch.column("text"), fold=True, alnum=True):
                text, feature = features(words)
                pairs = np.unique((text << BITS) + feature)
                ends = np.searchsorted(pairs >> BITS, np.arange(len(words) + 1)).astype(np.int32)
                part = batch.slice(first, len(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("fold"),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs & (1 << BITS) - 1).astype(np.int32))),
                     *(part.column(c) for c in categories)], names=["row", "fold", "features", *categories])

    kinds = ", ".join(f"{c} double" for c in categories)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    # a repeated doc_id must not bring more rows than the bound says
    return stored(rows.dropDuplicates(["doc_id"]).select("text", F.col("doc_id").alias("row"), fold.alias("fold"), *categories)
                  .mapInArrow(work, f"row long, fold int, features array<int>, {kinds}"), "sample")


def _fitter(category: str, names: tuple[str, ...]):
    """Fits one model without a fold and predicts that fold, or, beyond the folds, fits on all rows."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        of = key[0].as_py()
        column = rows["features"].combine_chunks()
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        earlier = np.column_stack([rows[c].to_numpy() for c in names]) if names else np.zeros((rows.num_rows, 0))
        y, apart = rows[category].to_numpy(), rows["fold"].to_numpy() == of
        use = np.flatnonzero(~apart)
        model = fit(ends, values, use, earlier[use], y[use])
        if of == FOLDS:
            return pa.table({"row": pa.array([None], pa.int64()), "p": pa.array([None], pa.float64()),
                             "model": pa.array([model.pack()], pa.binary())})
        held_out = np.flatnonzero(apart)
        place = np.full(1 << BITS, -1)
        place[model.features] = model.features
        p = predict(model, *_held(ends, values, held_out, place), earlier[held_out])
        return pa.table({"row": rows["row"].combine_chunks().filter(pa.array(apart)), "p": pa.array(p),
                         "model": pa.nulls(len(p), pa.binary())})

    return work


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> tuple[list[Model], float]:
    """One model per category, in order, and the threshold of the last category that has the best F1
    over the out-of-fold probabilities. ``labels`` has doc_id and a 0/1 column per category."""
    known = _sampled(docs, labels, categories)
    models: list[Model] = []
    names: list[str] = []
    for category in categories:
        # the sample is bounded, and so is each group: one per fold and one for all rows
        fitted = stored(known.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
                        .groupBy("of").applyInArrow(_fitter(category, tuple(names)), "row long, p double, model binary"), "fitted")
        raw = fitted.filter("model is not null").select("model").first()
        if raw is None:
            none = np.zeros(0, np.int64)
            models.append(fit(none, none, none, np.zeros((0, len(names))), np.zeros(0)))
        else:
            models.append(Model.unpack(bytes(raw[0])))
        name = f"p_{category}"
        known = stored(known.join(fitted.filter("row is not null").select("row", F.col("p").alias(name)), "row"), "known")
        names.append(name)
    last = known.select(names[-1], categories[-1])
    steps = np.linspace(0.05, 0.95, 19)
    counts = last.agg(F.coalesce(F.sum(categories[-1]), F.lit(0.0)), *(
        c for t in steps for c in (F.count_if(F.col(names[-1]) >= float(t)),
                                   F.coalesce(F.sum(F.when(F.col(names[-1]) >= float(t), F.col(categories[-1]))), F.lit(0.0))))).first()
    f1 = [2 * counts[2 + 2 * i] / max(1, counts[0] + counts[1 + 2 * i]) for i in range(len(steps))]
    return models, float(steps[int(np.argmax(f1))]) if counts[0] else 1.0


def probabilities(text: Column | str, models: Sequence[Model], categories: Sequence[str]) -> Column:
    """A struct of the probabilities of all categories, by the chain."""
    packed = [m.pack() for m in models]
    kinds = pa.struct([(f"p_{c}", pa.float64()) for c in categories])

    @F.arrow_udf(", ".join(f"p_{c} double" for c in categories))
    def score(texts: pa.Array) -> pa.Array:
        chain = [Model.unpack(m) for m in packed]
        parts = []
        for _, words in chunks(texts, fold=True, alnum=True):
            found = features(words)
            earlier = np.zeros((len(words), 0))
            for model in chain:
                earlier = np.column_stack((earlier, predict(model, *found, earlier)))
            parts.append(earlier)
        all_of = np.concatenate(parts) if parts else np.zeros((0, len(chain)))
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in all_of.T], fields=list(kinds))

    return score(text)


CATEGORIES = ("junk", "abusive_prose", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, a probability per category and the verdict, one row per document.

    Categories from the two given marks: junk (bad quality), abusive prose (toxic although well
    written), toxic. A null or empty text has no features and gets the models' biases; repeated rows
    are judged each; without labels nothing is toxic.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"),
                          ((F.col("toxic") == 1) & (F.col("quality") == 1)).cast("int").alias("abusive_prose"), "toxic")
    models, threshold = train(docs, marks, CATEGORIES)
    return (docs.select("doc_id", probabilities("text", models, CATEGORIES).alias("p")).select("doc_id", "p.*")
            .withColumn("toxic", F.col("p_toxic") >= threshold))
