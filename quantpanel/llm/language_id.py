"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features: hashed character 1- to 3-grams of the text (letters folded to lower case, everything that is no letter a
blank), term frequency times inverse document frequency, scaled to sum 1. The document frequencies come from every training text.
Weights: follow-the-regularised-leader (proximal) with elastic net, on a bounded sample of labelled texts: of each language the
texts of smallest seeded hash, ``sample`` in all and ``LEAST_EACH`` of a language at least (a rarer one gives all its texts). Each
sampled text is reduced to its gram counts where it is read, at most ``BUCKETS`` of them; one task fits the model, and only
the model, whose size is fixed, reaches the driver. A tenth of the sample is left out to fit the temperature that
calibrates the probabilities, by cross-entropy against labels smoothed by ``SMOOTHING``.
Prediction sums a table row per character position, so it reads whole texts and never materialises a feature vector.

Defined cases: null text, and text without a letter, is ``und`` with score 0; a null lang is not learned from; without labelled
rows all is ``und``; ties between languages go to the first in order; repeated rows count once in the sample; texts of any length
are read whole; an empty table gives an empty result; extra columns are kept, whatever their names, but for held_out, lang_pred and score,
which the result's replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 3000
EPOCHS = 3
BUCKETS = 1 << 15
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-4
LEAST_EACH = 50
SMOOTHING = 0.01
SEED = 7
MIN_SCORE = 0.5
UND = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str) -> np.ndarray | None:
    """Bucket numbers of all 1- to 3-grams; None if the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_letter = (points >= 97) & (points <= 122)
    other = points >= 128
    if other.any():
        kinds = {c: chr(c).isalpha() for c in np.unique(points[other]).tolist() if c < 0x110000}
        letters = ascii_letter | np.isin(points, [c for c, ok in kinds.items() if ok])
    else:
        letters = ascii_letter
    if not letters.any():
        return None
    c = np.where(letters, points, np.uint32(32)).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # one blank between words
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    one = c * _FACTORS[0]
    two = (one[:-1] ^ (one[:-1] >> 15)) * _FACTORS[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> 13)) * _FACTORS[2] + c[2:]
    mixed = np.concatenate([one, two * _FACTORS[0], three * _FACTORS[1]])
    return (mixed ^ (mixed >> 16)) & np.uint32(BUCKETS - 1)


def _counts(batches: Iterator) -> Iterator:
    """One row a task: document counts of the buckets."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for t in batch.column("text").to_pylist():
            g = grams(t)
            if g is not None:
                df[np.unique(g)] += 1
                n += 1
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(seen, -1), pa.int32()), "n": pa.array(np.append(df[seen], n), pa.int64())})


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.idf, self.temperature = langs, table, bias, idf, temperature

    def logits(self, g: np.ndarray) -> np.ndarray:
        """Mean over the n-grams of the weight rows, each gram weighing its idf."""
        return np.take(self.table, g, axis=0).sum(axis=0, dtype=np.float64) / max(float(np.take(self.idf, g).sum()), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text and self.langs else None
        if g is None:
            return UND, 0.0
        p = _softmax(self.logits(g) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FTRL:
    """Follow-the-regularised-leader, proximal form, with per-coordinate rates and elastic net."""

    def __init__(self, size: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


SCALE = 30.0


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """rows: (buckets, counts, lang); their order is the order of learning."""
    langs = sorted({y for _, _, y in rows})
    held = max(1, len(rows) // 10) if len(rows) > 20 else 0
    ftrl = FTRL(BUCKETS + 1, max(1, len(langs)))
    for _ in range(epochs):
        for at, tf, y in rows[held:]:
            x = tf * idf[at]
            ftrl.step(np.append(at, BUCKETS), np.append(SCALE * x / max(x.sum(), 1e-12), 1.0), langs.index(y))
    w = ftrl.weights()
    model = Model(langs, (SCALE * w[:BUCKETS] * idf[:, None]).astype(np.float32), w[BUCKETS], idf.astype(np.float32), 1.0)
    if held:
        z = np.array([model.logits(np.repeat(at, tf)) for at, tf, _ in rows[:held]])
        model.temperature = fit_temperature(z, np.array([langs.index(y) for _, _, y in rows[:held]]))
    return model


def fit_temperature(z: np.ndarray, y: np.ndarray, smoothing: float = SMOOTHING) -> float:
    """The temperature of least cross-entropy against smoothed labels; those keep it above zero where every label is met."""
    soft = np.full(z.shape, smoothing / z.shape[1])
    soft[np.arange(len(y)), y] += 1 - smoothing
    loss = lambda t: -(soft * np.log(np.maximum(_softmax(z / t), 1e-300))).sum(axis=1).mean()
    grid = np.exp(np.linspace(np.log(1e-3), np.log(1e3), 241))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def _gram_counts(batches: Iterator) -> Iterator:
    for batch in batches:
        found = [grams(t) for t in batch.column("text").to_pylist()]
        keep = [k for k, g in enumerate(found) if g is not None]
        pairs = [np.unique(found[k], return_counts=True) for k in keep]
        columns = [batch.column("lang").take(pa.array(keep, pa.int64())), batch.column("h").take(pa.array(keep, pa.int64()))]
        columns += [pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "h", "at", "tf"])


def _fit(idf: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        rows = [(at.values.to_numpy(), tf.values.to_numpy(), y) for b in batches for at, tf, y in zip(b.column("at"), b.column("tf"), b.column("lang").to_pylist())]
        m = fit(rows, idf)
        yield pa.RecordBatch.from_pydict({"langs": [m.langs], "weights": [m.table.tobytes()], "bias": [m.bias.tolist()], "temperature": [m.temperature]})

    return run


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """rows: text, lang, h. Of each language those of smallest h.

    A threshold from each language's number of texts leaves little more than those to rank, at any number of tasks, and only the
    cut of each language is joined back.
    """
    sizes = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "language-sizes")
    each = max(LEAST_EACH, sample // max(sizes.count(), 1))
    upto = F.least(F.lit(1.0), (1.3 * each + 200) / F.greatest("n", F.lit(1))) * 2.0**64 - 2.0**63
    near = rows.join(sizes, "lang").where(F.col("h").cast("double") <= upto).select("lang", "h").distinct()
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    cuts = materialize(near.withColumn("k", nth).where(F.col("k") <= each).groupBy("lang").agg(F.max("h").alias("cut")), "language-cuts")
    return rows.join(cuts, "lang").where("h <= cut").dropDuplicates(["lang", "h"]).select("text", "lang", "h")


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, lang (null langs are left out)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"))
    counts = rows.select("text").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[counts["bucket"].to_numpy()] = counts["n"].to_numpy()  # bucket -1: the number of texts
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0
    chosen = materialize(sampled(rows, sample).mapInArrow(_gram_counts, "lang string, h long, at array<int>, tf array<int>"), "language-sample")
    ordered = chosen.repartition(1).sortWithinPartitions("h", "lang")
    found = ordered.mapInArrow(_fit(idf), "langs array<string>, weights binary, bias array<double>, temperature double").first()
    if found is None or not found.langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), idf.astype(np.float32), 1.0)
    return Model(list(found.langs), np.frombuffer(found.weights, np.float32).reshape(BUCKETS, -1), np.array(found.bias), idf.astype(np.float32), found.temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score; the model, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def guess(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    found = docs.select(F.struct(*docs.columns).alias("row"), guess("text").alias("guess"))
    own = (F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score"))
    return found.select(*own, "guess.lang_pred", "guess.score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with held_out, lang_pred and score."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id"))), sample)).withColumn("held_out", held_out(F.col("doc_id")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
