"""Market regimes by clustering: a Gaussian mixture over the scaled six-feature matrix, named after its components' means.

The starts are those of Spark ML's GaussianMixture; its expectation-maximisation is done over all rows of the matrix in numpy blocks, made
once and kept, one distributed pass an iteration for all starts together. Only the components' weights, means and covariances reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import MultivariateGaussian
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.asof import last_before

C = F.col
FEATURES = ("vol_5d", "vol_21d", "mom_10d", "mom_30d", "ret_21d", "atr_pct")
# The four regimes, the three-way regime of each, and its share of the full position.
THREE_WAY = {"bull_quiet": "bull", "bull_volatile": "bull", "bear": "bear", "sideways": "choppy"}
POSITION = {"bull_quiet": 1.0, "bull_volatile": 0.7, "sideways": 0.5, "bear": 0.2}
# As in Spark ML: added to each weighted density; smaller eigenvalues, relative to the largest, count as none.
EPSILON = 2.0**-52
#: Rows that one matrix product takes; more would be spread over threads that the tasks already fill.
STRIP = 1024


def name_components(means: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """means (by.., component, mom_30d, vol_21d) of four components -> their regime: the lower two by momentum are bear (more volatile) and
    sideways, the upper two bull_volatile and bull_quiet. Ties go to the smaller component."""
    keys = [C(c) for c in by]
    up = F.row_number().over(W.partitionBy(*keys).orderBy("mom_30d", "component")) > 2
    rows = means.withColumn("up", up)
    wild = F.row_number().over(W.partitionBy(*keys, "up").orderBy(F.desc("vol_21d"), "component")) == 1
    name = F.when(C("up"), F.when(wild, "bull_volatile").otherwise("bull_quiet")).otherwise(F.when(wild, "bear").otherwise("sideways"))
    return rows.withColumn("regime", name).drop("up")


@dataclass
class Mixture:
    """Components of a mixture, and how far its fit has come."""

    weights: np.ndarray  # k
    means: np.ndarray  # k x d
    covs: np.ndarray  # k x d x d
    likelihood: float = -float(np.finfo(float).max)
    before: float = 0.0
    passes: int = 0

    def densities(self):
        """A function of rows (d x n): the weighted density of each component (k x n)."""
        k, d = self.means.shape
        e, v = np.linalg.eigh(self.covs)
        kept = e > EPSILON * e[:, -1:] * d
        if not kept.any(axis=1).all():
            raise ValueError("a component's covariance has no non-zero eigenvalue")
        e = np.where(kept, e, 1.0)
        root = np.swapaxes(v, 1, 2) * (kept / np.sqrt(e))[:, :, None]
        at, root = np.einsum("kij,kj->ki", root, self.means).reshape(-1, 1), root.reshape(-1, d)
        level = -0.5 * (d * np.log(2 * np.pi) + np.log(e).sum(axis=1))[:, None]
        summed, weights = np.kron(-0.5 * np.eye(k), np.ones(d)), self.weights[:, None]

        def of(z):
            y = root @ z
            y -= at
            y *= y
            p = summed @ y
            p += level
            np.exp(p, out=p)
            p *= weights
            p += EPSILON
            return p

        return of

    def moved(self, sums: np.ndarray) -> Mixture:
        """The next mixture from k x (1 + d + d (d + 1) / 2) weighted moments and, last of all, the likelihood."""
        k, d = self.means.shape
        m = sums[:-1].reshape(k, -1)
        w, upper = m[:, 0], np.triu_indices(d)
        means, second = m[:, 1 : d + 1] / w[:, None], np.empty((k, d, d))
        second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = m[:, d + 1 :] / w[:, None]
        return Mixture(w / w.sum(), means, second - means[:, :, None] * means[:, None, :], float(sums[-1]), self.likelihood, self.passes + 1)


class MixtureModel(Transformer):
    """The last stage of a ``RegimeModel``: adds posterior, an array by component, to rows with scaled vectors."""

    def __init__(self, mixture: Mixture):
        super().__init__()
        self.mixture = mixture
        self.weights = [float(w) for w in mixture.weights]
        self.gaussians = [MultivariateGaussian(DenseVector(m), DenseMatrix(len(m), len(m), c.ravel(order="F"))) for m, c in zip(mixture.means, mixture.covs)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mixture, d = self.mixture, self.mixture.means.shape[1]

        @F.arrow_udf("array<double>")
        def posterior(rows):
            import pyarrow as pa

            p = mixture.densities()(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).T)
            return pa.FixedSizeListArray.from_arrays(pa.array((p / p.sum(axis=0)).T.ravel()), len(p)).cast(pa.list_(pa.float64()))

        return dataset.withColumn("posterior", posterior(vector_to_array("scaled")))


def _packed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).tobytes()], pa.binary())], ["block"])


def _passed(blocks: RDD, mixtures: list[Mixture], d: int) -> list[Mixture]:
    """One pass of expectation and maximisation over all rows, for all ``mixtures`` at once; a task returns its sums alone."""
    n_moments = 1 + d + d * (d + 1) // 2

    def run(part: Iterator) -> Iterator:
        densities, sums = [m.densities() for m in mixtures], np.zeros((len(mixtures), len(mixtures[0].weights) * n_moments + 1))
        strip = np.ones((n_moments, STRIP))
        for block in part:
            rows = np.frombuffer(block).reshape(d, -1)
            for lo in range(0, rows.shape[1], STRIP):
                z = rows[:, lo : lo + STRIP]
                moments, at = strip[:, : z.shape[1]], d + 1
                moments[1:at] = z
                for i in range(d):
                    np.multiply(z[i], z[i:], out=moments[at : at + d - i])
                    at += d - i
                for s, density in zip(sums, densities):
                    p = density(z)
                    total = p.sum(axis=0)
                    p /= total
                    s[:-1] += (p @ moments.T).ravel()
                    s[-1] += np.log(total).sum()
        yield sums

    return [m.moved(s) for m, s in zip(mixtures, np.sum(blocks.mapPartitions(run).collect(), axis=0))]


def _run(blocks: RDD, mixtures: list[Mixture], d: int, most: int, tol: float) -> list[Mixture]:
    """Passes until each mixture has had ``most`` or its likelihood changes by ``tol`` at most."""
    moving = lambda m: m.passes < most and abs(m.likelihood - m.before) > tol
    while any(map(moving, mixtures)):
        at = [i for i, m in enumerate(mixtures) if moving(m)]
        for i, m in zip(at, _passed(blocks, [mixtures[i] for i in at], d)):
            mixtures[i] = m
    return mixtures


@dataclass
class RegimeModel:
    stages: PipelineModel
    names: list[str]  # by component
    log_likelihood: float


def fit_regimes(matrix: DataFrame, starts: int = 4, first_iter: int = 8, max_iter: int = 60, tol: float = 1e-3, seed: int = 42) -> RegimeModel:
    """Fits on all rows of ``matrix`` (``FEATURES``). Of ``starts`` short seeded runs that with the greatest likelihood is run to its end."""
    shape = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)]).fit(matrix)
    scaled, d = shape.transform(matrix).select("scaled").persist(), len(FEATURES)
    start = lambda k: GaussianMixture(k=4, featuresCol="scaled", seed=k, maxIter=0, tol=tol).fit(scaled)
    try:
        begun = [start(k) for k in range(seed, seed + starts)]
    finally:
        scaled.unpersist()
    mixtures = [Mixture(np.array(m.weights), np.array([g.mean.toArray() for g in m.gaussians]), np.array([g.cov.toArray() for g in m.gaussians])) for m in begun]
    mean, std = (v.toArray() for v in (shape.stages[1].mean, shape.stages[1].std))
    columns = [((C(c) - float(m)) * (1 / float(s) if s else 0.0)).alias(c) for c, m, s in zip(FEATURES, mean, std)]
    # binary values of an RDD are handed to Python as they are kept; a table's would be decoded and copied at every pass
    blocks = matrix.select(*columns).mapInArrow(_packed, "block binary").rdd.map(lambda r: bytes(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = max(_run(blocks, mixtures, d, first_iter, tol), key=lambda m: m.likelihood)
        best = _run(blocks, [best], d, max_iter, tol)[0]
    finally:
        blocks.unpersist()
    means = [[float(v) for v in mean + std * m] for m in best.means]
    spark = matrix.sparkSession
    rows = spark.createDataFrame([(k, m[FEATURES.index("mom_30d")], m[FEATURES.index("vol_21d")]) for k, m in enumerate(means)], "component int, mom_30d double, vol_21d double")
    named = {r.component: r.regime for r in name_components(rows).collect()}
    return RegimeModel(PipelineModel(stages=[*shape.stages, MixtureModel(best)]), [named[k] for k in range(4)], best.likelihood)


def regime_posteriors(model: RegimeModel, matrix: DataFrame) -> DataFrame:
    """matrix with p_<regime> for the four regimes, the likeliest as gmm_regime, and the probability-weighted position in [0.2, 1]."""
    rows = model.stages.transform(matrix)
    rows = rows.withColumns({f"p_{n}": C("posterior")[k] for k, n in enumerate(model.names)})
    names = list(THREE_WAY)
    likeliest = F.array_max(F.array(*(F.struct(C(f"p_{n}").alias("p"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(names))))["n"]
    scale = sum((C(f"p_{n}") * POSITION[n] for n in names), F.lit(0.0))
    rows = rows.withColumn("gmm_regime", likeliest).withColumn("position_scale", F.greatest(F.lit(0.2), F.least(F.lit(1.0), scale)))
    return rows.select(*matrix.columns, "gmm_regime", "position_scale", *(f"p_{n}" for n in names))


def three_way(regime: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in THREE_WAY.items() for x in kv)), regime)


def regime_series(bars: DataFrame, posteriors: DataFrame) -> DataFrame:
    """bars (symbol, date) with the three-way regime of the newest row that has features (null before the first), its four-way name and position."""
    marks = posteriors.select("symbol", "date", F.struct("gmm_regime", "position_scale", *(f"p_{n}" for n in THREE_WAY)).alias("m"))
    rows = last_before(bars.select("symbol", "date"), marks, "symbol", "date", C("m"), "_m")
    return rows.select("symbol", "date", three_way(C("_m.gmm_regime")).alias("regime"), "_m.*")
