"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Codes: several iterative-quantisation rotations, fitted on at most ``SAMPLE`` vectors (the smallest by a seeded hash), give
``ROTATIONS * dim`` bits. The radius is the ``RECALL`` quantile of the Hamming distances between sampled queries and their true neighbours in
the sample; with more rows the neighbours come closer, so the radius holds.
Index: every vector's code in byte substrings, each a table from value to rows. A code within radius r = m * a + b of a query is
within a in one of the first b + 1 substrings or within a - 1 in one of the others, so probing those values of every table retrieves every
code in the radius (pigeonhole); full Hamming distances filter, and the floats rerank.
Queries and rows meet in blocks of bounded size, each keeping its best k; the best of those are the answer. Queries
that find fewer than k in the radius search again with the radius of all codes, so nothing is capped.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take no
part, nor do null ids; ties go to the smaller vec_id; equal rows are candidates of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashed_sample, materialize

SAMPLE = 10_000
SAMPLE_QUERIES = 300
ROTATIONS = 4
RECALL = 0.985
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 8_192
FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) that take part."""
    rows = vectors.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("embedding", lambda x: x != 0))


def fit_codes(x: np.ndarray, rotations: int = ROTATIONS, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Columns are directions; a bit is the sign of the product with one. x: unit rows."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    return np.hstack(out)


def codes(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """uint8 substrings, a row per vector."""
    return np.packbits(x @ directions >= 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit_radius(x: np.ndarray, directions: np.ndarray, k: int) -> int:
    n = len(x)
    if n < 2:
        return 0
    c, queries = codes(x, directions), range(min(n, SAMPLE_QUERIES))
    far = []
    for q in queries:
        s = x @ x[q]
        s[q] = -2
        best = np.argsort(-s)[: min(k, n - 1)]
        far.append(hamming(c[best], c[q]))
    return int(np.quantile(np.concatenate(far), RECALL))


class HashIndex:
    """Substring tables of a block of codes."""

    def __init__(self, block: np.ndarray):
        self.columns = np.ascontiguousarray(block.T)
        pad = -block.shape[1] % 8
        self.words = np.ascontiguousarray(np.pad(block, ((0, 0), (0, pad)))).view(np.uint64)
        distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        self.within = [distance <= a for a in range(9)]  # by radius: value -> values in reach
        self.order = [np.argsort(c, kind="stable") for c in self.columns]
        self.begin = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(self.columns, self.order)]

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius``, by the pigeonhole over substrings."""
        a, b = divmod(radius, len(query))
        hit = np.zeros(len(self.words), bool)
        for j, value in enumerate(query):
            reach = a if j <= b else a - 1
            if reach < 0:
                continue
            if reach >= 2:  # many values: each row looks its value up
                hit |= self.within[min(reach, 8)][value].take(self.columns[j])
            else:
                for v in np.flatnonzero(self.within[reach][value]):
                    hit[self.order[j][self.begin[j][v] : self.begin[j][v + 1]]] = True
        rows = np.flatnonzero(hit)
        own = np.pad(query, (0, -len(query) % 8)).view(np.uint64)
        return rows[np.bitwise_count(self.words[rows] ^ own).sum(axis=1) <= radius]


def _matrix(column, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if len(column) else np.zeros((0, d))


def _encode(directions: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("embedding").flatten()).reshape(len(batch), -1)
            c = codes(x / np.linalg.norm(x, axis=1, keepdims=True), directions)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array([r.tobytes() for r in c], pa.binary())], ["vec_id", "embedding", "code"])

    return run


def _search(radius: int, k: int, d: int):
    def run(rows, queries):
        import pyarrow as pa

        if not len(rows) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = _matrix(rows["embedding"], d), _matrix(queries["embedding"], d)
        ids, asked = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        as_code = lambda t: np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
        index, asked_codes, norms = HashIndex(as_code(rows)), as_code(queries), np.sqrt((x * x).sum(axis=1))
        out_q, out_v, out_s = [], [], []
        for q in range(len(asked)):
            near = index.probe(asked_codes[q], radius)
            near = near[ids[near] != asked[q]]
            score = (x[near] * y[q]).sum(axis=1) / (norms[near] * np.sqrt((y[q] * y[q]).sum()))
            best = np.lexsort((ids[near], -score))[:k]
            out_q.append(np.full(len(best), asked[q]))
            out_v.append(ids[near][best])
            out_s.append(score[best])
        return pa.table({"query_id": np.concatenate(out_q).astype(np.int64), "vec_id": np.concatenate(out_v).astype(np.int64), "score": np.concatenate(out_s)})

    return run


def search(index: DataFrame, queries: DataFrame, radius: int, k: int, d: int, n_rows: int, n_queries: int) -> DataFrame:
    """index and queries: (vec_id, embedding, code). (query_id, rank, vec_id, score), the k best in the radius."""
    per = min(BLOCK_ROWS, max(512, n_rows // 16))
    r, q = max(1, -(-n_rows // per)), max(1, -(-n_queries // BLOCK_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("rb", block(r)).withColumn("qb", every(q))
    right = queries.withColumn("qb", block(q)).withColumn("rb", every(r))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(_search(radius, k, d), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """The k nearest of every row where ``is_query`` (a Column) holds, among all rows."""
    rows = valid(vectors)
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = dims.d
    rows = rows.where(F.size("embedding") == d)
    sample = hashed_sample(rows, "vec_id", dims["count"], SAMPLE, 3).select("embedding").toArrow()
    x = _matrix(sample["embedding"], d)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    directions = fit_codes(x)
    radius = fit_radius(x, directions, k)
    index = materialize(rows.mapInArrow(_encode(directions), "vec_id long, embedding array<double>, code binary"), "ann-index")
    asked = index.where(is_query)
    n_queries = asked.count()
    found = materialize(search(index, asked, radius, k, d, dims["count"], n_queries), "ann-found")
    full = found.groupBy("query_id").count().where(f"count >= {k}").select(F.col("query_id").alias("vec_id"))
    few = materialize(asked.join(full, "vec_id", "left_anti"), "ann-few")
    n_few = few.count()
    if n_few:
        again = search(index, few, directions.shape[1], k, d, dims["count"], n_few)
        found = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").union(again)
    return found


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
