"""Near-duplicate components by MinHash bottom-k sketches, exact at the end.

1. Every document's set of word 5-shingles is hashed with one function; the ``SKETCH`` smallest hashes are its sketch.
   Documents with equal sets are one class, and one member stands for it. Nothing is enumerated inside a class.
2. Inverted lists of the retained values. A link of similarity 0.75 shares at least ``need`` sketch values (see
   ``shared_least``), so of a sketch ordered by document frequency, rarest first, only the first m - need + 1 values are looked up
   (prefix filter). Values of common passages come last and are seldom looked up.
3. Rounds over the lists. In each, every list names a hub (the member with the fewest values of its own, which stands nearest
   to the rest), and its members in other components than the hub's are compared with it; links join components, so a large group of copies needs one comparison a member, not one a pair.
   Lists that are still split after ``HUB_ROUNDS`` yield the pairs across components: short lists directly, members of long
   lists through their whole shingle sets, rarest shingle first, where similarity 0.75 leaves a prefix of a quarter and places prune pairs.
4. A pair is first estimated on the bottom-k sketch of the union, then verified on the full shingle sets.
5. Components of the verified links, by minimum labels with pointer jumping, on written tables.

A pair is lost only if its sketches overlap less than 5.8 standard deviations below the mean (odds about 3e-9), and a
set only if 64-bit shingle hashes collide. Both bounds are independent of the corpus.

Defined cases: null text and text without words have empty sets and link with nothing; fewer than five words are one shingle; rows that
share a doc_id are one document, for which the longest text stands (of equally long ones the largest); rows without a doc_id have no
component; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, materialize, write_buckets

SHINGLE, SKETCH = 5, 64
SIM = 75  # percent
HUB_ROUNDS = 3
LONG_LIST = 16
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shared_least(n: int, k: int = SKETCH) -> int:
    """Sketch values that a document of ``n`` shingles shares with any partner of similarity 0.75 or more.

    Sets up to 0.75 k have partners of at most k shingles, whose sketches are whole: a share of 0.75 of the set. Otherwise the
    union's k smallest hashes lie in both sets k * 0.75 times on average, and 5.8 standard deviations less with odds of 3e-9.
    """
    if n * 100 <= SIM * k:
        return max(1, -(-SIM * n // 100))
    return max(1, int(0.75 * k - 5.8 * (k * 0.75 * 0.25) ** 0.5))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the word 5-shingles of each text."""
    from xxhash import xxh3_64_intdigest

    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    h = np.fromiter((xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, sum(map(len, words)))
    out, at = [], 0
    for ws in words:
        n = len(ws)
        own = h[at : at + n]
        at += n
        if not n:
            out.append(np.zeros(0, np.int64))
            continue
        size = min(n, SHINGLE)
        mixed = own[: n - size + 1] * _FACTORS[0]
        for j in range(1, size):
            mixed = (mixed ^ (mixed >> np.uint64(31))) + own[j : n - size + 1 + j] * _FACTORS[j]
        mixed ^= mixed >> np.uint64(33)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        mixed ^= np.uint64(size) << np.uint64(5)
        out.append(np.unique((mixed >> np.uint64(1)).astype(np.int64)))
    return out


def _slices(batch, chars: int = 4_000_000) -> Iterator[tuple[int, int, list]]:
    texts = batch.column("text").to_pylist()
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or k == len(texts) - 1:
            yield begin, k + 1, texts[begin : k + 1]
            begin, held = k + 1, 0


def _sketches(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    for batch in batches:
        for begin, end, texts in _slices(batch):
            sets = shingle_sets(texts)
            tops = [s[:SKETCH] for s in sets]
            flat = np.concatenate(tops) if tops else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tops])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[begin:end], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["doc_id", "n", "sig", "sketch"],
            )


def _verify(batches: Iterator) -> Iterator:
    """Keeps the pairs whose full sets meet the similarity."""
    import pyarrow as pa

    last, last_set = None, None
    for batch in batches:
        a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
        good = []
        for begin in range(0, len(a), 256):
            for k, sa in enumerate(shingle_sets(ta[begin : begin + 256]), begin):
                if b[k] != last:
                    last, last_set = b[k], shingle_sets([tb[k]])[0]
                both = len(np.intersect1d(sa, last_set, assume_unique=True))
                if 100 * both >= SIM * (len(sa) + len(last_set) - both):
                    good.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], ["a", "b"])


def _explode_sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for begin, end, texts in _slices(batch, 500_000):
            sets = shingle_sets(texts)
            ids = np.repeat(np.array(batch.column("doc_id")[begin:end].to_pylist(), np.int64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], ["rep", "v"])


class _Texts:
    """(doc_id, text) of the documents that some list names, written once, hash-bucketed by doc_id."""

    def __init__(self, docs: DataFrame, ids: DataFrame, buckets: int):
        rows = docs.select("doc_id", "text").repartition(buckets, "doc_id").join(ids.distinct().repartition(buckets, "doc_id"), "doc_id", "left_semi")
        self.rows = write_buckets(rows, "near-texts", "doc_id", buckets)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Texts of the documents in ``ids`` (doc_id), one row each."""
        return self.rows.join(ids.distinct(), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): the smallest node reachable. Each round is written; a count decides when to stop."""
    edges = materialize(edges.union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "label").select("node", "was", F.least("label", "far").alias("label")), "cc-labels")
        if step.where("label <> was").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def _links(texts: _Texts, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that hold on the sketch of the union, then on the full sets."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    sketch = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    text = lambda x, pairs: texts.fetch(pairs.select(F.col(x).alias("doc_id"))).select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    est = pairs.join(sketch("a"), "a").join(sketch("b"), "b")
    est = est.where(f"100 * least(n_a, n_b) >= {SIM} * greatest(n_a, n_b)")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, "sketch_a"), "sketch_b"))
    est = est.withColumn("k", F.size(union)).withColumn("both", both)
    close = materialize(est.where("both >= 0.75 * k - 5.8 * sqrt(k * 0.1875)").select("a", "b"), "near-close")
    hubs = materialize(text("b", close), "near-hubs")  # apart from the join, whose hot hubs can then be split
    full = close.join(text("a", close), "a").join(hubs, "b")
    return materialize(full.mapInArrow(_verify, "a long, b long"), "near-links")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, comp) after joining components over ``links`` (a, b)."""
    of = lambda x: labels.select(F.col("rep").alias(x), F.col("comp").alias(f"c_{x}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    moved = components(edges).select(F.col("node").alias("comp"), "label")
    return materialize(labels.join(moved, "comp", "left").select("rep", F.coalesce("label", "comp").alias("comp")), "near-labels")


def _rarest_first(postings: DataFrame, reps: DataFrame, prefix) -> DataFrame:
    """postings (v, rep) -> those among the first ``prefix`` values of a rep, of m in all, that another rep shares.

    reps: rep, m and whatever ``prefix`` (a Column) reads. A value that nobody shares takes a place but cannot match.
    Adds at (the place in the order) and alone (the share of a rep's values that nobody shares).
    """
    shared = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    listed = postings.join(shared, "v").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    listed = listed.join(reps, "rep").withColumn("own", F.col("m") - F.size("vs")).withColumn("room", prefix - F.col("own")).where("room > 0")
    listed = listed.select("rep", "n", "own", (F.col("own") / F.col("m")).alias("alone"), F.posexplode(F.slice("vs", F.lit(1), F.col("room").cast("int"))).alias("k", "x"))
    return materialize(listed.select("rep", "n", "alone", (F.col("own") + F.col("k")).alias("at"), "x.v"), "near-postings")


def _across(lists: DataFrame, whole: bool) -> DataFrame:
    """Pairs across components within the lists (v, rep, n, at, comp).

    ``whole``: the lists are of full sets, where what follows the first common value must still hold the overlap that 0.75 needs,
    which prunes by place in both orders (positional filter; exact).
    """
    right = lists.select("v", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("comp").alias("c_b"))
    test = f"a > b AND comp <> c_b AND 100 * least(n, n_b) >= {SIM} * greatest(n, n_b)"
    if whole:
        test += f" AND {100 + SIM} * least(n - at, n_b - at_b) >= {SIM} * (n + n_b)"
    return lists.withColumnRenamed("rep", "a").join(right, "v").where(test).select("a", "b")


def _split_lists(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with comp, of the lists that hold more than one component; c0 and c1 are two of them."""
    own = postings.join(labels, "rep")
    split = own.groupBy("v").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("length")).where("c0 <> c1")
    return own.join(split, "v")


def one_per_id(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every doc_id: that of the longest text, then the largest text, then the largest other columns. Rows without a doc_id stay.

    A table without repeated doc_ids is returned as it is.
    """
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = materialize(again, "near-repeated")
    if again.isEmpty():
        return docs
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    fields = [F.length("text").alias("f"), F.col("text").alias("f_text"), *(F.col(c).alias(f"f{k}") for k, c in enumerate(rest))]
    best = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(*fields)).alias("best"))
    best = best.select("doc_id", F.col("best.f_text").alias("text"), *(F.col(f"best.f{k}").alias(c) for k, c in enumerate(rest))).select(*docs.columns)
    return materialize(docs.join(again, "doc_id", "left_anti").select(*docs.columns).union(best), "near-documents")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` with a doc_id."""
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    single = one_per_id(named)
    found = _components_of_single(single)
    return found if single is named else named.select("doc_id").join(found, "doc_id")


def _components_of_single(docs: DataFrame) -> DataFrame:
    buckets = bucket_count(docs.sparkSession, docs.count())
    sets = materialize(docs.mapInArrow(_sketches, "doc_id long, n long, sig binary, sketch array<long>"), "sketches")
    classes = materialize(sets.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = sets.where("n > 0").join(classes.select(F.col("rep").alias("doc_id"), "sig", "n"), ["doc_id", "sig", "n"]).dropDuplicates(["doc_id"])
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "n", F.size("sketch").alias("m"), "sketch"), "near-reps")
    small = reps.select("rep", "n", "m")
    need = F.when(F.col("n") * 100 <= SIM * SKETCH, F.ceil(F.col("n") * SIM / 100)).otherwise(F.lit(shared_least(10**9)))
    postings = _rarest_first(reps.select("rep", F.explode("sketch").alias("v")), small, F.col("m") - need + 1)
    texts = _Texts(docs, postings.select(F.col("rep").alias("doc_id")), buckets)
    labels = small.select("rep", F.col("rep").alias("comp"))
    for k in range(HUB_ROUNDS):
        lists = _split_lists(postings, labels)
        # the member with the fewest values of its own stands nearest to the others
        hubs = lists if k == 0 else lists.where(F.col("comp") == F.col("c1" if k % 2 else "c0"))
        hubs = hubs.groupBy("v").agg(F.min(F.struct("alone", "rep", "comp")).alias("hub")).select("v", F.col("hub.rep").alias("b"), F.col("hub.comp").alias("c_b"))
        links = _links(texts, reps, lists.join(hubs, "v").where("comp <> c_b").select(F.col("rep").alias("a"), "b"))
        if links.isEmpty():
            break
        labels = _merge(labels, links)
    left = materialize(_split_lists(postings, labels).select("v", "rep", "n", "at", "comp", "length"), "near-left")
    pairs = _across(left.where(f"length <= {LONG_LIST}"), False)
    dense = left.where(f"length > {LONG_LIST}").select(F.col("rep").alias("doc_id")).distinct()
    if not dense.isEmpty():
        whole = materialize(texts.fetch(dense), "near-dense").mapInArrow(_explode_sets, "rep long, v long")
        whole = _rarest_first(whole, small.withColumn("m", F.col("n")), F.col("n") - F.ceil(F.col("n") * SIM / 100) + 1)
        pairs = pairs.union(_across(whole.join(labels, "rep"), True))
    links = _links(texts, reps, pairs)
    if not links.isEmpty():
        labels = _merge(labels, links)
    per_class = classes.join(labels, "rep").select("sig", "n", "comp")
    rows = sets.select("doc_id", "sig", "n").join(per_class, ["sig", "n"], "left")
    comp = F.coalesce("comp", "doc_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"))
    return out


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, one row each.

    Rows that share a doc_id are one document (see ``one_per_id``). A row without a doc_id belongs to no component and stays as it is.
    """
    single = one_per_id(docs)
    named = single.where("doc_id IS NOT NULL")
    kept = _components_of_single(named.select("doc_id", "text")).where("kept").select("doc_id")
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).union(single.where("doc_id IS NULL"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
