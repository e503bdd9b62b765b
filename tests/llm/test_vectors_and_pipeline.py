from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quantpanel.llm import ann, language_id, mixing, queries, tokens

from ..conftest import SF
from .test_text import _components, _dedup_lines, _ids


def test_recall_against_brute_force(spark):
    got = queries.queries()["op7_ann"](spark, SF).toPandas()
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(frame.embedding.tolist(), float), frame.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = asked = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(own.score) <= 0).all() and q not in set(own.vec_id)
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(own.vec_id))
        asked += 5
    assert hit / asked >= 0.9


def test_probe_finds_every_code_in_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (2000, 8), dtype=np.uint8)
    index = ann.HashIndex(codes)
    for radius in (0, 5, 17, 24, 31, 64):
        for q in codes[:20]:
            assert set(index.probe(q, radius)) == set(np.flatnonzero(ann.hamming(codes, q) <= radius))


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, score int"
    rows = [(0, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], 1, 1), (3, None, 1, 1), (4, [0.0, 0.0], 1, 1), (5, [float("nan"), 1.0], 1, 1), (6, [None, 1.0], 1, 1), (7, [], 1, 1), (None, [1.0, 0.0], 1, 1), (8, [0.0, 1.0], 1, 1), (9, [1.0, 2.0, 3.0], 1, 1)]
    got = ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 1.0), (0, 2, 1.0), (0, 8, 0.0)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = docs.persist()
        counts.append(docs.count())
    assert counts[1] >= 0.97 * counts[0] and counts[3] <= counts[2] and counts[5] > 0


def test_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(7)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9000, 40))
    rows = [(i, text(), "en", "ab"[i % 2], 1) for i in range(20)]
    rows += [rows[0]] * 4 + [(None, text(), "en", "a", 1), (None, text(), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()
    assert sorted(map(tuple, one), key=str) == sorted(set(rows), key=str)
    counts = mixing.copies(mixing.sized(docs)).collect()
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    want = Counter()
    for r in counts:
        want[r.doc_id] += r.copies
    assert mixed == +want and mixed[0] <= 5 * mixing.MAX_EPOCHS


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, score string, row string"


def _small_table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", "h", "s", "r") for r in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what the stage before kept, each against plain loops; extra columns of clashing names, null and odd texts among the rows."""
    rng = np.random.default_rng(21)
    real = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(40).collect()]
    passage = " ".join(f"wort{x}" for x in rng.integers(0, 900, 70)) + ".\n"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in real]
    rows += [(9000 + k, real[k].text[:400] + "\n" + passage, real[k].lang, "x") for k in (1, 2, 3)] + [(9100, real[5].text + " more", real[5].lang, None), (9101, None, "en", "x"), (9102, "", None, "x"), (9103, "12 !!", None, None)]
    folder = _small_table(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        after[name] = docs.collect()
    given = {r[0]: r for r in rows}
    said = {r.doc_id: r for r in language_id.identify(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    kept = {r.doc_id: r.text for r in after["language_id"]}
    assert kept == {i: given[i][1] for i, r in said.items() if r.lang_pred != "und" and r.score >= language_id.MIN_SCORE} and not {9101, 9102, 9103} & set(kept)
    cut = _dedup_lines(list(kept.items()))
    lines = {r.doc_id: (r.text, r.n_chars) for r in after["line_dedup"]}
    assert lines == {i: (t, len(t)) for i, t in cut.items() if t or not kept[i]}
    assert sum(passage[:-1] in t for t, _ in lines.values()) == 1
    label, _ = _components([(i, t) for i, (t, _) in lines.items()])
    near = {r.doc_id: r.text for r in after["near_dedup"]}
    assert near == {i: t for i, (t, _) in lines.items() if label[i] == i}
    size = lambda t: len(t.encode().split())
    times, per = Counter(r.doc_id for r in after["mixing"]), Counter()
    for i, t in near.items():
        per[given[i][3]] += size(t)
    assert set(times) <= set(near) and max(times.values()) <= mixing.MAX_EPOCHS and {(r.doc_id, r.text) for r in after["mixing"]} <= set(near.items())
    left, weights, targets = dict(per), dict(zip(sorted(per, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(per))), {}
    total = sum(per.values())
    while left:  # water-filling, source by source
        room = total - sum(targets.values())
        full = [s for s in left if room * weights[s] / sum(weights[x] for x in left) >= 3 * per[s]]
        targets |= {s: 3.0 * per[s] for s in full} if full else {s: room * weights[s] / sum(weights[x] for x in left) for s in left}
        left = {s: v for s, v in left.items() if s not in targets}
    for source in per:
        taken = sum(n * size(near[i]) for i, n in times.items() if given[i][3] == source)
        assert abs(taken - targets[source]) <= max(size(t) for i, t in near.items() if given[i][3] == source)
    encode = tokens.Encoder(tokens.token_path("byte_bpe_50k.json"), "byte")
    ids = dict(zip(near, (len(x) // 4 for x in _ids(encode, list(near.values())))))
    packed, by_seq = Counter(), {}
    for r in after["packing"]:
        packed[r.doc_id] += r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert packed == {i: n * ids[i] for i, n in times.items()}
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = _small_table(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    nothing = _small_table(spark, tmp_path / "b", [(1, None, None, None), (2, "", None, "x")])
    assert corpus_pipeline.run(spark, nothing).count() == 0
