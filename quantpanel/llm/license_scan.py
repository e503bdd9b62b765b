"""License scan: an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a window of ``2 * STRIDE`` words of a text's whole word sequence, line feeds or not; windows begin every ``STRIDE`` words, and no template
is longer than that, so every notice lies whole in one. A template is a set of words. A block meets a template if it holds at least
``threshold`` of its words. The template words are ordered by document frequency over the whole corpus, rarest first. With n words and o = ceil(threshold * n)
needed, a meeting block holds one of the first n - o + 1 (prefix filter), at least o distinct words (length filter), and
enough words after its first match in both orders (positional filter). Only blocks that pass are compared in full. Every template
that a block meets is reported. Of these meets, a variant gives way where another template in that block or one beside it matched all of its
words there and more, or the same words as a larger part of its own: notices that differ in a version or a clause do not name each other. A
template all of whose words stand in a row in the block stays whatever else stands there.
The template table is a fixed parameter, so broadcasting it is bounded.

Beside the templates, ``PHRASES`` are found wherever their words stand consecutively, with their places.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows and rows without a doc_id are scanned each for itself;
very long texts are cut into windows in whole; labels are distinct, sorted and comma-joined, the empty string if none; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

THRESHOLD = 0.8
STRIDE = 16
# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# License notices in common use and their labels.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "reserved"),
)
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, _BREAK + "+"), lambda w: w != "")


def _any_word(phrases: list[str]) -> str:
    """A pattern for a place where one of the phrases stands as whole words."""
    return f"(?i)(?<!{_WORD})(?:{'|'.join((_BREAK + '+').join(p.split()) for p in phrases)})(?!{_WORD})"


def token_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The template words by document frequency, rarest first; as many rows as the templates have words."""
    vocab = sorted({w for text, _ in templates for w in text.split()})
    held = F.array_distinct(F.regexp_extract_all(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), F.lit(_any_word(vocab)), F.lit(0)))
    counts = {r.w: r.n for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def keyed(docs: DataFrame) -> DataFrame:
    """Equal rows have equal keys, and equal results."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def similar_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, block (window number), template, label, matched (its words there), containment, in_row (its words stand there in a row) of every block and template it meets."""
    spark = docs.sparkSession
    if any(len(text.split()) > STRIDE for text, _ in templates):
        raise ValueError(f"a template has more than {STRIDE} words")
    order = token_order(docs, templates)
    rows, prefixes = [], set()
    for k, (text, label) in enumerate(templates):
        tokens = sorted(set(text.split()), key=order.index)
        phrase = f" {text} "
        need = math.ceil(threshold * len(tokens) - 1e-9)
        for i, t in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((t, k, label, i, need, tokens, phrase))
            prefixes.add(t)
    index = F.broadcast(spark.createDataFrame(rows, "token string, template int, label string, i int, need int, tokens array<string>, phrase string"))
    sought = F.array(*map(F.lit, sorted(prefixes)))
    blocks = docs.where(F.col("text").rlike(_any_word(sorted(prefixes)))).select("key", words_of(F.col("text")).alias("words"))
    window = lambda k: F.struct(k.alias("block"), F.slice("words", k * STRIDE + 1, 2 * STRIDE).alias("words"))
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRIDE).cast("int")), window)
    blocks = blocks.where("size(words) > 0").dropDuplicates(["key"]).select("key", F.explode(F.filter(windows, lambda w: F.arrays_overlap(w["words"], sought))).alias("w"))
    ordered = F.array_intersect(F.array(*map(F.lit, order)), "w.words")
    blocks = blocks.select("key", "w.block", F.size(F.array_distinct("w.words")).alias("n_words"), ordered.alias("known"), F.concat(F.lit(" "), F.array_join("w.words", " "), F.lit(" ")).alias("said"))
    hits = blocks.select("*", F.posexplode("known").alias("j", "token")).join(index, "token")
    hits = hits.where("n_words >= need AND 1 + least(size(tokens) - i - 1, size(known) - j - 1) >= need")
    hits = hits.withColumn("matched", F.array_intersect("known", "tokens")).where("size(matched) >= need")
    return hits.groupBy("key", "block", "template", "label", "matched").agg((F.size("matched") / F.max(F.size("tokens"))).alias("containment"), F.max(F.contains("said", "phrase")).alias("in_row"))


def own_templates(blocks: DataFrame) -> DataFrame:
    """The met templates but the variants of a better one in the same block or one beside it."""
    other = blocks.select("key", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("block"), F.col("matched").alias("more"), F.col("containment").alias("part"))
    better = (F.size("more") > F.size("matched")) | (F.col("part") > F.col("containment"))
    covered = ~F.col("in_row") & better & (F.size(F.array_except("matched", "more")) == 0)
    return blocks.join(other, ["key", "block"]).groupBy("key", "block", "template", "label", "containment").agg(F.max(covered).alias("covered")).where("NOT covered")


def phrase_places(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """key, doc_id, n_words, n_base, first_word, last_word, base (array of labels) for every row."""
    sought = F.col("text").rlike(_any_word([p for p, _ in phrases]))
    rows = docs.select(
        "key",
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(_WORD + "+")), F.lit(0)).cast("long").alias("n_words"),
        F.when(F.coalesce(sought, F.lit(False)), words_of(F.col("text"))).alias("words"),
    )
    found = [F.transform("words", _start_of(p.split())) for p, _ in phrases]
    rows = rows.select("key", "doc_id", "n_words", *(F.filter(f, lambda x: x.isNotNull()).alias(f"p{k}") for k, f in enumerate(found)))
    every = F.concat(*(F.coalesce(f"p{k}", F.array().cast("array<int>")) for k in range(len(phrases))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))))
    rows = rows.select("key", "doc_id", "n_words", every.alias("places"), base.alias("base"))
    return rows.select("key", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base")


def _start_of(phrase: list[str]):
    return lambda w, i: F.when(w == phrase[0], F.when(_follows(i, phrase[1:]), i))


def _follows(i: Column, rest: list[str]) -> Column:
    ok = F.lit(True)
    for k, w in enumerate(rest, 1):
        ok = ok & F.coalesce(F.get(F.col("words"), i + k) == w, F.lit(False))
    return ok


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: its words, phrase places, labels and score (the largest containment; a phrase counts 1)."""
    docs = keyed(docs)
    blocks = own_templates(materialize(similar_blocks(docs, threshold=threshold), "license-blocks"))
    per_doc = blocks.groupBy("key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("containment"))
    joined = phrase_places(docs).join(per_doc, "key", "left")
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("containment", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"), score.alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda s: "'" + s + "'"
    low = f"translate(coalesce(%s, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    words = lambda c: rf"list_filter(string_split_regex({low % c}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    places = []
    for p, label in PHRASES:
        w = p.split()
        test = " AND ".join(f"w[i + {k}] = {quoted(x)}" for k, x in enumerate(w))
        places.append(f"SELECT doc_id, i - 1 AS place, {quoted(label)} AS label FROM p WHERE {test}")
    return f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS ({' UNION ALL '.join(places)}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM f GROUP BY doc_id),
k AS (SELECT doc_id, s // {STRIDE} AS block, list_slice(w, s + 1, s + {2 * STRIDE}) AS v FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS s FROM d)),
t AS (SELECT s.tokens, s.label, s.phrase FROM (SELECT unnest([{', '.join(f"{{'tokens': [{', '.join(map(quoted, sorted(set(t.split()))))}], 'label': {quoted(label)}, 'phrase': {quoted(t)}}}" for t, label in TEMPLATES)}]) AS s)),
n AS (SELECT doc_id, block, label, list_intersect(v, tokens) AS matched, len(tokens) AS n, contains(' ' || array_to_string(v, ' ') || ' ', ' ' || phrase || ' ') AS whole FROM k, t
      WHERE list_has_any(v, tokens) AND len(list_intersect(v, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
m AS (SELECT * FROM n WHERE whole OR NOT EXISTS (SELECT 1 FROM n AS x WHERE x.doc_id = n.doc_id AND abs(x.block - n.block) <= 1 AND list_has_all(x.matched, n.matched)
      AND (len(x.matched) > len(n.matched) OR len(x.matched) * n.n > len(n.matched) * x.n))),
o AS (SELECT doc_id, list(DISTINCT label) AS own, max(len(matched) / n) AS containment FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(containment, 0.0))::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)
"""


OP4_SQL = _sql()
