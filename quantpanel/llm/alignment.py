"""Token boundaries of two tokenizers aligned over a corpus: groups, links, and corpus-wide counts of linked id pairs.

Each distinct text is tokenised and aligned once: texts are shuffled whole and counted (equal ones merged before they travel), and a slice of
texts at a time is encoded by both vocabularies and cut where tokens of both end, in numpy. The written table holds, per text, its
measures and its distinct linked pairs. Pair counts are sums over that table, weighted by how often a text stands in the corpus. The counts
come back to the texts in two ways: the ``HOT_PAIRS`` commonest pairs, a bounded table that serves most links, are broadcast; all others
meet by a shuffled join, in which no key is hot. Measures reach doc_ids by the texts' SHA-256.

Defined cases: a text that is null or empty, or whose tokens do not spell out space + text, has no tokens (zeros and ''); special
tokens' names in a text are plain text; a text of any length is aligned whole; a repeated row, or a doc_id that repeats, gives a row each; a
null doc_id is kept; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .tokens import _BYTES, Encoder, _Pieces, _ragged, slices, token_path

C = F.col
HOT_PAIRS = 1 << 16
SLICE_BYTES = 1_000_000
ALIGNED = "id long, digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, held array<int>"

_sides: dict[tuple[str, str], "Sides"] = {}


class PieceEncoder(Encoder):
    """Ids of a sentencepiece BPE model with byte fallback, by words.

    No piece has a space after another sign and none holds a line feed, so what starts at a space or a line feed is encoded alone. A
    word stands for a space and itself, "" for a space, and a word that begins with a line feed for itself. Texts with runs of
    spaces, or the sign that stands for a space, are encoded whole.
    """

    ODD = "  |^ |▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.space = self.model.piece_to_id("▁")
        self.memo = self._seeded()

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def _seeded(self) -> _Pieces:
        memo = _Pieces()
        memo.add([""], np.array([self.space], np.uint32), np.array([1], np.int64))
        return memo

    def _learn(self, pieces: list[str]) -> None:
        found = [ids[1:] if p[0] == "\n" else ids for p, ids in zip(pieces, self.model.encode(pieces, num_threads=1))]
        self.memo.add(pieces, np.fromiter((i for ids in found for i in ids), np.uint32), np.array(list(map(len, found)), np.int64))

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, self.ODD) if self.by_word else pa.array([True] * len(texts))
        words = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        ids, ends = self.memo_gather(coded)
        last = words.offsets.to_numpy().astype(np.int64)[1:] - words.offsets[0].as_py() - 1
        cuts = np.concatenate([[0], ends[last]])
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            parts = np.split(ids, cuts[1:-1])
            for k in whole.tolist():
                parts[k] = np.array(self.whole(texts[k].as_py()), np.uint32)
            ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
        return ids, cuts

    def memo_gather(self, coded) -> tuple[np.ndarray, np.ndarray]:
        slots = self._slots(coded.dictionary.to_pylist())
        return self.memo.gather(slots[coded.indices.to_numpy()])


class _Bytes:
    """The bytes of every id, end to end."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array(list(map(len, spelled)), np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ragged(self.begin, self.size, ids)[0]]


class Sides:
    """Both vocabularies; A is byte-level BPE, B a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a, "byte"), PieceEncoder(path_b)
        self.a.tokenizer.encode_special_tokens = True
        signs = {chr(c): b for b, c in _BYTES.items()}
        vocabulary = self.a.tokenizer.get_vocab(True)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            spelled[i] = bytes(signs[c] for c in piece) if all(c in signs for c in piece) else piece.encode()
        model = self.b.model
        size = model.get_piece_size()
        self.bytes_a = _Bytes(spelled)
        self.bytes_b = _Bytes([bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)])
        self.n_b = size
        #: id and what follows it: the next of its side, the other side, the next group.
        self.shown = [f"{i}{after}" for i in range(max(len(spelled), size)) for after in ",|;"]

    def encode_a(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text: those of a word, a space and the text, without the word's and the end's, which are one each."""
        import pyarrow.compute as pc

        ids, cuts = self.a(pc.binary_join_element_wise("a", texts, " "))
        stay = np.ones(len(ids), bool)
        stay[cuts[:-1]] = stay[cuts[1:] - 1] = False
        return ids[stay], cuts - 2 * np.arange(len(cuts))

    def spelled_out(self, texts, a, cuts_a, b, cuts_b) -> np.ndarray:
        """Which texts both sides spell out, byte by byte."""
        import pyarrow as pa
        import pyarrow.compute as pc

        want = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
        length = lambda table, ids, cuts: np.diff(np.concatenate([[0], np.cumsum(table.size[ids])])[cuts])
        good = (length(self.bytes_a, a, cuts_a) == want) & (length(self.bytes_b, b, cuts_b) == want)
        chosen = np.flatnonzero(good)
        if len(chosen):
            text = np.frombuffer(b"".join(pc.binary_join_element_wise("", texts, " ").take(pa.array(chosen)).cast(pa.binary()).to_pylist()), np.uint8)
            ends = np.cumsum(want[chosen])
            for table, ids, cuts in ((self.bytes_a, a, cuts_a), (self.bytes_b, b, cuts_b)):
                wrong = np.flatnonzero(table.of(ids[np.repeat(good, np.diff(cuts))]) != text)
                good[chosen[np.unique(np.searchsorted(ends, wrong, side="right"))]] = False
        return good

    def align(self, texts) -> tuple[np.ndarray, dict]:
        """(which texts have tokens, per such text its measures)."""
        a, cuts_a = self.encode_a(texts)
        b, cuts_b = self.b(texts)
        good = self.spelled_out(texts, a, cuts_a, b, cuts_b)
        n_a, n_b = np.diff(cuts_a)[good], np.diff(cuts_b)[good]
        a, b = a[np.repeat(good, np.diff(cuts_a))].astype(np.int64), b[np.repeat(good, np.diff(cuts_b))].astype(np.int64)
        end_a, end_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        meets = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[np.minimum(meets, len(end_b) - 1)] == end_a) if len(end_b) else np.zeros(0, np.int64)
        last_b = meets[last_a]  # the last tokens of every group
        edge_a, edge_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        text = np.searchsorted(edge_a, last_a, side="right") - 1
        n_groups = np.bincount(text, minlength=len(n_a))
        # A's ids of a group, then B's
        wide_a, wide_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(last_b + 1 - wide_b, wide_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, wide_b)
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[last_a], after_b[last_b] = 1, 2
        shown = np.empty(len(a) + len(b), np.int64)
        shown[place_a], shown[place_b] = 3 * a + after_a, 3 * b + after_b
        edge = edge_a + edge_b
        digests = [hashlib.sha256("".join(map(self.shown.__getitem__, shown[s:e].tolist()))[:-1].encode()).hexdigest() for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]
        span = len(self.bytes_a.size) * self.n_b
        keys, held = np.unique(text * span + a[last_a] * self.n_b + b[last_b], return_counts=True)
        own = np.searchsorted(keys, np.arange(len(n_a) + 1) * span)
        return good, {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups, "groups_sha256": digests, "pairs": keys % span, "held": held.astype(np.int32), "own": own}


def sides(path_a: str, path_b: str) -> Sides:
    """One per worker process."""
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = Sides(path_a, path_b)
    return _sides[path_a, path_b]


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        both, at = sides(path_a, path_b), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in ALIGNED.split(", ")]
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for begin, end in slices(texts, SLICE_BYTES):
                good, m = both.align(texts.slice(begin, end - begin))
                rows = pa.array(begin + np.flatnonzero(good))
                ids = np.arange(at, at + len(rows))
                at += len(rows)
                lists = [pa.ListArray.from_arrays(pa.array(m["own"], pa.int32()), pa.array(m[c])) for c in ("pairs", "held")]
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("digest").take(rows), batch.column("n").take(rows), *(pa.array(m[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(m["groups_sha256"], pa.string()), *lists], names)

    return run


def _digest(c: str = "text"):
    return F.unhex(F.sha2(C(c), 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``ALIGNED``: a row per distinct text that has tokens, written. pairs are A's id times B's size plus B's id."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("n")).withColumn("digest", _digest())
    return materialize(texts.mapInArrow(_aligner(path_a, path_b), ALIGNED), "aligned-texts")


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.select("id", "n", F.inline(F.arrays_zip("pairs", "held"))).withColumnRenamed("pairs", "pair")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, count, best): links of the whole corpus that hold the pair, and whether no A id has more with this B id. Written."""
    counts = materialize(_links(aligned).groupBy("pair").agg(F.sum(C("held") * C("n")).alias("count")).withColumn("b", C("pair") % n_b), "pair-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # at most a row for each id of B
    return counts.join(F.broadcast(top), "b").select("pair", F.expr(f"pair div {n_b}").alias("a"), "b", "count", (C("count") == C("top")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    path_a, path_b = path_a or token_path("byte_bpe_50k.json"), path_b or token_path("piece_bpe_32k.model")
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = aligned_texts(docs, path_a, path_b)
    counts = pair_counts(aligned, n_b).select("pair", "count", C("best").cast("long").alias("best"))
    hot = materialize(counts.orderBy(F.desc("count"), "pair").limit(hot_pairs), "hot-pairs")
    links = _links(aligned).drop("n")
    near = links.join(F.broadcast(hot), "pair")
    far = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(counts, "pair")
    sums = near.unionByName(far).groupBy("id").agg(F.sum(C("held") * C("best")).alias("n_best"), F.sum(C("held") * C("count")).alias("count_sum"))
    measures = aligned.drop("pairs", "held", "n").join(sums, "id").drop("id")
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), _digest().alias("digest")).join(measures, "digest", "left")
    zeros = (F.coalesce(C(c), F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return rows.select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
