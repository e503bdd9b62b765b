"""Packing documents into fixed-length sequences: first-fit decreasing in randomised groups.

A seeded hash deals the documents, texts and all, into groups of about ``group_docs`` (their number follows the row count, so a group
stays small at any size), and whole groups into tasks, which tokenise and pack them in one go; ids never travel. A group
that holds more than ``group_tokens`` ids is packed in parts, so a task holds no more than that and one document.
In a group every full ``capacity`` of a long document is a sequence of its own, and the remainders are
packed by first-fit decreasing, the first bin that fits found in a tournament tree over free capacities.
The sparsest bins of a group are then cut up to fill the gaps of the others, so a group pads about one sequence.
Rows are ordered in a task, so a repeated task packs alike.

Defined cases: null text is empty (one token, the end id); a null doc_id is packed as such; a document of any length is cut, never
truncated; ties in length go to the earlier row in the group's order; repeated rows are packed as separate documents; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encode_slices, token_path

CAPACITY = 2048
GROUP_DOCS = 1024
GROUP_TOKENS = 4_000_000
SEED = 29
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Leftmost bin whose free capacity is at least a given one; inner nodes hold the largest below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, its free capacity before); the bin's capacity shrinks by ``need``."""
        free, k = self.free, 1
        while k < self.leaves:
            k *= 2
            if free[k] < need:
                k += 1
        before = free[k]
        free[k] = before - need
        leaf = k
        k //= 2
        while k:
            free[k] = max(free[2 * k], free[2 * k + 1])
            k //= 2
        return leaf - self.leaves, before


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, largest items first."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree, bins = TournamentTree(len(lengths), capacity), []
    for i in order:
        b, before = tree.place(lengths[i])
        if before == capacity:
            bins.append([])
        bins[b].append(i)
    return bins


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length); items may be longer than ``capacity``."""
    sequences = [[(i, s, capacity)] for i, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = [(i, n - n % capacity, n % capacity) for i, n in enumerate(lengths) if n % capacity]
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    bins.sort(key=lambda b: (-sum(p[2] for p in b), b))
    fill = [sum(p[2] for p in b) for b in bins]
    k, last = 0, len(bins) - 1
    while k < last:  # the sparsest bins give their pieces to the gaps of the fullest
        if fill[k] == capacity:
            k += 1
            continue
        if not bins[last]:
            bins.pop()
            last -= 1
            continue
        i, s, n = bins[last].pop()
        take = min(n, capacity - fill[k])
        bins[k].append((i, s, take))
        fill[k] += take
        fill[last] -= take
        if n > take:
            bins[last].append((i, s + take, n - take))
    return sequences + [b for b in bins if b]


class _Group:
    """The documents of a group that wait to be packed."""

    def __init__(self, group: int | None, capacity: int, keep_ids: bool):
        self.group, self.capacity, self.keep_ids = group, capacity, keep_ids
        self.done = self.held = 0
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.ids.append(ids)
        self.held += len(ids)

    def pack(self):
        """A batch of pieces of all that waits; sequences count on from those packed before."""
        import pyarrow as pa

        out, kept = [], []
        packed = pack_lengths([len(x) for x in self.ids], self.capacity)
        raw = [memoryview(x.astype("<u4", copy=False)).cast("B") for x in self.ids]
        for q, pieces in enumerate(packed, self.done):
            offset = 0
            for i, start, n in pieces:
                piece = raw[i][4 * start : 4 * (start + n)]
                out.append((self.docs[i], start, n, zlib.crc32(piece), len(self.ids[i]), (self.group << 32) | q, offset))
                if self.keep_ids:
                    kept.append(bytes(piece))
                offset += n
        self.done += len(packed)
        self.docs, self.ids, self.held = [], [], 0
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * self.keep_ids, names + ["ids"] * self.keep_ids)


def _pack(path: str, kind: str, capacity: int, group_tokens: int, keep_ids: bool):
    def run(batches: Iterator) -> Iterator:
        now = None
        for batch in batches:
            docs, groups = batch.column("doc_id").to_pylist(), batch.column("group").to_pylist()
            for begin, end, ids, cuts in encode_slices(batch.column("text"), path, kind):
                for k in range(begin, end):
                    if now is None or groups[k] != now.group or now.held >= group_tokens:
                        if now is not None and now.docs:
                            yield now.pack()
                        if now is None or groups[k] != now.group:
                            now = _Group(groups[k], capacity, keep_ids)
                    # a slice's ids would stay as long as a part of them is held
                    now.add(docs[k], ids[cuts[k - begin] : cuts[k - begin + 1]].copy())
        if now is not None and now.docs:
            yield now.pack()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, kind: str = "byte", group_docs: int = GROUP_DOCS, group_tokens: int = GROUP_TOKENS, seed: int = SEED, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``keep_ids`` also ids, little-endian unsigned 32-bit."""
    path = path or token_path("byte_bpe_50k.json")
    groups = max(1, -(-docs.count() // group_docs))
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    dealt = docs.select("doc_id", "text", F.pmod(order, F.lit(groups)).alias("group"), order.alias("order"))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "order", "doc_id").drop("order")
    return dealt.mapInArrow(_pack(path, kind, capacity, group_tokens, keep_ids), PIECES + ", ids binary" * keep_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
