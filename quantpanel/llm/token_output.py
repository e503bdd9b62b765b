"""Token-id files: documents in ascending doc_id order, ids range-coded in independent, checksummed blocks.

File: magic, then blocks of (ids, words, crc32 of the ids, crc32 of the words, words), then the documents' ids and
lengths, then a footer with the place of the document table. A file holds one range of (doc_id, hash of the text); ``_manifest`` lists
the committed files in order with their counts, so what a lost or repeated task left behind is never read.

Defined cases: null text is empty (the end id alone); documents without a doc_id come first; ties in doc_id are ordered by a hash of the
text, so a doc_id that many rows share is spread over files; an empty table writes an empty manifest; texts of any length span blocks; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_path
from .range_coder import BLOCK_IDS, decode_block, encode_block
from .tokens import encode_slices, token_path

MAGIC = b"TOKBLK01"
HEAD, BLOCK, FOOT = struct.Struct("<8sI"), struct.Struct("<IIII"), struct.Struct("<QQQII8s")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFile:
    """Writes one file; memory is one block and 16 bytes a document."""

    def __init__(self, stream, vocab: int):
        self.stream, self.vocab = stream, vocab
        self.waiting: list[np.ndarray] = []
        self.held = self.at = self.blocks = 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self._put(HEAD.pack(MAGIC, vocab))

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order, their ids one after another."""
        self.docs.extend(docs)
        self.sizes.extend(sizes.tolist())
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self._flush(BLOCK_IDS)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting or [np.zeros(0)]).astype("<u4")
        while len(ids) >= least and len(ids):
            block, ids = ids[:BLOCK_IDS], ids[BLOCK_IDS:]
            words = encode_block(block, self.vocab).tobytes()
            self._put(BLOCK.pack(len(block), len(words) // 4, zlib.crc32(block.tobytes()), zlib.crc32(words)))
            self._put(words)
            self.blocks += 1
        self.waiting, self.held = [ids.copy()], len(ids)

    def close(self) -> None:
        self._flush(1)
        nameless = self.docs.count(None)  # they stand first
        place, rows = self.at, np.array([[0] * nameless + self.docs[nameless:], self.sizes], "<i8").tobytes()
        self._put(rows)
        self._put(FOOT.pack(place, len(self.docs), nameless, self.blocks, zlib.crc32(rows), MAGIC))
        self.stream.close()


def _writer(folder: str, path: str, kind: str, vocab: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files, root = _file_system(folder)
        name, out, first = f"part-{uuid.uuid4().hex}.tok", None, None
        for batch in batches:
            docs, hashes = batch.column("doc_id").to_pylist(), batch.column("h")
            for begin, end, ids, cuts in encode_slices(batch.column("text"), path, kind):
                if out is None:
                    out, first = TokenFile(files.open_output_stream(f"{root}/{name}"), vocab), (docs[begin], hashes[begin].as_py())
                out.add(docs[begin:end], np.diff(cuts), ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_doc": pa.array([first[0]], pa.int64()), "first_hash": pa.array([first[1]], pa.int64()), "docs": pa.array([len(out.docs)], pa.int64()), "tokens": pa.array([sum(out.sizes)], pa.int64())})

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, kind: str = "word") -> None:
    """Tokenises ``docs`` and writes ``folder``; one manifest row per file reaches the driver."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or token_path("word_bpe_49k.json")
    vocab = Tokenizer.from_file(path).get_vocab_size(True) + 1
    files, root = _file_system(folder)
    files.create_dir(root)
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows = ordered.mapInArrow(_writer(folder, path, kind, vocab), "file string, first_doc long, first_hash long, docs long, tokens long").collect()
    start, listed = 0, []
    for r in sorted(rows, key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.first_hash)):
        listed.append({"file": r.file, "docs": r.docs, "tokens": r.tokens, "start": start})
        start += r.tokens
    with files.open_output_stream(f"{root}/_manifest") as out:
        out.write(json.dumps(listed).encode())
    spark.sparkContext.setJobDescription(None)


class _FilePart(InputPartition):
    def __init__(self, file: str, start: int):
        self.file, self.start = file, start


class _TokenReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        files, root = _file_system(self.folder)
        with files.open_input_stream(f"{root}/_manifest") as f:
            return [_FilePart(x["file"], x["start"]) for x in json.loads(f.read())] or [_FilePart("", 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.file:
            return
        files, root = _file_system(self.folder)
        with files.open_input_file(f"{root}/{partition.file}") as f:
            f.seek(f.size() - FOOT.size)
            place, n, nameless, blocks, crc, magic = FOOT.unpack(f.read(FOOT.size))
            f.seek(place)
            rows = f.read(16 * n)
            if magic != MAGIC or zlib.crc32(rows) != crc:
                raise ValueError(f"{partition.file}: damaged document table")
            docs, sizes = np.frombuffer(rows, "<i8").reshape(2, n)
            f.seek(0)
            vocab = HEAD.unpack(f.read(HEAD.size))[1]
            none = np.arange(n) < nameless
            start, k, parts, waiting = partition.start, 0, [], 0
            for _ in range(blocks):
                ids, words, ids_crc, words_crc = BLOCK.unpack(f.read(BLOCK.size))
                raw = f.read(4 * words)
                block = decode_block(np.frombuffer(raw, "<u4"), ids, vocab).tobytes() if zlib.crc32(raw) == words_crc else b""
                if zlib.crc32(block) != ids_crc:
                    raise ValueError(f"{partition.file}: damaged block")
                parts.append(block)
                waiting += len(block)
                if waiting < 4 * sizes[k]:  # a document over many blocks is put together once
                    continue
                held = b"".join(parts)
                ends = 4 * np.cumsum(sizes[k : k + len(held) // 4 + 1])
                whole = int(np.searchsorted(ends, len(held), side="right"))
                if whole:
                    cuts = [0, *ends[:whole].tolist()]
                    pieces = list(map(held.__getitem__, map(slice, cuts, cuts[1:])))
                    starts = start + np.array(cuts[:-1]) // 4
                    for at in range(0, whole, 512):
                        part = slice(at, at + 512)
                        yield pa.RecordBatch.from_arrays([pa.array(docs[k : k + whole][part], mask=none[k : k + whole][part]), pa.array(starts[part], pa.int64()), pa.array(pieces[part], pa.binary())], ["doc_id", "start", "ids"])
                    start, k, held = start + cuts[-1] // 4, k + whole, held[cuts[-1] :]
                parts, waiting = [held], len(held)


class TokenSource(DataSource):
    """``spark.read.format("token_blocks").load(folder)``: doc_id, start (ids before the document), ids."""

    @classmethod
    def name(cls):
        return "token_blocks"

    def schema(self):
        return "doc_id long, start long, ids binary"

    def reader(self, schema):
        return _TokenReader(self.options["path"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_blocks").load(folder)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
