"""Token ids as Parquet lists: documents in order of id, selective reads.

Texts are dealt by ranges of doc_id, encoded in the tasks that hold the ranges, and
written by Spark's Parquet writer: ids as a dictionary-encoded list column, small
row groups and pages, page indexes. A range of documents then costs only its pages,
and reading metadata touches no ids.

Every row carries its range (``shard``) and the ids before it there; ids before a
range are a running sum over the ranges, so nothing counts through all documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import shared_folder
from .textbytes import LOWER, slices, texts_of

END_ID = 2
CACHED_CHUNKS = 200_000
"""Chunks of text whose ids a worker remembers, twice at most."""
TOGETHER = 1000
BETWEEN = "<|endoftext|>"
"""A special token of the tokenizer; chunks with a ``<|`` are encoded one by one."""
SLICE = 4 << 20

PARQUET = {
    "compression": "snappy",  # packed dictionary numbers hardly shrink any further
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where a dictionary is too large
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True

# letters of words stay in a range where no normal form or lower case makes several of one
_NOT_PLAIN = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-įı-ſ]").search
# how the tokenizer's model spells the bytes of UTF-8 that make up those letters
_BYTE_SIGNS = np.arange(256, dtype="<u4")
_BYTE_SIGNS[0x7F:0xA1] += 0x100 + 33 - 0x7F
_BYTE_SIGNS[0xAD] = 0x143


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts chunk by chunk, each different chunk once.

    The tokenizer drops white space and never joins characters across it, nor a
    letter and the mark after it. Texts are cut there, and equal chunks share ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks. A chunk that is one word of plain letters after its breaks
        (spaces and newlines only: Python's ``strip`` takes more, U+001C to U+001F among
        them, which the tokenizer keeps) skips the normaliser: it is lowered here, goes
        to the model, and its last token shows its end. If the pieces the model gives do
        not agree with the words in number, the words go to the tokenizer whole."""
        words = [c for c in chunks if c.lstrip(" \n").isalpha()]
        line = " ".join(words)
        if _NOT_PLAIN(line):
            words = [c for c in words if not _NOT_PLAIN(c)]
            line = " ".join(words)
        if words:
            line = line.lower()
            if not line.isascii():
                spelled = np.frombuffer(line.encode(), np.uint8)
                line = _BYTE_SIGNS[spelled].tobytes().decode("utf-32-le")
            ids = self._ids(self.plain, line)
            cut = np.append(0, 4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(cut) - 1 == len(words) and cut[-1] == 4 * len(ids):
                raw = ids.tobytes()
                found = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                self.young.update(zip(words, found, strict=True))
        others = [c for c in chunks if c not in self.young]
        for i in range(0, len(others), TOGETHER):
            self._learn_others(others[i : i + TOGETHER])

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        (encoded,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoded.ids, np.int32)

    def _learn_others(self, chunks: list[str]) -> None:
        """Chunks parted by a special token, or alone if they might hold one."""
        if any("<|" in c for c in chunks):
            for c in chunks:
                self.young[c] = self._ids(self.tokenizer, c).tobytes()
            return
        ids = self._ids(self.tokenizer, BETWEEN.join(chunks))
        cut = 4 * np.append(np.flatnonzero(ids == self.between), len(ids))
        raw, cut = ids.tobytes(), cut.tolist()
        first = [0, *(c + 4 for c in cut[:-1])]
        for c, a, b in zip(chunks, first, cut, strict=True):
            self.young[c] = raw[a:b]

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_CHUNKS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = [*map(young.get, chunks)]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i in missing:
            if (ids := old.get(chunks[i])) is not None:
                young[chunks[i]] = ids
        self.learn([chunks[i] for i in missing if chunks[i] not in young])
        for i in missing:
            found[i] = young[chunks[i]]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and the n + 1 borders."""
        plain = b"<|" not in data.tobytes()
        starts = self.cuts(data, offsets, plain)
        if plain:  # names of special tokens mind the case
            data = LOWER[data]
        tiles = pa.Array.from_buffers(
            pa.large_string(),
            len(starts),
            [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)],
        ).dictionary_encode()
        ids = self.ids_of(tiles.dictionary.to_pylist())
        ids.append(np.array([END_ID], np.int32).tobytes())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        which = tiles.indices.to_numpy(zero_copy_only=False)
        per_text = np.searchsorted(starts, offsets)
        which = np.insert(which, per_text[1:], len(ids) - 1)
        n = sizes[which]
        ends = np.cumsum(n)
        source = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n)
        out = flat[source + np.arange(len(source))]
        borders = np.concatenate([[0], ends])[per_text + np.arange(len(per_text))]
        return out, borders

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray, marks: bool = True) -> np.ndarray:
        """Where chunks begin: each text, spaces before a word, a mark after a letter.

        Where the names of special tokens may stand, marks begin none.
        """
        space = _BREAK[data]
        begin = np.zeros(len(data), bool)
        begin[1:] = space[1:] & ~space[:-1]
        if marks:
            begin[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return np.flatnonzero(begin)


_encoders: dict[str, ChunkEncoder] = {}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, text: str = "text") -> None:
    """Writes columns doc_id, shard, start_in_shard, n_tokens, ids to ``folder``.

    Order is by doc_id, null last, then by a hash of the text and the text; rows equal
    in both are written as often as they come. A null text is empty: the end id alone.
    """
    order = [F.col("doc_id").isNull(), "doc_id", F.xxhash64(text)]
    docs = docs.select("doc_id", text)
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order, text)

    def run(batches: Iterator[pa.RecordBatch]):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = ChunkEncoder(tokenizer)
        encoder, shard, written = _encoders[tokenizer], TaskContext.get().partitionId(), 0
        for batch in slices(batches, text, SLICE):
            ids, borders = encoder.encode(*texts_of(batch.column(text)))
            n = np.diff(borders)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(n), shard, np.int32)),
                    pa.array(written + borders[:-1]),
                    pa.array(n),
                    pa.ListArray.from_arrays(
                        pa.array(borders.astype(np.int32)), pa.array(ids, pa.int32())
                    ),
                ],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
            )
            written += int(borders[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, shard int, start_in_shard long, n_tokens long, ids array<int>"
    )
    dealt.mapInArrow(run, schema).write.options(**PARQUET).parquet(folder)


def _with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before.

    Sums are one row per range, so no more than the partitions of one shuffle: they
    are broadcast, and the ids stay where they are read.
    """
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    start = F.col("before") + F.col("start_in_shard")
    shards = F.broadcast(shards.select("shard", before))
    return rows.join(shards, "shard").withColumn("start", start)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; the ids are not read."""
    return _with_starts(spark.read.parquet(folder)).select("doc_id", "start", "n_tokens")


def read_tokens(
    spark: SparkSession, folder: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Ids of the documents from ``first`` to ``last``; other row groups and pages are
    skipped by their statistics."""
    rows = spark.read.parquet(folder)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.select("doc_id", "ids")


def _check_sums(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("start"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_report(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32.

    Lengths and check sums are those of the lists in the files. An empty table writes
    no rows and gives none.
    """
    folder = shared_folder(spark, "tokens")
    write_tokens(docs, folder, tokenizer or default_tokenizer())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        _with_starts(spark.read.parquet(folder))
        .select("doc_id", "start", "ids")
        .mapInArrow(_check_sums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    )
