"""Token shards as wavelet matrices: one compressed file per shard, with access, count and lookup.

A shard holds the ids of consecutive documents. Bit-plane ``k`` (highest bit first) has one bit per
token in the order that stable partitioning by the higher bits gives; with counts of ones at every
block border, a token, the number of its occurrences before a place and the place of its n-th
occurrence each take one step per plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_view, prepare, scratch_path, shuffle_partitions
from .tokens import segments

BLOCK = 512
SHARD_TOKENS = 1 << 20
SHARD = ("part int, seq int, part_offset bigint, n_tokens bigint, doc_ids array<bigint>, doc_lens array<bigint>, "
         "zeros array<bigint>, planes binary, ranks binary")


class WaveletMatrix:
    """Bit-planes over ``n`` tokens below ``2 ** len(zeros)``."""

    def __init__(self, n: int, zeros: list[int], planes: bytes, ranks: bytes):
        self.n, self.zeros = n, list(zeros)
        width = -(-n // 8)
        self.planes = np.frombuffer(planes, np.uint8).reshape(len(self.zeros), width)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(len(self.zeros), -1)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, top = len(ids), int(ids.max()) if len(ids) else 0
        x = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for k in reversed(range(max(1, top.bit_length()))):
            ones = (x & x.dtype.type(1 << k)) != 0
            first, second = np.flatnonzero(~ones), np.flatnonzero(ones)
            planes.append(np.packbits(ones, bitorder="little"))
            zeros.append(len(first))
            # ones before each block
            ranks.append(np.searchsorted(second, np.arange(0, n + 1, BLOCK)).astype("<u4"))
            x = np.concatenate([x[first], x[second]])
        return cls(n, zeros, np.concatenate(planes).tobytes() if n else b"", np.concatenate(ranks).tobytes())

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane ``k`` before place ``at``."""
        start = at // BLOCK
        bits = np.unpackbits(self.planes[k, start * BLOCK // 8: -(-at // 8)], bitorder="little")
        return int(self.ranks[k, start]) + int(bits[: at - start * BLOCK].sum())

    def _bit(self, k: int, at: int) -> int:
        return int(self.planes[k, at >> 3] >> (at & 7)) & 1

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for k, z in enumerate(self.zeros):
            bit, ones = self._bit(k, at), self._ones(k, at)
            token, at = 2 * token + bit, z + ones if bit else at - ones
        return token

    def _bits(self, token: int) -> list[int] | None:
        m = len(self.zeros)
        return [token >> (m - 1 - k) & 1 for k in range(m)] if 0 <= token < 1 << m else None

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` before place ``at``."""
        bits = self._bits(token)
        if bits is None or not self.n:
            return 0
        low, high = 0, min(at, self.n)
        for k, bit in enumerate(bits):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if bit else (low - a, high - b)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        """Place of the n-th (from 0) ``bit`` of plane ``k``."""
        ones = self.ranks[k].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        part = np.unpackbits(self.planes[k, block * BLOCK // 8: (block + 1) * BLOCK // 8], bitorder="little")
        part = part[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == bit)[nth - int(before[block])])

    def select(self, token: int, nth: int) -> int:
        """Place of the n-th (from 0) occurrence of ``token``."""
        bits = self._bits(token)
        if bits is None or not 0 <= nth < self.count(token):
            raise IndexError((token, nth))
        at = 0
        for k, bit in enumerate(bits):
            a = self._ones(k, at)
            at = self.zeros[k] + a if bit else at - a
        at += nth
        for k in reversed(range(len(bits))):
            at = self._select_bit(k, bits[k], at - self.zeros[k] if bits[k] else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, i) for i in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens in order."""
        out = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for k in reversed(range(len(self.zeros))):
            ones = np.unpackbits(self.planes[k], bitorder="little")[: self.n].astype(bool)
            first, second = np.flatnonzero(~ones), np.flatnonzero(ones)
            here = np.empty_like(out)
            here[first] = out[: len(first)]
            here[second] = out[len(first):] | out.dtype.type(1 << (len(self.zeros) - 1 - k))
            out = here
        return out


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS, spaced: bool = False,
                 parts: int | None = None) -> None:
    """Encode whole texts and write them in ascending id order as wavelet shards below ``path``.

    Documents are dealt by ranges of their id, so a shard is made where its documents are and no
    token is shuffled. A shard closes at the document that fills ``shard_tokens``: it holds that many
    ids and one document at most beyond. Null ids come first; rows of one id keep the order of their
    texts. A null or empty text has the end id alone. An empty table gives no shard.
    """
    spark = prepare(docs.sparkSession)
    view = column_view(docs, doc_id=id_col, text=text_col)
    n = parts or shuffle_partitions(spark)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = segments(vocabulary, spaced).ids
        end = np.array([end_id], "<u4").tobytes()
        schema = pa.schema([
            ("part", pa.int32()), ("seq", pa.int32()), ("part_offset", pa.int64()), ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())),
            ("zeros", pa.list_(pa.int64())), ("planes", pa.binary()), ("ranks", pa.binary())])
        part, seq, offset, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, lens, raw = [], [], []

        def shard():
            wm = WaveletMatrix.build(np.frombuffer(b"".join(raw), "<u4"))
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "part_offset": offset, "n_tokens": wm.n, "doc_ids": ids,
                "doc_lens": lens, "zeros": wm.zeros, "planes": wm.planes.tobytes(),
                "ranks": wm.ranks.tobytes()}], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw.append(encode(text.as_py()) + end)
                ids.append(doc_id.as_py())
                lens.append(len(raw[-1]) // 4)
                held += lens[-1]
                if held >= shard_tokens:
                    yield shard()
                    seq, offset, held, ids, lens, raw = seq + 1, offset + held, 0, [], [], []
        if raw:
            yield shard()

    (view.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(build, SHARD)
     .write.option("compression", "zstd").parquet(path))


def with_starts(shards: DataFrame) -> DataFrame:
    """Shards with ``start``, the number of ids before theirs in the whole corpus.

    One row per range partition is summed in order and broadcast: its size is the partition count.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
            .select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return (shards.join(F.broadcast(base), "part")
            .withColumn("start", F.col("_base") + F.col("part_offset")).drop("_base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents decoded from shards: doc_id, start, n_tokens and the ids as little-endian integers."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids", pa.binary())])
        for batch in batches:
            for row in range(batch.num_rows):
                n, start, doc_ids, lens, zeros, planes, ranks = (batch.column(c)[row].as_py() for c in range(7))
                raw = memoryview(WaveletMatrix(n, zeros, planes, ranks).decode().astype("<u4").tobytes())
                ends = np.cumsum(np.array(lens, np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(start + ends - lens), pa.array(lens, pa.int64()),
                    pa.array([bytes(raw[4 * (e - m): 4 * e]) for e, m in zip(ends.tolist(), lens, strict=True)],
                             pa.binary())], schema=schema)

    return with_starts(shards).select("n_tokens", "start", "doc_ids", "doc_lens", "zeros", "planes", "ranks").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """Every place (from 0, in the whole corpus) where ``token`` occurs, read by select."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, start, zeros, planes, ranks = (batch.column(c)[row].as_py() for c in range(5))
                places = WaveletMatrix(n, zeros, planes, ranks).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([start + p for p in places], pa.int64())], ["place"])

    return with_starts(shards).select("n_tokens", "start", "zeros", "planes", "ranks").mapInArrow(find, "place bigint")


def token_file_digests(docs: DataFrame, vocabulary: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs`` in the shared folder, read them back, and digest each document."""
    spark = docs.sparkSession
    path = scratch_path(prepare(spark), "wavelet")
    write_shards(docs, path, vocabulary, end_id, shard_tokens=shard_tokens)
    # the digest is Spark's own: crc32 over the decoded bytes
    return read_documents(spark.read.parquet(path)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["WaveletMatrix", "find_token", "read_documents", "token_file_digests", "with_starts", "write_shards"]
