"""Shortest-pack-first packing over the histogram of piece lengths.

Documents are cut into pieces of at most the sequence length. Only the histogram of piece lengths
(one row per length) meets on the driver: there lengths are placed longest first, each time into the
emptiest pattern that takes them, by counts. Patterns then meet pieces by rank within their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_view, materialize, numbered, prepare
from .tokens import segments

LENGTH = 2048


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id",
             text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of whole texts: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    A document's ids end in ``end_id`` (a null or empty text has no other) and are cut every
    ``length`` ids. Repeated rows give repeated pieces.
    """
    prepare(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = segments(vocabulary, spaced=True).ids
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = memoryview(encode(text.as_py()) + end)
                total, doc = len(raw) // 4, doc_id.as_py()
                for a in range(0, total, length):
                    piece = raw[4 * a: 4 * (a + length)]
                    rows.append((doc, a, len(piece) // 4, zlib.crc32(piece), total) + (bytes(piece),) * with_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields, strict=True)],
                [n for n, _ in fields])

    view = column_view(docs, doc_id=id_col, text=text_col)
    return view.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" +
                           ", ids binary" * with_ids)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths in order) that hold every length of the histogram.

    Longest lengths first; each goes to the pattern with the most room, split where only some of its
    packs are needed, and to new packs once no pattern has room.
    """
    if any(not 0 < size <= length for size in histogram):
        raise ValueError("lengths must lie between 1 and the sequence length")
    room: list[tuple[int, int, int, tuple[int, ...]]] = []  # a heap: -gap, order of birth, count, lengths
    full, born = [], 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if room and -room[0][0] >= size:
                gap, birth, count, held = heapq.heappop(room)
                used = min(left, count)
                if used < count:
                    heapq.heappush(room, (gap, birth, count - used, held))
                gap = -gap
            else:
                gap, used, held = length, left, ()
            left, born = left - used, born + 1
            if gap == size:
                full.append((used, held + (size,)))
            else:
                heapq.heappush(room, (size - gap, born, used, held + (size,)))
    return full + [(count, held) for _, _, count, held in sorted(room)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """One row per place of a pattern: the pieces it takes, as positions in the order of lengths."""
    rows, sequence = [], 0
    for count, held in patterns:
        offset = 0
        for size in held:
            rows.append((size, count, sequence, offset))
            offset += size
        sequence += count
    table = pd.DataFrame(rows, columns=["length", "count", "sequence", "offset"], dtype="int64")
    table = table.sort_values(["length", "sequence", "offset"], kind="stable", ignore_index=True)
    table["first"] = table["count"].cumsum() - table["count"]
    return table


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces of one length are ranked by (doc_id, start) through one global numbering in the order of
    (length, doc_id, start), however many share a length. The table of places has a size bounded by
    the histogram, not by the documents. An empty table packs to no row.
    """
    pieces = materialize(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, length))
    first, sequence, offset = (table[c].to_numpy() for c in ("first", "sequence", "offset"))
    names = [*pieces.columns, "sequence_id", "offset"]
    ranked = numbered(pieces, ["length", "doc_id", "start"], "_pos")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            slot = np.searchsorted(first, pos, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[slot] + pos - first[slot], pa.int64()),
                 pa.array(offset[slot], pa.int64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "_pos").mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Token sequences of packed pieces that carry ids: sequence_id, tokens and the end of each piece.

    Padded to ``length`` unless the tokens are already a power of two. A sequence is bounded by
    ``length``, and so is what one group collects.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(held.alias("held"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(h["ids"] for h in held), "<u4")
                pad = 0 if len(ids) & (len(ids) - 1) == 0 else length - len(ids)
                out.append(np.concatenate([ids, np.full(pad, pad_id, "<u4")]).astype(np.int32))
            ends = [[h["offset"] + h["length"] for h in held] for held in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())),
                                              pa.array(ends, pa.list_(pa.int64()))], ["sequence_id", "tokens", "ends"])

    return rows.mapInArrow(lay, "sequence_id bigint, tokens array<int>, ends array<bigint>")
