"""Preference formatting: the longest common turn prefix once as prompt, two masked completions; a row per turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_view, join_groups, materialize, prepare, shuffle_partitions
from .tokens import segments

TEMPLATE = "<{role}>\n{text}\n"


def _ranked(chosen: DataFrame, rejected: DataFrame, vocabulary: str, with_ids: bool, columns: dict[str, str]) -> DataFrame:
    """Turns of both sides: conv_id, side (0 chosen), role, text, rank, digest, n_tokens and, if asked for, ids.

    Turns are dealt by range of (conversation, side, turn, role, text) and counted in a stream, so a
    conversation of any length is ranked by many tasks. Only groups that span ranges are shifted: fewer
    than there are ranges, which makes their broadcast safe.
    """
    spark = chosen.sparkSession
    sides = [column_view(df, **columns).where("conv_id IS NOT NULL").withColumn("side", F.lit(i)) for i, df in enumerate((chosen, rejected))]
    turns = sides[0].unionByName(sides[1]).select(
        "conv_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    fields = [("digest", pa.binary()), ("n_tokens", pa.int64()), ("rank", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = segments(vocabulary, spaced=True).ids
        last, rank = None, 0
        for batch in batches:
            rows = []
            for conv, side, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                rank = rank + 1 if last == (conv, side) else 0
                last = conv, side
                ids = np.frombuffer(encode(TEMPLATE.format(role=role, text=text)), "<u4").astype(np.int32)
                head = role.encode()
                digest = hashlib.sha256(len(head).to_bytes(8, "little") + head + text.encode()).digest()
                rows.append((digest, len(ids), rank) + (ids,) * with_ids)
            cols = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3, 4)), *[pa.array(list(c), t) for c, (_, t) in zip(cols, fields, strict=True)]],
                ["conv_id", "side", "role", "text", *[n for n, _ in fields]])

    order = ["conv_id", "side", "turn", "role", "text"]
    dealt = materialize(
        turns.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        .mapInArrow(count, "conv_id bigint, side int, role string, text string, digest binary, n_tokens bigint, rank bigint" +
                    ", ids array<int>" * with_ids)
        .withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    before = Window.partitionBy("conv_id", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (dealt.groupBy("conv_id", "side", "part").agg(F.count("*").alias("n"))
            .select("conv_id", "side", "part", F.sum("n").over(before).alias("base")).where("base IS NOT NULL"))
    return (dealt.join(F.broadcast(materialize(base)), ["conv_id", "side", "part"], "left")
            .withColumn("rank", F.col("rank") + F.coalesce("base", F.lit(0))).drop("part", "base"))


def preference_turns(chosen: DataFrame, rejected: DataFrame, vocabulary: str, end_id: int = 1, conv_col: str = "conv_id",
                     turn_col: str = "turn", role_col: str = "role", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """conv_id, n_shared_turns, side, rank, role, text, n_tokens, loss and, if asked for, ids; a row per turn of a pair.

    ``side`` is "prompt" for shared turns, else "chosen" or "rejected"; each completion ends in a row of
    its own with the end id, a null role and text, and the rank after its last turn. The prompt's rows
    and one side's, by rank, are that side's sequence. ``loss`` is 1 where tokens count: in assistant
    turns after the prompt and the end id. Turns are tokenised one by one. No row holds more than a
    turn and no task a whole conversation, so conversations may have any length.

    Turns are equal when role and text are; they are in order of turn, role, text. Null roles and texts
    count as empty. Turns with a null id belong to no conversation and give no row. Conversations on
    one side only, or alike to the end, are no pair and give no row.
    """
    prepare(chosen.sparkSession)
    turns = _ranked(chosen, rejected, vocabulary, with_ids, dict(conv_id=conv_col, turn=turn_col, role=role_col, text=text_col))
    # the sides meet by rank as digests, then the least differing rank is a partial aggregate
    at = turns.groupBy("conv_id", "rank").agg(
        F.count("*").alias("n"), F.sum("side").alias("n_rejected"), (F.min("digest") != F.max("digest")).alias("differ"))
    convs = at.groupBy("conv_id").agg(
        F.min(F.when((F.col("n") < 2) | F.col("differ"), F.col("rank"))).alias("n_shared_turns"),
        F.sum(F.col("n") - F.col("n_rejected")).alias("n_0"), F.sum("n_rejected").alias("n_1"))
    convs = materialize(convs.where("n_shared_turns IS NOT NULL AND n_0 > 0 AND n_1 > 0").withColumn("n_turns", F.col("n_0") + F.col("n_1")))
    shared = F.col("rank") < F.col("n_shared_turns")
    side = F.when(shared, "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    ids = ["ids"] * with_ids
    rows = join_groups(turns, convs, "conv_id", "n_turns").where(~shared | (F.col("side") == 0)).select(
        "conv_id", "n_shared_turns", side.alias("side"), "rank", "role", "text", "n_tokens",
        (~shared & (F.col("role") == "assistant")).cast("int").alias("loss"), *ids)
    end = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), F.col(f"n_{i}").alias("rank")) for i, name in enumerate(("chosen", "rejected"))]))
    null = F.lit(None).cast("string")
    ends = convs.select("conv_id", "n_shared_turns", end.alias("end")).select(
        "conv_id", "n_shared_turns", "end.side", "end.rank", null.alias("role"), null.alias("text"),
        F.lit(1).cast("long").alias("n_tokens"), F.lit(1).alias("loss"), *[F.array(F.lit(end_id)).alias(c) for c in ids])
    return rows.unionByName(ends)


def pair_counts(turns: DataFrame) -> DataFrame:
    """conv_id, n_shared_turns, prompt_sha256, n_chosen, n_rejected, chosen_loss_tokens, rejected_loss_tokens.

    From ``preference_turns``; one row per pair, in partial sums. Only the digest of a prompt is
    sequential by nature: its task streams the shared turns of a conversation and holds none.
    """
    def total(*sides, loss=False):
        n = F.col("n_tokens") * F.col("loss") if loss else F.col("n_tokens")
        return F.sum(F.when(F.col("side").isin(*sides), n).otherwise(0))

    sums = turns.groupBy("conv_id", "n_shared_turns").agg(
        total("prompt", "chosen").alias("n_chosen"), total("prompt", "rejected").alias("n_rejected"),
        total("chosen", loss=True).alias("chosen_loss_tokens"), total("rejected", loss=True).alias("rejected_loss_tokens"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        names = ["conv_id", "prompt_sha256"]
        for batch in batches:
            done = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    done += [(last, state.hexdigest())] if state else []
                    last, state = conv, hashlib.sha256()
                state.update(TEMPLATE.format(role=role, text=text).encode())
            cols = list(zip(*done)) if done else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()], pa.string())], names)

    prompts = (turns.where("side = 'prompt'").select("conv_id", "rank", "role", "text").repartition("conv_id")
               .sortWithinPartitions("conv_id", "rank").select("conv_id", "role", "text")
               .mapInArrow(digest, "conv_id bigint, prompt_sha256 string"))
    return sums.join(prompts, "conv_id", "left").select(
        "conv_id", "n_shared_turns", F.coalesce("prompt_sha256", F.sha2(F.lit(""), 256)).alias("prompt_sha256"),
        "n_chosen", "n_rejected", "chosen_loss_tokens", "rejected_loss_tokens")
