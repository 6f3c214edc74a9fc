"""Content digests, file manifests and hash chains."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.plans.ordered import previous

GENESIS = "0" * 64


def row_hash(cols: list[Column]) -> Column:
    """SHA-256 of the columns' text, NULL spelled out so that it differs from an empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]), 256)


def row_digest(df: DataFrame, by: list[str], cols: list[Column]) -> DataFrame:
    """One content digest per group, independent of row order and partitioning.

    The SHA-256 of every row is cut into four numbers of 60 bits whose exact sums, with the row
    count, are hashed once per group. Sums combine map-side, so no row hash is shuffled and a
    group may be of any size. Include a sequence column where the order matters; use
    ``tree_digest`` where rows may be forged to collide on purpose.
    """
    words = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").cast("decimal(28,0)")
             for i in range(4)]
    hashed = df.select(*by, row_hash(cols).alias("_h"))
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]]
    sums = hashed.groupBy(*by).agg(*aggs) if by else hashed.agg(*aggs)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0"))
                              for c in ("_w0", "_w1", "_w2", "_w3", "n_rows")])
    return sums.select(*by, "n_rows", F.sha2(text, 256).alias("digest"))


def tree_digest(df: DataFrame, by: list[str], cols: list[Column],
                prefixes: tuple[int, ...] = (5, 2)) -> DataFrame:
    """The digest as a hash tree: rows meet in a bucket by the first hexadecimal digits of
    their own hash (even whatever the group sizes), bucket digests meet at the next shorter
    prefix. Five digits keep the buckets of a group of 10^11 rows near 10^5 rows.
    """
    level = df.select(*by, row_hash(cols).alias("_h"), F.lit(1).cast("bigint").alias("_n"))
    level = level.withColumn("_p", F.col("_h"))
    for width in (*prefixes, 0):
        level = (level.withColumn("_p", F.substring("_p", 1, width) if width else F.lit(""))
                 .groupBy(*by, "_p").agg(
                     F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_h2"),
                     F.sum("_n").alias("_n"))
                 .withColumnRenamed("_h2", "_h"))
    return level.select(*by, F.col("_n").alias("n_rows"), F.col("_h").alias("digest"))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*.parquet", block: int = 1 << 23) -> DataFrame:
    """Path, size and SHA-256 of every file below ``path``.

    Spark lists the files; a task reads its files as streams, ``block`` bytes at a time, so a file may be
    of any size. Executors open them by the file system of the path's scheme.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes")))

    def digest(batches: Iterator) -> Iterator:
        import hashlib
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs

        def one(name):
            scheme, rest = name.split(":", 1)
            if scheme == "file":
                system, at = fs.LocalFileSystem(), "/" + rest.lstrip("/")
            else:
                system, at = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
            h = hashlib.sha256()
            with system.open_input_stream(at) as f:
                while data := f.read(block):
                    h.update(data)
            return h.hexdigest()

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([one(x) for x in batch.column(0).to_pylist()], pa.string())], ["path", "bytes", "sha256"])

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "path").mapInArrow(digest, "path string, bytes bigint, sha256 string")


def manifest_digest(manifest: DataFrame) -> DataFrame:
    return row_digest(manifest, [], [F.col(c) for c in ("path", "bytes", "sha256")])


def manifest_diff(expected: DataFrame, actual: DataFrame, path: str = "path",
                  digest: str = "sha256", sample: float | None = None, seed: int = 0) -> DataFrame:
    """Missing, mismatching and additional entries.

    With ``sample`` the census of paths stays complete and only a seeded share of the digests
    is compared.
    """
    e = expected.select(path, F.col(digest).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(path, F.col(digest).alias("actual"), F.lit(True).alias("_a"))
    checked = F.lit(True) if sample is None else (
        F.pmod(F.xxhash64(F.lit(seed), F.col(path)), F.lit(1_000_000)) < int(sample * 1_000_000))
    status = (F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "additional")
              .when(checked & (F.col("expected") != F.col("actual")), "mismatch"))
    return e.join(a, path, "full_outer").withColumn("status", status) \
        .filter("status is not null").select(path, "status")


# ---------------------------------------------------------------- chains
def link_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(prev, body), 256)


def verify_chain(df: DataFrame, by: list[str], seq: str, body: str, bucket: Column,
                 prev: str = "prev", digest: str = "hash") -> DataFrame:
    """First broken row per chain (NULL when intact). Links are compared with the previous
    row through bucketed carries, so a long chain is checked in parallel."""
    linked = previous(df, by, [seq], bucket, {"_before": F.col(digest)})
    broken = ((F.col(prev) != F.coalesce("_before", F.lit(GENESIS)))
              | (F.col(digest) != link_hash(F.col(prev), F.col(body))))
    return linked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.when(broken, F.col(seq))).alias("first_break"))


def build_chain(df: DataFrame, by: str, seq: str, body: str) -> DataFrame:
    """Append ``prev`` and ``hash`` to every row of each chain.

    A hash chain is sequential by definition. Rows of a chain stream through their task in
    order and only the last hash is kept, so a chain never has to fit into memory.
    """
    import hashlib

    schema = T.StructType([*df.schema.fields, T.StructField("prev", T.StringType()),
                           T.StructField("hash", T.StringType())])

    def extend(batches: Iterator) -> Iterator:
        key, last = object(), GENESIS
        for batch in batches:
            prevs, hashes = [], []
            for k, text in zip(batch[by], batch[body], strict=True):
                if k != key:
                    key, last = k, GENESIS
                prevs.append(last)
                last = hashlib.sha256((last + text).encode()).hexdigest()
                hashes.append(last)
            yield batch.assign(prev=prevs, hash=hashes)

    return (df.repartition(by).sortWithinPartitions(by, seq).mapInPandas(extend, schema))
