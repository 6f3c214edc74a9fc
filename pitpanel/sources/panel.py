"""Reading and writing panels, rate files and event ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.functions.columns import month_of, normalize_epoch, on_grid
from pitpanel.params import DEFAULTS
from pitpanel.session import materialize

# Column order of delimited bar files.
BAR_CSV_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time",
                   "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"]
# Accepted header names of delimited rate files, by priority.
RATE_TIME_NAMES = ["calc_time", "fundingtime", "funding_time"]
RATE_VALUE_NAMES = ["funding_rate", "fundingrate", "last_funding_rate"]


def write_panel(df: DataFrame, path: str, by: str = "entity", ts: str = "ts",
                partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet by entity and month, sorted by time inside each file.

    Range partitioning on (entity, month, time) splits a hot entity over several tasks, where
    hashing on (entity, month) would give it one.
    """
    keyed = df.withColumn("month", month_of(ts))
    order = [by, "month", ts]
    spread = (keyed.repartitionByRange(partitions, *order) if partitions
              else keyed.repartitionByRange(*order))
    (spread.sortWithinPartitions(*order).write.mode(mode).partitionBy(by, "month")
     .option("compression", "zstd").parquet(path))


def _months(start: int, end: int) -> tuple[str, str]:
    from datetime import datetime, timezone
    lo, hi = (datetime.fromtimestamp(x / 1000, timezone.utc).strftime("%Y-%m") for x in (start, end))
    return lo, hi


def scan_panel(spark: SparkSession, path: str, start: int, end: int,
               entities: list[str] | None = None, by: str = "entity", ts: str = "ts") -> DataFrame:
    """Rows with ``start <= ts <= end``; the month predicate prunes directories, the time
    predicate prunes row groups."""
    lo, hi = _months(start, end)
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    df = df.withColumn("month", F.col("month").cast("string"))
    out = df.filter(F.col("month").between(lo, hi) & F.col(ts).between(start, end))
    if entities is not None:
        out = out.filter(F.col(by).isin(entities))
    return out.drop("month")


def scan_rates(spark: SparkSession, path: str, start: int, end: int, ts: str = "ts",
               by: str = "entity") -> DataFrame:
    """Rate files in the flat (``<entity>.parquet``) and the nested (``<entity>/*.parquet``,
    ``entity=<entity>/*.parquet``) layout; the entity is taken from the path."""
    root = path.rstrip("/").rsplit("/", 1)[-1] + "/"
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    inside = F.substring_index(F.url_decode(F.col("_metadata.file_path")), root, -1)
    entity = F.regexp_extract(inside, r"^(?:entity=)?([^/]+?)(?:\.parquet)?(?:/|$)", 1)
    return df.withColumn(by, entity).filter(F.col(ts).between(start, end))


def read_bar_csv(spark: SparkSession, path, step: int = DEFAULTS.fine_ms) -> DataFrame:
    """Delimited bars with or without a header line; wrong width or an off-grid time fails."""
    cells = F.split(F.trim("value"), ",")
    lines = (spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith(BAR_CSV_COLUMNS[0]))
             .select(cells.alias("c")))
    width = F.size("c") == len(BAR_CSV_COLUMNS)
    rows = lines.select(F.when(width, F.col("c")).otherwise(
        F.raise_error(F.lit("unexpected bar column count")).cast("array<string>")).alias("c"))
    named = rows.select(*[F.col("c")[i].alias(n) for i, n in enumerate(BAR_CSV_COLUMNS)])
    t = normalize_epoch(F.col("open_time"))
    stray = F.when(~on_grid(t, step), F.raise_error(F.lit("open_time off the grid")))
    doubles = ["open", "high", "low", "close", "volume", "quote_volume"]
    return named.select(F.coalesce(stray.cast("bigint"), t).alias("ts"),
                        *[F.col(c).cast("double").alias(c) for c in doubles])


def read_rate_csv(spark: SparkSession, path) -> DataFrame:
    """Delimited rates, every file under its own header; a header that is unknown or absent is refused.

    Headers are found in a scan of their own, one row per file; each file's values are then taken from
    the columns its header names. Spaces around names and values, and quotes, don't matter.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", "[\"\\s]", "").alias("_line")) \
        .filter("_line != ''")
    # a line that doesn't start like a number is a header
    cells = F.split(F.lower("_line"), ",")
    titled = lines.filter(~F.col("_line").rlike("^[-+.0-9]")).select("_file", "_line", cells.alias("_names")).distinct()

    def place(known):
        return F.coalesce(*[F.nullif(F.array_position("_names", c), F.lit(0)) for c in known])
    headers = materialize(titled.select("_file", "_line", place(RATE_TIME_NAMES).alias("_t"), place(RATE_VALUE_NAMES).alias("_r")))
    unknown = headers.filter("_t IS NULL OR _r IS NULL").first()
    if unknown:
        raise ValueError(f"unrecognized rate header: {unknown['_line']}")
    twice = headers.groupBy("_file").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"several rate headers in {twice['_file']}")
    rows = lines.filter(F.col("_line").rlike("^[-+.0-9]")).join(headers.select("_file", "_t", "_r"), "_file", "left")
    known = F.when(F.col("_t").isNull(), F.raise_error(F.concat(F.lit("no rate header in "), "_file")).cast("array<string>")) \
        .otherwise(F.split("_line", ","))
    value = rows.select(known.alias("_cells"), "_t", "_r")
    return value.select(normalize_epoch(F.get("_cells", (F.col("_t") - 1).cast("int")).cast("bigint")).alias("ts"),
                        F.get("_cells", (F.col("_r") - 1).cast("int")).cast("double").alias("rate"))


def merge_dedup(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in priority order, keeping the first source's row per key.

    A partial aggregate over ``(priority, row)`` instead of a window: duplicates of a hot key
    collapse map-side.
    """
    cols = parts[0].columns
    tagged = [p.select(*cols).withColumn("_prio", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    rest = [c for c in cols if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("_prio", *rest)).alias("_r")
    return out.groupBy(*keys).agg(first).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def write_ledger(df: DataFrame, path: str, order: str = "seq", mode: str = "errorifexists") -> None:
    """Gzip JSON lines; the order is kept in an explicit column, ranges are written in order."""
    (df.repartitionByRange(order).sortWithinPartitions(order)
     .write.mode(mode).option("compression", "gzip").json(path))


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


class SealedRangeError(RuntimeError):
    """A scan asked for a sealed interval."""


def guarded_scan(spark: SparkSession, path: str, a: int, b: int, sealed: tuple[int, int],
                 audit_path: str, reader=scan_panel, **kw) -> DataFrame:
    """``reader`` over ``[a, b]`` unless it touches the sealed interval; a refusal leaves an
    audit row and raises before any data is read."""
    if a <= sealed[1] and b >= sealed[0]:
        row = spark.range(1).select(
            F.unix_millis(F.current_timestamp()).alias("at"), F.lit(path).alias("path"),
            F.lit(a).cast("bigint").alias("start_ts"), F.lit(b).cast("bigint").alias("end_ts"),
            F.lit("REFUSED").alias("decision"))
        row.write.mode("append").json(audit_path)
        raise SealedRangeError(f"[{a},{b}] intersects the sealed range [{sealed[0]},{sealed[1]}]")
    return reader(spark, path, a, b, **kw)
