"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two sets with similarity of at least 4/5 differ in at most a ninth of the sum of their sizes. A set
names its first ``d + 1`` shingles in one order that all sets share, ``d`` being the most it may lack
of a partner, so that partners name one in common. The order puts shingles of many sets last: a
passage that many documents share is named only where there's little else. Sets meet in tiles of one
(band of sizes, shingle). Tiles are first linked through a few centres, then only members of tiles of
one centre that are still apart are compared, by bitmaps and then exactly. The method loses no pair (up to 64-bit hashes of shingles).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, column_view, join_groups, marks, materialize, mix64, prepare, release, with_mark
from .fertility import WINDOW, window_hashes

SMALL = 32  # sizes below are one band
TILE = 512
OFTEN = 64  # a shingle of fewer sets is not told from a rare one
TABLE = 1 << 20  # most rows of the table of frequent shingles
PLACES = 1 << 24  # places of the filter of wanted sets
CHUNK = 1 << 22  # shingles counted at a time
BATCH = "4m"  # bytes of a batch that a task passes to Python
_GOLD = 0x9E3779B97F4A7C15  # fixed value
_ORDERS = (0, 0x2AAAAAAAAAAAAAAA, 0x5555555555555555, 0x7FFFFFFFFFFFFFFF)  # fixed values
_WORDS = WordHashes(150_000)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WINDOW:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(window_hashes(_WORDS.array(words)))


def bitmap(h: np.ndarray) -> bytes:
    """A bit per shingle by hash, in twice the power of two that holds the set's size (512 at least).

    Sets that have little in common differ in twice the bits that a link may, so wider maps would only be moved.
    """
    bits = 2 * max(256, 1 << (len(h) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_link(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> bool:
    """Whether the bound on the overlap leaves room for the similarity."""
    if 5 * min(n_a, n_b) < 4 * max(n_a, n_b):
        return False
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    size = min(len(a), len(b))
    a, b = _fold(a, size), _fold(b, size)
    # a bit of one side only is a shingle the other lacks
    most = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return 9 * most >= 4 * (n_a + n_b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


Counts = tuple[np.ndarray, np.ndarray]
_NONE: Counts = (np.empty(0, np.uint64), np.empty(0, np.int64))


def tiles(h: np.ndarray, often: Counts = _NONE) -> np.ndarray:
    """Keys of the tiles of one set; two linked sets share one. ``often``: sorted shingles, their counts."""
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    named, counts = h, often[1]
    if len(counts):
        at = np.minimum(np.searchsorted(often[0], h), len(counts) - 1)
        named = h[np.argsort(np.where(often[0][at] == h, counts[at], 0), kind="stable")]
    largest, out = 5 * n // 4, []
    band = 0 if n < SMALL else n.bit_length() - (SMALL.bit_length() - 1)
    while True:
        low, high = (1, SMALL - 1) if band == 0 else (SMALL << (band - 1), (SMALL << band) - 1)
        if low > largest:
            return np.concatenate(out)
        salt = np.uint64((band + 1) * _GOLD & (1 << 64) - 1)
        out.append(mix64(named[: (n + min(largest, high)) // 9 + 1] ^ salt))
        band += 1


def _digest(h: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(h.astype("<u8").tobytes()) - (1 << 63) if len(h) else None


def _scan(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, key, set_id, n_shingles, bits), and rows (shingle, times) for :func:`frequent`.

    Arrays are several times the texts, so none is written: texts are read again where arrays are needed.
    ``key`` finds the text again. A task counts ``CHUNK`` shingles of its sets at a time, copies left
    out, and passes on those met three times.
    """
    names = ["doc_id", "key", "set_id", "n_shingles", "bits", "shingle", "times"]
    types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = np.empty(CHUNK, np.uint64), 0

        def batch_of(columns, n):
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def counted():
            h = held[:size]
            h.sort()
            values, n = np.unique(h[2:][h[2:] == h[:-2]], return_counts=True)
            return batch_of([None] * 5 + [values.view(np.int64), n + 2], len(values))

        for batch in batches:
            ids, sizes, maps = [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py())
                sid = _digest(h)
                ids.append(sid)
                sizes.append(len(h))
                maps.append(bitmap(h) if len(h) else None)
                if sid is None or sid in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                while len(h):
                    part, h = h[:CHUNK - size], h[CHUNK - size:]
                    held[size:size + len(part)] = part
                    size += len(part)
                    if size == CHUNK:
                        yield counted()
                        size = 0
            yield batch_of([batch.column(0), batch.column(2), ids, sizes, maps, None, None], len(ids))
        if size:
            yield counted()

    return docs.withColumn("key", F.xxhash64("text")).mapInArrow(
        build, "doc_id bigint, key bigint, set_id bigint, n_shingles bigint, bits binary, shingle bigint, times bigint")


def frequent(scanned: DataFrame) -> Counts:
    """Shingles of many sets with their counts, sorted; they only settle an order, so counts may be low.

    A shingle in the table has more than 1/``TABLE`` of all shingles of all documents, so the table has
    fewer than ``TABLE`` rows at any size.
    """
    total = scanned.agg(F.sum("n_shingles")).first()[0] or 0
    table = (scanned.where("times IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("n"))
             .where(F.col("n") > max(OFTEN, total // TABLE)).toArrow())
    shingle, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(set_id, shingles) of texts whose sets the task doesn't remember, so copies don't pile up."""
    seen: set[int] = set()
    for batch in batches:
        for text in batch.column(0):
            h = shingles(text.as_py())
            sid = _digest(h)
            if sid is not None and sid not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                yield sid, h


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list]]:
    """Columns of each run of rows that agree in the first ``width`` columns; rows come sorted."""
    held, key = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if key != row[:width]:
                if held and len(held) > 1:
                    yield held
                held, key = [], row[:width]
            held.append(row)
    if held and len(held) > 1:
        yield held


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, set_id (64-bit digest; null for none), n_shingles, hashes (sorted, little-endian)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, raws = [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py())
                raws.append(h.astype("<u8").tobytes())
                ids.append(_digest(h))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(raws, pa.binary())], ["doc_id", "set_id", "n_shingles", "hashes"])

    return docs.mapInArrow(build, "doc_id bigint, set_id bigint, n_shingles bigint, hashes binary")


def _tile_rows(docs: DataFrame, often: Counts) -> DataFrame:
    """(tile, set_id) of every set, in batches."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size = [], [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["tile", "set_id"])

        for sid, h in _unseen(batches):
            k = tiles(h, shared.value)
            keys.append(k.view(np.int64))
            ids.append(np.full(len(k), sid, np.int64))
            size += len(k)
            if size >= 100_000:
                yield rows()
                keys, ids, size = [], [], 0
        if keys:
            yield rows()

    return docs.select("text").mapInArrow(emit, "tile bigint, set_id bigint")


def _centred(rows: DataFrame) -> DataFrame:
    """(tile, set_id, centre) of tiles with several sets.

    The centre is a tile's first set in one of four orders, so that a group of copies has a few centres.
    Streams over sorted rows without holding a tile.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # tile, centre, last set
        for batch in batches:
            tile, sid = (batch.column(i).to_numpy() for i in range(2))
            if not len(tile):
                continue
            prev_tile = np.r_[tile[0] if last is None else last[0], tile[:-1]]
            prev_sid = np.r_[sid[0] if last is None else last[2], sid[:-1]]
            new = tile != prev_tile
            if last is None:
                new[0] = True
            at = np.maximum.accumulate(np.where(new, np.arange(len(tile)), -1))
            centre = np.where(at >= 0, sid[np.maximum(at, 0)], 0 if last is None else last[1])
            member = ~new & (sid != prev_sid) & (sid != centre)
            if member.any():
                yield pa.RecordBatch.from_arrays([pa.array(tile[member]), pa.array(sid[member]), pa.array(centre[member])],
                                                 ["tile", "set_id", "centre"])
            last = (tile[-1], centre[-1], sid[-1])

    order = F.col("set_id").bitwiseXOR(F.element_at(F.array(*[F.lit(x) for x in _ORDERS]), (F.pmod("tile", F.lit(4)) + 1).cast("int")))
    return rows.repartition("tile").sortWithinPartitions("tile", order).mapInArrow(
        walk, "tile bigint, set_id bigint, centre bigint")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs of the block pass texts and arrays to Python in batches of at most ``BATCH``, whatever their length.

    Ten thousand rows, the default, are tens of MB several times over in the JVM and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _step(df: DataFrame) -> DataFrame:
    """``df`` written; the shuffle files of the job go now, not when the driver next happens to collect its plans."""
    table = materialize(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def _sides(pairs: DataFrame, table: DataFrame, col: str) -> DataFrame:
    a = table.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col(col).alias("xa"))
    b = table.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col(col).alias("xb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "na", "xa", "nb", "xb")


def _passing(sides: DataFrame, test: Callable[..., bool]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [test(*r) for r in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return _step(sides.mapInArrow(run, "a bigint, b bigint"))


def _arrays(near: DataFrame, kept: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, n_shingles, hashes) of the ends of ``near``, once each.

    Their texts are found by marks of their keys, a table of bounded size, so that no other text leaves its
    task or is cut into shingles (but those that share a mark, which go by their set).
    """
    ends = _step(near.select(F.col("a").alias("set_id")).union(near.select("b")).distinct())
    place = F.pmod("key", F.lit(PLACES))
    words = F.broadcast(marks(kept.join(ends, "set_id", "left_semi").select(place.alias("place")), "place"))
    asked = with_mark(docs.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(PLACES))), words, "place")
    return _step(_distinct(_sets(asked.select("doc_id", "text")), ends, lambda h: h.tobytes(), "hashes"))


def _exact(near: DataFrame, arrays: DataFrame) -> DataFrame:
    """The linked ones of ``near``."""
    return _passing(_sides(near, arrays, "hashes"), lambda na, xa, nb, xb: linked(np.frombuffer(xa, "<u8"), np.frombuffer(xb, "<u8")))


def _check(pairs: DataFrame, kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among distinct pairs (a, b) that give the components of all links among them.

    Sizes decide first, then bitmaps, then arrays. Arrays are large, and a set has a near pair with each of
    its centres: one pair of every set is compared first, then only pairs whose ends are still apart.
    """
    sized = _sides(pairs, kept.select("set_id", "n_shingles"), "n_shingles")
    fit = _step(sized.where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")).select("a", "b"))
    near = _passing(_sides(fit, kept, "bits"), may_link)
    if near.isEmpty():
        return near
    arrays = _arrays(near, kept, docs)
    one = _exact(_step(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), arrays)
    roots = _step(smallest_reachable(one))
    rooted = near
    for end in ("a", "b"):
        rooted = rooted.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    apart = rooted.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    more = _exact(_step(apart), arrays)
    release(arrays)
    return one.unionByName(more)


def _marks(wanted: DataFrame) -> np.ndarray:
    """Bits of the places that ids of ``wanted`` hash to, in words of 32; 2 MB at any size."""
    place = F.pmod(F.xxhash64("set_id"), F.lit(PLACES))
    words = (wanted.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, int(p % 32)))").alias("bits")).toArrow())
    found = np.zeros(PLACES // 32, np.uint32)
    found[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return found


def _distinct(sets: DataFrame, wanted: DataFrame, form: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """(set_id, n_shingles, ``name``) of the ``wanted`` sets, once each.

    Arrays are most of what there is: they take their form, copies shrink and most unwanted sets go in
    the task that reads them, before the shuffle. The join drops the unwanted sets whose place is marked.
    """
    wanted = _step(wanted)
    asked_places = sets.sparkSession.sparkContext.broadcast(_marks(wanted))

    def one_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            place = batch.column(3).to_numpy()
            asked = (asked_places.value[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
            new = [ok and x not in seen and not seen.add(x) for ok, x in zip(asked.tolist(), batch.column(0).to_pylist(), strict=True)]
            batch = batch.filter(pa.array(new, pa.bool_()))
            made = [form(np.frombuffer(x, "<u8")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], ["set_id", "n_shingles", name])

    rows = sets.where("set_id IS NOT NULL").select("set_id", "n_shingles", "hashes", F.pmod(F.xxhash64("set_id"), F.lit(PLACES)).alias("place"))
    formed = rows.mapInArrow(one_per_task, f"set_id bigint, n_shingles bigint, {name} binary")
    return formed.join(wanted, "set_id", "left_semi").groupBy("set_id", "n_shingles").agg(F.first(name).alias(name))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): alternating star contraction until nothing moves.

    Every round is written, so lineage stays short; rounds grow with the logarithm of the longest path.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    at = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = at.union(at.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u != v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.u", "e.v").where("u != v").distinct())
        # stars only: no node is both a centre and a leaf, and every leaf has one centre
        done = (new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
                and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty())
        at = new
        if done:
            return nodes.join(at.select(F.col("u").alias("node"), "v"), "node", "left").select(
                "node", F.coalesce("v", "node").alias("root"))


def near_pairs(sizes: np.ndarray, bits: list[bytes], other: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Places (x, y) of rows, ascending by size, whose bitmaps leave room; ``other`` tells which rows x meets."""
    widths = np.array([len(b) for b in bits])
    held = {w: np.stack([np.frombuffer(bits[i], np.uint8) for i in np.flatnonzero(widths == w)]) for w in np.unique(widths).tolist()}
    place = np.zeros(len(bits), np.int64)
    for w in held:
        place[widths == w] = np.arange(len(held[w]))
    for x in range(len(bits) - 1):
        rest = np.arange(x + 1, np.searchsorted(sizes, 5 * sizes[x] // 4, side="right"))
        rest = rest[other(x, rest)]
        mine, w = held[widths[x]][place[x]], widths[x]
        for wide in np.unique(widths[rest]).tolist():
            at = rest[widths[rest] == wide]
            theirs = np.bitwise_or.reduce(held[wide][place[at]].reshape(len(at), wide // w, w), axis=1)
            most = np.minimum(sizes[x] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64),
                              sizes[at] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
            yield from ((x, y) for y in at[9 * most >= 4 * (sizes[x] + sizes[at])].tolist())


def _apart(multi: DataFrame, roots: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs (a, b) of one tile in different components whose bitmaps leave room.

    A set is in many tiles with the same others, and most of them have the same centre. So the members of
    all tiles of a centre are one group, in which a set stands once; the centre itself was compared before.
    The members of a group's largest component aren't compared with each other: they and the others
    are dealt into blocks of their own, and every pair of blocks that has others in it is one cell.
    """
    rooted = multi.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rows = _step(rooted.withColumn("root", F.coalesce("root", "set_id")))
    by_root = rows.groupBy("centre", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("centre").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = materialize(mixed.where("roots > 1").select(
        "centre", "n", F.col("main.root").alias("main"), F.ceil(F.col("main.n") / TILE).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.col("main.n")) / TILE).cast("int").alias("others")))
    members = (join_groups(rows, mixed, "centre", "n").withColumn("in_main", F.col("root") == F.col("main"))
               .withColumn("home", F.pmod(F.xxhash64("set_id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
               .join(kept.select("set_id", "n_shingles", "bits"), "set_id"))
    cells = F.expr("""CASE WHEN in_main THEN transform(sequence(0, others - 1), x -> struct(-1 - home AS i, x AS j))
        ELSE concat(transform(sequence(0, mains - 1), x -> struct(-1 - x AS i, home AS j)),
                    transform(sequence(0, others - 1), x -> struct(least(home, x) AS i, greatest(home, x) AS j))) END""")
    dealt = members.withColumn("cell", F.explode(cells)).select(
        "centre", "cell.i", "cell.j", "in_main", "home", "set_id", "root", "n_shingles", "bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            (i, j), run = run[0][1:3], sorted(run, key=lambda r: r[7])
            main, home, ids, root, sizes = (np.array([r[c] for r in run]) for c in range(3, 8))
            side = main if i < 0 else home

            def other(x, rest):
                apart = root[rest] != root[x]
                return apart if i == j else apart & (side[rest] != side[x])

            found = list(near_pairs(sizes, [r[8] for r in run], other))
            if found:
                pair = np.sort(ids[np.array(found)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return (dealt.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")
            .mapInArrow(compare, "a bigint, b bigint").distinct())


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; one row per document.

    Texts of the same shingle set are linked; null, empty and wordless texts are linked with nothing and
    are their own component. A null id counts as largest. An empty table gives no row.
    """
    prepare(docs.sparkSession)
    view = column_view(docs, doc_id=id_col, text=text_col)
    with small_batches(docs.sparkSession):
        scanned = _step(_scan(view))
        kept = _step(scanned.where("set_id IS NOT NULL").groupBy("set_id", "n_shingles").agg(
            F.first("bits").alias("bits"), F.min("key").alias("key"), F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
        often = frequent(scanned)
        rows = _step(scanned.where("times IS NULL").select("doc_id", "n_shingles", "set_id"))
        release(scanned)
        multi = _step(_centred(_tile_rows(view, often)).select("centre", "set_id").distinct())
        pairs = multi.select(F.least("centre", "set_id").alias("a"), F.greatest("centre", "set_id").alias("b")).distinct()
        edges = _check(pairs, kept, view)
        roots = _step(smallest_reachable(edges))
        apart = _step(_apart(multi, roots, kept).join(pairs, ["a", "b"], "left_anti"))
        more = _check(apart, kept, view)
    classes = _step(kept.select("set_id", "first_id", "rows"))
    release(kept)
    roots = materialize(smallest_reachable(materialize(edges.union(more))))
    named = classes.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id")).drop("node")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes"))
    found = materialize(join_groups(named, materialize(smallest), "root", "classes").select("set_id", "component_id", "rows"))
    some = join_groups(rows.where("set_id IS NOT NULL"), found, "set_id", "rows")
    none = rows.where("set_id IS NULL").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "n_shingles", "component_id"]
    return some.select(*cols).unionByName(none.select(*cols))
