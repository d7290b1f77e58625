"""What the corpus operators share: table reads, reliable checkpoints, Arrow text buffers, connected components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Training-data scans cut batches into blocks of about so many bytes of text, which bounds a worker's NumPy arrays.
BLOCK_BYTES = 1 << 18
#: Rows that go from the JVM to a Python worker at a time.
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all machines share. A session on one machine that has none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's shared checkpoint folder; lost executors then cost no recomputation."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded(df: DataFrame, values: int = 4_000_000, weight: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``values`` values of 8 or 16 bytes, else as it is, for a shuffled join.

    ``weight``: values of a row, where that is not the number of its columns. ``df`` is read twice: it should be a checkpoint or small.
    """
    total = df.agg(F.sum(weight).alias("n")).first()[0] if weight is not None else df.count() * len(df.columns)
    return F.broadcast(df) if (total or 0) <= values else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives its memory back to the machine when a task ends: a Python worker outlives its tasks and their stage.

    A session that has Spark's own batch size gets a smaller one: batches of whole texts are held by both the JVM and the worker.
    """
    conf = SparkSession.active().conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return wrapped


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` in total size, or one row where that row alone is larger."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, end to end, and the offsets of each; null becomes the empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@cache
def letters() -> np.ndarray:
    """Which code points are letters (Unicode's general categories L)."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def cells(keyed: DataFrame, keys: list[str], value: str, cell_rows: int, others: tuple[str, ...] = ()) -> DataFrame:
    """``keys, a, b, first, value, others``: the rows of each key that has two or more, dealt into cells (``keys, a, b``), in order.

    A key with more than ``cell_rows`` rows is dealt into blocks, and each pair of blocks is a cell of its own: no task holds
    more than two blocks of a key, and no pair is lost. ``first`` tells the block of ``a``.
    """
    sizes = keyed.groupBy(*keys).count().where("count > 1").select(*keys, F.ceil(F.col("count") / cell_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64(value, F.lit(7)), F.col("parts")).cast("int")
    dealt = keyed.join(sizes, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("first"), value, *others)
    return dealt.repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b")


def whole_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole cells, which differ in ``names``, and the row range of each cell."""

    def ranges(table: pa.Table) -> list[tuple[int, int]]:
        columns = [table.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        return list(zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows], strict=True))

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        cut = ranges(table)[-1][0]
        if cut:
            done = table.slice(0, cut).combine_chunks()
            yield done, ranges(done)
        held = [table.slice(cut)]
    if held and held[0].num_rows:
        done = held[0].combine_chunks()
        yield done, ranges(done)


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a[i]`` and ``b[i]`` for each i, in place; a root is its set's smallest index."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if not (apart := low != high).any():
            return
        np.minimum.at(parent, high[apart], low[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def solved(links: DataFrame) -> DataFrame:
    """``components`` of so few links that one task holds them all."""
    kind = links.schema["u"].dataType.simpleString()

    def order(node: object) -> object:
        return tuple(order(x) for x in node.values()) if isinstance(node, dict) else (node is not None, 0 if node is None else node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ends = pa.chunked_array([b.column(c) for c in ("u", "v") for b in held])
        nodes = [(order(x), i) for i, x in enumerate(ends.to_pylist())]
        number = {k: n for n, k in enumerate(sorted({k for k, _ in nodes}))}
        at = np.array([number[k] for k, _ in nodes])
        some = {number[k]: i for k, i in nodes}  # a place where each node stands
        parent = np.arange(len(number))
        union(parent, at[: len(at) // 2], at[len(at) // 2 :])
        take = lambda ns: ends.take(pa.array([some[n] for n in ns])).combine_chunks()
        node, root = take(range(len(number))), take(parent.tolist())
        yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (node, root)], ["node", "root"])

    return links.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, rounds: int = 64, few: int = 20_000) -> DataFrame:
    """``(node, root)`` for each end of the links ``(u, v)``: root is the smallest node reachable.

    Up to ``few`` distinct links are joined in one task; any more by alternating large and small stars: each round is two
    aggregations and two joins keyed by node, so a node with a third of all links is pre-aggregated and its join is split at run
    time; rounds grow with the logarithm of a component's size, and each is a reliable checkpoint. Null ends are ignored.
    """
    links = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, last = checkpointed(links), None
    if links.count() <= few:
        return solved(links)
    for _ in range(rounds):
        mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last:
            break
        last = mark
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        links = checkpointed(small.where("u != v").distinct())
    ends = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return ends.union(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
