"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length one; cosine >= c is Euclidean distance <= r = sqrt(2 - 2c). Pivots are vectors of the table, and
each vector belongs to its nearest pivot's cell. If x of cell i and y of cell j are within r, the triangle inequality keeps x
within r of the plane that separates the two pivots; so x is replicated to the cells j for which that holds. Cells are then
joined independently: a pair is looked at in exactly one cell, the later one of its two. Equal vectors collapse before all
that and count with their number of copies. Pivots grow with the table, one for ``cell_rows`` distinct vectors up to
``MOST_PIVOTS``. A cell that has more vectors all the same is dealt into cells of their own with the same pivot, so that no task
holds more than one such cell; vectors sent to it stream by.

Inside a cell, vectors lie in order of their distance to the pivot. By the triangle inequality a block of vectors only meets
those whose distance is within r of its own; products in single precision then leave out what is below the bound by more than
their error, and the rest is decided in double precision.

Out of a cell come each vector's number of links and a forest that spans its linked sets, never its pairs.

Nulls: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows without a
vec_id (component null, kept false). Vectors of different dimension never link. Repeated rows of a vec_id are further copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, components, read, tidy, union

CELL_ROWS, MOST_PIVOTS = 8192, 65_536
#: Vectors of a block, and numbers of a block of products with pivots.
BLOCK, PRODUCTS = 256, 1 << 21


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have cosine >= ``least`` in double precision; doubtful products are computed again."""
    products = a @ b.T
    norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    cosines = products / norms
    out = cosines >= least
    for i, j in np.argwhere(np.abs(cosines - least) < 1e-12):
        x, y = a[i], b[j]
        out[i, j] = float(np.dot(x, y)) / (float(np.sqrt(np.dot(x, x))) * float(np.sqrt(np.dot(y, y)))) >= least
    return out


def prepared(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, vector, k, l``: the vector in double precision, null where it can't link, and 128 bits of its hash."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    bad = F.col(embedding).isNull() | (F.size(embedding) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0) | F.col(vec_id).isNull()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).alias("vector"))
    return rows.withColumn("k", F.xxhash64("vector")).withColumn("l", F.xxhash64(F.lit(1), "vector"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension, the rows that have it, and their vectors."""
    sizes, values = np.asarray(column.value_lengths()), column.flatten().to_numpy()
    ends = np.cumsum(sizes)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, values[(ends[rows] - size)[:, None] + np.arange(size)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(distinct: DataFrame, least: float, cell_rows: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``node, copies, vector`` dealt to cells: ``cell``, and ``own`` where the vector belongs there rather than visits; and the
    cells' pivots."""
    count = distinct.count()
    wanted = int(min(MOST_PIVOTS, max(1, -(-count // cell_rows))))
    # The pivots are those with the smallest hash: a bounded choice that reruns repeat.
    chosen = distinct.orderBy(F.xxhash64("node", F.lit(42)), "node").limit(wanted).select("vector").collect()
    by_size: dict[int, list] = {}
    for (v,) in chosen:
        by_size.setdefault(len(v), []).append(v)
    pivots = {k: unit(np.array(v)) for k, v in by_size.items()}
    radius = float(np.sqrt(2 - 2 * least)) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, sent = np.zeros(batch.num_rows, np.int32), [[0]] * batch.num_rows
            for rows, x in matrices(batch.column("vector")):
                p = pivots.get(x.shape[1])
                step = max(1, PRODUCTS // len(p)) if p is not None else 0
                for s in range(0, len(rows), step) if step else ():
                    some = unit(x[s : s + step])
                    close = some @ p.T
                    best = close.argmax(1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (p[best] @ p.T)))
                    top = close[np.arange(len(some)), best][:, None]
                    # The distance to the separating plane; pivots that are all but one are not told apart.
                    visits = (top - close <= radius * apart) | (apart < 1e-6)
                    home[rows[s : s + step]] = best
                    for r, v in zip(rows[s : s + step].tolist(), visits, strict=True):
                        sent[r] = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, batch.column("vector").value_lengths(), pa.array(home), pa.array(sent, pa.list_(pa.int32()))], [*batch.schema.names, "size", "home", "sent"])

    dealt = distinct.mapInArrow(tidy(near), "node long, copies long, vector array<double>, size int, home int, sent array<int>")
    sizes = dealt.groupBy("size", "home").agg(F.count("*").alias("n")).collect()  # at most a row for each pivot and dimension
    base, table, middles = 0, [], {}
    for size, pivot, n in sorted(sizes):
        parts = -(-n // cell_rows)
        table.append((size, pivot, base, parts))
        if size in pivots:
            middles |= dict.fromkeys(range(base, base + parts), pivots[size][pivot])
        base += parts
    plan = dealt.sparkSession.createDataFrame(table, "size int, pivot int, base int, parts int")
    dealt = dealt.join(F.broadcast(plan.withColumnRenamed("pivot", "home")), ["size", "home"])
    dealt = dealt.withColumn("mine", F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("base", "parts")
    visits = dealt.withColumn("pivot", F.explode("sent")).join(F.broadcast(plan), ["size", "pivot"]).withColumn("cell", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1)))
    visits = visits.where("cell > mine").select("cell", F.lit(False).alias("own"), "node", "copies", "vector")
    return dealt.select(F.col("mine").alias("cell"), F.lit(True).alias("own"), "node", "copies", "vector").unionByName(visits), middles


@dataclass
class Rows:
    """Vectors of one cell in order of their distance to its pivot."""

    nodes: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    units: np.ndarray
    distance: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], pivot: np.ndarray | None) -> Rows:
        nodes, copies = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("node", "copies"))
        vectors = np.concatenate([next(matrices(b.column("vector")))[1] for b in batches])
        units = unit(vectors)
        distance = np.zeros(len(units)) if pivot is None else np.sqrt(((units - pivot) ** 2).sum(1))
        order = np.argsort(distance, kind="stable")
        return cls(nodes[order], copies[order], vectors[order], units[order].astype(np.float32), distance[order])


def links_of(x: Rows, y: Rows, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of linked rows of ``x`` and ``y``; where both are one cell, each pair once."""
    radius, error = float(np.sqrt(2 - 2 * least)) + 1e-6, 1e-6 + 3e-7 * x.units.shape[1]
    for s in range(0, len(x.nodes), BLOCK):
        e = min(s + BLOCK, len(x.nodes))
        lo, hi = np.searchsorted(y.distance, (x.distance[s] - radius, x.distance[e - 1] + radius))
        lo = max(int(lo), s) if x is y else int(lo)
        hit = x.units[s:e] @ y.units[lo:hi].T >= np.float32(least - error)
        if x is y:
            hit &= np.arange(lo, hi)[None, :] > np.arange(s, e)[:, None]
        i = np.flatnonzero(hit.any(1))
        if not len(i):
            continue
        j = np.flatnonzero(hit[i].any(0))
        i, j = i[:, None], j[None, :]
        a, b = np.nonzero(hit[i, j] & linked(x.vectors[s + i[:, 0]], y.vectors[lo + j[0]], least))
        yield s + i[a, 0], lo + j[0, b]


def joined(dealt: DataFrame, middles: dict[int, np.ndarray], least: float) -> DataFrame:
    """``node, links, root``: links counted in a cell, and the root of the node's set in it; a node may come from many cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, mine = None, None
        pending: list[pa.RecordBatch] = []

        def out(rows: list[Rows], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            """``rows``: the cell's own, and visitors, whose numbers follow theirs."""
            nodes, copies = (np.concatenate([getattr(r, c) for r in rows]) for c in ("nodes", "copies"))
            links, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            for i, j in pairs:
                links += np.bincount(i, copies[j], len(nodes)).astype(np.int64) + np.bincount(j, copies[i], len(nodes)).astype(np.int64)
                union(parent, i, j)
            on = (links > 0) | (parent != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(links[on]), pa.array(nodes[parent][on])], ["node", "links", "root"])

        def inside() -> Iterator[pa.RecordBatch]:
            nonlocal mine
            if pending:
                mine = Rows.of(pending, middles.get(cell))
                pending.clear()
                yield out([mine], links_of(mine, mine, least))

        for whole in batches:
            cells_, own = whole.column("cell").to_numpy(), whole.column("own").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(cells_) != 0) | (own[1:] != own[:-1])) + 1).tolist(), len(cells_)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                part = whole.slice(s, e - s)
                if cells_[s] != cell:
                    yield from inside()
                    cell, mine = int(cells_[s]), None
                if own[s]:
                    pending.append(part)
                    continue
                yield from inside()
                if mine is not None:
                    visitors = Rows.of([part], middles.get(cell))
                    yield out([mine, visitors], ((i + len(mine.nodes), j) for i, j in links_of(visitors, mine, least)))
        yield from inside()

    # Dimensions never share a cell, since cells are numbered by dimension and pivot.
    ordered = dealt.repartition("cell").sortWithinPartitions("cell", F.desc("own"))
    return ordered.mapInArrow(tidy(run), "node long, links long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    rows = prepared(vectors, vec_id, embedding)
    distinct = rows.where("vector IS NOT NULL").groupBy("k", "l").agg(F.min("vec_id").cast("long").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    names = checkpointed(distinct.withColumn("node", F.col("low")))
    # Rows of one vec_id with different vectors are numbered anew, in the same order.
    clash = bool(names.groupBy("node").count().where("count > 1").take(1))
    if clash:
        names = checkpointed(names.orderBy("low", "k", "l").withColumn("node", F.monotonically_increasing_id()))
    found = checkpointed(joined(*cells(names.select("node", "copies", "vector"), least, cell_rows), least))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    classes = names.drop("vector").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = checkpointed(classes.select("k", "l", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    if clash:
        classes = checkpointed(classes.join(names.select(F.col("node").alias("root"), F.col("low").alias("component_id")), "root"))
    else:
        classes = classes.withColumnRenamed("root", "component_id")
    # ``classes`` is a table of its own, so that the join can split a vector that a third of all rows have.
    good = rows.where("vector IS NOT NULL").select("vec_id", "k", "l").join(classes, ["k", "l"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
