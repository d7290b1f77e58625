"""SimHash near-duplicates by bit-sliced comparison.

Each text gets a 64-bit fingerprint over its word shingles. Equal fingerprints collapse before anything is compared.
Pigeonhole keys (the bits of some of the fingerprint's bands) bring every pair within the radius together at least once.
Inside a key, fingerprints are stored as vertical bit planes: one 64-bit word holds one bit of 64 fingerprints. Carry-save
counters then add up 64 distances at a time, and a block is left as soon as all of its distances exceed the radius.

Nulls: a null text is an empty text. Texts with no word have fingerprint zero and link like any other. A row with a null
doc_id gets its group's component; a group with no doc_id at all has component null. Repeated rows stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import cells, checkpointed, components, read, tidy, union, whole_cells

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints of one cell of a key, and pairs compared at a time.
CELL_ROWS, PAIRS = 8192, 1 << 22


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the text's word shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    values = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(values[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without its text, with ``simhash`` long (the 64 bits, as a signed number)."""
    kept = [f for f in docs.schema if f.name not in (text, "simhash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(values)], [*(f.name for f in kept), "simhash"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "simhash long"])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text)).mapInArrow(tidy(run), schema)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p (from the highest) of all values, 64 values to a word."""
    bits = np.unpackbits(np.ascontiguousarray(values.astype(">u8")).view(np.uint8)).reshape(-1, 64)
    width = -(-len(values) // 64) * 64
    out = np.zeros((64, width), np.uint8)
    out[:, : len(values)] = bits.T
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``(query, value)`` at Hamming distance up to ``radius``, by carry-save counters over bit planes.

    The counters start so far below their top that the carry out of them means that the radius is exceeded.
    """
    sliced, full = planes(values), np.uint64(0xFFFFFFFFFFFFFFFF)
    size = radius.bit_length()
    start = (1 << size) - radius - 1
    valid = np.packbits(np.arange(sliced.shape[1] * 64) < len(values), bitorder="little").view(np.uint64)
    step = max(1, PAIRS // max(1, sliced.shape[1] * 64))
    for at in range(0, len(queries), step):
        rows = np.arange(at, min(at + step, len(queries)))
        flips = np.where(np.unpackbits(queries[rows].astype(">u8").view(np.uint8)).reshape(-1, 64), full, np.uint64(0))
        counters = [np.full((len(rows), sliced.shape[1]), full if start >> b & 1 else 0, np.uint64) for b in range(size)]
        over = np.repeat(~valid[None, :], len(rows), 0)
        for p in range(64):
            carry = sliced[p] ^ flips[:, p, None]
            for b in range(size):
                counters[b], carry = counters[b] ^ carry, counters[b] & carry
            over |= carry
            if p > radius and p % 4 == 3:
                open_rows = (over != full).any(1)
                if not open_rows.any():
                    rows = rows[:0]
                    break
                if open_rows.mean() < 0.7:
                    rows, flips, over, counters = rows[open_rows], flips[open_rows], over[open_rows], [c[open_rows] for c in counters]
        if len(rows):
            i, j = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
            yield rows[i], j


def forest(values: np.ndarray, first: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Each value's root after joining all pairs within the radius between ``first`` rows and the rest, or among all."""
    parent = np.arange(len(values))
    own, other = (parent, parent) if same else (np.flatnonzero(first), np.flatnonzero(~first))
    if len(own) and len(other):
        for i, j in within(values[own], values[other], radius):
            union(parent, own[i], other[j])
    return parent


def key_masks(count: float, radius: int) -> list[int]:
    """Bit masks so that two fingerprints within the radius agree on all bits of at least one mask.

    With m bands, some m - radius are equal. More bands give longer keys; m grows so that the mean cell stays in the
    thousands whatever the number of fingerprints.
    """
    m = next((m for m in range(radius + 1, 17) if count / 2 ** (64 * (m - radius) // m) <= 2048), 16)
    edges = [64 * i // m for i in range(m + 1)]
    bands = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(bands, m - radius)]


def links(distinct: DataFrame, radius: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``(u, v)`` that span every set of fingerprints connected within ``radius``; ``distinct`` has ``simhash``.

    Where ``distinct`` has ``first`` too, ends are structs of both, so that a set's smallest end tells its smallest ``first``.
    A key with more than ``cell_rows`` fingerprints is dealt into cells; no pair is lost.
    """
    count = distinct.count()
    masks = key_masks(count, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    more = tuple(c for c in distinct.columns if c == "first")
    keyed = distinct.select("simhash", *(F.col(c).alias("named") for c in more), F.posexplode(F.array(*(F.col("simhash").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "key"))
    names = ["mask", "key", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in whole_cells(batches, names):
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            values, first = table.column("simhash").to_numpy(), table.column("first").to_numpy(zero_copy_only=False)
            u, v = [], []
            for s, e in ranges:
                roots = forest(values[s:e].view(np.uint64), first[s:e], radius, bool(a[s] == b[s]))
                moved = np.flatnonzero(roots != np.arange(e - s))
                u.append(s + moved)
                v.append(s + roots[moved])
            ends = [table.select([*("named" for _ in more), "simhash"]).take(pa.array(np.concatenate(x))).combine_chunks() for x in (u, v)]
            columns = [end.column(c) for end in ends for c in end.column_names]
            flat = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in columns]
            yield pa.RecordBatch.from_arrays(flat, [f"{x}_{c}" for x in "uv" for c in ends[0].column_names])

    kinds = [*((f"{x}_named", distinct.schema["first"].dataType.simpleString()) for x in "uv" for _ in more), *((f"{x}_simhash", "long") for x in "uv")]
    schema = ", ".join(f"{n} {k}" for n, k in sorted(kinds, key=lambda c: (c[0][0], "simhash" in c[0])))
    found = cells(keyed, ["mask", "key"], "simhash", cell_rows, ("named",) * len(more)).mapInArrow(tidy(run), schema)
    end = lambda x: F.struct(F.col(f"{x}_named").alias("first"), F.col(f"{x}_simhash").alias("simhash")) if more else F.col(f"{x}_simhash")
    return found.select(end("u").alias("u"), end("v").alias("v"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row: the smallest doc_id reachable by links of fingerprints."""
    rows = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words, seed))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    distinct = checkpointed(rows.groupBy("simhash").agg(low.alias("first")))
    roots = components(links(distinct, radius)).select(F.col("node.simhash").alias("simhash"), F.col("root.first").alias("root"))
    # What the rows are joined with is a table of its own, so that a fingerprint that a third of all rows have can be split.
    named = checkpointed(distinct.join(roots, "simhash", "left").select("simhash", F.coalesce("root", "first")["doc_id"].alias("component_id")))
    return rows.join(named, "simhash").select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest doc_id, of its rows the smallest hash of text and then of row.

    Rows without a doc_id come after all others of their group.
    """
    told = [*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns)]
    hashed = docs.withColumns({"__a": F.xxhash64(*told), "__b": F.xxhash64(F.lit(1), *told)})
    rows = fingerprints(hashed.select("doc_id", "text", "__a", "__b", F.xxhash64("text").alias("__text")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__text", "__a", "__b"))
    distinct = checkpointed(rows.groupBy("simhash").agg(first.alias("first")))
    roots = components(links(distinct.select("simhash"), radius))
    classes = distinct.join(roots, distinct.simhash == roots.node, "left").select("first", F.coalesce("root", "simhash").alias("root"))
    found = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.__a", "first.__b")
    return hashed.join(found, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]).select(docs.columns)
