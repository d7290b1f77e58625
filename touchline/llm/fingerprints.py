"""Document fingerprints by randomised edit embedding.

All texts walk with the same random bits (Chakraborty, Goldenberg and Koucky, 2016): at step j a text shows its current
character, and moves on by the bit that step j has for this character. Texts at a small edit distance fall into step again
soon after each edit, so that their walks differ in few places: edit distance becomes Hamming distance.

The walk is bit-sampled: bit k of a fingerprint comes from the step that has the smallest of k's random numbers among the
steps of the walk, and is one hashed bit of that step and of the ``context`` characters shown there. Walks of different length
therefore sample the same step as often as their shared part allows. Two fingerprints agree in (1 + s) / 2 of their bits,
where s is the share of steps with equal characters; likeness is the estimate of s.

Bands of bits give candidates for near-duplicates; their likeness is the verification.

Nulls: a null text is an empty text, with fingerprint zero. A null doc_id comes first in order. Rows with the same doc_id go
by text. Whole texts are walked, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import cells, checkpointed, read, tidy, whole_cells

BITS, CONTEXT, SEED = 512, 4, 42
#: Steps whose random bits repeat, as a period far above any stretch that two texts walk side by side by chance.
PERIOD = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walker:
    """Shared random walks, and the steps at which each bit is sampled anew."""

    def __init__(self, bits: int = BITS, context: int = CONTEXT, seed: int = SEED) -> None:
        self.bits, self.context, self.seed = bits, context, seed
        self.moves = np.random.default_rng(seed).integers(0, 2, (PERIOD, 256)).astype(np.int64)
        self.moves[:, 0] = 0  # a text's end
        self.steps, self.sampled, self.low = 0, {}, np.full(bits, np.uint64(0xFFFFFFFFFFFFFFFF))

    def extend(self, steps: int) -> None:
        """Finds the steps up to ``steps`` that have a new smallest random number for some bit."""
        ks = np.arange(self.bits, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed)
        while self.steps < steps:
            js = np.arange(self.steps, self.steps + 2048, dtype=np.uint64)
            draws = mix(mix(ks)[None, :] + js[:, None] * np.uint64(0xD1B54A32D192ED03))
            best = np.minimum.accumulate(np.vstack([self.low, draws]), axis=0)
            rows, bits = np.nonzero(best[1:] < best[:-1])
            for j, k in zip((rows + self.steps).tolist(), bits.tolist(), strict=True):
                self.sampled.setdefault(j, []).append(k)
            self.low, self.steps = best[-1], self.steps + 2048

    def walk(self, texts: list[str]) -> np.ndarray:
        """Bits of all texts, one row each; all of them walk side by side."""
        out = np.zeros((len(texts), self.bits), np.uint8)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        live = int((sizes > 0).sum())
        if not live:
            return out
        starts = np.concatenate(([0], np.cumsum(sizes + self.context)[:-1]))
        codes = np.frombuffer(("\0" * self.context).join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate((codes, np.zeros(2 * self.context, np.uint32)))
        small = ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        small[points == 0] = 0
        inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([sizes, np.full(len(sizes), self.context)], 1).ravel())
        small[: len(inside)] = np.where(inside, np.maximum(small[: len(inside)], 1), 0)
        hashes = np.zeros(len(points) - self.context, np.uint64)
        for c in range(self.context):
            hashes = hashes * np.uint64(0x100000001B3) + points[c : len(points) - self.context + c]
        at, rows, ends = starts[:live].copy(), np.arange(live), (starts + sizes)[:live]
        self.extend(2 * int(sizes[0]) + 64)
        j, step = 0, np.empty(live, np.int64)
        while len(at):
            until = j + 64
            self.extend(until)
            for j in range(j, until):
                if j in self.sampled:
                    on = np.flatnonzero(at < ends)
                    value = mix(hashes[at[on]] + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64)))
                    for k in self.sampled[j]:
                        out[rows[on], k] = (value >> np.uint64(k % 61)).astype(np.uint8) & 1
                np.take(self.moves[j % PERIOD], small[at], out=step[: len(at)], mode="clip")
                at += step[: len(at)]
            j = until
            on = at < ends
            if not on.all():
                at, rows, ends = at[on], rows[on], ends[on]
        done = np.zeros_like(out)
        done[order] = out
        return done


def hexed(bits: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of equal steps, from 0 to 1, of fingerprints row by row."""
    return np.maximum(0.0, 2 * (a == b).mean(axis=-1) - 1) if a.size else np.zeros(len(a))


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of doc_id, each range with the first rows of the next as an overhang; and the number of ranges.

    Only range bounds come to the driver, as many as there are shuffle partitions. Texts move once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.where("doc_id IS NOT NULL")
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []))
    part = F.coalesce(F.expr("size(filter(array({}), b -> b < doc_id))".format(", ".join(f"{b!r}D" for b in bounds))), F.lit(0)) if bounds else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part) if bounds else part
    firsts = {r[0]: r[1] for r in docs.select(part.alias("part"), "doc_id").groupBy("part").agg(F.expr("CASE WHEN count(*) > count(doc_id) THEN NULL ELSE min(doc_id) END")).collect()}
    used = sorted(firsts)
    rows = docs.withColumn("part", part).withColumn("over", F.lit(False))
    out = rows
    if used:
        before = spark.createDataFrame([(p, used[i - 1], firsts[p]) for i, p in enumerate(used)], f"part int, target int, first {docs.schema['doc_id'].dataType.simpleString()}")
        heads = rows.join(F.broadcast(before), "part").where("doc_id <=> first").withColumn("part", F.col("target")).withColumn("over", F.lit(True))
        out = rows.unionByName(heads.select(rows.columns))
    return out, len(used)


def fingerprinted(docs: DataFrame, bits: int = BITS, context: int = CONTEXT, seed: int = SEED, block: int = 1 << 21) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row."""
    rows, parts = with_next(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(bits, context, seed)
        held: list[tuple] = []  # rows (part, over, doc_id, text) in order
        size, id_type = 0, None

        def out() -> pa.RecordBatch | None:
            """All held rows but the last, which the next block needs as well."""
            texts = [r[3] for r in held]
            use = [i for i in range(len(held) - 1) if not held[i][1]]
            new = [edited(texts[i], texts[i + 1]) for i in use]
            marks = walker.walk(texts + new)
            own, changed, following = marks[use], marks[len(texts) :], marks[[i + 1 for i in use]]
            columns = [[len(texts[i]) for i in use], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], hexed(own), hexed(changed), likeness(own, changed), likeness(own, following)]
            return pa.RecordBatch.from_arrays([pa.array([held[i][2] for i in use], id_type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names) if use else None

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "over", "doc_id", "text")), strict=True):
                if held and (size > block or held[-1][0] != row[0]):
                    if held[-1][0] != row[0]:
                        got, held = out(), []
                    else:
                        got, held = out(), held[-1:]
                    size = 0
                    if got:
                        yield got
                held.append((*row[:3], row[3] or ""))
                size += len(held[-1][3])
        if held:
            got = out()
            if got:
                yield got

    dealt = rows.repartition("part").sortWithinPartitions("part", "over", "doc_id", "text")
    return dealt.mapInArrow(tidy(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(marks: DataFrame, bands: int = 32, least: float = 0.8, bits: int = BITS, cell_rows: int = 2048) -> DataFrame:
    """Pairs ``(a, b, likeness)``, a < b, of distinct fingerprints that agree on a band of bits and are alike by ``least`` or more.

    ``marks``: ``fingerprint`` of each document; nulls are left out. Equal fingerprints collapse first. A band that many
    fingerprints share is dealt into cells of at most two blocks, and all its pairs are verified; only those that are
    alike leave a task, and each of them once: from the first band that it agrees on.
    """
    width = bits // 8 // bands
    if width * 8 * bands != bits:
        raise ValueError("a band must be whole bytes")
    distinct = checkpointed(marks.where("fingerprint IS NOT NULL").select(F.unhex("fingerprint").alias("mark")).distinct())
    banded = distinct.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    keyed = banded.select("band", F.xxhash64(F.substring("mark", F.col("band") * width + 1, F.lit(width))).alias("key"), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in whole_cells(batches, ["band", "key", "a", "b"]):
            marks_ = np.frombuffer(b"".join(table.column("mark").to_pylist()), np.uint8).reshape(-1, bits // 8)
            band, a, b = (table.column(c).to_numpy() for c in ("band", "a", "b"))
            first = table.column("first").to_numpy(zero_copy_only=False)
            for s, e in ranges:
                own, other = (np.arange(s, e),) * 2 if a[s] == b[s] else (s + np.flatnonzero(first[s:e]), s + np.flatnonzero(~first[s:e]))
                words = marks_[other].view(np.uint64)
                for at in range(0, len(own), 256):
                    rows = own[at : at + 256]
                    differ = np.zeros((len(rows), len(other)), np.int64)
                    for k, w in enumerate(marks_[rows].view(np.uint64).T):
                        differ += np.bitwise_count(w[:, None] ^ words[:, k])
                    i, j = np.nonzero(1 - 2 * differ / bits >= least)
                    x, y = rows[i], other[j]
                    ok = (x < y) if a[s] == b[s] else np.ones(len(x), bool)
                    shared = (marks_[x] == marks_[y]).reshape(len(x), bands, width).all(2)
                    ok &= shared.any(1) & (shared.argmax(1) == band[s])
                    pairs = [sorted((marks_[p].tobytes().hex(), marks_[q].tobytes().hex())) for p, q in zip(x[ok], y[ok], strict=True)]
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), pa.array(1 - 2 * differ[i, j][ok] / bits)], ["a", "b", "likeness"])

    return cells(keyed, ["band", "key"], "mark", cell_rows).mapInArrow(tidy(run), "a string, b string, likeness double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(read(spark, sf_dir, "documents"))
