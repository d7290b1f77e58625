"""Packing documents into fixed windows of tokens by non-negative least squares over length combinations.

Documents longer than the window are cut into full windows and a rest. The rests' lengths, rounded up to a small grid, form
a histogram with at most ``window / grid`` classes. Combinations of few lengths that fill a window exactly are enumerated;
non-negative least squares finds how often to repeat each so that the histogram is used up (Krell et al., 2021). Repeat
counts are rounded down, and what is left is packed greedily, largest first, on the histogram: patterns with a repeat count,
not documents. The plan's size therefore does not depend on the number of documents. Documents then get their place from
their rank among those of their class, found by counts in fixed hash ranges, and offsets from the true lengths.

Nulls: a null text is an empty document: its end token alone. Repeated rows are separate documents. Ties in rank are broken by
hash, doc_id, start and checksum, so that reruns agree.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, read, tidy

WINDOW, GRID, RANGES = 4096, 16, 512
#: A worker forgets its words beyond so many: memory stays bounded, results do not change.
CACHED_WORDS = 800_000
#: Words that need no normaliser but lower case: Latin letters, then plain punctuation, which is one pre-token.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")

#: Byte-level models spell bytes as characters: those that can't be seen, in order, as the characters from 256 on.
UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
VISIBLE = {b: 256 + i for i, b in enumerate(UNSEEN)}


class WordEncoder(dict):
    """Token ids of UTF-8 words as packed little-endian 32-bit numbers, encoded on first use and remembered.

    The tokenizer's pre-tokens never hold ASCII white space, so that a text's ids are those of its white-space separated
    words, one after the other. A plain word is encoded by the tokenizer's model alone, any other by the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.parts = self.tokenizer.model.tokenize, {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if plain := PLAIN.fullmatch(text):
            head = plain[1].lower()
            ids = self.parts.get(head)
            if ids is None:
                seen = head if head.isascii() else head.encode().decode("latin-1").translate(VISIBLE)
                self.parts[head] = ids = packed_ids([t.id for t in self.tokenize(seen)])
            if plain[2]:
                tail = self.parts.get(plain[2])
                if tail is None:
                    self.parts[plain[2]] = tail = self.whole(plain[2])
                ids += tail
        else:
            ids = self.whole(text)
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(b"".join(map(self.__getitem__, text.split())))
            if len(self) > CACHED_WORDS:
                self.clear()
            if len(self.parts) > CACHED_WORDS:
                self.parts.clear()
        return out


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) for each piece of at most ``window`` ids of a document."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, last = WordEncoder(tokenizer), struct.pack("<I", end)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[list] = [[] for _ in names]
                where: list[int] = []
                for k, ids in enumerate(encoder.encode(part.column(1).cast(pa.binary()).fill_null(b"").to_pylist())):
                    ids += last
                    for s in range(0, len(ids), 4 * window):
                        piece = ids[s : s + 4 * window]
                        where.append(k)
                        for column, value in zip(rows[1:], (s // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, np.frombuffer(piece, "<i4") if with_ids else None), strict=False):
                            column.append(value)
                types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:], types, strict=True))], names)

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(tidy(run), schema)


def combinations(classes: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Combinations of present lengths (1 to ``classes``) that add up to ``classes``: up to three lengths, or many of one and a filler."""
    have = set(present.tolist())
    out: set[tuple[int, ...]] = set()
    for a in present.tolist():
        for k in range(1, classes // a + 1):
            rest = classes - k * a
            if rest == 0 or rest in have:
                out.add(tuple(sorted((a,) * k + (rest,) * bool(rest), reverse=True)))
        for b in present.tolist():
            if a >= b >= (c := classes - a - b) and c in have:
                out.add((a, b, c))
    return sorted(out, reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |ax - b| with x >= 0, by Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-7 * max(1.0, np.abs(a.T @ b).max())
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= least:
            break
        passive[k] = True
        while True:
            on = np.flatnonzero(passive)
            some = a[:, on]
            s = np.linalg.solve(some.T @ some + 1e-12 * np.eye(len(on)), some.T @ b)
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            low = on[s <= 0]
            step = np.min(x[low] / np.maximum(x[low] - s[s <= 0], 1e-300))
            x[on] += step * (s - x[on])
            passive[on[x[on] <= 1e-9]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes and how often to repeat each; together they use each class exactly ``counts`` times.

    ``counts[c]``: pieces of class c (index 0 unused); a pattern's classes add up to the largest class at most.
    """
    counts, classes = counts.copy(), len(counts) - 1
    out = [((classes,), int(counts[classes]))] if counts[classes] else []
    counts[classes] = 0
    present = np.flatnonzero(counts)
    options = [c for c in combinations(classes, present) if len(c) > 1]
    if options:
        matrix = np.zeros((classes + 1, len(options)))
        for j, c in enumerate(options):
            np.add.at(matrix[:, j], list(c), 1)
        scale = max(1.0, float(counts.max()))
        times = np.floor(nnls(matrix, counts / scale) * scale + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            used = matrix[:, j].astype(np.int64)
            n = int(min(times[j], (counts[used > 0] // used[used > 0]).min()))
            if n > 0:
                out.append((options[j], n))
                counts -= n * used
    while counts.any():
        left, room, pattern, used = counts.copy(), classes, [], np.zeros_like(counts)
        for c in np.flatnonzero(counts)[::-1].tolist():
            k = int(min(left[c], room // c))
            pattern += [c] * k
            used[c] += k
            room -= k * c
        n = int((counts[used > 0] // used[used > 0]).min())
        out.append((tuple(pattern), n))
        counts -= n * used
    return out


def pack(found: DataFrame, window: int = WINDOW, grid: int = GRID, seed: int = 42) -> DataFrame:
    """``found`` (``doc_id, start, length, ids_crc32, ...``, read twice) with ``sequence_id`` and ``offset``."""
    keyed = found.withColumn("class", F.ceil(F.col("length") / grid).cast("int")).withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), "start", F.lit(seed)))
    keyed = keyed.withColumn("range", F.pmod(F.shiftright("draw", 20), F.lit(RANGES)).cast("int"))
    fine = keyed.groupBy("class", "range").agg(F.count("*").alias("n"))
    counts = np.zeros(-(-window // grid) + 1, np.int64)
    cells = fine.collect()  # at most classes x ranges rows, whatever the corpus
    for c, _, n in cells:
        counts[c] += n
    spark = found.sparkSession
    # Each class's ranks are dealt to patterns in turn: rank r of a run of n repeats with k slots goes to repeat r // k, slot r % k.
    runs, at, first = [], np.zeros(len(counts), np.int64), 0
    for pattern, n in plan(counts):
        slot = 0
        for c in sorted(set(pattern), reverse=True):
            k = pattern.count(c)
            runs.append((c, int(at[c]), int(at[c] + n * k), first, slot, k))
            at[c] += n * k
            slot += k
        first += n
    start: dict[int, int] = {}
    bases = []
    for c, r, n in sorted(cells):
        bases.append((c, r, start.get(c, 0)))
        start[c] = start.get(c, 0) + n
    base = spark.createDataFrame(bases, "class int, range int, base long")
    deals = spark.createDataFrame([(c, [(lo, hi, f, s, k) for cc, lo, hi, f, s, k in runs if cc == c]) for c in sorted({r[0] for r in runs})], "class int, deals array<struct<low: long, high: long, first: long, slot: int, each: int>>")
    rank = F.row_number().over(Window.partitionBy("class", "range").orderBy("draw", "doc_id", "start", "ids_crc32")) - 1
    # Both tables are bounded by classes x ranges and by the plan, not by the corpus.
    placed = keyed.join(F.broadcast(base), ["class", "range"]).withColumn("rank", F.col("base") + rank).join(F.broadcast(deals), "class")
    deal = F.filter("deals", lambda d: (F.col("rank") >= d["low"]) & (F.col("rank") < d["high"]))[0]
    inside = F.col("rank") - F.col("deal.low")
    placed = placed.withColumn("deal", deal).withColumn("sequence_id", F.col("deal.first") + F.floor(inside / F.col("deal.each")))
    placed = placed.withColumn("slot", F.col("deal.slot") + inside % F.col("deal.each"))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).select(*found.columns, F.col("sequence_id").cast("long"), "offset")


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, grid: int = GRID) -> DataFrame:
    return pack(checkpointed(pieces(docs, tokenizer, window=window)), window, grid)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), default_tokenizer())
