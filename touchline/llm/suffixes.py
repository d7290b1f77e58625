"""Exact removal of repeated byte strings by a collection BWT that is built one column of symbols at a time.

What is removed: each byte covered by a ``length``-byte string that also starts anywhere else in the collection, the same
document included. The work is split so that no task needs the whole collection:

1. Equal texts collapse to one. A text of ``length`` bytes or more that occurs twice goes as a whole, and one copy stays in
   the search for the others' sake.
2. Each window of ``length`` bytes picks its anchor: the leftmost smallest hashed 64-byte gram inside it. The choice depends
   on the window's content alone, so equal windows have equal anchors at equal distances. Only anchors whose gram occurs
   twice go on; all others can't hold a repeat.
3. The stretch of text covered by an anchor's windows is a short document. Documents of the same gram meet in one task,
   as columns of 8-byte symbols counted from the anchor. The collection's BWT is then built from the right: each round puts
   one symbol in front of every document, that is, into the BWT at the place of the document's newest suffix; the new suffix
   belongs where the symbol's rank in the BWT says, and it and its common prefixes are merged into the streams of the round
   before, which are read and written block by block as sequential scratch files (Bauer, Cox and Rosone, 2013; Cox,
   Garofalo, Rosone and Sciortino, 2016).
4. Runs of suffixes with a common prefix of ``length`` bytes are repeats. Windows that start inside a symbol compare the
   few bytes before it too.

A text may also be a row of words: each word is an 8-byte symbol of its own (a hash), and all lengths count words
(``unit="words"``). Windows then start at words alone, and a passage of so many words is found however long its words are.

A task that meets a gram often deals its places over salted parts, so that they are counted in many tasks.
An anchor with more than ``group_rows`` places (a passage that a third of all documents share) is not gathered in one
task: its windows are dealt into pieces of a few neighbours, equal pieces are counted before the shuffle, and distinct ones are
compared window by window, by digest.

Nulls: a null text is an empty text. Texts shorter than ``length`` lose nothing. Repeated rows are copies of each other.
The scratch files lie where Spark itself spills (SPARK_LOCAL_DIRS), have no name, belong to one task, and go with it: a lost
executor costs a rerun of its tasks, and no other task ever reads them.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from touchline.llm.common import bounded, checkpointed, read, tidy

LENGTH, GRAM = 400, 64
#: The same in words, for passages.
WORDS, WORD_GRAM = 50, 16
#: Places of one gram that a task takes as they are; short documents in one collection; window starts of a text handled at a time,
#: and elements of all texts.
GROUP_ROWS, COLLECTION, CHUNK, PART = 20_000, 10_000, 1 << 17, 1 << 18
#: Neighbouring windows that travel together where a gram is crowded.
PIECE = 16
#: Places of one gram that a task sends to where all of that gram meet, before it deals the rest over SALTS - 1 other parts.
SALT_AFTER, SALTS = 16, 64
#: Records of a stream that are read and written at a time, and words that a worker remembers the symbols of.
BLOCK_RECORDS, CACHED_WORDS = 1 << 16, 150_000
#: Rows of a batch that are Python objects at a time.
SLICE = 1000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with the same anchor: the gram's hash, its position, the first and the last window start.

    ``data``: texts end to end, less than 2**20 bytes (or words); ``ends``: for each position the end of its text. Windows stay inside texts.
    """
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    n = len(data) - length + 1
    if n <= 0:
        return none
    h, size, base = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, 0xD6E8FEB86659FD93
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), size * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width = length - gram + 1
    keys = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    whole = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    whole[: len(keys)] = keys
    tiles = whole.reshape(-1, width)
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    at = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + length <= ends[:n])
    if not len(starts):
        return none
    cut = np.flatnonzero((np.diff(at[starts]) != 0) | (np.diff(starts) != 1) | (np.diff(ends[starts]) != 0))
    first, last = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]
    return h[at[first]], at[first], first, last


def anchor_rows(texts: list[bytes], length: int, gram: int, width: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays ``(text number, hash, anchor, first, last)``, positions in their text; long texts are cut into overlapping parts.

    ``width``: bytes of an element; lengths and positions count elements.
    """
    if length > CHUNK:
        raise ValueError(f"length must be {CHUNK} at most")
    parts: list[tuple[int, int, np.ndarray]] = []
    total = 0
    for k, text in enumerate(texts):
        for s in range(0, max(0, len(text) // width - length + 1), CHUNK):
            piece = np.frombuffer(text, f"<u{width}")[s : s + CHUNK + length - 1]
            if total + len(piece) > PART:
                yield from _anchors(parts, length, gram)
                parts, total = [], 0
            parts.append((k, s, piece))
            total += len(piece)
    if parts:
        yield from _anchors(parts, length, gram)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


class Symbols(dict):
    """The 8-byte symbol of each word, remembered for so many words.

    A symbol is a 64-bit hash: two words of a corpus with a billion different words share one with a chance of 0.03.
    """

    def __missing__(self, word: bytes) -> bytes:
        self[word] = symbol = hashlib.blake2b(word, digest_size=8).digest()
        return symbol

    def row(self, text: bytes) -> bytes:
        """The symbols of a text's words: runs without ASCII white space."""
        if len(self) > CACHED_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


class Salter:
    """Deals the places of a gram that a task meets often.

    A place gets a salt only after two distinct places of its gram went without one. So what stays without a salt always
    shows two places, and a gram with a salted place needs no count to be known as repeated.
    """

    def __init__(self, after: int) -> None:
        self.after, self.counts, self.plain = after, np.zeros(1 << 20, np.int32), {}

    def salts(self, grams: np.ndarray, keys: pa.Array, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        cell, out = grams & ((1 << 20) - 1), np.zeros(len(grams), np.int32)
        np.add.at(self.counts, cell, 1)
        for i in np.flatnonzero(self.counts[cell] > self.after).tolist():
            place, plain = (keys[int(text[i])].as_py(), int(first[i])), self.plain.setdefault(int(grams[i]), [])
            if place in plain:
                continue
            if len(plain) < 2:
                plain.append(place)
            else:
                out[i] = 1 + (int.from_bytes(place[0][:4], "little") + place[1]) % (SALTS - 1)
        return out


def _anchors(parts: list[tuple[int, int, np.ndarray]], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    sizes = np.array([len(p) for _, _, p in parts])
    stops = np.cumsum(sizes)
    h, at, first, last = anchors_of(np.concatenate([p for _, _, p in parts]), np.repeat(stops, sizes), length, gram)
    part = np.searchsorted(stops, first, side="right")
    shift = np.array([s for _, s, _ in parts])[part] - (stops - sizes)[part]
    yield np.array([k for k, _, _ in parts])[part], h.view(np.int64), at + shift, first + shift, last + shift


class Streams:
    """The records of a collection's suffixes, in order, as sequential scratch files of one task, one file for each field.

    Fields: the symbol in front of the suffix (its BWT symbol, -1 where there is none yet), the symbols that it shares with the
    suffix before it, and its name. Each round reads one set of files block by block and writes the other.
    """

    KINDS = (np.int32, np.uint16, np.int64)

    def __init__(self, block: int) -> None:
        folder = next(iter(filter(os.path.isdir, os.environ.get("SPARK_LOCAL_DIRS", "").split(","))), None)
        self.sets = [[tempfile.TemporaryFile(dir=folder) for _ in self.KINDS] for _ in range(2)]
        self.now, self.size, self.block = 0, 0, block

    def read(self, fields: int = 3) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Blocks of the first so many fields, each with the place of its first record."""
        files = self.sets[self.now][:fields]
        for f in files:
            f.seek(0)
        for start in range(0, self.size, self.block):
            n = min(self.block, self.size - start)
            yield start, [np.fromfile(f, kind, n) for f, kind in zip(files, self.KINDS, strict=False)]

    def write(self, blocks: Iterable[list[np.ndarray]]) -> None:
        files, size = self.sets[1 - self.now], 0
        for f in files:
            f.seek(0)
        for block in blocks:
            for f, kind, x in zip(files, self.KINDS, block, strict=True):
                x.astype(kind, copy=False).tofile(f)
            size += len(block[0])
        for f in files:
            f.flush()
        self.now, self.size = 1 - self.now, size

    def close(self) -> None:
        for f in [*self.sets[0], *self.sets[1]]:
            f.close()


def range_minimum(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest of ``values[left:right]`` for each pair (left < right), by a sparse table."""
    out, depth = np.empty(len(left), values.dtype), np.log2(right - left).astype(np.int64)
    table, step = values, 1
    for d in range(int(depth.max(initial=-1)) + 1):
        k = np.flatnonzero(depth == d)
        out[k] = np.minimum(table[left[k]], table[right[k] - step])
        table, step = np.minimum(table[:-step], table[step:]), step * 2
    return out


def build(columns: list[np.ndarray], alive: list[np.ndarray], block: int = BLOCK_RECORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of a collection, with common prefixes, by its BWT, built column by column from the right.

    ``columns[j]``: the symbol that document ``alive[j][i]`` puts in front in round j. Returns for each suffix, in order,
    ``round * documents + document`` and the number of symbols it shares with the one before it. The documents' empty suffixes
    come first, with names below zero. More than 65,534 rounds would not fit a common prefix and are refused.
    """
    if len(columns) > 65_534:
        raise ValueError("documents of more than 65,534 symbols")
    count = len(alive[0]) if alive else 0
    symbols_ = 1 + max((int(c.max()) for c in columns if len(c)), default=0)
    heads, place = np.zeros(symbols_, np.int64), np.arange(count)  # suffixes by first symbol; each document's newest suffix
    streams = Streams(block)
    try:
        streams.write([[np.full(count, -1), np.zeros(count), np.arange(-count, 0)]])
        for j, (symbols, docs) in enumerate(zip(columns, alive, strict=True)):
            order = np.argsort(place[docs])
            docs, symbols = docs[order], symbols[order]
            at = place[docs]
            wanted = np.zeros(symbols_ + 1, bool)  # the last stands for -1
            wanted[symbols] = True

            def filled(start: int, bwt: np.ndarray, at: np.ndarray = at, symbols: np.ndarray = symbols) -> np.ndarray:
                lo, hi = np.searchsorted(at, (start, start + len(bwt)))
                bwt[at[lo:hi] - start] = symbols[lo:hi]
                return bwt

            # First pass: where this round's symbols stand in the BWT, and the least common prefix since the place before.
            found, least = [], 65_535
            for start, (bwt, common) in streams.read(2):
                hit = np.flatnonzero(wanted[filled(start, bwt)])
                low = np.minimum.reduceat(np.append(common, np.uint16(65_535)), np.concatenate(([0], hit + 1)))
                low[0] = min(int(low[0]), least)
                least = int(low[-1])
                found.append((bwt[hit], hit + start, low[:-1]))
            symbol, stands, low = (np.concatenate(x) for x in zip(*found, strict=True))
            fresh = np.zeros(len(stands), bool)
            fresh[np.searchsorted(stands, at)] = True
            # A symbol's k-th place in the BWT belongs to the k-th of the suffixes that start with it.
            order = np.argsort(symbol, kind="stable")
            symbol, stands, fresh = symbol[order], stands[order], fresh[order]
            opens = np.concatenate(([True], symbol[1:] != symbol[:-1]))
            rank = np.arange(len(symbol)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
            heads += np.bincount(symbols, minlength=symbols_)
            new_place = count + (np.cumsum(heads) - heads)[symbol] + rank
            shared = np.zeros(len(symbol), np.uint16)
            pair = np.flatnonzero(~opens & (fresh | np.concatenate(([False], fresh[:-1]))))
            shared[pair] = range_minimum(low, order[pair - 1] + 1, order[pair] + 1) + np.uint16(1)
            changed = pair[~fresh[pair]]
            changed_at, changed_to = new_place[changed], shared[changed]
            docs = docs[np.searchsorted(at, stands[fresh])]
            new_place, shared = new_place[fresh], shared[fresh]
            place[docs] = new_place
            before = new_place - np.arange(len(new_place))  # the old record that each new one precedes
            fields = [np.full(len(docs), -1, np.int32), shared, j * count + docs]

            def merged() -> Iterator[list[np.ndarray]]:
                """Second pass: the old records with the new ones in their places."""
                for start, old in streams.read():
                    old[0] = filled(start, old[0])
                    end = start + len(old[0])
                    lo, hi = np.searchsorted(before, (start, end if end < streams.size else end + 1))
                    first, total = start + lo, len(old[0]) + hi - lo
                    own = np.ones(total, bool)
                    own[new_place[lo:hi] - first] = False
                    out = [np.empty(total, x.dtype) for x in old]
                    for o, x, f in zip(out, old, fields, strict=True):
                        o[own], o[~own] = x, f[lo:hi]
                    s, e = np.searchsorted(changed_at, (first, first + total))
                    out[1][changed_at[s:e] - first] = changed_to[s:e]
                    yield out

            streams.write(merged())
        blocks_ = [x for _, x in streams.read()]
        return (np.concatenate([x[2] for x in blocks_]), np.concatenate([x[1] for x in blocks_])) if blocks_ else (np.zeros(0, np.int64), np.zeros(0, np.uint16))
    finally:
        streams.close()


def repeated(segments: list[bytes], first: np.ndarray, copies: np.ndarray, length: int, width: int = 1) -> Iterator[tuple[int, int, int]]:
    """Runs ``(segment, from, to)`` of window starts, relative to the anchor, whose window starts elsewhere in the collection.

    ``first``: where each segment starts relative to its anchor; ``copies``: how many places it stands for; ``width``: bytes of an
    element, 1 or 8.
    """
    first, length = first * width, length * width
    count, sizes = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
    grid = first // 8  # symbols lie on multiples of 8 from the anchor
    blocks_ = -(-(first + sizes) // 8) - grid
    lead = first - grid * 8
    buffer = np.zeros((count, int(blocks_.max()) * 8), np.uint8)
    for k, s in enumerate(segments):
        buffer[k, lead[k] : lead[k] + len(s)] = np.frombuffer(s, np.uint8)
    words = buffer.view(">u8").astype(np.uint64)
    held = np.arange(words.shape[1])[None, :] < blocks_[:, None]
    ranks = np.zeros(words.shape, np.int32)
    ranks[held] = np.unique(words[held], return_inverse=True)[1]
    rounds = int(blocks_.max())
    alive = [np.flatnonzero(blocks_ > j) for j in range(rounds)]
    names, common = build([ranks[d, blocks_[d] - 1 - j] for j, d in enumerate(alive)], alive)
    names, common = names[count:], common[count:].astype(np.int64)
    common[0] = 0
    doc, block = names % count, blocks_[names % count] - 1 - names // count
    whole = length // 8
    shared = common * 8
    close = np.flatnonzero((common < whole) & (common >= whole - 1))  # a few bytes of the next symbol decide
    if len(close):
        nxt = block + common, np.roll(block, 1) + common
        owners = doc, np.roll(doc, 1)
        a, b = (np.where(nxt[i][close] < blocks_[owners[i][close]], words[owners[i][close], np.minimum(nxt[i][close], words.shape[1] - 1)], np.uint64(0)) for i in (0, 1))
        differ = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        shared[close] += np.where(differ.any(1), differ.argmax(1), 8)
    start = block * 8 - lead[doc]  # of the suffix, in its segment
    left = sizes[doc] - start
    marks = np.zeros((count, int((sizes - length).max()) // width + 1), bool)
    near = np.append(shared[1:] >= length - 7, False) | (shared >= length - 7)
    for e in range(0, 8, width):
        group = np.cumsum(shared < length - e)
        ok = np.flatnonzero(((copies[doc] > 1) | near) & (left >= length - e) & (start >= e))
        if not len(ok):
            continue
        bytes_before = np.zeros(len(ok), np.uint64)
        if e:
            bytes_before = words[doc[ok], block[ok] - 1] & np.uint64((1 << (8 * e)) - 1)
        order = np.lexsort((bytes_before, group[ok]))
        g, p, o = group[ok][order], bytes_before[order], ok[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])))
        members = np.cumsum(new) - 1
        many = np.bincount(members, weights=copies[doc[o]])[members] > 1
        marks[doc[o[many]], (start[o[many]] - e) // width] = True
    for k in np.flatnonzero(marks.any(1)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], marks[k].view(np.int8), [0]))))
        for s, t in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            yield int(k), int(first[k]) // width + s, int(first[k]) // width + t - 1


def with_key(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``raw``, the text's bytes, and ``key``, the first half of their SHA-256."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.withColumn("__raw", raw).withColumn("__key", F.substring(F.unhex(F.sha2("__raw", 256)), 1, 16))


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS, salt_after: int = SALT_AFTER, width: int = 1) -> DataFrame:
    """``(key, runs)`` for each distinct text that has repeated windows.

    ``rows``: ``__key`` and ``__raw`` of all texts, read where they lie to find anchors; only texts with a gram that occurs twice
    move. runs: arrays of (from, to) of repeated window starts in the text; neighbours may touch. Lengths and positions count
    elements of ``width`` bytes: 1, the texts' bytes, or 8, their words as symbols.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salter, symbols = Salter(salt_after), Symbols()
        for batch in slices(batches):
            keys, raw = batch.column("__key"), batch.column("__raw").to_pylist()
            for k, h, at, first, last in anchor_rows(raw if width == 1 else list(map(symbols.row, raw)), length, gram, width):
                salt = pa.array(salter.salts(h, keys, k, first), pa.int32())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(k)), *(pa.array(x, pa.int64()) for x in (h, at, first, last)), salt], ["key", "gram", "at", "first", "last", "salt"])

    places = rows.select("__key", "__raw").mapInArrow(tidy(find), "key binary, gram long, at long, first long, last long, salt int")
    # One shuffle serves both the removal of copies' places and the count. A copy's place may stay once with a salt and once
    # without: its text has copies, so that it goes as a whole anyway.
    places = places.repartition("gram", "salt").dropDuplicates(["gram", "salt", "key", "first"])
    places = checkpointed(places.withColumn("n", F.count("*").over(Window.partitionBy("gram", "salt"))).where("n > 1 OR salt > 0"))
    if places.where("salt > 0").take(1):
        dealt = places.where("salt > 0").select("gram").distinct()
        total = places.join(bounded(dealt), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("total"))
        places = places.join(bounded(total), "gram", "left").withColumn("n", F.coalesce("total", "n")).drop("total")
    crowds = bool(places.where(F.col("n") > group_rows).take(1))
    names = ["gram", "sub", "key", "at", "first", "segment"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretch of each place, or for crowded grams its pieces, with a digest."""
        rows: list[tuple] = []
        size, symbols = 0, Symbols()
        for batch in slices(batches):
            for key, raw, spots in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "places")), strict=True):
                raw = raw if width == 1 else symbols.row(raw)
                for p in spots:
                    if p["n"] <= group_rows:
                        pieces = [(p["first"], raw[p["first"] * width : (p["last"] + length) * width], b"")]
                    else:
                        pieces = []
                        s = p["first"]
                        while s <= p["last"]:  # cut at multiples from the anchor, so that equal places are cut alike
                            e = min(p["last"], p["at"] + ((s - p["at"]) // PIECE + 1) * PIECE - 1)
                            w = raw[s * width : (e + length) * width]
                            pieces.append((s, w, hashlib.blake2b(w, digest_size=16).digest()))
                            s = e + 1
                    for s, piece, sub in pieces:
                        rows.append((p["gram"], sub, key, p["at"], s, piece))
                        size += len(piece) + 100
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def segments(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("key").agg(F.collect_list(F.struct("gram", "at", "first", "last", "n")).alias("places"))
        texts = rows.join(bounded(some.select(F.col("key").alias("__key")).distinct()), "__key", "left_semi").groupBy(F.col("__key").alias("key")).agg(F.first("__raw").alias("raw"))
        return texts.join(wanted, "key").mapInArrow(tidy(cut), "gram long, sub binary, key binary, at long, first long, segment binary")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Collections of whole grams, in order of gram."""
        held: list[pa.RecordBatch] = []
        count = 0

        def out(table: pa.Table) -> pa.RecordBatch:
            keys, at, first = table.column("key"), table.column("at").to_numpy(), table.column("first").to_numpy()
            pieces = table.column("segment").to_pylist()
            # Equal segments of one gram collapse, with their count.
            index: dict[tuple, int] = {}
            member = np.array([index.setdefault(x, len(index)) for x in zip(table.column("gram").to_pylist(), (first - at).tolist(), pieces, strict=True)])
            copies = np.bincount(member)
            runs: dict[int, list[tuple[int, int]]] = {}
            distinct = list(index)
            for k, s, t in repeated([x[2] for x in distinct], np.array([x[1] for x in distinct]), copies, length, width):
                runs.setdefault(k, []).append((s, t))
            rows = [(i, a + s, a + t) for i, (m, a) in enumerate(zip(member.tolist(), at.tolist(), strict=True)) for s, t in runs.get(m, ())]
            where, s, t = zip(*rows, strict=True) if rows else ((), (), ())
            taken = keys.take(pa.array(where, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([taken.chunk(0) if isinstance(taken, pa.ChunkedArray) and taken.num_chunks == 1 else pa.array(taken.to_pylist(), pa.binary()), pa.array(s, pa.int64()), pa.array(t, pa.int64())], ["key", "start", "stop"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= COLLECTION:
                table = pa.Table.from_batches(held)
                grams = table.column("gram").to_numpy()
                cut_at = int(np.searchsorted(grams, grams[-1])) if grams[0] != grams[-1] else 0
                if cut_at:
                    yield out(table.slice(0, cut_at))
                    held = table.slice(cut_at).to_batches()
                    count -= cut_at
        if count:
            yield out(pa.Table.from_batches(held))

    solved = segments(places.where(F.col("n") <= group_rows)).drop("sub").repartition("gram").sortWithinPartitions("gram")
    found = solved.mapInArrow(tidy(solve), "key binary, start long, stop long")
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    if crowds:
        # Pieces are counted by content before the shuffle; distinct ones alone are taken apart into windows.
        crowded = segments(places.where(F.col("n") > group_rows)).select("gram", "sub", "key", "first", "segment")
        distinct = crowded.groupBy("gram", "sub").agg(F.count("*").alias("copies"), F.first("segment").alias("segment"))
        starts = F.sequence(F.lit(0), F.floor(F.length("segment") / width).cast("int") - length)
        window = F.transform(starts, lambda i: F.md5(F.substring("segment", i * width + 1, F.lit(length * width))))
        windows = distinct.select("gram", "sub", "copies", F.posexplode(window).alias("pos", "window"))
        many = windows.groupBy("gram", "window").agg(F.sum("copies").alias("many")).where("many > 1").drop("many")
        marked = checkpointed(windows.join(many, ["gram", "window"]).groupBy("gram", "sub").agg(F.collect_list("pos").alias("marks")))
        runs = F.transform("marks", lambda p: F.struct((F.col("first") + p).alias("start"), (F.col("first") + p).alias("stop")))
        # A piece that a third of all texts share: its marks go to the places where there are few, else the join's large side is split.
        single = crowded.select("gram", "sub", "key", "first").join(bounded(marked, weight=F.size("marks") + 4), ["gram", "sub"]).select("key", runs.alias("runs"))
        single = single.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        found = found.unionByName(single).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return found


def repeated_spans(docs: DataFrame, text: str, length: int, gram: int, group_rows: int = GROUP_ROWS, salt_after: int = SALT_AFTER, width: int = 1) -> DataFrame:
    """``__key, spans`` of each distinct text that loses something: half-open ranges, maximal, in order, in elements of ``width`` bytes.

    A text of ``length`` or more that occurs twice is one span.
    """
    rows = with_key(docs, text).select("__key", "__raw")
    found = repeats(rows, length, gram, group_rows, salt_after, width)
    # Texts that occur twice: their size alone counts.
    copied = checkpointed(rows.groupBy("__key").count().where("count > 1").select("__key"))
    n = F.first(word_count(F.col("__raw").cast("string")) if width == 8 else F.length("__raw").cast("long")).alias("n")
    whole = rows.join(bounded(copied), "__key", "left_semi").groupBy(F.col("__key").alias("key")).agg(n).where(F.col("n") >= length)
    whole = whole.select("key", F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("n") - length).alias("stop"))).alias("runs"))
    every = found.unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in slices(batches):
            out = [[{"start": a, "stop": b} for a, b in spans(runs, length)] for runs in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind)], ["__key", "spans"])

    return every.mapInArrow(tidy(merged), "__key binary, spans array<struct<start: long, stop: long>>")


def spans(runs: list, length: int) -> list[tuple[int, int]]:
    """Maximal spans covered by the windows that start in the runs."""
    out: list[list[int]] = []
    for s, t in sorted((r["start"], r["stop"]) for r in runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t + length)
        else:
            out.append([s, t + length])
    return [(a, b) for a, b in out]


@F.arrow_udf(BinaryType())
def kept_bytes(raw: pa.Array, spans_: pa.Array) -> pa.Array:
    """The bytes outside the spans."""
    out = []
    for text, found in zip(raw, spans_, strict=True):
        text, ends = text.as_py(), [0, *(x for s in found.as_py() for x in (s["start"], s["stop"]))]
        out.append(b"".join(text[a:b] for a, b in zip(ends[::2], [*ends[1::2], len(text)], strict=True)))
    return pa.array(out, pa.binary())


def split(docs: DataFrame, text: str, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that lose nothing, which stay where they are, and those that lose ``__spans``, both with ``__raw``."""
    lost = checkpointed(lost.withColumnRenamed("spans", "__spans"))
    rows = with_key(docs, text).join(bounded(lost, weight=F.size("__spans") * 2 + 3), "__key", "left").drop("__key")
    return rows.where("__spans IS NULL"), rows.where("__spans IS NOT NULL")


def strip_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS, made: dict[str, Column] | None = None, salt_after: int = SALT_AFTER) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (removed byte ranges, half open) and ``kept`` (the remaining bytes) in place of the text.

    ``made``: columns over these three to return instead of them. Columns of these names are replaced.
    """
    if gram & (gram - 1) or length < gram + 8 or length % 8:
        raise ValueError("gram must be a power of two, length a multiple of 8 and at least 8 over gram")
    same, changed = split(docs, text, repeated_spans(docs.select(text), text, length, gram, group_rows, salt_after))
    names = ["n_bytes", "spans", "kept"]
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in [*names, *(made or ())]]
    size, none = F.length("__raw").cast("long").alias("n_bytes"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans")
    made = {n: F.col(n) for n in names} if made is None else made
    told = [c.alias(n) for n, c in made.items()]
    # What is made of the three is made before the rows meet again.
    return (
        same.select(*others, size, none, F.col("__raw").alias("kept")).select(*others, *told)
        .unionByName(changed.select(*others, size, F.col("__spans").alias("spans"), kept_bytes("__raw", "__spans").alias("kept")).select(*others, *told))
    )


def removed(spans_: Column) -> Column:
    return F.aggregate(spans_, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"n_bytes": F.col("n_bytes"), "n_removed": removed(F.col("spans")), "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}
    return strip_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), made=made).select("doc_id", *made)


def passages(docs: DataFrame, text: str = "text", length: int = WORDS, gram: int = WORD_GRAM, group_rows: int = GROUP_ROWS, salt_after: int = SALT_AFTER) -> DataFrame:
    """``__key, spans`` of each distinct text that holds a passage of ``length`` words that starts anywhere else too.

    spans: half-open ranges of word numbers, maximal, in order. A text of so many words that occurs twice is one span.
    """
    if gram & (gram - 1) or length <= gram:
        raise ValueError("gram must be a power of two and less than length")
    return repeated_spans(docs.select(text), text, length, gram, group_rows, salt_after, 8)


def word_count(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def without_words(text: str, spans_: list[tuple[int, int]]) -> str:
    """``text`` without the words of each span (from, to) and the white space after them."""
    edges, at = [], 0
    wanted = [x for s in spans_ for x in s]
    for k, m in enumerate(WORD.finditer(text)):
        while at < len(wanted) and wanted[at] == k:
            edges.append(m.start())
            at += 1
    edges += [len(text)] * (len(wanted) - at)
    bounds = [0, *edges, len(text)]
    return "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


@F.arrow_udf(StringType())
def kept_words(text: pa.Array, spans_: pa.Array) -> pa.Array:
    rows = zip(text, spans_, strict=True)
    kept = (without_words(t.as_py(), [(s["start"], s["stop"]) for s in found.as_py()]) for t, found in rows)
    parts = iter(lambda: pa.array(list(islice(kept, SLICE)), pa.string()), pa.array([], pa.string()))
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def without_repeats(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """``docs`` without the passages of ``length`` words or more that start anywhere else too, in any row. All rows stay.

    Every copy of a passage goes, the first one as well. What is cut goes from a word's start to the start of the next word that
    stays. A text that loses nothing, null included, is unchanged; ``n_chars``, where it is a column, is counted anew.
    """
    same, changed = split(docs, "text", passages(docs, length=length))
    changed = changed.withColumn("text", kept_words("text", "__spans"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return same.select(columns).unionByName(changed.select(columns))
