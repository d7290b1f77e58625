"""Chat formatting at token level.

A conversation becomes one sequence of token ids. Roles and texts are encoded separately, as ordinary text, and ids beyond
the vocabulary are spliced in between: one before each role, one between role and text, one after each text. No text can
therefore make a turn. The loss mask is the prefix sum of +1 where an assistant's text starts and -1 where it ends.
Control strings inside roles and texts are escaped too, so that the sequence written out as a string can be read back: a
backslash goes in after the first character of each, and after the backslashes already there.

Turns are sorted within a conversation and streamed through a task one by one, so that a conversation with a third of all
rows needs no more memory than its own output row; equal rows stay, as turns of their own.

Nulls: a null role or text is empty; a null turn comes first; rows with a null conv_id form one conversation. Ties in turn
go by role, then text. A table without rows gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import read, tidy

#: Markers of this template, then control strings of common chat templates that texts may hold.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>")
CONTROL = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROLS))
ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(\\*){re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


@dataclass
class ChatTokens:
    """A byte-level vocabulary with three reserved ids after its last."""

    path: str
    pattern: str

    def __post_init__(self) -> None:
        import tiktoken

        with open(self.path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("chat", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.reserved = {first: TURN, first + 1: TEXT, first + 2: END}
        self.turn, self.text, self.end = self.reserved

    def segment(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(escape(text))

    def assemble(self, turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[np.ndarray, np.ndarray]:
        """The ids of a conversation, and its loss mask: 1 on the text ids of the role ``learn``."""
        parts: list[list[int]] = []
        size, steps = 0, []
        for role, text in turns:
            head, body = self.segment(role), self.segment(text)
            start = size + len(head) + 2
            if role == learn:
                steps += [(start, 1), (start + len(body), -1)]
            parts += [[self.turn], head, [self.text], body, [self.end]]
            size = start + len(body) + 1
        ids = np.fromiter((i for p in parts for i in p), np.int32, size)
        change = np.zeros(size + 1, np.int8)
        for at, by in steps:
            change[at] += by
        return ids, np.cumsum(change[:-1], dtype=np.int8)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist())

    def string(self, ids: np.ndarray) -> str:
        """The sequence written out, reserved ids as their markers."""
        out, at = [], 0
        for k in [*np.flatnonzero(ids >= self.turn).tolist(), len(ids)]:
            out.append(self.decode(ids[at:k]))
            if k < len(ids):
                out.append(self.reserved[int(ids[k])])
            at = k + 1
        return "".join(out)

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """The turns read back from a sequence of ids."""
        starts, middles, ends = (np.flatnonzero(ids == k) for k in (self.turn, self.text, self.end))
        return [(unescape(self.decode(ids[a + 1 : b])), unescape(self.decode(ids[b + 1 : c]))) for a, b, c in zip(starts, middles, ends, strict=True)]

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts under the mask, read back."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
        return [unescape(self.decode(ids[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def turns_in(text: str) -> list[tuple[str, str]]:
    """The turns read back from a sequence written out as a string."""
    out = []
    for turn in text.split(TURN)[1:]:
        role, body = turn.split(TEXT, 1)
        out.append((unescape(role), unescape(body.removesuffix(END))))
    return out


def formatted(rows: DataFrame, path: str, pattern: str, learn: str = "assistant") -> DataFrame:
    """``conv_id, ids, loss_mask, text`` for each conversation of ``rows`` (``conv_id, turn, role, text``)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "ids", "loss_mask", "text"]
    types = [pa.list_(pa.int32()), pa.list_(pa.int8()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ChatTokens(path, pattern)
        done: list[tuple] = []
        open_: list[tuple[str, str]] = []
        last, size, id_type = None, 0, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names)

        def close() -> int:
            ids, mask = tokens.assemble(open_, learn)
            done.append((last, ids, mask, tokens.string(ids)))
            open_.clear()
            return len(ids)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if open_ and conv != last:
                    size += close()
                    if size > 1 << 20:
                        yield out()
                        size = 0
                last = conv
                open_.append((role or "", text or ""))
        if open_:
            close()
        if done:
            yield out()

    sorted_rows = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.mapInArrow(tidy(run), f"conv_id {kind}, ids array<int>, loss_mask array<tinyint>, text string")


def digests(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the texts under the loss mask."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ChatTokens(path, pattern)
        for batch in batches:
            rows = []
            for ids, mask, text in zip(batch.column("ids"), batch.column("loss_mask"), batch.column("text").to_pylist(), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                turns, learned = tokens.turns(ids), "".join(tokens.learned(ids, mask))
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), whole, len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text), len(ids), int(mask.sum()), turns_in(text) == turns))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "loss_ids", "string_agrees"])

    return conversations.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, loss_ids long, string_agrees boolean")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    path, pattern = default_vocabulary()
    return digests(formatted(rows.unionByName(extra), path, pattern), path, pattern)
