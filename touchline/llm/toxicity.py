"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Documents carry one label each, so tokens get theirs from counts over all labelled training documents: in a document marked
toxic, a word is labelled toxic if it occurs in toxic documents far more often than chance allows and in more toxic than
clean ones; all other tokens are labelled clean. A two-state chain with weights for words, states and transitions is fitted to
these labels by gradient ascent on the exact conditional likelihood, from forward-backward marginals, over a bounded sample of
training documents. Scoring runs forward-backward over every token of every text. A document's score is a logistic function
of the largest marginal and of the expected number of toxic tokens; offending offsets are the runs of tokens whose marginal is
one half or more.

Nulls: a null or wordless text scores as a text without toxic tokens. Null labels teach nothing; of several labels of a
doc_id the largest counts. Repeated texts count once in the word counts. Without labelled rows of both kinds all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import blocks, bounded, read, texts_of, tidy
from touchline.llm.langid import remainder

TOKEN = re.compile(r"\w+")
#: Documents in the fitted sample (half of each label where there are enough), and words with a weight of their own.
SAMPLE, VOCABULARY = 3000, 20_000


def lowered(text: str) -> str | None:
    """The text in lower case, if that keeps its offsets (a capital dotted I becomes two characters)."""
    low = text.lower()
    return low if len(low) == len(text) else None


def tokens(text: str) -> list[str]:
    low = lowered(text)
    return TOKEN.findall(low) if low is not None else [w.lower() for w in TOKEN.findall(text)]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, toxic, clean``: how many rows of each label hold the word; ``docs``: ``text, label``.

    Tasks count before the shuffle, in tables that are handed on when they reach a bound.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["word", "toxic", "clean"])
            counts.clear()
            return rows

        for batch in batches:
            for text, label in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                for w in set(tokens(text)):
                    counts.setdefault(w, [0, 0])[label] += 1
                if len(counts) > 300_000:
                    yield out()
        yield out()

    return docs.select("text", "label").mapInArrow(tidy(run), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling_words(counts: DataFrame, toxic: int, clean: int, least: float = 3.0) -> list[tuple[str, float, float]]:
    """The words that speak most for toxicity: word, z against chance, and share of its documents that are toxic."""
    p = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    scored = counts.withColumn("z", (F.col("toxic") - n * p) / F.sqrt(n * p * (1 - p))).withColumn("share", F.col("toxic") / n)
    rows = scored.where((F.col("z") >= least) & (F.col("toxic") >= 2)).orderBy(F.desc("z"), "word").limit(VOCABULARY).select("word", "z", "share").collect()
    return [tuple(r) for r in rows]


def forward_backward(gain: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios of state 1 to state 0 forward and backward, and marginals of state 1, of chains laid end to end.

    ``gain``: the factor that each token gives state 1 over state 0; ``t``: transition factors. All chains step together.
    """
    forward, backward = np.zeros(len(gain)), np.zeros(len(gain))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    live = int((sizes > 0).sum())
    starts, sizes = starts[:live], sizes[:live]
    steps = int(sizes[0]) if live else 0
    counts = live - np.searchsorted(sizes[::-1], np.arange(steps), side="right")  # chains longer than each step
    if live:
        forward[starts] = gain[starts]
        r = gain[starts]
    for j in range(1, steps):
        at = starts[: counts[j]] + j
        r = r[: counts[j]]
        r = gain[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
        forward[at] = r
    ends = starts + sizes - 1
    if live:
        backward[ends] = 1.0
        r = np.ones(counts[0])
    for j in range(1, steps):
        at = ends[: counts[j]] - j
        r = r[: counts[j]]
        e = gain[at + 1] * r
        r = (t[1, 0] + t[1, 1] * e) / (t[0, 0] + t[0, 1] * e)
        backward[at] = r
    odds = forward * backward
    return forward, backward, odds / (1 + odds)


@dataclass
class ToxicityModel:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))  # the last is that of every token
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all tokens, end to end, and the number of tokens of each text; other words are the last number."""
        other, known = len(self.words), self.words.get
        rows = [[known(w, other) for w in tokens(t)] for t in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((k for r in rows for k in r), np.int64, int(sizes.sum())), sizes

    def gains(self, codes: np.ndarray) -> np.ndarray:
        table = np.append(self.weights[:-1], 0.0) + self.weights[-1]
        return np.exp(np.clip(table, -30, 30))[codes]

    def marginals(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return forward_backward(self.gains(codes), sizes, np.exp(self.transitions))[2]

    def features(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each text: log odds of the largest marginal, and the logarithm of the expected number of likely toxic tokens."""
        out = np.tile([-12.0, 0.0], (len(sizes), 1))
        full = np.flatnonzero(sizes)
        if len(full):
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full].astype(np.int64)
            top = np.clip(np.maximum.reduceat(p, at), 6e-6, 1 - 6e-6)
            out[full, 0] = np.log(top / (1 - top))
            out[full, 1] = np.log1p(np.add.reduceat(np.where(p > 0.1, p, 0.0), at))
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the offending offsets of each text in code points."""
        codes, sizes = self.coded(texts)
        p = self.marginals(codes, sizes)
        x = self.features(p, sizes)
        score = 1 / (1 + np.exp(-np.clip(self.scale[0] + x @ self.scale[1:], -500, 500)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        at = np.concatenate(([0], np.cumsum(sizes)))
        for k in np.unique(np.searchsorted(at, np.flatnonzero(p >= 0.5), side="right") - 1).tolist():
            low = lowered(texts[k])
            places = [m.span() for m in TOKEN.finditer(texts[k] if low is None else low)]
            before = -2
            for i in np.flatnonzero(p[at[k] : at[k + 1]] >= 0.5).tolist():
                if i == before + 1:
                    spans[k][-1] = (spans[k][-1][0], places[i][1])
                else:
                    spans[k].append(places[i])
                before = i
        return score, spans


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Intercept and slopes, by Newton's method with a ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, sample: int = SAMPLE, rounds: int = 40) -> ToxicityModel:
    """Learns from ``docs`` (``doc_id, text, label`` 0 or 1): word counts from all rows, the chain from about ``sample`` of them.

    The sample is the rows of the smallest hashes of doc_id and text, and never more than twice as many as asked for. At most
    ``VOCABULARY`` words, those that tell most, have a weight of their own: the size of the model, whatever that of the corpus.
    """
    rows = docs.where("label IN (0, 1)").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    # One row of each distinct text counts. Texts stay where they are: hashes and ids alone are shuffled.
    firsts = rows.select("doc_id", F.xxhash64("text").alias("key"), "label").groupBy("key", "label").agg(F.min("doc_id").alias("doc_id"))
    sizes = {r[0]: r[1] for r in firsts.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel()
    telling = telling_words(word_counts(rows.join(bounded(firsts.select("doc_id").distinct()), "doc_id", "left_semi")), sizes[1], sizes[0])
    model = ToxicityModel({w: k for k, (w, _, _) in enumerate(telling)})
    # A word's label: chance would have to be off by six standard deviations.
    labelled = np.array([z >= 6 and share >= 0.5 for _, z, share in telling] + [False])
    share = F.when(F.col("label") == 1, min(1.0, sample / 2 / sizes[1])).otherwise(min(1.0, sample / 2 / sizes[0]))
    drawn = rows.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(42))).where(F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) < share)
    drawn = drawn.orderBy("hash", "doc_id", "text", "label").limit(2 * sample).select("doc_id", "text", "label")
    chosen = sorted((r[0] or "", r[1], r[2]) for r in drawn.collect())
    texts, label = [r[1] for r in chosen], np.array([r[2] for r in chosen])
    codes, lengths = model.coded(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    y = labelled[codes] & (label[owner] == 1)
    count = len(telling)
    weights, trans = np.zeros(count + 1), np.zeros((2, 2))
    weights[-1] = -2.0
    squares_w, squares_t = np.full(count + 1, 1e-6), np.full((2, 2), 1e-6)
    first = np.zeros(len(codes), bool)
    first[np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0].astype(np.int64)] = True
    later = np.flatnonzero(~first)
    seen = np.array([[np.sum((y[later - 1] == i) & (y[later] == j)) for j in (0, 1)] for i in (0, 1)], float)
    for _ in range(rounds):
        model.weights, model.transitions = weights, trans
        t, gain = np.exp(trans), model.gains(codes)
        forward, backward, p = forward_backward(gain, lengths, t)
        push = y - p
        g = np.append(np.bincount(codes, push, count + 1)[:count], push.sum()) - 1e-3 * weights
        r, e = forward[later - 1], gain[later] * backward[later]
        joint = np.stack([np.full(len(r), t[0, 0]), t[0, 1] * e, t[1, 0] * r, t[1, 1] * r * e])
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        h = seen - expected - 1e-3 * trans
        h[0, 0] = 0  # one factor fixes the scale
        squares_w += g * g
        squares_t += h * h
        weights, trans = weights + g / np.sqrt(squares_w), np.clip(trans + 0.5 * h / np.sqrt(squares_t), -8, 8)
    model.weights, model.transitions = weights, trans
    x = model.features(model.marginals(codes, lengths), lengths)
    w = logistic(x, label.astype(float))
    # The sample is balanced; the intercept goes back to the labels' shares where both labels occur in it.
    if 0 < label.sum() < len(label):
        w[0] += 0.5 * (math.log(sizes[1] / sizes[0]) - math.log(label.sum() / (len(label) - label.sum())))
    model.scale = w
    return model


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``spans`` (offending offsets in code points) in place of ``text``."""
    kept = [f for f in docs.schema if f.name not in ("text", "score", "predicted", "spans")]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            scores: list[float] = []
            spans: list[list[dict]] = []
            for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 23):
                s, places = model.scores(texts[a:b])
                scores += s.tolist()
                spans += [[{"start": x, "stop": y} for x, y in p] for p in places]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), "score", "predicted", "spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double, predicted int, spans array<struct<start: long, stop: long>>"])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), "text").mapInArrow(tidy(run), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 5) == 0)
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = fit(docs.where("not held_out").join(bounded(labels), "doc_id"))
    return scored(docs, model).select("doc_id", "held_out", "score", "predicted", "spans")


