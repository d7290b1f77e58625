"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text (anything but letters counts as one blank) are hashed into a fixed number
of features. Inverse document frequencies come from all training rows. The regression is fitted by follow-the-regularised-
leader (FTRL-proximal) with elastic-net penalties on a bounded, hash-chosen sample of rows for each language, and its
temperature is calibrated on a part of the sample that the fit has not seen. Scoring reads whole texts.

Nulls: a null text or one without a letter (Unicode's categories L; "²" and "Ⅷ" are none) is predicted ``und`` with score 0. Rows whose language is null teach nothing.
Without any training row all predictions are ``und``. Ties go to the language first by code point. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import blocks, letters, read, texts_of, tidy

BITS = 14
#: Mean TF-IDF values are small; all are multiplied by this before the regression.
SCALE = 20.0


def grams(texts: list[str], n: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length up to ``n``, the feature of the n-gram that starts at each character; and the texts' offsets.

    An n-gram that runs over its text's end, or is a lone blank, has the feature 2**BITS, which weighs nothing.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    left = np.repeat(offsets[1:], sizes) - np.arange(len(codes))
    out, mixed = [], np.zeros(len(codes), np.uint32)
    for k in range(1, n + 1):
        mixed = (mixed + np.uint32(k)) * np.uint32(0x9E3779B1)
        mixed[: len(codes) - k + 1] ^= codes[k - 1 :] * np.uint32(0x85EBCA6B)
        feature = ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int64)
        feature[(left < k) | ((codes == 32) if k == 1 else False)] = 1 << BITS
        out.append(feature)
    return out, offsets


def document_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, dict[str, int]]:
    """How many of the rows hold each feature, and at the end the number of rows; and the number of rows of each language.

    One pass over the texts; tasks sum their rows before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        flags = np.zeros((1 << BITS) + 1, np.int64)
        by: dict[str, int] = {}
        for batch in batches:
            texts = texts_of(batch.column(0))
            for k in batch.column(1).to_pylist():
                by[k] = by.get(k, 0) + 1
            for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts))):
                features, offsets = grams(texts[a:b])
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    flags[:] = 0
                    for f in features:
                        flags[f[s:e]] = 1
                    flags[1 << BITS] = 1
                    total += flags
        at = np.flatnonzero(total)
        columns = [[None] * len(at) + list(by), [*at.tolist(), *[-1] * len(by)], [*total[at].tolist(), *by.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "feature", "n"])

    out, by = np.zeros((1 << BITS) + 1, np.int64), {}
    # As many rows as there are features and languages.
    for k, feature, n in docs.select(text, F.col(lang).cast("string")).mapInArrow(tidy(run), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n")).collect():
        if feature < 0:
            by[k] = n
        else:
            out[feature] = n
    return out, by


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        features, offsets = grams(texts)
        table = np.vstack([self.weights * self.idf[:, None], np.zeros((1, len(self.languages)))]).astype(np.float32)
        sums = np.zeros((int(offsets[-1]) + 1, len(self.languages)), np.float32)
        for f in features:
            sums[:-1] += table[f]
        full = np.flatnonzero(np.diff(offsets))
        out = np.repeat(self.bias[None, :].astype(np.float64), len(texts), 0)
        if len(full):
            counts = np.add.reduceat(sum((f < 1 << BITS).astype(np.int64) for f in features), offsets[full])
            out[full] += SCALE * np.add.reduceat(sums[:-1], offsets[full], axis=0, dtype=np.float64) / np.maximum(counts, 1)[:, None]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        names = [self.languages[k] if ok else "und" for k, ok in zip(p.argmax(1), known, strict=True)]
        return names, np.where(known, p.max(1, initial=0), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sparse(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and their TF-IDF values."""
    f = np.concatenate(grams([text])[0])
    at, counts = np.unique(f[f < 1 << BITS], return_counts=True)
    return at, SCALE * counts / max(1, counts.sum()) * idf[at]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: the weights follow from the accumulated gradients z and their squares n by a closed form."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(42)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x = rows[r]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = solved(z[at], n[at])
            p = softmax((x @ w)[None, :])[0]
            p[target[r]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solved(z, n)
    return w[:-1], w[-1]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1000, epochs: int = 3) -> LanguageModel:
    """Learns from all rows' document frequencies and from a sample of about ``per_language`` rows of each language.

    The sample is those of the smallest hashes of ``key`` and text, and never more than twice as many rows as asked for.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
    df, counts = document_counts(rows, text, lang)
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    share = F.coalesce(*(F.when(F.col(lang).cast("string") == k, F.lit(min(1.0, per_language / n))) for k, n in counts.items()))
    drawn = rows.select(F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), share.alias("share"))
    drawn = drawn.withColumn("hash", F.xxhash64("key", "text", F.lit(42))).where(F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    chosen = drawn.orderBy("hash", "key", "lang", "text").limit(2 * per_language * len(languages)).select("key", "lang", "text").collect()
    sample = sorted(chosen, key=lambda r: (str(r[0]), r[1], r[2]))
    vectors, target = [sparse(r[2], idf) for r in sample], np.array([languages.index(r[1]) for r in sample], int)
    held = np.arange(len(sample)) % 5 == 4
    weights, bias = ftrl([v for v, h in zip(vectors, held, strict=True) if not h], target[~held], len(languages), epochs)
    model = LanguageModel(languages, idf, weights, bias)
    if held.any():
        logits = model.logits([r[2] for r, h in zip(sample, held, strict=True) if h])
        grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(logits)), target[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the columns ``made`` (language and score) in place of its text column; other columns as they are.

    Columns that have these names already are replaced.
    """
    kept = [f for f in docs.schema if f.name not in (text, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            names: list[str] = []
            scores: list[float] = []
            for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts))):
                some, p = model.predict(texts[a:b])
                names += some
                scores += p.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in kept), *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{made[0]} string", f"{made[1]} double"])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text)).mapInArrow(tidy(run), schema)


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % mod


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 3) == 1)
    model = fit(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows whose language is known: not ``und``, and with a score of ``least`` or more. The model is fitted on the rows' own ``lang``.

    Null, empty and letterless texts go; repeated rows stay as often as they are there; all columns stay as they are.
    """
    model = fit(docs)
    marked = predict(docs.withColumn("__text", F.col("text")), model, "__text", ("__lang", "__score"))
    return marked.where((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
