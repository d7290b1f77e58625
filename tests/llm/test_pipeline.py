"""The corpus pipeline from end to end, against plain Python."""

import collections
import random

import corpus_pipeline
from tests.llm.test_operators import brute_passages, brute_simhash
from touchline.llm import common, langid, mixing, packing

import numpy as np


def test_run_against_plain_python(spark, tmp_path):
    rnd = random.Random(11)
    words = {k: [a + b for a in first for b in last] for k, first, last in (("en", ["th", "wh", "st"], ["e", "ing", "ough"]), ("de", ["sch", "gr", "ei"], ["en", "ung", "acht"]))}
    text = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    passage = {k: text(k, 55) for k in words}
    rows = []
    for i in range(80):
        k = "en" if i % 2 else "de"
        rows.append((i, text(k, 40) + " " + (passage[k] + " " if i % 4 < 2 else "") + text(k, 30 + i % 9), k, f"s{i % 3}" if i % 5 else None))
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1], None, "s1"), (102, None, "en", "s1"), (103, "123 !", "en", "s1"), (104, "", None, "s2")]
    docs = [(i, t, k, s, len(t or "")) for i, t, k, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # Language ID: what has no letter goes; the languages here can't be taken for each other.
    kept = [(i, t, s) for i, t, k, s in rows if t and any(map(str.isalpha, t))]
    marks = [brute_simhash(t) for _, t, _ in kept]
    parent = np.arange(len(kept))
    pairs = [(a, b) for a in range(len(kept)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 4]
    common.union(parent, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    kept = [kept[i] for i in sorted(set(parent.tolist()))]  # ids ascend, so a group's first row has its smallest
    texts = list(brute_passages([t for _, t, _ in kept], 50))
    assert 0 < sum(a != t for a, (_, t, _) in zip(texts, kept, strict=True)) < len(kept)

    sizes = collections.defaultdict(list)
    for (i, _, s), t in zip(kept, texts, strict=True):
        sizes[s].append((i, len(t.split()), t))
    sources = sorted(sizes, key=lambda s: (s is None, s))
    goal = mixing.targets([sum(n for _, n, _ in sizes[s]) for s in sources], [1 + k % 3 for k in range(len(sources))])
    encoder = packing.WordEncoder(packing.default_tokenizer())
    tokens = {i: len(encoder.encode([t.encode()])[0]) // 4 + 1 for s in sources for i, _, t in sizes[s]}
    taken = collections.Counter()
    for r in got:
        assert r.doc_tokens == tokens[r.doc_id] and r.start == 0 and r.length == tokens[r.doc_id]
        taken[r.doc_id] += 1
    for s, target in zip(sources, goal, strict=True):
        # Each source's words come as near its target as whole documents allow, here to within its shortest one.
        mix = sum(taken[i] * n for i, n, _ in sizes[s])
        assert abs(mix - target) <= min(n for _, n, _ in sizes[s]) and all(taken[i] <= 3 for i, _, _ in sizes[s])
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.BITS
