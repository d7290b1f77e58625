"""The corpus operators against brute force, and on awkward tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import chat, common, fingerprints, langid, mixing, packing, pages, simhash, suffixes, toxicity, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "key string, raw string, size long, draw long, `range` int, copies long, score string, simhash string, times int, spans string, kept string, part int"


def awkward(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    some = [(1, "the cat sat on the mat and so on", "en", "a"), (1, "the cat sat on the mat and so on", "en", "a"), (None, "le chat est sur la table", "fr", None), (3, None, "en", "b"), (4, "", None, "b"), (5, "123 !!", "en", ""), (6, long, "en", "a"), (7, long + " x", None, "a"), (8, "été \U0001f600 x", "fr", "a"), (9, "déjà vu " * 60, "fr", "b"), (10, "déjà vu " * 60, "fr", "b")]
    rows = [(a, b, c, d, len(b or "")) for a, b, c, d in some]
    return spark.createDataFrame(rows, DOC).selectExpr("*", *(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.strip().rsplit(" ", 1) for x in EXTRA.split(","))))


def empty(spark):
    return spark.createDataFrame([], DOC)


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        yield len(t), int(gone.sum()), len(runs) // 2, np.frombuffer(t, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize(("length", "gram", "crowd", "salt_after"), [(64, 16, 20_000, 16), (40, 32, 20_000, 0), (64, 16, 3, 16), (64, 16, 3, 0), (64, 16, 20_000, 0)])
def test_suffixes_against_brute_force(spark, length, gram, crowd, salt_after):
    rnd = random.Random(1)
    text = lambda n: bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
    shared = [text(rnd.randint(20, 300)) for _ in range(6)]
    texts = [text(rnd.randint(0, 150)) + b"".join(rnd.choice(shared)[rnd.randint(0, 60) :] + text(rnd.randint(0, 50)) for _ in range(rnd.randint(0, 3))) for _ in range(40)]
    texts += [b"a" * 90, b"a" * 64, b"ab" * 80, b"", texts[3], b"abc" * 30, *[texts[5] + shared[0]] * 9]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffixes.strip_repeats(df, "text", length, gram, crowd, salt_after=salt_after).select("n_bytes", suffixes.removed(F.col("spans")), F.size("spans"), "kept", "doc_id").orderBy("doc_id").collect()
    assert [(r[0], r[1], r[2], bytes(r[3])) for r in got] == list(brute_repeats(texts, length))


def test_salts_leave_two_places():
    salter, keys = suffixes.Salter(0), pytest.importorskip("pyarrow").array([b"a" * 16, b"b" * 16, b"c" * 16])
    grams = np.array([7, 7, 7, 7, 7, 9, 9])
    got = salter.salts(grams, keys, np.array([0, 0, 1, 2, 0, 0, 1]), np.zeros(7, np.int64))
    assert (got > 0).tolist() == [False, False, False, True, False, False, False]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_bwt_streams(block):
    rnd = random.Random(block)
    texts = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 30))] for _ in range(25)]
    texts += texts[:4] + [[1] * 40, [1] * 33]
    rounds = max(map(len, texts))
    alive = [np.array([d for d, t in enumerate(texts) if len(t) > j]) for j in range(rounds)]
    columns = [np.array([texts[d][len(texts[d]) - 1 - j] for d in alive[j]]) for j in range(rounds)]
    names, common = suffixes.build(columns, alive, block)
    assert sorted(names[: len(texts)]) == list(range(-len(texts), 0))
    found = [tuple(texts[n % len(texts)][-1 - n // len(texts) :]) for n in names[len(texts) :].tolist()]
    assert found == sorted(found) and len(found) == sum(map(len, texts))
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common[len(texts) + 1 :].tolist() == [shared(a, b) for a, b in zip(found, found[1:])]


def test_long_windows(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = text(3000)
    df = spark.createDataFrame([(1, f"{text(50)}1{shared}2{text(9)}"), (2, f"3{shared}4{text(70)}"), (3, text(4000))], "doc_id long, text string")
    for length in (2048, 2056, 2400):
        assert {r.doc_id: r.n for r in suffixes.strip_repeats(df, length=length).select("doc_id", suffixes.removed(F.col("spans")).alias("n")).collect()} == {1: 3000, 2: 3000, 3: 0}


def brute_passages(texts, length):
    """Each text without the words of passages that start elsewhere too, and the white space after them."""
    words = [t.split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    for t, w in zip(texts, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        if not any(gone):
            yield t
            continue
        places = [m.start() for m in suffixes.WORD.finditer(t)] + [len(t)]
        yield t[: places[0]] + "".join(t[places[k] : places[k + 1]] for k in range(len(w)) if not gone[k])


@pytest.mark.parametrize(("length", "gram", "crowd", "salt_after"), [(12, 4, 20_000, 16), (9, 8, 20_000, 0), (12, 4, 3, 16), (20, 4, 3, 0)])
def test_passages_against_brute_force(spark, length, gram, crowd, salt_after):
    rnd = random.Random(length)
    words = lambda n: " ".join(rnd.choice(["de", "la", "Été", "b", "c,", "d\n", "\U0001f600"]) + rnd.choice(["", "x", "yy"]) for _ in range(n))
    shared = [words(rnd.randint(8, 60)) for _ in range(5)]
    texts = ["  " + words(rnd.randint(0, 20)) + "\n" + "  ".join(rnd.choice(shared) + " " + words(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 3))) for _ in range(40)]
    texts += [" ".join(["same"] * 70), "", "few words", "few words", *[texts[3]] * 3, texts[4].replace(" ", "  "), *[shared[0]] * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans_ = {r["__key"]: r.spans for r in suffixes.passages(df, "text", length, gram, crowd, salt_after).collect()}
    got = [suffixes.without_words(t, [(s.start, s.stop) for s in spans_.get(hashlib.sha256(t.encode()).digest()[:16], [])]) for t in texts]
    assert got == list(brute_passages(texts, length))


@pytest.mark.parametrize("values", [4_000_000, 0])
def test_repeated_passages_go(spark, monkeypatch, values):
    """By broadcast and by shuffle: passages of 50 words go whole, shorter ones stay, and other columns are as they were."""
    plain = suffixes.bounded
    monkeypatch.setattr(suffixes, "bounded", lambda df, weight=None: plain(df, values, weight))
    rnd = random.Random(9)
    words = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    long_, short, copy = words(50), words(49), words(60)
    rows = [(i, f"{words(30)} {long_ if i % 2 else short} {words(5)}", "en", None, 0) for i in range(12)] + [(None, copy, None, "s", 7)] * 2 + [(50, None, "en", "s", None), (51, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("spans", F.lit("x")).withColumn("__new", F.col("doc_id"))
    got = sorted(map(tuple, suffixes.without_repeats(docs).collect()), key=str)
    cut = lambda t: t.replace(long_ + " ", "")
    want = [(i, cut(t), lang, s, len(cut(t)), "x", i) if t and long_ in t else (i, "", lang, s, 0, "x", i) if t == copy else (i, t, lang, s, n, "x", i) for i, t, lang, s, n in rows]
    assert got == sorted(want, key=str)


def brute_simhash(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(rnd.randint(0, 40))) for _ in range(30)]
    texts = base + [b + " zz" for b in base] + base[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(df).orderBy("doc_id").collect()
    marks = [brute_simhash(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{m:016x}" for m in marks]
    parent = np.arange(len(texts))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4]
    common.union(parent, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert [r.component_id for r in got] == parent.tolist()


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    a[50:] = a[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    want = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    got = np.zeros_like(want)
    for i, j in simhash.within(a, a, radius):
        got[i, j] = True
    assert (got == want).all()


@pytest.mark.parametrize("few", [0, 20_000])
def test_simhash_splits_crowded_keys(spark, few):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 20, 300), rng.integers(0, 1 << 62, 100)]))
    found = simhash.links(spark.createDataFrame([(int(v),) for v in values], "simhash long"), 4, 40)
    roots = {r.node: r.root for r in common.components(found, few=few).collect()}
    parent = np.arange(len(values))
    for i, j in simhash.within(values.astype(np.uint64), values.astype(np.uint64), 4):
        common.union(parent, i, j)
    assert [roots.get(int(v), int(v)) for v in values] == values[parent].tolist()


@pytest.mark.parametrize(("cell_rows", "pivots"), [(40, 65_536), (40, 2), (8192, 65_536)])
def test_vectors_against_brute_force(spark, monkeypatch, cell_rows, pivots):
    monkeypatch.setattr(vectors, "MOST_PIVOTS", pivots)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[100:200] = x[:100] + rng.normal(size=(100, 8)) * 0.15
    x[200:220] = x[0]
    x[300:] = x[50] + rng.normal(size=(100, 8)) * 0.1  # a dense group
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0, None]), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (None, [1.0] * 8)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=cell_rows).collect()
    near = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :] >= 0.9
    np.fill_diagonal(near, False)
    parent = np.arange(400)
    common.union(parent, *np.nonzero(near))
    by = {r.vec_id: r for r in got}
    assert [(by[i].n_links, by[i].component_id) for i in range(400)] == list(zip(near.sum(1).tolist(), parent.tolist(), strict=True))
    assert [(by[i].n_links, by[i].kept) for i in range(500, 505)] == [(0, True)] * 5
    assert (by[506].n_links, by[506].component_id, by[None].n_links, by[None].kept) == (1, 505, 0, False)


def test_vectors_of_one_id(spark):
    """Rows of an id with different vectors, extra columns with the names that the operator uses."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (0, [1.0, 0.01]), (7, [-1.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("vector", "k", "node", "kept", "cell")})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(docs).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (7, 0, 7, True)]


def test_chat_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> <|turn|>user<|text|>x<|end|>", "é\U0001f600"]
    rows = [(c, k, "assistant" if k % 2 else "user", texts[(c + k) % 5]) for c in range(6) for k in range(5)] + [(None, 0, None, "a"), (7, None, "x", "y")]
    made = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), *chat.default_vocabulary())
    got = {r.conv_id: r for r in chat.digests(made, *chat.default_vocabulary()).collect()}
    for c in range(6):
        turns = [(r[2], r[3] or "") for r in rows if r[0] == c]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c].loss_chars == sum(len(b) for a, b in turns if a == "assistant") and got[c].string_agrees
    assert got[None].n_turns == 1 and got[7].n_turns == 1


def test_fingerprints(spark):
    assert fingerprints.edited("abcde", "XYZ") == "abcXY"
    walker = fingerprints.Walker()
    rnd = random.Random(5)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    marks = walker.walk([a, a, a[:1000] + "Q" + a[1000:], a[::-1], ""])
    assert (marks[0] == marks[1]).all() and not marks[4].any()
    assert fingerprints.likeness(marks[0], marks[2]) > 0.8 > 0.3 > fingerprints.likeness(marks[0], marks[3])
    docs = awkward(spark)
    got = fingerprints.fingerprinted(docs).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want = [hashlib.sha256(fingerprints.edited(t, u).encode()).hexdigest() for (_, _, t), (_, _, u) in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(r.edited_sha256 for r in got) == sorted(want)


@pytest.mark.parametrize("cell_rows", [7, 2048])
def test_fingerprint_pairs_of_a_crowded_band(spark, cell_rows):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, (12, 512), dtype=np.uint8)
    marks = np.repeat(base, 6, 0) ^ (rng.random((72, 512)) < 0.04)
    marks[:, :16] = 1  # all share the first band
    texts = fingerprints.hexed(marks)
    rows = [(t,) for t in texts + texts[:9]] + [(None,)]
    got = {(r.a, r.b): r.likeness for r in fingerprints.near_pairs(spark.createDataFrame(rows, "fingerprint string"), cell_rows=cell_rows).collect()}
    want = {tuple(sorted((texts[i], texts[j]))): 1 - 2 * (marks[i] != marks[j]).mean() for i in range(72) for j in range(i)}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.8} and len(got) > 50
    assert fingerprints.near_pairs(spark.createDataFrame([], "fingerprint string")).count() == 0


def test_packing(spark):
    docs = awkward(spark)
    tokenizer = packing.default_tokenizer()
    got = packing.packed(docs, tokenizer, window=256, grid=4).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    ids = {r.doc_id: np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in got) == sum(len(ids[r.doc_id]) for r in docs.collect())


def test_plan_uses_each_class_exactly():
    counts = np.random.default_rng(1).integers(0, 50, 65)
    counts[0] = 0
    used = np.zeros(65, int)
    for pattern, n in packing.plan(counts):
        assert sum(pattern) <= 64 and n > 0
        np.add.at(used, list(pattern), n)
    assert (used == counts).all()


def test_mixing():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert sum(mixing.targets([100, 1, 0], [1, 2, 3])) == pytest.approx(101)
    take = mixing.closest(np.array([7, 5, 3]), np.array([2, 1, 4]), 20)
    assert (take * [7, 5, 3]).sum() == 20 and (take <= [2, 1, 4]).all()


def test_mixing_whole(spark):
    rows = mixing.mix(awkward(spark)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert len(rows) == 11
    for mine in by.values():
        sizes, target = [r.size for r in mine], mine[0].target
        whole = int(target // max(1, sum(sizes)))
        # No set of documents taken once more comes nearer from below.
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums}
        best = whole * sum(sizes) + max(x for x in sums if x <= max(0, round(target - whole * sum(sizes))))
        assert sum(r.taken for r in mine) == best and all(r.taken <= 3 * r.size for r in mine)


def test_mixing_of_equal_rows(spark, monkeypatch):
    """Sources of one row, all equal, and of rows without an id come near their targets too; reruns agree."""
    rows = [(1, "one two three four", "a")] * 100 + [(None, f"w{i % 7} x y z", "b") for i in range(100)] + [(None, None, "b"), (2, "", None)] + [(i, "a b c d", "c") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for equals in (100_000, 3):
        monkeypatch.setattr(mixing, "EQUALS", equals)
        got = mixing.mix(docs).collect()
        goal = mixing.targets([400, 400, 400, 0], [1, 2, 3, 1])
        for source, want in zip(["a", "b", "c"], goal):
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - want) <= 4 and {r.target for r in mine} == {want} and {r.source_size for r in mine} == {400}
        assert len(got) == len(rows) and all(r.taken <= 3 * r.size and r.taken == r.size * r.times for r in got)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect())) or equals == 3
        whole = mixing.mixed(docs.withColumns({c: F.lit("z") for c in ("size", "draw", "times", "row", "named")}))
        assert whole.columns == [*docs.columns, "size", "draw", "times", "row", "named"]
        if equals > 3:
            want = times_of(rows, got)
            assert {k: n for k, n in collections.Counter((r.doc_id, r.text, r.source) for r in whole.collect()).items() if k in want} == {k: n for k, n in want.items() if n}


def times_of(rows, got):
    """How often each row is taken: a mix tells doc_id and size, and here a source's rows differ in their texts alone."""
    out = collections.Counter()
    texts = collections.defaultdict(collections.Counter)
    for d, t, s in rows:
        texts[s, d][t] += 1
    for (s, d), found in texts.items():
        if len(found) == 1:
            out[d, next(iter(found)), s] += sum(r.times for r in got if (r.source, r.doc_id) == (s, d))
    return out


def test_language_model(spark):
    rows = [(i, t * 3, k) for i, (t, k) in enumerate([("the cat and the dog were here with them ", "en"), ("der hund und die katze sind nicht hier ", "de")] * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, scores = model.predict(["the dog and the cat", "die katze und der hund", "", "123 ...", "\u00b2 \u00bd \u2167 _", "\u2e80\u20ac"])
    assert names == ["en", "de", "und", "und", "und", "und"] and scores[2] == 0 and (scores <= 1).all()
    held = [("the cats with the dogs are here", "en"), ("der hund ist mit der katze hier", "de")] * 20
    assert model.predict([t for t, _ in held])[0] == [k for _, k in held]
    # Many rows of one id are no larger a sample, and a column with the model's name keeps its values.
    many = spark.createDataFrame([(7, r[1], r[2], "mine", "x") for r in rows * 3], "doc_id long, text string, lang string, score string, lang_pred string")
    assert langid.fit(many, per_language=10).languages == ["de", "en"]
    kept = langid.keep_known(many)
    assert kept.schema == many.schema and {(r.score, r.lang_pred) for r in kept.collect()} == {("mine", "x")} and kept.count() == 240


def test_language_counts_against_brute_force(spark):
    texts = [("ab ba", "x"), ("ab", "x"), ("b1b", "y")]
    found, by = langid.document_counts(spark.createDataFrame(texts * 5, "text string, lang string"))
    want = np.zeros((1 << langid.BITS) + 1, int)
    for t, _ in texts:
        want[list({int(f) for g in langid.grams([t])[0] for f in g if f < 1 << langid.BITS})] += 5
    want[-1] = 15
    assert (found == want).all() and by == {"x": 10, "y": 5}


def test_toxicity(spark):
    rnd = random.Random(4)
    clean = [" ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(30)) for _ in range(200)]
    rows = [(i, t + " awful vile" if i % 4 == 0 else t, int(i % 4 == 0)) for i, t in enumerate(clean)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    score, spans = model.scores(["ab cd awful vile ef", "ab cd", ""])
    assert score[0] > 0.5 > score[1] and spans == [[(6, 16)], [], []]
    gain, t = np.array([0.5, 2.0, 0.3]), np.array([[1.0, 0.5], [0.4, 2.0]])
    weight = lambda s: np.prod([gain[i] ** s[i] for i in range(3)]) * t[s[0], s[1]] * t[s[1], s[2]]
    states = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    want = [sum(weight(s) for s in states if s[i]) / sum(map(weight, states)) for i in range(3)]
    assert toxicity.forward_backward(gain, np.array([3]), t)[2] == pytest.approx(want)


def test_toxic_offsets_where_lower_case_is_longer():
    model = toxicity.ToxicityModel({"awful": 0, "i\u0307vile": 1}, np.array([12.0, 12.0, -6.0]), np.zeros((2, 2)))
    texts = ["\u0130 ab AWFUL ef", "ab \u0130VILE awful", "ab AWFUL ef"]
    assert model.scores(texts)[1] == [[(5, 10)], [(3, 14)], [(3, 8)]]


PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div id='cookie-notice'>We use cookies</div>{0}<article><h1>Head &amp; tail</h1><p>One <b>two<br>three</p><p>{1}<div class=comments><p>First!</p></div></article><div class=x>Site words</div><footer>F</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format("<form>Q<input></form>", f"Text {i}")) for i in range(8)] + [(8, None, None), (9, "x", ""), (10, "http://h.example/x", "plain <3 text")]
    rows += [(20 + i, f"http://g.example/{i}", f"<body><div class=x>Always the same</div><p>Story number {i} is long enough to be the main thing.</p></body>") for i in range(8)]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"Head & tail\nOne two three\nText {i}" for i in range(8)]
    assert (got[8], got[9], got[10]) == ("", "", "plain <3 text")
    assert got[21] == "Story number 1 is long enough to be the main thing."


KIND = "page_id long, url string, html string"
NOTICE = "A notice of the whole host that is much longer than any of its stories and has no name at all."


def texts_of(spark, bodies, **kwargs):
    rows = [(i, f"http://{site}/{i}", f"<body>{body}</body>") for i, (site, body) in enumerate(bodies)]
    return [r.text for r in pages.extracted(spark.createDataFrame(rows, KIND), **kwargs).orderBy("page_id").collect()]


@pytest.mark.parametrize("blocks", [1_000_000, 0])
def test_pages_tree_before_names(spark, blocks):
    wraps = ["<div class='content has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div class='article legal'>{}</div>", "<div class='entry form-post'>{}</div>", "<div class='legal-pages'><article>{}</article></div>", "<form>{}</form>"]
    inner = "<p>Story {} of one page.</p><div class='sidebar'>Aside {}</div>"
    for few in (1, 8):
        bodies = [(f"w{k}.example", w.format(inner.format(i, i))) for k, w in enumerate(wraps) for i in range(few)]
        assert texts_of(spark, bodies, broadcast_blocks=blocks) == [f"Story {i} of one page." for _ in wraps for i in range(few)]


@pytest.mark.parametrize("blocks", [1_000_000, 0])
def test_pages_noise_by_importance_alone(spark, blocks):
    story = "<section><p>Story number {} is told on this page alone.</p></section>"
    n = 60
    turned = [("a.example", f"<div class=x>Variant {'ABC'[i % 3]}</div>" + story.format(i)) for i in range(n)]
    partly = [("b.example", ("<div class=x>Of a section</div>" if i % 5 < 2 else "") + story.format(i)) for i in range(n)]
    longer = [("c.example", f"<div class=x>{NOTICE}</div><p>Story {i}</p>") for i in range(n)]
    rare = [("d.example", f"<div class=x>{'Always' if i > 3 else f'Seldom {i // 2}'}</div>" + story.format(i)) for i in range(n)]
    want = [f"Story number {i} is told on this page alone." for i in range(n)]
    assert texts_of(spark, turned + partly + longer + rare, broadcast_blocks=blocks) == want * 2 + [f"Story {i}" for i in range(n)] + want
    copies = [("e.example", f"<p>{NOTICE}</p><p>It is a story here.</p>")] * 9 + [("e.example", f"<p>Other {i}</p>") for i in range(9)]
    assert texts_of(spark, copies, broadcast_blocks=blocks) == [f"{NOTICE}\nIt is a story here."] * 9 + [f"Other {i}" for i in range(9)]


def test_keep_one_of_each_component(spark):
    words = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(1, words[0], "x"), (1, words[1], "x"), (2, words[1], "x"), (0, words[1], "y"), (None, words[0], "x"), (None, words[2], "x"), (None, words[2], "x"), (None, words[2], "x"), (5, words[3], "b"), (5, words[3], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = {(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()}
    assert near == {(1, words[0]), (0, words[1]), (None, words[2]), (5, words[3])}
    want = sorted(map(str, simhash.keep_one(docs).collect()))
    assert len(want) == 4 and sorted(map(str, simhash.keep_one(docs.repartition(3).orderBy(F.desc("source"))).collect())) == want


STAGES = [langid.keep_known, simhash.keep_one, suffixes.without_repeats, mixing.mixed]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns(spark, stage):
    docs = awkward(spark)
    out = stage(docs)
    assert out.columns == docs.columns and out.count() <= 3 * docs.count()
    nothing = stage(empty(spark))
    assert nothing.columns == empty(spark).columns and nothing.count() == 0


def test_empty_tables(spark):
    docs = empty(spark)
    assert packing.packed(docs, packing.default_tokenizer()).count() == 0
    assert fingerprints.fingerprinted(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), *chat.default_vocabulary()).count() == 0
    model = toxicity.fit(docs.withColumn("label", F.lit(1)))
    assert toxicity.scored(docs.select("doc_id", "text"), model).count() == 0
    assert langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).count() == 0


def test_awkward_scores(spark):
    docs = awkward(spark)
    model = toxicity.fit(docs.withColumn("label", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int")))
    assert toxicity.scored(docs, model).count() == 11
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[3].lang_pred == "und" and got[5].lang_pred == "und" and got[6].lang_pred == "en"
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert near[10] == 9 and near[4] == 3 and near[7] == 6


@pytest.mark.parametrize("few", [0, 20_000])
def test_components_of_a_long_chain(spark, few):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in common.components(edges, few=few).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    named = edges.select(*(F.struct(F.col(c).isNull().alias("unnamed"), F.when(F.col(c) != 4, F.col(c)).alias("id"), F.lit("x").alias("more")).alias(c) for c in ("u", "v")))
    got = {r.node.id: (r.root.unnamed, r.root.id) for r in common.components(named.where("NOT u.unnamed"), few=few).collect()}
    assert got == {None if i == 4 else i: (False, None) for i in range(61)} | {100: (False, 100), 101: (False, 100)}
    assert common.components(edges.limit(0), few=few).count() == 0


def test_vectors_same_as_sql(spark):
    import duckdb

    from touchline.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    names = ["vec_id", "n_links", "component_id", "kept"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op9_embeddings']}) ORDER BY vec_id").fetchall()
    assert [tuple(r) for r in vectors.op9_embeddings(spark, "/root/testdata/sf0.001").select(names).orderBy("vec_id").collect()] == want
