"""Importance resampling, vantage-point search and the filter audit against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_words import words as made

from scrubline.llm import filter_audit, importance, vantage

# ---- importance ---------------------------------------------------------------------


def features(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(w), [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute_resample(docs, target, n=1, buckets=10_000, percent=10):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = Counter(bucket(f) for _, t in docs for f in features(t, n)[1])
    t = Counter(bucket(f) for x in target for f in features(x, n)[1])
    size, goal = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (goal + buckets))))

    out = []
    for i, text in docs:
        count, found = features(text, n)
        weight = sum(gain(bucket(f)) for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, count])
    able = sorted((r for r in out if r[0] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_crc_of_spans_equals_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    lengths = np.concatenate([np.arange(1, 200), rng.integers(1, 1500, 50), [63, 64, 65, 127, 128, 129, 192]])
    starts = np.array([rng.integers(0, 5000 - n) for n in lengths])
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]
    assert importance.crc32_spans(data, starts, lengths).tolist() == want
    assert len(importance.crc32_spans(data, starts[:0], lengths[:0])) == 0


@pytest.mark.parametrize("n,block", [(1, 1 << 20), (3, 1 << 20), (1, 50), (3, 50)])
def test_runs_of_whole_texts(monkeypatch, n, block):
    """Blocks cut long texts, never a word or a run."""
    monkeypatch.setattr(importance, "BLOCK", block)
    rng = random.Random(2)
    texts = [made(rng, rng.randint(0, 60)) for _ in range(30)]
    texts += [None, "", "  ", "A-b_C9 \x00é日本 x", "é" * 200, "word" * 100 + " end", "\n".join(["Same LINE here"] * 20)]
    got = [Counter() for _ in texts]
    counts = [0] * len(texts)
    arr = pa.array(["skipped", *texts])[1:]
    for i, _, runs in importance._runs(arr, n, 1 << 31):
        for t, b in zip(runs.text, runs.bucket, strict=True):
            got[i + t][int(b)] += 1
        for t in runs.words:
            counts[i + t] += 1
    for text, found, count in zip(texts, got, counts, strict=True):
        number, want = features(text, n)
        assert count == number
        assert found == Counter(zlib.crc32(f.encode()) % (1 << 31) for f in want)


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_equals_brute_force(spark, n):
    rng = random.Random(3)
    docs = [(i, made(rng, rng.randint(5, 60))) for i in range(150)]
    target = [made(rng, 30) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, weight string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, n)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, target, n)


def test_resampling_edges(spark, edge_docs, no_docs):
    goal = spark.createDataFrame([("ka lo mi",), (None,)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = sorted(map(tuple, importance.resample(edge_docs, goal, percent=50).collect()), key=str)
    # rows 8 are equal: either may have the better rank
    assert got == brute_resample(docs, ["ka lo mi", None], percent=50)
    assert importance.resample(no_docs, goal).collect() == []
    assert len(importance.resample(edge_docs, goal.limit(0)).collect()) == len(docs)


# ---- nearest neighbours -----------------------------------------------------------------


def brute_neighbours(rows, k, step):
    usable = []
    for i, v in {(i, None if v is None else tuple(v)): (i, v) for i, v in rows}.values():
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.append((i, v))
    out = []
    for i, v in usable:
        if i % step == 0:
            near = [(-math.fsum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in usable if j != i or w != v]
            out += [(i, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(sorted((round(s, 12), j) for s, j in near)[:k], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, id string, cell string, v string"


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted((q, r, i, round(s, 9)) for q, r, i, s in vantage.neighbours(df, **kw).collect())


@pytest.fixture
def tiny(monkeypatch):
    """Many cells, shards, chunks and leaves from few rows."""
    for name, value in (("SHARD", 16), ("CHUNK", 4), ("LEAF", 4), ("SAMPLE", 64), ("SAMPLED", 4)):
        monkeypatch.setattr(vantage, name, value)


def test_factor_one_is_exact(spark, tiny):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-4, 4)) for _ in range(5)]) for i in range(200)]
    # a third of all rows hold one vector, some lengths differ much
    rows = [(i, [1.0, 2.0, 0.0, 0.0, 1.0] if i % 3 == 0 else v if i % 7 else [x * 9 for x in v]) for i, v in rows]
    assert found(spark, rows, k=6, query_step=5, factor=1.0) == brute_neighbours(rows, 6, 5)


def test_vectors_that_take_no_part_and_ties(spark, tiny):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, nan]), (80, [inf, 1.0]), (100, [1.0, None]), (120, []),
        (1, [2.0, 0.0]), (2, [2.0, 5.0]), (3, [-1.0]), (4, [2.0, 5.0]), (4, [2.0, 5.0]), (None, [9.0, 9.0]), (0, [1.0, 0.0]), (140, [1.0]),
        (0, [3.0, 1.0]),
    ]
    want = brute_neighbours([(i, v if v is None else [*v, 0.0][:2] if len(v) == 1 else v) for i, v in rows], 20, 20)
    got = found(spark, rows, factor=1.0)
    # an id with two vectors is two queries; the other vector is a candidate under the same id
    own = lambda xs: [x for x in xs if x[0] != 0]
    assert own(got) == own(want)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == [] and found(spark, [(1, None)]) == []
    assert found(spark, [(20, [1.0]), (7, [2.0])]) == [(20, 1, 7, 2.0)]


def test_relaxed_search_keeps_nine_of_ten(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", 512)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    x[1000:] += 3 * x[rng.integers(0, 20, 2000)]
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vantage.neighbours(df).collect()
    hits = Counter()
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        hits["all"] += 20
        hits["found"] += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 3000 and hits["found"] >= 0.9 * hits["all"]
    assert all(abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9 for r in got[:200])


def test_search_skips_subtrees_of_clustered_vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 8
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    search = vantage.Search(x, np.arange(4000), x[:50], np.full(50, -np.inf), 20, 1.0 + 1e-9, 1.0)
    assert search.visited < 0.5 * 50 * 4000


# ---- filter audit ---------------------------------------------------------------------


def test_weights_are_the_shapley_value():
    for n in (1, 2, 3, 5):
        rng = random.Random(n)
        value = [0] + [rng.randint(0, 99) for _ in range(2**n - 1)]
        for i, row in enumerate(filter_audit.shapley_weights(n)):
            want = 0
            for order in itertools.permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                want += value[before | 1 << i] - value[before]
            assert sum(a * b for a, b in zip(row, value, strict=True)) == want
    with pytest.raises(ValueError):
        filter_audit.shapley_weights(9)


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = {}
    for k, (i, text, source) in enumerate(docs):
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = "A" if len(w) < 50 else ""
        f += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else ""
        f += "D" if re.search("[#$%&*|]", t) else ""
        f += "E" if i is not None and least[t] < i else ""
        fails[k] = (source or "", f, i in good, i in bad)
    out = []
    for part in {p for p, *_ in fails.values()}:
        mine = [x[1:] for x in fails.values() if x[0] == part]
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] for x in mine) - len(gone)
                alone = sum(x[0] == f for x in mine)
                steps.append([part, "".join(order), step, len(left), len(gone), redundant, alone, sum(x[1] for x in gone), sum(x[2] for x in gone)])
        total = Counter()
        for s in steps:
            total[s[1][s[2] - 1]] += s[4]
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit_equals_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(8)
    docs = []
    for i in range(300):
        text = made(rng, rng.choice([10, 49, 50, 60, 200]))
        text = rng.choice([text, text, text.upper(), text + " # a|b", "copied " * 60, "", None])
        docs.append((rng.choice([i, i, i, i - 1, None]), text, rng.choice(["a", "a", "b", None, ""])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 300, 2), *range(0, 300, 5)]] + [(None, 1, 1)]
    names = "doc_id long, text string, source string, part string, n string, failed string"
    df = spark.createDataFrame([(*d, "x", "x", "x") for d in docs], names).repartition(5)
    marks = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(df, marks)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in edge_docs.collect()]
    assert sorted(map(tuple, filter_audit.audit(edge_docs, marks.limit(0)).collect())) == brute_audit(rows, [])
    assert filter_audit.audit(no_docs, marks).collect() == []
