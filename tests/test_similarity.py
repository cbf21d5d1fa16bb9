"""Similarity operators against brute force."""

import random
import re
from collections import Counter

import pytest

from scrubline.operators import similarity as s


def mutate(rnd, text):
    chars = list(text)
    for _ in range(rnd.randint(0, 3)):
        i = rnd.randrange(len(chars) + 1)
        if rnd.random() < 0.5 and chars:
            chars.pop(min(i, len(chars) - 1))
        else:
            chars.insert(i, rnd.choice("abcde "))
    return "".join(chars)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_groups(rows, threshold):
    gone, out = set(), []
    for i, (leader, a) in enumerate(rows):
        if leader in gone:
            continue
        for member, b in rows[i + 1 :]:
            if member not in gone and s.ratio(a, b) >= threshold:
                gone.add(member)
                out.append((leader, member, s.ratio(a, b)))
    return sorted(out)


def texts(seed, n, length=40, alphabet="abcdefgh "):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, length))) for _ in range(n // 5)]
    return [(i, mutate(rnd, rnd.choice(base))) for i in range(n)]


def test_ratio():
    assert s.ratio("Elect.", "Electronics") == 59
    assert s.ratio("USA", "US") == 80
    assert s.ratio("", "") == 100 and s.ratio("a", "") == 0


def test_lcs_matches_dynamic_programming():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        assert s.lcs_length(a, b) == brute_lcs(a, b)


@pytest.mark.parametrize("threshold", [80, 90])
def test_no_similar_pair_lacks_a_common_block(threshold):
    rows = [t for _, t in texts(3, 400)] + ["a", "ab", "abc", "US", "USA"]
    blocker = s.Blocker(threshold, Counter(t[:2] for t in rows))
    keys = [{k for k, _, _ in blocker.keys(t)} for t in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            if a and rows[j] and s.ratio(a, rows[j]) >= threshold:
                assert keys[i] & keys[j], (a, rows[j])


@pytest.mark.parametrize("threshold,first,growth,edges", [(90, 2048, 8, 200_000), (80, 10, 2, 200_000), (90, 8, 4, 0)])
def test_groups_equal_the_greedy_loop(spark, monkeypatch, threshold, first, growth, edges):
    """With tiny batches, split blocks and without the pass on the driver the answer must not change."""
    monkeypatch.setattr(s, "FIRST_BATCH", first)
    monkeypatch.setattr(s, "GROWTH", growth)
    monkeypatch.setattr(s, "DRIVER_EDGES", edges)
    monkeypatch.setattr(s, "BLOCK_ROWS", 4096 if first > 100 else 3)
    rows = texts(1, 60 if first < 100 else 300, 25)
    got = s.fuzzy_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", threshold=threshold)
    assert sorted(map(tuple, got.collect())) == brute_groups(rows, threshold)


def test_a_hot_text_and_a_dense_cluster(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"Customer#{i:09d}") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, t string")
    assert sorted(map(tuple, s.fuzzy_duplicate_groups(df, "id").collect())) == brute_groups(rows, 90)
    kept = {r["id"] for r in s.RemoveFuzzyDuplicates("id").run(df).collect()}
    assert kept == {i for i, _ in rows} - {m for _, m, _ in brute_groups(rows, 90)}


def test_long_texts_are_compared_whole(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(1500))
    tail = long[:1200] + "".join(rnd.choice("qrstuvwxyz") for _ in range(400))
    rows = [(0, long), (1, long + "!"), (2, tail), (3, tail + "?")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert sorted(map(tuple, s.fuzzy_duplicate_groups(df, "id").collect())) == brute_groups(rows, 90)


def brute_mapping(values, threshold):
    def norm(v):
        return " ".join(sorted(re.sub(r"[^\w]+", " ", v.lower()).split()))

    counts = Counter(v.strip() for v in values)
    order = sorted(counts, key=lambda v: (-counts[v], v))
    mapped = {}
    for v in order:
        free = [x for x in order if x not in mapped and counts[x] >= counts[v] and x != v and norm(x)]
        if free and norm(v):
            best = max(free, key=lambda x: s.ratio(norm(v), norm(x)))
            if s.ratio(norm(v), norm(best)) >= threshold:
                mapped[v] = best
    return sorted(mapped.items())


def test_category_mapping(spark):
    rnd = random.Random(4)
    kinds = ["electronics", "Electronics", "ELECTRONICS", "Elect.", "home decor", "decor, home", "toys", "toy", "US", "USA"]
    values = [mutate(rnd, rnd.choice(kinds)) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = sorted((r["raw"], r["canonical"]) for r in s.category_mapping(df, "c").collect())
    assert got == brute_mapping(values, 80)


def test_auto_standardize(spark):
    df = spark.createDataFrame([("US",), ("US",), ("USA",), ("DE",), (None,)], "c string")
    out = sorted(str(r["c"]) for r in s.AutoStandardize("c").run(df).collect())
    assert out == ["DE", "None", "US", "US", "US"]


def test_few_texts_against_one_at_once():
    rng = random.Random(11)
    for letters, longest in (("ab", 12), ("abcde日é", 40), ("abc ", 150)):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(40)]
        texts = list(dict.fromkeys(texts + [x[: len(x) // 2] + "x" + x[len(x) // 2 + 1 :] for x in texts]))
        firsts = s.Firsts(range(len(texts)), texts, 80)
        for b, x in enumerate(texts):
            want = [(a, s.ratio(texts[a], x)) for a in range(b) if s.ratio(texts[a], x) >= 80]
            assert firsts.similar(b, x, False) == want and firsts.similar(b, x, True) == want[:1]


def test_a_crowd_is_settled_without_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "_blocks", lambda *_: pytest.fail("blocks of a crowd"))
    texts = [f"Customer#{i * 7919 % 100_000:09d}" for i in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = {r["member_id"]: (r["leader_id"], r["similarity"]) for r in s.fuzzy_duplicate_groups(df, "id", threshold=90).collect()}
    leaders, want = [], {}
    for b, x in enumerate(texts):
        near = next((a for a in leaders if s.ratio(texts[a], x) >= 90), None)
        if near is None:
            leaders.append(b)
        else:
            want[b] = (near, s.ratio(texts[near], x))
    assert got == want


def greedy(rows, threshold):
    """{id: (leader, similarity)} of the greedy loop over ids, each with one text or several."""
    texts = {}
    for i, x in sorted(rows):
        texts.setdefault(i, []).append(x)
    fate = {}
    for a in texts:
        if a not in fate:
            fate[a] = (a, 100)
            for b in texts:
                near = [s.ratio(x, y) for x in texts[a] for y in texts[b] if s.ratio(x, y) >= threshold]
                if near and b not in fate:
                    fate[b] = (a, near[0])
    return fate


@pytest.mark.parametrize("letters,longest,ends", [("0123456789", 7, ("Customer#00", " BUILDING")), ("ab日😀", 40, ("", "")), ("abc ", 150, ("x" * 70, "")), ("abcdefgh", 300, ("", "yz"))])
def test_settling_equals_the_greedy_loop(monkeypatch, letters, longest, ends):
    """In bunches of any size, with masks kept or made anew, and as far as it goes if it ends early."""
    rnd = random.Random(longest)
    cut = [x for _, x in texts(longest, 120, longest, letters)]
    rows = [f"{ends[0]}{x}{ends[1]}" if rnd.random() < 0.9 else x for x in dict.fromkeys(cut)]
    rows = list(zip(rnd.sample(range(1000), len(set(rows))), dict.fromkeys(rows), strict=True))
    want = greedy(rows, 90)
    for bunch, masks, most in ((4, 0, 4096), (16, 1000, 5), (4096, 10**7, 4096)):
        monkeypatch.setattr(s, "BUNCH_TEXTS", bunch)
        monkeypatch.setattr(s, "MASK_BYTES", masks)
        leader, similarity = s.settle(*zip(*rows, strict=True), 90, most)
        first = sorted(a for a, (b, _) in want.items() if a == b)[:most]
        got = {i: (a, n) for (i, _), a, n in zip(rows, leader.tolist(), similarity.tolist(), strict=True) if n >= 0}
        assert got == {i: f for i, f in want.items() if f[0] in first}
        few = first[:7], [dict(rows)[a] for a in first[:7]]
        rest = [(i, x) for i, x in rows if i not in few[0]]
        leader, similarity = s.first_leaders(few, [x for _, x in rest], 90)
        for (_, x), a, n in zip(rest, leader.tolist(), similarity.tolist(), strict=True):
            assert (a, n) == next(((b, s.ratio(x, y)) for b, y in zip(*few, strict=True) if s.ratio(x, y) >= 90), (0, -1))


def crowd(n):
    return [f"Customer#{i * 7919 % 1_000_003:09d} {('BUILDING', 'MACHINERY')[i % 3 % 2]}" for i in range(n)]


def test_a_crowd_takes_few_rounds(spark, monkeypatch):
    """Each leader of a crowd absorbs few texts of a small batch, so the tables written must not grow with the leaders."""
    staged, stage = [], s.stage_table
    monkeypatch.setattr(s, "stage_table", lambda df, label: staged.append(label) or stage(df, label))
    rows = list(enumerate(crowd(6000)))
    got = s.fuzzy_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id").collect()
    leader, similarity = s.settle(*zip(*rows, strict=True), 90)
    assert sorted(map(tuple, got)) == sorted((a, i, n) for i, (a, n) in enumerate(zip(leader.tolist(), similarity.tolist(), strict=True)) if a != i)
    assert len(staged) <= 8, staged


@pytest.mark.parametrize("first,few,crowd_texts,work", [(5, 5, 40, 10**10), (5, 5, 262_144, 10**10), (2, 1, 40, 10**10), (200, 200, 40, 0)])
def test_batches_that_end_early_and_repeated_ids(spark, monkeypatch, first, few, crowd_texts, work):
    """With leaders of a crowd in many rounds, through blocks, and pairs of a heavy batch, the answer must not change."""
    monkeypatch.setattr(s, "FIRST_BATCH", first)
    monkeypatch.setattr(s, "DIRECT_TEXTS", few)
    monkeypatch.setattr(s, "CROWD_TEXTS", crowd_texts)
    monkeypatch.setattr(s, "CROWD_WORK", work)
    rnd = random.Random(2)
    # an id may come with several texts, a text with several ids
    rows = [(rnd.randrange(150) if rnd.random() < 0.2 else i, rnd.choice(crowd(100))) for i in range(150)] + [(None, x) for x in crowd(3)]
    got = s.fuzzy_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", threshold=93).collect()
    firsts = {}
    for i, x in rows:
        if i is not None:
            firsts[x] = min(i, firsts.get(x, i))
    fate = greedy([(i, x) for x, i in firsts.items()], 93)
    want = Counter((fate[firsts[x]][0], i) for i, x in rows if i is not None and fate[firsts[x]][0] != i)
    assert Counter((r["leader_id"], r["member_id"]) for r in got) == want


def test_a_crowd_in_any_order_is_settled_without_blocks(spark, monkeypatch):
    """The first texts are all unlike each other and lead; that they absorb many later ones tells of the crowd."""
    monkeypatch.setattr(s, "_blocks", lambda *_: pytest.fail("blocks of a crowd"))
    monkeypatch.setattr(s, "FIRST_BATCH", 16)
    monkeypatch.setattr(s, "DIRECT_PAIRS", 0)
    rnd = random.Random(3)
    heads = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(10)]
    rows = list(enumerate([*heads, *(f"{heads[i % 10]}{'qrstuvwxyz'[i // 10 % 10]}{'qrstuvwxyz'[i // 100]}" for i in range(500))]))
    got = s.fuzzy_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id").collect()
    assert sorted(map(tuple, got)) == brute_groups(rows, 90)
