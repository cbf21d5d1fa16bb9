"""Language, toxicity, quality and leaks: held-out accuracy and brute force on small corpora."""

import random
import re
from collections import defaultdict

import numpy as np
from llm_words import words

from scrubline.llm import divergence, language, latent, toxicity

ALPHABETS = {"aa": "ka lo mi ren tas", "bb": "schu öst ver dürf ein", "cc": "que ión ñar ez llo"}


def prose(rng, lang, n):
    s = ALPHABETS[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(20, 200)), lang) for i in range(600) for lang in [rng.choice(list(ALPHABETS))]]
    rows += [(9000, "12 34!", "aa"), (9001, None, "bb"), (9002, prose(rng, "bb", 50).upper(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(df.withColumn("out", language.held_out("doc_id", 3, 1)), language.learn(df)).collect()
    out = [r for r in found if r["out"] and r["doc_id"] < 9000]
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.99
    by = {r["doc_id"]: r for r in found}
    assert [(by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) for i in (9000, 9001)] == [("und", 0.0, True)] * 2
    assert by[9002]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in found)
    mixed = language.identify(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {})
    assert mixed.first()["lang_pred"] == "und"


def test_stray_and_rare_labels_leave_the_others(spark):
    """One short mislabelled document and one document of a language of its own, beside three large languages."""
    rng = random.Random(6)
    rare = "вод зем неб лес гор".split()
    other = lambda n: " ".join("".join(rng.choices(rare, k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(rng, lang, rng.randint(20, 200)), lang) for i in range(600) for lang in [rng.choice(list(ALPHABETS))]]
    learnt = [(i, prose(rng, "aa", 6), "xx") for i in (7000,)] + [(7001, other(200), "dd")]
    tests = [(8000 + i, other(100), None) for i in range(30)]
    names = "doc_id long, text string, lang string"
    contents = language.dictionaries(language.sample_texts(spark.createDataFrame(rows[:400] + learnt, names), "doc_id", "text", "lang"))
    assert len(contents["xx"]) < 100 and all(len(contents[lang]) > 10_000 for lang in ALPHABETS)
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows[400:] + tests, names), contents).collect()}
    assert np.mean([got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows[400:]]) > 0.98
    assert np.mean([got[i]["lang_pred"] == "dd" and not got[i]["rejected"] for i, _, _ in tests]) > 0.95


def test_language_edges(edge_docs, no_docs):
    contents = language.learn(edge_docs)
    out = language.identify(edge_docs, contents)
    assert out.count() == edge_docs.count() and {r["lang_pred"] for r in out.where("text is null").collect()} == {"und"}
    assert language.learn(no_docs) == {} and language.identify(no_docs, {}).count() == 0


def test_pairs_beyond_a_linear_score(spark):
    """Toxic only if an insult meets a group: neither word alone tells."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = words(rng, 12) + (" zinsulta" if insult else "") + (" zgruppo" if group else "")
        rows.append((i, text))
        labels.append((i, int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df, y.where(~language.held_out("doc_id", 4, 2)))
    out = toxicity.score(df.withColumn("out", language.held_out("doc_id", 4, 2)), model).where("out").collect()
    want = dict(labels)
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in out]) > 0.97
    a, b = (np.searchsorted(model.buckets, x) for x in sorted(_buckets(spark, ["zinsulta", "zgruppo"])))
    assert model.factors[a] @ model.factors[b] > 0.5


def _buckets(spark, found):
    df = spark.createDataFrame([(w,) for w in found], "w string")
    return [r["b"] for r in df.selectExpr(f"cast(pmod(xxhash64(w), {toxicity.BUCKETS}) as int) AS b").collect()]


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.FactorMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 2, 5], [], [1, 4]]
    want = [0.3 + sum(m.weights[r]) + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(r) for b in r[i + 1 :]) for r in rows]
    got = m.scores(np.array([0, 3, 3, 5]), np.array([0, 2, 5, 1, 4]))
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))))


def test_a_word_that_tells_only_beside_another_is_learnt(spark):
    rng = random.Random(19)
    rows, labels, alone = [], [], [0, 0]
    for i in range(6000):
        block, insult = i // 10, i % 10 == 0
        group = block % 25 == 0
        toxic = group if insult and group else block % 4 == 1 if insult else i % 10 == 7 and block % 3 == 0 and not group
        text = words(rng, 12) + " zorgwit" * insult + " blenfolk" * group + " " + words(rng, 8)
        rows.append((i, text))
        labels.append((i, int(toxic)))
        alone[0] += group
        alone[1] += group and toxic
    n, p = len(rows), sum(y for _, y in labels)
    held, hit = alone
    chi2 = n * (hit * n - held * p) ** 2 / (held * (n - held) * p * (n - p))
    # the group word has nearly no effect of its own
    assert chi2 < toxicity.MIN_CHI2 / 2
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(_buckets(spark, ["blenfolk", "zorgwit"])) <= set(model.buckets.tolist())
    tests = spark.createDataFrame([(1, "a zorgwit blenfolk"), (2, "a zorgwit"), (3, "a blenfolk"), (4, "a")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(tests, model).collect()}
    assert got[1] > 0.7 and got[2] < 0.45 and got[3] < 0.15 and got[4] < 0.1


def test_toxicity_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(edge_docs, none)
    out = toxicity.score(edge_docs, model).collect()
    assert len(out) == edge_docs.count() and all(r["score"] < 0.01 and r["predicted"] == 0 for r in out)
    some = spark.createDataFrame([(5, 1), (5, 0), (9, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    out = toxicity.score(edge_docs, toxicity.learn(edge_docs, some)).collect()
    assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(no_docs, model).count() == 0


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_and_verdicts(spark, edge_docs, no_docs):
    rng = random.Random(3)
    common = divergence.COMMON_WORDS["en"]
    clean = lambda n: " ".join(rng.choice(common[:8]) if rng.random() < 0.4 else words(rng, 1) for _ in range(n))
    rows = [(i, clean(rng.randint(40, 400)), "en") for i in range(200)]
    rows += [(1000, "|".join(words(rng, 1).upper() + " #$" for _ in range(200)), "en"), (1001, "a b c d e " * 30, "en"), (1002, "x\n\nx\nx \n y", None)]
    rows += [(1003, clean(200), None), (1004, "one two\vthree\xa0four " * 3 + clean(60), "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in divergence.quality_rules(df).collect()}
    for i, text, _ in rows:
        r = got[i]
        n, chars, symbols, dup, repeated = base_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated), i
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
    assert sum(got[i]["kept"] for i in range(200)) >= 196 and not got[1000]["kept"] and not got[1000]["base_failed"]
    assert got[1001]["base_failed"] and got[1003]["kept"]
    edge = divergence.quality_rules(edge_docs).collect()
    assert len(edge) == edge_docs.count()
    for r, d in zip(sorted(edge, key=str), sorted(edge, key=str), strict=True):
        assert r == d
    by = {r["doc_id"]: r for r in edge}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[9]["n_repeat_words"] == base_counts(edge_docs.where("doc_id = 9").first()["text"])[4]
    assert divergence.quality_rules(no_docs).count() == 0


def test_jensen_shannon_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    got = df.select(divergence._distance(F.col("p"), F.col("q")).alias("d")).first()["d"]
    assert abs(got - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-9


def test_leaks_and_paraphrases(spark, edge_docs, no_docs):
    rng = random.Random(5)
    vocabulary = words(rng, 4000).split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, ". ".join(text(9) for _ in range(3)) + ".") for i in range(30)] + [(90, None), (91, ""), (92, "?!")]
    rows, want = [], set()
    for i in range(300):
        body = [text(rng.randint(0, 120)), text(rng.randint(0, 120))]
        if i % 10 == 0:
            item = rng.randrange(30)
            leak = items[item][1].lower().split()
            if i % 20 == 0:  # a paraphrase: some words replaced, some inserted
                for _ in range(5):
                    leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
                leak.insert(rng.randrange(len(leak)), "inserted")
            body.insert(1, " ".join(leak))
            want.add((i, item))
        rows.append((i, " ".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaked(df, queries).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    assert latent.leaked(edge_docs, queries).count() == 0
    assert latent.leaked(no_docs, queries).count() == 0 and latent.leaked(df, queries.limit(0)).count() == 0


def test_long_items_are_found(spark):
    """Items of 150 to 900 words copied verbatim or with some words replaced, and halves that must not match."""
    rng = random.Random(8)
    vocabulary = words(rng, 4000).split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, ". ".join(text(10) for _ in range(n))) for i, n in enumerate((15, 22, 40, 60, 90))]
    rows, want = [(i, text(rng.randint(5, 300))) for i in range(200)], set()
    for i, item in items:
        copy = item.split()
        rows += [(1000 + i, f"{text(37)} {item} {text(90)}"), (2000 + i, f"{text(50)} {' '.join(copy[: len(copy) * 2 // 5])} {text(40)}")]
        for _ in range(len(copy) // 10):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((3000 + i, f"{text(11)} {' '.join(copy)}"))
        want |= {(1000 + i, i), (3000 + i, i)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = latent.leaked(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    # items of several windows stand before others: each row tells the cosine of its own window
    assert all(r["cosine"] >= latent.MIN_COSINE for r in rows)
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == want


def test_common_subsequence_is_the_heaviest():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, 7).astype(np.uint32), rng.integers(0, 5, 9).astype(np.uint32)
        w = np.array([1.0, 2.0, 3.0, 0.5, 0.25])[a]
        table = np.zeros((8, 10))
        for i in range(7):
            for j in range(9):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + w[i] if a[i] == b[j] else 0)
        share, _ = latent.common_subsequence(a, b, w, 0)
        assert abs(share * w.sum() - table[-1, -1]) < 1e-9


def test_every_language_has_its_own_reference(spark):
    """A language without a given list is judged by its own documents, and moves no other language's verdicts."""
    rng = random.Random(8)
    english, fifth = divergence.COMMON_WORDS["en"][:8], "и в не на что он с как это по".split()
    mixed = lambda listed, own, n: " ".join(rng.choice(listed) if rng.random() < 0.4 else own() for _ in range(n))
    cyrillic = lambda: "".join(rng.choices("вод зем неб лес гор".split(), k=rng.randint(1, 3)))
    names = "doc_id long, text string, lang string"
    rows = [(i, mixed(english, lambda: words(rng, 1), rng.randint(40, 300)), "en") for i in range(100)]
    others = [(1000 + i, mixed(fifth, cyrillic, rng.randint(40, 300)), "ru") for i in range(100)]
    odd = [(2000, mixed(english, lambda: words(rng, 1), 300), "ru"), (2001, "x", "yy"), (2002, "", "zz"), (2003, None, "zz")]
    alone = {r["doc_id"]: r for r in divergence.quality_rules(spark.createDataFrame(rows, names)).collect()}
    got = {r["doc_id"]: r for r in divergence.quality_rules(spark.createDataFrame(rows + others + odd, names)).collect()}
    assert len(got) == 204 and all(got[i][:8] == alone[i][:8] and np.allclose(got[i][8:], alone[i][8:]) for i in alone)
    assert sum(got[1000 + i]["kept"] for i in range(100)) >= 98 and not got[2000]["kept"]
    counted = {r["name"]: r["counted"] for r in divergence.counted_words(spark.createDataFrame(rows + others + odd, names), "text", "lang").collect()}
    assert set(counted) == {"ru", "yy"} and set(fifth) <= set(counted["ru"]) and counted["yy"] == ["x"]


def test_the_latent_space_is_fitted_on_all_passages(spark):
    rng = np.random.default_rng(2)
    sizes = [0, 1, 31, 32, 33, 64, 65, 200, 1000]
    texts = [rng.integers(-(2**31), 2**31, n).astype(np.int32) for n in sizes]
    tokens = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(texts)], "doc_id long, ids array<int>")
    df, inside, n = latent.frequencies(tokens)
    idf, thin = rng.random(latent.FEATURES), rng.normal(size=(latent.FEATURES, 3))
    rows, seen = [], np.zeros(latent.FEATURES)
    for x in texts:
        pieces = [x[i : i + latent.BLOCK] for i in range(0, len(x), latent.BLOCK)]
        for p in [np.concatenate(pieces[i : i + 2]) for i in range(max(1, len(pieces) - 1))] if pieces else []:
            v = np.zeros(latent.FEATURES)
            np.add.at(v, latent.features(p), idf[latent.features(p)])
            np.add.at(seen, latent.features(p), 1)
            rows.append(0.5 * v / np.sqrt((idf[latent.features(p)] ** 2).sum()))
    a = np.array(rows)
    assert n == len(rows) and np.array_equal(inside, seen) and df.sum() == sum(len(set(latent.features(x))) for x in texts)
    assert np.allclose(latent.gram_times(tokens, None, idf, thin, 0.5), a.T @ (a @ thin), atol=1e-4)


def test_the_latent_space_holds_the_leading_vectors():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(latent.FEATURES, 20)))[0]
    scale = 2.0 ** -np.arange(20)
    got = latent.latent_space(lambda q: basis @ (scale[:, None] * (basis.T @ q)))
    assert got.shape == (latent.FEATURES, latent.RANK)
    assert np.allclose(np.abs(np.sum(got[:, :10] * basis[:, :10], axis=0)), 1, atol=1e-6)


def test_sums_by_word_and_by_piece_are_the_plain_ones():
    rng = np.random.default_rng(5)
    f, at, rows = rng.integers(0, 40, 500), rng.integers(0, 30, 500), rng.normal(size=(30, 7)).astype(np.float32)
    for x in (None, rng.random(500)):
        out, want = np.ones((latent.FEATURES, 7)), np.ones((latent.FEATURES, 7))
        latent._add_by_word(out, f, rows, at, x)
        np.add.at(want, f, rows[at].astype(float) * (1 if x is None else x[:, None]))
        assert np.allclose(out, want, atol=1e-4)
    word = rng.integers(0, 30, (20, latent.BLOCK))
    assert np.allclose(latent._piece_sums(rows, word), rows[word].sum(axis=1), atol=1e-4)


def test_words_of_the_latent_space(spark):
    texts = ["", None, " .. ", "a", "..Über, naïve-2nd\n日本 x! ", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["ids"] for r in df.select("i", latent.word_ids(df["t"]).alias("ids")).collect()}
    for i, t in enumerate(texts):
        want = latent.item_words(t)[0] if t and t.strip(" .") else np.zeros(0, dtype=np.uint32)
        assert got[i] == want.view(np.int32).tolist()
