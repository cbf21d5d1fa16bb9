"""Lattice encoding against a plain Viterbi, and round trips."""

import random

import pytest
from llm_words import words

from scrubline.llm import pieces

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(pieces.MODEL), reason="no piece table")


@pytest.fixture(scope="module")
def table():
    return pieces.load()


def plain(unit, table, known):
    best = [(0.0, -1, -1)]
    for stop in range(1, len(unit) + 1):
        tried = []
        for start in range(max(0, stop - table.longest), stop):
            hit = known.get(unit[start:stop])
            if hit:
                tried.append((best[start][0] + hit[1], start, hit[0]))
            elif stop - start == 1:
                tried.append((best[start][0] + table.unknown, start, -1 - start))
        best.append(max(tried))
    out, at = [], len(unit)
    while at > 0:
        _, start, i = best[at]
        out.append([i] if i >= 0 else [table.byte_ids[b] for b in unit[start].encode()])
        at = start
    return [x for part in reversed(out) for x in part]


def test_encoding_is_viterbi_and_decoding_gives_the_text_back(spark, table):
    rng = random.Random(1)
    texts = [words(rng, n) for n in (1, 3, 50, 400)]
    texts += ["Hello  world, the cat\n\n sat.\t", "日本 😀 x", "  a ", "z" * 300 + " " * 40 + "\ny", "Straße über naïve\r\nñandú", "\n", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = {p: (i, s) for p, i, s in table.pieces}
    # small blocks, so that units meet from several
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df, table, block_chars=200), table).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert "".join(pieces.units(text)) == " " + text
        assert got[i]["ids"] == [x for u in pieces.units(text) for x in plain(u, table, known)]
        assert got[i]["text"] == text


def test_edges_of_the_input(edge_docs, no_docs, table):
    got = pieces.decode(pieces.encode(edge_docs, table), table).collect()
    want = sorted((str(r["doc_id"]), r["text"] or "") for r in edge_docs.collect())
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == want
    assert pieces.encode(no_docs, table).count() == 0


def test_long_units_are_not_cut(spark, table):
    rng = random.Random(2)
    joined = "".join(words(rng, 400).split())[:1000]
    texts = [joined, "日本語テキスト" * 60, " " * 200 + "x", joined + " " + joined, "ab" * 64 + "c"]
    known = {p: (i, s) for p, i, s in table.pieces}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df, table), table).collect()}
    for i, text in enumerate(texts):
        assert got[i]["text"] == text
        assert got[i]["ids"] == [x for u in pieces.units(text) for x in plain(u, table, known)]
    assert pieces.units(texts[0]) == [" " + joined]
    # one unit by both ways
    short = " " + joined[:100]
    row = pieces._with_bytes(pieces.best_paths(pieces.edges(spark.createDataFrame([(short,)], "unit string"), table)), table).first()
    assert row["path"] == pieces.long_path(short, known, table)


def test_common_units_come_from_the_lattice_and_nothing_is_shuffled(spark, table, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(pieces, "COMMON", 5)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    texts = [words(rng, 300) + " the" * 9 + " 日本" * (8 + i) for i in range(4)]
    known = {p: (i, s) for p, i, s in table.pieces}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    common = {r["unit"]: r["path"] for r in pieces.common_paths(df.select("text"), table, 1000).collect()}
    assert len(common) == 5 and " the" in common and " 日本" in common
    assert all(path == pieces.long_path(unit, known, table) for unit, path in common.items())
    # neither blocks nor paths are shuffled or written
    encoded = pieces.encode(df, table, block_chars=1000)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: [x for u in pieces.units(t) for x in plain(u, table, known)] for i, t in enumerate(texts)}


def test_the_fold_over_many_units_is_the_plain_one(spark, table):
    rng = random.Random(6)
    known = {p: (i, s) for p, i, s in table.pieces}
    found = {u for n in (20, 300) for u in pieces.units(words(rng, n))} | {"é😀x", " 日本", "\n", "   ", "zz😀😀", " " * 40 + "a", "ab" * 60}
    for some in (found, ["a"], [" 日"], ["\n", "\n"]):
        some = sorted(some, key=len, reverse=True)
        ids, counts = pieces.Lattice(table).paths(some)
        assert len(counts) == len(some)
        assert ids.tolist() == [x for u in some for x in plain(u, table, known)]
