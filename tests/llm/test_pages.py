"""Main text on labelled pages that weren't trained on, and WARC round trips."""

import gzip
import hashlib
import random
import time

import pytest

from scrubline.llm import html_crf, warc
from scrubline.llm.html_blocks import blocks

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def chain():
    return html_crf.trained()


def test_blocks_of_broken_markup():
    html = '<title>t</title><p>a &amp;lt; b<b>c<br>d<p>e<script>x="</p>"</script>f<!-- <p>no --><li>g<ul><li>h<li>i</ul><img alt="a>b">j<textarea>k</textarea>&nbsp;l'
    assert [b.text for b in blocks(html)] == ["a &lt; bc d", "ef", "g", "h", "i", "j l"]
    assert [b.text for b in blocks("<p>one <a href='x>y'>two</a> < three <p")] == ["one two < three <p"]
    assert blocks("") == [] and blocks("<!-- never closed") == []


def test_tags_that_never_end_are_read_once():
    """The time grows with the page, not with its square."""
    took = []
    for n in (20_000, 200_000):
        pages = ["<a " * n, "<p>one</p>" + "<a " * n, "<a \"" * n, "x > " + "<b '" * n, "<!--" * n, "<! " * n + "<a "]
        start = time.process_time()
        for page in pages:
            blocks(page)
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 0.5
    assert [b.text for b in blocks("<p>one</p>two <a three")] == ["one", "two <a three"]
    assert [b.text for b in blocks("<p>one</p>two <!-- three")] == ["one", "two"]
    assert [b.text for b in blocks("<p>one</p>two <!-- three > four")] == ["one", "two"]
    assert [b.text for b in blocks("a <!-- > --> b <! c > d <? e")] == ["a b d"]


def test_held_out_pages(chain):
    wrong = total = 0
    for seed in range(20_000, 20_300):
        html, texts, labels = html_crf.labelled_page(seed)
        page = blocks(html)
        assert [b.text for b in page] == texts
        wrong += sum(a != b for a, b in zip(chain.decode(page), labels, strict=True))
        total += len(labels)
    assert wrong < 0.005 * total


def test_viterbi_is_the_best_of_all_paths(chain):
    import itertools

    for seed in range(300, 330):
        page = blocks(html_crf.labelled_page(seed)[0])[:10]
        e = chain.emissions(page)
        value = lambda path: sum(e[i][x] for i, x in enumerate(path)) + sum(chain.moves[a][b] for a, b in itertools.pairwise(path))  # noqa: E731,B023
        best = max(map(value, itertools.product((0, 1), repeat=len(page))))
        assert abs(value(chain.decode(page)) - best) < 1e-9


def test_extraction_of_edge_pages(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a>x</a></nav>"), (4, "u", "<article><h1>T.</h1><p>Long text here." + "<p>again and again." * 500), (4, "u", None)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_crf.extract(df, chain).collect()]
    assert got[:3] == [(1, "", 0), (2, "", 0), (3, "", 0)]
    assert got[3][1].split("\n")[:2] == ["T.", "Long text here."] and got[3][2] == len(got[3][1]) and got[3][1].count("\n") == 501
    assert html_crf.extract(df.limit(0), chain).count() == 0


def pages(rng):
    big = "x" * 900 + "é" * 50
    rows = [(i, f"http://h/{i}", rng.choice([big, "y" * 2000, "small", str(rng.random()) * rng.randint(1, 200)])) for i in range(300)]
    rows += [(None, None, big), (5000, "http://a b\nc", None), (5001, "", "日本" * 400), (5002, "u", "日本" * 400), (5002, "u", "日本" * 400)]
    return rows


def test_warc_round_trip(spark, tmp_path):
    rows = pages(random.Random(1))
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'z' AS leader", "1 AS shard", "2 AS digest").repartition(7)
    options = {"shard_bytes": 40_000, "roll_bytes": 3_000}
    manifest = warc.write_archive(df, str(tmp_path / "a"), **options)
    files = manifest.collect()
    assert len(files) > 5 and sum(r["records"] for r in files) == len(rows)
    largest = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            largest[data] = max(largest.get(data, 0), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        other = largest.get(data)
        revisit = other is not None and other != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    got = [tuple(r)[:5] for r in warc.read_archive(spark, str(tmp_path / "a")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # the same rows in another order and number of partitions give the same bytes
    warc.write_archive(df.orderBy("html").coalesce(2), str(tmp_path / "b"), **options)
    names = sorted(r["file"] for r in files)
    for name in names:
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes()
    first = gzip.decompress((tmp_path / "a" / names[0]).read_bytes())
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and b"WARC-Type: response" in first


def test_warc_notices_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc" * 500)], PAGES)
    name = warc.write_archive(df, str(tmp_path / "a")).first()["file"]
    path = tmp_path / "a" / name
    path.write_bytes(path.read_bytes()[:-30])
    with pytest.raises(Exception, match="cut|match|incorrect|Error"):
        warc.read_archive(spark, str(tmp_path / "a")).collect()


def test_warc_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    assert warc.write_archive(empty, str(tmp_path / "a")).count() == 0
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0
