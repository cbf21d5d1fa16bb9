import hashlib
import random
import re

import xxhash
from llm_words import words
from pyspark.sql import functions as F

from scrubline.llm import pii


def brute(text):
    """The patterns as they are given, without any shortcut."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    parts = ["a.b@c.de", "x@y", "@z.org", "q@@r.s", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0) 30-123456"]
    parts += ["+1", " ", "-", ".", "@", "é", "日", "a", "7", "%", "\n", "4111111111111111", "00.0.0.0001"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute(text), text


def test_hash_of_the_bit_table_is_sparks(spark):
    text = "héllo"
    got = spark.range(1).select(F.pmod(F.xxhash64(F.lit(text)), F.lit(pii.BITS)).alias("h")).first()["h"]
    assert got == xxhash.xxh64_intdigest(text.encode(), seed=42) % pii.BITS


def test_terms_that_tell_a_value_are_protected(spark):
    rng = random.Random(3)
    rows = [(i, f"{words(rng, 5)} Zanzibar wrote from quill@corp.example.org about the matter {words(rng, 4)}") for i in range(6)]
    # copies of one text are no support for a word
    rows += [(50 + i, "unusual Copyword beside copy@corp.example.org the matter") for i in range(6)]
    rows += [(100 + i, f"the plain text wrote from here about the matter and today beside {words(rng, 9)}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert "<TERM> wrote from <EMAIL>" in out[0]["text"] and "the matter" in out[0]["text"]
    assert out[50]["text"] == "unusual Copyword beside <EMAIL> the matter"
    assert out[100]["text"] == rows[12][1]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(rows[0][1]))
    assert found[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert found[0]["spans"].startswith(base + ",term:") and found[0]["n_email"] == 1


def test_edges_of_the_input(edge_docs, no_docs):
    found = pii.digest(pii.find(edge_docs)).collect()
    assert len(found) == edge_docs.count()
    assert {r["doc_id"]: r["n_email"] for r in found}[11] == 1
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in found if r["doc_id"] in (1, 2, 3))
    out = pii.redact(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    assert pii.find(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_a_word_far_from_the_value_is_protected_too(spark):
    rng = random.Random(5)
    rows = [(i, f"Zanzibar {words(rng, 60)} from quill@corp.example.org {words(rng, 400)} Quagmire") for i in range(5)]
    rows += [(100 + i, words(rng, 60)) for i in range(100)]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].startswith("<TERM> ") and out[i].endswith(" <TERM>") for i in range(5))


def test_words_of_the_whole_text_but_not_of_its_values():
    text = "Anna über\u00e9bob@corp.example.org anna +49 301 2345678 Zoe"
    got = pii.context_terms(text, pii.base_spans(text))
    assert got == [("anna", 0, 4), ("anna", text.index("anna"), text.index("anna") + 4), ("zoe", len(text) - 3, len(text))]
