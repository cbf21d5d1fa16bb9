"""Personal data: fixed patterns, and terms of their context that give the protected value away.

Every text is searched whole for four kinds of values. Then, over all documents, the words of the whole texts with
each value are counted: a word t discloses a value e by its pointwise mutual information relative to the
value's own information, ``PMI(e; t) / -log p(e)``, which is 1 if the word occurs only beside that
value. Words at or above ``max_disclosure``, seen with the value in at least ``min_support``
different texts, are protected too (kind ``term``), so that the value can't be guessed from what
is left. Redaction replaces each value by its kind, the general term of which it is an instance.

Null text counts as empty and has no span. Copies of a text count as documents in the
probabilities but only once as support. Repeated rows give equal rows, extra columns are unread by
the search, an empty table gives an empty result. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.text import small_batches
from scrubline.session import stage_table

KINDS = ("email", "ip", "card", "phone")
# fixed values: the patterns of the four kinds; an email's local part is found from its @ backwards
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
MAX_DISCLOSURE = 0.8
MIN_SUPPORT = 3
BITS = 1 << 22
SMALL_ROWS = 200_000
# pairs of a value and a word that a task holds before it gives their counts
PAIRS_AT_ONCE = 200_000
FOUND = "row long, doc_id long, h long, base string, n_email long, n_ip long, n_card long, n_phone long, entities array<long>, text string"
SPANS = "array<struct<start:int,stop:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every value, by kind and then by start."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(x) < 9 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def entity(kind: str, value: str) -> int:
    """The hash of a value without its punctuation, so that its spellings are one value."""
    plain = value.lower() if kind in ("email", "ip") else re.sub(r"\D", "", value)
    return _signed(xxhash.xxh64_intdigest(f"{kind}:{plain}".encode()))


def context_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) for all words of a text that aren't part of one of its values."""
    merged: list[list[int]] = []
    for x, y in sorted((x, y) for _, x, y in spans):
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
        else:
            merged.append([x, y])
    starts = [x for x, _ in merged]
    out = []
    for m in TERM.finditer(text):
        a, b = m.span()
        i = bisect_left(starts, b) - 1
        if i < 0 or merged[i][1] <= a:
            out.append((m.group().lower(), a, b))
    return out


def _parsed(base: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"base": pa.string(), "entities": pa.list_(pa.int64()), "text": pa.string()}
    schema = pa.schema([(f, types.get(f, pa.int64())) for f in (x.split()[0] for x in FOUND.split(", "))])
    for batch in batches:
        rows = []
        for row, doc_id, h, text in zip(*batch.columns, strict=True):
            text = text.as_py() or ""
            spans = base_spans(text)
            kinds = Counter(k for k, _, _ in spans)
            rows.append({
                "row": row.as_py(), "doc_id": doc_id.as_py(), "h": h.as_py(), "base": ",".join(f"{k}:{a}:{b}" for k, a, b in spans),
                **{f"n_{k}": kinds[k] for k in KINDS},
                "entities": sorted({entity(k, text[a:b]) for k, a, b in spans}),
                "text": text if spans else None,
            })
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _count_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(base, text, copies, values) to (e, term, net, support): in how many documents and texts both occur."""
    net: Counter = Counter()
    support: Counter = Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array([e for e, _ in net], pa.int64()), pa.array([t for _, t in net], pa.string())]
        counts = [pa.array(net.values(), pa.int64()), pa.array([support[k] for k in net], pa.int64())]
        return pa.RecordBatch.from_arrays(columns + counts, names=["e", "term", "net", "support"])

    for batch in batches:
        for base, text, copies, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = {t for t, _, _ in context_terms(text, _parsed(base))}
            for e in values:
                for t in terms:
                    net[e, t] += copies
                    support[e, t] += 1
                if len(net) > PAIRS_AT_ONCE:
                    yield out()
                    net.clear()
                    support.clear()
    if net:
        yield out()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, base, text, values) to (row, e, term) for all words of the texts."""
    for batch in batches:
        for row, base, text, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = sorted({t for t, _, _ in context_terms(text, _parsed(base))})
            for e in values if terms else []:
                columns = [pa.array([row] * len(terms), pa.int64()), pa.array([e] * len(terms), pa.int64()), pa.array(terms, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "e", "term"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, base, text, words) to (row, terms): where the words stand."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        rows, terms = batch.column(0), []
        for base, text, words in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            words = set(words)
            terms.append([{"start": a, "stop": b} for t, a, b in context_terms(text, _parsed(base)) if t in words])
        yield pa.RecordBatch.from_arrays([rows, pa.array(terms, kind)], names=["row", "terms"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _texts_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many documents each of ``terms`` occurs.

    A bit table of fixed size lets most words go at once; the join is exact.
    """
    place = F.pmod(F.xxhash64("term"), F.lit(BITS)).cast("int")
    bit = F.expr("bit_or(shiftleft(1L, place % 32))").alias("v")
    cells = terms.select(place.alias("place")).groupBy(F.expr("place div 32").alias("cell")).agg(bit)
    table = np.zeros(BITS // 32, dtype=np.int64)
    for r in cells.collect():
        table[r["cell"]] = r["v"]
    bits = np.packbits(((table[:, None] >> np.arange(32)) & 1).astype(np.uint8).ravel())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                for w in set(TERM.findall((text.as_py() or "").lower())):
                    maybe = known.get(w)
                    if maybe is None:
                        if len(known) > 300_000:
                            known.clear()
                        at = xxhash.xxh64_intdigest(w.encode(), seed=42) % BITS
                        known[w] = maybe = bool(bits[at >> 3] >> (7 - (at & 7)) & 1)
                    if maybe:
                        n[w] += 1
            if len(n) > 200_000:
                yield out()
                n.clear()
        if n:
            yield out()

    counted = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("nt"))
    return counted.join(terms, "term", "left_semi")


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_disclosure: float = MAX_DISCLOSURE, min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), counts by kind, base, and ``terms`` (start, stop)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # the texts with a value stay beside what was found in them
    found = stage_table(base.mapInArrow(_search, FOUND), "private")
    held = found.where("text is not null")
    values = held.select("row", "h", F.explode("entities").alias("e"))
    # only values of several texts can have words that are seen with them there
    often = values.groupBy("e").agg(F.count("*").alias("ne"), F.count_distinct("h").alias("texts")).where(F.col("texts") >= min_support)
    often = stage_table(often.select("e", "ne"), "often")
    spans = found.select("row", F.lit(None).cast(SPANS).alias("terms")).limit(0)
    if not often.isEmpty():
        frequent = _small(often.select("e"))
        shared = stage_table(values.join(frequent, "e").groupBy("row").agg(F.collect_list("e").alias("values")), "values")
        once = held.groupBy("h").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
        once = stage_table(shared.join(once, "row").select("row", "copies", "values"), "once")
        read = held.select("row", "base", "text").join(_small(once), "row").select("base", "text", "copies", "values")
        together = read.mapInArrow(_count_together, "e long, term string, net long, support long").groupBy("e", "term")
        together = together.agg(F.sum("net").alias("net"), F.sum("support").alias("support")).where(F.col("support") >= min_support)
        together = stage_table(together, "together")
        terms = stage_table(together.select("term").distinct(), "terms")
        total = found.count()
        known = together.join(_texts_with(base, terms), "term").join(often, "e")
        info = F.log2(F.lit(float(total)) / F.col("ne"))
        pmi = F.log2(F.col("net") * F.lit(float(total)) / (F.col("ne") * F.col("nt")))
        # a value in every document has no information that a word could give away
        telling = known.where((info > 0) & (pmi >= F.lit(max_disclosure) * info)).select("e", "term")
        telling = stage_table(telling, "telling")
        told = _small(telling.select("e").distinct())
        asked = stage_table(values.join(told, "e").groupBy("row").agg(F.collect_list("e").alias("values")), "asked")
        texts = held.select("row", "base", "text")
        pairs = texts.join(_small(asked), "row").select("row", "base", "text", "values").mapInArrow(_pairs, "row long, e long, term string")
        words = pairs.join(_small(telling), ["e", "term"]).groupBy("row").agg(F.collect_set("term").alias("words"))
        words = stage_table(words, "term-words")
        spans = texts.join(_small(words), "row").select("row", "base", "text", "words").mapInArrow(_places, f"row long, terms {SPANS}")
        spans = stage_table(spans, "term-spans")
    return found.drop("entities", "text").join(_small(spans), "row", "left").drop("row")


def digest(found: DataFrame) -> DataFrame:
    """The spans as text and the digest of the fixed patterns' spans."""
    terms = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int>>")),
        lambda s: F.concat(F.lit("term:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")),
    )
    parts = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), terms)
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.array_join(parts, ",").alias("spans"), F.size(terms).cast("long").alias("n_term"),
    )


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans are one, of the first's kind."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in reversed(merged):
        text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
    return text


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all protected spans generalised in ``text_col``; null texts stay null."""
    found = find(docs, id_col, text_col, **options).where((F.col("base") != "") | F.col("terms").isNotNull())
    found = found.select(F.col("doc_id").alias("__i"), F.col("h").alias("__h"), "base", F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int>>")).alias("terms"))
    spans = _small(stage_table(found.distinct().select("__i", "__h", F.col("base").alias("__base"), F.col("terms").alias("__terms")), "redactions"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, bases, terms in batches:
            out = []
            for text, base, more in zip(texts, bases, terms, strict=True):
                spans = _parsed(base.as_py())
                spans += [("term", s["start"], s["stop"]) for s in more.as_py()]
                out.append(redact_text(text.as_py(), spans))
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    match = docs[id_col].cast("long").eqNullSafe(F.col("__i")) & (F.xxhash64(docs[text_col]) == F.col("__h"))
    joined = docs.join(spans, match, "left")
    hit = F.col("__base").isNotNull() & F.col(text_col).isNotNull()
    new = F.arrow_udf(run, "string")(
        F.when(hit, F.col(text_col)).otherwise(""), F.coalesce("__base", F.lit("")),
        F.coalesce("__terms", F.array().cast("array<struct<start:int,stop:int>>")),
    )
    return joined.withColumn(text_col, F.when(hit, new).otherwise(F.col(text_col))).select(*docs.columns)
