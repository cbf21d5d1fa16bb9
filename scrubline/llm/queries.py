"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrubline.llm import html_crf, language, pieces, pii, toxicity
from scrubline.llm.divergence import COMMON_WORDS, quality_rules
from scrubline.llm.filter_audit import audit
from scrubline.llm.importance import resample
from scrubline.llm.latent import leaked
from scrubline.llm.probminhash import near_duplicates
from scrubline.llm.shared_runs import shared_runs
from scrubline.llm.substring_dedup import repeated_passages
from scrubline.llm.vantage import neighbours
from scrubline.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "common_distance")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return repeated_passages(docs).unionByName(shared_runs(docs))


def op2_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_table(spark, table(spark, sf_dir, "documents"))


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", language.held_out("doc_id", 3, 1).alias("held_out"), "text")
    found = language.identify(rows, language.learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin")


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(~language.held_out("doc_id", 4, 2)))
    rows = docs.withColumn("held_out", language.held_out("doc_id", 4, 2))
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op10_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ALL = (
    op1_substring_dedup,
    op2_sentencepiece_lattice,
    op3_pii_disclosure,
    op4_html_crf,
    op5_quality_divergence,
    op6_probminhash,
    op7_latent_decontamination,
    op8_language_zstd,
    op9_toxicity_fm,
    op10_warc_shards,
    op11_importance_crc,
    op12_vantage_points,
    op13_filter_audit,
)
QUERIES = {f.__name__: f for f in ALL}
ORACLE: dict[str, str] = {}

_COMMON = ", ".join(f"('{lang}', {words})" for lang, words in sorted(COMMON_WORDS.items()))
ORACLE["op5_quality_divergence"] = f"""
WITH given(ref, listed) AS (VALUES {_COMMON}),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
found AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
    FROM (SELECT lang, lower(unnest(ws)) AS word FROM w WHERE lang NOT IN (SELECT ref FROM given)) GROUP BY lang, word),
common AS (FROM given UNION ALL SELECT lang, list(word ORDER BY place) FROM found WHERE place <= 20 GROUP BY lang),
best AS (SELECT r, max(struct_pack(n := len(list_intersect(list_transform(ws, lambda x: lower(x)), listed)), ref := ref)).ref AS ref FROM w, given GROUP BY r),
b AS (SELECT w.*, CASE WHEN lang IN (SELECT ref FROM common) THEN lang ELSE best.ref END AS ref, len(ws) AS n_words FROM w JOIN best USING (r)),
grams AS (SELECT r, i, ws[i:i + 4] AS gram FROM (SELECT r, ws, unnest(range(1, n_words - 3)) AS i FROM b)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS t(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM b)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (SELECT *, length(t) AS chars, list_sum(list_transform(ws, lambda x: length(x))) AS wc,
    length(regexp_replace(t, '[^\\p{{Ll}}]', '', 'g')) AS low, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS up,
    length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) AS dig, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS sym,
    length(regexp_replace(t, '[^.,;:!?''"()\\-]', '', 'g')) AS stp FROM b),
f AS (SELECT r, doc_id, ref, n_words, CAST(coalesce(wc, 0) AS BIGINT) AS word_chars, sym AS n_symbols, chars, ws,
    [low, chars - coalesce(wc, 0), up, dig, sym, stp, coalesce(wc, 0) - low - up - dig - sym - stp] AS classes FROM c),
bins AS (
    SELECT r, ref, n_words, 'class' AS kind, k, classes[k] / greatest(chars, 1)::DOUBLE AS share FROM f, range(1, 8) AS t(k)
    UNION ALL
    SELECT f.r, ref, n_words, 'common', k, coalesce(h.n, 0) / greatest(n_words, 1)::DOUBLE
    FROM f JOIN (SELECT ref, unnest(range(1, len(listed) + 2)) AS k FROM common) USING (ref)
    LEFT JOIN (SELECT r, CASE WHEN list_contains(listed, word) THEN list_position(listed, word) ELSE len(listed) + 1 END AS k, count(*) AS n
        FROM (SELECT r, ref, lower(unnest(ws)) AS word FROM f) JOIN common USING (ref) GROUP BY ALL) h USING (r, k)),
means AS (SELECT ref, kind, k, avg(share) AS mean FROM bins WHERE n_words >= 30 GROUP BY ALL),
apart AS (SELECT r, kind, sqrt(greatest(sum((CASE WHEN share > 0 THEN share * log2(share * 2 / (share + mean)) ELSE 0 END
    + CASE WHEN mean > 0 THEN mean * log2(mean * 2 / (share + mean)) ELSE 0 END) / 2), 0)) AS d FROM bins JOIN means USING (ref, kind, k) GROUP BY r, kind),
q AS (SELECT f.*, coalesce(covered.n, 0) AS repeated, coalesce(lines.n, 0) AS dup,
    (SELECT d FROM apart a WHERE a.r = f.r AND kind = 'class') AS dc, (SELECT d FROM apart a WHERE a.r = f.r AND kind = 'common') AS dw
    FROM f LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * repeated > 20 * n_words AS failed FROM q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
    CAST(repeated AS BIGINT) AS n_repeat_words, failed AS base_failed,
    NOT failed AND (n_words < 30 OR NOT coalesce(dc > 0.15 + 0.3 / sqrt(n_words) OR dw > 0.12 + 1.5 / sqrt(n_words), FALSE)) AS kept
FROM v"""

ORACLE["op10_warc_shards"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS leader, count(*) AS n FROM p
    WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest,
    CASE WHEN leader IS NOT NULL AND page_id IS DISTINCT FROM leader THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)"""


ORACLE["op13_filter_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed,
    coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad FROM w LEFT JOIN lab USING (doc_id)),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (bad) AS nt FROM f GROUP BY ALL),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS t(step)),
x AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN failed & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before <> 0 AND failed & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN ng ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN nt ELSE 0 END) AS toxic_lost
    FROM g, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x"""

# CRC-32 of each different word, byte by byte in a list fold; everything else is counting
ORACLE["op11_importance_crc"] = r"""
WITH RECURSIVE reg(n, i, x) AS (SELECT n, 0, n::UBIGINT FROM range(256) AS t(n)
    UNION ALL SELECT n, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END FROM reg WHERE i < 8),
tab AS (SELECT list(x ORDER BY n) AS t FROM reg WHERE i = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x) AS ws FROM documents),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY ALL),
tw AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM hexed, tab),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN hashed USING (word) GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS n FROM tw JOIN hashed USING (word) GROUP BY ALL),
gain AS (SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
    FROM range(10000) AS x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
f AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM d LEFT JOIN w USING (r)),
able AS (SELECT *, n_features >= 20 AND doc_id IS NOT NULL AS ok FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (ok) OVER () AS n FROM able)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= 10 * n // 100 THEN place END AS rank FROM placed"""
