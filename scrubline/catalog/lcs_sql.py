"""SQL of the character similarity: common table expressions for DuckDB.

The longest common subsequence is a fold over one text's characters with a bit for each place of the other, so
texts of up to 120 characters are meant.
"""

TOKENS = "list_sort(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' +'), lambda x: x <> ''))"


def token_sorted_sql(text: str) -> str:
    return f"array_to_string({TOKENS.format(text)}, ' ')"


def ratio_sql(n: str, lengths: str) -> str:
    return f"round_even(200.0 * {n} / {lengths}, 0)"


# needs pairs(id, sa, sb); gives ratios(id, similarity)
RATIOS = f"""
places AS (SELECT id, map(list(ch), list(bits)) AS bitmap FROM (
    SELECT id, ch, sum(1::HUGEINT << (pos - 1)::HUGEINT)::HUGEINT AS bits
    FROM (SELECT id, unnest(string_split(sa, '')) AS ch, generate_subscripts(string_split(sa, ''), 1) AS pos FROM pairs) GROUP BY ALL) GROUP BY id),
common AS (SELECT id, length(sa) + length(sb) AS l, length(sa) - bit_count(list_reduce(list_prepend(whole,
    list_transform(string_split(sb, ''), lambda c: coalesce(bitmap[c], 0::HUGEINT))), lambda v, m: ((v + (v & m)) | (v - (v & m))) & whole)) AS n
    FROM (SELECT *, (1::HUGEINT << length(sa)::HUGEINT) - 1 AS whole FROM pairs JOIN places USING (id))),
ratios AS (SELECT id, CAST({ratio_sql("n", "l")} AS INT) AS similarity FROM common)"""


def similar_sql(threshold: int) -> str:
    """Needs texts(id, s), s different in each row; gives edges(a, b, similarity), a < b, at or above the threshold."""
    t = (threshold - 0.5) / 100
    ratio = ratio_sql("n", "(la + lb)")
    return f"""
masks AS MATERIALIZED (SELECT id, map(list(ch), list(bits)) AS bitmap FROM (
    SELECT id, ch, sum(1::HUGEINT << (pos - 1)::HUGEINT)::HUGEINT AS bits
    FROM (SELECT id, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) AS pos FROM texts) GROUP BY ALL) GROUP BY id),
close AS MATERIALIZED (SELECT a.id AS a, b.id AS b, length(a.s) AS la, length(b.s) AS lb, (1::HUGEINT << length(a.s)::HUGEINT) - 1 AS whole, bitmap,
    string_split(b.s, '') AS chars FROM texts a JOIN texts b ON a.id < b.id AND 2 * least(length(a.s), length(b.s)) >= {t} * (length(a.s) + length(b.s)) - 1e-9
    AND levenshtein(a.s, b.s) <= {1 - t} * (length(a.s) + length(b.s)) + 1e-9 JOIN masks ON masks.id = a.id),
scored AS (SELECT a, b, la, lb, la - bit_count(list_reduce(list_prepend(whole, list_transform(chars, lambda c: coalesce(bitmap[c], 0::HUGEINT))),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & whole)) AS n FROM close),
edges AS MATERIALIZED (SELECT a, b, CAST({ratio} AS INT) AS similarity FROM scored WHERE {ratio} >= {threshold})"""


# needs before(b, a), a < b; gives down(id): vertices with an earlier neighbour that is not down
FALLEN = """
turns AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b) AS k, b, list(a) AS earlier FROM before GROUP BY b),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
    SELECT t.k, CASE WHEN len(list_filter(t.earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, t.b) ELSE gone END
    FROM walk JOIN turns t ON t.k = walk.k + 1),
down AS MATERIALIZED (SELECT unnest(gone) AS id FROM walk WHERE k = (SELECT max(k) FROM walk))"""


def groups_sql(table: str, row_id: str, text: str, threshold: int = 90) -> str:
    """Recursive common table expressions; gives members(leader_id, member_id, similarity) of the greedy grouping."""
    return f"""WITH RECURSIVE r AS (SELECT {row_id} AS id, {text} AS s FROM {table}),
texts AS MATERIALIZED (SELECT min(id) AS id, s FROM r GROUP BY s), {similar_sql(threshold)},
before AS (SELECT b, a FROM edges), {FALLEN},
led AS (SELECT b AS id, min(a) AS leader, arg_min(similarity, a) AS similarity FROM edges
    WHERE a NOT IN (SELECT id FROM down) AND b IN (SELECT id FROM down) GROUP BY b),
members AS (SELECT coalesce(led.leader, texts.id) AS leader_id, r.id AS member_id, CAST(coalesce(led.similarity, 100) AS INT) AS similarity
    FROM r JOIN texts USING (s) LEFT JOIN led ON led.id = texts.id WHERE coalesce(led.leader, texts.id) <> r.id)"""


def mapping_sql(table: str, column: str, threshold: int = 80) -> str:
    """raw, canonical, similarity and n of every value that is merged into another."""
    return f"""WITH RECURSIVE raws AS (SELECT trim({column}) AS v, count(*) AS n, {token_sorted_sql(f"trim({column})")} AS s FROM {table} WHERE {column} IS NOT NULL GROUP BY 1),
vals AS MATERIALIZED (SELECT v, n, s, row_number() OVER (ORDER BY n DESC, v) AS pos FROM raws WHERE s <> ''),
texts AS MATERIALIZED (SELECT min(pos) AS id, s FROM vals GROUP BY s), {similar_sql(threshold)},
placed AS MATERIALIZED (SELECT pos, n, id FROM vals JOIN texts USING (s)),
alike AS (SELECT a, b, similarity FROM edges UNION ALL SELECT b, a, similarity FROM edges UNION ALL SELECT id, id, 100 FROM texts),
links AS MATERIALIZED (SELECT x.pos AS v, y.pos AS c, similarity FROM alike JOIN placed x ON x.id = a JOIN placed y ON y.id = b WHERE x.pos <> y.pos AND y.n >= x.n),
doomed AS MATERIALIZED (SELECT DISTINCT v FROM links WHERE c > v),
before AS (SELECT v AS b, c AS a FROM links WHERE v NOT IN (FROM doomed) AND c NOT IN (FROM doomed)), {FALLEN},
mapped AS (SELECT v FROM doomed UNION SELECT id FROM down),
best AS (SELECT v, arg_max(c, similarity::BIGINT * 1000000000 - c) AS c, max(similarity) AS similarity FROM links WHERE c > v OR c NOT IN (FROM mapped) GROUP BY v)
SELECT x.v AS raw, y.v AS canonical, CAST(best.similarity AS INT) AS similarity, x.n AS n FROM best JOIN vals x ON x.pos = best.v JOIN vals y ON y.pos = best.c"""
