"""Registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelpick.llm import (bpe, decontaminate, jaccard_join, line_dedup, lm_scores, manifest, preferences, resample,
                           secrets, sketch, token_counts, topk, toxicity)
from labelpick.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- pieces of SQL ----------------------------------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# the table of crc32, and the crc32 of a list of bytes
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""
CRC = "xor(list_reduce({}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def sql_bytes(text: str) -> str:
    return f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:-2], " \
           "lambda x: ('0x' || x)::BIGINT)"


def sql_words(text: str) -> str:
    """Words of a text; null has none."""
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


# ---- queries ----------------------------------------------------------------------------------------------------------

@query("op1_lm_scores")
def op1_lm_scores(spark, folder):
    return lm_scores.score_documents(documents(spark, folder), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


OP2_SQL = '''
WITH conv AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
pair AS (SELECT a.conv_id AS pair_id, a.turns AS c, list_concat(a.turns[1:len(a.turns) - 1],
    coalesce(b.turns[len(b.turns):], [])) AS r
  FROM conv a LEFT JOIN conv b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
cut AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])[1] - 1,
    least(len(c), len(r))) AS n FROM pair),
parts AS (SELECT pair_id, n, c[1:n] AS shared, c[n + 1:] AS c, r[n + 1:] AS r FROM cut),
side AS (SELECT pair_id, 'c' AS side, unnest(c) AS t, generate_subscripts(c, 1) AS i FROM parts UNION ALL
  SELECT pair_id, 'r', unnest(r), generate_subscripts(r, 1) FROM parts UNION ALL
  SELECT pair_id, 's', unnest(shared), generate_subscripts(shared, 1) FROM parts),
line AS (SELECT pair_id, side, i, t.role AS role, t.text AS text,
    '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS line FROM side),
placed AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, side ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(role) + 13 AS start FROM line),
text AS (SELECT pair_id, side, string_agg(line, '' ORDER BY i) AS text,
    coalesce(string_agg(start || ':' || (start + length(text) + 11), ',' ORDER BY i) FILTER (role = 'assistant'), '') AS mask
  FROM placed GROUP BY pair_id, side)
SELECT p.pair_id, p.n AS n_common, coalesce(s.text, '') AS prompt, coalesce(c.text, '') AS chosen,
  coalesce(r.text, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM parts p LEFT JOIN text s ON s.pair_id = p.pair_id AND s.side = 's'
LEFT JOIN text c ON c.pair_id = p.pair_id AND c.side = 'c' LEFT JOIN text r ON r.pair_id = p.pair_id AND r.side = 'r'
'''

OP6_SQL = '''
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
'''


@query("op2_preferences", OP2_SQL)
def op2_preferences(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    return preferences.format_pairs(preferences.neighbour_pairs(turns))


OP3_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS MATERIALIZED (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
key AS MATERIALIZED (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  '{UPPER}', '{LOWER}') AS key FROM line),
often AS MATERIALIZED (SELECT key FROM key WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM key LEFT JOIN often o USING (key) GROUP BY r
"""

OP7_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
b AS MATERIALIZED (SELECT coalesce(item_id::VARCHAR, '') AS item, {sql_words('text')} AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS part FROM (SELECT item, w, least(len(w), 10) AS k,
  unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS part FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM d, (SELECT DISTINCT k FROM bw))),
hit AS MATERIALIZED (SELECT r, i, k, item FROM dw JOIN bw USING (k, part)),
place AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(place.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(place.n, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (r) LEFT JOIN item USING (r)
"""


@query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark, folder):
    return line_dedup.line_report(documents(spark, folder), min_docs=10, min_chars=1)


@query("op4_jaccard_join")
def op4_jaccard_join(spark, folder):
    return jaccard_join.near_duplicates(documents(spark, folder), n=5, threshold=0.8)


@query("op5_token_counts")
def op5_token_counts(spark, folder):
    return token_counts.count_tokens(documents(spark, folder), tokenizer_path("word_bpe_49k.json"), limit=2048)


@query("op6_topk", OP6_SQL)
def op6_topk(spark, folder):
    return topk.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), k=5, every=50)


@query("op7_decontaminate", OP7_SQL)
def op7_decontaminate(spark, folder):
    return decontaminate.scan_benchmark(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"),
                                        window=10)


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    return toxicity.score_toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"),
                                   threshold=0.3)


@query("op9_secrets")
def op9_secrets(spark, folder):
    return secrets.scan_secrets(documents(spark, folder))


@query("op10_bpe")
def op10_bpe(spark, folder):
    return bpe.round_trip(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"))


def sql_sketch(words: str) -> str:
    """The sorted digests of a text's sketch, from its words."""
    run = " || ' ' || ".join(f"{words}[i + {j}]" for j in range(sketch.SHINGLE))
    every = (f"(CASE WHEN len({words}) >= {sketch.SHINGLE} THEN list_transform(range(1, len({words}) - {sketch.SHINGLE - 2}), "
             f"lambda i: md5({run})[:{sketch.DIGITS}]) WHEN len({words}) > 0 THEN "
             f"[md5(array_to_string({words}, ' '))[:{sketch.DIGITS}]] ELSE [] END)")
    low = f"list_sort(list_distinct(list_filter({every}, lambda h: h < '{sketch.limit()}')))"
    return f"CASE WHEN len({low}) > 0 THEN {low} WHEN len({words}) > 0 THEN [list_min({every})] ELSE [] END"


def sql_likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {both} / (len({a}) + len({b}) - {both})::DOUBLE END")


OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
  row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS i, count(*) OVER () AS rows FROM documents),
e AS MATERIALIZED (SELECT a.i, b.i AS k, a.doc_id, a.n, a.text, substr(a.text, 1, a.n - a.n // 3) || substr(b.text, 1, a.n // 3)
  AS edited FROM d a JOIN d b ON b.i = a.i % a.rows + 1),
w AS MATERIALIZED (SELECT i, k, doc_id, n, edited, {sql_words('text')} AS w, {sql_words('edited')} AS x FROM e),
s AS MATERIALIZED (SELECT i, k, doc_id, n, edited, {sql_sketch('w')} AS s, {sql_sketch('x')} AS t FROM w)
SELECT a.doc_id, a.n AS n_chars, sha256(a.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint,
  array_to_string(a.t, '') AS edited_fingerprint, {sql_likeness('a.s', 'a.t')} AS near_edited,
  {sql_likeness('a.s', 'b.s')} AS near_next FROM s a JOIN s b ON b.i = a.k
"""


OP12_SQL = f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS w FROM benchmark) GROUP BY w),
code AS MATERIALIZED (SELECT w, {CRC.format(sql_bytes('w'))} % 10000 AS b
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT b, sum(n) AS s FROM dw JOIN code USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM bw JOIN code USING (w) GROUP BY b),
f AS (SELECT b, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM f) + 10000)
  / ((s + 1) * ((SELECT sum(t) FROM f) + 10000))))::BIGINT AS g FROM f),
m AS (SELECT r, sum(n * g)::BIGINT AS total, sum(n)::BIGINT AS n FROM dw JOIN code USING (w) JOIN gain USING (b) GROUP BY r),
x AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n)::BIGINT, 0) AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT r, doc_id, n_features, weight,
  weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
  FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""


def sql_field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def sql_tree(name: str, leaves: str) -> str:
    """(g, h, i, node): all levels of the trees over ``leaves`` (g, i, node)."""
    return f"""{name} AS (SELECT g, 0 AS h, i, node FROM {leaves} UNION ALL
  SELECT g, h + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)) FROM (
    SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {name}) WHERE m > 1 GROUP BY g, h, i // 2)"""


def sql_paths(name: str, tree: str, leaves: str) -> str:
    """(g, i, path): the levels of every leaf's proof."""
    return f"""{name} AS MATERIALIZED (SELECT g, i, list(level ORDER BY h) AS path FROM (SELECT l.g, l.i, t.h, string_agg(
  CASE WHEN t.i = l.i >> t.h THEN '*' ELSE t.node END, '' ORDER BY t.i) AS level FROM {leaves} l JOIN (SELECT *, max(h) OVER (
  PARTITION BY g) AS top FROM {tree}) t ON t.g = l.g AND t.h < t.top AND t.i // 2 = l.i >> (t.h + 1) GROUP BY l.g, l.i, t.h)
  GROUP BY g, i)"""


_FIELDS = [sql_field(c) for c in manifest.FIELDS]
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(concat({', '.join(_FIELDS)})) AS node,
  sha256(concat({', '.join([*_FIELDS[:3], sql_field('(n_chars + 1)'), *_FIELDS[4:]])})) AS now FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM d),
{sql_tree('tree', 'l')},
sub AS MATERIALIZED (SELECT g AS of, arg_max(node, h) AS node FROM tree GROUP BY g),
s AS MATERIALIZED (SELECT '' AS g, of, node, row_number() OVER (ORDER BY of) - 1 AS i FROM sub),
{sql_tree('upper_tree', 's')},
{sql_paths('p', 'tree', 'l')},
{sql_paths('q', 'upper_tree', 's')},
root AS (SELECT arg_max(node, h) AS root FROM upper_tree),
a AS (SELECT l.doc_id, l.node AS leaf, s.node AS subroot, root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path,
  CASE WHEN {CRC.format(sql_bytes('l.doc_id::VARCHAR'))} % 7 = 0 THEN now ELSE l.node END AS now
  FROM l JOIN s ON s.of = l.g LEFT JOIN p ON p.g = l.g AND p.i = l.i LEFT JOIN q ON q.i = s.i, root, crc),
f AS (SELECT *, list_reduce(path, lambda x, level: sha256(replace(level, '*', x)), now) AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '*', '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM f
"""


@query("op11_fingerprints", OP11_SQL)
def op11_fingerprints(spark, folder):
    return sketch.fingerprint_report(documents(spark, folder), shingle=5, fraction=sketch.FRACTION)


@query("op12_resample", OP12_SQL)
def op12_resample(spark, folder):
    return resample.resample_report(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), max_n=1,
                                    buckets=10_000, min_words=20, percent=10, seed=2024)


@query("op13_manifest", OP13_SQL)
def op13_manifest(spark, folder):
    return manifest.tamper_report(documents(spark, folder), every=7, fanout=2)
