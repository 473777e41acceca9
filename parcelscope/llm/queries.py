"""The registered queries of the operators, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .decontamination import decontamination
from .hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES, hard_negatives
from .html_text import extract_pages
from .masked_lm import pseudo_likelihood
from .near_duplicates import near_duplicates
from .phrases import COVERED, LEAST, LONGEST, SCALE, TOP, phrase_collocations
from .quality_rules import MAX_LOST, MAX_REPEATED, MIN_DOCUMENTS, MIN_WORDS, quality_rules
from .resampling import importance_resampling
from .secret_scan import secret_scan
from .sharding import byte_shards
from .token_counts import token_counts
from .toxicity import ordinal_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).drop("clean_text", "input_row")


QUALITY_SQL = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, text IS NULL AS none FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
n AS (SELECT *, list_transform(ls, lambda x: trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS nl FROM w),
win AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n_repeat FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM
    (SELECT host, t, unnest(nl) AS line FROM n) GROUP BY host, line) f WHERE n > {MIN_DOCUMENTS}),
lost AS (SELECT rid, sum(len(string_split(line, ' '))) AS lost FROM
    (SELECT rid, host, unnest(nl) AS line FROM n) JOIN freq USING (host, line) GROUP BY rid),
q AS (SELECT rid, doc_id, n.host, t, none, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_words
  FROM n LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid)),
rules AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM q)
"""

ORACLES["op1_quality_rules"] = f"""WITH {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_words <= {MAX_LOST}::DOUBLE * n_words AS kept, lost_words FROM rules"""


@_query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_read(spark, sf_dir, "documents"))


@_query
def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_read(spark, sf_dir, "documents"))


@_query
def op5_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


@_query
def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query
def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query
def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(_read(spark, sf_dir, "documents"))


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4)


def near_duplicate_sql(table: str, shingle: int) -> str:
    """Common table expressions up to ``component``: brute force over all pairs that share a shingle."""
    window = " || ' ' || ".join(f"ws[p + {at}]" if at else "ws[p]" for at in range(shingle))
    return rf"""
nd_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table}),
nd_shingle AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, {window} AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {shingle - 2})) AS p FROM nd_words)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM nd_words WHERE len(ws) BETWEEN 1 AND {shingle - 1})),
nd_size AS (SELECT doc_id, count(*) AS n FROM nd_shingle GROUP BY doc_id),
nd_both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM nd_shingle a JOIN nd_shingle b
  ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
nd_link AS (SELECT a, b FROM nd_both JOIN nd_size x ON a = x.doc_id JOIN nd_size y ON b = y.doc_id
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
nd_reach(doc_id, other) AS (SELECT DISTINCT a, a FROM nd_link UNION
  SELECT r.doc_id, l.b FROM nd_reach r JOIN nd_link l ON r.other = l.a),
nd_least AS (SELECT doc_id, min(other) AS least FROM nd_reach GROUP BY doc_id),
nd_component AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id
  FROM {table} d LEFT JOIN nd_size USING (doc_id) LEFT JOIN nd_least USING (doc_id))"""


ORACLES["op10_near_duplicates"] = f"""WITH RECURSIVE {near_duplicate_sql("documents", 4)}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM nd_component"""


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def decontamination_sql(table: str) -> str:
    """Common table expressions up to ``dc_best``: brute force over all windows that share a shingle with an item."""
    shingle = " || ' ' || ".join(f"ws[p + {at}]" if at else "ws[p]" for at in range(5))
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return rf"""
dc_doc AS (SELECT doc_id, {words} AS ws FROM {table}),
dc_item AS (SELECT item_id, {words} AS ws FROM benchmark),
dc_ds AS (SELECT doc_id, n, p, {shingle} AS s
  FROM (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS p FROM dc_doc)),
dc_is AS (SELECT item_id, n, {shingle} AS s
  FROM (SELECT item_id, ws, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS p FROM dc_item)),
dc_in AS (SELECT item_id, n, s, count(*) AS c FROM dc_is GROUP BY ALL),
dc_window AS (SELECT DISTINCT doc_id, item_id, i.n AS size, least(i.n, d.n) AS len,
    unnest(range(greatest(1, p - i.n + 5), least(p, greatest(1, d.n - i.n + 1)) + 1)) AS start
  FROM dc_ds d JOIN dc_in i USING (s)),
dc_count AS (SELECT w.doc_id, w.item_id, w.start, w.len, d.s, count(*) AS c
  FROM dc_window w JOIN dc_ds d ON d.doc_id = w.doc_id AND d.p BETWEEN w.start AND w.start + w.len - 5 GROUP BY ALL),
dc_shared AS (SELECT doc_id, item_id, start, len, sum(k.c) AS nw, sum(least(k.c, coalesce(i.c, 0))) AS shared
  FROM dc_count k LEFT JOIN dc_in i USING (item_id, s) GROUP BY ALL),
dc_size AS (SELECT item_id, sum(c) AS ni FROM dc_in GROUP BY item_id),
dc_found AS (SELECT *, shared / (nw + ni - shared) AS similarity FROM dc_shared JOIN dc_size USING (item_id)
  WHERE 100 * shared >= 80 * (nw + ni - shared)),
dc_best AS (SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(start - 1 AS BIGINT) AS start_word,
    CAST(len AS BIGINT) AS n_words
  FROM dc_found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1)"""


ORACLES["op6_decontamination"] = f"WITH {decontamination_sql('documents')} SELECT * FROM dc_best"


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = _read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, e.rid, e.vec_id, a.label = e.label AS same,
    CAST(list_inner_product(a.q, e.q) AS BIGINT) AS score FROM e a JOIN e ON a.rid <> e.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, anchor_id, rid, vec_id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid) AS INT) AS rank
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}"""


@_query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(_read(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, ws[p : p + {n - 1}] AS g FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS p FROM w)"
    for n in range(1, LONGEST + 1)
)
ORACLES["op13_phrase_collocations"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM d),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, g, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
cut AS (SELECT c.lang, c.g, a, k, l.f AS l, r.f AS r,
    CAST({SCALE}::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[: k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 :]),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, g[p : p + n - 1] AS g, max(a) AS longer FROM (SELECT *, unnest(range(1, len(g) - n + 2)) AS p
    FROM (SELECT lang, g, a, unnest(range(2, len(g))) AS n FROM c)) GROUP BY ALL),
o AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, a, l, r, score FROM s LEFT JOIN i ON i.lang = s.lang AND i.g = s.g
  WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score FROM o JOIN t USING (lang) QUALIFY rank <= {TOP}"""


def _crc_entry(half: int) -> int:
    """What four zero bits behind ``half`` do to a CRC-32."""
    for _ in range(4):
        half = half >> 1 ^ (0xEDB88320 if half & 1 else 0)
    return half


# DuckDB has no CRC-32: the halves of all bytes, lower half first, are folded one after the other.
ORACLES["op4_byte_shards"] = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, CAST(strlen(t) + 1 AS BIGINT) AS size, list_transform(string_split(hex(encode(t)), ''),
  lambda x: CAST(instr('0123456789ABCDEF', x) - 1 AS BIGINT)) AS half FROM t),
c AS (SELECT rid, doc_id, size, CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295::BIGINT],
  list_transform(range(len(half)), lambda i: half[xor(i, 1) + 1])),
  lambda c, x: xor(c >> 4, ({[_crc_entry(half) for half in range(16)]}::BIGINT[])[(xor(c, x) & 15) + 1])),
  4294967295::BIGINT) END AS text_crc32 FROM n),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size, rid
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST(least(15, (2 * before + size) * 16 // (2 * total)) AS INT) AS shard FROM s)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size, rid) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard FROM p"""
