"""The registered queries of the numbered operators, each over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table
from .debruijn import remove_repeats as remove_repeated_words
from .decontaminate import contamination, proximity
from .divergence import source_divergence
from .exact import exact_groups
from .language import identify
from .minhash import near_duplicates
from .mixing import mixed
from .pii import BASE, PLAIN, SCORES, SURE, context, find_pii, pii_digest
from .quality import importance_sample
from .sharding import assign_shards
from .suffixes import remove_repeats
from .trie import conversation_trie


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hops")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("first_position"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_order, sum(source_size) OVER () AS total FROM s),
w AS (SELECT *, CAST([3, 1, 2][source_order % 3 + 1] AS BIGINT) AS weight FROM o),
f AS (SELECT *, total * 3 - 2 * coalesce(2 * sum(source_size) OVER (ORDER BY source_size * 1.0e0 / weight, source_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
    2 * sum(weight) OVER (ORDER BY source_size * 1.0e0 / weight, source_order ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM w),
g AS (SELECT *, weight * num >= source_size * 2 * den AS is_full FROM f),
l AS (SELECT num AS lnum, den AS lden FROM g WHERE NOT is_full ORDER BY source_size * 1.0e0 / weight, source_order LIMIT 1),
t AS (SELECT source, source_size, source_order, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE) ELSE CAST(weight * lnum AS DOUBLE) / CAST(lden AS DOUBLE) END AS target FROM g LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.source_order, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(first + size / 2 <= target AS INT) + CAST(source_size + first + size / 2 <= target AS INT) END AS copies, CAST(first AS DOUBLE) / target AS dem FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INT) AS copies,
  CASE WHEN copies > 0 THEN round(CASE source_order % 3
    WHEN 0 THEN least(greatest(dem, 0) * 2 / (1 + sqrt(1.0e0)), 1)
    WHEN 1 THEN CASE WHEN dem >= 0.625 THEN least((dem - 0.625) * 2 / (1 + sqrt(greatest(1 - (dem - 0.625) * 2, 0))) + 0.5, 1)
      ELSE least(dem * 2 / (1.5 + sqrt(greatest(2.25 - dem * 2, 0))), 0.5) END
    ELSE CASE WHEN dem >= 0.375 THEN least((dem - 0.375) * 2 / (1 + sqrt(greatest(1 + (dem - 0.375) * 2, 0))) + 0.5, 1)
      ELSE least(dem * 2 / (0.5 + sqrt(greatest(0.25 + dem * 2, 0))), 0.5) END END, 6) END AS first_position
FROM c
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP5_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM
  (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, s, dw.k FROM dw JOIN (SELECT DISTINCT * FROM iw) iw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _pii_kind_sql(kind: str, rank: int, pattern: str, valid: str, score: int, more: int, words: str) -> str:
    return rf"""
  SELECT doc_id, {rank} AS k, '{kind}' AS kind, b AS s, b + length(f) AS e,
    {score} + CASE WHEN regexp_matches(lower(right(gap, 40)), '{context(words)}') THEN {more} ELSE 0 END AS score
  FROM (SELECT doc_id, ps[i] AS gap, ms[i] AS f, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits, replace(ms[i], ' ', '') AS code,
      list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b
    FROM (SELECT doc_id, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM
      (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM t WHERE regexp_matches(t, '{pattern}'))))
  WHERE {valid} AND ({rank} < {BASE} OR score >= {SURE})"""


_LUHN_SQL = "list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(digits, length(digits) - i, 1) AS INT) ELSE CAST(substr(digits, length(digits) - i, 1) AS INT) * 2 - CASE WHEN CAST(substr(digits, length(digits) - i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_OCTET_SQL = "list_bool_and(list_transform(string_split(f, '.'), lambda x: TRY_CAST(x AS HUGEINT) <= 255))"
_MOD97_SQL = "list_reduce(list_prepend(0, list_transform(string_split(substr(code, 5) || substr(code, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: CASE WHEN x >= 10 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
_VALID_SQL = {"email": "true", "ip": _OCTET_SQL, "card": f"length(digits) BETWEEN 12 AND 19 AND {_LUHN_SQL}", "phone": "length(digits) BETWEEN 9 AND 15", "iban": _MOD97_SQL, "ssn": "NOT regexp_matches(f, '^(000|666|9)|-00-|-0000$')", "secret": "length(digits) >= 4 AND length(regexp_replace(f, '[^A-Za-z]', '', 'g')) >= 4"}
_PII_SQL = " UNION ALL ".join(_pii_kind_sql(kind, n, rf"\b{PLAIN[kind]}\b" if kind in ("iban", "ssn") else PLAIN[kind], _VALID_SQL[kind], *SCORES[kind]) for n, kind in enumerate(PLAIN))

OP7_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_PII_SQL}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, count(*) FILTER (k = 4) AS n_iban, count(*) FILTER (k = 5) AS n_ssn, count(*) FILTER (k = 6) AS n_secret, count(*) AS n_spans,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, k) AS scores FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn, coalesce(n_secret, 0) AS n_secret, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(g.spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN g USING (doc_id)
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), F.col("selected").alias("kept"))



def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


#: Every window as hexadecimal text, its least doc_id, and the bytes outside the union of the covered windows.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING count(*) > 1 AND min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, p FROM w JOIN m USING (win) WHERE doc_id > least),
g AS (SELECT *, sum(CASE WHEN p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), p) AS before FROM c)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
r AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""



def op2_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
x AS (SELECT e.doc_id, count(*) AS n_words, count(g.p) AS n_removed, coalesce(string_agg(e.w[e.p], ' ' ORDER BY e.p) FILTER (g.p IS NULL), '') AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS ln FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
c AS (SELECT e.lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (total + v) AS p, 1 + (1000000000 * (ln + 1)) // (lt + v) AS lp
  FROM t JOIN k ON t.lang = k.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - lp) * (p - lp)) // lp AS BIGINT) AS value FROM p WHERE n > 0 AND p > lp),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: A prefix's key is the list of its turns; crc32 goes bit by bit over the decimal digits, the lowest bit first.
OP13_SQL = r"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_transform(range(0, 8), lambda k: CAST((ascii(x) >> CAST(k AS INT)) & 1 AS BIGINT))))),
    lambda crc, bit: xor(crc >> 1, CASE WHEN (xor(crc, bit) & 1) = 1 THEN 3988292384 ELSE 0 END)) AS rest FROM (SELECT DISTINCT c FROM o)),
h AS (SELECT c, xor(rest, 4294967295) % 4 AS h FROM b),
r AS (SELECT h.c, o.pos, 0 AS part, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.pos <= h.h UNION ALL SELECT h.c, o.pos, 1, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.pos > h.h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, length(role) || ':' || length(text) || ':' || role || text AS turn FROM r),
keys AS (SELECT c, d, w, array_to_string(list(turn) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), '') AS key FROM t UNION ALL SELECT c, 0, 0, '' FROM h),
node AS (SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS cost FROM keys GROUP BY key),
par AS (SELECT DISTINCT a.key, b.key AS parent FROM keys a JOIN keys b ON a.c = b.c AND b.d = a.d - 1),
ch AS (SELECT parent AS key, count(*) AS n_children FROM par GROUP BY parent),
up AS (SELECT DISTINCT b.key AS above, a.key FROM keys a JOIN keys b ON a.c = b.c AND b.d <= a.d),
tot AS (SELECT above AS key, sum(cost) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM up JOIN node USING (key) LEFT JOIN ch USING (key) GROUP BY above),
ends AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM keys) WHERE d = last GROUP BY key)
SELECT node.conv_id, node.depth, pn.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM node JOIN tot USING (key) LEFT JOIN ch USING (key) LEFT JOIN ends USING (key) LEFT JOIN par USING (key) LEFT JOIN node pn ON pn.key = par.parent
"""


QUERIES = {"op13_conversation_trie": op13_conversation_trie, "op11_source_divergence": op11_source_divergence, "op12_byte_bpe": op12_byte_bpe, "op2_debruijn_dedup": op2_debruijn_dedup, "op1_suffix_dedup": op1_suffix_dedup, "op3_minhash": op3_minhash, "op4_exact_dedup": op4_exact_dedup, "op5_decontamination": op5_decontamination, "op5_proximity": op5_proximity, "op6_language_id": op6_language_id, "op7_pii": op7_pii, "op8_quality": op8_quality, "op9_sharding": op9_sharding, "op10_mixing": op10_mixing}
SQL = {"op1_suffix_dedup": OP1_SQL, "op2_debruijn_dedup": OP2_SQL, "op3_minhash": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op7_pii": OP7_SQL, "op10_mixing": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_conversation_trie": OP13_SQL}
