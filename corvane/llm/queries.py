"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, html_text, jaccard, langid, quality, ranked, recompress, secrets, suffixes, urls
from .common import table

#: (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} AS rules(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality": op2_quality,
        "op3_jaccard": op3_jaccard,
        "op4_url_filter": op4_url_filter,
        "op5_bpe": op5_bpe,
        "op6_repeats": op6_repeats,
        "op7_decontaminate": op7_decontaminate,
        "op8_html_text": op8_html_text,
        "op9_neighbours": op9_neighbours,
        "op10_secrets": op10_secrets,
        "op11_ranked": op11_ranked,
        "op12_word_repeats": op12_word_repeats,
    }


ORACLE_SQL = {
    "op4_url_filter": f"""
WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id,
         coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
  FROM split),
judged AS (
  SELECT page_id, host, path,
         (SELECT arg_max(struct_pack(rule := h || p, verdict := v), length(h || p) * 1000 + length(h)) FROM rules
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS hit
  FROM parts)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM judged
""",
}

ORACLE_SQL["op7_decontaminate"] = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
places AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS q FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[q + 1:q + 10], ' ') AS win FROM places),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, n, w, unnest(range(0, len(w) - n + 1)) AS s FROM lowered, sizes WHERE len(w) >= n),
grams AS (SELECT r, n, s, array_to_string(w[s + 1:s + n], ' ') AS win FROM starts),
hits AS (SELECT g.r, g.s, g.n, b.item_id FROM grams g JOIN windows b ON g.n = b.n AND g.win = b.win),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r),
tokens AS (SELECT r, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM lowered),
counts AS (SELECT t, count(*) AS n FROM tokens GROUP BY t),
ranges AS (SELECT row_number() OVER () AS i, w FROM (SELECT DISTINCT item_id, w FROM items WHERE len(w) > 0)),
spans AS (SELECT i, q, w[q + 1:q + 10] AS win FROM (SELECT i, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS q FROM ranges)),
rated AS (
  SELECT i, q, any_value(win) AS win, arg_min(t, (coalesce(n, 0), o)) AS t, min(coalesce(n, 0)) AS least
  FROM (SELECT i, q, win, unnest(win) AS t, unnest(range(0, len(win))) AS o FROM spans) LEFT JOIN counts USING (t) GROUP BY i, q),
close AS (
  SELECT r, count(DISTINCT i) AS n_near
  FROM (SELECT t, r, p, w[greatest(p - 14, 0) + 1:p + 15] AS ctx FROM tokens JOIN lowered USING (r) WHERE t IN (SELECT t FROM rated)) JOIN rated USING (t)
  WHERE least > 0 AND list_has_all(ctx, win) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM lowered LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN close USING (r)
"""
ORACLE_SQL["op3_jaccard"] = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS k FROM cut WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 5], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
ORACLE_SQL["op6_repeats"] = r"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
texts AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n_bytes FROM raw),
places AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS k FROM texts)),
owners AS (SELECT win, min(doc_id) AS owner FROM places GROUP BY win),
hits AS (SELECT doc_id, k FROM places JOIN owners USING (win) WHERE doc_id > owner),
marked AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER w > 50 THEN 1 ELSE 0 END AS new FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
grouped AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM marked),
runs AS (SELECT doc_id, g, min(k) AS s, max(k) + 50 AS e FROM grouped GROUP BY ALL),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head, max(e) AS tail
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
ORACLE_SQL["op11_ranked"] = r"""
WITH tokens AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
asked AS (
  SELECT DISTINCT i, item_id, t FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))),
sizes AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM tokens GROUP BY r),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
postings AS (SELECT t, r, count(*) AS tf FROM tokens WHERE t IN (SELECT t FROM asked) GROUP BY t, r),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY t),
scores AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // l)))))::BIGINT AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t) JOIN sizes USING (r), totals GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
ORACLE_SQL["op12_word_repeats"] = r"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, doc_id, k, array_to_string(w[k + 1:k + 13], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(0, len(w) - 12)) AS k FROM cut)),
owners AS (SELECT win, min(doc_id) AS owner FROM places GROUP BY win),
hits AS (SELECT r, k FROM places JOIN owners USING (win) WHERE doc_id > owner),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(k, k + 13)) AS p FROM hits)),
kept AS (
  SELECT r, count(g.p) AS n, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE g.p IS NULL), '') AS t
  FROM (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM cut) LEFT JOIN gone g USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM cut LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
