"""Registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import digests, tokenize
from .decontaminate import find_leaks
from .language_id import identify_languages
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mtree import top_k
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .toxicity import score_toxicity
from .url_filter import filter_urls

#: host, path, action
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, action string")
    return filter_urls(_read(spark, sf_dir, "pages"), rules)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), k=3, radius=3)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(tokenize(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_decontamination, op4_line_dedup, op5_language_id, op6_top_k, op7_simhash, op8_toxicity, op9_bpe, op10_license_scan)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS x FROM d, unnest(range(length(h) // 2 - 99)) t(i) WHERE length(h) >= 200),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
runs AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER o + 100 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM spans
         UNION ALL SELECT doc_id, max(z), 1000000000 FROM spans GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.z - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
n AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n.removed, 0)::BIGINT AS n_removed, coalesce(n.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op2_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM p),
u AS (SELECT page_id, {_LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM q),
r(rh, rp, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
""",
    "op3_decontamination": f"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, i AS p, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM dw, unnest(range(greatest(0, len(w) - 4))) t(i)),
iss AS (SELECT item_id, len(w) - 4 AS m, i AS q, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM iw, unnest(range(greatest(0, len(w) - 4))) t(i)),
n AS (SELECT doc_id, len(w) - 4 AS n FROM dw),
ic AS (SELECT item_id, m, s, count(*) AS c FROM iss GROUP BY ALL),
hits AS (SELECT doc_id, item_id, m, n, p, s, c FROM ds JOIN n USING (doc_id) JOIN ic USING (s)),
win AS (SELECT DISTINCT doc_id, item_id, m, n, start FROM hits, unnest(range(greatest(p - m + 1, 0), least(p, greatest(n - m, 0)) + 1)) t(start)),
o AS (SELECT doc_id, item_id, w.m, w.n, start, s, least(count(*), any_value(c)) AS k FROM win w JOIN hits h USING (doc_id, item_id) WHERE p >= start AND p < start + w.m GROUP BY ALL),
sim AS (SELECT doc_id, item_id, m, n, start, sum(k) AS o FROM o GROUP BY ALL)
SELECT doc_id, item_id, round(max(o::DOUBLE / (least(m, n) + m - o)), 6) AS similarity FROM sim WHERE o::DOUBLE / (least(m, n) + m - o) >= 0.8 GROUP BY doc_id, item_id
""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)),
k AS (SELECT doc_id, i, line, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT *, key IN (SELECT key FROM c) AS gone FROM k) GROUP BY doc_id
""",
    "op6_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
