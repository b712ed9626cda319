"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.llm import alignment, decontaminate, edit_counts, ngram_join, packing, periodic_runs, pq_dedup, secrets, sharding, token_files, toxicity, url_cascade, warc
from fleetcast.llm.frames import new_folder

Query = Callable[[SparkSession, str], DataFrame]

# fixed values: the url rules
URL_RULES = (
    url_cascade.Rule("net", "/", "block"),
    url_cascade.Rule("example.net", "/en/", "allow"),
    url_cascade.Rule("example.com", "/de/", "block"),
    url_cascade.Rule("org", "/fr/", "allow"),
)


BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
SHARDS = 40
END_ID = 2
TOXIC_FROM = 0.7

#: personal data that the edit query redacts: mail addresses and long numbers
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9 ()-]{6,}[0-9]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are tokens of the vocabulary, and one for the end id of a text that has any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.token_count(F.col("text"), public_tokenizers.path(BYTE_BPE)), tie=F.xxhash64("text"))


def op2_word_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limits and batches over words, which SQL can count too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.word_count(F.col("text")))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after all mail addresses and long numbers are redacted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path(BYTE_BPE)
    states = edit_counts.state_table(docs, vocabulary)
    edited = docs.withColumn("edits", edit_counts.redactions(F.col("text"), PERSONAL, "<redacted>"))
    return edit_counts.recount_edited(edited, states, vocabulary)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.size("toxicity.passages").cast("long").alias("n_passages"),
    )


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark, "tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path(BYTE_BPE), end_id=END_ID)
    return token_files.read_token_index(spark, path)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are a minute apart in the order of page_id; the table has no times of its own."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = new_folder(spark, "warc")
    minute = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0)) * 60)
    warc.write_archives(pages, path, captured_at=minute)
    return warc.merge_index(warc.read_index(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position"
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.secrets_summary(secrets.find_secrets(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_summary(found)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_groups(docs, SHARDS)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.periodic_runs(docs, seed=F.crc32(F.col("doc_id").cast("string")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokenizers(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_length_buckets": op2_length_buckets,
    "op2_word_buckets": op2_word_buckets,
    "op3_edit_counts": op3_edit_counts,
    "op4_toxicity": op4_toxicity,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_token_files": op6_token_files,
    "op7_url_filter": op7_url_filter,
    "op8_warc_index": op8_warc_index,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontaminate": op10_decontaminate,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_alignment": op13_alignment,
}

_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT {id} AS n, {id} AS r FROM {table} UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)"""

def _limits_sql(buckets: int) -> str:
    """The dynamic program over x(i, l, cum), a step a bucket; each row carries its limits so far."""
    steps = ["d1 AS (SELECT i, l, cum, l * cum AS cost, [l] AS path FROM x)"]
    for k in range(2, buckets + 1):
        steps.append(
            f"""d{k} AS (
  SELECT p.i, p.l, p.cum, CASE WHEN s.cost < p.cost THEN s.cost ELSE p.cost END AS cost, CASE WHEN s.cost < p.cost THEN s.path ELSE p.path END AS path
  FROM d{k - 1} p LEFT JOIN (
    SELECT i, min(cost) AS cost, arg_min(path, cost * 100000 + j) AS path
    FROM (SELECT x.i, q.i AS j, q.cost + x.l * (x.cum - q.cum) AS cost, list_append(q.path, x.l) AS path FROM x JOIN d{k - 1} q ON q.i < x.i)
    GROUP BY i) s ON s.i = p.i)"""
        )
    return ",\n".join(steps)


ORACLES: dict[str, str] = {
    "op2_word_buckets": r"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS k FROM documents),
t AS (SELECT doc_id, CASE WHEN k > 0 THEN k + 1 ELSE 0 END AS n FROM w),
r AS (
  SELECT doc_id, chunk, least(2048, n - chunk * 2048) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / 2048.0) AS BIGINT), 1))) AS chunk FROM t)),
h AS (SELECT CAST(ceil(n_tokens / 16.0) * 16 AS BIGINT) AS l, count(*) AS c FROM r WHERE n_tokens > 0 GROUP BY 1),
x AS (SELECT row_number() OVER (ORDER BY l) AS i, l, CAST(sum(c) OVER (ORDER BY l) AS BIGINT) AS cum FROM h),
""" + _limits_sql(packing.BUCKETS) + f""",
lim AS (SELECT unnest(path) AS b FROM (SELECT path FROM d{packing.BUCKETS} ORDER BY i DESC LIMIT 1)),
p AS (SELECT doc_id, chunk, n_tokens, CASE WHEN n_tokens > 0 THEN (SELECT min(b) FROM lim WHERE b >= n_tokens) END AS bucket FROM r),
q AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, chunk) - 1 AS place, greatest(1, 32768 // bucket) AS per FROM p)
SELECT doc_id, chunk, n_tokens, bucket, CASE WHEN bucket IS NOT NULL THEN place // per END AS batch,
  CASE WHEN bucket IS NOT NULL THEN place % per END AS slot FROM q""",
    "op1_ngram_join": r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
""" + _REACH.format(id="doc_id", table="documents") + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.n = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)""",
    "op5_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
""" + _REACH.format(id="vec_id", table="embeddings") + """,
c AS (SELECT n AS vec_id, min(r) AS component_id FROM reach GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op8_warc_index": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h HAVING count(*) > 1),
k AS (
  SELECT page_id, n, sha1(p.h) AS digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS kind,
    CASE WHEN page_id <> first THEN first END AS refers_to, regexp_replace(url, '^[^:/?#]*://', '', 's') AS bare
  FROM p LEFT JOIN f ON p.h = f.h),
u AS (
  SELECT *, array_to_string(list_reverse(string_split(translate(regexp_extract(bare, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '.')), ',') || ')' || regexp_extract(bare, '^[^/?#]*(.*)$', 1, 's') AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
  FROM k)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, kind AS record_type, refers_to, url_key, captured_at,
  row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS position FROM u""",
    "op7_url_filter": r"""
WITH u AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
traps AS (SELECT host, path FROM u GROUP BY ALL HAVING count(DISTINCT url) >= 3),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
    max_by(v, length(rhost || rpath)) AS v
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY u.page_id, u.host, u.path, u.url)
SELECT m.page_id, m.host, m.path, rule,
  coalesce(v, CASE WHEN t.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN traps t ON m.host = t.host AND m.path = t.path""",
    "op10_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n,
          unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
occ AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT o.doc_id, o.i, o.n, wins.item_id FROM occ o JOIN wins USING (n, win)),
per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
