"""The operators over the driver's tables, with production parameters, and what SQL can say of their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, compression_classifier, exact_dedup, html_extract, minhash_dedup, ngram_join, packing, quality_rules, secrets, substring_dedup, url_filters, whitening
from helixframe.sources.tables import spread

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = compression_classifier.fit(docs, _read(spark, sf_dir, "labels"))
    out = compression_classifier.score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # no doc_id: not in the held-out part
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), k=5, percent=75)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents")).drop("nearest", "class_distance", "word_distance")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_read(spark, sf_dir, "documents"), RANKS, PATTERN)
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("found").alias("spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), components=16)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_compression_classifier, op3_ngram_jaccard_join, op4_url_filters, op5_exact_dedup, op6_packing, op7_byte_bpe, op8_html_extraction, op9_quality_rules, op10_secret_scans, op11_embedding_whitening, op12_minhash_dedup)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _near_sql(k: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of k-word shingles are similar."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {k - 1}], ' ') AS g, len(w) < {k} AS short FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {k - 1}))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.short = b.short AND a.doc_id != b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON reach.r = link.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id{more}
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""


SQL = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
low AS (SELECT win, min(doc_id) AS m FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS i FROM wins JOIN low USING (win) WHERE m < doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_ngram_jaccard_join": _near_sql(5, 75),
    "op5_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)""",
    "op12_minhash_dedup": _near_sql(3, 85, ", d.doc_id = min(r) AS kept"),
}


def _op4_sql(rounds: int = 12, damping: float = 0.85, threshold: float = 0.5) -> str:
    """The same ranks, a common table expression for each round."""
    fits = lambda rule: f"(host = '{rule.split('/')[0]}' OR ends_with(host, '.{rule.split('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    cases = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in sorted(URL_RULES, key=lambda x: (-len(x[1]), x[1])))
    allow = ", ".join(f"'{r}'" for a, r in URL_RULES if a == "allow")
    steps = ["r0 AS MATERIALIZED (SELECT kind, host, seed AS x FROM seeds)"]
    for i in range(rounds):
        got = f"SELECT flow.kind AS kind, dst AS host, {damping} * sum(x * w) AS got, 0.0 AS seed FROM r{i} JOIN flow ON flow.kind = r{i}.kind AND flow.src = r{i}.host GROUP BY 1, 2"
        steps.append(f"g{i} AS MATERIALIZED (SELECT kind, host, sum(got) AS got, sum(seed) AS seed FROM ({got} UNION ALL SELECT kind, host, 0.0, seed FROM seeds) GROUP BY 1, 2)")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT kind, host, got + rest * seed AS x FROM g{i} JOIN (SELECT kind, 1 - sum(got) AS rest FROM g{i} GROUP BY kind) USING (kind))")
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
j AS MATERIALIZED (SELECT *, CASE {cases} END AS rule FROM u),
hosts AS (SELECT host, bool_or(coalesce(rule IN ({allow}), false)) AS ok, host = 'net' OR ends_with(host, '.net') AS bad FROM j WHERE host != '' GROUP BY host),
s0 AS (SELECT CASE WHEN bad THEN 'distrust' ELSE 'trust' END AS kind, host FROM hosts WHERE bad OR ok),
seeds AS MATERIALIZED (SELECT kind, host, 1 / count(*) OVER (PARTITION BY kind) AS seed FROM s0),
found AS (SELECT host, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)) AS t FROM j WHERE host != '')),
e AS (SELECT host, dst, count(*) AS n FROM found WHERE host != dst GROUP BY 1, 2),
links AS (SELECT 'trust' AS kind, host AS src, dst, n FROM e UNION ALL SELECT 'distrust', dst, host, n FROM e),
flow AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM links),
{", ".join(steps)},
ranks AS (SELECT host, coalesce(sum(x * size) FILTER (kind = 'distrust'), 0) / {1 - damping} AS d, coalesce(sum(x * size) FILTER (kind = 'trust'), 0) / {1 - damping} AS t
  FROM r{rounds} JOIN (SELECT kind, count(*) AS size FROM seeds GROUP BY kind) USING (kind) GROUP BY host)
SELECT page_id, j.host, path, rule, CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL OR (d >= {threshold} AND d > t) THEN 'block' ELSE 'allow' END AS verdict
FROM j LEFT JOIN ranks ON ranks.host = j.host"""


SQL["op4_url_filters"] = _op4_sql()
