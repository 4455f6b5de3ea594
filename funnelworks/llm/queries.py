"""The thin queries that apply the operators to the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiling import leaks

    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "covered", F.size("tiles").alias("n_tiles"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(_table(spark, sf_dir, "documents")).select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), "confirmed", F.round("similarity", 6).alias("similarity"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fertility import quality_rules

    judged = quality_rules(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "chars_per_token", "chars_per_rank_token", "byte_share", "token_entropy")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    placed = shard_documents(_table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _remainder(of: int) -> Column:
    """crc32 of doc_id as text, mod ``of``; -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(-1))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    documents = _table(spark, sf_dir, "documents")
    model = train(documents, _table(spark, sf_dir, "labels").where(_remainder(4) != 2))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_windows")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import perplexities

    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexities(_table(spark, sf_dir, "documents"), trusted)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import label_languages, train

    documents = _table(spark, sf_dir, "documents")
    model = train(documents.where(_remainder(5) != 0))
    labelled = label_languages(documents, model)
    return labelled.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents")).select("doc_id", "other_doc_id", "start", "end", "other_start", "other_end", F.round("identity", 4).alias("identity"))


#: The rules of ``op11_url_filter``: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import build_list, judge_urls

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), build_list(rules))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_best_fit_packing, op3_license_scan, op4_quality_rules, op5_sharding, op6_toxicity, op7_ngram_jaccard_join, op8_quality_classifier, op9_language_id, op10_substring_dedup, op11_url_filter, op12_ranked_search, op13_centroid_clustering)}

def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after another: distances to all centroids, the nearest, then the floor of each mean."""
    near = """a{i} AS (SELECT r, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, v.x, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, c{i} c) GROUP BY r, x)"""
    move = """m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
  SELECT c, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{j} AS (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)"""
    steps = [x for i in range(rounds) for x in (near.format(i=i), move.format(i=i, j=i + 1))] + [near.format(i=rounds)]
    return f"""WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('1:' || vec_id), x LIMIT {k}),
{", ".join(steps)}
SELECT vec_id, a.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c"""


# Others tokenise, learn, align or search: the tests hold them against brute force, round trips and held-out accuracy.
ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op11_url_filter": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM (SELECT u.*, (SELECT max_by({'rule': h || p, 'v': v}, 1000 * (length(h) + length(p)) + length(h)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM u)""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, unnest(t) AS term, len(t) AS n FROM d) GROUP BY r, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, s.n),
x AS (
  SELECT q.item_id, p.r, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, s GROUP BY q.item_id, p.r, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10""".replace("\\", "\\"),
    "op13_centroid_clustering": _clustering_sql(),
}
