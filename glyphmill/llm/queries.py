"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.token_output import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.repeat_removal import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to FROM m
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.compact_windows import near_duplicate_passages

    return near_duplicate_passages(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0
), dw AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM bw) AS s, unnest(generate_series(1, len(w) - size + 1)) AS g(i)
), hits AS (
  SELECT r, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + size - 1)) AS g(p) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM o
), f AS (
  SELECT min(k) AS k FROM l WHERE share * w <= cap
), t AS (
  SELECT source, source_size, CASE WHEN l.k < f.k THEN cap::DOUBLE ELSE (SELECT share FROM l AS x WHERE x.k = f.k) * w END AS target FROM l, f
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS copies, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest FROM t
), c AS (
  SELECT d.*, source_size, target, copies, rest, sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), m AS (
  SELECT *, coalesce(2 * cum - size <= 2 * rest, FALSE) AS more FROM c
)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.ppm import score

    return score(table(spark, sf_dir, "documents"), across=True)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.periodic_runs import collapse_runs, plant_periods

    found = collapse_runs(plant_periods(table(spark, sf_dir, "documents")))
    best = F.expr("reduce(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select("doc_id", "runs", "collapsed", best.alias("b")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from glyphmill.llm.merge_encoding import encode_pieces

    got = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.centroid_clustering import cluster_vectors

    got = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _op13_sql() -> str:
    """Clustering in SQL: centroids as rows of components, one step after another."""
    near = """
n{k} AS (
  SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT r, c, sum((v - x) * (v - x))::BIGINT AS d FROM e JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r
)"""
    step = """
m{k} AS (
  SELECT n{k}.c, i, sum(v)::BIGINT AS s, count(*) AS n FROM n{k} JOIN e USING (r) GROUP BY n{k}.c, i
), c{l} AS (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{k} LEFT JOIN m{k} USING (c, i)
)"""
    head = """
WITH a AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), e AS (
  SELECT r, i, floor(64 * embedding[i]::DOUBLE)::BIGINT AS v FROM a, generate_series(1, 64) AS g(i)
), f AS (
  SELECT r, row_number() OVER (ORDER BY sha256(concat('1:', CAST(vec_id AS VARCHAR))), r) - 1 AS c FROM a QUALIFY c < 16
), c0 AS (
  SELECT c, i, v AS x FROM f JOIN e USING (r)
)"""
    rounds = ",".join(near.format(k=k) + "," + step.format(k=k, l=k + 1) for k in range(3))
    tail = """
, h AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c
)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM n3 JOIN a USING (r) JOIN h USING (c)
"""
    return head + "," + rounds + "," + near.format(k=3) + tail


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_jaccard_join, op3_repeat_removal, op4_warc, op5_substring_dedup, op6_decontaminate, op7_mixing, op8_token_output, op9_quality, op10_lm_score, op11_periodic_runs, op12_piece_encoding, op13_centroid_clustering)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_mixing": OP7_SQL, "op13_centroid_clustering": _op13_sql()}
