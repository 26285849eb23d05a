"""The registered queries of these operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language, mixing, nearest, ngram, packing, phrases, pii, sharding, simhash, spans, tokenfile, yinyang
from .tokens import public_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of passages that came before."""
    cleaned = spans.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "text", "n_sentences", "n_removed")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a trigram trie of nine tenths of them, with every n-gram seen there."""
    return ngram.learn_and_score(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; labels of the held-out quarter are never seen."""
    found = language.classify(_documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    plan = mixing.plan_copies(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_edits(_documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that four differing bits connect."""
    found = simhash.near_components(_documents(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law ``key``."""
    return sharding.shard_documents(_documents(spark, sf_dir), shards=24)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in seekable files, read back from them."""
    folder, files = tokenfile.write_token_files(_documents(spark, sf_dir), public_path("byte_bpe_50k.json"))
    return tokenfile.read_token_files(spark, folder, files)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_documents(spark, sf_dir), public_path("word_bpe_49k.json"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in eight clusters after ten rounds."""
    return yinyang.yinyang_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: what the patterns find, and what the trained classifier adds."""
    return pii.personal_data(_documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language, over all documents."""
    return phrases.collocations(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scores": op2_lm_scores,
    "op3_language_id": op3_language_id,
    "op4_neighbours": op4_neighbours,
    "op5_mix_sources": op5_mix_sources,
    "op6_fingerprints": op6_fingerprints,
    "op7_near_dedup": op7_near_dedup,
    "op8_shard": op8_shard,
    "op9_token_files": op9_token_files,
    "op10_pack": op10_pack,
    "op11_centroids": op11_centroids,
    "op12_personal_data": op12_personal_data,
    "op13_collocations": op13_collocations,
}

_OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM src
), weighed AS (
  SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(2.0 AS DOUBLE) * CAST(source_size AS DOUBLE) AS cap FROM ranked
), leveled AS (
  SELECT *, cap / weight AS full_at,
    (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(2.0 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed
), chosen AS (
  SELECT arg_min(level, full_at) AS level FROM (SELECT level, full_at FROM leveled WHERE level <= full_at ORDER BY full_at, pos LIMIT 1)
), targets AS (
  SELECT source, source_size, CASE WHEN c.level IS NULL THEN cap ELSE least(cap, c.level * weight) END AS target FROM leveled, chosen c
), rated AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT r.*, k, CAST(floor(rate) AS BIGINT) + CAST(CAST(('0x' || substr(md5((k // 4) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), CAST(1 + 8 * (k % 4) AS BIGINT), 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) < rate - floor(rate) AS BIGINT) AS copies
  FROM rated r, range(16) x(k)
), seeds AS (
  SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - any_value(target)), k) AS rn FROM drawn GROUP BY source, k) WHERE rn = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(d.size * d.copies AS BIGINT) AS taken
FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.k = s.k
"""


def _op11_sql(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """Plain k-means over exact integers, a few steps a round."""
    steps = [rf"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda c: CAST(floor(1024.0 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims}
), parts AS MATERIALIZED (
  SELECT row_id, i, x[i] AS v FROM kept, range(1, {dims} + 1) d(i)
), c0 AS MATERIALIZED (
  SELECT c, i, x[i] AS v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS c, x FROM kept QUALIFY c < {k}), range(1, {dims} + 1) d(i)
)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(rf"""a{r} AS MATERIALIZED (
  SELECT row_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.row_id, m.c, sum((p.v - m.v) * (p.v - m.v)) AS d FROM parts p JOIN c{r} m USING (i) GROUP BY ALL) GROUP BY row_id
)""")
        if r < rounds:
            steps.append(rf"""c{r + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (SELECT c, i, sum(v) AS s, count(*) AS n FROM a{r} JOIN parts USING (row_id) GROUP BY c, i)
  ) n USING (c, i)
)""")
    return "WITH " + ", ".join(steps) + rf"""
SELECT k.vec_id, CAST(a.c AS INTEGER) AS "cluster", CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN kept k USING (row_id) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) h ON a.c = h.c
"""  # fmt: skip


_OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), words AS (
  SELECT lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split WHERE len(ws) > 0
), followed AS (
  SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5 FROM words WINDOW p AS (PARTITION BY pid ORDER BY pos)
), grams AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, 1 AS k, w AS phrase FROM followed
    UNION ALL SELECT lang, 2, w || ' ' || w2 FROM followed
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM followed
    UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM followed
    UNION ALL SELECT lang, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM followed
  ) WHERE phrase IS NOT NULL GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, CAST(sum(a) AS HUGEINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), cand AS MATERIALIZED (
  SELECT g.lang, k, phrase, string_split(phrase, ' ') AS ws, a, n FROM grams g JOIN totals t ON g.lang = t.lang WHERE k > 1 AND a >= 100
), counted AS MATERIALIZED (
  SELECT lang || ':' || phrase AS key, a FROM grams WHERE a >= 100
), cuts AS MATERIALIZED (
  SELECT c.*, j, lang || ':' || array_to_string(list_slice(ws, 1, j), ' ') AS lp, lang || ':' || array_to_string(list_slice(ws, j + 1, k), ' ') AS rp FROM cand c, range(1, 5) t(j) WHERE j < k
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, c.n, (1000 * CAST(c.a AS HUGEINT) * c.n) // (CAST(l.a AS HUGEINT) * r.a) AS score, j
  FROM cuts c JOIN counted l ON l.key = c.lp JOIN counted r ON r.key = c.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), swallowed AS (
  SELECT DISTINCT c.lang, array_to_string(list_slice(c.ws, i, i + m - 1), ' ') AS phrase, c.a
  FROM cand c, range(2, 5) t(m), range(1, 5) u(i) WHERE m < c.k AND i + m - 1 <= c.k
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM swallowed s WHERE s.lang = b.lang AND s.phrase = b.phrase AND 100 * s.a >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op5_mix_sources": _OP5_SQL, "op11_centroids": _op11_sql(), "op13_collocations": _OP13_SQL}
