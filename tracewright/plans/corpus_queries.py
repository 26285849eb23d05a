"""Corpus, harvest and planning queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, status
from ..functions.text import name_words
from ..operators import corpus, ranking, sampling
from .registry import query
from .standins import ENTITIES, TRACES, entities, traces

ENT_ID = "substr(sha1(trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) || '|' || trim(regexp_replace(lower(n_name), '\\s+', ' ', 'g'))), 1, 16)"


@query(f"SELECT c_custkey, {ENT_ID} AS entity_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def entity_id(t):
    """FN1: the id of an entity by name and city."""
    return entities(t).select(F.col("entity_id").alias("c_custkey"), keys.entity_id(F.col("name"), F.col("city")).alias("entity_id"))


@query(f"WITH {ENTITIES} SELECT entity_id, name, city, split FROM entities WHERE split = 'eval'")
def scan_split(t):
    """SRC2, PRJ1: entities of one split."""
    return corpus.scan_entities(entities(t), split="eval").select("entity_id", "name", "city", "split")


@query(f"WITH {ENTITIES} SELECT entity_id, name FROM entities WHERE split IS NULL")
def scan_unmarked(t):
    """SRC2: entities without a split."""
    return corpus.scan_entities(entities(t), unmarked=True).select("entity_id", "name")


@query(f"WITH {ENTITIES}, {TRACES} SELECT trace_id, t.entity_id, name, city, concat(name, ', ', city) AS episode_input, split, found FROM traces t JOIN entities e ON t.entity_id = e.entity_id WHERE NOT rejected")
def traces_with_entity(t):
    """SRC3, JN1, PRJ2: kept traces with their entity."""
    out = corpus.scan_traces(traces(t), entities(t))
    return out.select("trace_id", "entity_id", "name", "city", F.concat("name", F.lit(", "), "city").alias("episode_input"), "split", "found")


@query(f"WITH {ENTITIES}, {TRACES} SELECT trace_id, split FROM traces t JOIN entities e ON t.entity_id = e.entity_id WHERE NOT rejected AND split = 'sft' AND trace_source = 'student'")
def traces_of_source(t):
    """SRC3 with split and source filters; PRJ3: the filters reach the scan."""
    return corpus.scan_traces(traces(t), entities(t), split="sft", source="student").select("trace_id", "split")


@query(f"WITH {ENTITIES} SELECT entity_id, name FROM entities WHERE entity_id = 17")
def point_lookup(t):
    """SRC4: one entity by its key."""
    return entities(t).where(F.col("entity_id") == 17).limit(1).select("entity_id", "name")


@query(f"WITH {ENTITIES} SELECT coalesce(split, 'unmarked') AS split, count(*) AS n FROM entities GROUP BY 1")
def count_by_split(t):
    """AG1."""
    return corpus.count_by_split(entities(t))


@query(f"WITH {TRACES} SELECT count(*) FILTER (reviewed_at IS NOT NULL) AS reviewed, count(*) FILTER (reviewed_at IS NULL) AS unreviewed, count(*) FILTER (reviewed_at IS NOT NULL AND NOT rejected) AS kept, count(*) FILTER (rejected) AS rejected FROM traces")
def review_counts(t):
    """AG2."""
    return corpus.review_counts(traces(t))


@query(f"WITH {TRACES} SELECT count(*) AS n, count(*) FILTER (NOT rejected) AS n_kept FROM traces")
def trace_count(t):
    """AG3."""
    return traces(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("rejected")).alias("n_kept"))


@query(f"WITH {TRACES} SELECT trace_id, CASE WHEN reviewed_at IS NULL THEN NULL WHEN rejected THEN 'reject' ELSE 'keep' END AS decision FROM traces")
def review_decision(t):
    """PRJ15."""
    return traces(t).select("trace_id", status.review_decision(F.col("reviewed_at"), F.col("rejected")).alias("decision"))


@query(f"WITH {TRACES} SELECT trace_id, found, row_number() OVER (ORDER BY found, trace_id) AS place FROM traces WHERE NOT found")
def review_scope(t):
    """PRJ17, SO5: the not-found traces in the order of review."""
    scoped = traces(t).where(~F.col("found"))
    return ranking.with_rank(scoped, F.col("trace_id"), ["found", "trace_id"], "place").select("trace_id", "found", "place")


def _unmarked(t):
    return entities(t).withColumn("split", F.lit(None).cast("string"))


@query(f"""WITH {ENTITIES}, r AS (SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) AS pos, count(*) OVER () AS n FROM entities)
SELECT entity_id, CASE WHEN pos <= round_even(n * CAST(0.5 AS DOUBLE), 0) THEN 'sft' WHEN pos <= round_even(n * CAST(0.5 AS DOUBLE), 0) + round_even(n * CAST(0.3 AS DOUBLE), 0) THEN 'grpo' ELSE 'eval' END AS split FROM r""")
def assign_splits(t):
    """SP1, SO2, WN14: a seeded permutation cut by fractions."""
    return sampling.assign_splits(_unmarked(t), {"sft": 0.5, "grpo": 0.3, "eval": 0.2}).select("entity_id", "split")


@query(f"""WITH {ENTITIES}, r AS (SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) AS pos FROM entities WHERE split IS NULL)
SELECT entity_id, 'eval' AS split FROM r UNION ALL SELECT entity_id, split FROM entities WHERE split IS NOT NULL""")
def fill_splits(t):
    """SP1 for the unmarked alone."""
    return sampling.assign_splits(entities(t), {"eval": 1.0}).select("entity_id", "split")


@query(f"WITH {ENTITIES} SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN name || '!' ELSE name END AS name, city FROM entities UNION ALL SELECT entity_id + 10000000, name, city FROM entities WHERE entity_id % 10 = 0")
def upsert_full(t):
    """UPS1, SRC5: updates replace rows, the last of a key wins, new keys are added."""
    base = entities(t).select("entity_id", "name", "city")
    third = base.where("entity_id % 3 = 0")
    updates = third.withColumn("name", F.lit("old")).withColumn("seq", F.lit(1)).unionByName(third.withColumn("name", F.concat("name", F.lit("!"))).withColumn("seq", F.lit(2)))
    updates = updates.unionByName(base.where("entity_id % 10 = 0").withColumn("entity_id", F.col("entity_id") + 10000000).withColumn("seq", F.lit(1)))
    return corpus.upsert(base, updates, ["entity_id"])


@query(f"WITH {ENTITIES} SELECT entity_id, CASE WHEN entity_id % 6 = 0 THEN NULL ELSE split END AS split FROM entities")
def upsert_preserve(t):
    """UPS2: a column that an update leaves out keeps its value; an explicit null overwrites."""
    base = entities(t).select("entity_id", "split")
    updates = base.where("entity_id % 3 = 0").select("entity_id", F.lit(None).cast("string").alias("split"), (F.col("entity_id") % 6 == 0).alias("has_split"))
    return corpus.upsert_preserving(base, updates, ["entity_id"], "split", "has_split")


@query(f"""WITH {TRACES} SELECT trace_id, CASE trace_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE rejected END AS rejected,
CASE trace_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE reject_reason END AS reject_reason,
CASE trace_id % 4 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-01-01' WHEN 2 THEN NULL ELSE reviewed_at END AS reviewed_at FROM traces""")
def apply_decisions(t):
    """UPS3: keep, reject and undecided."""
    tr = traces(t)
    k = F.col("trace_id") % 4
    d = tr.where(k < 3).select("trace_id", F.when(k == 0, "reject").when(k == 1, "keep").otherwise("undecided").alias("decision"), F.lit("bad").alias("reason"), F.lit("2024-01-01").alias("at"))
    return corpus.apply_decisions(tr, d).select("trace_id", "rejected", "reject_reason", "reviewed_at")


@query(f"WITH {TRACES} SELECT a.trace_id, b.trace_id AS sibling_id FROM traces a JOIN traces b ON a.entity_id = b.entity_id AND a.trace_id <> b.trace_id")
def siblings(t):
    """JN8."""
    return corpus.siblings(traces(t))


@query(f"WITH {TRACES}, s AS (SELECT a.trace_id, b.trace_id AS sibling_id, b.found, b.grounding FROM traces a JOIN traces b ON a.entity_id = b.entity_id AND a.trace_id <> b.trace_id) SELECT trace_id, sibling_id, row_number() OVER (PARTITION BY trace_id ORDER BY found DESC, coalesce(grounding, 1.0), sibling_id) AS place FROM s")
def sibling_order(t):
    """SO4: siblings, found first, then by grounding, unknown last."""
    tr = traces(t)
    s = corpus.siblings(tr).join(tr.select(F.col("trace_id").alias("sibling_id"), "found", "grounding"), "sibling_id")
    w = Window.partitionBy("trace_id").orderBy(F.col("found").desc(), F.coalesce("grounding", F.lit(1.0)), "sibling_id")
    return s.select("trace_id", "sibling_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {ENTITIES}, {TRACES} SELECT 'traces' AS table_name, 'unique(trace_id)' AS rule, count(*) AS n FROM (SELECT trace_id FROM traces GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'traces', 'required(reviewed_at)', count(*) FROM traces WHERE reviewed_at IS NULL
UNION ALL SELECT 'traces', 'domain(trace_source)', count(*) FROM traces WHERE trace_source NOT IN ('teacher')
UNION ALL SELECT 'traces', 'reference(entity_id)', count(*) FROM traces WHERE entity_id NOT IN (SELECT entity_id FROM entities WHERE split = 'sft')""")
def constraint_violations(t):
    """VAL2, SNK8: keys, nulls, domains and references."""
    sft = entities(t).where("split = 'sft'")
    return corpus.violations(traces(t), "traces", unique=["trace_id"], required=["reviewed_at"], domain={"trace_source": ("teacher",)}, reference={"entity_id": (sft, "entity_id")})


@query(f"WITH {ENTITIES}, {TRACES} SELECT entity_id FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM traces WHERE found)")
def resume_todo(t):
    """JN13, SET2, ST5: planned less done."""
    return entities(t).join(traces(t).where("found"), "entity_id", "left_anti").select("entity_id")


@query(f"WITH {ENTITIES}, {TRACES} SELECT entity_id FROM entities WHERE entity_id IN (SELECT entity_id FROM traces)")
def traced_entities(t):
    """JN14: the leak guard's semi join."""
    return entities(t).join(traces(t), "entity_id", "left_semi").select("entity_id")


@query("SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels")
def id_intersect(t):
    """SET3."""
    return t("documents").where("n_chars > 1000").select("doc_id").intersect(t("labels").select("doc_id"))


@query(f"WITH {ENTITIES} SELECT entity_id, split FROM entities WHERE split IN ('sft', 'grpo') ORDER BY entity_id LIMIT 100 OFFSET 50")
def shard_selection(t):
    """SET1, SO7, SO8: scans of two splits, in order, one shard of them."""
    e = entities(t)
    both = corpus.scan_entities(e, split="sft").unionByName(corpus.scan_entities(e, split="grpo"))
    return both.select("entity_id", "split").orderBy("entity_id").offset(50).limit(100)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_by_id(t):
    """WN1: the first record of each id."""
    return ranking.keep_first(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), lower(p_brand) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1")
def dedup_entities(t):
    """WN2, WN4, FN10: the first entity of each normalised name and place."""
    p = t("part").withColumn("_n", name_words(F.col("p_name"))).withColumn("_b", F.lower("p_brand"))
    return ranking.keep_first(p, ["_n", "_b"], ["p_partkey"]).select("p_partkey")


@query("SELECT p_partkey, p_size > 48 OR count(*) OVER (PARTITION BY lower(p_name)) >= 30 AS is_chain FROM part")
def chain_flag(t):
    """AG18: tagged chains, and names at 30 places or more."""
    return corpus.chain_flag(t("part"), name_words(F.col("p_name")), F.col("p_size") > 48, 30).select("p_partkey", "is_chain")


@query("""WITH top AS (SELECT p_type FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(p_partkey) LIMIT 3)
SELECT p_partkey, CASE WHEN p_type IS NULL THEN 'unspecified' WHEN p_type IN (SELECT p_type FROM top) THEN p_type ELSE 'other' END AS bucket FROM part""")
def topn_bucket(t):
    """AG19: the most frequent kinds, the rest as other."""
    return corpus.top_bucket(t("part"), "p_type", 3, "p_partkey").select("p_partkey", "bucket")


_ALLOC = """, c AS (SELECT {key} AS k, count(*) AS c FROM {source} GROUP BY 1), p AS (SELECT *, sum(c) OVER () AS pool FROM c),
f AS (SELECT *, (least({total}, pool) * c) // pool AS fl, (least({total}, pool) * c) % pool AS rest FROM p),
q AS (SELECT k, c, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, c DESC, k DESC) <= least({total}, pool) - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM f)"""


@query(f"WITH {ENTITIES}" + _ALLOC.format(key="concat(cuisine, '/', region)", source="entities", total=100) + " SELECT k AS stratum, c, CAST(quota AS BIGINT) AS quota FROM q")
def allocate_strata(t):
    """SP2: largest remainders in integers."""
    counts = entities(t).groupBy(F.concat_ws("/", "cuisine", "region").alias("stratum")).agg(F.count(F.lit(1)).alias("c"))
    return sampling.allocate(counts, "stratum", 100)


@query(f"""WITH {ENTITIES}, s AS (SELECT *, concat(cuisine, '/', region) AS stratum, row_number() OVER (PARTITION BY is_chain, concat(cuisine, '/', region) ORDER BY md5('42:' || entity_id), entity_id) AS nth FROM entities),
n AS (SELECT count(*) FILTER (is_chain) AS nc, count(*) FILTER (NOT is_chain) AS ni FROM entities), w1 AS (SELECT nc, ni, least(120, nc + ni) AS n FROM n),
w2 AS (SELECT *, least(nc, round_even(n * (1 - CAST(0.7 AS DOUBLE)), 0)) AS c0 FROM w1), w3 AS (SELECT *, least(ni, n - c0) AS wi FROM w2), w AS (SELECT *, least(nc, n - wi) AS wc FROM w3),
c AS (SELECT is_chain, stratum, count(*) AS c FROM s GROUP BY 1, 2), p AS (SELECT c.*, sum(c) OVER (PARTITION BY is_chain) AS pool, CAST(CASE WHEN is_chain THEN wc ELSE wi END AS BIGINT) AS total FROM c, w),
f AS (SELECT *, (least(total, pool) * c) // pool AS fl, (least(total, pool) * c) % pool AS rest FROM p),
q AS (SELECT *, fl + CASE WHEN row_number() OVER (PARTITION BY is_chain ORDER BY rest DESC, c DESC, stratum DESC) <= least(total, pool) - sum(fl) OVER (PARTITION BY is_chain) THEN 1 ELSE 0 END AS quota FROM f)
SELECT s.entity_id, s.stratum, s.is_chain FROM s JOIN q ON s.stratum = q.stratum AND s.is_chain = q.is_chain WHERE nth <= quota""")
def stratified_sample(t):
    """SP3: quotas by stratum, independents first."""
    out = sampling.stratified_sample(entities(t), target=120, chain="is_chain", stratum=F.concat_ws("/", "cuisine", "region"), key="entity_id")
    return out.select("entity_id", "stratum", "is_chain")


_POOL = ", ".join(f"'{x}'" for x in sampling.DIETARY_POOL)
_SLUG = "substr(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60)"


@query(f"""WITH {ENTITIES}, r AS (SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) - 1 AS pos FROM entities), n AS (SELECT count(*) AS n FROM entities),
b AS (SELECT entity_id, NULL AS restriction, pos AS i FROM r WHERE pos < 300 UNION ALL
  SELECT entity_id, list_extract([{_POOL}], CAST(k % 13 + 1 AS BIGINT)) AS restriction, k + 300 AS i FROM range(200) x(k), n JOIN r ON k % n.n = r.pos),
d AS (SELECT CASE WHEN restriction IS NULL THEN CAST(entity_id AS VARCHAR) ELSE entity_id || '__' || {_SLUG.format("restriction")} END AS trace_id, * FROM b)
SELECT trace_id, entity_id, restriction, i FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY i) AS rn FROM d) WHERE rn = 1""")
def plan_episodes(t):
    """SP4, JN16, FN3: free episodes, then conditioned ones in turn."""
    return sampling.plan_episodes(entities(t), 500, 0.4)


@query("""WITH n AS (SELECT count(*) FILTER (quality = 1) AS nt, count(*) FILTER (quality <> 1) AS nf FROM labels),
k AS (SELECT CASE WHEN nf <= CAST(0.2 AS DOUBLE) * (nt + nf) THEN nf ELSE least(nf, CAST(floor(nt * CAST(0.2 AS DOUBLE) / (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)) END AS keep FROM n),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS pos FROM labels WHERE quality <> 1)
SELECT doc_id, true AS found FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, false FROM r, k WHERE pos <= keep""")
def ratio_guard(t):
    """SP5: at most a fifth of the rows are not found."""
    return sampling.ratio_guard(t("labels").select("doc_id", (F.col("quality") == 1).alias("found")), "found", "doc_id").select("doc_id", "found")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT DISTINCT CAST(least(n - 1, floor(j * (CAST(n AS DOUBLE)) / 37)) AS BIGINT) AS pos FROM range(37) x(j), n), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, pos IN (SELECT pos FROM p) AS probe FROM r""")
def stride_probe(t):
    """WN11, SP6, SET4: a systematic sample and the rest."""
    return sampling.stride_probe(t("documents").select("doc_id"), F.col("doc_id"), ["doc_id"], 37).select("doc_id", "probe")


@query(f"WITH {ENTITIES} SELECT 'region' AS kind, CAST(region AS VARCHAR) AS value, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'cuisine', cuisine, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'chain', CASE WHEN is_chain THEN 'true' ELSE 'false' END, count(*) FROM entities GROUP BY 2")
def harvest_report(t):
    """AG20: regions, cuisines and chains, in one pass."""
    e = entities(t).select(F.explode(F.array(F.struct(F.lit("region").alias("kind"), F.col("region").cast("string").alias("value")), F.struct(F.lit("cuisine").alias("kind"), F.col("cuisine").alias("value")), F.struct(F.lit("chain").alias("kind"), F.col("is_chain").cast("string").alias("value")))).alias("x"))
    return e.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'UK' WHEN 1 THEN 'US' WHEN 2 THEN 'CA' WHEN 3 THEN 'AU' WHEN 4 THEN 'UK' ELSE 'FR' END AS country FROM part")
def norm_country(t):
    """PRJ6."""
    raw = F.element_at(F.array(*[F.lit(x) for x in (" gb ", "United States", "canada", "AUSTRALIA", "uk", "fr")]), F.col("p_size") % 6 + 1)
    return t("part").select("p_partkey", keys.norm_country(raw).alias("country"))


@query("SELECT DISTINCT o_orderstatus AS model FROM orders")
def distinct_models(t):
    """AG30."""
    return t("orders").select(F.col("o_orderstatus").alias("model")).distinct()


@query("SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'local only' WHEN l.doc_id IS NULL THEN 'remote only' WHEN l.n_chars = r.n_chars THEN 'same' ELSE 'changed' END AS state FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 <> 0) l FULL JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 3 <> 0) r ON l.doc_id = r.doc_id")
def sync_state(t):
    """JN18, SET5, SNK7: local and remote sets by key."""
    d = t("documents").select("doc_id", "n_chars")
    left = d.where("doc_id % 5 != 0").select(F.col("doc_id").alias("a"), F.col("n_chars").alias("x"))
    right = d.where("doc_id % 3 != 0").select(F.col("doc_id").alias("b"), (F.col("n_chars") + (F.col("doc_id") % 7 == 0).cast("long")).alias("y"))
    state = F.when(F.col("b").isNull(), "local only").when(F.col("a").isNull(), "remote only").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return left.join(right, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("doc_id"), state.alias("state"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN false WHEN doc_id % 5 = 1 THEN doc_id % 2 = 0 WHEN doc_id % 5 = 2 THEN doc_id % 3 = 0 ELSE doc_id % 4 = 0 END AS unchanged,
CASE WHEN doc_id % 5 = 0 THEN 'remote missing' WHEN doc_id % 5 = 1 THEN 'md5 metadata' WHEN doc_id % 5 = 2 THEN 'etag' ELSE 'size' END AS reason FROM documents""")
def sync_decision(t):
    """PV4."""
    k, own = F.col("doc_id") % 5, F.md5("text")
    d = t("documents").select(
        "doc_id", own.alias("md5"), F.col("n_chars").alias("size"), F.when(k != 0, F.when(F.col("doc_id") % 4 == 0, F.col("n_chars")).otherwise(-1)).alias("r_size"),
        F.when(k == 1, F.when(F.col("doc_id") % 2 == 0, own).otherwise("x")).alias("r_md5"),
        F.when(k == 2, F.when(F.col("doc_id") % 3 == 0, own).otherwise("x")).when(k == 3, "abc-2").otherwise(None).alias("r_etag"),
    )
    s = status.sync_decision(F.col("r_md5"), F.col("r_etag"), F.col("r_size"), F.col("md5"), F.col("size"))
    return d.select("doc_id", s["unchanged"].alias("unchanged"), s["reason"].alias("reason"))
