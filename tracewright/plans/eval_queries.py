"""Messages, menus, paired evaluation, grounding and reward queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status
from ..functions.text import fold_words
from ..operators import menus, messages
from .registry import query
from .standins import ITEMS, items
from .standins import menus as menu_table

CONV = "conversations"


# --- messages ---


@query("WITH b AS (SELECT conv_id, turn, role, text, turn % 2 AS id FROM conversations) SELECT u.conv_id AS trace_id, u.turn AS call_pos, max(r.turn) AS result_pos, arg_max(r.text, r.turn) AS result FROM b u LEFT JOIN b r ON u.conv_id = r.conv_id AND u.id + 1 = r.id + CASE WHEN u.id = 0 THEN 0 ELSE 2 END AND r.role = 'user' AND r.turn > u.turn WHERE u.role = 'assistant' GROUP BY 1, 2")
def tool_call_pairs(t):
    """JN4, JN6, O-MSG3: a call and the last later result of its id within the trace."""
    c = t(CONV).select("conv_id", "turn", "role", "text", (F.col("turn") % 2).alias("id"))
    use = c.where("role = 'assistant'").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("pos"), F.lit("tool_use").alias("type"), (1 - F.col("id")).cast("string").alias("id"), F.lit("search").alias("name"), F.col("text").alias("content"))
    res = c.where("role = 'user'").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("pos"), F.lit("tool_result").alias("type"), F.when(F.col("id") == 1, "1").otherwise("0").alias("id"), F.lit(None).cast("string").alias("name"), F.col("text").alias("content"))
    flipped = use.withColumn("id", F.when(F.col("id") == "1", "1").otherwise("0"))
    return messages.call_pairs(flipped.unionByName(res)).select("trace_id", "call_pos", "result_pos", "result")


@query("SELECT a.conv_id, a.turn, a.text AS call, coalesce(u.text, '') AS result FROM conversations a LEFT JOIN conversations u ON a.conv_id = u.conv_id AND a.turn + 1 = u.turn AND u.role = 'user' WHERE a.role = 'assistant'")
def next_turn_pairs(t):
    """JN5."""
    return messages.next_turn_pairs(t(CONV))


@query("""WITH s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role <> 'system'),
g AS (SELECT *, sum(CASE WHEN role <> 'user' OR prev IS NULL OR prev <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS bundle FROM s)
SELECT conv_id, CAST(bundle AS BIGINT) AS bundle, role, count(*) AS n_parts, string_agg(text, chr(10) ORDER BY turn) AS text FROM g GROUP BY 1, 2, 3""")
def turn_bundles(t):
    """WN7, O-MSG1: consecutive results as one turn, system turns dropped."""
    return messages.turn_bundles(t(CONV))


@query("SELECT conv_id, lower(string_agg(text, chr(10) ORDER BY turn)) AS evidence FROM conversations WHERE role = 'user' GROUP BY 1")
def tool_text(t):
    """O-MSG5, JS9: the evidence of a trace."""
    return messages.tool_text(t(CONV))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, role, substr(text, 1, 100) AS preview, length(text) > 100 AS truncated, CAST(length(text) AS INT) AS full_len FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def turn_preview(t):
    """FN25, O-MSG8: turns as a review shows them."""
    return messages.walk_turns(t(CONV), most=100)


@query("SELECT conv_id, substr(text, 1, 200000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE idx = 2")
def turn_fetch(t):
    """O-MSG9: one turn by its number; out of range gives no row."""
    walked = messages.walk_turns(t(CONV), most=200_000)
    return walked.where("idx = 2").select("conv_id", F.col("preview").alias("text"))


@query("""WITH s AS (SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS fr, arg_max(role, turn) AS lr, arg_max(text, turn) AS lt FROM conversations WHERE role <> 'system' GROUP BY 1)
SELECT conv_id, n_turns, CASE WHEN lr <> 'assistant' THEN 'last turn not assistant' WHEN fr <> 'user' THEN 'first turn not user' WHEN trim(coalesce(lt, '')) = '' THEN 'final answer unparsable' END AS skip_reason FROM s""")
def sft_rows(t):
    """O-MSG6: whether a trace gives a training row, and why not."""
    return messages.sft_skip_reason(t(CONV))


@query("SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n FROM (SELECT conv_id, CASE WHEN arg_max(role, turn) <> 'assistant' THEN 'last turn not assistant' WHEN arg_min(role, turn) <> 'user' THEN 'first turn not user' WHEN trim(coalesce(arg_max(text, turn), '')) = '' THEN 'final answer unparsable' END AS skip_reason FROM conversations WHERE role <> 'system' GROUP BY 1) GROUP BY 1")
def skip_counts(t):
    """AG21."""
    return messages.sft_skip_reason(t(CONV)).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, CASE WHEN contains(r, ' with ') THEN 'teacher-only phrase' WHEN NOT contains(r, ' the ') THEN 'missing:  the ' WHEN NOT contains(r, '. ') THEN 'missing: . ' END AS reason FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS r FROM conversations GROUP BY 1)")
def round_trip_check(t):
    """O-MSG7: the first check that a rendering fails."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    r = t(CONV).groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("r"))
    return r.select("conv_id", messages.round_trip_reason(F.col("r"), F.array(F.lit(" the "), F.lit(". ")), " with ").alias("reason"))


@query("SELECT o_orderkey, string_agg(CASE WHEN i >= 2 AND i < 5 OR i >= 7 AND i < 9 THEN o_orderkey + i ELSE -100 END, ',' ORDER BY i) AS labels FROM orders, range(10) x(i) GROUP BY 1")
def label_mask(t):
    """O-MSG11: labels on the spans alone."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("o_orderkey") + i)
    spans = F.array(*[F.struct(F.lit(a).alias("st"), F.lit(b).alias("en")) for a, b in ((2, 5), (7, 9))])
    return t("orders").select("o_orderkey", F.array_join(F.transform(messages.label_mask(ids, spans), lambda x: x.cast("string")), ",").alias("labels"))


@query("""WITH n AS (SELECT o_orderkey, o_orderkey % 5 + 1 AS n, o_orderkey // 4 AS b FROM orders), m AS (SELECT b, max(n) AS m FROM n GROUP BY 1)
SELECT o_orderkey, string_agg(CASE WHEN i < n THEN i ELSE 0 END, ',' ORDER BY i) AS padded, string_agg(CASE WHEN i < n THEN 1 ELSE 0 END, ',' ORDER BY i) AS mask, string_agg(CASE WHEN i < n THEN i ELSE -100 END, ',' ORDER BY i) AS labels FROM n JOIN m USING (b), range(5) x(i) WHERE i < m GROUP BY 1""")
def pad_batch(t):
    """O-MSG12."""
    o = t("orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 4).alias("b"), F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 5).alias("ids"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return messages.pad_batch(o, "ids", "b").select("o_orderkey", text("padded"), text("mask"), text("labels"))


@query("SELECT c.conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_calls, string_agg(text, '|' ORDER BY turn) FILTER (role = 'assistant') AS queries FROM conversations c GROUP BY 1")
def extract_calls(t):
    """O-MSG2: the queries of a trace in order."""
    c = t(CONV).groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_calls"), F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.col("text").alias("q"))))).alias("x"))
    return c.select("conv_id", "n_calls", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda x: x["q"]), "|")).alias("queries"))


# --- menus ---


@query(f"WITH {ITEMS} SELECT trace_id, count(*) AS n_items, string_agg(name, '|' ORDER BY section, pos, price NULLS FIRST, name) AS names FROM items WHERE name <> '' GROUP BY 1")
def flatten_items(t):
    """JS5, JS6."""
    m = menu_table(t)
    return m.select("trace_id", F.size(menus.flat_items(F.col("menu"))).cast("long").alias("n_items"), F.array_join(menus.item_names(F.col("menu")), "|").alias("names"))


@query(f"WITH {ITEMS}, s AS (SELECT trace_id, section, section || '|' || string_agg(name, '|' ORDER BY pos, price NULLS FIRST, name) AS x FROM items GROUP BY 1, 2) SELECT trace_id, string_agg(x, '|' ORDER BY section) AS strings FROM s GROUP BY 1")
def menu_strings(t):
    """JS7."""
    return menu_table(t).select("trace_id", F.array_join(menus.menu_strings(F.col("menu")), "|").alias("strings"))


@query(f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY section, pos, price NULLS FIRST, name) AS rn FROM items) SELECT trace_id, string_agg(name, '|' ORDER BY rn) AS names FROM r WHERE rn <= 3 GROUP BY 1")
def trim_menu(t):
    """JS8: the first items over sections."""
    m = menu_table(t)
    return m.select("trace_id", F.array_join(menus.item_names(menus.trim_menu(F.col("menu"), 3)), "|").alias("names"))


@query(f"WITH {ITEMS} SELECT trace_id, count(DISTINCT section) AS n_sections, count(*) AS n_items, count(price) AS n_priced, count(price) / CAST(count(*) AS DOUBLE) AS coverage FROM items GROUP BY 1")
def self_report(t):
    """MT4, PRJ16."""
    s = menus.self_report(F.col("menu"))
    return menu_table(t).select("trace_id", s.alias("s")).select("trace_id", F.col("s.n_sections").cast("long").alias("n_sections"), F.col("s.n_items").cast("long").alias("n_items"), F.col("s.n_priced").cast("long").alias("n_priced"), "s.coverage")


@query(f"WITH {ITEMS}, s AS (SELECT trace_id, count(*) AS n, count(price) AS p FROM items GROUP BY 1) SELECT count(*) AS n_episodes, round(avg(CASE WHEN o_orderstatus <> 'F' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS found_rate, round(avg(n), 6) AS mean_items, round(avg(p / CAST(n AS DOUBLE)), 6) AS coverage FROM orders LEFT JOIN s ON o_orderkey = trace_id")
def self_report_aggregate(t):
    """AG5: an unknown found counts as not found, coverage only where there are items."""
    s = menus.self_report(F.col("menu"))
    m = menu_table(t).select("trace_id", s.alias("s"))
    o = t("orders").join(m, F.col("o_orderkey") == F.col("trace_id"), "left")
    found = F.coalesce(F.col("o_orderstatus") != "F", F.lit(False)).cast("double")
    return o.agg(F.count(F.lit(1)).alias("n_episodes"), F.round(F.avg(found), 6).alias("found_rate"), F.round(F.avg("s.n_items"), 6).alias("mean_items"), F.round(F.avg("s.coverage"), 6).alias("coverage"))


_JSON = {
    0: '{"found":true,"restaurant_name":"x","menu":[{"section":"a","items":[{"name":"b","price":1}]}]}', 1: '{"found":"true","restaurant_name":"x","menu":[]}',
    2: '{"found":true,"restaurant_name":"x","menu":"oops"}', 3: '{"found":false,"restaurant_name":"x","menu":[],"extra":1}', 4: "not json", 5: '{"found":true,"restaurant_name":"x","menu":[{"section":"a","items":[{"price":1}]}]}',
}


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 3) AS valid FROM orders")
def schema_valid(t):
    """VAL1, MT1, RW1: types are checked, extra keys pass."""
    text = F.element_at(F.create_map(*[F.lit(v) for k in _JSON.items() for v in k]), (F.col("o_orderkey") % 6).cast("int"))
    return t("orders").select("o_orderkey", menus.schema_valid(text).alias("valid"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '{\"a\":' || o_orderkey || '}' END AS value FROM orders")
def extract_json(t):
    """JS1, JS2, FN27: fenced, followed by prose, or none."""
    k = F.col("o_orderkey")
    obj = F.concat(F.lit('{"a": '), k, F.lit("}"))
    text = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Here: "), obj, F.lit(" as asked"))).otherwise("none")
    return t("orders").select("o_orderkey", menus.extract_json(text).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey END AS q FROM orders")
def json_arguments(t):
    """JS3, JS4: arguments as a map; what cannot be parsed is an empty one."""
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"q":"v'), "o_orderkey", F.lit('"}'))).otherwise("{broken")
    args = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return t("orders").select("o_orderkey", F.try_element_at(args, F.lit("q")).alias("q"))


@query(f"""WITH {ITEMS}, k AS (SELECT trace_id, pos, l_quantity > 10 AS cand, list_distinct(string_split(lower(name), ' ')) AS t FROM items), e AS (SELECT trace_id, pos, cand, t, unnest(t) AS w FROM k),
c AS (SELECT a.trace_id, a.pos AS a, b.pos AS b, a.t AS x, b.t AS y FROM e a JOIN e b ON a.trace_id = b.trace_id AND a.w = b.w AND a.cand GROUP BY ALL)
SELECT trace_id, a, b, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard FROM c""")
def token_jaccard_pairs(t):
    """JN9 in its SQL form: candidate and reference items of each trace that share a token; no cross join."""
    k = items(t).select("trace_id", "pos", (F.col("l_quantity") > 10).alias("cand"), menus.tokens_of(F.col("name")).alias("t"))
    e = k.select("trace_id", "pos", "cand", "t", F.explode("t").alias("w"))
    a, b = e.where("cand").select("trace_id", F.col("pos").alias("a"), F.col("t").alias("x"), "w"), e.select("trace_id", F.col("pos").alias("b"), F.col("t").alias("y"), "w")
    pairs = a.join(b, ["trace_id", "w"]).select("trace_id", "a", "b", "x", "y").distinct()
    return pairs.select("trace_id", "a", "b", F.round(menus.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


def _episodes(t):
    """trace_id, found_r, found_c, schema_valid, conditioned of each order."""
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("trace_id"), (F.col("o_orderstatus") != "F").alias("found_r"), (k % 4 != 0).alias("found_c"), (k % 11 != 0).alias("schema_valid"), (k % 2 == 0).alias("conditioned"))


def _paired(t):
    """Candidate and reference menus of each trace: the candidate has the items in more than ten pieces."""
    cand = F.col("l_quantity") > 10
    item = F.struct("pos", "name", "price")
    sides = items(t).where("trace_id is not null").groupBy("trace_id").agg(
        F.sort_array(F.collect_list(item)).alias("_r"), F.sort_array(F.collect_list(F.when(cand, item))).alias("_c"),
        F.size(F.collect_set("section")).alias("sections_r"), F.size(F.collect_set(F.when(cand, F.col("section")))).alias("sections_c"),
    )
    strip = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<pos:int,name:string,price:double>>")), lambda x: F.struct(x["name"].alias("name"), x["price"].alias("price")))
    o = _episodes(t).join(sides, "trace_id", "left")
    none = F.array().cast("array<struct<name:string,price:double>>")
    return o.withColumns({"c": F.when(F.col("found_c"), strip("_c")).otherwise(none), "r": F.when(F.col("found_r"), strip("_r")).otherwise(none)})  # sections count where both are found


@query()
def fuzzy_item_match(t):
    """MT2, JN9, FN13, SO3: greedy pairs by similarity, prices and place."""
    return menus.match_menus(_paired(t), "trace_id", "c", "r")


def _scored(t):
    p = _paired(t)
    m = menus.match_menus(p, "trace_id", "c", "r").withColumnRenamed("trace_id", "_t")
    p = p.join(m, F.col("trace_id") == F.col("_t"))
    cols = menus.score_columns(F.col("schema_valid"), F.col("found_c"), F.col("found_r"), F.size("c"), F.size("r"), F.col("matched"), F.col("agreed"), F.col("sections_c"), F.col("sections_r"))
    return p.withColumns(cols)


@query()
def score_episode(t):
    """MT3, MT6: all metrics of each episode."""
    return _scored(t).select("trace_id", "schema_valid", "found_correct", *menus.METRICS, "item_delta", "section_delta")


_EQ = """p AS (SELECT o_orderkey AS trace_id, o_orderstatus <> 'F' AS fr, o_orderkey % 4 <> 0 AS fc, o_orderkey % 11 <> 0 AS valid, o_orderkey % 2 = 0 AS conditioned, coalesce(nr, 0) AS nr, coalesce(nc, 0) AS nc FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS nr, count(*) FILTER (l_quantity > 10) AS nc FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
q AS (SELECT *, valid AND fc = fr AS found_correct, CASE WHEN fr THEN nr ELSE 0 END AS r, CASE WHEN fc THEN nc ELSE 0 END AS c FROM p),
s AS (SELECT *, least(r, c) AS m, valid AND fc AND fr AS both_ FROM q),
z AS (SELECT *, CASE WHEN both_ AND c = 0 AND r = 0 THEN 1.0 WHEN both_ THEN CASE WHEN c > 0 THEN m / CAST(c AS DOUBLE) END WHEN valid AND fc AND NOT fr THEN 0.0 END AS precision,
 CASE WHEN both_ AND c = 0 AND r = 0 THEN 1.0 WHEN both_ THEN CASE WHEN r > 0 THEN m / CAST(r AS DOUBLE) END WHEN fr AND NOT (valid AND fc) THEN 0.0 END AS recall FROM s)"""


def _counted(t):
    """Episodes scored by counts alone: every candidate item is a reference item, so one sum of a trace's rows tells all."""
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("_t")).agg(F.count(F.lit(1)).alias("_r"), F.count_if(F.col("l_quantity") > 10).alias("_c"))
    p = _episodes(t).join(n, F.col("trace_id") == F.col("_t"), "left")
    side = lambda found, count: F.when(F.col(found), F.coalesce(count, F.lit(0))).otherwise(0)
    p = p.withColumns({"nc": side("found_c", F.col("_c")), "nr": side("found_r", F.col("_r"))})
    m = F.least("nc", "nr")
    return p.withColumns(menus.score_columns(F.col("schema_valid"), F.col("found_c"), F.col("found_r"), F.col("nc"), F.col("nr"), m, m, F.ceil(F.col("nc") / 2), F.ceil(F.col("nr") / 3)))


@query(f"WITH {_EQ} SELECT trace_id, found_correct, round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall, CAST(CASE WHEN both_ THEN c - r END AS BIGINT) AS item_delta, CAST(CASE WHEN both_ THEN ceil(c / CAST(2 AS DOUBLE)) - ceil(r / CAST(3 AS DOUBLE)) END AS BIGINT) AS section_delta FROM z")
def score_by_count(t):
    """MT3's truth table where matching is by count, for SQL."""
    s = _counted(t)
    return s.select("trace_id", "found_correct", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "item_delta", "section_delta")


@query(f"WITH {_EQ} SELECT count(*) AS n_episodes, round(avg(CASE WHEN valid THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS schema_valid_rate, round(avg(CASE WHEN found_correct THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS found_accuracy, round(avg(CAST(precision AS DOUBLE)), 6) AS precision, count(precision) AS n_precision, round(avg(CAST(recall AS DOUBLE)), 6) AS recall, count(recall) AS n_recall, round(avg(CASE WHEN both_ THEN c - r END), 6) AS item_delta, round(avg(CASE WHEN both_ THEN abs(c - r) END), 6) AS item_delta_abs FROM z")
def eval_aggregate(t):
    """AG4: rates over all, means over what has the metric."""
    a = menus.aggregate_metrics(_counted(t), metrics=("precision", "recall"))
    return a.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in a.dtypes])


@query(f"WITH {_EQ} SELECT CASE WHEN grouping(conditioned) = 1 THEN 'all' WHEN conditioned THEN 'conditioned' ELSE 'free' END AS slice, count(*) AS n, round(avg(CASE WHEN found_correct THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS found_accuracy, round(avg(CAST(recall AS DOUBLE)), 6) AS recall FROM z GROUP BY GROUPING SETS ((), (conditioned))")
def eval_slices(t):
    """AG6, AG23: all, free and conditioned in one pass."""
    s = _counted(t)
    g = s.groupingSets([[], ["conditioned"]], "conditioned").agg(F.grouping("conditioned").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("found_correct").cast("double")), 6).alias("found_accuracy"), F.round(F.avg("recall"), 6).alias("recall"))
    return g.select(F.when(F.col("g") == 1, "all").when(F.col("conditioned"), "conditioned").otherwise("free").alias("slice"), "n", "found_accuracy", "recall")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0")
def eval_join(t):
    """JN2, PRJ14: candidates with a usable reference."""
    return t("documents").join(t("labels").where("toxic = 0"), "doc_id").select("doc_id", "n_chars", "quality")


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS paired, count(*) FILTER (l.doc_id IS NULL) AS candidate_only, count(*) FILTER (d.doc_id IS NULL) AS reference_only FROM (SELECT doc_id FROM documents WHERE n_chars > 1000) d FULL JOIN labels l ON d.doc_id = l.doc_id")
def eval_join_accounting(t):
    """JN3."""
    d = t("documents").where("n_chars > 1000").select(F.col("doc_id").alias("a"))
    j = d.join(t("labels").select(F.col("doc_id").alias("b")), F.col("a") == F.col("b"), "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("paired"), F.count_if(F.col("b").isNull()).alias("candidate_only"), F.count_if(F.col("a").isNull()).alias("reference_only"))


@query("WITH o AS (SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'correct_find' WHEN quality = 1 THEN 'false_abstain' WHEN toxic = 1 THEN 'false_find' ELSE 'correct_abstain' END AS outcome FROM labels) SELECT b AS outcome, count(o.outcome) AS n FROM (VALUES ('correct_find'), ('false_abstain'), ('false_find'), ('correct_abstain')) v(b) LEFT JOIN o ON b = o.outcome GROUP BY 1")
def abstention_matrix(t):
    """AG7, MT5: four buckets, zero-filled."""
    o = t("labels").agg(*[F.count_if(status.abstention(F.col("quality") == 1, F.col("toxic") == 1) == b).alias(b) for b in ("correct_find", "false_abstain", "false_find", "correct_abstain")])
    return o.select(F.explode(F.map_entries(F.map_from_arrays(F.array(*[F.lit(c) for c in o.columns]), F.array(*o.columns)))).alias("x")).select(F.col("x.key").alias("outcome"), F.col("x.value").alias("n"))


# --- grounding and reward ---

_SENT = "list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda s: trim(s)), lambda s: s <> '')"


def _evidence(word: str = "the"):
    """A whole text without a word, so that sentences with it have no ground."""
    return F.replace("text", F.lit(word), F.lit(""))


def _names():
    parts = F.transform(F.split("text", r"[.\n]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


@query(f"""WITH h AS (SELECT doc_id, regexp_replace(lower(replace(text, 'the', '')), '\\s+', ' ', 'g') AS hay, {_SENT} AS names FROM documents),
n AS (SELECT doc_id, hay, unnest(names) AS x FROM h), c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT contains(hay, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))) AS m FROM n GROUP BY 1)
SELECT h.doc_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN (n - m) / CAST(n AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS fraction FROM h LEFT JOIN c ON h.doc_id = c.doc_id""")
def grounding_score(t):
    """GR1, JN10: the sentences of a document that its text without one word contains."""
    g = messages.grounding(_names(), _evidence())
    return t("documents").select("doc_id", g.alias("g")).select("doc_id", F.col("g.n").cast("long").alias("n"), "g.fraction")


@query(f"""WITH h AS (SELECT doc_id, regexp_replace(lower(replace(text, 'the', '')), '\\s+', ' ', 'g') AS hay, {_SENT} AS names FROM documents),
n AS (SELECT doc_id, hay, unnest(names) AS x FROM h), c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT contains(hay, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))) AS m FROM n GROUP BY 1)
SELECT h.doc_id, round_even((n - m) / CAST(n AS DOUBLE), 3) AS fraction, least(m, 25) AS misses FROM h LEFT JOIN c ON h.doc_id = c.doc_id""")
def trace_grounding(t):
    """GR2: rounded half-even, null without items, at most 25 misses."""
    g = messages.trace_grounding(_names(), _evidence())
    return t("documents").select("doc_id", g.alias("g")).select("doc_id", "g.fraction", F.size("g.misses").cast("long").alias("misses"))


@query("""WITH m AS (SELECT doc_id, text, lower(text) AS low, lower(trim(substr(text, 400, 30))) AS needle FROM documents), a AS (SELECT *, instr(low, needle) AS p, length(needle) AS k FROM m)
SELECT doc_id, CASE WHEN needle <> '' AND p > 0 THEN CASE WHEN greatest(1, p - 50) > 1 THEN '...' ELSE '' END || substr(text, greatest(1, p - 50), p - greatest(1, p - 50)) || '[[' || substr(text, p, k) || ']]' || substr(text, p + k, 50) || CASE WHEN length(text) >= p + k + 50 THEN '...' ELSE '' END END AS context FROM a""")
def match_context(t):
    """GR3, FN24, JN7: the text around a match."""
    return t("documents").select("doc_id", messages.match_context(F.substring("text", 400, 30), F.col("text"), 50).alias("context"))


@query(f"""WITH h AS (SELECT doc_id, [lower(replace(text, 'the', '')), 'x ' || lower(replace(text, 'de', ''))] AS d, {_SENT} AS names FROM documents),
n AS (SELECT doc_id, d, unnest(names) AS s FROM h), e AS (SELECT doc_id, list_min(list_filter(list_transform(d, lambda x: CASE WHEN contains(x, lower(s)) THEN instr(x, lower(s)) - 1 + length(s) END), lambda v: v IS NOT NULL)) AS en FROM n)
SELECT h.doc_id, CAST(max(en) AS INT) AS deepest, count(en) / CAST(nullif(count(e.doc_id), 0) AS DOUBLE) AS match_rate FROM h LEFT JOIN e ON h.doc_id = e.doc_id GROUP BY 1""")
def menu_reach(t):
    """GR4, JN11, AG16: how deep into the scrapes the strings reach."""
    r = messages.menu_reach(_names(), F.array(_evidence(), F.concat(F.lit("x "), _evidence("de"))))
    return t("documents").select("doc_id", r.alias("r")).select("doc_id", "r.deepest", "r.match_rate")


_RW = "SELECT doc_id, n_chars % 40 AS g, (n_chars % 11) / CAST(10.0 AS DOUBLE) AS f, n_chars % 7 <> 0 AS valid, n_chars % 5 AS items FROM documents"


@query(f"SELECT doc_id, round(CASE WHEN valid AND items > 0 THEN (1 - exp(-g / CAST(20.0 AS DOUBLE))) * f - greatest(CAST(0 AS DOUBLE), (1 - f) - CAST(0.15 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END, 6) AS reward FROM ({_RW})")
def grounding_reward(t):
    """RW3."""
    d = t("documents").select("doc_id", (F.col("n_chars") % 40).alias("g"), ((F.col("n_chars") % 11) / F.lit(10.0)).alias("f"), (F.col("n_chars") % 7 != 0).alias("valid"), (F.col("n_chars") % 5).alias("items"))
    return d.select("doc_id", F.round(status.reward_grounding(F.col("g"), F.col("f"), F.col("valid"), F.col("items")), 6).alias("reward"))


@query(f"SELECT doc_id, round(CAST(0.2 AS DOUBLE) * CASE WHEN valid THEN 1 ELSE 0 END + CAST(0.2 AS DOUBLE) * CASE WHEN valid AND items > 0 THEN 1 ELSE 0 END + CAST(0.6 AS DOUBLE) * CASE WHEN valid AND items > 0 THEN (1 - exp(-g / CAST(20.0 AS DOUBLE))) * f - greatest(CAST(0 AS DOUBLE), (1 - f) - CAST(0.15 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END, 6) AS total FROM ({_RW})")
def reward_total(t):
    """RW1, RW2, RW5, UX4: the weighted sum of the terms."""
    valid, n = F.col("n_chars") % 7 != 0, F.col("n_chars") % 5
    g = status.reward_grounding(F.col("n_chars") % 40, (F.col("n_chars") % 11) / F.lit(10.0), valid, n)
    total = status.reward_total(valid.cast("double"), (valid & (n > 0)).cast("double"), g, F.lit(0.0))
    return t("documents").select("doc_id", F.round(total, 6).alias("total"))


@query("SELECT doc_id, trim(CASE WHEN doc_id % 2 = 0 THEN ' x ' || text ELSE text END) AS answer, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS spans FROM documents")
def wire_answer(t):
    """RW6, RW8: the answer and evidence of a raw completion."""
    even = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<tool_call>a</tool_call><tool_response>r</tool_response><think>t\n</think> x "), "text")).otherwise(F.col("text"))
    return t("documents").select("doc_id", messages.wire_answer(even).alias("answer"), F.size(messages.wire_evidence(even)).alias("spans"))


@query("WITH r AS (SELECT o_orderkey AS i, o_totalprice AS s, o_orderpriority = '1-URGENT' AS flag, o_orderkey // 4 AS g FROM orders), k AS (SELECT *, count(*) FILTER (NOT flag) OVER (PARTITION BY g) AS kept, avg(CASE WHEN NOT flag THEN s END) OVER (PARTITION BY g) AS m FROM r) SELECT i, round(CASE WHEN flag AND kept > 0 THEN m ELSE s END, 4) AS neutral FROM k")
def neutralize_groups(t):
    """RW7, AG29: aborted scores take their group's clean mean."""
    o = t("orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("s"), (F.col("o_orderpriority") == "1-URGENT").alias("flag"))
    return messages.neutralize_groups(o, "i", "s", "flag", 4).select("i", F.round("neutral", 4).alias("neutral"))


@query("SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(regexp_replace(lower(d.text), '\\s+', ' ', 'g'), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) GROUP BY 1")
def evidence_lookup(t):
    """JN10 across rows: the documents that hold each passage, by words that both must have."""
    pairs = messages.evidence_pairs(t("benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name")), t("documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("evidence")))
    n = pairs.groupBy("name_id").agg(F.count(F.lit(1)).alias("_n"))
    return t("benchmark").select("item_id").join(n, F.col("item_id") == F.col("name_id"), "left").select("item_id", F.coalesce("_n", F.lit(0)).alias("n_docs"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name), 'ß', 'ss'), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded, len(list_distinct(string_split(lower(p_name), ' '))) AS n_tokens FROM part")
def name_tokens(t):
    """FN8, SET6."""
    return t("part").select("p_partkey", fold_words(F.col("p_name")).alias("folded"), F.size(menus.tokens_of(F.col("p_name"))).cast("long").alias("n_tokens"))
