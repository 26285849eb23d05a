"""Exports, traces as parsed, sync counts and the dietary term."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import status
from ..operators import labels, menus, messages
from .registry import query
from .standins import menus as menu_table
from .text_queries import _slim_sql


@query("SELECT conv_id AS trace_id, count(*) AS n_messages, arg_max(text, turn) AS final FROM conversations GROUP BY 1")
def candidate_export(t):
    """SNK6: traces as candidates, messages given way to their number."""
    c = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("messages"))
    return c.select(F.col("conv_id").alias("trace_id"), F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", -1)["text"].alias("final"))


@query("SELECT doc_id, n_chars, lang FROM documents WHERE doc_id % 2 = 0")
def jsonl_round_trip(t):
    """SRC8, SNK1, JS3: rows as JSON lines and back, blank lines skipped."""
    d = t("documents").select("doc_id", "n_chars", "lang")
    line = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("doc_id", "n_chars", "lang"), {"ignoreNullFields": "false"})).otherwise(" ")
    lines = d.select(line.alias("value")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", "doc_id long, n_chars long, lang string").alias("r")).select("r.*")


def _traces(t):
    """Conversations as block-structured traces: an assistant's turn is a call, the user's next one its result, but for the first and last turns."""
    none = F.lit(None).cast("string")
    c = t("conversations")
    w = Window.partitionBy("conv_id")
    c = c.withColumns({"first": F.min("turn").over(w), "last": F.max("turn").over(w)})
    ends = F.col("turn").isin(F.col("first"), F.col("last")) | (F.col("role") == "system")
    use = F.col("role") == "assistant"
    said = F.when(use & (F.col("turn") == F.col("last")), F.concat(F.lit('Here: {"found": true, "n": '), F.col("turn"), F.lit("} done"))).otherwise(F.col("text"))
    tool = F.when(F.floor(F.when(use, F.col("turn")).otherwise(F.col("turn") - 1) / 2) % 2 == 0, "scrape_url").otherwise("web_search")
    argument = F.when(tool == "scrape_url", F.lit("url")).otherwise("query")
    block = lambda kind, text, id_, name, given: F.struct(kind.alias("type"), text.alias("text"), id_.alias("id"), name.alias("name"), given.alias("input"))
    call = block(F.lit("tool_use"), none, F.concat(F.lit("c"), F.col("turn")), tool, F.to_json(F.create_map(argument, F.col("text"))))
    result = block(F.lit("tool_result"), F.concat(F.when(F.col("turn") % 5 == 0, "(scrape failed: x) ").otherwise(""), F.lit("![i](a.png)"), F.col("text")), F.concat(F.lit("c"), F.col("turn") - 1), none, none)
    content = F.when(ends, F.array(block(F.lit("text"), said, none, none, none))).when(use, F.array(block(F.lit("text"), F.lit("thought"), none, none, none), call)).otherwise(F.array(result))
    parts = F.sort_array(F.collect_list(F.struct("turn", F.col("role"), content.alias("content"))))
    g = c.groupBy("conv_id").agg(parts.alias("p"))
    return g.select(F.col("conv_id").alias("trace_id"), F.transform("p", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("vegan"))).alias("restrictions"))


#: Turns with their place, and calls with the result of their id: the user's turn right after.
_PLACED = """c AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
k AS (SELECT *, turn IN (first, last) OR role = 'system' AS ends FROM c),
u AS (SELECT conv_id, turn, text, CASE WHEN turn // 2 % 2 = 0 THEN 'scrape_url' ELSE 'web_search' END AS name FROM k WHERE role = 'assistant' AND NOT ends),
r AS (SELECT conv_id, turn - 1 AS turn, CASE WHEN turn % 5 = 0 THEN '(scrape failed: x) ' ELSE '' END || '![i](a.png)' || text AS result FROM k WHERE role NOT IN ('assistant', 'system') AND NOT ends),
p AS (SELECT u.*, r.result FROM u LEFT JOIN r ON u.conv_id = r.conv_id AND u.turn = r.turn)"""


@query(f"""WITH {_PLACED}, g AS (SELECT conv_id, count(*) FILTER (name = 'scrape_url' AND result IS NOT NULL) AS scrapes, string_agg(result, '|' ORDER BY turn) FILTER (name = 'scrape_url') AS first, string_agg(result, '|' ORDER BY turn) FILTER (name = 'web_search') AS second FROM p GROUP BY 1)
SELECT i.conv_id, coalesce(scrapes, 0) AS scrapes, coalesce(first, '') AS scraped, coalesce(second, '') AS searched FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON i.conv_id = g.conv_id""")
def parse_trace(t):
    """O-MSG4: whole results of a trace by their tool, in order."""
    r = _traces(t).select(F.col("trace_id").alias("conv_id"), messages.trace_results(F.col("messages")).alias("r"))
    return r.select("conv_id", F.size("r.scrapes").cast("long").alias("scrapes"), F.array_join("r.scrapes", "|").alias("scraped"), F.array_join("r.searches", "|").alias("searched"))


@query(f"""WITH {_PLACED}, g AS (SELECT conv_id, count(*) AS n_calls, string_agg(text, '|' ORDER BY turn) FILTER (name = 'web_search') AS queries, string_agg(text || ':direct:' || CASE WHEN starts_with(coalesce(result, ''), '(scrape failed') THEN 'true' ELSE 'false' END, '|' ORDER BY turn) FILTER (name = 'scrape_url') AS fetches FROM p GROUP BY 1)
SELECT i.conv_id, coalesce(n_calls, 0) AS n_calls, coalesce(queries, '') AS queries, coalesce(fetches, '') AS fetches FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON i.conv_id = g.conv_id""")
def trace_calls(t):
    """O-MSG3: queries, and fetches with mode and failure, of a trace's calls."""
    none = F.lit(None).cast("array<string>")
    r = _traces(t).select(F.col("trace_id").alias("conv_id"), messages.trace_calls(F.col("messages"), none, none).alias("r"))
    line = lambda x: F.concat(x["url"], F.lit(":"), x["mode"], F.lit(":"), x["failed"].cast("string"))
    return r.select("conv_id", F.col("r.n_calls").cast("long").alias("n_calls"), F.array_join("r.queries", "|").alias("queries"), F.array_join(F.transform("r.fetches", line), "|").alias("fetches"))


@query(f"""WITH {_PLACED}, e AS (SELECT conv_id, arg_min(role, turn) AS fr, arg_max(role, turn) AS lr, arg_min(text, turn) AS ft, max(turn) AS lt, count(*) AS n FROM conversations GROUP BY 1),
s AS (SELECT *, CASE WHEN lr <> 'assistant' THEN 'last turn not assistant' WHEN fr <> 'user' OR ft = '' THEN 'first turn not user' END AS skip_reason FROM e),
g AS (SELECT conv_id, string_agg(name || ' ' || text || ' ' || coalesce(CASE WHEN name = 'scrape_url' THEN {_slim_sql("result")} ELSE result END, ''), '|' ORDER BY turn) AS calls FROM p GROUP BY 1)
SELECT s.conv_id, skip_reason, CASE WHEN skip_reason IS NULL THEN coalesce(calls, '') END AS calls, CASE WHEN skip_reason IS NULL THEN ft END AS asked, CASE WHEN skip_reason IS NULL THEN '{{"found":true,"n":' || lt || '}}' END AS answer,
  CASE WHEN skip_reason IS NULL THEN s.conv_id % 2 = 0 END AS restricted FROM s LEFT JOIN g ON s.conv_id = g.conv_id""")
def training_rows(t):
    """O-MSG6: whole training rows: prompt, question, calls beside their slimmed results, compact answer; or why there is none."""
    r = messages.training_rows(_traces(t))
    m = F.col("messages")
    calls = F.flatten(F.transform(F.filter(m, lambda x: x["tool_calls"].isNotNull()), lambda x: F.zip_with(x["tool_calls"], x["tool_responses"], lambda a, b: F.concat(a["name"], F.lit(" "), F.coalesce(F.get_json_object(a["arguments"], "$.url"), F.get_json_object(a["arguments"], "$.query")), F.lit(" "), b["response"]))))
    return r.select(F.col("trace_id").alias("conv_id"), "skip_reason", F.array_join(calls, "|").alias("calls"), F.get(m, F.lit(1))["content"].alias("asked"), F.try_element_at(m, F.lit(-1))["content"].alias("answer"), F.contains(F.get(m, F.lit(0))["content"], F.lit("vegan")).alias("restricted"))


@query()
def token_labels(t):
    """O-MSG11: labels of whole training rows by the public tokenizer; the mask as lengths of its runs, and where rows are skipped, why."""
    import public_tokenizers

    rows = messages.training_rows(_traces(t)).select(F.col("trace_id").alias("conv_id"), "skip_reason", labels.rendered(F.col("messages")).alias("segments"))
    found = labels.token_labels(rows, public_tokenizers.path("byte_bpe_50k.json"), "conv_id")
    learnt = F.filter("labels", lambda x: x != messages.IGNORED)
    return found.select("conv_id", "skip_reason", F.size("input_ids").alias("n_tokens"), F.when(F.col("labels").isNotNull(), F.size(learnt)).alias("n_learnt"), F.crc32(F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")).alias("labels_crc32"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 2 = 0 THEN 'skipped' ELSE 'pushed' END AS decision, count(*) AS n FROM documents GROUP BY 1")
def push_plan(t):
    """PV6, SNK7: what a push would send, skip and lack."""
    own = F.md5("text")
    d = t("documents").select("doc_id", own.alias("md5"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 2 == 0, own).otherwise("x").alias("r"))
    s = status.sync_decision(F.col("r"), F.lit(None).cast("string"), F.col("size"), F.col("md5"), F.col("size"))
    decision = F.when(F.col("doc_id") % 5 == 0, "missing").when(s["unchanged"], "skipped").otherwise("pushed")
    return d.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trace_id, round((2 * count(*) FILTER (contains(name, 'ring')) - count(*)) / CAST(count(*) AS DOUBLE), 6) AS dietary FROM (SELECT l_orderkey AS trace_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def dietary_reward(t):
    """RW4, UX3: the term with a judge that knows one word."""
    term = menus.dietary_reward(menus.flat_items(F.col("menu")), F.array(F.lit("ring")), lambda i, r: F.contains(i["name"], F.get(r, F.lit(0))))
    return menu_table(t).select("trace_id", F.round(term, 6).alias("dietary"))
