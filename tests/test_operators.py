import datetime
import json
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import prompts
from tracewright.operators import cache, corpus, harvest, labels, menus, messages, ranking, sampling
from tracewright.sources import files, keyed
from tracewright.streaming import attempts, ordered

NAMES = [("Ssamjang", "Atlanta", False), ("Pagliacci", "Seattle", False), ("Serious Pie", "Seattle", False), ("McDonald's", "Chicago", True)]


def entities(spark, n=100):
    return spark.createDataFrame([(f"e{i:03d}", None) for i in range(n)], "entity_id string, split string")


def test_splits_are_disjoint_repeatable_and_exact(spark):
    e = entities(spark)
    a = {r[0]: r[1] for r in sampling.assign_splits(e, {"sft": 0.5, "grpo": 0.3, "eval": 0.2}).collect()}
    b = {r[0]: r[1] for r in sampling.assign_splits(e.orderBy(F.desc("entity_id")), {"sft": 0.5, "grpo": 0.3, "eval": 0.2}).collect()}
    assert a == b and sorted(map(list(a.values()).count, ("sft", "grpo", "eval"))) == [20, 30, 50]


def test_bad_fractions_are_refused(spark):
    for bad in ({"sft": 0.5}, {"other": 1.0}):
        with pytest.raises(ValueError):
            sampling.assign_splits(entities(spark), bad)
    for text in ("sft", "sft=x", "sft=0.5"):
        with pytest.raises(ValueError):
            sampling.parse_fractions(text)


def test_reassign_with_traces_needs_force(spark):
    e = entities(spark, 4).withColumn("split", F.lit("sft"))
    traced = e.limit(1).select("entity_id")
    with pytest.raises(ValueError):
        sampling.assign_splits(e, {"eval": 1.0}, reassign=True, traced=traced)
    assert sampling.assign_splits(e, {"eval": 1.0}, reassign=True, traced=traced, force=True).where("split = 'eval'").count() == 4


@pytest.mark.parametrize("total", [0, 1, 7, 50, 99, 1000])
def test_quotas_sum_to_the_total(spark, total):
    counts = spark.createDataFrame([("a", 40), ("b", 31), ("c", 20), ("d", 1)], "k string, c long")
    got = sampling.allocate(counts, "k", total).collect()
    assert sum(r["quota"] for r in got) == min(total, 92) and all(0 <= r["quota"] <= r["c"] for r in got)


def test_plan_reuses_the_prefix(spark):
    plan = sampling.plan_episodes(entities(spark, 5), 10, 0.4).collect()
    free = {r["entity_id"] for r in plan if r["restriction"] is None}
    assert len(free) == 5 and sum(r["restriction"] is not None for r in plan) == 4 and len({r["trace_id"] for r in plan}) == len(plan)
    with pytest.raises(ValueError):
        sampling.plan_episodes(entities(spark, 5), 10, 1.5)


def test_ranks_agree_however_the_rows_are_parted(spark):
    df = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 5000)
    one = {r["id"]: r["rank"] for r in ranking.with_rank(df, F.col("v"), ["v"]).collect()}
    many = {r["id"]: r["rank"] for r in ranking.with_rank(df, F.col("v"), ["v"], rows=300).collect()}
    assert one == many


def test_percentile_definitions_differ(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    got = ranking.percentiles(df, "v", {"a": ranking.floor_place(0.5), "b": ranking.nearest_place(50)}).first()
    assert (got["n"], got["a"], got["b"]) == (4, 3, 3)
    assert ranking.percentiles(df.limit(0), "v", {"a": ranking.floor_place(0.5)}).first()["n"] == 0


def test_percentiles_of_many_values_are_exact(spark):
    """Ranges of few values, a null group, and one group with most rows."""
    rows = [(None if k % 7 == 0 else "hot" if k % 7 < 6 else "b", k * 37 % 900) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int")
    places = {"p50": ranking.nearest_place(50), "p99": ranking.floor_place(0.99)}
    for by in (["g"], []):
        got = {r["g"] if by else "": (r["n"], r["p50"], r["p99"]) for r in ranking.percentiles(df, "v", places, by, rows=100).collect()}
        groups = {g: sorted(v for h, v in rows if not by or h == g) for g in ({h for h, _ in rows} if by else {""})}
        assert got == {g: (len(v), v[round(0.5 * (len(v) - 1))], v[min(len(v) - 1, int(0.99 * len(v)))]) for g, v in groups.items()}


def test_count_by_split_is_zero_filled(spark):
    assert {r[0]: r[1] for r in corpus.count_by_split(entities(spark, 4)).collect()} == {"sft": 0, "grpo": 0, "eval": 0, "unmarked": 4}


def test_upsert_keeps_what_is_left_out(spark):
    base = spark.createDataFrame([("a", "sft"), ("b", None)], "k string, split string")
    new = spark.createDataFrame([("a", None, False), ("b", None, True), ("c", "eval", True)], "k string, split string, has boolean")
    assert {r[0]: r[1] for r in corpus.upsert_preserving(base, new, ["k"], "split", "has").collect()} == {"a": "sft", "b": None, "c": "eval"}


def test_unknown_split_is_refused(spark):
    with pytest.raises(ValueError):
        corpus.scan_entities(entities(spark), split="test")


SIMILAR = [("Ceasar Salad", "Caesar Salad"), ("BBQ Chicken Pizza", "Barbecue Chicken Pizza"), ("Spring Rolls (2)", "Spring Rolls"), ("!!", "--")]
DIFFERENT = [("Galbi Set", "Bulgogi Set"), ("Pad Thai", "Pad See Ew"), ("Coke", "Sprite"), ("Pizza", "BBQ Chicken Pizza"), ("", "a")]
MENU = "array<struct<name:string,price:double>>"


def alike(a, b):
    """The similarity of two names, plainly."""
    a, b = (" ".join("".join(c if c.isalnum() or c == "_" else " " for c in x.lower()).split()) for x in (a, b))
    if a == b or not a or not b:
        return float(a == b)
    x, y = set(a.split()), set(b.split())
    inside = len(x & y) / min(len(x), len(y)) if min(len(x), len(y)) > 1 else 0.0
    return max(SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y), inside)


def greedy(candidate, reference, least=menus.ITEM_MATCH):
    """Pairs taken one after the other, from full similarities: how many, and how many of one price."""
    agree = lambda p, q: p == q if p is None or q is None else abs(p - q) <= 0.005
    ranked = sorted((-alike(c[0], r[0]), not agree(c[1], r[1]), i, j) for i, c in enumerate(candidate) for j, r in enumerate(reference))
    out = []
    for s, apart, i, j in ranked:
        if -s >= least and all(i != a and j != b for a, b, _ in out):
            out.append((i, j, apart))
    return len(out), sum(not apart for _, _, apart in out)


def matched(spark, cases):
    rows = [(k, c, r) for k, (c, r) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k long, c {MENU}, r {MENU}").repartition(3)
    return [(r["matched"], r["agreed"]) for r in menus.match_menus(df, "k", "c", "r").orderBy("k").collect()]


def test_similar_and_different_names(spark):
    rows = spark.createDataFrame(SIMILAR + DIFFERENT, "a string, b string")
    got = {(r["a"], r["b"]): r["s"] for r in rows.select("a", "b", menus.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(got[p] >= menus.ITEM_MATCH for p in SIMILAR) and all(got[p] < menus.ITEM_MATCH for p in DIFFERENT)
    assert all(abs(got[p] - alike(*p)) < 1e-12 for p in got)


def test_matching_is_one_to_one_and_prefers_prices(spark):
    wine = [("House Wine", 12.0), ("House Wine", 8.0)]
    cases = [([("Caesar", None)] * 2, [("Caesar", None)]), ([("House Wine", 8.0)], wine), ([], wine), (None, None), ([("a b c", float("nan"))], [("a b c", None)])]
    assert matched(spark, cases) == [(1, 1), (1, 1), (0, 0), (0, 0), (1, 1)]


def test_matching_agrees_with_one_by_one(spark):
    rng = random.Random(4)
    words = ["pad", "thai", "noodles", "fried", "rice", "chicken", "(2)", "Soup", "soupe", "!!", "", "ceasar", "caesar"]
    side = lambda: [(" ".join(rng.choices(words, k=rng.randint(0, 3))), rng.choice([None, 1.0, 2.0])) for _ in range(rng.randint(0, 9))]
    cases = [(side(), side()) for _ in range(150)]
    assert matched(spark, cases) == [greedy(c, r) for c, r in cases]


@pytest.mark.parametrize("valid, fc, fr, nc, nr, m, want", [
    (True, True, True, 0, 0, 0, (True, 1.0, 1.0, 1.0)), (True, True, True, 0, 4, 0, (True, None, 0.0, 0.0)), (True, False, True, 0, 4, 0, (False, None, 0.0, 0.0)),
    (True, True, False, 4, 0, 0, (False, 0.0, None, 0.0)), (True, False, False, 0, 0, 0, (True, None, None, None)), (False, None, True, 0, 4, 0, (False, None, 0.0, 0.0)),
    (False, None, False, 0, 0, 0, (False, None, None, None)), (True, True, True, 2, 4, 2, (True, 1.0, 0.5, 2 / 3)),
])
def test_truth_table(spark, valid, fc, fr, nc, nr, m, want):
    df = spark.createDataFrame([(valid, fc, fr, nc, nr, m)], "v boolean, fc boolean, fr boolean, nc int, nr int, m int")
    cols = menus.score_columns(F.col("v"), F.col("fc"), F.col("fr"), F.col("nc"), F.col("nr"), F.col("m"), F.col("m"))
    got = df.select(*[cols[c].alias(c) for c in ("found_correct", "precision", "recall", "f1")]).first()
    assert got[0] is want[0] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[1:], want[1:]))


@pytest.mark.parametrize("text, want", [
    ('{"found":true,"restaurant_name":"x","menu":[]}', True), ("null", False), ('"s"', False), ('{"restaurant_name":"x","menu":[]}', False),
    ('{"found":true,"restaurant_name":"x","menu":"oops"}', False), ('{"found":true,"restaurant_name":"x","menu":[{"section":"a","items":[{}]}]}', False), (None, False),
])
def test_contract(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(menus.schema_valid("t")).first()[0] is want


def test_json_recovery():
    assert menus.extract_json_value('```json\n{"a": 1}\n```') == ({"a": 1}, None)
    assert menus.extract_json_value('So: {"a": {"b": 2}} and more')[0] == {"a": {"b": 2}}
    assert menus.extract_json_value("nothing")[0] is None and menus.extract_json_value("[1]")[0] == [1]


def test_grounding(spark):
    df = spark.createDataFrame([(["Bulgogi", "Bibimbap", "Kimchi", "Tteokbokki"], "our menu: bulgogi $18, bibimbap\n $16, house kimchi"), ([], "x")], "n array<string>, e string")
    a, b = df.select(messages.grounding(F.col("n"), F.col("e")).alias("g"), messages.trace_grounding(F.col("n"), F.col("e")).alias("t")).collect()
    assert a["g"]["fraction"] == 0.75 and a["g"]["misses"] == ["Tteokbokki"] and b["g"]["fraction"] == 0.0 and b["t"] is None


@pytest.mark.parametrize("query, name, city, want", [
    ("Ssamjang Atlanta menu", "Ssamjang", "Atlanta", "{name} {city} menu"), ("cheesecake factory menu prices", "The Cheesecake Factory", "Seattle", "{name} menu prices"),
    ("best bbq atlanta", "Ssamjang Korean BBQ", "Atlanta", "best bbq {city}"), ("joes pizza menu", "Joe's Pizza", "New York", "{name} menu"),
    ("la menu", "La Palma", "x", "{name} menu"), ("of menu", "Of Mice", "x", "of menu"), ("the best menu in town", "The Cheesecake Factory", "Seattle", "the best menu in town"), ("ssamjang new york menu", "Ssamjang", "New York", "{name} {city} menu"),
])
def test_templates(query, name, city, want):
    assert harvest.template_of(query, name, city) == want


def test_neutral_scores_keep_the_mean_of_the_clean(spark):
    df = spark.createDataFrame([(0, 1.0, False), (1, 9.0, True), (2, 5.0, True), (3, 5.0, True)], "i long, s double, f boolean")
    assert [r["neutral"] for r in messages.neutralize_groups(df, "i", "s", "f", 2).orderBy("i").collect()] == [1.0, 1.0, 5.0, 5.0]
    assert [r["neutral"] for r in messages.neutralize_groups(df, "i", "s", "f", 3).orderBy("i").collect()] == [1.0, 9.0, 5.0, 5.0]


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([("a ![x](y)" * 50,), ("",), (None,)], "response string")
    once = cache.clean(df, most=100)
    assert sorted(map(str, cache.clean(once.select("response"), most=100).collect())) == sorted(map(str, once.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"trace_id": "t1", "x": 1}))
    (tmp_path / "in/b.json").write_text(json.dumps({"trace_id": "t1", "x": 2}))
    (tmp_path / "in/c.json").write_text("broken")
    got = {r["trace_id"]: r["body"] for r in files.load_candidates(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"t1", "c"} and json.loads(got["t1"])["x"] == 2 and got["c"] is None
    (tmp_path / "r/deep").mkdir(parents=True)
    (tmp_path / "r/deep/one.json").write_text(json.dumps({"aggregate": {"n": 1}}))
    (tmp_path / "r/meta.json").write_text(json.dumps({"aggregate": 1}))
    (tmp_path / "r/two.json").write_text("{}")
    assert [r["file"] for r in files.scan_reports(spark, str(tmp_path / "r")).collect()] == ["one.json"]
    df = spark.createDataFrame([(2, None), (1, "ü")], "k int, t string")
    files.write_jsonl(df, str(tmp_path / "out"), ["k"])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ['{"k":1,"t":"ü"}', '{"k":2,"t":null}']
    assert files.read_jsonl(spark, str(tmp_path / "out"), "k int").count() == 2
    with pytest.raises(FileNotFoundError):
        files.open_table(spark, str(tmp_path / "none"), "k int")
    with pytest.raises(ValueError):
        files.write_json({}, "data/x.json")
    assert "| a |" in files.markdown_table([{"a": None}], ["a"]) and files.checksums(spark, str(tmp_path / "in")).count() == 3
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.harvest(spark, "places", str(tmp_path / "p")).count() == 2


def test_streams_say_what_batches_say(spark, tmp_path):
    rows = [(i, f"k{i * 7 % 5}", float(i % 3), i % 4 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts double, ok boolean")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).toPandas()

    got = run(attempts.replay(stream), "replayed")
    want = cache.replay(df, "key", ["ts", "event_id"], F.col("ok")).toPandas()
    assert dict(zip(got.event_id, got.hit)) == dict(zip(want.event_id, want.hit))
    got = run(attempts.throttle(stream.select("event_id", F.col("key").alias("host"), F.col("ts").alias("at"))), "spaced")
    want = cache.throttle(df, "key", "ts", "event_id").toPandas()
    assert dict(zip(got.event_id, got.start)) == dict(zip(want.event_id, want.start))
    got = run(attempts.streaks(stream.withColumnRenamed("key", "run"), 3), "streaks")
    want = cache.streaks(df, "key", ["ts", "event_id"], ~F.col("ok")).toPandas()
    assert dict(zip(got.event_id, got.streak)) == dict(zip(want.event_id, want.streak))


def block(kind, text=None, id=None, name=None, input=None):
    return {"type": kind, "text": text, "id": id, "name": name, "input": input}


def trace(*messages):
    return [{"role": r, "content": list(c)} for r, c in messages]


TRACE = trace(
    ("user", [block("text", "Ssamjang, "), block("text", "Atlanta")]),
    ("assistant", [block("text", "I think"), block("tool_use", id="1", name="web_search", input='{"query":"q"}'), block("tool_use", id="2", name="scrape_url", input='{"url":"u","mode":"browser"}')]),
    ("user", [block("tool_result", "![i](a.png)page", "2"), block("tool_result", "![i](a.png)hits", "1")]),
    ("assistant", [block("tool_use", id="3", name="scrape_url", input='{"url":"v"}')]), ("user", [block("tool_result", "(scrape failed: x)", "3")]),
    ("assistant", [block("text", 'Done: {"found": true, '), block("text", '"menu": []} bye')]),
)


@pytest.fixture
def traces_df(spark):
    rows = [
        ("ok", TRACE, ["vegan"]), ("none", [], None), ("null", None, None), ("user", TRACE[:-1], None), ("prose", TRACE[:-1] + trace(("assistant", [block("text", "no json")])), None),
        ("list", TRACE[:-1] + trace(("assistant", [block("text", "[1]")])), None), ("first", TRACE[1:], None), ("blank", trace(("user", []), ("assistant", [block("text", "{}")])), None),
    ]
    return spark.createDataFrame(rows, f"trace_id string, messages {messages.MESSAGES}, restrictions array<string>")


def test_training_rows(traces_df):
    got = {r["trace_id"]: r for r in messages.training_rows(traces_df).collect()}
    assert {k: r["skip_reason"] for k, r in got.items()} == {
        "ok": None, "none": "no messages", "null": "no messages", "user": "last turn not assistant", "prose": "final answer unparsable", "list": "final answer unparsable",
        "first": "first turn not user", "blank": "first turn not user",
    }
    system, asked, one, two, answer = got["ok"]["messages"]
    assert "vegan" in system["content"] and asked["content"] == "Ssamjang, Atlanta" and answer["content"] == '{"found":true,"menu":[]}'
    assert [(c["name"], c["arguments"]) for c in one["tool_calls"]] == [("web_search", '{"query":"q"}'), ("scrape_url", '{"url":"u","mode":"browser"}')]
    assert [tuple(c) for c in one["tool_responses"]] == [("web_search", "![i](a.png)hits"), ("scrape_url", "page")]
    assert [tuple(c) for c in two["tool_responses"]] == [("scrape_url", "(scrape failed: x)")] and two["role"] == "assistant"
    assert all(r["messages"] is None for k, r in got.items() if k != "ok")


def test_calls_and_results_of_traces(traces_df):
    r = traces_df.select("trace_id", messages.trace_calls(F.col("messages"), F.array(F.lit("s")), F.array(F.lit("w"))).alias("c"), messages.trace_results(F.col("messages")).alias("r"))
    got = {x["trace_id"]: x for x in r.collect()}
    c = got["ok"]["c"]
    assert c["queries"] == ["q"] and [tuple(f) for f in c["fetches"]] == [("u", "browser", False), ("v", "direct", True)] and c["n_calls"] == 3
    assert [tuple(f) for f in got["none"]["c"]["fetches"]] == [("w", "unknown", False)] and got["null"]["c"]["n_calls"] == 2
    assert got["ok"]["r"]["scrapes"] == ["![i](a.png)page", "(scrape failed: x)"] and got["ok"]["r"]["searches"] == ["![i](a.png)hits"]


def test_chat_becomes_messages(spark):
    call = lambda i: {"id": i, "name": "web_search", "arguments": "{}"}
    chat = [("system", "s", None, None), ("user", "hi", None, None), ("assistant", " ", [call("1"), call("2")], None), ("tool", "r1", None, "1"), ("tool", "r2", None, "2"), ("assistant", None, None, None), ("tool", "r3", None, "3"), ("assistant", "bye", None, None)]
    kind = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string>>"
    df = spark.createDataFrame([(chat,), ([],)], f"chat {kind}")
    got, none = (r[0] for r in df.select(messages.from_chat(F.col("chat"))).collect())
    said = [(m["role"], [(b["type"], b["text"], b["id"]) for b in m["content"]]) for m in got]
    assert said == [
        ("user", [("text", "hi", None)]), ("assistant", [("tool_use", None, "1"), ("tool_use", None, "2")]), ("user", [("tool_result", "r1", "1"), ("tool_result", "r2", "2")]),
        ("assistant", [("text", "", None)]), ("user", [("tool_result", "r3", "3")]), ("assistant", [("text", "bye", None)]),
    ]
    assert none == []


def test_text_joiners(spark):
    df = spark.createDataFrame([(TRACE,)], f"m {messages.MESSAGES}")
    first, last = F.get("m", F.lit(0))["content"], F.try_element_at("m", F.lit(-1))["content"]
    assert df.select(messages.block_text(first), messages.block_text(last, "\n")).first()[:] == ("Ssamjang, Atlanta", 'Done: {"found": true, \n"menu": []} bye')


def test_reward_folds_punctuation(spark):
    df = spark.createDataFrame([(["Joe's (Best) Pie", "Cake"], "joe s  best-pie!")], "n array<string>, e string")
    g = df.select(messages.reward_evidence(F.col("n"), F.col("e")).alias("g")).first()["g"]
    assert g["fraction"] == 0.5 and g["misses"] == ["Cake"]


def test_slimming_rewrites_changed_rows_only(spark):
    df = spark.createDataFrame([(1, "a ![x](y)"), (2, "plain"), (3, None)], "k int, response string")
    assert [tuple(r) for r in cache.slim_rows(df).collect()] == [(1, "a ")]
    assert cache.slim_rows(cache.slim_rows(df)).count() == 0
    r = cache.slim_report(df, "response").first()
    assert (r["scanned"], r["changed"], r["chars_before"] - r["chars_after"]) == (3, 1, 7)
    assert {x["step"]: x["rows"] for x in cache.clean_changes(df.withColumn("status", F.lit("ok")), most=3).collect()} == {"slim": 1, "reclassify": 3, "clip": 1}


def test_groups_of_a_batch():
    assert sampling.effective_batch(2, 3, 4) == 24 and sampling.effective_batch(2, 3, 0) == 6
    sampling.check_groups(24, 8)
    for batch, group in ((24, 7), (24, 1)):
        with pytest.raises(ValueError):
            sampling.check_groups(batch, group)


def test_prompts_of_episodes(spark):
    df = spark.createDataFrame([(["vegan"],), (None,)], "r array<string>")
    a, b = (r["system_prompt"] for r in prompts.with_prompts(df, "r", "teacher").collect())
    assert "vegan" in a and "whole menu" in b and prompts.GUIDANCE in b
    with pytest.raises(ValueError):
        prompts.system_prompt(F.col("r"), "other")


def test_provenance_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "a", ["x", "y"]), (2, False, "b", [])], "k int, found boolean, src string, messages array<string>")
    side = files.sidecar(df, "found", "src", cap=5)
    assert (side["rows"], side["found"], side["found_false"], side["sources"], side["cap"]) == (2, 1, 1, 2, 5)
    (tmp_path / "run/checkpoint-9").mkdir(parents=True)
    assert files.checkpoint_meta(str(tmp_path / "run/checkpoint-9")) is None
    (tmp_path / "run/meta.json").write_text('{"a": 1}')
    assert files.checkpoint_meta(str(tmp_path / "run/checkpoint-9/")) == {"a": 1}
    files.export_candidates(df, str(tmp_path / "out"))
    assert {(r["k"], r["n_messages"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(1, 2), (2, 0)}


def test_snapshots_are_checked_and_pushes_skip_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert files.snapshot(df, str(tmp_path / "snap"), ["k"]) == 2 and files.snapshot(df, str(tmp_path / "snap"), ["k"]) == 2
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            files.snapshot(spark.createDataFrame(bad, "k int, v string"), str(tmp_path / "bad"), ["k"])
    src, dst = tmp_path / "src", tmp_path / "dst"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    assert files.push(spark, str(src), str(dst)) == {"pushed": 2, "skipped": 0, "remote_only": 0}
    (src / "a.txt").write_text("ONE")
    (dst / "c.txt").write_text("own")
    assert files.push(spark, str(src), str(dst)) == {"pushed": 1, "skipped": 1, "remote_only": 1}
    assert (dst / "a.txt").read_text() == "ONE" and (dst / "c.txt").exists()


def test_telemetry_and_upserts_survive_a_restart(spark, tmp_path):
    schema = "k string, seq long, v string, ok boolean, value double, ts timestamp"

    def put(n, rows):
        spark.createDataFrame([(*r, True, 1.0, datetime.datetime(2024, 1, 1, 0, n)) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        attempts.upsert_sink(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "ck")).awaitTermination()
        return {r["k"]: r["v"] for r in keyed.KeyedTable(spark, str(tmp_path / "out")).read().collect()}

    put(0, [("a", 1, "x"), ("b", 2, "y")])
    assert run() == {"a": "x", "b": "y"}
    put(1, [("a", 3, "z")])
    assert run() == {"a": "z", "b": "y"} and run() == {"a": "z", "b": "y"}
    put(59, [("c", 4, "w")])
    q = attempts.telemetry(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("telemetry").outputMode("complete").option("checkpointLocation", str(tmp_path / "t")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["ok_rate"]) for r in spark.table("telemetry").collect()) == [(1, 1.0), (3, 1.0)]


def test_evidence_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    words = ["red", "blue", "green", "go", "a", "x-y", "Straße", "the"]
    names = [(k, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for k in range(40)] + [(40, None), (41, "  "), (42, "re"), (43, "e")]
    texts = [(k, "  ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(30)] + [(30, None), (31, "")]
    fold = lambda s: " ".join((s or "").lower().split())
    want = {(i, j) for i, n in names for j, t in texts if fold(n) and fold(n) in fold(t)}
    got = messages.evidence_pairs(spark.createDataFrame(names, "name_id int, name string"), spark.createDataFrame(texts, "evidence_id int, evidence string"))
    assert {tuple(r) for r in got.collect()} == want


def test_contract_agrees_with_python(spark):
    rng = random.Random(2)
    odd = [None, True, 1, 2.5, "x", [], {}, [1], {"a": 1}, 10**30]

    def some(value):
        return rng.choice(odd) if rng.random() < 0.06 else value

    def without(d):
        return {k: v for k, v in d.items() if rng.random() > 0.03}

    texts = ['{"found":true,"found":false,"restaurant_name":"x","menu":[]}', '{"found":true,"restaurant_name":"x","menu":[{"section":"a","items":[{"name":"b","price":NaN}]}]}', "", "[", "nul"]
    for _ in range(400):
        items = lambda: [some(without({"name": some("n"), "description": some(None), "price": some(rng.choice([None, 1, 2.5, 1e9, 123456789012345678901234567890]))})) for _ in range(rng.randint(0, 2))]
        menu = [some(without({"section": some("s"), "items": some(items())})) for _ in range(rng.randint(0, 2))]
        texts.append(json.dumps(some(without({"found": some(True), "restaurant_name": some("r"), "menu": some(menu), "cuisine": some("c"), "notes": some(None), "more": 1}))))

    def want(t):
        try:
            return menus.is_valid_menu(json.loads(t))
        except ValueError:
            return False

    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", menus.schema_valid("t").alias("v"))
    wrong = [(texts[r["k"]], r["v"]) for r in got.collect() if r["v"] is not want(texts[r["k"]])]
    assert not wrong and 40 < sum(map(want, texts)) < 360


@pytest.mark.parametrize("alone", [0, 1 << 40])
def test_names_are_found_by_one_scan_as_by_many(spark, monkeypatch, alone):
    monkeypatch.setattr(messages, "ALONE", alone)
    monkeypatch.setattr(messages, "AUTOMATON_CHARS", 40)
    rng = random.Random(9)
    rows = [(k, ["".join(rng.choices("ab é\t", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 30))], "".join(rng.choices("abé  \n", k=rng.randint(0, 400)))) for k in range(60)]
    rows += [(60, None, "a"), (61, ["a", "b"], None), (62, [], ""), (63, [None, "A"], "xay")]
    df = spark.createDataFrame(rows, "k long, names array<string>, hay string")
    fold = lambda x: re.sub(r"\s+", " ", (x or "").lower())
    for r in df.select("k", "names", "hay", messages.grounding(F.col("names"), F.col("hay")).alias("g")).collect():
        names = r["names"] or []
        misses = [n for n in names if fold(n).strip() not in fold(r["hay"])]
        assert list(r["g"]["misses"]) == misses and r["g"]["n"] == len(names)
        assert r["g"]["fraction"] == ((len(names) - len(misses)) / len(names) if names else 0.0)


def test_evidence_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = ["ab", "b", "abc", "ca", "cab", "x", "abcd", "é"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    names = [(k, say(rng.randint(1, 5)).upper() if k % 3 else say(2)) for k in range(40)] + [(40, " "), (41, "no such words here"), (42, None)]
    evidence = [(k, say(rng.randint(0, 40)).replace(" ", rng.choice([" ", "  ", "\n"]))) for k in range(30)] + [(30, None), (31, "")]
    fold = lambda x: re.sub(r"\s+", " ", x.lower())
    want = {(n, e) for n, name in names if name and name.strip() for e, text in evidence if text is not None and fold(name).strip() in fold(text)}
    got = messages.evidence_pairs(spark.createDataFrame(names, "name_id long, name string"), spark.createDataFrame(evidence, "evidence_id long, evidence string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("rows", [40, 7, 10**6])
def test_runs_in_slices_are_as_in_one_window(spark, rows):
    """A hot run with a third of all rows, and more, goes over many groups; ties and null times too."""
    rng = random.Random(rows)
    data = [(k, None if rng.random() < 0.02 else float(rng.randint(0, 120)), rng.choice(["hot", "hot", "a", "b", None]), rng.random() < 0.3, rng.random() < 0.8, float(rng.randint(0, 9))) for k in range(600)]
    data += [(1000 + k, 200.0 + k, "bad", False, True, 1.0) for k in range(120)]
    df = spark.createDataFrame(data, "event_id long, at double, run string, ok boolean, counted boolean, value double").repartition(4)
    order = ["at", "event_id"]
    w = Window.partitionBy("run").orderBy(*order)
    bad = (~F.col("ok") & F.col("counted")).cast("int")
    want = df.withColumn("island", F.sum(1 - bad).over(w)).withColumn("streak", F.sum(bad).over(Window.partitionBy("run", "island").orderBy(*order)))
    got = cache.streaks(df, "run", order, ~F.col("ok"), F.col("counted"), rows=rows)
    rows_of = lambda x, *c: sorted(map(tuple, x.select("event_id", *c).collect()))
    assert rows_of(got, "streak") == rows_of(want, "streak") and set(got.columns) == {*df.columns, "streak"}
    timed = df.where("at IS NOT NULL")
    n = F.row_number().over(w) * 0.25
    want = timed.withColumn("n", n).withColumn("start", F.col("n") + F.max(F.col("at") - F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = cache.throttle(timed, "run", "at", "event_id", 0.25, rows=rows)
    assert rows_of(got, "start") == rows_of(want, "start")
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"done": F.count(F.lit(1)).over(far), "ok_rate": F.avg(F.col("ok").cast("double")).over(far), "mean_value": F.avg("value").over(far)})
    got = cache.running_rates(df, "run", order, F.col("ok"), F.col("value"), rows=rows)
    assert rows_of(got, "done", "ok_rate", "mean_value") == rows_of(want, "done", "ok_rate", "mean_value")
    if rows < 100:
        most = max(Counter((r["run"], r["s"]) for r in cache.streaks(df, "run", order, ~F.col("ok"), rows=rows).withColumn("s", F.floor("at")).collect()).values())
        assert len(cache._slices(df, "at", rows)) > 10 and most < 720


# labels


def say(role, content=None, calls=None, responses=None):
    return {"role": role, "content": content, "tool_calls": calls, "tool_responses": responses}


ROW = "k long, messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>,tool_responses:array<struct<name:string,response:string>>>>"


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_labels_are_those_of_whole_retokenisation(spark, file):
    path = pytest.importorskip("public_tokenizers").path(file)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    ids_of = lambda t: whole.encode(t, add_special_tokens=False).ids
    rng = random.Random(7)
    words = ["the menu", "Soup ", " straße", "漢字", "12.50", "\n\n", "  ", "don't", "x" * 60, '"q"', "<b>", "é", "a b c d"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for k in range(40):
        turns = [say("system", text(20)), say("user", text(5))]
        for _ in range(rng.randint(0, 3)):
            n = rng.randint(1, 2)
            turns.append(say("assistant", None, [("web_search", '{"q":"' + text(3) + '"}')] * n, [("web_search", text(rng.randint(0, 80)))] * n))
        rows.append((k, turns + [say("assistant", '{"found":true,"n":"' + text(4) + '"}')]))
    as_rows = [(k, [(m["role"], m["content"], m["tool_calls"], m["tool_responses"]) for m in turns]) for k, turns in rows]
    df = spark.createDataFrame([*as_rows, (98, []), (99, None)], ROW).repartition(3)
    df = df.select("k", F.when(F.col("k") == 99, "no messages").alias("skip_reason"), labels.rendered(F.col("messages")).alias("segments"))
    segments = {r["k"]: r["segments"] for r in df.collect()}
    got = {r["k"]: r for r in labels.token_labels(df, path, "k").collect()}
    assert got[99]["skip_reason"] == "no messages" and got[99]["input_ids"] is None and got[98]["input_ids"] == []
    kept = 0
    for k in range(40):
        full = "".join(s["text"] for s in segments[k])
        ids, mask, at, broken = ids_of(full), set(), 0, False
        for s in segments[k]:
            if s["learn"] and s["text"]:
                before, after = ids_of(full[:at]), ids_of(full[: at + len(s["text"])])
                broken |= before != ids[: len(before)] or after != ids[: len(after)]
                mask.update(range(len(before), len(after)))
            at += len(s["text"])
        if broken:
            assert got[k]["skip_reason"] == labels.BROKEN and got[k]["input_ids"] is None
            continue
        kept += 1
        assert got[k]["input_ids"] == ids and got[k]["labels"] == [x if i in mask else -100 for i, x in enumerate(ids)]
        learnt = whole.decode([x for x in got[k]["labels"] if x != -100])
        assert "search" in learnt or len(rows[k][1]) == 3
    assert kept >= 35


def test_a_row_whose_prefix_breaks_has_no_labels(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [(1, None, [("fine words ", False), ("here", True)]), (2, None, [("fine words", False), (" here", True)]), (3, None, [("wo", False), ("rds", True)]), (4, "skipped", None)]
    df = spark.createDataFrame(rows, "trace_id long, skip_reason string, segments array<struct<text:string,learn:boolean>>")
    got = {r["trace_id"]: r for r in labels.token_labels(df, path).collect()}
    assert [got[k]["skip_reason"] for k in (1, 2, 3, 4)] == [labels.BROKEN, None, labels.BROKEN, "skipped"]
    assert got[2]["labels"][:-1] == [-100] * (len(got[2]["labels"]) - 1) and got[2]["labels"][-1] == got[2]["input_ids"][-1]


def test_prefixes_are_extended_not_encoded_again():
    asked = []

    def encode(text):
        asked.append(len(text))
        return [ord(c) for c in text]

    text = "some words in a row " * 500
    ends = list(range(100, len(text), 100))
    assert labels.prefix_ids(encode, text, ends) == [[ord(c) for c in text[:e]] for e in ends]
    assert sum(asked) < 4 * len(text)


# keyed tables


def table_of(spark, tmp_path, ranges=8):
    t = keyed.KeyedTable(spark, str(tmp_path / "table"))
    rows = spark.createDataFrame([(k, f"v{k}", "sft" if k % 2 else None, 0) for k in range(400)], "k long, v string, split string, seq long")
    t.create(rows.schema, ["k"], ranges)
    t.upsert(rows.withColumn("_n", F.lit(0)), "_n")
    return t, rows


def bytes_of(tmp_path):
    return {p: p.stat().st_size for p in (tmp_path / "table/data").rglob("*.parquet")}


def test_only_touched_files_are_written(spark, tmp_path):
    t, rows = table_of(spark, tmp_path)
    before = bytes_of(tmp_path)
    update = spark.createDataFrame([(7, "new", None, 1, 1), (7, "newer", None, 2, 2)], "k long, v string, split string, seq long, _n long")
    assert t.upsert(update, "_n") == 2
    new = {p: n for p, n in bytes_of(tmp_path).items() if p not in before}
    assert len(new) == 1 and sum(new.values()) < sum(before.values()) / 4
    assert {r["k"]: r["v"] for r in t.read().collect()} == {k: "newer" if k == 7 else f"v{k}" for k in range(400)}
    assert t.read(1).where("k = 7").first()["v"] == "v7" and t.read(1).count() == 400
    assert [r["v"] for r in t.lookup(spark.createDataFrame([(7,), (999,)], "k long")).collect()] == ["newer"]
    keep = lambda base, new, keys, order: corpus.upsert_preserving(base, new.withColumn("_has", F.lit(False)), keys, "split", "_has")
    t.upsert(spark.createDataFrame([(9, "w", "eval", 3, 3)], update.schema), "_n", merge=keep)
    assert t.read().where("k = 9").first()[:3] == (9, "w", "sft")
    files_before = len(bytes_of(tmp_path))
    assert t.vacuum(keep=1) == 2 and len(bytes_of(tmp_path)) == files_before - 2 and t.numbers() == [3] and t.read().count() == 400
    with pytest.raises(FileNotFoundError):
        t.read(1)


def test_large_ranges_are_halved_and_batches_count_once(spark, tmp_path):
    t, rows = table_of(spark, tmp_path, ranges=1)
    more = rows.select((F.col("k") + 400).alias("k"), "v", "split", "seq", F.lit(0).alias("_n"))
    assert t.upsert(more, "_n", source=("s", 4), file_rows=100) == 2 and t.upsert(more.withColumn("v", F.lit("x")), "_n", source=("s", 4)) == 2
    v = t.version()
    assert len(v.ranges) == 8 and sum(r[3] for r in v.ranges) == 800 == t.read().count() and v.ranges[0][0] == -(1 << 63) and v.ranges[-1][1] == (1 << 63) - 1
    assert t.upsert(more.limit(0), "_n", source=("s", 5)) == 3 and t.version().applied == {"s": 5}
    assert {r[0] for r in t.read().select("k").collect()} == set(range(800))
    with pytest.raises(keyed.CommitConflict):
        t.create(rows.schema, ["k"])


def test_commits_conflict_and_failures_leave_the_last_version(spark, tmp_path, monkeypatch):
    t, rows = table_of(spark, tmp_path)
    update = lambda v: spark.createDataFrame([(1, v, None, 1, 1)], "k long, v string, split string, seq long, _n long")
    base, seen = t.version, []

    def stale(number=None):
        """As if another writer commits between this one's reading and its commit, once."""
        found = base(number)
        if not seen:
            seen.append(1)
            keyed.KeyedTable(spark, t.path).upsert(update("other"), "_n")
        return found

    t.version = stale
    with pytest.raises(keyed.CommitConflict):
        t.upsert(update("mine"), "_n")
    assert t.read().where("k = 1").first()["v"] == "other"
    seen.clear()
    t.upsert_retrying(update("mine"), "_n")
    assert t.read().where("k = 1").first()["v"] == "mine" and t.read().count() == 400
    del t.version
    last = t.numbers()[-1]
    with pytest.raises(Exception, match="broken"):
        t.upsert(update("bad"), "_n", merge=lambda base, new, keys, order: base.select(*[F.raise_error(F.lit("broken")).cast(k).alias(c) for c, k in base.dtypes]))
    assert t.numbers()[-1] == last and t.read().where("k = 1").first()["v"] == "mine"
    (tmp_path / f"table/versions/{last + 1:012d}.json.claim").write_text("")  # a writer that was lost
    with pytest.raises(keyed.CommitConflict):
        t.upsert(update("late"), "_n")
    monkeypatch.setattr(keyed, "CLAIM_S", -1)
    t.upsert(update("late"), "_n")
    assert t.read().where("k = 1").first()["v"] == "late"


# streams in event order


EVENTS = "event_id long, key string, ts timestamp, ok boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_result_of_a_batch(spark, tmp_path, seed):
    """Rows arrive in files shuffled within the watermark; each query stops after some files and goes on from its checkpoint."""
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, rng.choice("aab"), start + datetime.timedelta(seconds=rng.randint(0, 200)), rng.random() < 0.4) for k in range(120)]
    arrive = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 60)))
    flush = [(10_000, "z", start + datetime.timedelta(days=2), True), (10_001, "z", start + datetime.timedelta(days=3), True)]
    parts = [arrive[:40], arrive[40:80], arrive[80:], flush[:1], flush[1:]]
    ops = {"hits": lambda s: ordered.replay(s, "5 minutes"), "starts": lambda s: ordered.throttle(s.withColumnRenamed("key", "host"), 2.0, "5 minutes"), "streaks": lambda s: ordered.streaks(s.withColumnRenamed("key", "run"), 3, "5 minutes"), "progress": lambda s: ordered.progress(s.withColumnRenamed("key", "run"), 10, "5 minutes")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(name):
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ops[name](stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start().awaitTermination()

    for n, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n in (1, 4):
            for name in ops:
                run(name)
    df = spark.createDataFrame(rows, EVENTS)
    got = lambda name, *c: {r["event_id"]: tuple(r[x] for x in c) for r in spark.read.parquet(str(tmp_path / name)).where("event_id < 10000").collect()}
    want = lambda d, *c: {r["event_id"]: tuple(r[x] for x in c) for r in d.collect()}
    assert got("hits", "hit") == want(cache.replay(df, "key", ["ts", "event_id"], F.col("ok")), "hit")
    assert got("starts", "start") == want(cache.throttle(df.withColumn("at", F.unix_micros("ts") / F.lit(1e6)), "key", "at", "event_id", 2.0), "start")
    assert got("streaks", "streak") == want(cache.streaks(df, "key", ["ts", "event_id"], ~F.col("ok")), "streak")
    assert got("progress", "done", "ok_rate") == want(cache.running_rates(df, "key", ["ts", "event_id"], F.col("ok"), F.lit(1.0)), "done", "ok_rate")
    assert all(c == (d % 10 == 0) for d, c in got("progress", "done", "checkpoint").values())
