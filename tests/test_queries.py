"""Every query with SQL against DuckDB on the smallest tables; plans without cartesian products; the entry point."""

import os
from difflib import SequenceMatcher
from functools import partial

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tracewright import plans
from tracewright.operators import cache

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The only queries that join with a literal relation of a few rows.
SMALL_CROSS = {"domain_counts"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_plan_has_no_cartesian_product(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name in SMALL_CROSS or "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rates_in_slices_agree_with_sql(spark, duck, monkeypatch):
    monkeypatch.setattr(cache, "running_rates", partial(cache.running_rates, rows=100))
    got, want = plans.QUERIES["running_rates"](spark, SF).toPandas(), duck.sql(plans.ORACLE_SQL["running_rates"]).df()
    assert rows(got) == rows(want)


def test_durations_add_floats_in_the_order_of_events(spark, tmp_path):
    """0.7 + 0.2 + 0.1 is under 1 as floats, 0.1 + 0.2 + 0.7 is not; rows lie in another order than their ids."""
    data = [(3, 1, 0.1), (2, 1, 0.2), (1, 1, 0.7), (4, 2, None), (6, 3, 0.7), (5, 3, 0.2), (4, 3, 0.1)]
    spark.createDataFrame(data, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = dict(map(tuple, plans.QUERIES["format_duration"](spark, str(tmp_path)).collect()))
    assert (got[1], got[3]) == ("0s", "1s")


@pytest.mark.parametrize("name, once", [("normalize_restrictions", {"array_position": 0}), ("menu_reach", {"instr(": 1})])
def test_plan_does_work_once(spark, name, once):
    """No search of a list for each of its elements, no text sought twice."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert {k: plan.count(k) for k in once} == once


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["traces_of_source"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "PushedFilters: [" in plan


def test_paired_scores_by_hand(spark, duck):
    """Matches of every trace's items, one after the other by full scores; sections by SQL."""

    def fold(name):
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in name.casefold()).split())

    def alike(a, b):
        a, b = fold(a), fold(b)
        x, y = set(a.split()), set(b.split())
        inside = len(x & y) / min(len(x), len(y)) if min(len(x), len(y)) > 1 else 0.0
        return 1.0 if a == b else max(SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y), inside)

    items = duck.sql("""SELECT l_orderkey AS t, l_linenumber AS pos, p_name AS name, CASE WHEN l_orderkey % 10 <> 0 THEN l_extendedprice END AS price, l_returnflag AS section, l_quantity > 10 AS cand
      FROM lineitem JOIN part ON l_partkey = p_partkey ORDER BY t, pos, name, price NULLS FIRST""").fetchall()
    ref = {}
    for t, *item in items:
        ref.setdefault(t, []).append(item)
    found_r = {t for (t,) in duck.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'").fetchall()}
    matched = {r["trace_id"]: r["matched"] for r in plans.QUERIES["fuzzy_item_match"](spark, SF).collect()}
    scored = {r["trace_id"]: r for r in plans.QUERIES["score_episode"](spark, SF).collect()}
    for t, own in ref.items():
        c = [i for i in own if i[4]] if t % 4 else []
        r = own if t in found_r else []
        pairs = sorted((-s, a[2] != b[2] and (a[2] is None or b[2] is None or abs(a[2] - b[2]) > 0.005), i, j) for i, a in enumerate(c) for j, b in enumerate(r) if (s := alike(a[1], b[1])) >= 0.75)
        used_c, used_r = set(), set()
        for _, _, i, j in pairs:
            if i not in used_c and j not in used_r:
                used_c.add(i)
                used_r.add(j)
        assert matched[t] == len(used_c), t
        both = t % 11 and t % 4 and t in found_r
        want = len({i[3] for i in own if i[4]}) - len({i[3] for i in own}) if both else None
        assert scored[t]["section_delta"] == want and scored[t]["item_delta"] == (len(c) - len(r) if both else None)
