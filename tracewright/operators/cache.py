"""Cache semantics over tables: replay, maintenance reports, throttling, streaks, warm plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import scrape_status
from ..functions.text import MAX_STORED_CHARS, slim


def replay(events: DataFrame, key: str, order: list[str], stored: Column) -> DataFrame:
    """``events`` with hit: whether an earlier attempt of the same key was stored.

    The first stored attempt of each key is a minimum, summed before it is shuffled, so a hot key's attempts meet only
    in a join that adaptive execution can split. ``order`` tells attempts of a key apart.
    """
    first = events.where(stored).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = events.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("hit", F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))).drop("_key", "_first")


def hit_rate(hits: Column, lookups: Column) -> Column:
    return F.when(lookups > 0, hits / lookups)


def store(rows: DataFrame, *, most: int = MAX_STORED_CHARS, veto: Column | None = None) -> DataFrame:
    """Responses with their status by the whole text, then clipped; vetoed ones are not stored."""
    rows = rows if veto is None else rows.where(~veto)
    return rows.withColumn("status", scrape_status(F.col("response"))).withColumn("response", F.substring("response", 1, most))


def clip_report(rows: DataFrame, text: str, most: int) -> DataFrame:
    """Rows over the limit, characters beyond it, and the longest."""
    n, over = F.length(text), F.length(text) > most
    return rows.agg(F.count_if(over).alias("rows_over"), F.coalesce(F.sum(F.when(over, n - most)), F.lit(0)).alias("chars_over"), F.coalesce(F.max(F.when(over, n)), F.lit(0)).alias("longest"))


def slim_report(rows: DataFrame, text: str, slimmer=slim) -> DataFrame:
    """Rows scanned and changed, characters before and after; null texts are scanned and untouched."""
    rows = rows.select(F.col(text).alias("a"), slimmer(F.col(text)).alias("b"))
    changed = F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(changed).alias("changed"),
        F.coalesce(F.sum(F.length("a")), F.lit(0)).alias("chars_before"), F.coalesce(F.sum(F.length("b")), F.lit(0)).alias("chars_after"),
    )


def reclassify(rows: DataFrame, text: str, status: str) -> DataFrame:
    """(transition, n) of statuses that the stored text changes; run after slimming."""
    new = scrape_status(F.col(text))
    rows = rows.select(F.concat(F.col(status), F.lit("->"), new).alias("transition"), (F.col(status) != new).alias("changed"))
    return rows.where("changed").groupBy("transition").agg(F.count(F.lit(1)).alias("n"))


def slim_rows(rows: DataFrame, text: str = "response", slimmer=slim) -> DataFrame:
    """CA5: the rows that slimming changes, with their new text; a second run gives none. Null texts stay as they are."""
    rows = rows.withColumn("_new", slimmer(F.col(text)))
    return rows.where(F.col(text) != F.col("_new")).withColumn(text, F.col("_new")).drop("_new")


def clean(rows: DataFrame, text: str = "response", most: int = MAX_STORED_CHARS) -> DataFrame:
    """CA7: slim, classify, clip, in this order; a second run changes nothing."""
    rows = rows.withColumn(text, slim(F.col(text)))
    rows = rows.withColumn("status", scrape_status(F.col(text)))
    return rows.withColumn(text, slim(F.substring(text, 1, most)))  # a cut can leave a bullet with nothing after it


def clean_changes(rows: DataFrame, text: str = "response", status: str = "status", most: int = MAX_STORED_CHARS) -> DataFrame:
    """CA7 as a dry run: (step, rows): how many rows slimming, classifying and clipping would change; nothing is written."""
    new = slim(F.col(text))
    rows = rows.select(F.col(text).alias("old"), F.col(status).alias("status"), new.alias("new")).withColumn("now", scrape_status(F.col("new")))
    counts = rows.agg(F.count_if(F.col("old") != F.col("new")).alias("slim"), F.count_if(F.col("status") != F.col("now")).alias("reclassify"), F.count_if(F.length("new") > most).alias("clip"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("step"), F.col(c).alias("rows")) for c in counts.columns])).alias("x")).select("x.*")


#: Rows of a table up to which each run, however long, is one group of a window.
RUN_ROWS = 1_000_000


def _slices(df: DataFrame, number: str, rows: int) -> list | None:
    """Cuts of ``number`` that part the rows into slices of some ``rows``; None where one slice is enough."""
    n = df.count()
    if n <= rows:
        return None
    parts = math.ceil(n / rows) * 2
    return sorted(set(df.select(F.percentile_approx(number, [k / parts for k in range(1, parts)], 10 * parts)).first()[0])) or None


def _place(x: Column, cuts: list[Column]) -> Column:
    """How many of the ascending cuts are not above ``x``, by halving; 0 where it is null.

    No lambda: the planner carries one over from the rows to their summaries, where ``x`` is not.
    """
    place = lambda lo, hi: F.lit(lo) if lo == hi else F.when(x >= cuts[(lo + hi) // 2], place((lo + hi) // 2 + 1, hi)).otherwise(place(lo, (lo + hi) // 2))
    return place(0, len(cuts))


def segmented(df: DataFrame, run: str, order: list[str], rows: int, local, summary: dict[str, Column], carry, incoming: dict[str, str], finish) -> DataFrame:
    """A running value of each run that depends on all before it, in slices of time that are run apart.

    ``order[0]``, a number or time, is cut at approximate quantiles; a run's slice is a group of its own. ``local`` (rows,
    window) gives the value within the slice, ``summary`` what a slice tells those after it, ``carry`` (summaries, window
    of a run's slices) the columns ``incoming`` from before, and ``finish`` joins both. So a group holds a slice, and of
    a run only a row a slice meets elsewhere. A table of up to ``rows`` rows is one slice.
    """
    cuts = _slices(df, order[0], rows)
    at = F.lit(0) if cuts is None else _place(F.col(order[0]), [F.lit(c).cast(df.schema[order[0]].dataType) for c in cuts])
    df = local(df.withColumn("_slice", at), Window.partitionBy(run, "_slice").orderBy(*order))
    if cuts is None:
        return finish(df.withColumns({c: F.lit(None).cast(t) for c, t in incoming.items()})).drop("_slice")
    told = df.groupBy(F.col(run).alias("_run"), F.col("_slice").alias("_at")).agg(*[v.alias(k) for k, v in summary.items()])
    came = carry(told, Window.partitionBy("_run").orderBy("_at")).select("_run", "_at", *[F.col(c).cast(t).alias(c) for c, t in incoming.items()])
    joined = df.join(came, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_slice") == F.col("_at")))
    return finish(joined.drop("_run", "_at")).drop("_slice")


def throttle(arrivals: DataFrame, host: str, at: str, order: str, gap: float = 1.0, rows: int = RUN_ROWS) -> DataFrame:
    """``arrivals`` with start: first come, first served by host, starts at least ``gap`` apart.

    The n-th start of a host is n gaps after the greatest of (arrival less its own number of gaps) so far; numbers and
    maxima of a slice carry into the next, so that a hot host is many groups.
    """

    def local(df: DataFrame, w) -> DataFrame:
        df = df.withColumn("_n", F.row_number().over(w))
        return df.withColumn("_d", F.col(at) - F.col("_n") * gap).withColumn("_d", F.max("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def carry(told: DataFrame, w) -> DataFrame:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        told = told.withColumn("_in_n", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        return told.withColumn("_in_d", F.max(F.col("_most") - F.col("_in_n") * gap).over(before))

    def finish(df: DataFrame) -> DataFrame:
        n = F.coalesce("_in_n", F.lit(0))
        start = (F.col("_n") + n) * gap + F.greatest(F.col("_d") - n * gap, F.col("_in_d"))
        return df.withColumn("start", start).drop("_n", "_d", "_in_n", "_in_d")

    return segmented(arrivals, host, [at, order], rows, local, {"_count": F.count(F.lit(1)), "_most": F.max("_d")}, carry, {"_in_n": "long", "_in_d": "double"}, finish)


def streaks(events: DataFrame, run: str, order: list[str], failed: Column, counted: Column | None = None, rows: int = RUN_ROWS) -> DataFrame:
    """``events`` with streak: consecutive failures up to here in its run; anything that is no failure resets.

    ``counted`` restricts what counts as a failure, as broken machines among all failures. Of a slice the next ones need
    whether it has a reset, and how many failures come after the last.
    """
    bad = failed if counted is None else failed & counted

    def local(df: DataFrame, w) -> DataFrame:
        df = df.withColumn("_bad", bad.cast("int"))
        df = df.withColumn("_island", F.sum(1 - F.col("_bad")).over(w))
        return df.withColumn("_streak", F.sum("_bad").over(Window.partitionBy(run, "_slice", "_island").orderBy(*order)))

    def carry(told: DataFrame, w) -> DataFrame:
        reset = F.col("_resets") > 0
        told = told.withColumn("_group", F.sum(reset.cast("int")).over(w))
        told = told.withColumn("_tail", F.sum("_after").over(Window.partitionBy("_run", "_group").orderBy("_at")))
        return told.withColumn("_in_streak", F.lag("_tail").over(w))

    def finish(df: DataFrame) -> DataFrame:
        open_ = F.when(F.col("_island") == 0, F.coalesce("_in_streak", F.lit(0))).otherwise(0)
        return df.withColumn("streak", F.col("_streak") + open_).drop("_bad", "_island", "_streak", "_in_streak")

    after = F.max(F.struct("_island", "_streak"))["_streak"]  # the last island's longest streak is what the slice ends with
    return segmented(events, run, order, rows, local, {"_resets": F.sum(1 - F.col("_bad")), "_after": after}, carry, {"_in_streak": "long"}, finish)


def running_rates(events: DataFrame, run: str, order: list[str], ok: Column, value: Column, rows: int = RUN_ROWS) -> DataFrame:
    """``events`` with done, ok_rate and mean_value so far in its run; sums of a slice carry into the next."""

    def local(df: DataFrame, w) -> DataFrame:
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({"_done": F.count(F.lit(1)).over(w), "_ok": F.sum(ok.cast("double")).over(w), "_known": F.count(ok).over(w), "_sum": F.sum(value).over(w), "_valued": F.count(value).over(w)})

    sums = ("_done", "_ok", "_known", "_sum", "_valued")

    def carry(told: DataFrame, w) -> DataFrame:
        return told.withColumns({f"_in{c}": F.sum(f"_all{c}").over(w.rowsBetween(Window.unboundedPreceding, -1)) for c in sums})

    def finish(df: DataFrame) -> DataFrame:
        all_ = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_in{c}", F.lit(0))
        share = lambda a, n: F.when(all_(n) > 0, all_(a) / all_(n))
        df = df.withColumns({"done": all_("_done").cast("long"), "ok_rate": share("_ok", "_known"), "mean_value": share("_sum", "_valued")})
        return df.drop(*sums, *[f"_in{c}" for c in sums])

    summary = {"_all_done": F.count(F.lit(1)), "_all_ok": F.sum(ok.cast("double")), "_all_known": F.count(ok), "_all_sum": F.sum(value), "_all_valued": F.count(value)}
    return segmented(events, run, order, rows, local, summary, carry, {"_in_done": "long", "_in_ok": "double", "_in_known": "long", "_in_sum": "double", "_in_valued": "long"}, finish)


def url_funnel(ranked: DataFrame, query: str, rank: str, dead: Column, keep: int = 3) -> DataFrame:
    """Results in rank order until ``keep`` live ones are kept: kept or skipped; what comes after is not emitted."""
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_live", (~dead).cast("int"))
    before = F.coalesce(F.sum("_live").over(w), F.lit(0))
    return ranked.withColumn("_before", before).where(F.col("_before") < keep).withColumn("kept", F.col("_live") == 1).drop("_live", "_before")


def warm_plan(urls: DataFrame, url: str, dead: Column, direct_chars: Column, direct_status: Column, *, both: bool = False, under: int = 2000) -> DataFrame:
    """(url, mode) to fetch: direct for all; browser too for sentinels, site errors, thin pages, or on demand."""
    browser = F.lit(both) | dead | F.coalesce(direct_status == "error", F.lit(False)) | F.coalesce(direct_chars < under, F.lit(False))
    modes = F.when(browser, F.array(F.lit("direct"), F.lit("browser"))).otherwise(F.array(F.lit("direct")))
    return urls.withColumn("_modes", modes).withColumn("mode", F.explode("_modes")).drop("_modes")


def checkpoints(events: DataFrame, seq: str, total: int, every: int) -> DataFrame:
    """Rows after which a checkpoint is due: every so many, and the last."""
    return events.where((F.col(seq) % every == 0) | (F.col(seq) == total))
