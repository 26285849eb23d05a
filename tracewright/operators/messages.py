"""Operators over trajectories, exploded once into turns and blocks."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import system_prompt
from ..functions.text import collapse, fold_words, let, transform_tool_result
from .menus import extract_json

#: Label of tokens that no loss is taken on (fixed value).
IGNORED = -100


def call_pairs(blocks: DataFrame) -> DataFrame:
    """Each tool_use with the last tool_result of its id that comes after it in the trace; none leaves nulls.

    blocks: trace_id, pos, type, id (of use or result), name, content.
    """
    use = blocks.where("type = 'tool_use'").select("trace_id", F.col("pos").alias("call_pos"), "id", "name", F.col("content").alias("input"))
    result = blocks.where("type = 'tool_result'").select("trace_id", "id", F.col("pos").alias("result_pos"), F.col("content").alias("result"))
    joined = use.join(result.withColumnsRenamed({"trace_id": "_t", "id": "_i"}), (F.col("trace_id") == F.col("_t")) & (F.col("id") == F.col("_i")) & (F.col("result_pos") > F.col("call_pos")), "left")
    last = F.max(F.when(F.col("result_pos").isNotNull(), F.struct("result_pos", "result"))).alias("_r")
    out = joined.groupBy("trace_id", "call_pos", "id", "name", "input").agg(last)
    return out.select("trace_id", "call_pos", "id", "name", "input", F.col("_r.result_pos").alias("result_pos"), F.col("_r.result").alias("result"))


def next_turn_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each assistant turn with the user turn right after it; an empty text if there is none."""
    a = turns.where("role = 'assistant'").select(key, "turn", F.col("text").alias("call"))
    u = turns.where("role = 'user'").select(F.col(key).alias("_k"), (F.col("turn") - 1).alias("_turn"), F.col("text").alias("_text"))
    out = a.join(u, (F.col(key) == F.col("_k")) & (F.col("turn") == F.col("_turn")), "left")
    return out.select(key, "turn", "call", F.coalesce("_text", F.lit("")).alias("result"))


def turn_bundles(turns: DataFrame, bundled: str = "user", key: str = "conv_id") -> DataFrame:
    """Consecutive turns of role ``bundled`` as one; others on their own; system turns are dropped."""
    turns = turns.where("role != 'system'")
    w = Window.partitionBy(key).orderBy("turn")
    prev = F.lag("role").over(w)
    start = F.when((F.col("role") != bundled) | prev.isNull() | (prev != bundled), 1).otherwise(0)
    turns = turns.withColumn("_s", start).withColumn("bundle", F.sum("_s").over(w))
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy(key, "bundle", "role").agg(F.count(F.lit(1)).alias("n_parts"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def tool_text(turns: DataFrame, roles=("user",), key: str = "conv_id") -> DataFrame:
    """All evidence of a trace in order, joined by line ends, lower case."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.where(F.col("role").isin(*roles)).groupBy(key).agg(F.lower(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("evidence"))


def walk_turns(turns: DataFrame, key: str = "conv_id", most: int = 800) -> DataFrame:
    """Turns that are not wholly empty, numbered anew from 0, with previews."""
    turns = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    n = F.row_number().over(Window.partitionBy(key).orderBy("turn")) - 1
    return turns.select(key, n.alias("idx"), "role", F.substring("text", 1, most).alias("preview"), (F.length("text") > most).alias("truncated"), F.length("text").alias("full_len"))


def sft_skip_reason(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, skip_reason): why a trace gives no training row; null if it does."""
    turns = turns.where("role != 'system'")
    first, last = F.min(F.struct("turn", "role")), F.max(F.struct("turn", "role", "text"))
    out = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), first.alias("f"), last.alias("l"))
    reason = (
        F.when(F.col("l.role") != "assistant", "last turn not assistant")
        .when(F.col("f.role") != "user", "first turn not user")
        .when(F.trim(F.coalesce("l.text", F.lit(""))) == "", "final answer unparsable")
    )
    return out.select(key, "n_turns", reason.alias("skip_reason"))


def round_trip_reason(rendered: Column, needles: Column, forbidden: str) -> Column:
    """The first check that a rendering fails: a teacher-only phrase in it, or a needle that is missing; else null."""
    missing = F.filter(needles, lambda n: (n != "") & ~F.contains(rendered, n))
    return F.when(F.contains(rendered, F.lit(forbidden)), "teacher-only phrase").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.get(missing, F.lit(0))))


def label_mask(ids: Column, spans: Column) -> Column:
    """ids where some span [st, en) covers the place, else IGNORED."""
    return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["st"]) & (i < s["en"])), x).otherwise(F.lit(IGNORED).cast("long")))


def pad_batch(df: DataFrame, ids: str, batch: str, pad: int = 0) -> DataFrame:
    """``df`` with ids padded on the right to the longest of the batch, an attention mask, and labels ignored there."""
    longest = df.groupBy(F.col(batch).alias("_b")).agg(F.max(F.size(ids)).alias("_m"))
    out = df.join(longest, F.col(batch) == F.col("_b"))
    more = F.col("_m") - F.size(ids)
    fill = lambda v: F.array_repeat(F.lit(v).cast("long"), more)
    return out.withColumns({
        "padded": F.concat(ids, fill(pad)), "mask": F.concat(F.array_repeat(F.lit(1).cast("long"), F.size(ids)), fill(0)), "labels": F.concat(ids, fill(IGNORED)),
    }).drop("_b", "_m")


# --- traces as arrays of messages ---
#
# A message is struct<role, content>; content an array of blocks struct<type, text, id, name, input>. Blocks are text,
# tool_use (id, name, input as JSON) and tool_result (id of its use, text). A plain text is one text block.

#: How a failed fetch begins, and the mode that a fetch has unless it says so.
FAILED_FETCH, DEFAULT_MODE = "(scrape failed", "direct"
BLOCK = "struct<type:string,text:string,id:string,name:string,input:string>"
MESSAGES = f"array<struct<role:string,content:array<{BLOCK}>>>"


def _block(kind: str, text=None, id_=None, name=None, input_=None) -> Column:
    none = F.lit(None).cast("string")
    parts = (F.lit(kind), *(none if x is None else x for x in (text, id_, name, input_)))
    return F.struct(*[x.alias(n) for x, n in zip(parts, ("type", "text", "id", "name", "input"))])


def block_text(content: Column, joiner: str = "") -> Column:
    """JS9: the texts of a message's text blocks, joined."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), joiner)


def from_chat(chat: Column) -> Column:
    """O-MSG1: a chat of struct<role, content, tool_calls array<struct<id, name, arguments>>, tool_call_id> as messages.

    System turns go. A user's text is one block; an assistant's is its text unless blank and its calls, or one empty
    block; consecutive tool turns are the results of one user turn.
    """
    chat = F.filter(chat, lambda m: m["role"] != "system")
    chat = F.transform(chat, lambda m, i: F.struct(m.alias("m"), i.alias("i"), (m["role"] == "tool").alias("tool")))

    def message(x, all_):
        m = x["m"]
        calls = F.transform(F.coalesce(m["tool_calls"], F.array()), lambda c: _block("tool_use", None, c["id"], c["name"], c["arguments"]))
        said = F.when(F.trim(F.coalesce(m["content"], F.lit(""))) != "", F.array(_block("text", m["content"]))).otherwise(F.array().cast(f"array<{BLOCK}>"))
        assistant = F.concat(said, calls)
        assistant = F.when(F.size(assistant) > 0, assistant).otherwise(F.array(_block("text", F.lit(""))))
        after = F.filter(all_, lambda y: ~y["tool"] & (y["i"] > x["i"]))
        until = F.coalesce(F.array_min(F.transform(after, lambda y: y["i"])), F.lit(1 << 30))
        results = F.transform(F.filter(all_, lambda y: y["tool"] & (y["i"] >= x["i"]) & (y["i"] < until)), lambda y: _block("tool_result", F.coalesce(y["m"]["content"], F.lit("")), y["m"]["tool_call_id"]))
        content = F.when(x["tool"], results).when(m["role"] == "assistant", assistant).otherwise(F.array(_block("text", F.coalesce(m["content"], F.lit("")))))
        return F.struct(F.when(x["tool"], F.lit("user")).otherwise(m["role"]).alias("role"), content.alias("content"))

    begins = lambda x, all_: ~x["tool"] | ~F.exists(all_, lambda y: y["tool"] & (y["i"] == x["i"] - 1))
    bound = F.transform(F.array(chat), lambda all_: F.transform(F.filter(all_, lambda x: begins(x, all_)), lambda x: message(x, all_)))
    return F.get(bound, F.lit(0)).cast(MESSAGES)


def _placed_blocks(messages: Column) -> Column:
    """All blocks in order: struct(pos, role, b)."""
    placed = F.flatten(F.transform(messages, lambda m: F.transform(F.coalesce(m["content"], F.array().cast(f"array<{BLOCK}>")), lambda b: F.struct(m["role"].alias("role"), b.alias("b")))))
    return F.transform(placed, lambda x, i: F.struct(i.alias("pos"), x["role"].alias("role"), x["b"].alias("b")))


def trace_calls(messages: Column, queries: Column, urls: Column) -> Column:
    """O-MSG3: struct(queries, fetches array<struct<url, mode, failed>>, n_calls) of a trace's tool uses, in order.

    A fetch has failed if the last result of its id that follows it, and no later use of the id, says so. A trace
    without messages has the queries and urls that are stored with it, in an unknown mode.
    """
    argument = lambda b, k: F.coalesce(F.get_json_object(b["input"], f"$.{k}"), F.lit(""))

    def parse(all_):
        uses = F.filter(all_, lambda x: (x["role"] == "assistant") & (x["b"]["type"] == "tool_use"))

        def fetch(u):
            own = F.filter(all_, lambda r: (r["b"]["type"] == "tool_result") & (r["b"]["id"] == u["b"]["id"]) & (r["pos"] > u["pos"]) & ~F.exists(uses, lambda v: (v["b"]["id"] == u["b"]["id"]) & (v["pos"] > u["pos"]) & (v["pos"] < r["pos"])))
            failed = F.coalesce(F.startswith(F.get(own, F.size(own) - 1)["b"]["text"], F.lit(FAILED_FETCH)), F.lit(False))
            mode = F.coalesce(F.get_json_object(u["b"]["input"], "$.mode"), F.lit(DEFAULT_MODE))
            return F.struct(argument(u["b"], "url").alias("url"), mode.alias("mode"), failed.alias("failed"))

        return F.struct(
            F.transform(F.filter(uses, lambda u: u["b"]["name"] == "web_search"), lambda u: argument(u["b"], "query")).alias("queries"),
            F.transform(F.filter(uses, lambda u: u["b"]["name"] == "scrape_url"), fetch).alias("fetches"), F.size(uses).alias("n_calls"),
        )

    texts = F.array().cast("array<string>")
    queries, urls = F.coalesce(queries, texts), F.coalesce(urls, texts)
    stored = F.struct(queries.alias("queries"), F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit("unknown").alias("mode"), F.lit(False).alias("failed"))).alias("fetches"), (F.size(queries) + F.size(urls)).alias("n_calls"))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) == 0, stored).otherwise(F.get(F.transform(F.array(_placed_blocks(messages)), parse), F.lit(0)))


def trace_results(messages: Column) -> Column:
    """O-MSG4: struct(scrapes, searches): whole texts of the results in user turns by their tool, in order."""

    def parse(all_):
        named = lambda r: F.get(F.transform(F.slice(F.reverse(F.filter(all_, lambda u: (u["role"] == "assistant") & (u["b"]["type"] == "tool_use") & (u["b"]["id"] == r["b"]["id"]))), 1, 1), lambda u: u["b"]["name"]), F.lit(0))
        results = F.filter(all_, lambda r: (r["role"] == "user") & (r["b"]["type"] == "tool_result"))
        of = lambda tool: F.transform(F.filter(results, lambda r: named(r) == tool), lambda r: F.coalesce(r["b"]["text"], F.lit("")))
        return F.struct(of("scrape_url").alias("scrapes"), of("web_search").alias("searches"))

    return F.get(F.transform(F.array(_placed_blocks(messages)), parse), F.lit(0))


def training_rows(traces: DataFrame, key: str = "trace_id") -> DataFrame:
    """O-MSG6: (key, skip_reason, messages): each trace as a student sees it, or why it gives no row.

    traces: key, messages, restrictions (array or null). The student's system prompt, the first turn's text, each
    assistant turn with calls and, beside them, the results of the user turn right after it, slimmed and capped as at
    inference, then the last turn's answer as compact JSON. Thoughts and texts before calls are dropped. messages:
    array<struct<role, content, tool_calls array<struct<name, arguments>>, tool_responses array<struct<name, response>>>>.
    """
    last = F.try_element_at("messages", F.lit(-1))
    first = F.get("messages", F.lit(0))
    traces = traces.select(key, "messages", "restrictions", extract_json(block_text(last["content"])).alias("final"))
    asked = F.when(first["role"] == "user", block_text(first["content"]))
    reason = (
        F.when(F.coalesce(F.size("messages"), F.lit(0)) == 0, "no messages")
        .when(F.coalesce(last["role"], F.lit("")) != "assistant", "last turn not assistant")
        .when(~F.coalesce(F.startswith("final", F.lit("{")), F.lit(False)), "final answer unparsable")
        .when(F.coalesce(asked, F.lit("")) == "", "first turn not user")
    )
    # a call and its result to a row, so that long traces' results are slimmed apart
    turns = traces.where(reason.isNull()).select(F.col(key).alias("_k"), F.posexplode("messages").alias("turn", "m"), "messages")
    turns = turns.where((F.col("m.role") == "assistant") & (F.col("turn") < F.size("messages") - 1))
    after = F.get("messages", F.col("turn") + 1)
    results = F.when(after["role"] == "user", F.filter(after["content"], lambda b: b["type"] == "tool_result"))
    calls = turns.select("_k", "turn", results.alias("results"), F.posexplode(F.filter(F.col("m.content"), lambda b: b["type"] == "tool_use")).alias("nth", "u"))
    own = F.reverse(F.filter("results", lambda r: r["id"] == F.col("u.id")))
    raw = F.coalesce(F.get(own, F.lit(0))["text"], F.lit(""))
    calls = calls.select("_k", "turn", "nth", F.col("u.name").alias("name"), F.coalesce("u.input", F.lit("{}")).alias("arguments"), raw.alias("raw"))
    calls = calls.withColumn("response", transform_tool_result(F.col("name"), F.col("raw")))
    part = F.struct("turn", "nth", F.struct("name", "arguments").alias("call"), F.struct("name", "response").alias("answer"))
    calls = calls.groupBy("_k").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    none = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>,tool_responses:array<struct<name:string,response:string>>>>"
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"), F.lit(None).alias("tool_calls"), F.lit(None).alias("tool_responses"))
    parts = F.coalesce("parts", F.array())
    mine = lambda turn, field: F.transform(F.filter(parts, lambda p: p["turn"] == turn), lambda p: p[field])
    bundles = F.transform(F.array_distinct(F.transform(parts, lambda p: p["turn"])), lambda t: F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), mine(t, "call").alias("tool_calls"), mine(t, "answer").alias("tool_responses")))
    prompt = F.array(said("system", system_prompt(F.col("restrictions"), "student")), said("user", asked)).cast(none)
    rows = traces.withColumn("skip_reason", reason).join(calls, F.col(key) == F.col("_k"), "left")
    whole = F.concat(prompt, bundles.cast(none), F.array(said("assistant", F.col("final"))).cast(none))
    return rows.select(key, "skip_reason", F.when(F.col("skip_reason").isNull(), whole).alias("messages"))


# --- grounding ---


#: Names times characters of evidence up to which each name is sought on its own; beyond, an automaton seeks all at once.
ALONE = 1 << 18
#: Bits of a filter of asked words, and characters of names that one automaton holds.
FILTER_BITS, AUTOMATON_CHARS = 1 << 20, 1 << 20


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def absent(keys: pd.Series, evidence: pd.Series) -> pd.Series:
    """Places of the keys that a text does not contain, by one scan of the text for all of them; null for null."""

    def one(names, hay):
        if names is None or hay is None:
            return None
        wanted, size = [{}], 0
        for name in names:
            if size > AUTOMATON_CHARS:
                wanted, size = [*wanted, {}], 0
            if name:
                wanted[-1][name] = None
                size += len(name)
        found = {""}
        for group in wanted:
            if group:
                seeker = ahocorasick.Automaton()
                for name in group:
                    seeker.add_word(name, name)
                seeker.make_automaton()
                left = set(group)
                for _, name in seeker.iter(hay):
                    left.discard(name)
                    if not left:
                        break
                found.update(group.keys() - left)
        return [k for k, name in enumerate(names) if name not in found]

    return pd.Series([one(n, h) for n, h in zip(keys, evidence)], dtype=object)


def grounding(names: Column, evidence: Column, fold=collapse) -> Column:
    """struct(fraction, misses, n): the share of names whose folded form is in the folded evidence; 0 and none without names.

    Evidence and names are folded once a row. No evidence holds no name. Where names times characters are over ALONE, one
    scan of the evidence seeks all names; below, each is sought on its own.
    """
    evidence = F.coalesce(evidence, F.lit(""))
    hay = F.regexp_replace(F.lower(evidence), r"(?U)\s+", " ") if fold is collapse else fold(evidence)
    keys = F.transform(names, lambda n: F.coalesce(fold(n), F.lit("")))
    many = F.coalesce(F.size(names).cast("long") * F.length(evidence) > ALONE, F.lit(False))

    def alone(given: Column) -> Column:
        marked = F.transform(given["keys"], lambda k, i: F.when(~F.contains(given["hay"], k), i))
        return F.filter(marked, lambda i: i.isNotNull())

    places = F.when(many, absent(F.when(many, keys), F.when(many, hay))).otherwise(let(F.struct(F.when(~many, hay).alias("hay"), F.when(~many, keys).alias("keys")), alone))
    n = F.greatest(F.coalesce(F.size(names), F.lit(0)), F.lit(0))
    share = lambda g: F.when(g["n"] > 0, (g["n"] - F.size(g["at"])) / g["n"]).otherwise(0.0)
    return let(F.struct(n.alias("n"), F.coalesce(places, F.array().cast("array<int>")).alias("at"), names.alias("names")), lambda g: F.struct(share(g).alias("fraction"), F.transform(g["at"], lambda i: F.get(g["names"], i)).alias("misses"), g["n"].alias("n")))


def word_filter(words: DataFrame, word: str):
    """A test of words that all words of ``words`` pass and few others do; None if there are none. Its size is fixed, however
    many words there are."""
    at = F.xxhash64(word).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = [0] * (FILTER_BITS // 64)
    parts = words.select(F.shiftright(at, 6).alias("part"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    for r in parts.groupBy("part").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["part"]] = r["bits"]
    if not any(bits):
        return None
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # one literal

    def passes(w: Column) -> Column:
        return let(F.xxhash64(w).bitwiseAND(F.lit(FILTER_BITS - 1)), lambda h: F.bit_get(F.get(table, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1)

    return passes


def evidence_pairs(names: DataFrame, evidence: DataFrame) -> DataFrame:
    """JN10 across rows: distinct (name_id, evidence_id) where the folded name is in the folded evidence; no all-pairs test.

    names: name_id, name; evidence: evidence_id, evidence. Every name has an anchor that an evidence with it must hold: of
    three words or more, the inner word that the fewest evidences hold; of two, up to three last letters of the first, at
    a word's end; of one, its first letters up to three, within a word. Of the evidence only what passes a filter of the
    anchors becomes rows; candidates come from an equi-join of anchors, and only they are tested on whole texts. Blank
    names and null evidence are in no pair.
    """
    key = collapse(F.col("name"))
    names = names.select("name_id", key.alias("key")).where(F.col("key") != "").distinct()
    words = F.split("key", " ")
    hay = F.regexp_replace(F.lower("evidence"), r"(?U)\s+", " ")
    evidence = evidence.select("evidence_id", hay.alias("hay")).where(F.col("hay").isNotNull())
    own = F.array_distinct(F.split("hay", " "))
    inner = names.where(F.size(words) > 2).select("name_id", "key", F.explode(F.array_distinct(F.slice(words, F.lit(2), F.size(words) - 2))).alias("word"))
    asked = word_filter(inner, "word") or (lambda w: F.lit(False))
    counts = evidence.select(F.explode(F.filter(own, asked)).alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = inner.join(counts, F.col("word") == F.col("_word"), "left").groupBy("name_id", "key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "word")).alias("r"))
    rarest = rarest.where("r.n > 0").select("name_id", "key", F.concat(F.lit("w"), "r.word").alias("anchor"))
    first = F.get(words, F.lit(0))
    short = names.where(F.size(words) < 3).select("name_id", "key", F.when(F.size(words) == 2, F.concat(F.lit("e"), F.right(first, F.lit(3)))).otherwise(F.concat(F.lit("i"), F.left(first, F.lit(3)))).alias("anchor"))
    anchors = rarest.union(short)
    whole, part = word_filter(rarest, "anchor"), word_filter(short, "anchor")

    def signs(w: Column) -> Column:
        found = [F.array().cast("array<string>")]
        if whole:
            found.append(F.filter(F.array(F.concat(F.lit("w"), w)), whole))
        if part:
            sizes = F.array(*[F.lit(n) for n in (1, 2, 3)])
            starts = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
            ends = F.transform(sizes, lambda n: F.concat(F.lit("e"), F.right(w, n)))
            inside = F.flatten(F.transform(starts, lambda i: F.transform(sizes, lambda n: F.concat(F.lit("i"), F.substring(w, i, n)))))
            found.append(F.filter(F.concat(ends, inside), part))
        return F.concat(*found)

    held = evidence.select(F.col("evidence_id").alias("_e"), F.explode(F.array_distinct(F.flatten(F.transform(own, signs)))).alias("_anchor"))
    found = held.join(anchors, F.col("_anchor") == F.col("anchor")).select("_e", "name_id", "key").distinct()
    found = found.join(evidence, F.col("_e").eqNullSafe(F.col("evidence_id")))
    return found.where(F.contains("hay", F.col("key"))).select("name_id", "evidence_id").distinct()


def trace_grounding(names: Column, evidence: Column, most: int = 25) -> Column:
    """As ``grounding``, rounded half-even to three places; null without names; at most ``most`` misses."""
    out = F.transform(F.array(grounding(names, evidence)), lambda g: F.when(g["n"] > 0, F.struct(F.bround(g["fraction"], 3).alias("fraction"), F.slice(g["misses"], 1, most).alias("misses"))))
    return F.get(out, F.lit(0))


def reward_evidence(names: Column, evidence: Column) -> Column:
    """Grounding for the reward, which folds punctuation away on both sides."""
    return grounding(names, evidence, fold_words)


def match_context(name: Column, text: Column, around: int = 100) -> Column:
    """The text around the first match with the match marked, ellipses where it is cut; null if the name is empty or not there."""
    low, needle = F.lower(text), F.lower(F.trim(name))
    at = F.instr(low, needle)
    begin, size = F.greatest(F.lit(1), at - around), F.length(needle)
    left = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, at - begin))
    end = at + size
    right = F.concat(F.substring(text, end, F.lit(around)), F.when(F.length(text) >= end + around, "...").otherwise(""))
    return F.when((needle != "") & (at > 0), F.concat(left, F.lit("[["), F.substring(text, at, size), F.lit("]]"), right))


def menu_reach(strings: Column, scrapes: Column) -> Column:
    """struct(deepest, match_rate): how far into the scrapes the menu's strings reach; null without strings.

    Each string's end is the least over scrapes of where its first occurrence ends; deepest is the greatest of them.
    """
    given = F.array(F.struct(F.transform(scrapes, lambda d: F.lower(d)).alias("low"), F.transform(strings, lambda s: F.struct(F.lower(s).alias("low"), F.length(s).alias("n"))).alias("strings")))
    end = lambda d, s: let(F.instr(d, s["low"]), lambda at: F.when(at > 0, at - 1 + s["n"]))
    ends = F.transform(given, lambda g: F.transform(g["strings"], lambda s: F.array_min(F.filter(F.transform(g["low"], lambda d: end(d, s)), lambda e: e.isNotNull()))))
    out = F.transform(ends, lambda e: F.when(F.size(e) > 0, F.struct(F.array_max(e).alias("deepest"), (F.size(F.filter(e, lambda x: x.isNotNull())) / F.size(e)).alias("match_rate"))))
    return F.get(out, F.lit(0))


def wire_answer(raw: Column) -> Column:
    """The tail after the last response span, without call and thought spans."""
    tail = F.when(F.contains(raw, F.lit("</tool_response>")), F.substring_index(raw, "</tool_response>", -1)).otherwise(raw)
    return F.trim(F.regexp_replace(tail, r"(?s)<tool_call>.*?</tool_call>|<think>.*?</think>", ""))


def wire_evidence(raw: Column) -> Column:
    """The contents of all response spans."""
    return F.regexp_extract_all(raw, F.lit(r"(?s)<tool_response>(.*?)</tool_response>"), 1)


def neutralize_groups(df: DataFrame, i: str, score: str, flag: str, size: int) -> DataFrame:
    """``df`` with neutral: aborted scores become their group's clean mean; groups of none or all flagged stay as they are.

    A group is ``size`` consecutive i; sizes below 2, or a count that ``size`` does not divide, leave all as they are.
    """
    if size < 2 or df.count() % size:
        return df.withColumn("neutral", F.col(score))
    df = df.withColumn("grp", F.floor(F.col(i) / size))
    g = Window.partitionBy("grp")
    kept = F.count_if(~F.col(flag)).over(g)
    clean = F.avg(F.when(~F.col(flag), F.col(score))).over(g)
    return df.withColumn("neutral", F.when(F.col(flag) & (kept > 0), clean).otherwise(F.col(score)))
