"""Labels of training rows from a tokenizer: which tokens of a rendered trace the model itself would write."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .messages import IGNORED

#: Fixed values of the rendering: what begins a turn of a role, ends one, and encloses calls and their responses.
OPEN, END, CALL, RESPONSE = ("<|", "|>\n"), "<|end|>", ("<tool_call>", "</tool_call>"), ("<tool_response>", "</tool_response>")
#: Why a row has no labels.
BROKEN = "a prefix is no token prefix"
#: Where a text may be cut without a change of what is before: at a space between two words, with a whole word after it.
_STABLE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z]{1,40} )")


def rendered(messages: Column) -> Column:
    """A training row's messages as segments struct(text, learn) in order; together their texts are the rendered trace.

    Learnt are an assistant's calls, and its final content with the end of its turn; not what the surroundings write:
    other turns, the opening of an assistant's turn, responses with their opening sign. A line end parts what is learnt
    from what is not, as tokens may span signs.
    """
    said = lambda text, learn: F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(learn).alias("learn"))
    text = lambda x: F.coalesce(x, F.lit(""))
    opening = lambda role: F.concat(F.lit(OPEN[0]), role, F.lit(OPEN[1]))

    def turn(m: Column) -> Column:
        calls = F.array_join(F.transform(m["tool_calls"], lambda c: F.concat(F.lit(CALL[0] + '{"name":"'), text(c["name"]), F.lit('","arguments":'), text(c["arguments"]), F.lit("}" + CALL[1]))), "")
        responses = F.array_join(F.transform(F.coalesce(m["tool_responses"], F.array()), lambda r: F.concat(F.lit(RESPONSE[0]), text(r["response"]), F.lit(RESPONSE[1]))), "")
        acted = F.array(said(opening(m["role"]), False), said(calls, True), said(F.concat(F.lit("\n"), responses, F.lit(END + "\n")), False))
        answered = F.array(said(opening(m["role"]), False), said(F.concat(text(m["content"]), F.lit(END)), True), said(F.lit("\n"), False))
        other = F.array(said(F.concat(opening(m["role"]), text(m["content"]), F.lit(END + "\n")), False))
        return F.when(m["role"] != "assistant", other).when(F.size(F.coalesce(m["tool_calls"], F.array())) > 0, acted).otherwise(answered)

    return F.flatten(F.transform(messages, turn))


def prefix_ids(encode, text: str, ends: list[int]) -> list[list[int]]:
    """Ids of the prefixes of a text that end at ``ends`` (ascending), each extended from the last stable place.

    What lies before a space between two words is encoded once, however many prefixes contain it.
    """
    out, done, at = [], [], 0
    for end in ends:
        last = None
        for m in _STABLE.finditer(text, at, end):
            last = m.start()
        if last is not None and last > at:
            done, at = done + encode(text[at:last]), last
        out.append(done + encode(text[at:end]))
    return out


def labels_of(encode, segments: list[tuple[str, bool]]) -> tuple[list[int], list[int]] | None:
    """(ids, labels) of a rendered trace, or None if a boundary of a learnt segment is no boundary of its tokens.

    The ids before such a boundary, encoded alone, must begin the ids of the whole; else the mask would be wrong.
    """
    text = "".join(t for t, _ in segments)
    ends, spans, at = [], [], 0
    for t, learn in segments:
        if learn and t:
            spans.append((len(ends), len(ends) + 1))
            ends += [at, at + len(t)]
        at += len(t)
    ids = encode(text)
    labels, prefixes = [IGNORED] * len(ids), prefix_ids(encode, text, ends)
    if any(p != ids[: len(p)] for p in prefixes):
        return None
    for a, b in spans:
        st, en = len(prefixes[a]), len(prefixes[b])
        labels[st:en] = ids[st:en]
    return ids, labels


_tokenizers: dict[str, object] = {}


def _encoder(path: str):
    """This worker's encoder of a tokenizer file, without special tokens added."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    found = _tokenizers[path]
    return lambda text: found.encode(text, add_special_tokens=False).ids if text else []


def token_labels(rows: DataFrame, tokenizer: str, key: str = "trace_id", segments: str = "segments") -> DataFrame:
    """O-MSG11: (key, skip_reason, input_ids, labels) of rendered traces: ids where the model writes, IGNORED elsewhere.

    ``segments``: array<struct<text, learn>>, null where a row was skipped before (``skip_reason`` says why and stays).
    Rows whose prefixes break are marked BROKEN and have no ids. ``tokenizer`` is a file that every machine has.
    """
    kind = dict(rows.dtypes)[key]
    rows = rows.select(key, "skip_reason", F.transform(segments, lambda s: F.struct(s["text"].alias("text"), s["learn"].alias("learn"))).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for b in batches:
            why, ids, labels = [], [], []
            for reason, parts in zip(b.column("skip_reason").to_pylist(), b.column("segments")):
                found = None if reason is not None or not parts.is_valid else labels_of(encode, [(s["text"] or "", bool(s["learn"])) for s in parts.as_py()])
                why.append(reason if found or reason is not None or not parts.is_valid else BROKEN)
                ids.append(found and np.array(found[0], np.int32))
                labels.append(found and np.array(found[1], np.int32))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(why, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))], names=[key, "skip_reason", "input_ids", "labels"])

    return rows.mapInArrow(run, f"`{key}` {kind}, skip_reason string, input_ids array<int>, labels array<int>")
