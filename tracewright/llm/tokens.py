"""Whole-text tokenisation that asks the tokenizer's model once per distinct pre-token."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Characters that one step splits and joins at a time, and pre-tokens that a worker remembers.
STEP_CHARS, REMEMBERED = 1_000_000, 300_000
#: Characters whose classes are beyond doubt: for texts of these alone, the pre-token rules below are exact.
_SAFE = re.compile(r"[\t\n -~À-ÖØ-öø-ÿ]*").fullmatch
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pre-token rules of the public files, over safe characters (fixed values).
_BYTE_RULE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+").findall
_WORD_RULE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+").findall
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def public_path(name: str) -> str:
    """Where the installed public tokenizer file of this name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself, or the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _rule(spec: dict) -> Callable[[str], list[str]] | None:
    """The pre-tokens of a safe text under a tokenizer file that follows one of the two rules; else None."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return _BYTE_RULE
    steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    first, *rest = pre.get("pretokenizers") or [{}]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": _WORD_PATTERN} and [x.get("type") for x in rest] == ["ByteLevel"]:
        return lambda text: _WORD_RULE(text.lower())
    return None


class _Known(dict):
    """Ids of pre-tokens; a new one is asked of the model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        self[word] = found = array("I", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    They are what the library gives for the file as it is, without adding special tokens; the strings of the file's added
    tokens in a text are those tokens, as they are there. A text's ids are those of its pre-tokens in order, so each
    distinct pre-token is encoded once and remembered. Texts with characters outside the safe set or with the string of
    an added token, and all texts under other rules, go to the tokenizer whole. The memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rule = _rule(spec)
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        # a text with an added token, in any case, has its longest stretch without letters
        self.marks = sorted({max(re.findall(r"[^\W\d_]+|[\W\d_]+", t), key=lambda x: (not re.search(r"[^\W\d_]", x), len(x))) for t in added})
        self.known = _Known(self.tokenizer.model)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.rule:
            return self.whole(texts)
        split = [self.rule(t) if _SAFE(t) and not any(m in t for m in self.marks) else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.__getitem__
        rest = iter(self.whole([t for t, s in zip(texts, split) if s is None]))
        return [next(rest) if s is None else b"".join(map(get, s)) for s in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_rows(batches: Iterable, path: str, end_id: int) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end id) of Arrow batches with doc_id and text, a bounded number of characters at a time."""
    tail, enc = array("I", [end_id]).tobytes(), encoder(path)
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id")
        at = 0
        while at < len(texts):
            part, chars, begin = [], 0, at
            while at < len(texts) and (not part or chars < STEP_CHARS):
                part.append(texts[at].as_py() or "")
                chars += len(part[-1])
                at += 1
            for k, b in enumerate(enc.encode(part)):
                yield ids[begin + k].as_py(), b + tail
