"""JSON out of a model's answer, by one tolerant reader: comments, trailing commas and curly quotes are fine, text around
the value is passed over, and of a value that was cut off, what is whole stays."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from json.decoder import scanstring
from typing import Any

NOTHING = object()
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_WORD = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
_CLOSING = {"“": "”", "”": "”"}


class _Reader:
    """value(i) gives (value, end, whole). A value that is not whole ran into the end of the text; NOTHING: not even a part."""

    def __init__(self, text: str) -> None:
        self.text = text

    def past_space(self, i: int) -> int:
        return _SPACE.match(self.text, i).end()

    def value(self, i: int) -> tuple[Any, int, bool]:
        i = self.past_space(i)
        c = self.text[i : i + 1]
        if c == "":
            return NOTHING, i, False
        if c in "[{":
            return self.array(i + 1) if c == "[" else self.object(i + 1)
        if c == '"' or c in _CLOSING:
            return self.string(i)
        m = _WORD.match(self.text, i)
        if m:  # a number at the very end may go on
            return json.loads(m[0]), m.end(), m.end() < len(self.text) or m[0][0] in "tfn"
        if any(w.startswith(self.text[i:]) for w in ("true", "false", "null", "-")):
            return NOTHING, len(self.text), False
        raise ValueError(f"no value at {i}")

    def string(self, i: int) -> tuple[Any, int, bool]:
        close = _CLOSING.get(self.text[i])
        if close:
            end = self.text.find(close, i + 1)
            return (self.text[i + 1 : end], end + 1, True) if end >= 0 else (NOTHING, len(self.text), False)
        try:
            return *scanstring(self.text, i + 1, False), True
        except ValueError as e:
            if "Unterminated" in str(e) or i + 8 > len(self.text):
                return NOTHING, len(self.text), False
            raise

    def array(self, i: int) -> tuple[list, int, bool]:
        out: list = []
        while True:
            i = self.past_space(i)
            if self.text[i : i + 1] == "]":
                return out, i + 1, True
            if self.text[i : i + 1] == "," and out:
                i += 1
                continue
            v, i, whole = self.value(i)
            if not whole:  # half an element is none
                return out, i, False
            out.append(v)

    def object(self, i: int) -> tuple[dict, int, bool]:
        out: dict = {}
        while True:
            i = self.past_space(i)
            if self.text[i : i + 1] == "}":
                return out, i + 1, True
            if self.text[i : i + 1] == "," and out:
                i += 1
                continue
            if i >= len(self.text):
                return out, i, False
            if self.text[i] != '"' and self.text[i] not in _CLOSING:
                raise ValueError(f"no name at {i}")
            key, i, whole = self.string(i)
            i = self.past_space(i)
            if not whole or i >= len(self.text):
                return out, i, False
            if self.text[i] != ":":
                raise ValueError(f"no colon at {i}")
            v, i, whole = self.value(i + 1)
            if whole or isinstance(v, (list, dict)):  # of a member, what is whole inside it stays
                out[key] = v
            if not whole:
                return out, i, False


def read(text: str | None) -> tuple[Any, bool]:
    """(value, whole) of the first array or object of a text, in a code fence if there is one; NOTHING where there is none."""
    raw = text or ""
    fence = re.search(r"```(?:json)?\s*(.+?)(?:```|\Z)", raw, re.S | re.I)
    body = (fence[1] if fence else raw).strip()
    try:
        return json.loads(body), True
    except (ValueError, RecursionError):
        pass
    reader, at, cut = _Reader(body), 0, (NOTHING, True)
    for m in re.finditer(r"[{\[]|//[^\n]*|/\*.*?\*/", body, re.S):
        if m[0] not in ("{", "[") or m.start() < at:
            continue
        try:
            v, at, whole = reader.value(m.start())
        except (ValueError, RecursionError):
            continue
        if whole:
            return v, True
        if cut[0] is NOTHING:
            cut = (v, False)
    return cut


def salvage_truncated(text: str | None) -> Any | None:
    """The whole elements of an answer that was cut off; None where none was cut, or nothing can be read."""
    value, whole = read(text)
    return None if whole or value is NOTHING else value


def _as_object(value: Any) -> dict | None:
    return value if isinstance(value, dict) else {"entities": value} if isinstance(value, list) else None


def parse_json_lenient(text: str | None) -> dict:
    """An object; a bare array becomes its ``entities``; {} if nothing can be read."""
    return _as_object(read(text)[0]) or {}


@dataclass(frozen=True)
class Answer:
    """value: {} where the call failed; truncated: the answer was cut off; out_tokens: 0 where the model doesn't say."""

    value: dict
    truncated: bool = False
    failed: bool = False
    out_tokens: int = 0


def invoke_json_meta(model: Callable[..., Any] | None, system: str, user: str, schema: dict | None = None, max_tokens: int | None = None, timeout: float | None = None) -> Answer:
    """Asks a model for JSON. A model may offer ``generate_json_meta(prompt, system=, schema=, max_tokens=, timeout=)``, which
    tells (answer, its tokens and whether it was cut off), or ``generate_json(prompt, system=, schema=)``; else it is called
    with (prompt, system), and what is to be known is read off the answer."""
    said: dict = {}
    try:
        if hasattr(model, "generate_json_meta"):
            raw, said = model.generate_json_meta(user, system=system, schema=schema, max_tokens=max_tokens, timeout=timeout)
        elif schema is not None and hasattr(model, "generate_json"):
            raw = model.generate_json(user, system=system, schema=schema)
        else:
            raw = model(user, system)
    except Exception:  # a model's failure is an answer without items
        return Answer({}, failed=True)
    said = said or {}
    cut = bool(said.get("truncated") or said.get("length_error"))
    tokens = int(said.get("out_tokens") or 0)
    value, whole = (raw, True) if isinstance(raw, dict) else read(raw) if isinstance(raw, str) else (NOTHING, True)
    found = _as_object(value)
    return Answer(found or {}, cut or not whole, bool(said.get("failed")) or found is None, tokens)


def invoke_json(model: Callable[..., Any] | None, system: str, user: str, schema: dict | None = None) -> dict:
    """{} where the model fails."""
    return invoke_json_meta(model, system, user, schema).value
