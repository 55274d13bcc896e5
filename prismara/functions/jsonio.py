"""Strict JSON reading for Arrow-batched stages."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

BAD = object()
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def strict_loads(body: str | None) -> Any:
    """The value of ``body``, or ``BAD`` when it is null or not valid JSON as a whole.

    NaN and Infinity are not JSON. Any depth is read. The last of repeated keys counts.
    """
    if not isinstance(body, str):
        return BAD
    try:
        return json.loads(body, parse_constant=_refuse)
    except ValueError:
        return BAD
    except RecursionError:
        try:
            return deep_loads(body)
        except (ValueError, IndexError):
            return BAD


def _blank(text: str, at: int) -> int:
    return _BLANK.match(text, at).end()


def _leaf(text: str, at: int) -> tuple[Any, int]:
    """A string, number or word at ``at``, and where it ends."""
    if text[at] == '"':
        return scanstring(text, at + 1, True)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError(f"no value at {at}")
    return (float(m.group()) if m.group(2) or m.group(3) else int(m.group())), m.end()


def deep_loads(text: str) -> Any:
    """The value of a JSON text of any depth: open containers wait on a list, not on the interpreter's stack."""
    open_: list[tuple[Any, Any]] = []  # container, and for an object the key that waits for its value
    at = _blank(text, 0)
    while True:
        if text[at] in "[{":
            value: Any = [] if text[at] == "[" else {}
            at = _blank(text, at + 1)
            closed = text[at] == ("]" if isinstance(value, list) else "}")
            if not closed:
                key = None
                if isinstance(value, dict):
                    key, at = _key(text, at)
                open_.append((value, key))
                continue
            at += 1
        else:
            value, at = _leaf(text, at)
        # A value is complete: it goes into its container, which may complete as well.
        while True:
            at = _blank(text, at)
            if not open_:
                if at != len(text):
                    raise ValueError(f"more text at {at}")
                return value
            box, key = open_.pop()
            if isinstance(box, list):
                box.append(value)
            else:
                box[key] = value
            if text[at] == ",":
                at = _blank(text, at + 1)
                if isinstance(box, dict):
                    key, at = _key(text, at)
                open_.append((box, key))
                break
            if text[at] != ("]" if isinstance(box, list) else "}"):
                raise ValueError(f"no end of a container at {at}")
            value, at = box, at + 1


def _key(text: str, at: int) -> tuple[str, int]:
    """The key of an object's member at ``at``, and where its value starts."""
    if text[at] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _blank(text, at)
    if text[at] != ":":
        raise ValueError(f"no colon at {at}")
    return key, _blank(text, at + 1)


def dumps(value: Any, sort_keys: bool = False, ensure_ascii: bool = False) -> str:
    """Compact JSON of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=ensure_ascii, sort_keys=sort_keys, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]
    while todo:
        ready, x = todo.pop()
        if ready:
            out.append(x)
        elif isinstance(x, dict):
            parts: list[tuple[bool, Any]] = [(True, "{")]
            for n, (k, v) in enumerate(sorted(x.items()) if sort_keys else x.items()):
                parts += [(True, "," * (n > 0) + json.dumps(k, ensure_ascii=ensure_ascii) + ":"), (False, v)]
            todo += reversed([*parts, (True, "}")])
        elif isinstance(x, list):
            parts = [(True, "[")]
            for n, v in enumerate(x):
                parts += [(True, "," * (n > 0)), (False, v)]
            todo += reversed([*parts, (True, "]")])
        else:
            out.append(json.dumps(x, ensure_ascii=ensure_ascii))
    return "".join(out)


def clean(text: str) -> str:
    """``text`` with lone surrogates replaced, so that it can be stored as UTF-8."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode("utf-8")


def as_text(value: Any) -> str | None:
    """A string as it is, null as None, anything else as compact JSON."""
    if value is None:
        return None
    if isinstance(value, str):
        return clean(value)
    return clean(dumps(value))
