"""Broken JSON: one pass over its signs with a stack of what is open, whatever the depth."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

#: White space, strings (the last may lack its end), structure, numbers, names, any other sign.
TOKEN = re.compile(r'[ \t\n\r]+|"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[{}\[\]:,]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|-?Infinity|[A-Za-z]+|.', re.S)
NAMES = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
#: Levels of a value that are kept: what lies deeper comes as an empty object or array.
LEVELS = 16
NOTHING = object()


class Open:
    """An object or array whose end is yet to come, and what may come next in it."""

    __slots__ = ("value", "key", "expects")

    def __init__(self, value: dict | list):
        self.value, self.key = value, None
        self.expects = "key or end" if isinstance(value, dict) else "value or end"


def scalar(token: str):
    """The value of a string, number or name; NOTHING for any other token."""
    try:
        if token[0] == '"':
            value, end = scanstring(token, 1, True)
            return value if end == len(token) else NOTHING
        if token[0].isalpha() or token == "-Infinity":
            return NAMES.get(token, NOTHING)
        if token[-1].isdigit():
            return int(token) if token.lstrip("-").isdigit() else float(token)
    except ValueError:  # a wrong escape, a number beyond what is read
        pass
    return NOTHING


def scan(raw: str, wanted: str) -> tuple[object, list[dict]]:
    """(the text's value if it is one whole value, else NOTHING; every complete object whose `wanted` field isn't empty, in order of ends).

    A sign that can't stand where it does ends all that is open around it, and nothing else: an object that begins later
    may still be complete. Each sign is read once.
    """
    stack: list[Open] = []
    whole, clean, found = [], True, []

    def put(value) -> bool:
        """Takes a value where one may stand."""
        if not stack:
            whole.append(value)
            return True
        top = stack[-1]
        if not top.expects.startswith("value"):
            return False
        if isinstance(top.value, dict):
            top.value[top.key] = value
        else:
            top.value.append(value)
        top.expects = "comma or end"
        return True

    for match in TOKEN.finditer(raw):
        token = match[0]
        top = stack[-1] if stack else None
        good = True
        if token[0] in " \t\n\r":
            continue
        if token in ("{", "["):
            if top and not top.expects.startswith("value"):
                stack.clear()
                clean = False
            stack.append(Open({} if token == "{" else []))
        elif token in ("}", "]"):
            good = bool(top) and isinstance(top.value, dict) == (token == "}") and top.expects.endswith("end")
            if good:
                stack.pop()
                if token == "}" and top.value.get(wanted):
                    found.append(top.value)
                good = put(top.value)
        elif token == ",":
            good = bool(top) and top.expects == "comma or end"
            if good:
                top.expects = "key" if isinstance(top.value, dict) else "value"
        elif token == ":":
            good = bool(top) and top.expects == "colon"
            if good:
                top.expects = "value"
        else:
            value = scalar(token)
            if value is NOTHING:
                good = False
            elif top and top.expects.startswith("key"):
                good = isinstance(value, str)
                if good:
                    top.key, top.expects = value, "colon"
            else:
                good = put(value)
        if not good:
            stack.clear()
            clean = False
    return (whole[0] if clean and not stack and len(whole) == 1 else NOTHING), found


def shallow(value, levels: int = LEVELS):
    """A value without what lies deeper than some levels."""
    if isinstance(value, dict):
        return {k: shallow(v, levels - 1) for k, v in value.items()} if levels else {}
    if isinstance(value, list):
        return [shallow(v, levels - 1) for v in value] if levels else []
    return value


#: What the built-in decoder says of a sign that can't stand where it does; its place is that sign's.
MISPLACED = ("Expecting", "Unterminated string", "Illegal trailing comma", "Extra data")


def scanned(raw: str, wanted: str) -> tuple[object, list[dict]]:
    """What scan gives, by the built-in decoder as far as it goes: it tells of every object that ends, and where it stopped; only the rest is scanned here."""
    found: list[dict] = []

    def ended(value: dict) -> dict:
        if value.get(wanted):
            found.append(value)
        return value

    try:
        return json.JSONDecoder(object_hook=ended).decode(raw), found
    except json.JSONDecodeError as e:
        if not may_hold(raw, wanted):
            return NOTHING, []
        if not e.msg.startswith(MISPLACED):  # within a string
            return scan(raw, wanted)
        return NOTHING, found + scan(raw[e.pos :], wanted)[1]
    except (ValueError, RecursionError):
        if not may_hold(raw, wanted) and not raw.rstrip(" \t\n\r").endswith(("}", "]")):
            return NOTHING, []
        return scan(raw, wanted)


def may_hold(raw: str, wanted: str) -> bool:
    """Whether a field of that name may stand in a text: as it is, or with escapes."""
    return f'"{wanted}"' in raw or "\\u" in raw


def answer_items(raw: str, field: str, wanted: str) -> tuple[bool, list[str]]:
    """(whether an answer is an object with a list in `field`; that list's items as JSON, or, of a broken answer, the complete objects with `wanted`)."""
    value, items = scanned(raw, wanted)
    good = isinstance(value, dict) and isinstance(value.get(field), list)
    if value is not NOTHING:
        items = value[field] if good else []
    return good, [json.dumps(shallow(item), ensure_ascii=False) for item in items]
