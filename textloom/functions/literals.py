"""Object literals in a Lisp-like notation, read into JSON.

Lists (a b c) and arrays #A(a b c) become arrays, #H((k v) ...) maps, #S(...) or #H of
bare elements sets, #*0110 bit vectors, "..." strings, |...| symbols with any character,
numbers integers, floats or ratios (as {"num": n, "den": d}), #B #O #X and #nR integers
of another radix, other words symbols (strings). Malformed text gives null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""\s*(?:;[^\n]*\n\s*)*(?P<t>\#[A-Za-z]?\(|[()]|"(?:[^"\\]|\\.)*"|\|(?:[^|\\]|\\.)*\||\#\*[01]*|\#[BbOoXx][-+]?[0-9A-Za-z]+|\#\d+[Rr][-+]?[0-9A-Za-z]+|[^\s()"|;]+)""",
    re.VERBOSE,
)
RADIX = {"b": 2, "o": 8, "x": 16}


class Malformed(ValueError):
    pass


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if m is None:
            raise Malformed(text[at:])
        out.append(m["t"])
        at = m.end()
    return out


def atom(t: str):
    if t[0] in '"|':
        return re.sub(r"(?s)\\(.)", r"\1", t[1:-1])
    if t.startswith("#*"):
        return [c == "1" for c in t[2:]]
    if m := re.fullmatch(r"#([BbOoXx])(.+)", t):
        return int(m[2], RADIX[m[1].lower()])
    if m := re.fullmatch(r"#(\d+)[Rr](.+)", t):
        return int(m[2], int(m[1]))
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if m := re.fullmatch(r"([-+]?\d+)/(\d+)", t):
        return {"num": int(m[1]), "den": int(m[2])}
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", t):
        return float(t)
    return t


def parse(text: str):
    words = tokens(text)
    value, at = _value(words, 0)
    if at != len(words):
        raise Malformed(text)
    return value


def _value(words: list[str], at: int):
    if at >= len(words) or words[at] == ")":
        raise Malformed("nothing to read")
    t = words[at]
    if t != "(" and not t.endswith("(") or t[0] in '"|':
        return atom(t), at + 1
    items, at = [], at + 1
    while at < len(words) and words[at] != ")":
        item, at = _value(words, at)
        items.append(item)
    if at >= len(words):
        raise Malformed("unclosed")
    kind = t[1:-1].upper()
    if kind == "H" and items and all(isinstance(i, list) and len(i) == 2 for i in items):
        return {i[0] if isinstance(i[0], str) else json.dumps(i[0]): i[1] for i in items}, at + 1
    if kind in ("H", "S"):
        seen: dict[str, object] = {}
        for i in items:
            seen.setdefault(json.dumps(i), i)
        return list(seen.values()), at + 1
    return items, at + 1


def to_json(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(parse(text), ensure_ascii=False)
    except (Malformed, ValueError):
        return None


def read_object(s: Column) -> Column:
    """The JSON of an object literal; feed it to from_json or parse_json."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(to_json)

    return read(s)
