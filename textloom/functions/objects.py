"""Objects in several notations as VARIANT columns, told apart by how a text begins.

JSON is read with commas and colons optional and bare words as strings; what begins like an
object literal (``literals``) goes to that reader. A caller may add readers for
beginnings of its own: the longest beginning that fits decides. A text that its reader
refuses, or that no reader knows, is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import literals

Reader = Callable[[str], object]

TOKEN = re.compile(r'[\s,:]*([{}\[\]]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+)', re.DOTALL)
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
# JSON's words.
WORDS = {"true": True, "false": False, "null": None}


def tolerant_json(text: str):
    """The value of a JSON text in which commas and colons may be left out; nesting of any depth."""
    root: list = []
    # Open containers; of an object the keys and values in turn.
    stack, at, end = [root], 0, len(text.rstrip(" \t\r\n\f\v,:"))
    while at < end:
        m = TOKEN.match(text, at)
        if m is None:
            raise literals.Malformed(text[at:])
        t, at = m[1], m.end()
        if t in "{[":
            stack.append([t])
            continue
        if t in "}]":
            if len(stack) == 1 or stack[-1][0] != {"}": "{", "]": "["}[t]:
                raise literals.Malformed(text)
            kind, *items = stack.pop()
            value = _object(items) if kind == "{" else items
        elif t[0] == '"':
            value = json.loads(t, strict=False)
        else:
            value = WORDS[t] if t in WORDS else json.loads(t) if NUMBER.fullmatch(t) else t
        stack[-1].append(value)
    if len(stack) != 1 or len(root) != 1:
        raise literals.Malformed(text)
    return root[0]


def _object(items: list) -> dict:
    if len(items) % 2:
        raise literals.Malformed("a key without a value")
    return {k if isinstance(k, str) else json.dumps(k): v for k, v in zip(items[::2], items[1::2], strict=True)}


#: Readers by how a text begins; "" takes all other texts.
READERS: dict[str, Reader] = {"{": tolerant_json, "[": tolerant_json, "": literals.parse}


def json_of(text: str | None, readers: dict[str, Reader] = READERS) -> str | None:
    """The JSON of one object, by the reader with the longest beginning that fits."""
    if text is None:
        return None
    body = text.strip()
    fits = [start for start in readers if body.startswith(start)]
    if not fits:
        return None
    try:
        return json.dumps(readers[max(fits, key=len)](body), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


def read_objects(s: Column, readers: dict[str, Reader] | None = None) -> Column:
    """A text column as VARIANT; readers of the caller's stand beside the ones that are there, or before them."""
    known = {**READERS, **(readers or {})}

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json_of(t, known))

    return F.try_parse_json(read(s))
