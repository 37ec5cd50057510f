"""Four splitters of text into words, and the canonical form of a sentence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def whitespace(s: Column) -> Column:
    return F.filter(F.split(s, r"[ \t\n\r\x0b\f]+"), lambda x: x != "")


def delimited(s: Column, delimiter: str) -> Column:
    """Fields between delimiters; empty ones vanish, but a delimiter at the start leaves one empty field."""
    fields = F.split(s, f"\\Q{delimiter}\\E")
    return F.filter(fields, lambda x, i: (x != "") | ((i == 0) & (F.size(fields) > 1)))


CSV_FIELD = r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))'


def csv(s: Column) -> Column:
    """Comma-separated fields; quotes enclose commas and a doubled quote stands for one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), s), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.rlike(r'(?s)^".*"$') & (F.length(x) >= 2), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def word_list(s: Column, delimiter: str = " ") -> Column:
    return F.split(s, f"\\Q{delimiter}\\E")


# What counts as part of a word beside ASCII letters and digits: every character beyond ASCII.
_W = r"A-Za-z0-9\u0080-\U0010ffff"
_ENGLISH = re.compile(
    r"\.\.\.|--"  # ellipsis, double hyphen
    r"|(?<![" + _W + r".])[+-]?\d+(?:\.\d+)?[eE][+-]?\d+(?![" + _W + r"])"  # with an exponent
    r"|(?:(?<=\s)|^)[+-](?=\d)(?:\d+(?:\.\d+)*|\.\d+)"  # signed number after white space
    r"|[A-Za-z](?:\.[A-Za-z])+\."  # abbreviation of single letters: U.S.
    r"|\d+(?:\.\d+)+(?![" + _W + r"])"  # decimal
    r"|[" + _W + r"]+(?:(?:'|\.(?=[A-Za-z]{2})|-(?=[A-Za-z\u0080-\U0010ffff]))(?<=[A-Za-z\u0080-\U0010ffff]['.\-])[A-Za-z\u0080-\U0010ffff][" + _W + r"]*)*"  # word with inner ' . -
    r"|\S"
)
_COMMA = re.compile(r"\d,(?=\d)")


def english_words(text: str, strict: bool = True) -> list[str]:
    """Words, numbers and punctuation marks of English text.

    Kept whole: decimals and exponents, signed numbers after a space, abbreviations of
    single letters, contractions, hyphenated words, dotted names, "--" and "...". A
    comma between digits stays with the digits before it; with strict=False the whole
    number 1,234.56 is one word.
    """
    out: list[str] = []
    at, n = 0, len(text)
    while at < n:
        m = _ENGLISH.search(text, at)
        if m is None:
            break
        word, at = m[0], m.end()
        if word.isdigit() and at + 1 < n and text[at] == "," and text[at + 1].isdigit():
            if strict:
                word, at = word + ",", at + 1
            else:
                while (more := re.compile(r",\d+(?:\.\d+)?").match(text, at)) is not None:
                    word, at = word + more[0], more.end()
        out.append(word)
    return out


def english(s: Column, strict: bool = True) -> Column:
    """english_words of a text column, in Arrow batches; null texts give null."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else english_words(t, strict))

    return split(s)


#: Splitters that a table function can use by name.
SPLITTERS: dict[str, Callable[[str], Iterable[str]]] = {"english": english_words, "whitespace": lambda t: re.findall(r"[^ \t\n\r\x0b\f]+", t)}


def table_function(split: str | Callable[[str], Iterable[str]] = "english"):
    """A table function (text) -> (pos, word) for lateral joins, by a splitter's name or a function of the caller's; null texts have no words.

    Its schema comes from analyze, which refuses arguments that are no text.
    """
    cut = SPLITTERS[split] if isinstance(split, str) else split

    class Words:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, (StringType, NullType)):
                raise ValueError(f"a text is wanted, not {text.dataType.simpleString()}")
            return AnalyzeResult(schema=StructType().add("pos", "integer").add("word", "string"))

        def eval(self, text: str | None):
            if text is not None:
                yield from enumerate(cut(text))

    return F.udtf(Words)


def token_table(rows: DataFrame, split: str | Callable[[str], Iterable[str]] = "english", text: str = "text") -> DataFrame:
    """rows with a row for each word of a text column: its columns, pos and word."""
    return rows.lateralJoin(table_function(split)(F.col(text).outer()))


def joined(words: Column, delimiter: str = " ") -> Column:
    return F.array_join(words, delimiter)


def canonical(s: Column, upper: bool = False, delimiter: str = " ") -> Column:
    """The sentence's English words, in capitals if wanted, joined by the delimiter."""
    return joined(english(F.upper(s) if upper else s), delimiter)
