"""Text scalars: trimming, counting, quoting, tests, conversions, bit and number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in trims: space, tab, line feed, carriage return, vertical tab, form feed.
BLANKS = " \t\n\r\x0b\x0c"


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def skip_blanks(s: Column) -> Column:
    return F.ltrim(s, F.lit(BLANKS))


def from_next_blank(s: Column) -> Column:
    """The text from its first white space on; empty without one."""
    return F.regexp_extract(s, r"(?s)[ \t\n\r\x0b\f].*", 0)


def count_words(s: Column) -> Column:
    """Spaces plus one; 0 for the empty text."""
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


def unquote(s: Column) -> Column:
    """Without enclosing quotes or bars, backslash escapes resolved; other texts as they are."""
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    quoted = (F.length(s) >= 2) & ((s.startswith('"') & s.endswith('"')) | (s.startswith("|") & s.endswith("|")))
    return F.when(quoted, F.regexp_replace(inner, r"(?s)\\(.)", "$1")).otherwise(s)


def is_number(s: Column) -> Column:
    return s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]*)$")


def is_punct(s: Column) -> Column:
    """The first character is ASCII punctuation, and nothing or white space follows."""
    return s.rlike(r"^[!-/:-@\[-`{-~]([ \t\n\r\x0b\f]|$)")


def to_int(s: Column, bits: int = 32, signed: bool = True) -> Column:
    """A decimal, 0x or leading-0 octal integer in range; null for other texts."""
    body = F.lower(trim(s))
    sign = F.when(body.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(body, r"^[+-]", "")
    wide = "decimal(20,0)"
    value = (
        F.when(digits.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.regexp_replace(digits, "^0x", ""), 16, 10).cast(wide))
        .when(digits.rlike("^0[0-7]+$"), F.conv(digits, 8, 10).cast(wide))
        .when(digits.rlike("^[0-9]{1,20}$"), digits.try_cast(wide))
    ) * sign
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return F.when((value >= F.lit(low).cast(wide)) & (value <= F.lit(high).cast(wide)), value)


def to_double(s: Column) -> Column:
    return trim(s).try_cast("double")


def to_number(s: Column) -> Column:
    """Struct (num, den): a ratio when the text has a slash, else an integer over 1; null if it is neither."""
    parts = F.split(s, "/", 2)
    num = F.get(parts, F.lit(0)).try_cast("bigint")
    den = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    return F.when(num.isNotNull() & den.isNotNull() & (den != 0), F.struct(num.alias("num"), den.alias("den")))


def same_number(a: Column, b: Column) -> Column:
    """Whether two number texts, integers, floats or ratios, have one value; null if either is no number."""
    x, y = to_number(a), to_number(b)
    whole = (x["num"].cast("decimal(38,0)") * y["den"].cast("decimal(38,0)")) == (y["num"].cast("decimal(38,0)") * x["den"].cast("decimal(38,0)"))
    value = lambda n, s: F.coalesce(n["num"].cast("double") / n["den"], to_double(s))
    return F.when(x.isNotNull() & y.isNotNull(), whole).otherwise(value(x, a) == value(y, b))


def compare_numbers(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by value, for number texts of any kind; null if either is no number."""
    value = lambda s: F.coalesce(to_number(s)["num"].cast("double") / to_number(s)["den"], to_double(s))
    x, y = value(a), value(b)
    return F.when(same_number(a, b), 0).when(x < y, -1).when(x > y, 1)


def compare_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the texts' UTF-8 bytes; null if either is null."""
    return F.when(a.cast("binary") < b.cast("binary"), -1).when(a.cast("binary") > b.cast("binary"), 1).when(a.isNotNull() & b.isNotNull(), 0)


def random_int(key: Column, low: int, high: int, seed: int = 0) -> Column:
    """An integer from low to high - 1 that follows from the key and the seed alone."""
    return (F.lit(low) + F.floor(random_float(key, 0.0, 1.0, seed) * (high - low))).cast("bigint")


def random_float(key: Column, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    """A number from low up to below high that follows from the key and the seed alone."""
    draw = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.lit(float(low)) + draw * (high - low)


def digest_number(s: Column) -> Column:
    """32 bits of a text's MD5 as a whole number: a draw that follows from the text alone, on any engine."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("bigint")


def radix(s: Column, base: int) -> Column:
    return F.conv(s, base, 10).try_cast("bigint")


def code_point(s: Column, at: int = 1) -> Column:
    """The Unicode code point of one character; null beyond the end."""
    ch = F.substring(s, at, 1)
    raw = F.encode(ch, "UTF-32")
    return F.when(ch != "", F.conv(F.hex(raw), 16, 10).cast("int"))


def from_code_point(n: Column) -> Column:
    """The character of a code point; null for surrogates and what lies outside Unicode."""
    ok = (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32"))


def utf8_size(s: Column) -> Column:
    return F.octet_length(s)


def from_surrogates(high: Column, low: Column) -> Column:
    """The character of a surrogate pair; null unless both are in their ranges."""
    ok = high.between(0xD800, 0xDBFF) & low.between(0xDC00, 0xDFFF)
    return F.when(ok, from_code_point((high - 0xD800) * 1024 + (low - 0xDC00) + 0x10000))


def reverse_bits(n: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.right(F.lpad(F.bin(n), bits, "0"), F.lit(bits))), 2, 10).cast("bigint")


def popcount(n: Column) -> Column:
    return F.bit_count(n)


def hash64(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def subsequence(s: Column, start: int, stop: int) -> Column:
    """Characters start to stop - 1, from 0."""
    return F.substring(s, start + 1, max(0, stop - start))


def format_number(x: Column) -> Column:
    """As %g prints it: six significant digits without trailing zeros."""
    size = F.floor(F.log10(F.abs(x)))
    plain = F.regexp_replace(F.format_string("%.10f", F.round(x, 10)), r"\.?0+$", "")
    whole = F.when(F.abs(x) >= 1, F.regexp_replace(F.format_string("%.5f", x), r"\.?0+$", ""))
    fixed = F.coalesce(whole, plain)
    return F.when(x == 0, "0").when((size >= -4) & (size < 6), fixed).otherwise(F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e"))


def file_parts(path: Column) -> Column:
    """Struct (dir, base, ext) of a file path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.struct(
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"),
        F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name).alias("base"),
        F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).otherwise("").alias("ext"),
    )


def match_prefix(word: str, names: list[str]) -> str | None:
    """The one name, in any case, that is the word or starts with it; None without one or with several."""
    low = word.lower()
    exact = [n for n in names if n.lower() == low]
    hits = exact or [n for n in names if n.lower().startswith(low)]
    return hits[0] if len(hits) == 1 else None


def all_matches(word: str, names: list[str]) -> list[str]:
    return sorted(n for n in names if n.lower().startswith(word.lower()))
