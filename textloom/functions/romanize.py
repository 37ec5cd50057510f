"""Romanisation of text in other scripts.

Greek follows ISO 843, Cyrillic ISO 9 with common digraphs in place of carons. Letters
of other alphabets are read by their Unicode names (ARMENIAN SMALL LETTER BEN, HIRAGANA
LETTER KA): the part of the name that tells the sound, by a rule for each script. Thai
follows ISO 11940. Hangul syllables are taken apart into their letters, which are read one
by one. Decimal digits of any script become ASCII digits. A consonant sign of an Indic script carries its vowel "a" unless a vowel sign or a virama
follows.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 843.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))
GREEK_PAIRS = {"αυ": "av", "ευ": "ev", "ηυ": "iv", "ου": "ou", "γγ": "ng", "γξ": "nx", "γχ": "nch", "μπ": "b"}
# ISO 9 letters, in digraphs.
CYRILLIC = dict(
    zip(
        "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґўђѓљњћќџѕј",
        "a b v g d e zh z i j k l m n o p r s t u f kh c ch sh shch _ y _ e yu ya yo i yi ye g u dj gj lj nj c kj dz dz j".split(),
        strict=True,
    )
)
# ISO 11940 letters and vowels from U+0E01 and from U+0E40 on.
THAI = dict(
    zip(
        map(chr, (*range(0x0E01, 0x0E3A), *range(0x0E40, 0x0E47))),
        "k kh ḳh kh kh ḳh ng c ch ch s ch y ḍ ṭ ṭh ṯh th ṇ d t th th ṭh n b p ph f ph f ph m y r v l ł w ṣ s s h ḷ x ḥ ǂ"
        " a ạ ā å i ī ụ ụ u ū e æ o ı ị ɨ «".split(),
        strict=True,
    )
)
# Hangul letters in the order of their syllables' initials, vowels and finals.
INITIALS = "g kk n d tt l m b pp s ss _ j jj ch k t p h".split()
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = "_ g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".split()

# How the last word of a letter's Unicode name is read where it is not its own sound.
NAMED = {
    "ARMENIAN": {
        "AYB": "a", "BEN": "b", "GIM": "g", "DA": "d", "ECH": "e", "ZA": "z", "EH": "e", "ET": "e", "TO": "t", "ZHE": "zh",
        "INI": "i", "LIWN": "l", "XEH": "kh", "CA": "ts", "KEN": "k", "HO": "h", "JA": "dz", "GHAD": "gh", "CHEH": "ch",
        "MEN": "m", "YI": "y", "NOW": "n", "SHA": "sh", "VO": "o", "CHA": "ch", "PEH": "p", "JHEH": "j", "RA": "r",
        "SEH": "s", "VEW": "v", "TIWN": "t", "REH": "r", "CO": "ts", "YIWN": "w", "PIWR": "p", "KEH": "k", "OH": "o", "FEH": "f",
    },
    "HEBREW": {
        "ALEF": "'", "BET": "b", "GIMEL": "g", "DALET": "d", "HE": "h", "VAV": "v", "ZAYIN": "z", "HET": "h", "TET": "t",
        "YOD": "y", "KAF": "k", "LAMED": "l", "MEM": "m", "NUN": "n", "SAMEKH": "s", "AYIN": "'", "PE": "p", "TSADI": "ts",
        "QOF": "q", "RESH": "r", "SHIN": "sh", "TAV": "t",
    },
    "ARABIC": {
        "ALEF": "a", "BEH": "b", "TEH": "t", "THEH": "th", "JEEM": "j", "HAH": "h", "KHAH": "kh", "DAL": "d", "THAL": "dh",
        "REH": "r", "ZAIN": "z", "SEEN": "s", "SHEEN": "sh", "SAD": "s", "DAD": "d", "TAH": "t", "ZAH": "z", "AIN": "'",
        "GHAIN": "gh", "FEH": "f", "QAF": "q", "KAF": "k", "LAM": "l", "MEEM": "m", "NOON": "n", "HEH": "h", "WAW": "w",
        "YEH": "y", "HAMZA": "'", "MARBUTA": "h", "PEH": "p", "TCHEH": "ch", "JEH": "zh", "GAF": "g",
    },
    "GEORGIAN": {
        "AN": "a", "BAN": "b", "GAN": "g", "DON": "d", "EN": "e", "VIN": "v", "ZEN": "z", "TAN": "t", "IN": "i", "KAN": "k",
        "LAS": "l", "MAN": "m", "NAR": "n", "ON": "o", "PAR": "p", "ZHAR": "zh", "RAE": "r", "SAN": "s", "TAR": "t", "UN": "u",
        "PHAR": "p", "KHAR": "k", "GHAN": "gh", "QAR": "q", "SHIN": "sh", "CHIN": "ch", "CAN": "ts", "JIL": "dz", "CIL": "ts",
        "CHAR": "ch", "XAN": "kh", "JHAN": "j", "HAE": "h",
    },
}
INDIC = frozenset("DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA".split())


def hangul(code: int) -> str | None:
    """The sound of a Hangul syllable, or of one of the letters that syllables are made of."""
    at = code - 0xAC00
    if 0 <= at < 19 * 21 * 28:
        parts = INITIALS[at // (21 * 28)], VOWELS[at // 28 % 21], FINALS[at % 28]
        return "".join(parts).replace("_", "")
    for first, sounds in ((0x1100, INITIALS), (0x1161, VOWELS), (0x11A7, FINALS)):
        if 0 <= code - first < len(sounds):
            return sounds[code - first].replace("_", "")
    return None


@functools.cache
def _letter(ch: str) -> tuple[str, str] | None:
    """(kind, sound): letter, consonant (with inherent a), sign or virama; None for what is not romanised."""
    low = ch.lower()
    plain = unicodedata.normalize("NFD", low)[0]
    for table in (GREEK, CYRILLIC):
        if low in table or plain in table:
            return "letter", table.get(low, table.get(plain)).replace("_", "")
    if ch in THAI:
        return "letter", THAI[ch]
    if (sound := hangul(ord(ch))) is not None:
        return "letter", sound
    if not ch.isascii() and unicodedata.decimal(ch, None) is not None:
        return "letter", str(unicodedata.decimal(ch))
    words = unicodedata.name(ch, "").split()
    if not words:
        return None
    script = words[0]
    if script in NAMED and "LETTER" in words:
        known = [w for w in words if w in NAMED[script]]
        return ("letter", NAMED[script][known[-1]]) if known else None
    if (script in ("HIRAGANA", "KATAKANA") and "LETTER" in words) or (script == "ETHIOPIC" and "SYLLABLE" in words):
        return "letter", words[-1].lower()
    if script in INDIC:
        if "VIRAMA" in words:
            return "virama", ""
        if "VOWEL" in words and "SIGN" in words:
            return "sign", words[-1].lower()
        if "ANUSVARA" in words:
            return "letter", "m"
        if "LETTER" in words:
            sound = words[-1].lower()
            return ("consonant", sound[:-1]) if len(sound) > 1 and sound.endswith("a") and sound != "aa" else ("letter", sound)
    return None


def romanizable(ch: str) -> bool:
    return _letter(ch) is not None


def romanize_text(text: str) -> str:
    out: list[str] = []
    i = 0
    while i < len(text):
        ch = text[i]
        pair = text[i : i + 2]
        low = "".join(unicodedata.normalize("NFD", c)[0] for c in pair.lower())
        sound, width = None, 1
        if len(pair) == 2 and low in GREEK_PAIRS and "̈" not in unicodedata.normalize("NFD", pair[1]):
            sound, width = GREEK_PAIRS[low], 2
        elif (found := _letter(ch)) is not None:
            kind, sound = found
            if kind == "consonant":
                after = _letter(text[i + 1]) if i + 1 < len(text) else None
                if after is None or after[0] not in ("sign", "virama"):
                    sound += "a"
        if sound is None:
            out.append(ch)
        else:
            out.append(sound[:1].upper() + sound[1:] if ch.isupper() else sound)
        i += width
    return "".join(out)


def romanize(s: Column) -> Column:
    """romanize_text of a column in Arrow batches; texts in ASCII pass through."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else romanize_text(t))

    return convert(s)
