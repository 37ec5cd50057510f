from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import cognate, collections, literals, romanize, strings, text, tokenize, vectors

ENGLISH = {
    "Hello, world!": "Hello , world !",
    "N.A.T.O. met in the U.S. today.": "N.A.T.O. met in the U.S. today .",
    "don't re-use e-mail 1,234.56 or 2.5e-3": "don't re-use e-mail 1, 234.56 or 2.5e-3",
    "range 123-456 and -7": "range 123 - 456 and -7",
    "foo.com -- bar": "foo.com -- bar",
    "price: $5.00 (approx)": "price : $ 5.00 ( approx )",
    "a/b <tag>x</tag>": "a / b < tag > x < / tag >",
    "": "",
}


def one(spark, value, s):
    return spark.createDataFrame([(s,)], "s string").select(value(F.col("s"))).first()[0]


@pytest.mark.parametrize(("given", "wanted"), ENGLISH.items())
def test_english(given, wanted):
    assert tokenize.english_words(given) == wanted.split()


def test_splitters(spark):
    assert tokenize.english_words("1,234.56 it", strict=False) == ["1,234.56", "it"]
    assert one(spark, lambda s: tokenize.delimited(s, ","), "a,b,,c") == ["a", "b", "c"]
    assert one(spark, lambda s: tokenize.delimited(s, ","), ",a") == ["", "a"]
    assert one(spark, tokenize.whitespace, " a b  c\n") == ["a", "b", "c"]
    assert one(spark, tokenize.csv, 'x,"a,""b""",,z') == ["x", 'a,"b"', "", "z"]
    assert one(spark, lambda s: tokenize.canonical(s, True), "Hi, you") == "HI , YOU"
    assert one(spark, tokenize.english, None) is None


def test_scalars(spark):
    assert one(spark, text.trim, "\t a b \n") == "a b"
    assert [one(spark, text.count_words, s) for s in ("", "a", "a b", "a  b")] == [0, 1, 2, 3]
    assert [one(spark, text.is_number, s) for s in ("1", "-1.5", ".5", "1e5", "x", "")] == [True, True, True, False, False, False]
    assert [one(spark, text.is_punct, s) for s in ("!", "! x", "!x", "a")] == [True, True, False, False]
    assert one(spark, text.unquote, r'"a\"b"') == 'a"b'
    assert one(spark, text.unquote, "|x|") == "x"
    assert [one(spark, lambda s: text.to_int(s), s) for s in ("12", "-0x10", "017", "2147483648", "x")] == [12, -16, 15, None, None]
    assert one(spark, text.to_number, "3/4").asDict() == {"num": 3, "den": 4}
    assert one(spark, text.to_number, "3/0") is None
    assert one(spark, lambda s: text.from_code_point(text.code_point(s)), "é!") == "é"
    assert one(spark, lambda s: text.from_surrogates(F.lit(0xD83D), F.lit(0xDE00)), "") == "\U0001f600"
    assert one(spark, lambda s: text.from_code_point(F.lit(0xD800)), "") is None
    assert one(spark, lambda s: text.reverse_bits(F.lit(6), 8), "") == 96
    assert [one(spark, lambda s: text.format_number(s.cast("double")), s) for s in ("2.5", "100000", "1e10", "0", "0.001")] == ["2.5", "100000", "1e+10", "0", "0.001"]
    assert text.match_prefix("co", ["cosine", "dice"]) == "cosine"
    assert text.match_prefix("", ["a", "b"]) is None


def test_literals():
    assert literals.parse('(a "b c" 1 2.5 3/4 #*011 #XFF #3R12)') == ["a", "b c", 1, 2.5, {"num": 3, "den": 4}, [False, True, True], 255, 5]
    assert literals.parse("#H((k 1) (m (x y)))") == {"k": 1, "m": ["x", "y"]}
    assert literals.parse("#S(a b a)") == ["a", "b"]
    assert literals.to_json("(a") is None and literals.to_json("a)") is None and literals.to_json(None) is None


def test_many_pairs():
    """Pairs aligned together score as they do one by one."""
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcé𝄞", k=rng.randint(0, 7)))
    a, b = [word() for _ in range(500)], [word() for _ in range(500)]
    costs = cognate.Costs().doublings("abc", 0.9).transpositions("ab", 1.5).add("a", "", 0.3).add("", "b", 0.2).add("ab", "c", 1.2).add("c", "abé", 1.1)
    for c in (None, costs):
        for scaling in ("longer", "shorter", "average"):
            assert cognate.scores_of(a, b, c, scaling) == pytest.approx([cognate.score(x, y, c, scaling) for x, y in zip(a, b, strict=True)])
    assert strings.jaro_scores(a, b) == pytest.approx([strings.jaro_score(x, y) for x, y in zip(a, b, strict=True)])
    assert strings.jaro_winkler_scores(a, b) == pytest.approx([strings.jaro_winkler_score(x, y) for x, y in zip(a, b, strict=True)])


def test_more_scripts():
    assert romanize.romanize_text("한글 각 값 앉") == "hangeul gag gabs anj"
    assert romanize.romanize_text("ᄀ") == "g" and romanize.romanize_text("ᅡ") == "a" and romanize.romanize_text("ᆨ") == "g"
    assert romanize.romanize_text("ไทย ๑๒") == "ịthy 12" and romanize.romanize_text("१०") == "10"
    assert romanize.romanize_text("ሀለ") == "hala"


def test_cognates():
    for a, b, v in (("night", "nacht", 0.6), ("cat", "bat", 0.6667), ("colour", "color", 0.8333), ("house", "haus", 0.6), ("kitten", "sitting", 0.5714)):
        assert round(cognate.score(a, b), 4) == v
    assert cognate.score("", "") == 1 and cognate.score("", "a") == 0
    costs = cognate.Costs().transpositions("he", 1.8)
    assert cognate.score("teh", "the", costs) == pytest.approx(2.8 / 3)
    assert cognate.alignment("teh", "the", costs) == [("t", "t"), ("eh", "he")]
    assert cognate.Costs(fold=True).cognate("A", "a")
    near = cognate.Costs().adjacent_keys("qwerty", 0.5, 0.2)
    assert near.cognate("q", "w") and near.cognate("q", "a") and not near.cognate("q", "p")


def test_suggestions(spark):
    vocab = spark.createDataFrame([("colour",), ("cool",), ("dog",)], "word string")
    rows = cognate.suggestions(spark.createDataFrame([("color",)], "word string"), vocab, least=0.5).collect()
    assert [(r["suggestion"], r["rank"]) for r in rows] == [("colour", 1), ("cool", 2)]


def test_romanize():
    assert romanize.romanize_text("Αθήνα ευχαριστώ") == "Athina evcharisto"
    assert romanize.romanize_text("Москва щука") == "Moskva shchuka"
    assert romanize.romanize_text("नमस्ते") == "namaste"
    assert romanize.romanize_text("plain é") == "plain é"
    assert romanize.romanizable("ж") and not romanize.romanizable("z")


def test_jaro():
    assert strings.jaro_score("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert strings.jaro_winkler_score("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert strings.jaro_score("", "a") == 0


def test_vectors_and_lists(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0, 1.0], {1: 2.0}, {1: 1.0, 5: 1.0}, "2:1.5 7:-1", "#<TermVector:x 1:2 3:0.5>")], "a array<double>, b array<double>, s map<int,double>, t map<int,double>, line string, lit string")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        vectors.length(a), vectors.add(a, b, 2.0), vectors.increase(b, a), vectors.normalize(a), vectors.sparse_add(F.col("s"), F.col("t")),
        vectors.sparse_insert(F.col("s"), 1, 9.0), vectors.sparse_to_dense(F.col("s"), 3), vectors.parse_sparse(F.col("line")), vectors.parse_term_vector(F.col("lit")),
        collections.elide(b, 1, 2), collections.resize(a, 3, 0.0), collections.last(a),
    ).first()
    assert list(row) == [5.0, [5.0, 6.0, 2.0], [4.0, 5.0, 1.0], [0.6, 0.8], {1: 3.0, 5: 1.0}, {1: 2.0}, [0.0, 2.0, 0.0], {2: 1.5, 7: -1.0}, {1: 2.0, 3: 0.5}, [1.0, 1.0], [3.0, 4.0, 0.0], 4.0]


def test_objects(spark):
    from textloom.functions import objects

    read = objects.tolerant_json
    assert read('{"a" 1 "b": [1, 2 3], c {d e}}') == {"a": 1, "b": [1, 2, 3], "c": {"d": "e"}}
    assert read('[true false null -1.5e3 "q\\"x" 01]') == [True, False, None, -1500.0, 'q"x', "01"]
    assert json.loads(objects.json_of("{}")) == {} and objects.json_of("[1,2,]") == "[1, 2]"
    for broken in ("{", "[1}", "1 ]", "[1] [2]", '{"a"}', '"open', "", '["\\x"]'):
        assert objects.json_of(broken, {"": read}) is None
    assert read("[" * 5000 + "]" * 5000) and objects.json_of("(" * 5000) is None and objects.json_of(None) is None
    assert objects.json_of("(a 1)") == '["a", 1]' and objects.json_of("<5>", {"<": lambda t: int(t[1:-1])}) == "5"
    rows = spark.createDataFrame([("{k 1}",), ("!x",), ("(",), (None,)], "s string")
    got = rows.select(F.to_json(objects.read_objects(F.col("s"), {"!": lambda t: {"said": t[1:]}})).alias("j")).collect()
    assert [r["j"] for r in got] == ['{"k":1}', '{"said":"x"}', None, None]
