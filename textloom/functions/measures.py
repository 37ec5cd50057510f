"""Vector similarity and distance measures.

One definition table serves all families. A formula is SQL text in the dialect that
Spark and DuckDB share, over quantities that are aggregated once per pair of vectors:

* real contingency: a = sum least(x, y), b = sum x - a, c = sum y - a
* binary contingency: a both, b first only, c second only, d neither (counts)
* elementwise: named sums or maxima of expressions in x and y, and n, the length

Vectors are arrays of doubles of one length; all arithmetic is in doubles. A division by
zero gives the value stated with the formula (1 where two empty vectors count as alike).
In Spark each quantity is an ``aggregate(zip_with(...))`` inside code generation.

Where the documented formula and its common implementation disagree the documented one
holds: similarity of a distance is 1 - d, Bhattacharyya, Hellinger and Matusita use the
fidelity itself, Soergel divides by the maxima, L0 is a real ratio, Clark skips 0/0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = "CAST('Infinity' AS DOUBLE)"


def div(n: str, d: str, other: str = "1.0D") -> str:
    return f"(CASE WHEN ({d}) = 0 THEN {other} ELSE ({n}) / ({d}) END)"


@dataclass(frozen=True)
class Measure:
    """kind: what the value is as it stands; family: which quantities the formula reads."""

    name: str
    kind: str  # similarity or distance
    family: str  # real, binary, element
    formula: str
    parts: tuple[tuple[str, str, str], ...] = ()  # (name, sum or max, expression in x and y)
    normalize: int = 0  # 0 none, 1 L1, 2 L2, 3 Linf: of both vectors, before anything else
    reciprocal: bool = False  # the other kind is 1 / value instead of 1 - value


def _ab(x: str = "a", y: str = "b") -> str:
    return f"({x} + {y})"


AB, AC, SUM3, SUM4 = "(a + b)", "(a + c)", "(a + b + c)", "(2*a + b + c)"
LOW, HIGH = "least(b, c)", "greatest(b, c)"


def _shares(numerator: str, denominator: str, real: bool) -> str:
    """A formula in a, b, c divided by their total N (with d in binary form)."""
    total = SUM3 if real else "(a + b + c + d)"
    shares = {"a": f"(a / {total})", "b": f"(b / {total})", "c": f"(c / {total})"}

    def put(s: str) -> str:
        return "".join(shares.get(ch, ch) if not (i and s[i - 1].isalpha()) and not (i + 1 < len(s) and s[i + 1].isalpha()) else ch for i, ch in enumerate(s))

    return f"(CASE WHEN {total} = 0 THEN 1.0D ELSE {div(put(numerator), put(denominator))} END)"


EXPECTED = "(a + b)*(a + c)"


def _plogp(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0D ELSE {x} * ln(CASE WHEN {x} <= 0 THEN 1.0D ELSE {x} END) END)"


def _log2(x: str) -> str:
    return f"(ln({x}) / ln(2.0D))"


def _contingency(real: bool) -> dict[str, tuple[str, str]]:
    """name -> (kind, formula) of the measures that have a real and a binary form."""
    bray = div("b + c", SUM4)
    d = "0.0D" if real else "d"
    total = SUM3 if real else "(a + b + c + d)"
    both = "(a + b) = 0 AND (a + c) = 0"
    either = "(a + b) = 0 OR (a + c) = 0"
    p, q = f"(a/{total}*{d}/{total})", f"(b/{total}*c/{total})"
    routledge = f"({SUM3}*{SUM3})"
    u = _log2(f"1 + (a + {LOW})/(a + {HIGH})")
    s = f"(1 / sqrt({_log2(f'2 + {LOW}/(a + 1)')}))"
    r = f"({_log2(f'1 + a/{AB}')} * {_log2(f'1 + a/{AC}')})"
    u = f"(CASE WHEN a + {HIGH} = 0 THEN 1.0D ELSE {u} END)"
    r = f"(CASE WHEN {either} THEN 1.0D ELSE {r} END)"
    sokal = "(2*a)" if real else "(2*(a + d))"
    return {
        "anti_dice": ("similarity", div("a", "a + 2*(b + c)")),
        "benini": ("similarity", _shares(f"a - {EXPECTED}", f"a + {LOW} - {EXPECTED}", real)),
        "braun_blanquet": ("similarity", div("a", f"greatest({AB}, {AC})")),
        "bray_curtis": ("distance", bray),
        "cocogaston": ("distance", bray),
        "cody": ("similarity", div(f"a*({AB} + {AC})", f"2*{AB}*{AC}")),
        "dice": ("similarity", div("2*a", SUM4)),
        "fager_mcgowan": ("similarity", div("a", f"sqrt({AB}*{AC}) - {HIGH}/2")),
        "gamma": ("similarity", f"(CASE WHEN {total} = 0 THEN 1.0D ELSE {div(f'{p} - {q}', f'{p} + {q}')} END)"),
        "gilbert": ("similarity", _shares(f"a - {EXPECTED}", f"a + b + c - {EXPECTED}", real)),
        "gini": ("similarity", _shares(f"a - {EXPECTED}", "sqrt(greatest(0.0D, (1 - (a + b)*(a + b))*(1 - (a + c)*(a + c))))", real)),
        "harrison": ("distance", div(LOW, f"a + {HIGH}")),
        "jaccard": ("similarity", div("a", SUM3)),
        "kulczynski1": ("similarity", div("a", "b + c", INF)),
        "kulczynski2": ("similarity", f"(CASE WHEN {both} THEN 1.0D WHEN {either} THEN 0.0D ELSE (a/{AB} + a/{AC})/2 END)"),
        "lance_williams": ("distance", bray),
        "lande": ("distance", "(b + c)/2"),
        "legendre2": ("similarity", div("3*a", "3*a + b + c")),
        "lennon": ("distance", div("2*abs(b - c)", SUM4, "0.0D")),
        "lennon2": ("similarity", f"(CASE WHEN {SUM3} = 0 THEN 1.0D ELSE {_log2(f'{SUM4}/{SUM3}')} END)"),
        "maarel": ("similarity", div("2*a - b - c", SUM4)),
        "magurran": ("distance", f"(CASE WHEN {SUM3} = 0 THEN 1.0D ELSE {SUM4}*(1 - a/{SUM3}) END)"),
        "mcconnagh": ("similarity", div("a*a - b*c", f"{AB}*{AC}")),
        "modified_gini": ("similarity", _shares(f"a - {EXPECTED}", f"1 - abs(b - c)/2 - {EXPECTED}", real)),
        "mountford": ("similarity", div("2*a", "a*(b + c) + 2*b*c")),
        "ochiai": ("similarity", f"(CASE WHEN {both} THEN 1.0D WHEN {either} THEN 0.0D ELSE a/sqrt({AB}*{AC}) END)"),
        "routledge1": ("distance", f"(CASE WHEN {routledge} - 2*b*c = 0 THEN 1.0D ELSE {routledge}/({routledge} - 2*b*c) - 1 END)"),
        "routledge2": ("distance", f"(CASE WHEN {SUM4} = 0 THEN 0.0D ELSE ln({SUM4}) - (2*a*ln(2.0D) + {_plogp(AB)} + {_plogp(AC)})/{SUM4} END)"),
        "simpson": ("similarity", div("a", f"a + {LOW}")),
        "sokal_sneath": ("similarity", div(sokal, f"{sokal} + b + c")),
        "sorgenfrei": ("similarity", div("a*a", f"{AB}*{AC}")),
        "tripartite": ("similarity", f"sqrt({u}*{s}*{r})"),
        "whittaker": ("distance", f"(CASE WHEN {SUM4} = 0 THEN 1.0D ELSE 2*{SUM3}/{SUM4} - 1 END)"),
        "williams": ("distance", div(LOW, SUM3)),
        "williams2": ("distance", div("2*b*c + 1", f"{SUM3}*{SUM3} - {SUM3}")),
        "wilson_shmida": ("distance", bray),
    }


def _half_entropy(log) -> str:
    """Of a cell: x log x and y log y against their mean's."""
    return f"(({log('x')} + {log('y')})/2 - {log('((x + y)/2)')})"


def _plog2p(x: str) -> str:
    return f"({_plogp(x)} / ln(2.0D))"


def _elementwise() -> list[Measure]:
    def m(name, kind, formula, *parts, **more):
        return Measure(name, kind, "element", formula, parts, **more)

    gap, fid = ("s", "sum", "abs(x - y)"), ("f", "sum", "sqrt(x*y)")
    square = ("s", "sum", "(x - y)*(x - y)")
    both_positive = "(CASE WHEN x > 0 AND y > 0 THEN x*ln((CASE WHEN x > 0 THEN x ELSE 1.0D END)/(CASE WHEN y > 0 THEN y ELSE 1.0D END))/ln(2.0D) ELSE 0.0D END)"
    return [
        m("cosine", "similarity", div("p", "sqrt(q)*sqrt(r)", "0.0D"), ("p", "sum", "x*y"), ("q", "sum", "x*x"), ("r", "sum", "y*y")),
        m("manhattan", "distance", "s", gap, reciprocal=True),
        m("euclidean", "distance", "sqrt(s)", square),
        m("squared_euclidean", "distance", "s", square),
        m("linf", "distance", "s", ("s", "max", "abs(x - y)")),
        m("l0", "distance", div("s", "n", "0.0D"), ("s", "sum", "(CASE WHEN x = y THEN 0.0D ELSE 1.0D END)")),
        m("l_norm", "distance", "s", gap),
        m("canberra", "distance", div("s", "t", "0.0D"), gap, ("t", "sum", "(abs(x) + abs(y))")),
        m("soergel", "distance", div("s", "t", "0.0D"), gap, ("t", "sum", "greatest(x, y)")),
        m("lorentzian", "distance", "s", ("s", "sum", "ln(1 + abs(x - y))")),
        m("fidelity", "similarity", "f", fid),
        m("bhattacharyya", "distance", f"(CASE WHEN f <= 0 THEN {INF} ELSE -ln(CASE WHEN f <= 0 THEN 1.0D ELSE f END) END)", fid, normalize=1),
        m("hellinger", "distance", "2*sqrt(greatest(0.0D, 1 - f))", fid, normalize=1),
        m("matusita", "distance", "sqrt(greatest(0.0D, 2 - 2*f))", fid, normalize=1),
        m("squared_chord", "distance", "s", ("s", "sum", "(sqrt(x) - sqrt(y))*(sqrt(x) - sqrt(y))")),
        m("clark", "distance", "sqrt(s)", ("s", "sum", f"({div('abs(x - y)', 'x + y', '0.0D')}*{div('abs(x - y)', 'x + y', '0.0D')})")),
        m("wave_hedges", "distance", "s", ("s", "sum", div("abs(x - y)", "greatest(x, y)", "0.0D"))),
        m("sangvi", "distance", "sqrt(s)", ("s", "sum", div("(x - y)*(x - y)", "x + y", "0.0D"))),
        m("circle_product", "similarity", div("s", "2*n", "0.0D"), ("s", "sum", "least(x, y)")),
        m("similarity_ratio", "similarity", div("p", "q - p", INF), ("p", "sum", "x*y"), ("q", "sum", "(x*x + y*y)")),
        m("robinson", "distance", "s/2", gap, normalize=1),
        m("jensen", "distance", "s", ("s", "sum", _half_entropy(_plogp)), normalize=1),
        m("jensen_shannon", "distance", "s", ("s", "sum", _half_entropy(_plog2p)), normalize=1),
        m("topsoe", "distance", "2*s", ("s", "sum", _half_entropy(_plog2p)), normalize=1),
        m("kullback_leibler", "distance", "s", ("s", "sum", both_positive), normalize=1),
        m("kumar_johnson", "distance", "s", ("s", "sum", div("(x*x - y*y)", "2*power(x*y, 1.5D)", "0.0D"))),
        m("taneja", "distance", "s", ("s", "sum", "(CASE WHEN x*y = 0 THEN 0.0D ELSE (x + y)/2*ln((x + y)/(2*sqrt(CASE WHEN x*y = 0 THEN 1.0D ELSE x*y END))) END)")),
        m("tversky", "similarity", div("p", "p + 0.5D*(q - p) + 0.5D*(r - p)"), ("p", "sum", "least(x, y)"), ("q", "sum", "x"), ("r", "sum", "y")),
        m(
            "morisita",
            "similarity",
            div("2*p", f"({div('q', 'u*u', '0.0D')} + {div('r', 'w*w', '0.0D')})*u*w"),
            ("p", "sum", "x*y"),
            ("q", "sum", "x*x"),
            ("r", "sum", "y*y"),
            ("u", "sum", "x"),
            ("w", "sum", "y"),
        ),
    ]


def _registry() -> dict[str, Measure]:
    out = {m.name: m for m in _elementwise()}
    for prefix, family in (("", "real"), ("binary_", "binary")):
        for name, (kind, formula) in _contingency(family == "real").items():
            out[prefix + name] = Measure(prefix + name, kind, family, formula)
    return dict(sorted(out.items()))


MEASURES = _registry()

# Other names by which measures are known.
ALIASES = {"binary_modgini": "binary_modified_gini", "binary_wilsonshmida": "binary_wilson_shmida", "tanimoto": "similarity_ratio"}


def find_measure(name: str) -> Measure:
    """By name, in any case; a prefix that only one name has will do."""
    low = name.lower()
    known = {**{k: k for k in MEASURES}, **ALIASES}
    if low in known:
        return MEASURES[known[low]]
    hits = {known[k] for k in known if k.startswith(low)}
    if len(hits) != 1:
        raise KeyError(f"{name!r} names {'no measure' if not hits else 'several measures: ' + ', '.join(sorted(hits))}")
    return MEASURES[hits.pop()]


CONTINGENCY = {
    "real": (("a", "sum", "least(x, y)"), ("b", "sum", "(x - least(x, y))"), ("c", "sum", "(y - least(x, y))")),
    "binary": tuple(
        (k, "sum", f"(CASE WHEN {test} THEN 1.0D ELSE 0.0D END)")
        for k, test in (("a", "x <> 0 AND y <> 0"), ("b", "x <> 0 AND y = 0"), ("c", "x = 0 AND y <> 0"), ("d", "x = 0 AND y = 0"))
    ),
}


def parts_of(measure: Measure) -> tuple[tuple[str, str, str], ...]:
    return measure.parts or CONTINGENCY[measure.family]


def norm_weight(v: str, mode: int) -> str:
    """SQL for what a vector is divided by: 1, its L1, L2 or largest absolute value."""
    return {
        0: "1.0D",
        1: f"aggregate({v}, 0.0D, (norm_s, norm_x) -> norm_s + abs(norm_x))",
        2: f"sqrt(aggregate({v}, 0.0D, (norm_s, norm_x) -> norm_s + norm_x*norm_x))",
        3: f"aggregate({v}, 0.0D, (norm_s, norm_x) -> greatest(norm_s, abs(norm_x)))",
    }[mode]


def normalized(v: str, mode: int) -> str:
    """SQL for a vector over its norm; a zero vector stays as it is."""
    if not mode:
        return v
    w = norm_weight(v, mode)
    # The vector is named inside the lambda, so the lambda's own name must be no column's.
    return f"transform({v}, norm_e -> norm_e / (CASE WHEN {w} = 0 THEN 1.0D ELSE {w} END))"


def quantity(expression: str, how: str, v1: str, v2: str) -> str:
    fold = "s + z" if how == "sum" else "greatest(s, z)"
    return f"aggregate(zip_with({v1}, {v2}, (x, y) -> {expression}), 0.0D, (s, z) -> {fold})"


def measure_sql(measure: str | Measure, v1: str, v2: str, normalize: int | None = None) -> str:
    """Spark SQL for the measure of two array columns, given by name."""
    m = find_measure(measure) if isinstance(measure, str) else measure
    mode = m.normalize if normalize is None else normalize
    x, y = normalized(v1, mode), normalized(v2, mode)
    names = [p[0] for p in parts_of(m)]
    values = [f"'{k}', {quantity(e, how, x, y)}" for k, how, e in parts_of(m)]
    record = f"named_struct({', '.join(values)}, 'n', cast(size({v1}) as double))"
    # Quantities are computed once, in a one-element array that the formula is mapped over.
    formula = _prefixed(m.formula, [*names, "n"], "q")
    return f"transform(array({record}), q -> {formula})[0]"


def _prefixed(formula: str, names: list[str], to: str) -> str:
    """The formula with each of the names as a field of a struct."""
    out, word = [], ""
    for ch in formula + "\0":
        if ch.isalnum() or ch in "_.":
            word += ch
            continue
        out.append(f"{to}.{word}" if word in names else word)
        word = ""
        out.append(ch)
    return "".join(out)[:-1]


def measure(name: str, v1: str, v2: str, normalize: int | None = None) -> Column:
    """The measure's own value for two array columns."""
    return F.expr(measure_sql(name, v1, v2, normalize))


def similarity(name: str, v1: str, v2: str, normalize: int | None = None) -> Column:
    m = find_measure(name)
    value = measure(name, v1, v2, normalize)
    return value if m.kind == "similarity" else _other(m, value)


def distance(name: str, v1: str, v2: str, normalize: int | None = None) -> Column:
    m = find_measure(name)
    value = measure(name, v1, v2, normalize)
    return value if m.kind == "distance" else _other(m, value)


def _other(m: Measure, value: Column) -> Column:
    if m.reciprocal:
        return F.when(value == 0, F.lit(float("inf"))).otherwise(1 / value)
    if m.name.endswith("kulczynski1"):
        return 1 / (1 + value)
    return 1 - value


def l_norm(v1: str, v2: str, power: float) -> Column:
    """Minkowski distance; a power of 0 or less means the largest difference."""
    if power <= 0:
        return measure("linf", v1, v2)
    inner = quantity(f"power(abs(x - y), {float(power)!r}D)", "sum", v1, v2)
    return F.expr(f"power({inner}, 1.0D / {float(power)!r}D)")


def tversky(v1: str, v2: str, alpha: float, beta: float) -> Column:
    p, q, r = (quantity(e, "sum", v1, v2) for e in ("least(x, y)", "x", "y"))
    bottom = f"{p} + {alpha!r}D*({q} - {p}) + {beta!r}D*({r} - {p})"
    return F.expr(div(p, bottom))


def mahalanobis(v1: str, v2: str, variances: str) -> Column:
    """With a diagonal covariance given as an array column; dimensions without variance are left out."""
    gaps = f"zip_with({v1}, {v2}, (x, y) -> (x - y)*(x - y))"
    return F.expr(f"sqrt(aggregate(zip_with({gaps}, {variances}, (g, w) -> CASE WHEN w > 0 THEN g / w ELSE 0.0D END), 0.0D, (s, z) -> s + z))")


def pair_oracle(m: Measure, source: str) -> str:
    """DuckDB SQL for the measure of all pairs id1 < id2 of a long table (id, dim, val) with every cell present."""
    value = "val" if not m.normalize else "val / CASE WHEN w = 0 THEN 1 ELSE w END"
    parts = ", ".join(f"{'sum' if how == 'sum' else 'max'}({e.replace('.0D', '.0').replace('.5D', '.5')}) AS {k}" for k, how, e in parts_of(m))
    formula = m.formula.replace(".0D", ".0").replace(".5D", ".5")
    return f"""
WITH cells AS ({source}),
w AS (SELECT id, dim, val, sum(abs(val)) OVER (PARTITION BY id) AS w FROM cells),
v AS (SELECT id, dim, CAST({value} AS DOUBLE) AS val FROM w),
q AS (SELECT id1, id2, {parts}, CAST(count(*) AS DOUBLE) AS n FROM
  (SELECT l.id AS id1, r.id AS id2, l.val AS x, r.val AS y FROM v l JOIN v r ON l.dim = r.dim AND l.id < r.id) GROUP BY id1, id2)
SELECT id1, id2, round({formula}, 6) + 0.0 AS value FROM q
"""
