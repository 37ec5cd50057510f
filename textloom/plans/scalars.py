"""Queries of scalar functions, readers and small operators, and of clusterings that recursive SQL can follow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import cognate, collections, literals, measures, objects, tokenize, vectors
from textloom.functions import text as T
from textloom.operators import cluster, corpus, graph, relations, trie
from textloom.operators.tables import materialize, shared_dir
from textloom.plans.catalog import _WS, ORACLES, PROFILE_SQL, _name_pairs, docs, embeddings, long, nation_profile, query, table, tidy
from textloom.sources import io
from textloom.streaming import vocabulary


def own_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


# ---- literals, buffers, text ----


@query("SELECT n_nationkey, n_name AS first, CAST(n_regionkey AS VARCHAR) AS second, CAST(2 AS BIGINT) AS n FROM nation")
def json_arrays(spark, sf):
    text = F.concat(F.lit('["'), "n_name", F.lit('", "'), F.col("n_regionkey").cast("string"), F.lit('"]'))
    got = table(spark, sf, "nation").select("n_nationkey", io.from_json(text, "array<string>").alias("a"))
    return got.select("n_nationkey", F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(1)).alias("second"), long(F.size("a")).alias("n"))


@query(
    "SELECT n_nationkey, '{\"name\": \"' || n_name || '\", \"key\": ' || n_nationkey || '}' AS map, '[\"a\", ' || n_regionkey || ']' AS \"set\" FROM nation"
)
def map_and_set_literals(spark, sf):
    key = F.col("n_nationkey").cast("string")
    held = F.concat(F.lit('#H((name "'), "n_name", F.lit('") (key '), key, F.lit("))"))
    some = F.concat(F.lit("#S(a "), F.col("n_regionkey").cast("string"), F.lit(" a "), F.col("n_regionkey").cast("string"), F.lit(")"))
    return table(spark, sf, "nation").select("n_nationkey", literals.read_object(held).alias("map"), literals.read_object(some).alias("set"))


@query("SELECT p_partkey, CAST(2 AS BIGINT) AS n, CAST(p_size AS DOUBLE) AS one, CAST(p_size AS DOUBLE) / 2 AS seven FROM part")
def term_vector_literals(spark, sf):
    size = F.col("p_size").cast("double")
    text = F.concat(F.lit("#<TermVector:x 1:"), size.cast("string"), F.lit(" 7:"), (size / 2).cast("string"), F.lit(">"))
    got = table(spark, sf, "part").select("p_partkey", vectors.parse_term_vector(text).alias("v"))
    return got.select("p_partkey", long(F.size("v")).alias("n"), F.try_element_at("v", F.lit(1)).alias("one"), F.try_element_at("v", F.lit(7)).alias("seven"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey - 100) AS BIGINT) AS total, CAST(4 * count(*) AS BIGINT) AS bytes FROM lineitem GROUP BY l_orderkey")
def integer_buffers(spark, sf):
    """Buffers of 32-bit integers written and read back."""
    path = own_path(spark, "buffers")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("bigint") - 100).alias("v"))
    rows.select("l_orderkey", io.to_fixed_ints(F.col("v"), 32).alias("content")).write.parquet(path)
    back = spark.read.parquet(path).select("l_orderkey", F.octet_length("content").alias("bytes"), io.fixed_ints(F.col("content"), 32, signed=True).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
    return back.select("l_orderkey", long(F.size("v")).alias("n"), total.alias("total"), long("bytes").alias("bytes"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS first, CAST(count(*) + 1 AS BIGINT) AS n, string_agg('a' || chr(9) || n_name || '\\', '|' ORDER BY n_name || chr(92)) AS names FROM nation GROUP BY n_regionkey")
def string_blocks(spark, sf):
    """Arrays of strings with marks inside, as lines of a text file and back."""
    path = own_path(spark, "blocks")
    named = F.array_sort(F.collect_list(F.concat(F.lit("a\t"), "n_name", F.lit("\\"))))
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(named.alias("names"))
    io.save_blocks(rows.select(F.concat(F.array(F.col("n_regionkey").cast("string")), "names").alias("block")), path)
    back = io.load_blocks(spark, path)
    return back.select(F.get("block", F.lit(0)).alias("first"), long(F.size("block")).alias("n"), F.array_join(F.slice("block", 2, 100), "|").alias("names"))


@query(
    "SELECT p_partkey, p_name || ' x' AS skipped, ' ' || split_part(p_name || ' x', ' ', 2) || substr(p_name || ' x', length(split_part(p_name || ' x', ' ', 1)) + length(split_part(p_name || ' x', ' ', 2)) + 2) AS rest,"
    " p_name || '\"' AS quoted, '|' || p_name AS open, substr(p_name, 3, 4) AS part FROM part"
)
def blanks_and_quotes(spark, sf):
    name = F.col("p_name")
    padded = F.concat(F.lit(" \t\n"), name, F.lit(" x"))
    return table(spark, sf, "part").select(
        "p_partkey", T.skip_blanks(padded).alias("skipped"), T.from_next_blank(F.concat(name, F.lit(" x"))).alias("rest"),
        T.unquote(F.concat(F.lit('"'), name, F.lit('\\""'))).alias("quoted"), T.unquote(F.concat(F.lit("|"), name)).alias("open"), T.subsequence(name, 2, 6).alias("part"),
    )


@query("SELECT p_partkey, chr(CAST(65536 + (p_partkey % 40) * 1024 + p_size AS INTEGER)) AS ch, CAST(NULL AS VARCHAR) AS wrong FROM part")
def surrogate_pairs(spark, sf):
    high, low = F.lit(0xD800) + F.col("p_partkey") % 40, F.lit(0xDC00) + F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", T.from_surrogates(high.cast("int"), low.cast("int")).alias("ch"), T.from_surrogates(low.cast("int"), high.cast("int")).alias("wrong"))


@query("SELECT count(DISTINCT c_name) AS names, count(DISTINCT c_name) AS hashes, count(*) AS same FROM customer")
def hash_values(spark, sf):
    """64-bit hashes: equal for equal values, as many as there are values."""
    rows = table(spark, sf, "customer").select("c_name", T.hash64(F.col("c_name")).alias("h"), T.hash64(F.concat("c_name", F.lit(""))).alias("again"))
    return rows.agg(F.count_distinct("c_name").alias("names"), F.count_distinct("h").alias("hashes"), F.sum((F.col("h") == F.col("again")).cast("bigint")).alias("same"))


@query(
    "WITH w AS (SELECT DISTINCT lower(substr(n_name, 1, k)) AS word FROM nation, (SELECT unnest([1, 2, 4, 30]) AS k)), m AS (SELECT word, list_sort(list(n_name)) AS names FROM w JOIN nation ON starts_with(lower(n_name), word) GROUP BY word)"
    " SELECT word, CASE WHEN len(list_filter(names, lambda x: lower(x) = word)) = 1 THEN list_filter(names, lambda x: lower(x) = word)[1] WHEN len(names) = 1 THEN names[1] END AS match, array_to_string(names, '|') AS names FROM m"
)
def name_matches(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    words = nations.select(F.explode(F.array(*[F.lower(F.substring("name", 1, k)) for k in (1, 2, 4, 30)])).alias("word"))
    return relations.match_names(words, nations).select("word", "match", F.array_join("all", "|").alias("names"))


@query("SELECT n_nationkey, CAST(3 AS BIGINT) AS n, CAST(n_nationkey AS VARCHAR) AS size, 'b' AS kind, CAST(NULL AS VARCHAR) AS none FROM nation")
def symbol_properties(spark, sf):
    m = F.create_map(F.lit("kind"), F.lit("a"), F.lit("name"), F.col("n_name"))
    held = collections.with_property(collections.with_property(m, "kind", F.lit("b")), "size", F.col("n_nationkey").cast("string"))
    rows = table(spark, sf, "nation").select("n_nationkey", held.alias("m"))
    return rows.select("n_nationkey", long(F.size("m")).alias("n"), *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("size", "kind", "none")])


@query("WITH s AS (SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS folded FROM customer GROUP BY 1) SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, md5(folded) AS folded FROM s")
def ordered_fold(spark, sf):
    rows = table(spark, sf, "customer").select(long("c_nationkey").alias("c_nationkey"), "c_custkey", "c_mktsegment")
    got = relations.fold(rows, ["c_nationkey"], ["c_custkey"], F.lit(""), lambda s, r: F.when(s == "", r["c_mktsegment"]).otherwise(F.concat_ws(",", s, r["c_mktsegment"])))
    return got.select("c_nationkey", F.md5("folded").alias("folded"))


@query(
    "SELECT l_returnflag, count(*) AS n, CAST(min(l_partkey) AS BIGINT) AS low, CAST(max(l_partkey) AS BIGINT) AS high, CAST(bit_xor(l_orderkey * 8 + l_linenumber) AS BIGINT) AS mix FROM lineitem GROUP BY l_returnflag"
)
def merged_fold(spark, sf):
    """A caller's states over groups that hold a third of all rows each."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", long("l_partkey").alias("part"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row"))
    start = lambda: {"n": 0, "low": None, "high": None, "mix": 0}
    low = lambda f, a, b: b if a is None else a if b is None else f(a, b)

    def merge(a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "low": low(min, a["low"], b["low"]), "high": low(max, a["high"], b["high"]), "mix": a["mix"] ^ b["mix"]}

    def add(s: dict, r: dict) -> dict:
        return merge(s, {"n": 1, "low": r["part"], "high": r["part"], "mix": r["row"]})

    return relations.merge_fold(rows, ["l_returnflag"], "n long, low long, high long, mix long", start, add, merge)


@query(
    "WITH w AS (SELECT " + _WS + " AS words FROM benchmark), v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT unnest(words) AS word FROM w))"
    " SELECT word, CAST(id % 50 AS BIGINT) AS at, CAST(1 AS DOUBLE) AS total FROM v"
)
def one_hot_terms(spark, sf):
    """Term vectors with a single one, at the word's number."""
    toks = corpus.tokens(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    ids = io.symbols(toks, "word").select(F.col("name").alias("word"), (F.col("id") % 50).alias("at"))
    held = ids.select("word", vectors.one_hot(F.col("at"), 50).alias("v"))
    return held.select("word", long(F.array_position("v", 1.0) - 1).alias("at"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


ORACLES["random_basis"] = (
    "WITH b AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand, '[' || array_to_string([CASE "
    + _DRAW.format("p_brand || ':' || i || ':0'")
    + " % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '-1.0' ELSE '0.0' END FOR i IN range(64)], ',') || ']' AS basis FROM b"
)
ORACLES["ctx_random_index"] = (
    "WITH w AS (SELECT " + _WS + " AS words FROM documents), p AS (SELECT words, unnest(range(1, len(words) + 1)) AS i FROM w), o AS (SELECT words[i] AS word, i + o AS j, words FROM p, (SELECT unnest([-2, -1, 1, 2]) AS o)),"
    " c AS (SELECT word, words[j] AS context, count(*) AS weight FROM o WHERE j >= 1 AND j <= len(words) GROUP BY 1, 2), d AS (SELECT DISTINCT context FROM c),"
    " t AS (SELECT context, unnest(range(8)) AS k FROM d), r AS (SELECT context, " + _DRAW.format("context || ':' || k || ':0'") + " AS draw FROM t),"
    " x AS (SELECT word, draw % 256 AS dim, sum(weight * CASE WHEN draw < 2147483648 THEN 1 ELSE -1 END) AS weight FROM c JOIN r USING (context) GROUP BY 1, 2)"
    " SELECT word, count(*) AS dims, CAST(sum(abs(weight)) AS BIGINT) AS total FROM x WHERE weight <> 0 GROUP BY word"
)


@query(f"WITH v AS ({PROFILE_SQL}) SELECT id, round(sum(abs(val)), 6) + 0.0 AS l1, round(sqrt(sum(val * val)), 6) + 0.0 AS l2, round(max(abs(val)), 6) + 0.0 AS linf FROM v GROUP BY id")
def norm_weights(spark, sf):
    return nation_profile(spark, sf).select("id", *[tidy(F.expr(measures.norm_weight("v", k))).alias(name) for k, name in ((1, "l1"), (2, "l2"), (3, "linf"))])


# ---- graphs, tries, options ----


@query("WITH e AS (SELECT DISTINCT c_nationkey AS a, CAST(c_custkey % 25 AS INTEGER) AS b FROM customer), w AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation) SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM w WHERE (a, b) IN (SELECT (a, b) FROM e)")
def edge_exists(spark, sf):
    edges = table(spark, sf, "customer").select(long("c_nationkey").alias("src"), long(F.col("c_custkey") % 25).alias("dst"), F.lit(1.0).alias("len"))
    return graph.has_edge(edges, table(spark, sf, "nation").select(long("n_nationkey").alias("src"), long("n_regionkey").alias("dst")))


@query("SELECT DISTINCT upper(p_name) AS key FROM part WHERE upper(p_name) IN (SELECT upper(p_name) FROM part WHERE p_size < 10)")
def trie_find(spark, sf):
    parts = table(spark, sf, "part")
    return trie.find(parts.select(F.upper("p_name").alias("key")).distinct(), parts.filter("p_size < 10").select(F.upper("p_name").alias("key")))


@query(
    "SELECT n_nationkey, CASE WHEN n_regionkey < 4 THEN n_regionkey + 1 END::BIGINT AS k, CASE WHEN n_regionkey < 4 THEN n_nationkey / 4 END::DOUBLE AS threshold,"
    " CASE WHEN n_regionkey < 4 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'random' ELSE 'separated' END END AS init, CASE WHEN n_regionkey < 4 THEN 'kmedoids' END AS method, n_regionkey = 4 AS refused FROM nation"
)
def option_strings(spark, sf):
    """Option strings read, applied to the defaults and checked; an unknown option is refused."""
    flag = F.when(F.col("n_nationkey") % 2 == 0, "+rand").otherwise("!ran")
    text = F.concat(F.lit("meth=kmed:k="), (F.col("n_regionkey") + 1).cast("string"), F.lit(":thr="), (F.col("n_nationkey") / 4).cast("string"), F.lit(":"), flag, F.when(F.col("n_regionkey") == 4, ":q=1").otherwise(""))
    got = table(spark, sf, "nation").select("n_nationkey", cluster.parsed_options(text).alias("o"))
    return got.select("n_nationkey", long("o.k").alias("k"), F.col("o.threshold").alias("threshold"), F.col("o.init").alias("init"), F.col("o.method").alias("method"), F.col("o.error").isNotNull().alias("refused"))


@query("SELECT true AS dense, false AS mixed")
def vectors_of_a_kind(spark, sf):
    rows = embeddings(spark, sf).select("vec_id", F.col("v").alias("dense"), F.lit(None).cast("map<int,double>").alias("sparse"))
    one = F.create_map(F.lit(1), F.lit(1.0))
    mixed = rows.select("vec_id", F.when(F.col("vec_id") > 9, F.col("dense")).alias("dense"), F.when(F.col("vec_id") <= 9, one).alias("sparse"))
    return spark.createDataFrame([(cluster.all_sparse_or_dense(rows), cluster.all_sparse_or_dense(mixed))], "dense boolean, mixed boolean")


def _vector_distance(name: str, how: str, agg: str, reverse: bool) -> None:
    order = ("b.v", "a.v") if reverse else ("a.v", "b.v")

    def run(spark, sf):
        rows = embeddings(spark, sf)
        members = rows.select("vec_id", F.col("label").alias("cluster"), "v")
        got = cluster.to_vectors(members, rows.filter("vec_id % 10 = 0"), how, kind="distance", reverse=reverse)
        return got.select("cluster", "vec_id", tidy("value").alias("value"))

    query(
        "WITH u AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
        f" SELECT a.label AS cluster, b.vec_id AS vec_id, round({agg}(1 - list_cosine_similarity({order[0]}, {order[1]})), 6) + 0.0 AS value FROM u a JOIN u b ON b.vec_id % 10 = 0 GROUP BY 1, 2",
        name,
    )(run)


for _case in (("distance_average", "average", "avg", False), ("distance_nearest", "nearest", "min", False), ("distance_furthest_reversed", "furthest", "max", True)):
    _vector_distance(f"vector_{_case[0]}", *_case[1:])


# ---- cognates ----


def _weighted_sql() -> str:
    """The alignment table by diagonals: d1 to d4 are the last four, by letters of w1; a cell outside is very small."""
    at = lambda d, i: f"coalesce({d}[{i}], -1e9)"
    a, b = "substr(w1, CAST(i AS INTEGER), 1)", "substr(w2, CAST(k + 1 - i AS INTEGER), 1)"
    a2, b2 = "substr(w1, CAST(i - 1 AS INTEGER), 1)", "substr(w2, CAST(k - i AS INTEGER), 1)"
    rows = cognate.KEYBOARDS["qwerty"]
    near = " OR ".join(f"(strpos('{r}', {a}) > 0 AND strpos('{r}', {b}) > 0 AND abs(strpos('{r}', {a}) - strpos('{r}', {b})) = 1)" for r in rows)
    far = " OR ".join(
        f"(strpos('{p}', {x}) > 0 AND strpos('{q}', {y}) > 0 AND strpos('{p}', {x}) - strpos('{q}', {y}) IN (0, 1))" for p, q in zip(rows, rows[1:]) for x, y in ((a, b), (b, a))
    )
    single = f"CASE WHEN {a} = {b} THEN 1.0 WHEN {near} THEN 0.4 WHEN {far} THEN 0.2 ELSE 0.0 END"
    twice = "strpos('aeioulnrst', {0}) > 0"
    ways = [
        at("d1", "i + 1"), at("d1", "i"), f"{at('d2', 'i')} + {single}",
        f"CASE WHEN i >= 2 AND {a} = {a2} AND {a} = {b} AND {twice.format(a)} THEN {at('d3', 'i - 1')} + 0.9 ELSE -1e9 END",
        f"CASE WHEN k - i >= 1 AND {b} = {b2} AND {a} = {b} AND {twice.format(a)} THEN {at('d3', 'i')} + 0.9 ELSE -1e9 END",
        f"CASE WHEN i >= 2 AND k - i >= 1 AND {a} = {b2} AND {a2} = {b} AND {a} <> {b} AND strpos('aeiou', {a}) > 0 AND strpos('aeiou', {b}) > 0 THEN {at('d4', 'i - 1')} + 1.5 ELSE -1e9 END",
    ]
    inside = f"CASE WHEN i = 0 OR k + 1 - i = 0 THEN 0.0 ELSE greatest({', '.join(ways)}) END"
    cell = f"CASE WHEN k + 1 - i < 0 OR k + 1 - i > length(w2) THEN -1e9 ELSE {inside} END"
    every = "range(0, length(w1) + 1)"
    empty = f"list_transform({every}, lambda i: CAST(-1e9 AS DOUBLE))"
    return (
        "WITH RECURSIVE n AS (SELECT lower(n_name) AS w FROM nation), p AS (SELECT a.w AS w1, b.w AS w2 FROM n a JOIN n b ON a.w < b.w),"
        f" d AS (SELECT w1, w2, 0 AS k, list_transform({every}, lambda i: CAST(CASE WHEN i = 0 THEN 0 ELSE -1e9 END AS DOUBLE)) AS d1, {empty} AS d2, {empty} AS d3, {empty} AS d4 FROM p"
        f" UNION ALL SELECT w1, w2, k + 1, list_transform({every}, lambda i: CAST({cell} AS DOUBLE)), d1, d2, d3 FROM d WHERE k < length(w1) + length(w2))"
        " SELECT w1, w2, round(d1[length(w1) + 1] / ((length(w1) + length(w2)) / 2.0), 6) + 0.0 AS score FROM d WHERE k = length(w1) + length(w2)"
    )


ORACLES["cognate_weighted"] = _weighted_sql()


@query(ORACLES["cognate_exact"].replace("round(d1[length(w1) + 1] / greatest(length(w1), length(w2)), 6) + 0.0 AS score", "CAST(d1[length(w1) + 1] AS BIGINT) AS same, w1 AS sources, w2 AS targets"))
def cognate_alignment(spark, sf):
    rows = _name_pairs(spark, sf).withColumn("parts", cognate.alignments(F.col("w1"), F.col("w2")))
    same = F.size(F.filter("parts", lambda p: p["source"] == p["target"]))
    join = lambda side: F.array_join(F.transform("parts", lambda p: p[side]), "")
    return rows.select("w1", "w2", long(same).alias("same"), join("source").alias("sources"), join("target").alias("targets"))


_ROW = "(strpos('{0}', a) > 0 AND strpos('{0}', b) > 0 AND abs(strpos('{0}', a) - strpos('{0}', b)) <= 1)"


@query(
    "WITH l AS (SELECT DISTINCT lower(substr(n_name, k, 1)) AS ch FROM nation, (SELECT unnest([1, 2, 3]) AS k)), p AS (SELECT x.ch AS a, y.ch AS b FROM l x, l y)"
    f" SELECT a, b, a = b OR {' OR '.join(_ROW.format(r) for r in cognate.KEYBOARDS['dvorak'])} AS cognate FROM p"
)
def cognate_letters(spark, sf):
    letter = F.explode(F.array(*[F.lower(F.substring("n_name", k, 1)) for k in (1, 2, 3)]))
    l = materialize(table(spark, sf, "nation").select(letter.alias("ch")).distinct(), "letters")  # noqa: E741
    pairs = l.select(F.col("ch").alias("a")).crossJoin(F.broadcast(l.select(F.col("ch").alias("b"))))  # an alphabet
    return pairs.select("a", "b", cognate.letters_cognate(F.col("a"), F.col("b"), cognate.Costs().adjacent_keys("dvorak", 0.5)).alias("cognate"))


# ---- clusterings that recursive SQL follows step by step ----

_COS = "u AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS MATERIALIZED (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) AS n FROM u)"

ORACLES["leader_clusters"] = (
    f"WITH RECURSIVE {_COS}, m AS MATERIALIZED (SELECT a.n AS n, a.vec_id AS vec_id, list(list_cosine_similarity(a.v, b.v) ORDER BY b.n) AS sims FROM n a JOIN n b ON b.n <= a.n GROUP BY 1, 2),"
    " r AS (SELECT CAST(1 AS BIGINT) AS n, (SELECT vec_id FROM n WHERE n.n = 1) AS vec_id, [CAST(1 AS BIGINT)] AS heads, CAST(0 AS BIGINT) AS cluster"
    " UNION ALL SELECT n, vec_id, CASE WHEN new THEN list_append(heads, n) ELSE heads END, CASE WHEN new THEN len(heads) ELSE list_position(s, list_max(s)) - 1 END FROM"
    " (SELECT m.n AS n, m.vec_id AS vec_id, heads, [sims[h] FOR h IN heads] AS s, list_max([sims[h] FOR h IN heads]) < 0.3 AND len(heads) < 10 AS new FROM r JOIN m ON m.n = r.n + 1))"
    " SELECT vec_id, cluster FROM r"
)


def _kmeans_sql(start: str, rounds: int, medoid: bool = False) -> str:
    """Rounds of assignments as tables a1, a2, ...; start gives s (centre, vec_id)."""
    out = [
        f"WITH RECURSIVE {_COS}, o AS MATERIALIZED (SELECT vec_id, v, row_number() OVER (ORDER BY md5(vec_id || ':0'), vec_id) - 1 AS pos FROM u), {start},"
        " c AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM u), z1 AS MATERIALIZED (SELECT centre, v AS cv FROM s JOIN u USING (vec_id))"
    ]
    for k in range(1, rounds + 1):
        out.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, centre FROM (SELECT u.vec_id AS vec_id, centre, row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_cosine_similarity(u.v, cv), 12) DESC, centre) AS k FROM u, z{k}) WHERE k = 1)"
        )
        sums = f"SELECT centre, list(x ORDER BY dim) AS cv FROM (SELECT centre, dim, sum(x) AS x FROM c JOIN a{k} USING (vec_id) GROUP BY 1, 2) GROUP BY centre"
        if medoid:
            sums = f"SELECT a.centre AS centre, arg_max(u.v, struct_pack(s := list_cosine_similarity(u.v, t.cv), t := -u.vec_id)) AS cv FROM a{k} a JOIN u USING (vec_id) JOIN ({sums}) t ON t.centre = a.centre GROUP BY 1"
        out.append(f"z{k + 1} AS MATERIALIZED ({sums})")
    return ", ".join(out[:-1]) + f" SELECT vec_id, CAST(centre AS BIGINT) AS cluster FROM a{rounds}"


#: Of 2 k + 1 vectors the one that is nearest to another leaves, until k are left; of the nearest two the first.
_APART = (
    "b AS MATERIALIZED (SELECT x.pos AS p, y.pos AS q, list_cosine_similarity(x.v, y.v) AS s FROM o x JOIN o y ON x.pos <> y.pos AND x.pos < 21 AND y.pos < 21),"
    " g AS (SELECT 21 AS left_, list(pos ORDER BY pos) AS held FROM o WHERE pos < 21 UNION ALL SELECT left_ - 1, list_filter(held, lambda x: x <> gone) FROM"
    " (SELECT left_, held, (SELECT p FROM b WHERE list_contains(held, p) AND list_contains(held, q) ORDER BY s DESC, p LIMIT 1) AS gone FROM g WHERE left_ > 10)),"
    " h AS (SELECT unnest(held) AS pos FROM g WHERE left_ = 10), s AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS centre, vec_id FROM h JOIN o USING (pos))"
)


@query(_kmeans_sql("s AS (SELECT pos AS centre, vec_id FROM o WHERE pos < 10)", 3))
def kmeans_random(spark, sf):
    return cluster.run(embeddings(spark, sf), "method=kmeans:k=10:iterations=3:+random")


ORACLES["kmeans"] = _kmeans_sql(_APART, 5)
ORACLES["kmedoids"] = _kmeans_sql(_APART, 3, medoid=True)

_MERGED = (
    f"WITH RECURSIVE v AS ({PROFILE_SQL}), q AS (SELECT a.id AS x, b.id AS y, sum(a.val * b.val) / sqrt(sum(a.val * a.val)) / sqrt(sum(b.val * b.val)) AS s FROM v a JOIN v b ON a.dim = b.dim AND a.id <> b.id GROUP BY 1, 2),"
    " p AS MATERIALIZED (FROM q), r AS (SELECT DISTINCT 0 AS step, id AS vec_id, id AS top, '' AS path FROM v UNION ALL"
    " SELECT r.step + 1, r.vec_id, CASE WHEN r.top = m.b THEN m.a ELSE r.top END, CASE WHEN r.top = m.a THEN '0' || r.path WHEN r.top = m.b THEN '1' || r.path ELSE r.path END FROM r,"
    " (SELECT x.top AS a, y.top AS b, avg(p.s) AS s FROM r x JOIN r y ON x.top < y.top JOIN p ON p.x = x.vec_id AND p.y = y.vec_id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1) m WHERE (SELECT count(DISTINCT top) FROM r) > 5),"
    " f AS (SELECT * FROM r WHERE step = (SELECT max(step) FROM r)) "
)


def _nation_merges(spark, sf):
    rows = nation_profile(spark, sf).select(F.col("id").alias("vec_id"), "v")
    return cluster.agglomerate(rows, cluster.Options(method="brown", k=5, threshold=-1.0))


@query(_MERGED + "SELECT vec_id, dense_rank() OVER (ORDER BY top) - 1 AS cluster, 'B' || path AS path FROM f")
def merged_nations(spark, sf):
    """Brown merging of the nations' profiles, with each member's path."""
    return _nation_merges(spark, sf).select("vec_id", long("cluster").alias("cluster"), "path")


@query(_MERGED + "SELECT vec_id, substr('B' || path, 1, 3) AS cluster FROM f")
def flattened_merges(spark, sf):
    return cluster.flatten(_nation_merges(spark, sf), 2)


@query("SELECT true AS same, false AS other")
def clusters_equal(spark, sf):
    """Two assignments that group alike under other names, and two that do not."""
    rows = embeddings(spark, sf).select("vec_id", F.col("label").alias("cluster"))
    renamed = rows.select("vec_id", (F.col("cluster") * 10 + 3).alias("cluster"))
    moved = rows.select("vec_id", F.when(F.col("vec_id") == 0, F.col("cluster") + 1).otherwise(F.col("cluster")).alias("cluster"))
    return spark.createDataFrame([(cluster.same_clusters(rows, renamed), cluster.same_clusters(rows, moved))], "same boolean, other boolean")


def _dbscan_sql(epsilon: float) -> str:
    return ORACLES["dbscan_clusters"].replace("<= 0.65", f"<= {epsilon}")


_EPSILONS = (0.5, 0.6, 0.65)


@query(" UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS epsilon, vec_id, cluster FROM ({_dbscan_sql(e)})" for e in _EPSILONS))
def optics_cuts(spark, sf):
    """One density structure, cut at several epsilons."""
    found = cluster.optics(embeddings(spark, sf), cluster.Options(method="optics", epsilon=max(_EPSILONS), min_points=3))
    cuts = [cluster.optics_cut(found, e).select(F.lit(e).alias("epsilon"), "vec_id", "cluster") for e in _EPSILONS]
    return cuts[0].unionByName(cuts[1]).unionByName(cuts[2])


@query(
    "SELECT n_nationkey, form, n_name AS name, CAST(n_regionkey AS BIGINT) AS third, CASE WHEN form = 2 THEN NULL ELSE 'deep' END AS inner, form = 2 AS refused FROM nation, (SELECT unnest([0, 1]) AS form)"
    " UNION ALL SELECT n_nationkey, 2, NULL, NULL, NULL, true FROM nation"
)
def variant_objects(spark, sf):
    """Objects in tolerant JSON and as literals, read into VARIANT; a broken one is null."""
    name, number = F.concat(F.lit('"'), "n_name", F.lit('"')), F.col("n_regionkey").cast("string")
    texts = [
        F.concat(F.lit('{"name" '), name, F.lit(' list [1 2 '), number, F.lit('] "in" {key: deep}}')),
        F.concat(F.lit("#H((name "), name, F.lit(") (list (1 2 "), number, F.lit(")) (in #H((key deep))))")),
        F.concat(F.lit('{"name" '), name, F.lit(" list [1 2}")),
    ]
    rows = table(spark, sf, "nation").select("n_nationkey", F.posexplode(F.array(*texts)).alias("form", "text"))
    rows = rows.select("n_nationkey", "form", objects.read_objects(F.col("text")).alias("v"))
    got = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select("n_nationkey", "form", got("$.name", "string").alias("name"), got("$.list[2]", "bigint").alias("third"), got("$.in.key", "string").alias("inner"), F.col("v").isNull().alias("refused"))


# ---- table functions and streams ----


@query(
    "SELECT item_id, CAST(len(w) AS BIGINT) AS words, md5(array_to_string(w, '|')) AS digest FROM (SELECT item_id, " + _WS + " AS w FROM benchmark) WHERE len(w) > 0"
)
def words_by_table_function(spark, sf):
    """Words by a Python table function in a lateral join, in their order."""
    rows = tokenize.token_table(table(spark, sf, "benchmark").select("item_id", "text"), "whitespace")
    got = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return got.select("item_id", long(F.size("w")).alias("words"), F.md5(F.array_join(F.transform("w", lambda x: x["word"]), "|")).alias("digest"))


@query("WITH w AS (SELECT " + _WS + " AS words FROM documents), v AS (SELECT DISTINCT unnest(words) AS word FROM w) SELECT count(*) AS words, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, count(*) AS ids FROM v")
def stream_vocabulary(spark, sf):
    """The documents' words as a stream of four files, each word numbered when it is first seen."""
    source, path = own_path(spark, "stream"), own_path(spark, "vocabulary")
    docs(spark, sf).select(F.explode(tokenize.whitespace(F.col("text"))).alias("word")).repartition(4).write.parquet(source)
    words = spark.readStream.schema("word string").option("maxFilesPerTrigger", 1).parquet(source)
    vocabulary.follow(words, path, own_path(spark, "progress")).awaitTermination()
    held = vocabulary.read_vocabulary(spark, path)
    return held.agg(F.count_distinct("word").alias("words"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids"))
