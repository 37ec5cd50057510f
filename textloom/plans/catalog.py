"""Every query by name, and the DuckDB SQL that it is checked against.

A query takes (spark, folder of tables) and runs over whole tables. Fixtures:

* nation_profile: orders by customer nation (id) and order priority x market segment
  (dim), every cell present: dense counts.
* nation_day: orders by customer nation and day: dense arrays with many zeros.
* embeddings: signed vectors with labels. Searches take every vector whose id is
  divisible by 100 as a query, against all vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cognate, collections, measures, romanize, strings, tokenize, vectors
from textloom.functions import text as T
from textloom.operators import cluster, corpus, graph, relations, trie
from textloom.operators.tables import materialize, shared_dir
from textloom.sources import io
from textloom.streaming import counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def tidy(c, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# ---- vector fixtures ----


#: Dimensions of a dense table at most.
MAX_DIMS = 100_000


def dense(cells: DataFrame) -> DataFrame:
    """(id, v): arrays in the order of dim; a cell that is missing is 0. The dimensions are one list, whose length is checked."""
    dims = cells.select("dim").distinct().agg(F.array_sort(F.collect_list("dim")).alias("dims"))
    few = dims.select(F.when(F.size("dims") <= MAX_DIMS, F.col("dims")).otherwise(F.raise_error(F.lit(f"more than {MAX_DIMS} dimensions"))).alias("dims"))
    # Every element of the result is one row for a moment: zeros for all dimensions beside what there is.
    zeros = cells.select("id").distinct().crossJoin(F.broadcast(few)).select("id", F.explode("dims").alias("dim"), F.lit(0.0).alias("val"))  # few is one row
    sums = cells.select("id", "dim", F.col("val").cast("double").alias("val")).unionByName(zeros).groupBy("id", "dim").agg(F.sum("val").alias("val"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "val"))), lambda c: c["val"]).alias("v"))


def nation_cells(spark: SparkSession, sf: str, dim: Column) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return rows.groupBy(F.col("c_nationkey").cast("bigint").alias("id"), dim.alias("dim")).agg(F.count("*").cast("double").alias("val"))


def nation_profile(spark: SparkSession, sf: str) -> DataFrame:
    return dense(nation_cells(spark, sf, F.concat_ws("|", "o_orderpriority", "c_mktsegment")))


def nation_day(spark: SparkSession, sf: str) -> DataFrame:
    return dense(nation_cells(spark, sf, F.date_format("o_orderdate", "yyyy-MM-dd")))


def _cells_sql(dim: str) -> str:
    return f"""
SELECT i.id AS id, d.dim AS dim, CAST(coalesce(n.val, 0) AS DOUBLE) AS val FROM
(SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS id FROM orders JOIN customer ON o_custkey = c_custkey) i CROSS JOIN
(SELECT DISTINCT {dim} AS dim FROM orders JOIN customer ON o_custkey = c_custkey) d LEFT JOIN
(SELECT c_nationkey AS id, {dim} AS dim, count(*) AS val FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) n
ON n.id = i.id AND n.dim = d.dim"""


PROFILE_SQL = _cells_sql("o_orderpriority || '|' || c_mktsegment")
DAY_SQL = _cells_sql("strftime(o_orderdate, '%Y-%m-%d')")


def pairs(rows: DataFrame) -> DataFrame:
    a = rows.select(F.col("id").alias("id1"), F.col("v").alias("v1"))
    return a.join(rows.select(F.col("id").alias("id2"), F.col("v").alias("v2")), F.col("id1") < F.col("id2"))


def _measure_query(m: measures.Measure) -> None:
    source = nation_day if m.family == "binary" else nation_profile

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return pairs(source(spark, sf)).select("id1", "id2", tidy(measures.measure(m.name, "v1", "v2")).alias("value"))

    query(measures.pair_oracle(m, DAY_SQL if m.family == "binary" else PROFILE_SQL), f"vec_{m.name}")(run)


for _m in measures.MEASURES.values():
    _measure_query(_m)

_PAIR_SQL = f"""WITH v AS ({PROFILE_SQL}), p AS (SELECT l.id AS id1, r.id AS id2, l.dim AS dim, l.val AS x, r.val AS y FROM v l JOIN v r ON l.dim = r.dim AND l.id < r.id) """


@query(_PAIR_SQL + "SELECT id1, id2, round(pow(sum(pow(abs(x - y), 3.0)), 1.0/3), 6) + 0.0 AS value FROM p GROUP BY id1, id2")
def vec_l_norm_3(spark, sf):
    return pairs(nation_profile(spark, sf)).select("id1", "id2", tidy(measures.l_norm("v1", "v2", 3.0)).alias("value"))


@query(_PAIR_SQL + "SELECT id1, id2, round(sum(least(x, y)) / (sum(least(x, y)) + 0.2*(sum(x) - sum(least(x, y))) + 0.8*(sum(y) - sum(least(x, y)))), 6) + 0.0 AS value FROM p GROUP BY id1, id2")
def vec_tversky_weighted(spark, sf):
    return pairs(nation_profile(spark, sf)).select("id1", "id2", tidy(measures.tversky("v1", "v2", 0.2, 0.8)).alias("value"))


@query(
    f"WITH v AS ({PROFILE_SQL}), w AS (SELECT dim, var_samp(val) AS w FROM v GROUP BY dim), p AS (SELECT l.id AS id1, r.id AS id2, l.val AS x, r.val AS y, w FROM v l JOIN v r ON l.dim = r.dim AND l.id < r.id JOIN w ON w.dim = l.dim)"
    " SELECT id1, id2, round(sqrt(sum(CASE WHEN w > 0 THEN (x - y)*(x - y)/w ELSE 0 END)), 6) + 0.0 AS value FROM p GROUP BY id1, id2"
)
def vec_mahalanobis(spark, sf):
    rows = nation_profile(spark, sf)
    spread = rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_samp("x").alias("w"))
    spread = spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "w"))), lambda c: c["w"]).alias("w"))  # one row
    return pairs(rows).crossJoin(F.broadcast(spread)).select("id1", "id2", tidy(measures.mahalanobis("v1", "v2", "w")).alias("value"))


@query(_PAIR_SQL + ", s AS (SELECT id1, id2, sum(x*y) AS p, sum(x*x) AS q, sum(y*y) AS r FROM p GROUP BY id1, id2) SELECT id1, id2, round(p/sqrt(q)/sqrt(r), 6) + 0.0 AS sim, round(1 - p/sqrt(q)/sqrt(r), 6) + 0.0 AS dist FROM s")
def vec_similarity_and_distance(spark, sf):
    return pairs(nation_profile(spark, sf)).select("id1", "id2", tidy(measures.similarity("COS", "v1", "v2")).alias("sim"), tidy(measures.distance("cosine", "v1", "v2")).alias("dist"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(long("vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), long("label").alias("label"))


EMBEDDING_CELLS = "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


def _vector_query(name: str, value: Callable[[Column], Column], sql: str) -> None:
    @query(f"WITH c AS ({EMBEDDING_CELLS}) SELECT vec_id, round({sql}, 5) + 0.0 AS value FROM c GROUP BY vec_id", name)
    def run(spark, sf):
        return embeddings(spark, sf).select("vec_id", tidy(value(F.col("v")), 5).alias("value"))


_sum = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
_vector_query("vec_norm", lambda v: vectors.length(v), "sqrt(sum(x*x))")
_vector_query("vec_weight_sum", lambda v: vectors.weight_sum(v), "sum(abs(x))")
_vector_query("vec_max_weight", lambda v: vectors.largest_weight(v), "max(abs(x))")
_vector_query("vec_scale", lambda v: _sum(vectors.scale(v, 2.5)), "sum(x*2.5)")
_vector_query("vec_normalize", lambda v: F.aggregate(vectors.normalize(v), F.lit(0.0), lambda s, x: s + F.abs(x)), "sum(abs(x))/sqrt(sum(x*x))")
_vector_query("vec_slice", lambda v: _sum(collections.subsequence(v, 8, 24)), "coalesce(sum(x) FILTER (WHERE dim > 8 AND dim <= 24), 0)")
_vector_query("vec_text_round_trip", lambda v: _sum(vectors.parse_dense(F.array_join(F.transform("v", lambda x: x.cast("string")), " "))), "sum(x)")
_vector_query(
    "sparse_text_round_trip",
    lambda v: _sum(F.map_values(vectors.parse_sparse(F.array_join(F.transform("v", lambda x, i: F.concat_ws(":", i.cast("string"), x.cast("string"))), " ")))),
    "sum(x)",
)

_NEXT_SQL = f"WITH c AS ({EMBEDDING_CELLS}), p AS (SELECT a.vec_id AS vec_id, a.dim AS dim, a.x AS x, b.x AS y FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND a.dim = b.dim) "


def _next(spark, sf):
    e = embeddings(spark, sf).select("vec_id", "v")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


@query(_NEXT_SQL + "SELECT vec_id, round(sum(abs(x + y)), 5) + 0.0 AS value FROM p GROUP BY vec_id")
def vec_add(spark, sf):
    return _next(spark, sf).select("vec_id", tidy(vectors.weight_sum(vectors.add(F.col("v"), F.col("w"))), 5).alias("value"))


@query(_NEXT_SQL + "SELECT vec_id, round(sum(abs(x + y*CASE WHEN dim <= 32 THEN 0.5 ELSE 0 END)), 5) + 0.0 AS value FROM p GROUP BY vec_id")
def vec_increase(spark, sf):
    return _next(spark, sf).select("vec_id", tidy(vectors.weight_sum(vectors.increase(F.col("v"), F.slice("w", 1, 32), 0.5)), 5).alias("value"))


def _positive(v: str) -> Column:
    return F.map_from_entries(F.filter(F.transform(v, lambda x, i: F.struct(i.alias("key"), x.alias("value"))), lambda e: e["value"] > 0))


@query(_NEXT_SQL + "SELECT vec_id, round(sum(CASE WHEN x > 0 THEN x ELSE 0 END + CASE WHEN y > 0 THEN y ELSE 0 END), 5) + 0.0 AS value, sum(CASE WHEN x > 0 OR y > 0 THEN 1 ELSE 0 END)::BIGINT AS cells FROM p GROUP BY vec_id")
def sparse_add(spark, sf):
    rows = _next(spark, sf).select("vec_id", _positive("v").alias("a"), _positive("w").alias("b"))
    both = rows.withColumn("s", vectors.sparse_add(F.col("a"), F.col("b")))
    return both.select("vec_id", tidy(_sum(F.map_values("s")), 5).alias("value"), long(vectors.index_union(F.col("a"), F.col("b"))).alias("cells"))


@query(f"WITH c AS ({EMBEDDING_CELLS}) SELECT vec_id, (count(*) FILTER (WHERE x > 0) + max(CASE WHEN dim = 1 AND x <= 0 THEN 1 ELSE 0 END))::BIGINT AS cells FROM c GROUP BY vec_id")
def sparse_insert(spark, sf):
    return embeddings(spark, sf).select("vec_id", long(F.size(vectors.sparse_insert(_positive("v"), 0, 1.0))).alias("cells"))


@query()
def random_basis(spark, sf):
    return table(spark, sf, "part").select("p_brand").distinct().select("p_brand", F.to_json(vectors.basis(F.col("p_brand"), 64)).alias("basis"))


# ---- searches and clusters ----

_SIMS = f"WITH c AS ({EMBEDDING_CELLS}), n AS (SELECT vec_id, sqrt(sum(x*x)) AS n FROM c GROUP BY vec_id) "
_KNN = _SIMS + """, s AS (SELECT q.vec_id AS query, b.vec_id AS vec_id, sum(q.x*b.x) AS p FROM c q JOIN c b ON q.dim = b.dim AND q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT s.query AS query, s.vec_id AS vec_id, p/a.n/b.n AS sim, row_number() OVER (PARTITION BY s.query ORDER BY p/a.n/b.n DESC, s.vec_id) AS rank FROM s JOIN n a ON a.vec_id = s.query JOIN n b ON b.vec_id = s.vec_id) """


def _knn(spark, sf, k):
    e = embeddings(spark, sf)
    found = cluster.neighbours(e.filter(F.col("vec_id") % 100 == 0), e, k)
    return found.select("query", "vec_id", tidy("sim", 5).alias("sim"), long("rank").alias("rank"))


@query(_KNN + "SELECT query, vec_id, round(sim, 5) + 0.0 AS sim, rank FROM r WHERE rank <= 1")
def knn_top1(spark, sf):
    return _knn(spark, sf, 1)


@query(_KNN + "SELECT query, vec_id, round(sim, 5) + 0.0 AS sim, rank FROM r WHERE rank <= 10")
def knn_topk(spark, sf):
    return _knn(spark, sf, 10)


def _labelled(spark, sf):
    return embeddings(spark, sf).withColumnRenamed("label", "cluster")


@query(f"WITH c AS ({EMBEDDING_CELLS}) SELECT label AS cluster, CAST(dim - 1 AS BIGINT) AS dim, round(sum(x), 4) + 0.0 AS value FROM c GROUP BY label, dim")
def centroid_sum(spark, sf):
    rows = cluster.centroids(_labelled(spark, sf)).select("cluster", F.posexplode("v").alias("dim", "x"))
    return rows.select("cluster", long("dim").alias("dim"), tidy("x", 4).alias("value"))


@query(f"WITH c AS ({EMBEDDING_CELLS}) SELECT label AS cluster, CAST(dim - 1 AS BIGINT) AS idx, round(sum(x), 4) + 0.0 AS val FROM c WHERE x > 0 GROUP BY label, dim")
def centroid_sparse(spark, sf):
    cells = _labelled(spark, sf).select("cluster", "vec_id", F.posexplode("v").alias("idx", "val")).filter("val > 0")
    return cluster.sparse_centroids(cells).select("cluster", long("idx").alias("idx"), tidy("val", 4).alias("val"))


@query("SELECT CAST(label AS BIGINT) AS cluster, count(*) AS size FROM embeddings GROUP BY 1")
def cluster_sizes(spark, sf):
    return cluster.centroids(_labelled(spark, sf)).select("cluster", "size")


_MEDOID = _SIMS + """, z AS (SELECT label, dim, sum(x) AS z FROM c GROUP BY label, dim), zn AS (SELECT label, sqrt(sum(z*z)) AS zn FROM z GROUP BY label),
s AS (SELECT c.label AS label, c.vec_id AS vec_id, sum(x*z) AS p FROM c JOIN z ON c.label = z.label AND c.dim = z.dim GROUP BY 1, 2) """


@query(_MEDOID + "SELECT s.label AS cluster, arg_max(s.vec_id, p/n/zn) AS vec_id FROM s JOIN n ON n.vec_id = s.vec_id JOIN zn ON zn.label = s.label GROUP BY s.label")
def medoid(spark, sf):
    return cluster.medoids(_labelled(spark, sf))


_SEEDS = "seeds AS (SELECT vec_id, label FROM n JOIN (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label FROM embeddings) e USING (vec_id) WHERE vec_id % 10 = 0)"


@query(
    _SIMS
    + f", {_SEEDS}, s AS (SELECT a.vec_id AS vec_id, b.vec_id AS centre, sum(a.x*b.x) AS p FROM c a JOIN c b ON a.dim = b.dim WHERE a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0 GROUP BY 1, 2),"
    " t AS (SELECT s.vec_id AS vec_id, s.centre AS centre, p/a.n/b.n AS sim, row_number() OVER (PARTITION BY s.vec_id ORDER BY p/a.n/b.n DESC, s.centre) AS k FROM s JOIN n a ON a.vec_id = s.vec_id JOIN n b ON b.vec_id = s.centre)"
    " SELECT t.vec_id AS vec_id, CASE WHEN sim >= 0.2 THEN label END AS label FROM t JOIN seeds ON seeds.vec_id = t.centre WHERE k = 1 UNION ALL SELECT vec_id, label FROM seeds"
)
def grow_seeds(spark, sf):
    e = embeddings(spark, sf)
    return cluster.grow_seeds(e.withColumn("label", F.when(F.col("vec_id") % 10 == 0, F.col("label"))))


_STEP = ", f AS (SELECT label, min(vec_id) AS centre FROM c GROUP BY label), s AS (SELECT a.vec_id AS vec_id, f.label AS centre, sum(a.x*b.x) AS p, f.centre AS cv FROM c a JOIN c b ON a.dim = b.dim JOIN f ON f.centre = b.vec_id GROUP BY 1, 2, 4), t AS (SELECT s.vec_id AS vec_id, s.centre AS centre, row_number() OVER (PARTITION BY s.vec_id ORDER BY p/a.n/b.n DESC, s.centre) AS k FROM s JOIN n a ON a.vec_id = s.vec_id JOIN n b ON b.vec_id = s.cv) "


@query(_SIMS + _STEP + "SELECT vec_id, centre FROM t WHERE k = 1")
def kmeans_step(spark, sf):
    e = embeddings(spark, sf)
    first = e.groupBy(F.col("label").alias("centre")).agg(F.min_by("v", "vec_id").alias("cv"))
    return cluster.nearest(e, first).select("vec_id", "centre")


for _how, _agg in (("average", "avg"), ("furthest", "min"), ("nearest", "max")):

    @query(
        _SIMS
        + f", s AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS c1, b.label AS c2, sum(a.x*b.x) AS p FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2, 3, 4) SELECT c1, c2, round({_agg}(p/a.n/b.n), 5) + 0.0 AS sim FROM s JOIN n a ON a.vec_id = i JOIN n b ON b.vec_id = j GROUP BY c1, c2",
        f"linkage_{_how}",
    )
    def _linkage(spark, sf, how=_how):
        return cluster.linkage(_labelled(spark, sf), how).select("c1", "c2", tidy("sim", 5).alias("sim"))


@query()
def kmeans(spark, sf):
    return cluster.run(embeddings(spark, sf), "method=kmeans:k=10:iterations=5")


@query()
def kmedoids(spark, sf):
    return cluster.run(embeddings(spark, sf), "method=kmedoids:k=10:iterations=3")


@query()
def leader_clusters(spark, sf):
    return cluster.run(embeddings(spark, sf), "method=incr:k=10:threshold=0.3")


@query()
def brown_clusters(spark, sf):
    return cluster.agglomerate(embeddings(spark, sf).select("vec_id", "v"), cluster.Options(k=10, threshold=-1.0)).select("vec_id", "cluster", "path")


_UNIT = "u AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(
    f"WITH RECURSIVE {_UNIT}, near AS MATERIALIZED (SELECT a.vec_id AS vec_id, b.vec_id AS other FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.65),"
    " core AS MATERIALIZED (SELECT vec_id FROM near GROUP BY vec_id HAVING count(*) + 1 >= 3),"
    " link AS MATERIALIZED (SELECT vec_id, other FROM near WHERE vec_id IN (FROM core) AND other IN (FROM core)),"
    " reach AS (SELECT vec_id AS a, vec_id AS b FROM core UNION SELECT a, other FROM reach JOIN link ON b = vec_id),"
    " label AS (SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a), border AS (SELECT n.vec_id AS vec_id, min(cluster) AS reach FROM near n JOIN label l ON l.vec_id = n.other GROUP BY n.vec_id)"
    " SELECT u.vec_id AS vec_id, coalesce(cluster, reach) AS cluster FROM u LEFT JOIN label USING (vec_id) LEFT JOIN border USING (vec_id)"
)
def dbscan_clusters(spark, sf):
    return cluster.run(embeddings(spark, sf), "method=dbscan:epsilon=0.65:min_points=3")


@query(
    f"WITH {_UNIT}, s AS (SELECT a.vec_id AS q, b.vec_id AS o, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank FROM u a JOIN u b ON a.vec_id <> b.vec_id),"
    " k AS MATERIALIZED (SELECT q, o FROM s WHERE rank <= 5)"
    " SELECT m.q AS a, m.o AS b, (SELECT count(*) FROM k x JOIN k y ON x.o = y.o WHERE x.q = m.q AND y.q = m.o) AS shared FROM k m JOIN k r ON r.q = m.o AND r.o = m.q WHERE m.q < m.o"
)
def shared_neighbours(spark, sf):
    return cluster.shared_neighbours(embeddings(spark, sf), 5).select("a", "b", long("shared").alias("shared"))


@query("WITH a AS (SELECT vec_id, label AS c1, vec_id % 7 AS c2 FROM embeddings) SELECT CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, count(*) AS \"both\", (max(n1) + max(n2) - count(*))::BIGINT AS either FROM a JOIN (SELECT c1, count(*) AS n1 FROM a GROUP BY c1) USING (c1) JOIN (SELECT c2, count(*) AS n2 FROM a GROUP BY c2) USING (c2) GROUP BY c1, c2")
def membership_overlap(spark, sf):
    one = _labelled(spark, sf)
    return cluster.membership_overlap(one, one.select("vec_id", (F.col("vec_id") % 7).alias("cluster")))


@query("SELECT DISTINCT CAST(label AS BIGINT) AS label, '<CL_' || lpad(CAST(label AS VARCHAR), 4, '0') || '>' AS name, true AS generated FROM embeddings")
def generated_labels(spark, sf):
    rows = embeddings(spark, sf).select("label").distinct().withColumn("name", cluster.generated_label(F.col("label")))
    return rows.withColumn("generated", cluster.is_generated(F.col("name")))


# ---- text ----


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


_WS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\f]+'), lambda x: x <> '')"
_TOK = f"WITH w AS (SELECT doc_id, {_WS} AS words FROM documents), tok AS (SELECT doc_id, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS word FROM w) "


@query(f"SELECT doc_id, len({_WS})::BIGINT AS n_words, md5(array_to_string({_WS}, ' ')) AS digest FROM documents")
def tok_whitespace(spark, sf):
    words = tokenize.whitespace(F.col("text"))
    return docs(spark, sf).select("doc_id", long(F.size(words)).alias("n_words"), F.md5(tokenize.joined(words)).alias("digest"))


@query("WITH f AS (SELECT doc_id, string_split(text, '.') AS f FROM documents), g AS (SELECT doc_id, f, list_filter(f, lambda x, i: x <> '' OR (i = 1 AND len(f) > 1)) AS g FROM f) SELECT doc_id, len(g)::BIGINT AS n_fields, md5(array_to_string(g, '|')) AS digest FROM g")
def tok_delimiter(spark, sf):
    words = tokenize.delimited(F.col("text"), ".")
    return docs(spark, sf).select("doc_id", long(F.size(words)).alias("n_fields"), F.md5(tokenize.joined(words, "|")).alias("digest"))


@query("SELECT c_custkey, replace(c_name, 'Customer', 'a,b') AS f1, c_mktsegment AS f2, 3::BIGINT AS n FROM customer")
def tok_csv(spark, sf):
    line = F.concat(F.lit('"'), F.replace("c_name", F.lit("Customer"), F.lit("a,b")), F.lit('",'), F.col("c_mktsegment"), F.lit(","))
    rows = table(spark, sf, "customer").select("c_custkey", tokenize.csv(line).alias("f"))
    return rows.select("c_custkey", F.get("f", F.lit(0)).alias("f1"), F.get("f", F.lit(1)).alias("f2"), long(F.size("f")).alias("n"))


@query()
def tok_english(spark, sf):
    rows = docs(spark, sf).select("doc_id", tokenize.english(F.col("text")).alias("words"))
    return rows.select("doc_id", long(F.size("words")).alias("n_words"), F.md5(tokenize.joined("words")).alias("digest"))


@query()
def canonical_sentence(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tokenize.canonical(F.col("text"), upper=True, delimiter="_")).alias("digest"))


@query("SELECT p_partkey, len(string_split(p_name, ' '))::BIGINT AS n FROM part")
def word_list(spark, sf):
    return table(spark, sf, "part").select("p_partkey", long(F.size(tokenize.word_list(F.col("p_name")))).alias("n"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END::BIGINT AS n FROM documents")
def count_words(spark, sf):
    return docs(spark, sf).select("doc_id", long(T.count_words(F.col("text"))).alias("n"))


@query("SELECT item_id, trim('  ' || text || chr(9) || chr(10), ' ' || chr(9) || chr(10)) AS trimmed FROM benchmark")
def trim(spark, sf):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit("\t\n"))
    return table(spark, sf, "benchmark").select("item_id", T.trim(padded).alias("trimmed"))


@query("SELECT doc_id, md5(lower(text)) AS low FROM documents")
def lower(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(F.lower("text")).alias("low"))


@query("SELECT p_partkey, upper(p_name) AS up, left(p_name, 5) AS head, lower(p_name) AS low FROM part")
def upper_and_prefix(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("up"), F.left("p_name", F.lit(5)).alias("head"), F.lower("p_name").alias("low"))


@query(_TOK + r"SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(word, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]*)$')) AS numbers, count(*) FILTER (WHERE regexp_matches(word, '^[!-/:-@\[-`{-~]$')) AS puncts FROM tok")
def is_number_and_punct(spark, sf):
    w = F.col("word")
    return corpus.tokens(docs(spark, sf)).agg(F.count("*").alias("n"), F.count_if(T.is_number(w)).alias("numbers"), F.count_if(T.is_punct(w)).alias("puncts"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS as_long, CASE WHEN l_partkey <= 255 THEN CAST(l_partkey AS BIGINT) END AS as_byte, round(l_discount, 2) + 0.0 AS as_double FROM lineitem")
def string_conversions(spark, sf):
    s = F.col("l_partkey").cast("string")
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", long(T.to_int(s, 64)).alias("as_long"), long(T.to_int(s, 8, signed=False)).alias("as_byte"), tidy(T.to_double(F.col("l_discount").cast("string")), 2).alias("as_double"))


@query("SELECT o_orderkey, bit_count(o_orderkey)::BIGINT AS ones, CAST('0b' || reverse(lpad(bin(o_orderkey), 32, '0')) AS BIGINT) AS reversed FROM orders".replace("CAST('0b' || reverse(lpad(bin(o_orderkey), 32, '0')) AS BIGINT)", "list_sum(list_transform(range(0, 32), lambda i: ((o_orderkey >> i) & 1) << (31 - i)))::BIGINT"))
def bit_functions(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", long(T.popcount(k)).alias("ones"), T.reverse_bits(k, 32).alias("reversed"))


@query("SELECT doc_id, ascii(substr(text, 1, 1))::BIGINT AS code, chr(ascii(substr(text, 1, 1))) AS ch, strlen(text)::BIGINT AS size FROM documents WHERE text <> ''")
def code_points(spark, sf):
    code = T.code_point(F.col("text"))
    rows = docs(spark, sf).filter("text <> ''")
    return rows.select("doc_id", long(code).alias("code"), T.from_code_point(code).alias("ch"), long(T.utf8_size(F.col("text"))).alias("size"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir FROM pages")
def file_parts(spark, sf):
    p = T.file_parts(F.col("url"))
    name = F.when(p["ext"] == "", p["base"]).otherwise(F.concat_ws(".", p["base"], p["ext"]))
    whole = F.when(F.col("url").endswith("."), F.concat(name, F.lit("."))).otherwise(name)
    return table(spark, sf, "pages").select("page_id", whole.alias("name"), p["dir"].alias("dir"))


@query()
def romanized(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(romanize.romanize(F.col("text"))).alias("digest"))


# ---- corpora ----


@query(_TOK + ", f AS (SELECT word, count(*) AS freq, min(doc_id * 1000000000 + pos) AS first FROM tok GROUP BY word) SELECT word, freq, row_number() OVER (ORDER BY first) - 1 AS id FROM f")
def vocab_ids(spark, sf):
    return corpus.vocabulary_ids(corpus.tokens(docs(spark, sf))).select("word", "freq", "id")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), t AS (SELECT unnest(list_append(" + _WS + ", '<eol>')) AS word FROM l) SELECT word, count(*) AS freq FROM t GROUP BY word")
def term_freq(spark, sf):
    return corpus.term_frequency(corpus.line_tokens(docs(spark, sf)))


@query(_TOK + "SELECT p.w AS word, (SELECT count(*) FROM tok WHERE word = p.w)::BIGINT AS freq FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) p".replace("(SELECT count(*) FROM tok WHERE word = p.w)", "coalesce((SELECT count(*) FROM tok WHERE word = p.w), 0)"))
def freq_lookup(spark, sf):
    words = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return corpus.lookup_frequency(words, corpus.vocabulary(corpus.tokens(docs(spark, sf))))


@query(_TOK + "SELECT count(*) AS corpus_size, count(DISTINCT word) AS vocab_size FROM tok")
def corpus_size(spark, sf):
    freq = corpus.term_frequency(corpus.tokens(docs(spark, sf)))
    return freq.agg(F.sum("freq").alias("corpus_size"), F.count("*").alias("vocab_size"))


def _gram_sql(n: int, least: int = 1, words: str = "words") -> str:
    return (
        f"WITH w AS (SELECT {'list_reverse(' + _WS + ')' if words != 'words' else _WS} AS words FROM documents), g AS (SELECT unnest(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) AS ngram FROM w WHERE len(words) >= {n}) "
        f"SELECT CAST({n} AS BIGINT) AS n, ngram, count(*) AS freq FROM g GROUP BY ngram HAVING count(*) >= {least}"
    )


for _n in (1, 2, 3):

    @query(_gram_sql(_n), f"ngram_{_n}")
    def _ngrams(spark, sf, n=_n):
        return corpus.ngrams(docs(spark, sf), n).select(long("n").alias("n"), "ngram", "freq")


@query(_gram_sql(2, 5))
def ngram_minfreq(spark, sf):
    return corpus.ngrams(docs(spark, sf), 2, least=5).select(long("n").alias("n"), "ngram", "freq")


@query(_gram_sql(2, 1, "reverse"))
def ngram_reverse(spark, sf):
    return corpus.ngrams(docs(spark, sf), 2, reverse=True).select(long("n").alias("n"), "ngram", "freq")


@query(
    "WITH w AS (SELECT doc_id, " + _WS + " AS words FROM documents), g AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM w),"
    " p AS (SELECT unnest(['MIT License.', 'GNU General Public License,', 'the Apache License,']) AS phrase)"
    " SELECT phrase, doc_id, CAST(i - 1 AS BIGINT) AS pos FROM g JOIN p ON array_to_string(words[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase"
)
def phrase_lookup(spark, sf):
    found = corpus.find_phrases(docs(spark, sf), ["MIT License.", "GNU General Public License,", "the Apache License,"])
    return found.select("phrase", "doc_id", long("pos").alias("pos"))


@query(_TOK + ", f AS (SELECT word, count(*) AS freq FROM tok GROUP BY word) SELECT CASE WHEN freq < 5 THEN '<rare>' ELSE word END AS context, sum(freq)::BIGINT AS n FROM f GROUP BY 1")
def rare_fold(spark, sf):
    return corpus.fold(corpus.tokens(docs(spark, sf)), rare=5).groupBy("context").agg(F.count("*").alias("n"))


_NUM = r"regexp_matches(word, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]*)$')"


@query(_TOK + f"SELECT CASE WHEN {_NUM} THEN '<number>' ELSE word END AS context, count(*) AS n FROM tok GROUP BY 1")
def number_fold(spark, sf):
    return corpus.fold(corpus.tokens(docs(spark, sf)), numbers=True).groupBy("context").agg(F.count("*").alias("n"))


@query(
    _TOK + f", f AS (SELECT word, count(*) AS freq FROM tok GROUP BY word), k AS (SELECT unnest(['the', 'la', 'der', 'el']) AS word, 'ARTICLE' AS class)"
    f" SELECT coalesce(class, CASE WHEN {_NUM} THEN '<number>' WHEN freq < 5 THEN '<rare>' ELSE word END) AS context, sum(freq)::BIGINT AS n FROM f LEFT JOIN k USING (word) GROUP BY 1"
)
def ctx_equiv(spark, sf):
    classes = spark.createDataFrame([(w, "ARTICLE") for w in ("the", "la", "der", "el")], "word string, class string")
    return corpus.fold(corpus.tokens(docs(spark, sf)), 5, True, classes).groupBy("context").agg(F.count("*").alias("n"))


@query(_TOK + "SELECT word, count(*) AS freq, CASE WHEN word IN (SELECT DISTINCT substr(lower(n_name), 1, 2) FROM nation) THEN 4 ELSE 0 END::BIGINT AS attrs FROM tok GROUP BY word")
def attr_semi(spark, sf):
    marks = table(spark, sf, "nation").select(F.substring(F.lower("n_name"), 1, 2).alias("word"))
    return corpus.with_attributes(corpus.vocabulary(corpus.tokens(docs(spark, sf))), marks, 2).select("word", "freq", "attrs")


@query(
    _TOK + ", c AS (SELECT word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS l1, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS r1 FROM tok)"
    " SELECT word, count(l1) AS n_left, count(r1) AS n_right, count(DISTINCT l1) AS d_left, count(DISTINCT r1) AS d_right FROM c GROUP BY word"
)
def ctx_position(spark, sf):
    # A word without neighbours keeps its null contexts, so every word is there.
    around = corpus.neighbour_counts(docs(spark, sf), 1, 1)
    at = lambda o: (F.col("offset") == o) & F.col("context").isNotNull()
    return around.groupBy("word").agg(
        *[F.coalesce(F.sum(F.when(at(o), F.col("n"))), F.lit(0)).alias(f"n_{s}") for o, s in ((-1, "left"), (1, "right"))],
        *[F.count_if(at(o)).alias(f"d_{s}") for o, s in ((-1, "left"), (1, "right"))],
    )


@query(
    _TOK + ", c AS (SELECT a.word AS word, b.word AS context FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos), v AS (SELECT word, context, count(*) AS w FROM c GROUP BY 1, 2)"
    " SELECT word, count(*) AS dims, sum(w)::BIGINT AS total, round(sqrt(sum(w*w)), 5) + 0.0 AS norm FROM v GROUP BY word"
)
def ctx_vector(spark, sf):
    v = corpus.context_vectors(docs(spark, sf), 2, 2)
    return v.groupBy("word").agg(F.count("*").alias("dims"), long(F.sum("weight")).alias("total"), tidy(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 5).alias("norm"))


@query()
def ctx_random_index(spark, sf):
    v = corpus.indexed_vectors(docs(spark, sf), 2, 2, 256)
    return v.groupBy("word").agg(F.count("*").alias("dims"), long(F.sum(F.abs("weight"))).alias("total"))


@query("WITH t AS (SELECT vec_id * 10 + (vec_id % 5) AS x, CAST(vec_id AS BIGINT) AS w FROM embeddings) SELECT w, CAST(w % 4 + CASE WHEN w % 4 >= 2 THEN 1 ELSE 0 END - 2 AS BIGINT) AS o, CAST(w * 4 + w % 4 AS BIGINT) AS pid, w AS back FROM t")
def positional_ids(spark, sf):
    w = embeddings(spark, sf).select(F.col("vec_id").alias("w"))
    o = F.pmod("w", F.lit(4)) - 2
    rows = w.withColumn("o", o + (o >= 0).cast("bigint"))
    rows = rows.withColumn("pid", corpus.positional_id(F.col("w"), F.col("o"), 2, 2))
    offset = corpus.positional_offset(F.col("pid"), 2, 2)
    return rows.filter(offset == F.col("o")).select("w", long("o").alias("o"), long("pid").alias("pid"), long(corpus.positional_word(F.col("pid"), 2, 2)).alias("back"))


@query(_gram_sql(2).replace("SELECT CAST(2 AS BIGINT) AS n, ngram, count(*) AS freq FROM g GROUP BY ngram HAVING count(*) >= 1", ", f AS (SELECT count(*) AS freq FROM g GROUP BY ngram) SELECT freq, count(*) AS ngrams FROM f GROUP BY freq"))
def lm_counts_of_counts(spark, sf):
    return corpus.counts_of_counts(docs(spark, sf), 2)


@query(
    _gram_sql(2).replace(
        "SELECT CAST(2 AS BIGINT) AS n, ngram, count(*) AS freq FROM g GROUP BY ngram HAVING count(*) >= 1",
        ", f AS (SELECT split_part(ngram, ' ', 1) AS w1, split_part(ngram, ' ', 2) AS w2, count(*) AS freq FROM g GROUP BY ngram), b AS (SELECT w2, count(*) AS b FROM f GROUP BY w2), a AS (SELECT w1, count(*) AS a, sum(freq) AS t FROM f GROUP BY w1)"
        " SELECT w1, w2, round(greatest(freq - 0.75, 0) / t + 0.75 * a / t * b / (SELECT count(*) FROM f), 8) + 0.0 AS prob FROM f JOIN a USING (w1) JOIN b USING (w2)",
    )
)
def lm_kneser_ney(spark, sf):
    return corpus.kneser_ney(docs(spark, sf)).select("w1", "w2", tidy("prob", 8).alias("prob"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) SELECT doc_id, md5(array_to_string(flatten(list_transform(lines, lambda text: list_append(" + _WS + ", '<eol>'))), ' ')) AS digest FROM l")
def running_text(spark, sf):
    return corpus.running_text(docs(spark, sf)).select("doc_id", F.md5("line").alias("digest"))


@query(_TOK + ", s AS (SELECT tok.doc_id AS doc_id, pos, w.words[pos + 1:pos + 3] AS key FROM tok JOIN w ON w.doc_id = tok.doc_id) SELECT doc_id, CAST(pos AS BIGINT) AS pos, array_to_string(key, ' ') AS suffix FROM s")
def suffix_dump(spark, sf):
    return corpus.suffixes(docs(spark, sf), 3).select("doc_id", long("pos").alias("pos"), "suffix")


@query(_TOK + "SELECT count(*) || chr(9) || word AS value FROM tok GROUP BY word")
def vocab_dump(spark, sf):
    return io.vocabulary_lines(corpus.vocabulary(corpus.tokens(docs(spark, sf))))


# ---- collections and relations ----


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1, 2")
def hash_count(spark, sf):
    rows = table(spark, sf, "orders")
    key = ["o_orderpriority", "o_orderstatus"]
    return relations.add_counts(rows, key).join(relations.add_counts(rows, key, F.col("o_totalprice"), "total"), key).select(*key, "n", tidy("total", 2).alias("total"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def count_items(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def hash_lookup(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return relations.probe(table(spark, sf, "lineitem"), parts, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relations.contained(table(spark, sf, "customer"), o, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relations.removed(table(spark, sf, "customer"), o, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def assoc_lookup(spark, sf):
    # region is a list of five pairs
    pairs_ = table(spark, sf, "region").agg(F.collect_list(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))).alias("pairs"))
    return table(spark, sf, "nation").crossJoin(F.broadcast(pairs_)).select("n_nationkey", collections.assoc(F.col("pairs"), F.col("n_regionkey")).alias("r_name"))


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_wins(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return relations.first_wins(rows, "o_custkey", ["o_orderkey"])


@query("SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_global(spark, sf):
    return relations.top(table(spark, sf, "orders"), 20, [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", tidy("o_totalprice", 2).alias("price"))


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def topk_group(spark, sf):
    found = relations.top_by_group(table(spark, sf, "customer"), ["c_nationkey"], 3, [F.desc("c_acctbal"), F.col("c_custkey")])
    return found.select("c_nationkey", "c_custkey", long("rank").alias("rank"))


@query("SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':0'), event_id LIMIT 100")
def sample_n(spark, sf):
    return relations.sample(table(spark, sf, "events"), "event_id", 100).select("event_id")


@query("SELECT event_id FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':0'), 1, 8) AS BIGINT) < 429496729")
def sample_fraction(spark, sf):
    return relations.sample_share(table(spark, sf, "events"), "event_id", 0.1).select("event_id")


def _order_lines(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return rows.select("l_orderkey", F.transform("a", lambda x: x["l_partkey"]).alias("a"))


_LINES = "WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY l_orderkey) "
_J = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(_LINES + "SELECT l_orderkey, array_to_string(a[2:3], ',') AS sliced, array_to_string(list_concat(a[1:1], a[3:]), ',') AS elided, a[1] AS first, a[len(a)] AS last, array_to_string(list_reverse(a), ',') AS rev FROM a")
def slice(spark, sf):  # noqa: A001
    a = F.col("a")
    return _order_lines(spark, sf).select(
        "l_orderkey",
        _J(collections.subsequence(a, 1, 3)).alias("sliced"),
        _J(collections.elide(a, 1, 2)).alias("elided"),
        collections.nth(a, 0).alias("first"),
        collections.last(a).alias("last"),
        _J(F.reverse(a)).alias("rev"),
    )


@query(_LINES + "SELECT l_orderkey, array_to_string(list_sort(a), ',') AS sorted, list_contains(a, 1) AS has_one, len(list_filter(a, lambda x: x % 2 = 0))::BIGINT AS evens, array_to_string(list_filter(a, lambda x: x % 2 <> 0), ',') AS odds, array_to_string(list_resize(a, 3, 0), ',') AS three FROM a")
def array_ops(spark, sf):
    a = F.col("a")
    return _order_lines(spark, sf).select(
        "l_orderkey",
        _J(F.array_sort(a)).alias("sorted"),
        collections.member(a, F.lit(1).cast("bigint")).alias("has_one"),
        long(F.size(collections.keep_if(a, lambda x: x % 2 == 0))).alias("evens"),
        _J(collections.remove_if(a, lambda x: x % 2 == 0)).alias("odds"),
        _J(collections.resize(a, 3, 0)).alias("three"),
    )


@query("WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT k FROM a INTERSECT SELECT k FROM b")
def set_intersect(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return rows.filter("l_returnflag = 'R'").select("k").intersect(rows.filter("l_returnflag = 'A'").select("k"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set_union(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "region").select("r_name")).distinct()


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem")
def set_except(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf, "lineitem").select("l_partkey"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionAll(table(spark, sf, "supplier").select("s_suppkey", "s_name"))


@query("SELECT n_name AS subject, r_name AS object, false AS inverse FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name, true FROM nation JOIN region ON n_regionkey = r_regionkey")
def symbol_relation(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return relations.inverse_relation(n.join(r, n["n_regionkey"] == r["r_regionkey"]), "n_name", "r_name")


@query("SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT DISTINCT p_type AS name FROM part)")
def symbol_table(spark, sf):
    return io.symbols(table(spark, sf, "part"), "p_type").select("id", "name")


@query("SELECT n_nationkey, 'sym' || n_nationkey AS symbol, '011' AS bits FROM nation")
def symbols_and_bits(spark, sf):
    bits = collections.set_bit(collections.bits(F.lit("010")), 2, True)
    text = F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), "")
    return table(spark, sf, "nation").select("n_nationkey", collections.generated_symbol("sym", F.col("n_nationkey")).alias("symbol"), text.alias("bits"))


# ---- sources ----


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", io.from_json(F.col("props"), "k bigint")["k"].alias("k"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS json FROM nation""")
def json_write(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", io.to_json(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("json"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS value FROM l) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5(value) AS digest FROM n WHERE line_no % 2 = 0")
def line_pairs(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return io.mono_lines(rows, 1).select("doc_id", long("line_no").alias("line_no"), F.md5("value").alias("digest"))


@query("SELECT o_orderkey, list_sum(list_transform(range(0, 4), lambda i: (o_orderkey >> (8*i)) & 255))::BIGINT AS bytes, CAST(o_orderkey AS BIGINT) AS value FROM orders")
def fixed_width_ints(spark, sf):
    big = F.unhex(F.lpad(F.hex("o_orderkey"), 8, "0"))
    total = F.aggregate(io.fixed_ints(big, 8), F.lit(0).cast("decimal(20,0)"), lambda s, x: (s + x).cast("decimal(20,0)"))
    return table(spark, sf, "orders").select("o_orderkey", long(total).alias("bytes"), long(F.get(io.fixed_ints(big, 32, little=False), F.lit(0))).alias("value"))


# ---- alignment, tries, graphs, streams ----


def _name_pairs(spark, sf):
    n = table(spark, sf, "nation").select(F.lower("n_name").alias("w"))
    return n.select(F.col("w").alias("w1")).join(n.select(F.col("w").alias("w2")), F.col("w1") < F.col("w2"))


#: The longest common subsequence by diagonals of the alignment table; d1 and d2 are the two before, by letters of w1.
_LCS = (
    "WITH RECURSIVE n AS (SELECT lower(n_name) AS w FROM nation), p AS (SELECT a.w AS w1, b.w AS w2 FROM n a JOIN n b ON a.w < b.w),"
    " d AS (SELECT w1, w2, 0 AS k, list_transform(range(0, length(w1) + 1), lambda i: 0) AS d1, list_transform(range(0, length(w1) + 1), lambda i: 0) AS d2 FROM p"
    " UNION ALL SELECT w1, w2, k + 1, list_transform(range(0, length(w1) + 1), lambda i: CASE WHEN i = 0 OR k + 1 - i <= 0 OR k + 1 - i > length(w2) THEN CASE WHEN i > 0 AND k + 1 - i > length(w2) THEN d1[i] ELSE 0 END"
    " ELSE greatest(d1[i], d1[i + 1], d2[i] + CASE WHEN substr(w1, i::INT, 1) = substr(w2, (k + 1 - i)::INT, 1) THEN 1 ELSE 0 END) END), d1 FROM d WHERE k < length(w1) + length(w2))"
    " SELECT w1, w2, round(d1[length(w1) + 1] / greatest(length(w1), length(w2)), 6) + 0.0 AS score FROM d WHERE k = length(w1) + length(w2)"
)


@query(_LCS)
def cognate_exact(spark, sf):
    return _name_pairs(spark, sf).select("w1", "w2", tidy(cognate.cognate_score(F.col("w1"), F.col("w2"))).alias("score"))


@query()
def cognate_weighted(spark, sf):
    costs = cognate.Costs().adjacent_keys("qwerty", 0.4, 0.2).doublings("aeioulnrst", 0.9).transpositions("aeiou", 1.5)
    return _name_pairs(spark, sf).select("w1", "w2", tidy(cognate.cognate_score(F.col("w1"), F.col("w2"), costs, "average")).alias("score"))


@query()
def spelling(spark, sf):
    """Every hundredth word of the vocabulary, in first-seen order, against all words."""
    vocab = materialize(corpus.vocabulary_ids(corpus.tokens(docs(spark, sf))).select("id", "word"), "vocabulary")
    words = vocab.filter(F.col("id") % 100 == 0).select("word")
    return cognate.suggestions(words, vocab).select("word", "suggestion", tidy("score").alias("score"), long("rank").alias("rank"))


@query("WITH n AS (SELECT lower(n_name) AS w FROM nation) SELECT a.w AS w1, b.w AS w2, round(jaro_similarity(a.w, b.w), 6) + 0.0 AS value FROM n a JOIN n b ON a.w < b.w")
def str_jaro(spark, sf):
    return _name_pairs(spark, sf).select("w1", "w2", tidy(strings.jaro(F.col("w1"), F.col("w2"))).alias("value"))


@query(
    "WITH n AS (SELECT lower(n_name) AS w FROM nation), p AS (SELECT a.w AS w1, b.w AS w2, jaro_similarity(a.w, b.w) AS j FROM n a JOIN n b ON a.w < b.w)"
    " SELECT w1, w2, round(j + 0.1*(1 - j)*(CASE WHEN left(w1, 4) = left(w2, 4) AND length(w1) >= 4 AND length(w2) >= 4 THEN 4 WHEN left(w1, 3) = left(w2, 3) THEN 3 WHEN left(w1, 2) = left(w2, 2) THEN 2 WHEN left(w1, 1) = left(w2, 1) THEN 1 ELSE 0 END), 6) + 0.0 AS value FROM p"
)
def str_jaro_winkler(spark, sf):
    return _name_pairs(spark, sf).select("w1", "w2", tidy(strings.jaro_winkler(F.col("w1"), F.col("w2"))).alias("value"))


_KEYS = "WITH k AS (SELECT DISTINCT p_name AS key FROM part), p AS (SELECT key, unnest(list_transform(range(1, length(key) + 1), lambda i: left(key, i))) AS prefix FROM k) "


def _keys(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("key"))


@query(_KEYS + "SELECT prefix, count(*) AS keys FROM p GROUP BY prefix")
def trie_prefix(spark, sf):
    return trie.nodes(_keys(spark, sf))


@query(_KEYS + "SELECT key FROM k WHERE key NOT IN (SELECT prefix FROM p WHERE prefix <> key)")
def trie_terminal(spark, sf):
    return trie.terminal(_keys(spark, sf))


@query(_KEYS + "SELECT prefix, key FROM p WHERE prefix IN (SELECT DISTINCT left(key, 6) FROM k)")
def trie_extensions(spark, sf):
    wanted = _keys(spark, sf).select(F.left("key", F.lit(6)).alias("prefix"))
    return trie.extensions(_keys(spark, sf), wanted)


@query(_KEYS + "SELECT DISTINCT left(prefix, length(prefix) - 1) AS prefix, right(prefix, 1) AS step, prefix AS node FROM p")
def trie_steps(spark, sf):
    return trie.steps(_keys(spark, sf))


def _nation_graph(spark, sf):
    rows = pairs(nation_profile(spark, sf))
    return rows.select(F.col("id1").alias("src"), F.col("id2").alias("dst"), tidy(measures.distance("manhattan", "v1", "v2")).alias("len"))


#: An edge is in the forest if the shorter ones, ties by their ends, do not join its ends already.
@query(
    _PAIR_SQL.replace("WITH v", "WITH RECURSIVE v", 1)
    + ", e AS (SELECT id1 AS src, id2 AS dst, round(sum(abs(x - y)), 6) + 0.0 AS len FROM p GROUP BY id1, id2), r AS MATERIALIZED (SELECT src, dst, len, row_number() OVER (ORDER BY len, src, dst) AS k FROM e),"
    " w AS MATERIALIZED (SELECT k, src AS a, dst AS b FROM r UNION ALL SELECT k, dst, src FROM r),"
    " reach AS (SELECT k, src AS v FROM r UNION SELECT reach.k, w.b FROM reach JOIN w ON w.a = reach.v AND w.k < reach.k)"
    " SELECT src, dst, len FROM r WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.k = r.k AND reach.v = r.dst)"
)
def mst(spark, sf):
    return graph.spanning_forest(_nation_graph(spark, sf))


@query(_PAIR_SQL + "SELECT id1 AS src, id2 AS dst, round(sum(abs(x - y)), 6) + 0.0 AS len FROM p WHERE id1 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND id2 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY id1, id2")
def subgraph(spark, sf):
    chosen = table(spark, sf, "nation").filter("n_regionkey = 1").select(long("n_nationkey").alias("v"))
    return graph.subgraph(_nation_graph(spark, sf), chosen).select("src", "dst", "len")


@query("SELECT CAST(n_regionkey AS BIGINT) AS \"row\", CAST(n_nationkey % 5 AS BIGINT) AS col, count(*)::DOUBLE AS val FROM nation WHERE abs(n_regionkey - n_nationkey % 5) <= 1 GROUP BY 1, 2")
def matrix_band(spark, sf):
    cells = table(spark, sf, "nation").groupBy(long("n_regionkey").alias("row"), long(F.col("n_nationkey") % 5).alias("col")).agg(F.count("*").cast("double").alias("val"))
    return graph.matrix_cells(cells, "banded", 1)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return counts.event_counts(table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", tidy("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def user_sessions(spark, sf):
    return counts.sessions(table(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '') AS words FROM documents), g AS (SELECT unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' '))) AS ngram FROM w WHERE len(words) >= 2) SELECT ngram, count(*) AS freq FROM g GROUP BY ngram ORDER BY freq DESC, ngram LIMIT 20")
def top_bigrams(spark, sf):
    """The flagship: the twenty most frequent bigrams of all documents."""
    return relations.top(corpus.ngrams(docs(spark, sf), 2), 20, [F.desc("freq"), F.col("ngram")]).select("ngram", "freq")


# ---- representatives, seeds, term vectors, literals ----


@query(f"WITH c AS ({EMBEDDING_CELLS}), m AS (SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM c GROUP BY label) SELECT c.label AS cluster, round(sum(x) FILTER (WHERE vec_id = lo), 5) + 0.0 AS prototype, round(sum(x) FILTER (WHERE vec_id = hi), 5) + 0.0 AS newest FROM c JOIN m ON c.label = m.label GROUP BY c.label")
def representatives(spark, sf):
    rows = _labelled(spark, sf)
    first, final = (cluster.representatives(rows, k).select("cluster", tidy(_sum(F.col("v")), 5).alias(k)) for k in ("prototype", "newest"))
    return first.join(final, "cluster")


@query(
    f"WITH v AS ({PROFILE_SQL}), n AS (SELECT id, sqrt(sum(val*val)) AS n FROM v GROUP BY id), s AS (SELECT a.id AS i, b.id AS j, sum(a.val*b.val) AS p FROM v a JOIN v b ON a.dim = b.dim GROUP BY 1, 2)"
    " SELECT CAST(i % 5 AS BIGINT) AS cluster, j AS vec_id, round(avg(p/a.n/b.n), 6) + 0.0 AS mean, round(min(p/a.n/b.n), 6) + 0.0 AS furthest FROM s JOIN n a ON a.id = i JOIN n b ON b.id = j GROUP BY 1, 2"
)
def cluster_to_vector(spark, sf):
    rows = nation_profile(spark, sf).select(F.col("id").alias("vec_id"), "v").withColumn("cluster", F.col("vec_id") % 5)
    mean, far = (cluster.to_vectors(rows, rows, k).select("cluster", "vec_id", tidy("value").alias(n)) for k, n in (("average", "mean"), ("furthest", "furthest")))
    return mean.join(far, ["cluster", "vec_id"])


@query("SELECT count(*) FILTER (WHERE vec_id % 10 = 0) AS seeds, count(*) FILTER (WHERE vec_id % 10 <> 0) AS others FROM embeddings")
def separate_seeds(spark, sf):
    rows = embeddings(spark, sf).withColumn("label", F.when(F.col("vec_id") % 10 == 0, F.col("label")))
    seeds, others = cluster.separate_seeds(rows)
    return seeds.agg(F.count("*").alias("seeds")).crossJoin(others.agg(F.count("*").alias("others")))


@query("SELECT o_custkey AS key, CAST(p_size AS BIGINT) AS dim, round(sum(l_quantity * p_retailprice), 2) + 0.0 AS val FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def term_vector_sum(spark, sf):
    line, orders, part = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    bought = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("key"), F.col("l_partkey").alias("term"), F.col("l_quantity").alias("weight"))
    terms = part.select(F.col("p_partkey").alias("term"), long("p_size").alias("dim"), F.col("p_retailprice").alias("val"))
    return corpus.add_terms(bought, terms).select("key", "dim", tidy("val", 2).alias("val"))


@query("SELECT c_custkey, round(c_acctbal + 1000, 2) + 0.0 AS priority FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, round(c_acctbal, 2) + 0.0 FROM customer WHERE c_custkey % 7 <> 0 ORDER BY priority DESC, c_custkey LIMIT 25")
def requeue(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", tidy("c_acctbal", 2).alias("priority"))
    changes = rows.filter("c_custkey % 7 = 0").select("c_custkey", tidy(F.col("priority") + 1000, 2).alias("priority"))
    return relations.change_priority(rows, changes, "c_custkey", "priority", 25)


@query("SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS num, CAST(n_nationkey + 1 AS BIGINT) AS den, '[\"' || n_name || '\", ' || n_nationkey || ', [true, false]]' AS json FROM nation")
def literals(spark, sf):
    from textloom.functions import literals as reader

    rows = table(spark, sf, "nation")
    ratio = T.to_number(F.concat_ws("/", F.col("n_regionkey").cast("string"), (F.col("n_nationkey") + 1).cast("string")))
    text = F.concat(F.lit('("'), F.col("n_name"), F.lit('" '), F.col("n_nationkey").cast("string"), F.lit(" #*10)"))
    return rows.select("n_nationkey", ratio["num"].alias("num"), ratio["den"].alias("den"), reader.read_object(text).alias("json"))


@query("SELECT l_quantity AS q, CAST(l_quantity AS BIGINT)::VARCHAR AS text, count(*) AS n FROM lineitem GROUP BY 1, 2")
def number_format(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), T.format_number(F.col("l_quantity")).alias("text"))
    return rows.groupBy("q", "text").agg(F.count("*").alias("n"))


_BIGRAMS = _gram_sql(2).replace(
    "SELECT CAST(2 AS BIGINT) AS n, ngram, count(*) AS freq FROM g GROUP BY ngram HAVING count(*) >= 1",
    ", f AS (SELECT split_part(ngram, ' ', 1) AS w1, split_part(ngram, ' ', 2) AS w2, count(*) AS freq FROM g GROUP BY ngram), b AS (SELECT w2, count(*) AS b FROM f GROUP BY w2), a AS (SELECT w1, count(*) AS a, sum(freq) AS t FROM f GROUP BY w1)",
)


@query(
    _BIGRAMS
    + ", m AS (SELECT w1, w2, greatest(freq - 0.75, 0) / t + 0.75 * a / t * b / (SELECT count(*) FROM f) AS prob FROM f JOIN a USING (w1) JOIN b USING (w2)),"
    " o AS (SELECT doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i:i + 1])) AS gram FROM (SELECT doc_id, " + _WS + " AS words FROM documents) WHERE len(words) >= 2)"
    " SELECT doc_id, count(*) AS bigrams, round(exp(-avg(ln(prob))), 4) + 0.0 AS perplexity FROM o JOIN m ON m.w1 = gram[1] AND m.w2 = gram[2] GROUP BY doc_id"
)
def lm_perplexity(spark, sf):
    d = docs(spark, sf)
    return corpus.perplexity(d, corpus.bigram_model(d)).select("doc_id", "bigrams", tidy("perplexity", 4).alias("perplexity"))


# ---- files: written to the shared folder and read back ----


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def _text_file(rows: DataFrame, value: Column, name: str, order: str | None = None, compression: str = "none") -> str:
    """The folder of a text table; with an order one file (for small tables whose lines are numbered)."""
    path = scratch(rows.sparkSession, name)
    lines = rows.select(value.alias("value")) if order is None else rows.repartition(1).sortWithinPartitions(order).select(value.alias("value"))
    io.write_lines(lines, path, compression)
    return path


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1")
def text_lines(spark, sf):
    padded = F.concat(F.lit("  "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "\t").otherwise(" "))
    rows = table(spark, sf, "part")
    both = rows.select(padded.alias("value")).unionAll(rows.select(F.lit(" \t ").alias("value")))
    path = _text_file(both, F.col("value"), "lines", compression="gzip")
    return io.without_blank(io.trimmed(io.read_lines(spark, path))).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT upper(p_name) AS value, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def edited_lines(spark, sf):
    path = _text_file(table(spark, sf, "part"), F.concat_ws("\t", F.col("p_size").cast("string"), "p_name"), "edit")
    size = lambda c: F.split_part(c, F.lit("\t"), F.lit(1)).cast("int")
    lines = io.edited(io.read_lines(spark, path), lambda c: F.when(size(c) % 2 == 0, F.upper(F.split_part(c, F.lit("\t"), F.lit(2)))))
    return lines.groupBy("value").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation) SELECT CAST((n - 3) // 4 AS BIGINT) AS batch, string_agg(n_name, '|' ORDER BY n) AS lines FROM l WHERE n >= 3 GROUP BY 1")
def line_batches(spark, sf):
    path = _text_file(table(spark, sf, "nation"), F.col("n_name"), "batches", "n_nationkey")
    rows = io.skip_lines(io.numbered_lines(spark, path), 3).withColumn("line_no", F.col("line_no") - 3)
    return io.line_batches(rows, 4).select(long("batch").alias("batch"), F.array_join("lines", "|").alias("lines"))


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 3 <> 0")
def file_list(spark, sf):
    mark = F.when(F.col("n_nationkey") % 3 == 0, F.when(F.col("n_nationkey") % 2 == 0, ";").otherwise("# ")).otherwise(" ")
    path = _text_file(table(spark, sf, "nation"), F.concat(mark, "n_name"), "list")
    return spark.createDataFrame([(x,) for x in io.read_file_list(spark, path)], "name string")


@query("SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1")
def word_list_file(spark, sf):
    path = _text_file(table(spark, sf, "part"), F.concat(F.col("p_name"), F.lit(" ; a comment # "), "p_brand"), "words")
    return io.read_word_list(spark, path).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT lower(n_name) AS word, 'region' || n_regionkey AS class FROM nation")
def class_file(spark, sf):
    line = F.concat_ws("\t", F.concat(F.col("n_name"), F.lit(" ")), F.concat(F.lit(" region"), F.col("n_regionkey").cast("string")))
    path = _text_file(table(spark, sf, "nation").select(F.explode(F.array(line, F.lit("no class"))).alias("line")), F.col("line"), "classes")
    return io.read_classes(spark, path, lower=True)


@query(_TOK + "SELECT word, count(*) AS n, sum(pos)::BIGINT AS places, count(DISTINCT doc_id) AS docs FROM tok GROUP BY word")
def corpus_files(spark, sf):
    path = scratch(spark, "corpus")
    io.save_corpus(docs(spark, sf), path)
    toks, _ = io.load_corpus(spark, path)
    return toks.groupBy("word").agg(F.count("*").alias("n"), long(F.sum("pos")).alias("places"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT n_nationkey, n_name FROM nation")
def signed_table(spark, sf):
    path = scratch(spark, "signed")
    io.save_signed(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "nations", 3)
    return io.load_signed(spark, path, "nations", 2)


@query("SELECT r_regionkey, r_name, 'new' AS age FROM region UNION ALL SELECT n_nationkey, n_name, 'old' FROM nation")
def replaced_table(spark, sf):
    path = scratch(spark, "replaced")
    io.replace_table(table(spark, sf, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")), path)
    io.replace_table(table(spark, sf, "region").select("r_regionkey", "r_name"), path)
    new, old = spark.read.parquet(path), spark.read.parquet(path + ".bak")
    return new.withColumn("age", F.lit("new")).unionByName(old.withColumn("age", F.lit("old")))


@query(f"WITH c AS ({EMBEDDING_CELLS}), s AS (SELECT vec_id, round(sum(x), 4) + 0.0 AS total, count(*) FILTER (WHERE x > 0) AS positive FROM c GROUP BY vec_id) SELECT total, positive, count(*) AS n FROM s GROUP BY 1, 2")
def vector_files(spark, sf):
    e = embeddings(spark, sf)
    number = lambda x: x.cast("string")
    cells = F.filter(F.transform("v", lambda x, i: F.when(x > 0, F.concat_ws(":", i.cast("string"), number(x)))), lambda c: c.isNotNull())
    dense_path = _text_file(e, F.array_join(F.transform("v", number), " "), "dense")
    sparse_path = _text_file(e, F.array_join(cells, " "), "sparse")
    sums = io.read_vectors(spark, dense_path).select(tidy(_sum(F.col("v")), 4).alias("total"), long(F.size(F.filter("v", lambda x: x > 0))).alias("positive"))
    sizes = io.read_vectors(spark, sparse_path, sparse=True).select(long(F.size("v")).alias("positive"))
    # The sparse file must have as many vectors with so many cells as the dense one.
    same = sums.groupBy("positive").count().exceptAll(sizes.groupBy("positive").count()).agg((F.count("*") == 0).alias("same"))
    return sums.crossJoin(F.broadcast(same)).filter("same").groupBy("total", "positive").agg(F.count("*").alias("n"))  # same has one row


@query("SELECT 'region' || n_regionkey AS section, 'nation' || n_nationkey AS key, n_name AS value FROM nation")
def config_file(spark, sf):
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.format_string("nation%d = %s", "n_nationkey", "n_name"))).alias("lines"))
    text = nations.select(F.concat(F.lit("[region"), F.col("n_regionkey").cast("string"), F.lit("]\n"), F.array_join("lines", "\n")).alias("line")).repartition(1)
    path = scratch(spark, "config")
    io.write_lines(text.select(F.col("line").alias("value")), path)
    held = io.read_config(spark, path)
    return spark.createDataFrame([(a, k, v) for a, rows in held.items() for k, v in rows.items()], "section string, key string, value string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'a\tb\\n' || c_name AS value FROM customer".replace("\\n", "' || chr(10) || '"))
def map_file(spark, sf):
    path = scratch(spark, "map")
    io.save_map(table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("a\tb\n"), "c_name").alias("value")), path)
    return io.load_map(spark, path)


@query("SELECT 'src' || n_nationkey AS source, 'trg' || k AS target, CASE WHEN k = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM nation, (SELECT unnest([1, 2]) AS k)")
def cognate_file(spark, sf):
    line = F.format_string('("src%d" "trg1" 0.5 "trg2")', "n_nationkey")
    path = _text_file(table(spark, sf, "nation"), line, "cognates")
    return cognate.read_pairs(io.read_lines(spark, path)).select("source", "target", "score")


@query("SELECT count(*) AS files, true AS sized FROM (SELECT DISTINCT n_regionkey FROM nation)")
def file_facts(spark, sf):
    path = scratch(spark, "facts")
    table(spark, sf, "nation").select("n_regionkey", F.col("n_name").alias("value")).repartition(1).write.partitionBy("n_regionkey").text(path)
    facts = io.file_facts(spark, path + "/*/*.txt")
    return facts.agg(F.count("*").alias("files"), F.bool_and((F.col("size") > 0) & (F.col("ext") == "txt")).alias("sized"))


# ---- comparisons, list building, seeded numbers, matrices, merged clusters ----

_NEXT_LINES = _LINES + ", b AS (SELECT l_orderkey - 1 AS l_orderkey, a AS b FROM a) SELECT l_orderkey, "


@query(_NEXT_LINES + "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END::INT AS sign, a = b AS same FROM a JOIN b USING (l_orderkey)")
def compare_lists(spark, sf):
    a = _order_lines(spark, sf)
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("a").alias("b"))
    sign = collections.compare(F.col("a"), F.col("b"))
    return a.join(b, "l_orderkey").select("l_orderkey", sign.alias("sign"), (sign == 0).alias("same"))


@query(_LINES + "SELECT l_orderkey, array_to_string(list_append(list_prepend(0::BIGINT, a[:-2]), 9::BIGINT), ',') AS built, a[len(a)] AS item, list_sum(a)::BIGINT AS total FROM a")
def build_lists(spark, sf):
    a = F.transform("a", lambda x: x.cast("bigint"))
    p = collections.popped(collections.without_nulls(F.concat(a, F.array(F.lit(None).cast("bigint")))))
    built = collections.pushed(collections.prepended(p["rest"], F.lit(0).cast("bigint")), F.lit(9).cast("bigint"))
    return _order_lines(spark, sf).select("l_orderkey", _J(built).alias("built"), p["item"].alias("item"), long(F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("total"))


@query("SELECT o_orderkey, CASE WHEN b1 < b2 THEN -1 WHEN b1 > b2 THEN 1 ELSE 0 END::INT AS sign FROM (SELECT o_orderkey, bin(o_orderkey) AS b1, bin(o_custkey) AS b2 FROM orders)")
def compare_bits(spark, sf):
    one, two = (collections.bits(F.bin(c)) for c in ("o_orderkey", "o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", collections.compare(one, two).alias("sign"))


@query("SELECT n_nationkey, true AS same, CASE WHEN n_nationkey < n_regionkey THEN -1 WHEN n_nationkey > n_regionkey THEN 1 ELSE 0 END::INT AS sign, CASE WHEN n_name < 'NATION_2' THEN -1 WHEN n_name > 'NATION_2' THEN 1 ELSE 0 END::INT AS bytes FROM nation")
def compare_numbers(spark, sf):
    n, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    ratio = F.concat((F.col("n_nationkey") * 6).cast("string"), F.lit("/6"))
    same = T.same_number(n, F.concat(n, F.lit(".0"))) & T.same_number(ratio, n) & ~T.same_number(n, F.concat(n, F.lit(".5")))
    return table(spark, sf, "nation").select("n_nationkey", same.alias("same"), T.compare_numbers(ratio, r).alias("sign"), T.compare_bytes(F.col("n_name"), F.lit("NATION_2")).alias("bytes"))


_DRAW = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':5'), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"SELECT event_id, CAST(floor(10 + floor({_DRAW} * 90)) AS BIGINT) AS whole, round(-1 + {_DRAW} * 2, 6) + 0.0 AS part FROM events")
def random_numbers(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", T.random_int(k, 10, 100, 5).alias("whole"), tidy(T.random_float(k, -1.0, 1.0, 5)).alias("part"))


@query("WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey % 5 AS BIGINT) AS c, count(*)::DOUBLE AS val FROM nation GROUP BY 1, 2), s AS (SELECT least(r, c) AS r, greatest(r, c) AS c, arg_min(val, r > c) AS val FROM c GROUP BY 1, 2), w AS (SELECT a AS \"row\", b AS col FROM (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(0, 6)) AS b)) SELECT w.\"row\" AS \"row\", w.col AS col, coalesce(val, 0) AS val FROM w LEFT JOIN s ON s.r = least(w.\"row\", w.col) AND s.c = greatest(w.\"row\", w.col)")
def matrix_elements(spark, sf):
    cells = table(spark, sf, "nation").groupBy(long("n_regionkey").alias("row"), long(F.col("n_nationkey") % 5).alias("col")).agg(F.count("*").cast("double").alias("val"))
    wanted = spark.range(36).select(F.floor(F.col("id") / 6).alias("row"), (F.col("id") % 6).alias("col"))
    return graph.matrix_elements(cells, wanted, "symmetric").select("row", "col", "val")


for _how, _agg in (("average", "avg"), ("furthest", "max"), ("nearest", "min")):

    @query(
        _SIMS
        + f", s AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS c1, b.label AS c2, sum(a.x*b.x) AS p FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2, 3, 4) SELECT c1, c2, round({_agg}(1 - p/a.n/b.n), 5) + 0.0 AS dist FROM s JOIN n a ON a.vec_id = i JOIN n b ON b.vec_id = j GROUP BY c1, c2",
        f"linkage_distance_{_how}",
    )
    def _linkage_distance(spark, sf, how=_how):
        return cluster.linkage(_labelled(spark, sf), how, kind="distance").select("c1", "c2", tidy("dist", 5).alias("dist"))


@query(
    f"WITH c AS ({EMBEDDING_CELLS}), z AS (SELECT label, dim, sum(x) AS x FROM c GROUP BY label, dim), n AS (SELECT label, sqrt(sum(x*x)) AS n FROM z GROUP BY label)"
    " SELECT a.label AS c1, b.label AS c2, round(sum(a.x*b.x)/any_value(p.n)/any_value(q.n), 5) + 0.0 AS sim FROM z a JOIN z b ON a.dim = b.dim AND a.label < b.label JOIN n p ON p.label = a.label JOIN n q ON q.label = b.label GROUP BY 1, 2"
)
def representative_similarity(spark, sf):
    return cluster.representative_similarity(_labelled(spark, sf)).select("c1", "c2", tidy("sim", 5).alias("sim"))


@query("SELECT CASE WHEN label IN (3, 5) THEN 1 ELSE CAST(label AS BIGINT) END AS cluster, count(*) AS size FROM embeddings GROUP BY 1")
def merge_clusters(spark, sf):
    return cluster.merged(_labelled(spark, sf), 1, 3, 5).groupBy("cluster").agg(F.count("*").alias("size"))


@query("WITH g AS (SELECT CAST(label AS BIGINT) AS label, min(vec_id) AS f, count(*) AS size, string_agg(vec_id, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY 1) SELECT row_number() OVER (ORDER BY f) - 1 AS cluster, label, size, members FROM g")
def extract_clusters(spark, sf):
    return cluster.extract_clusters(embeddings(spark, sf).select("vec_id", "label")).select("cluster", "label", "size", _J("members").alias("members"))


@query(f"WITH c AS ({EMBEDDING_CELLS}) SELECT label AS cluster, CAST(dim - 1 AS BIGINT) AS dim, round(sum(x), 4) + 0.0 AS value FROM c GROUP BY label, dim")
def updated_representative(spark, sf):
    """Centroids of three quarters of the vectors, brought up to date with the rest."""
    rows = _labelled(spark, sf)
    old = cluster.centroids(rows.filter("vec_id % 4 <> 0"))
    now = cluster.updated_representative(old, rows.filter("vec_id % 4 = 0"))
    return now.select("cluster", F.posexplode("v").alias("dim", "x")).select("cluster", long("dim").alias("dim"), tidy("x", 4).alias("value"))


@query("SELECT n_nationkey, round((length(p) / greatest(length(n_name), length(o)))::DOUBLE, 6) + 0.0 AS share FROM (SELECT n_nationkey, n_name, 'NATION_' || ((n_nationkey + 10) % 25) AS o, (SELECT max(left(n_name, i)) FROM (SELECT unnest(range(0, 12)) AS i) WHERE left(n_name, i) = left('NATION_' || ((n_nationkey + 10) % 25), i) AND i <= least(length(n_name), length('NATION_' || ((n_nationkey + 10) % 25)))) AS p FROM nation)")
def cognate_prefix(spark, sf):
    other = F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 10) % 25).cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", tidy(cognate.prefix_score(F.col("n_name"), other)).alias("share"))


# ---- language models beyond bigrams ----

_GRAMS3 = (
    "WITH w AS (SELECT doc_id, " + _WS + " AS words FROM documents), g AS (SELECT doc_id, n, i, array_to_string(words[i - n + 1:i], ' ') AS ngram FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS n) WHERE i >= n),"
    " f AS (SELECT n, ngram, count(*) AS freq FROM g GROUP BY 1, 2 HAVING count(*) >= 2)"
)


@query(_GRAMS3 + " SELECT length, count(*) AS places FROM (SELECT doc_id, i, max(CASE WHEN f.freq IS NULL THEN 0 ELSE g.n END) AS length FROM g LEFT JOIN f ON f.n = g.n AND f.ngram = g.ngram GROUP BY 1, 2) GROUP BY length")
def lm_longest_match(spark, sf):
    d = docs(spark, sf)
    counts_ = materialize(corpus.ngrams(d, 1, 3).filter("freq >= 2"), "grams")
    return corpus.longest_match(d, counts_, 3).groupBy("length").agg(F.count("*").alias("places"))


@query(
    _GRAMS3
    + ", t AS (SELECT sum(freq) AS total FROM f WHERE n = 1), h AS (SELECT f.n AS n, f.ngram AS ngram, f.freq / coalesce(b.freq, total) AS share FROM f CROSS JOIN t LEFT JOIN f b ON f.n > 1 AND b.n = f.n - 1 AND b.ngram = regexp_replace(f.ngram, ' [^ ]*$', '')),"
    " m AS (SELECT doc_id, i, max(CASE WHEN h.share IS NULL THEN 0 ELSE g.n END) AS length, arg_max(h.share, g.n) FILTER (WHERE h.share IS NOT NULL) AS share FROM g LEFT JOIN h ON h.n = g.n AND h.ngram = g.ngram GROUP BY 1, 2)"
    " SELECT doc_id, round(avg(CASE WHEN length > 0 THEN share * pow(0.4, least(i, 3) - length) ELSE 0 END), 6) + 0.0 AS prob FROM m GROUP BY doc_id"
)
def lm_backoff(spark, sf):
    d = docs(spark, sf)
    counts_ = materialize(corpus.ngrams(d, 1, 3).filter("freq >= 2"), "grams")
    return corpus.backoff_probability(d, counts_, 3).groupBy("doc_id").agg(tidy(F.avg("prob")).alias("prob"))


@query(
    "WITH w AS (SELECT list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS words FROM documents), g AS (SELECT unnest(list_transform(range(1, len(words)), lambda i: words[i:i + 1])) AS gram FROM w WHERE len(words) >= 2)"
    " SELECT 2::BIGINT AS n, array_to_string(gram, ' ') AS ngram, count(*) AS freq FROM g WHERE gram[1] = gram[2] GROUP BY 2"
)
def ngram_callback(spark, sf):
    """Bigrams of one word twice, by a test and a tokenizer of the caller's."""
    found = corpus.filtered_ngrams(docs(spark, sf), 2, 2, lambda g: F.get(g, F.lit(0)) == F.get(g, F.lit(1)), lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != ""))
    return found.select(long("n").alias("n"), "ngram", "freq")


# The queries of the other modules of this folder are registered with these.
from textloom.plans import depth, scalars  # noqa: E402, F401
