"""Joins, orders, sets and graphs on the dimension tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import graph, joins, resolve, similarity
from glyphmill.plans.registry import query, table


@query(
    """WITH m AS (SELECT user_id, ts, event_id, event_type AS kind FROM events WHERE event_type IN ('signup', 'purchase')), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('signup', 'purchase'))
SELECT e.event_id, e.user_id, m.kind AS state FROM e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts"""
)
def speaker_asof(spark, d):
    events = table(spark, d, "events")
    sets = F.col("event_type").isin("signup", "purchase")
    right = events.where(sets).select("user_id", "ts", F.col("event_type").alias("state"))
    left = events.where(~sets).select("event_id", "user_id", "ts")
    return joins.asof(left, right, "user_id", "ts", "state").select("event_id", "user_id", "state")


@query(
    """WITH b AS (SELECT i AS band, i * 12500.0 AS lo, i * 12500.0 + 5000.0 AS hi FROM range(60) t(i)) SELECT o_orderkey, band FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi"""
)
def range_lookup(spark, d):
    bands = spark.range(60).select(F.col("id").alias("band"), (F.col("id") * 12500.0).alias("lo"), (F.col("id") * 12500.0 + 5000.0).alias("hi"))
    return joins.range_lookup(table(spark, d, "orders"), bands, "o_totalprice", "lo", "hi", 5000.0).select("o_orderkey", "band")


@query(
    """SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM supplier s WHERE p.p_partkey * 100 < s.s_suppkey * 1000 + 150 AND s.s_suppkey * 1000 < p.p_partkey * 100 + p.p_size)"""
)
def interval_overlap(spark, d):
    a = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 100).alias("start"), F.col("p_size").cast("long").alias("length"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") * 1000).alias("start"), F.lit(150).cast("long").alias("length"))
    return joins.overlapping(a, b, "start", "length", 500).select("p_partkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def overlay_latest(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return joins.latest(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(
    """WITH n AS (SELECT c_custkey, c_mktsegment || c_custkey % 97 || 'x' || c_custkey AS name FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 30, '0') ELSE x END)) AS place FROM n"""
)
def natural_sort(spark, d):
    name = F.concat("c_mktsegment", (F.col("c_custkey") % 97).cast("string"), F.lit("x"), F.col("c_custkey").cast("string"))
    rows = table(spark, d, "customer").select("c_custkey", T.natural_key(name).alias("k"))
    return resolve.numbered(rows, [F.col("k")], "place").drop("k")


@query(
    """SELECT o_orderkey, string_agg(p_name || ' x' || CAST(l_quantity AS INTEGER), '; ' ORDER BY l_linenumber, l_partkey, p_name || ' x' || CAST(l_quantity AS INTEGER)) AS items, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey"""
)
def nested_lookup(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    own = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("p_name", F.lit(" x"), F.col("l_quantity").cast("int").cast("string")).alias("s"))))
    return rows.groupBy("o_orderkey").agg(F.array_join(own["s"], "; ").alias("items"), F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT lower(trim(n_name)) AS k, n_nationkey FROM nation) SELECT s_suppkey, coalesce(a.n_nationkey, b.n_nationkey, -1) AS nation, a.n_nationkey IS NULL AS fallback
FROM (SELECT *, lower(s_name) AS k FROM supplier) s LEFT JOIN n a ON a.k = s.k LEFT JOIN n b ON b.n_nationkey = s.s_nationkey"""
)
def alias_lookup(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.lower(F.trim("n_name")).alias("k"), F.col("n_nationkey").alias("a")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_nationkey").alias("b"))
    rows = table(spark, d, "supplier").withColumn("k", F.lower("s_name")).join(a, "k", "left").join(b, "s_nationkey", "left")
    return rows.select("s_suppkey", F.coalesce("a", "b", F.lit(-1)).alias("nation"), F.col("a").isNull().alias("fallback"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND l_returnflag <> 'R' GROUP BY l_orderkey HAVING count(*) > 3")
def option_groups(spark, d):
    orders = table(spark, d, "orders").where("o_orderdate >= timestamp '1996-01-01'").select("o_orderkey")
    items = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("l_orderkey")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue")).where("n > 3")


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY CUBE (r_name, n_name)")
def region_cube(spark, d):
    # The dimensions have a row per nation and are joined after the rows have been counted by nation.
    by = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    rows = by.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.cube("r_name", "n_name").agg(F.sum("n").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


_EDGES = "m AS (SELECT count(*) AS m FROM customer), e AS (SELECT c_custkey AS src, 1 AS pos, (c_custkey * 3 + 1) % m AS dst FROM customer, m WHERE c_custkey % 10 < 8 UNION ALL SELECT c_custkey, 2, (c_custkey * 7 + 4) % m FROM customer, m WHERE c_custkey % 10 < 8)"


def customer_edges(spark, d):
    """Two edges from each customer to others, but for two of ten that have none."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    m = people.count()
    people = people.where("src % 10 < 8")
    one = people.select("src", F.lit(1).alias("pos"), ((F.col("src") * 3 + 1) % m).alias("dst"))
    return one.unionByName(people.select("src", F.lit(2).alias("pos"), ((F.col("src") * 7 + 4) % m).alias("dst")))


@query(f"WITH RECURSIVE {_EDGES}, r(node, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 40) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def graph_reach(spark, d):
    return graph.reachable(customer_edges(spark, d), spark.range(1).select(F.col("id").alias("node")))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS src, pos, c_custkey * 2 + pos AS dst FROM customer, (VALUES (1), (2)) v(pos) WHERE c_custkey * 2 + pos < (SELECT count(*) FROM customer) AND c_custkey % 5 <> 4), r(node, path) AS (SELECT CAST(0 AS BIGINT), '' UNION ALL SELECT dst, path || '0001' || pos FROM r JOIN e ON src = node)
SELECT node, path FROM r UNION ALL SELECT c_custkey, '~' || lpad(CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR), 4, '0') || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT node FROM r)"""
)
def graph_dfs_order(spark, d):
    """A tree over the customers of which some branches are cut; what no path reaches follows."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    edges = people.where("src % 5 <> 4").select("src", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).withColumn("dst", F.col("src") * 2 + F.col("pos")).where(F.col("dst") < people.count())
    return graph.depth_first_order(edges, spark.range(1).select(F.col("id").alias("node")), people.select(F.col("src").alias("node")))


@query(f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM r JOIN e ON src = node) SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT node FROM r)")
def graph_orphans(spark, d):
    reached = graph.reachable(customer_edges(spark, d), spark.range(1).select(F.col("id").alias("node")))
    return graph.orphans(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), reached)


@query(
    """WITH m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label AS l, list(x ORDER BY i) AS mean FROM m GROUP BY label),
s AS (SELECT vec_id, label, l, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), mean), 9) AS score FROM embeddings, c)
SELECT vec_id, label, arg_min(l, (-score, l)) AS best, round(max(score), 6) AS score FROM s GROUP BY vec_id, label"""
)
def vector_rank(spark, d):
    return similarity.nearest_centroid(table(spark, d, "embeddings")).withColumn("score", F.round("score", 6))


@query(
    """WITH w AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), x AS (SELECT k FROM w EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT k FROM x"""
)
def set_operations(spark, d):
    orders = table(spark, d, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    building = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return urgent.intersect(building).subtract(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query()
def graph_components(spark, d):
    """All orders join customers with groups. Recursive SQL takes too long over the whole table; tests hold the operator against a plain one."""
    rows = table(spark, d, "orders")
    return graph.components(rows.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 7 * 1000 + F.round(F.col("o_totalprice")).cast("long") % 11 * 100000).alias("dst")))


@query(
    """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS VARCHAR) AS node, pos, n_name || pos AS text, CASE WHEN pos = 2 AND n_nationkey * 2 + 1 < 25 THEN CAST(n_nationkey * 2 + 1 AS VARCHAR) WHEN pos = 3 AND n_nationkey * 2 + 2 < 25 THEN CAST(n_nationkey * 2 + 2 AS VARCHAR) END AS callee FROM nation, (VALUES (1), (2), (3)) v(pos)),
r(path, node, pos, text, callee) AS (SELECT '0001' || pos, node, pos, text, callee FROM e WHERE node = '0' UNION ALL SELECT r.path || '/' || '0001' || e.pos, e.node, e.pos, e.text, e.callee FROM r JOIN e ON e.node = r.callee)
SELECT path, node, pos, text FROM r"""
)
def call_expansion(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("pos"))
    callee = F.col("n_nationkey") * 2 + F.col("pos") - 1
    events = n.select(F.col("n_nationkey").cast("string").alias("node"), "pos", F.concat("n_name", F.col("pos").cast("string")).alias("text"), F.when((F.col("pos") > 1) & (callee < 25), callee.cast("string")).alias("callee"))
    return graph.expand_calls(events, "0")


@query(
    """WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS v FROM embeddings), m AS (SELECT label, i, CAST(avg(x) > 0 AS INTEGER) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
c AS (SELECT label AS l, list(x ORDER BY i) AS mean FROM m GROUP BY label), s AS (SELECT vec_id, l, round(list_sum(list_transform(list_zip(v, mean), lambda z: least(z[1], z[2]))) / list_sum(list_transform(list_zip(v, mean), lambda z: greatest(z[1], z[2]))), 9) AS score FROM b, c)
SELECT vec_id, arg_min(l, (-score, l)) AS best, max(score) AS score FROM s GROUP BY vec_id"""
)
def glyph_rank(spark, d):
    rows = table(spark, d, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg((F.avg(F.col("x").cast("double")) > 0).cast("int").alias("x"))
    means = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
    bits = rows.select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("v"))
    return similarity.best_mean(bits, means.withColumnRenamed("label", "l"), similarity.overlap_of_bits, "vec_id", "v")


@query(
    """WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS v FROM embeddings), m AS (SELECT label, i, CAST(avg(x) > 0 AS INTEGER) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
c AS (SELECT label AS l, list(x ORDER BY i) AS mean FROM m GROUP BY label), t AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx)),
g AS (SELECT l, list_transform(range(len(mean)), lambda i: CASE WHEN i // 8 + dy BETWEEN 0 AND len(mean) // 8 - 1 AND i % 8 + dx BETWEEN 0 AND 7 THEN mean[i + 8 * dy + dx + 1] ELSE 0 END) AS s FROM c, t),
a AS (SELECT vec_id, v FROM b UNION ALL SELECT vec_id, list_transform(v, lambda x: 1 - x) FROM b),
r AS (SELECT vec_id, l, round(max(list_sum(list_transform(list_zip(v, s), lambda z: least(z[1], z[2]))) / nullif(list_sum(list_transform(list_zip(v, s), lambda z: greatest(z[1], z[2]))), 0)), 9) AS score FROM a, g GROUP BY ALL)
SELECT vec_id, arg_min(l, (-score, l)) AS best, max(score) AS score FROM r GROUP BY vec_id"""
)
def glyph_shift_rank(spark, d):
    """Vectors as pictures of eight columns against the labels' mean pictures, moved by up to two rows and columns and inverted."""
    rows = table(spark, d, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg((F.avg(F.col("x").cast("double")) > 0).cast("int").alias("x"))
    means = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
    moved = means.select(F.col("label").alias("l"), similarity.glyph_rows(F.col("mean"), 8).alias("r")).select("l", similarity.shifted_glyphs(F.col("r"), 8).alias("mean"))
    drawn = rows.select("vec_id", similarity.glyph_rows(F.transform("embedding", lambda x: (x > 0).cast("int")), 8).alias("v"))
    return similarity.best_mean(drawn, moved, lambda v, m: similarity.glyph_overlap(v, m, 8), "vec_id", "v")
