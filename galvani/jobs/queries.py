"""The graph queries by name, over graphs that Spark derives from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import tidy
from ..operators import bridges as B
from ..operators import centrality as C
from ..operators.classes import Classes
from ..operators import components as K
from ..operators import decomposition as D
from ..operators import edges as E
from ..operators import parts as Q
from ..operators import paths as P
from ..operators import resistance as R
from ..operators import solve as V
from ..sources import edge_lists as S
from ..sources.scratch import Scratch, dealt_out
from ..sources.trade_graphs import geo_edges, order_part_edges, order_part_pairs, read, sparse_trade_edges, trade_edges
from .sql import BLOCKS, BOTH, BRIDGES, COMPONENTS, GEO, INVERSE, ORDER_PART, SPARSE, TRADE, query

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    """Under the function's name; sql where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def geo(spark: SparkSession, d: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark)
    return scratch.table(geo_edges(spark, d), "geo"), scratch


def sparse(spark: SparkSession, d: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark)
    return scratch.table(sparse_trade_edges(spark, d), "sparse"), scratch


# --- sources and sinks ----------------------------------------------------------------------------------------------

LINES = "SELECT l_orderkey::BIGINT AS u, (CASE WHEN l_linenumber % 5 = 0 THEN l_orderkey ELSE l_partkey + 1000000000 END)::BIGINT AS v FROM lineitem"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts as pairs, some of them loops."""
    t = read(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("u"), F.when(F.col("l_linenumber") % 5 == 0, F.col("l_orderkey")).otherwise(F.col("l_partkey") + 1_000_000_000).alias("v"))


@register(f"SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM ({LINES}) WHERE u <> v")
def s1_read_edge_list(spark, d):
    """Written as text, an edge a line, and read back."""
    path = f"{Scratch(spark).top}/lines"
    _lines(spark, d).select(F.concat_ws(" ", "u", "v").alias("value")).write.text(path)
    return S.read_edge_list(spark, path)[0]


@register(f"SELECT count(DISTINCT x)::BIGINT AS n FROM (SELECT u AS x FROM ({LINES}) UNION ALL SELECT v FROM ({LINES}))")
def s1_nodes_with_loops(spark, d):
    return S.nodes_of(_lines(spark, d), "u", "v").agg(F.count(F.lit(1)).alias("n"))


@register(
    query(
        SPARSE + BOTH + COMPONENTS,
        "SELECT src, dst FROM edges JOIN components ON src = node WHERE component = (SELECT component FROM components GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)",
        recursive=True,
    )
)
def s2_largest_component(spark, d):
    edges, scratch = sparse(spark, d)
    return K.largest_component(edges, scratch.table)


@register("SELECT 'status=' || o_orderstatus AS graph_id, count(DISTINCT (o_custkey, o_orderkey)) AS m FROM orders GROUP BY 1")
def s3_read_directory(spark, d):
    """A file a graph: orders by status, written as text and read back by file."""
    top, orders = f"{Scratch(spark).top}/graphs", read(spark, d, "orders")
    kinds = sorted(r[0] for r in orders.select("o_orderstatus").distinct().collect())  # three values
    for kind in kinds:
        part = orders.filter(F.col("o_orderstatus") == kind).select(F.concat_ws(" ", "o_custkey", F.col("o_orderkey") + 10_000_000_000).alias("value"))
        part.write.text(f"{top}/status={kind}")
    edges, _ = S.read_edge_lists(spark, top, by="folder")
    return edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))


@register("SELECT l_orderkey || ' p' || l_partkey AS value, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1")
def f1_rejected_lines(spark, d):
    """Lines without two whole numbers, from a text file in which others are fine."""
    path = f"{Scratch(spark).top}/lines"
    end = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("p"), "l_partkey")).otherwise(F.col("l_partkey").cast("string"))
    read(spark, d, "lineitem").select(F.concat_ws(" ", "l_orderkey", end).alias("value")).write.text(path)
    return S.rejected_lines(spark, path)


@register(query(ORDER_PART, "SELECT src, dst FROM edges"))
def s4_graph_of_table(spark, d):
    return order_part_edges(spark, d)


@register(query(GEO + BOTH + INVERSE, "SELECT node, round(n / farness, 6) AS centrality FROM far CROSS JOIN (SELECT count(*) AS n FROM nodes) ORDER BY round(farness, 9), node LIMIT 1", recursive=True))
def s5_write_top_node(spark, d):
    edges, scratch = geo(spark, d)
    path = f"{scratch.top}/top"
    S.write_results(C.most_central(edges).select("node", tidy(F.col("centrality")).alias("centrality")), path, "csv")
    return spark.read.schema("node long, centrality double").option("header", True).csv(path)


@register("SELECT i AS src, i + 1 AS dst FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer))) AS i)")
def s6_path_graph(spark, d):
    return S.path_graph(spark, read(spark, d, "customer").count())


# --- projections, filters, predicates -------------------------------------------------------------------------------


@register("SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM (" + LINES + ") WHERE u <> v")
def p1_canonical(spark, d):
    return S.canonical(_lines(spark, d), "u", "v")


@register(query(ORDER_PART + BOTH, "SELECT src, dst FROM both_ways"))
def p2_symmetric(spark, d):
    return E.symmetric(order_part_edges(spark, d))


@register(
    query(
        GEO + BOTH,
        "SELECT node AS i, node AS j, degree::DOUBLE AS val FROM degrees WHERE node <> 99 UNION ALL SELECT src, dst, -1.0::DOUBLE FROM both_ways WHERE src <> 99 AND dst <> 99",
    )
)
def p3_grounded_laplacian(spark, d):
    """A node goes; the diagonal keeps the degrees that counted it."""
    return E.laplacian(geo_edges(spark, d)).filter("i <> 99 and j <> 99")


@register(query(GEO, "SELECT src, dst FROM edges WHERE src <> 99 AND dst <> 99"))
def p3_without_node(spark, d):
    return E.without_node(geo_edges(spark, d), 99)


@register(query(ORDER_PART, "SELECT src, dst FROM edges WHERE dst NOT IN (SELECT p_partkey + 1000000000 FROM part WHERE p_size < 20)"))
def p4_without_nodes(spark, d):
    gone = read(spark, d, "part").filter("p_size < 20").select((F.col("p_partkey") + 1_000_000_000).alias("node"))
    return E.without_nodes(order_part_edges(spark, d), gone)


@register(
    query(
        ORDER_PART,
        "SELECT src, dst FROM edges WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND dst IN (SELECT p_partkey + 1000000000 FROM part WHERE p_size >= 20)",
    )
)
def p5_induced(spark, d):
    kept = read(spark, d, "part").filter("p_size >= 20").select((F.col("p_partkey") + 1_000_000_000).cast("long").alias("node"))
    kept = kept.union(read(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("long")))
    return E.induced(order_part_edges(spark, d), kept)


GONE = "SELECT DISTINCT l_orderkey AS src, l_partkey + 1000000000 AS dst FROM lineitem WHERE l_quantity < 10"


def _gone(spark, d):
    return read(spark, d, "lineitem").filter("l_quantity < 10").select(F.col("l_orderkey").cast("long").alias("src"), (F.col("l_partkey") + 1_000_000_000).cast("long").alias("dst"))


@register(query(ORDER_PART, f"SELECT src, dst FROM edges ANTI JOIN ({GONE}) g USING (src, dst)"))
def p6_without_edges(spark, d):
    return E.without_edges(order_part_edges(spark, d), _gone(spark, d))[0]


@register(f"SELECT DISTINCT unnest([src, dst])::BIGINT AS node FROM ({GONE})")
def p6_touched_nodes(spark, d):
    return E.without_edges(order_part_edges(spark, d), _gone(spark, d))[1]


CHECKS = """SELECT n, m, c AS n_components, c = 1 AS is_connected, c = 1 AND m = n - 1 AS is_tree
FROM (SELECT count(*) AS n, count(DISTINCT component) AS c FROM components), (SELECT count(*) AS m FROM edges)"""


@register(query(GEO + BOTH + COMPONENTS, CHECKS, recursive=True))
def p7_p8_graph_checks(spark, d):
    edges, scratch = geo(spark, d)
    return K.graph_checks(edges, scratch.table)


@register(query(SPARSE + BOTH + COMPONENTS, CHECKS, recursive=True))
def p7_not_connected(spark, d):
    edges, scratch = sparse(spark, d)
    return K.graph_checks(edges, scratch.table)


# --- joins and aggregates -------------------------------------------------------------------------------------------


@register(
    query(
        ORDER_PART + BOTH,
        "SELECT e.src AS node, (any_value(d.degree) * (e.src % 97) - sum(e.dst % 97))::DOUBLE AS value FROM both_ways e JOIN degrees d ON d.node = e.src GROUP BY e.src",
    )
)
def j2_laplacian_times(spark, d):
    edges = order_part_edges(spark, d)
    x = E.nodes(edges).withColumn("value", (F.col("node") % 97).cast("double"))
    return E.laplacian_times(edges, x)


@register(query(ORDER_PART, "SELECT node, sum(v)::DOUBLE AS value FROM (SELECT src AS node, ((src + dst) % 13)::DOUBLE AS v FROM edges UNION ALL SELECT dst, -((src + dst) % 13) FROM edges) GROUP BY 1"))
def j3_incidence_sum(spark, d):
    return E.incidence_sum(order_part_edges(spark, d), ((F.col("src") + F.col("dst")) % 13).cast("double"))


@register(query(ORDER_PART + BOTH, "SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m"))
def a1_size(spark, d):
    return E.size(order_part_edges(spark, d))


@register(query(ORDER_PART + BOTH, "SELECT node, degree FROM degrees"))
def a2_degrees(spark, d):
    return E.degrees(order_part_edges(spark, d))


@register(query(ORDER_PART + BOTH, "SELECT src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM both_ways GROUP BY 1"))
def a3_neighbour_lists(spark, d):
    return E.neighbour_lists(order_part_edges(spark, d)).withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ","))


@register(query(ORDER_PART + BOTH, "SELECT e.dst AS node, count(*) AS ext FROM both_ways e JOIN degrees d ON d.node = e.src AND d.degree = 1 GROUP BY 1"))
def a4_leaf_counts(spark, d):
    return E.leaf_counts(order_part_edges(spark, d))


@register("SELECT x AS node, row_number() OVER (ORDER BY p) AS id FROM (SELECT x, min(p) AS p FROM (SELECT c_custkey AS x, o_orderkey * 2 AS p FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 10000000 + c_nationkey, o_orderkey * 2 + 1 FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)")
def w1_first_appearance(spark, d):
    pairs = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").cast("long").alias("a"), (F.col("c_nationkey") + 10_000_000).cast("long").alias("b"), F.col("o_orderkey").alias("p"))
    return E.first_appearance_ids(pairs, "a", "b", "p")


@register(query(ORDER_PART + BOTH, "SELECT node, row_number() OVER (ORDER BY node) AS id FROM nodes"))
def w2_dense_ids(spark, d):
    return E.dense_ids(E.nodes(order_part_edges(spark, d)), "node").select("node", "id")


@register("SELECT l_orderkey::BIGINT AS node FROM lineitem UNION SELECT l_partkey + 1000000000 FROM lineitem")
def u1_union_of_ends(spark, d):
    return S.nodes_of(order_part_pairs(spark, d), "u", "v")


@register("SELECT o_orderkey::BIGINT AS node FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity < 10")
def u2_difference(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("node")).subtract(_gone(spark, d).select("src"))


@register("SELECT o_orderkey::BIGINT AS node FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity < 10")
def u3_intersection(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("long").alias("node")).intersect(_gone(spark, d).select("src"))


@register(query(ORDER_PART + BOTH, "SELECT node AS i, node AS j, degree::DOUBLE AS val FROM degrees UNION ALL SELECT src, dst, -1.0::DOUBLE FROM both_ways"))
def g11_laplacian(spark, d):
    return E.laplacian(order_part_edges(spark, d))


# --- components and bridges -----------------------------------------------------------------------------------------


@register(query(SPARSE + BOTH + COMPONENTS, "SELECT node, component FROM components", recursive=True))
def g1_components(spark, d):
    edges, scratch = sparse(spark, d)
    return K.connected_components(edges, scratch.table)


@register(query(ORDER_PART + BOTH, "SELECT node, (SELECT min(node) FROM nodes) AS component FROM nodes"))
def g1_components_of_orders(spark, d):
    """The large graph, which is one component at every scale factor given."""
    scratch = Scratch(spark)
    return K.connected_components(scratch.table(order_part_edges(spark, d)), scratch.table)


@register(query(SPARSE + BOTH + COMPONENTS, "SELECT component, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM components GROUP BY 1", recursive=True))
def g2_component_lists(spark, d):
    edges, scratch = sparse(spark, d)
    return K.component_lists(K.connected_components(edges, scratch.table)).withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


@register(query(SPARSE + BOTH + COMPONENTS, "SELECT component, count(*) AS size FROM components GROUP BY 1 HAVING count(*) > 1", recursive=True))
def p9_a6_component_sizes(spark, d):
    edges, scratch = sparse(spark, d)
    return K.component_sizes(K.connected_components(edges, scratch.table), drop_single=True)


@register(query(GEO + BOTH + BRIDGES, "SELECT src, dst, kind FROM bridges", recursive=True))
def g4_g5_bridges(spark, d):
    edges, scratch = geo(spark, d)
    return B.classify_bridges(edges, B.find_bridges(edges, scratch))


def _with_bridges(spark, d):
    edges, scratch = geo(spark, d)
    return edges, scratch.table(B.classify_bridges(edges, B.find_bridges(edges, scratch)), "bridges"), scratch


@register(query(GEO + BOTH + BRIDGES, "SELECT src, dst FROM edges ANTI JOIN bridges USING (src, dst)", recursive=True))
def g6_without_bridges(spark, d):
    edges, bridges, _ = _with_bridges(spark, d)
    return E.without_edges(edges, bridges)[0]


STATISTICS = """SELECT 100.0 * i / m AS inner_edges, 100.0 * 2 * i / n AS inner_end_occurrences, 100.0 * e / n AS inner_end_nodes, 100.0 * l / m AS leaf_edges, 100.0 * leaves / n AS leaf_nodes
FROM (SELECT count(*) FILTER (kind = 'inner') AS i, count(*) FILTER (kind = 'leaf') AS l FROM bridges), (SELECT count(*) AS m FROM edges), (SELECT count(*) AS n, count(*) FILTER (degree = 1) AS leaves FROM degrees),
(SELECT count(DISTINCT node) AS e FROM (SELECT unnest([src, dst]) AS node FROM bridges WHERE kind = 'inner'))"""


@register(query(GEO + BOTH + BRIDGES, f"SELECT {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in ('inner_edges', 'inner_end_occurrences', 'inner_end_nodes', 'leaf_edges', 'leaf_nodes'))} FROM ({STATISTICS})", recursive=True))
def a8_bridge_statistics(spark, d):
    edges, bridges, _ = _with_bridges(spark, d)
    found = B.bridge_statistics(edges, bridges)
    return C.tidy_scores(found, *found.columns)


@register(query(GEO + BOTH + BRIDGES + BLOCKS, "SELECT block, node, is_link, ext FROM blocks", recursive=True))
def g7_blocks(spark, d):
    return B.blocks(*_with_bridges(spark, d))


PROFILE = """SELECT block, count(*) AS nodes, count(*) FILTER (is_link) AS links, round(100.0 * count(*) FILTER (is_link) / count(*), 6)::DOUBLE AS link_share, sum(ext + 1)::BIGINT AS real_size,
coalesce(string_agg(node::VARCHAR, ',' ORDER BY node) FILTER (is_link), '') AS boundary, coalesce(string_agg(node::VARCHAR, ',' ORDER BY node) FILTER (ext > 0), '') AS anchors FROM blocks GROUP BY 1"""


@register(query(GEO + BOTH + BRIDGES + BLOCKS, PROFILE, recursive=True))
def a7_a9_block_profile(spark, d):
    return C.tidy_scores(B.block_profile(B.blocks(*_with_bridges(spark, d))), "link_share")


@register(query(GEO + BOTH + BRIDGES + BLOCKS, "SELECT b.src, b.dst, x.block AS src_block, y.block AS dst_block FROM bridges b LEFT JOIN blocks x ON x.node = b.src LEFT JOIN blocks y ON y.node = b.dst WHERE kind = 'inner'", recursive=True))
def j4_j5_d5_bridge_ends(spark, d):
    edges, bridges, scratch = _with_bridges(spark, d)
    return B.bridge_ends(bridges, B.blocks(edges, bridges, scratch))


@register(query(GEO + BOTH + BRIDGES, "SELECT NOT EXISTS (SELECT 1 FROM degrees l WHERE degree = 1 AND (l.node IN (SELECT unnest([src, dst]) FROM bridges WHERE kind = 'inner') OR EXISTS (SELECT 1 FROM both_ways e JOIN degrees x ON x.node = e.dst AND x.degree = 1 WHERE e.src = l.node))) AS apart", recursive=True))
def u4_leaf_classes_apart(spark, d):
    edges, bridges, _ = _with_bridges(spark, d)
    return B.leaf_classes_apart(edges, bridges)


# --- exact resistances and centralities -----------------------------------------------------------------------------


def exact(sql: str) -> str:
    return query(GEO + BOTH + INVERSE, sql, recursive=True)


@register(exact("SELECT i, j, round(val, 6) + 0.0 AS val FROM inverse"))
def r3_pseudo_inverse(spark, d):
    return Classes(*geo(spark, d)).entries(digits=6)


@register(exact("SELECT src, dst, round(r, 6) + 0.0 AS r FROM edges JOIN pairs ON u = src AND v = dst"))
def r4_j1_edge_resistance(spark, d):
    edges, scratch = geo(spark, d)
    return C.tidy_scores(Classes(edges, scratch).pair_resistance(edges), "r")


@register(exact("SELECT u, v, round(r, 6) + 0.0 AS r FROM pairs WHERE u < v"))
def r5_j6_all_pairs(spark, d):
    return Classes(*geo(spark, d)).all_pairs_resistance(digits=6)


@register(exact("SELECT node, round(farness, 6) AS farness FROM far"))
def a5_farness_of_pairs(spark, d):
    return C.tidy_scores(Classes(*geo(spark, d)).farness_of_pairs(), "farness")


@register(exact("SELECT round(sum(val), 6) AS trace FROM diag"))
def a10_trace(spark, d):
    return C.tidy_scores(Classes(*geo(spark, d)).trace(), "trace")


@register(exact("SELECT j AS node, round(sum(val * val), 6) AS value FROM inverse GROUP BY 1"))
def a13_column_squares(spark, d):
    return C.tidy_scores(Classes(*geo(spark, d)).column_squares(), "value")


CENTRAL = "SELECT node, round(farness, 6) AS farness, round(n / farness, 6) AS centrality FROM far CROSS JOIN (SELECT count(*) AS n FROM nodes)"


@register(exact(CENTRAL))
def c1_exact_centrality(spark, d):
    return C.tidy_scores(C.exact_centrality(*geo(spark, d)), "farness", "centrality")


@register(exact("SELECT node, round(n / farness, 6) AS centrality FROM far CROSS JOIN (SELECT count(*) AS n FROM nodes) ORDER BY round(n / farness, 9) DESC, node LIMIT 1"))
def c2_t3_most_central(spark, d):
    return C.tidy_scores(C.most_central(geo(spark, d)[0]), "centrality")


@register(exact(CENTRAL + " ORDER BY round(n / farness, 9) DESC, node LIMIT 10"))
def t1_top_ten(spark, d):
    return C.tidy_scores(C.top_nodes(C.exact_centrality(*geo(spark, d)), "centrality"), "farness", "centrality")


@register(exact("SELECT node, round(val, 6) AS value, row_number() OVER (ORDER BY round(val, 9), node)::INT AS rank FROM diag"))
def w3_t4_ranked_diagonal(spark, d):
    edges, scratch = geo(spark, d)
    ranked, _ = C.exact_greedy(edges, 1, scratch)
    return ranked.select("node", tidy(F.col("score")).alias("value"), "rank")


@register(exact("SELECT node, round(farness, 6) AS farness FROM far"))
def c5_grounded_traces(spark, d):
    """Tr of the inverse grounded at each node, from the grounded entries themselves."""
    return C.tidy_scores(Classes(*geo(spark, d)).grounded_traces(), "farness")


GREEDY = """,
p1 AS (SELECT node AS g FROM diag ORDER BY round(val, 9), node LIMIT 1),
m1 AS (SELECT m.i, m.j, m.val - x.val - y.val + z.val AS val FROM inverse m, p1 JOIN inverse x ON x.i = g JOIN inverse y ON y.j = g JOIN diag z ON z.node = g WHERE x.j = m.j AND y.i = m.i AND m.i <> g AND m.j <> g),
s2 AS (SELECT j AS node, sum(val * val) / max(val) FILTER (i = j) AS score FROM m1 GROUP BY 1),
p2 AS (SELECT node AS g FROM s2 ORDER BY round(score, 9) DESC, node LIMIT 1),
m2 AS (SELECT m.i, m.j, m.val - x.val * y.val / z.val AS val FROM m1 m, p2 JOIN m1 x ON x.i = g JOIN m1 y ON y.j = g JOIN m1 z ON z.i = g AND z.j = g WHERE x.j = m.j AND y.i = m.i AND m.i <> g AND m.j <> g),
s3 AS (SELECT j AS node, sum(val * val) / max(val) FILTER (i = j) AS score FROM m2 GROUP BY 1),
p3 AS (SELECT node AS g FROM s3 ORDER BY round(score, 9) DESC, node LIMIT 1),
m3 AS (SELECT m.i, m.j, m.val - x.val * y.val / z.val AS val FROM m2 m, p3 JOIN m2 x ON x.i = g JOIN m2 y ON y.j = g JOIN m2 z ON z.i = g AND z.j = g WHERE x.j = m.j AND y.i = m.i AND m.i <> g AND m.j <> g)"""
RANKS = """SELECT 1 AS step, row_number() OVER (ORDER BY round(val, 9), node)::INT AS rank, node, round(val, 6) AS score FROM diag
UNION ALL SELECT 2, row_number() OVER (ORDER BY round(score, 9) DESC, node), node, round(score, 6) FROM s2
UNION ALL SELECT 3, row_number() OVER (ORDER BY round(score, 9) DESC, node), node, round(score, 6) FROM s3"""


@register(query(GEO + BOTH + INVERSE + GREEDY, RANKS, recursive=True))
def c6_exact_greedy(spark, d):
    edges, scratch = geo(spark, d)
    return C.tidy_scores(C.exact_greedy(edges, 3, scratch)[0], "score")


@register(query(GEO + BOTH + INVERSE + GREEDY, "SELECT 3 AS k, round((SELECT count(*) FROM nodes) / sum(val), 6) AS centrality FROM m3 WHERE i = j", recursive=True))
def c6_greedy_value(spark, d):
    edges, scratch = geo(spark, d)
    return C.tidy_scores(C.exact_greedy(edges, 3, scratch)[1], "centrality")


@register(query(GEO + BOTH + INVERSE + GREEDY.replace("SELECT node AS g FROM diag ORDER BY round(val, 9), node LIMIT 1", "SELECT 100 AS g").replace("SELECT node AS g FROM s2 ORDER BY round(score, 9) DESC, node LIMIT 1", "SELECT 103 AS g"), "SELECT 2 AS k, round((SELECT count(*) FROM nodes) / sum(val), 6) AS centrality FROM m2 WHERE i = j", recursive=True))
def c8_given_group(spark, d):
    edges, scratch = geo(spark, d)
    return C.tidy_scores(C.exact_greedy(edges, 2, scratch, given=[100, 103])[1], "centrality")


# --- the decomposition ----------------------------------------------------------------------------------------------


@register(exact(CENTRAL))
def d1_d6_decomposed_centrality(spark, d):
    edges, bridges, scratch = _with_bridges(spark, d)
    return C.tidy_scores(C.with_centrality(D.decomposed_farness(edges, bridges, scratch)), "farness", "centrality")


@register(exact("SELECT node, round(farness, 6) AS farness, true AS same FROM far"))
def u6_decomposed_equals_exact(spark, d):
    edges, bridges, scratch = _with_bridges(spark, d)
    both = D.decomposed_farness(edges, bridges, scratch).join(C.exact_centrality(edges).select("node", F.col("farness").alias("exact")), "node", "full_outer")
    return C.tidy_scores(both.select("node", "farness", F.coalesce(F.abs(F.col("farness") - F.col("exact")) <= 1e-6, F.lit(False)).alias("same")), "farness")


def _links(spark, d):
    edges, bridges, scratch = _with_bridges(spark, d)
    placed, inside = D.bridge_free_blocks(edges, bridges, scratch)
    ends = bridges.select(F.explode(F.array("src", "dst")).alias("node"))
    return edges, bridges, scratch, placed, scratch.table(D.link_rows(placed, scratch.table(inside), ends))


CONTRACTED = """,
ends AS (SELECT DISTINCT unnest([src, dst]) AS node FROM bridges WHERE kind = 'inner'),
contracted AS (
  SELECT src AS a, dst AS b, 1.0::DOUBLE AS w FROM bridges WHERE kind = 'inner'
  UNION ALL SELECT u, v, r FROM pairs JOIN blocks x ON x.node = u JOIN blocks y ON y.node = v AND x.block = y.block WHERE u < v AND u IN (SELECT node FROM ends) AND v IN (SELECT node FROM ends))"""


@register(query(GEO + BOTH + BRIDGES + BLOCKS + INVERSE + CONTRACTED, "SELECT a, b, round(w, 6) AS w FROM contracted", recursive=True))
def g8_contracted_graph(spark, d):
    _, bridges, _, placed, rows = _links(spark, d)
    return C.tidy_scores(D.contracted_graph(bridges, placed, rows), "w")


@register(
    query(
        GEO + BOTH + BRIDGES + BLOCKS + INVERSE + CONTRACTED,
        "SELECT source, block, round(dist, 6) AS dist, entry FROM (SELECT e.node AS source, b.block, round(p.r, 9) AS dist, p.v AS entry, row_number() OVER (PARTITION BY e.node, b.block ORDER BY round(p.r, 9), p.v) AS k FROM ends e JOIN pairs p ON p.u = e.node JOIN blocks b ON b.node = p.v WHERE p.v IN (SELECT node FROM ends)) WHERE k = 1",
        recursive=True,
    )
)
def g9_g10_block_distances(spark, d):
    """Along a tree of blocks the shortest path of bridges and resistances is the resistance itself."""
    edges, bridges, scratch, placed, rows = _links(spark, d)
    graph = D.contracted_graph(bridges, placed, rows)
    starts = graph.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(F.col("node").alias("source"), "node")
    core = B.blocks(edges, bridges, scratch)
    return C.tidy_scores(D.block_distances(P.shortest_paths(graph, starts, scratch), core), "dist")


WEIGHTS = """,
own(node, other) AS (SELECT node, node FROM nodes UNION SELECT w.node, k.dst FROM own w JOIN kept k ON k.src = w.other),
home AS (SELECT node, min(other) AS block FROM own GROUP BY 1),
nearest AS (SELECT p.v AS other, h.block, min_by(p.u, round(p.r, 9)) AS node, min(p.r) AS r FROM pairs p JOIN home h ON h.node = p.u GROUP BY 1, 2)"""


@register(
    query(
        GEO + BOTH + BRIDGES + BLOCKS + INVERSE + WEIGHTS,
        "SELECT h.block, h.node, count(*)::DOUBLE AS w, round(sum(r), 6) + 0.0 AS d FROM home h JOIN nearest n ON n.node = h.node AND n.block = h.block GROUP BY 1, 2",
        recursive=True,
    )
)
def d3_d4_d9_node_weights(spark, d):
    """By brute force: every other node hangs off the node of the block that is nearest to it."""
    _, bridges, scratch, placed, rows = _links(spark, d)
    return C.tidy_scores(D.node_weights(placed, D.block_tree(placed, bridges, scratch), rows, scratch), "d")


@register(exact("SELECT node, round(farness, 6) AS farness FROM far JOIN degrees USING (node) WHERE degree = 1"))
def d2_u5_leaf_rule(spark, d):
    edges, scratch = geo(spark, d)
    return C.tidy_scores(D.leaf_rule(edges, C.exact_centrality(edges, scratch).select("node", "farness")), "farness")


HOME = """,
own(node, other) AS (SELECT node, node FROM nodes UNION SELECT w.node, k.dst FROM own w JOIN (SELECT x.src, x.dst FROM both_ways x ANTI JOIN bridges b ON b.src = least(x.src, x.dst) AND b.dst = greatest(x.src, x.dst)) k ON k.src = w.other),
home AS (SELECT node, min(other) AS block FROM own GROUP BY 1),
block_edges AS (SELECT x.block AS a, y.block AS b FROM bridges JOIN home x ON x.node = src JOIN home y ON y.node = dst),
ways AS (SELECT a, b FROM block_edges UNION ALL SELECT b, a FROM block_edges),
trees(block, other) AS (SELECT DISTINCT a, a FROM ways UNION SELECT t.block, w.b FROM trees t JOIN ways w ON w.a = t.other),
roots AS (SELECT block, min(other) AS root FROM trees GROUP BY 1)"""


@register(query(GEO + BOTH + BRIDGES + HOME, "SELECT (SELECT count(*) FROM block_edges) = count(*) - count(DISTINCT root) AS is_forest FROM roots", recursive=True))
def g8_block_forest(spark, d):
    _, bridges, scratch, placed, _ = _links(spark, d)
    return D.is_block_forest(bridges, placed, scratch)


@register(exact(CENTRAL))
def d1_r11_solved_blocks(spark, d):
    """The same where blocks of over ten nodes count as giant: no inverse of any of them is taken."""
    edges, bridges, scratch = _with_bridges(spark, d)
    return C.tidy_scores(C.with_centrality(D.decomposed_farness(edges, bridges, scratch, most=10)), "farness", "centrality")


# --- solves and estimates -------------------------------------------------------------------------------------------


@register(exact("SELECT i AS node, round(sum(val * (j % 13)), 6) + 0.0 AS x FROM inverse GROUP BY 1"))
def r1_solution(spark, d):
    """L x = b less its mean, b the key modulo 13."""
    edges, scratch = geo(spark, d)
    right = E.nodes(edges).withColumn("x", (F.col("node") % 13).cast("double"))
    return C.tidy_scores(V.solve_by_shuffle(edges, right, ["x"], scratch, 1e-12)[0], "x")


@register(exact("SELECT m.i AS node, round(sum((m.val - x.val - y.val + z.val) * (m.j % 13)), 6) + 0.0 AS x FROM inverse m JOIN inverse x ON x.i = 99 AND x.j = m.j JOIN inverse y ON y.j = 99 AND y.i = m.i JOIN diag z ON z.node = 99 WHERE m.i <> 99 AND m.j <> 99 GROUP BY 1"))
def r2_grounded_solution(spark, d):
    """The same grounded at a node."""
    edges, scratch = geo(spark, d)
    right = E.nodes(edges).filter("node <> 99").withColumn("x", (F.col("node") % 13).cast("double"))
    return C.tidy_scores(V.solve_by_shuffle(edges, right, ["x"], scratch, 1e-12, ground=(99,))[0], "x")


@register(exact(CENTRAL))
def c1_r3_solved_centrality(spark, d):
    """Exact centralities from solved columns, as of a graph that no task may invert."""
    edges, scratch = geo(spark, d)
    inverse = Classes(edges, scratch, "tables")
    return C.tidy_scores(C.with_centrality(R.farness_of_diagonal(inverse.diagonal())), "farness", "centrality")


@register(exact(CENTRAL))
def c1_r3_selected_centrality(spark, d):
    """Exact centralities after leaves and chains are eliminated, the diagonal brought back round by round."""
    edges, scratch = geo(spark, d)
    return C.tidy_scores(C.exact_centrality(edges, scratch, reduce=True), "farness", "centrality")


@register(exact("SELECT src, dst, round(r, 6) + 0.0 AS r FROM edges JOIN pairs ON u = src AND v = dst"))
def r4_r7_selected_resistance(spark, d):
    """Exact resistances of all edges from the inverse's entries at the edges alone."""
    edges, scratch = geo(spark, d)
    return C.tidy_scores(Q.Parts(edges, scratch, reduce=True).resistances(), "r")


HOMES = """,
homes AS (
  SELECT r_regionkey + 100 AS node, r_regionkey AS region FROM region UNION ALL SELECT n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT s_suppkey + 1000, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@register(
    query(
        GEO + BOTH + INVERSE + HOMES,
        "SELECT 'region=' || x.region AS graph_id, u AS node, round(sum(r), 6) AS farness, round(count(*) / sum(r), 6) AS centrality FROM pairs JOIN homes x ON x.node = u JOIN homes y ON y.node = v AND x.region = y.region GROUP BY 1, 2",
        recursive=True,
    )
)
def s3_c1_centralities_of_graphs(spark, d):
    """A graph for each region, written as text, read as a folder of graphs, and all of them solved for at once. A region
    hangs on the world by one bridge, so its resistances are those of the whole graph."""
    edges, scratch = geo(spark, d)
    home = read(spark, d, "region").select((F.col("r_regionkey") + 100).alias("node"), F.col("r_regionkey").alias("region"))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    home = home.union(nation).union(read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("nation")).select(F.col("s_suppkey") + 1000, "region"))
    path = f"{scratch.top}/graphs"
    lines = edges.filter("src <> 99 AND dst <> 99").join(home.withColumnRenamed("node", "src"), "src")
    lines.select("region", F.concat_ws(" ", "src", "dst").alias("value")).write.partitionBy("region").text(path)
    found, ends = S.read_edge_lists(spark, path, by="folder")
    graphs = Q.ManyGraphs(found, scratch, ends)
    parts = Q.Parts(graphs.edges, scratch, graphs.names.select("node", F.col("graph_id").alias("part")))
    return C.tidy_scores(graphs.named(parts.centralities().drop("part")), "farness", "centrality")


@register("SELECT true AS solved")
def r1_solve_by_shuffle(spark, d):
    """L x = b on the large graph, b of mean zero from the keys: applied again, x gives b."""
    scratch = Scratch(spark)
    edges = scratch.table(order_part_edges(spark, d), "edges")
    with dealt_out(spark, 2 * edges.count()):
        right = scratch.table(E.incidence_sum(edges, F.when(F.xxhash64("src", "dst") % 2 == 0, 1.0).otherwise(-1.0)).withColumnRenamed("value", "b"), "right")
        x, _ = V.solve_by_shuffle(edges, right, ["b"], scratch, 1e-6)
        again = E.laplacian_times(edges, x.hint("shuffle_hash"), "b").join(right, "node")
        return scratch.table(again.agg((F.sqrt(F.sum((F.col("value") - F.col("b")) ** 2)) <= 1e-5 * F.sqrt(F.sum(F.col("b") ** 2))).alias("solved")), "solved")


def within(sql_nodes: str) -> str:
    return query(GEO + BOTH, f"SELECT node, true AS within FROM nodes {sql_nodes}")


def _held(estimate: DataFrame, truth: DataFrame, by: str, share: float) -> DataFrame:
    both = truth.select("node", F.col(by).alias("truth")).join(estimate.select("node", F.col(by).alias("guess")), "node", "left")
    return both.select("node", F.coalesce(F.abs(F.col("guess") - F.col("truth")) <= share * F.abs(F.col("truth")), F.lit(False)).alias("within"))


@register(within(""))
def r6_a11_diagonal_estimate(spark, d):
    edges, scratch = geo(spark, d)
    return _held(R.Estimates(edges, 200).diagonal(), Classes(edges, scratch).diagonal(), "value", 0.3)


@register(query(GEO + BOTH, "SELECT src, dst, true AS within FROM edges"))
def r7_embedded_resistance(spark, d):
    edges, scratch = geo(spark, d)
    guess = R.embedded_resistance(scratch.table(R.Estimates(edges, 200).embedding()), edges).withColumnRenamed("r", "guess")
    truth = Classes(edges, scratch).pair_resistance(edges)
    return truth.join(guess, ["src", "dst"]).select("src", "dst", (F.abs(F.col("guess") - F.col("r")) <= 0.3 * F.col("r")).alias("within"))


@register(within(""))
def r8_c3_estimated_centrality(spark, d):
    edges, scratch = geo(spark, d)
    return _held(C.estimated_centrality(edges, 200), C.exact_centrality(edges), "centrality", 0.1)


@register(query(GEO + BOTH, "SELECT node, target, true AS within, true AS rest_within FROM nodes, (SELECT unnest([99, 100])::BIGINT AS target) WHERE node <> target"))
def r9_r10_distances_to_marked(spark, d):
    edges, scratch = geo(spark, d)
    marked = spark.createDataFrame([(99,), (100,)], "node long")
    guess = R.Estimates(edges, 200).farness_and_distance(marked).toDF("node", "target", "guess", "rest")
    m = Classes(edges, scratch)
    pairs = E.nodes(edges).crossJoin(marked.toDF("target")).filter("node <> target")  # two rows a node
    pairs = scratch.table(m.pair_resistance(pairs, "node", "target"), "pairs")
    near = pairs.groupBy("node").agg(F.sum("r").alias("near"))
    truth = pairs.join(m.farness_of_pairs().join(near, "node").selectExpr("node", "farness - near AS others"), "node")
    held = lambda a, b, s: (F.abs(F.col(a) - F.col(b)) <= s * F.col(b)).alias("within")
    return truth.join(guess, ["node", "target"]).select("node", "target", held("guess", "r", 0.3), held("rest", "others", 0.1).alias("rest_within"))


@register("SELECT true AS within")
def r13_trace_estimate(spark, d):
    edges, scratch = geo(spark, d)
    truth = C.exact_centrality(edges).filter("node = 99").select("farness")
    return R.Estimates(edges, 200, ground=(99,)).trace().crossJoin(truth).select((F.abs(F.col("trace") - F.col("farness")) <= 0.1 * F.col("farness")).alias("within"))


@register(within("WHERE node <> 99"))
def r14_squares_estimate(spark, d):
    edges, scratch = geo(spark, d)
    return _held(R.Estimates(edges, 200, ground=(99,)).squares(), Classes(edges, scratch).ground(99).column_squares(), "value", 0.3)


@register(within("WHERE node <> 99"))
def r15_r16_split_diagonal(spark, d):
    edges, scratch = geo(spark, d)
    e = R.Estimates(edges, 200, ground=(99,))
    both = e.inner_part().union(e.boundary_part()).groupBy("node").agg(F.sum("value").alias("value"))
    return _held(both, Classes(edges, scratch).ground(99).diagonal(), "value", 0.3)


@register("SELECT true AS near_best")
def c4_estimated_most_central(spark, d):
    edges, scratch = geo(spark, d)
    best = C.most_central(edges).select(F.col("centrality").alias("best"))
    return C.estimated_most_central(edges, 200).crossJoin(best).select((F.col("centrality") >= 0.9 * F.col("best")).alias("near_best"))


@register("SELECT true AS near_best")
def c7_estimated_greedy(spark, d):
    edges, scratch = geo(spark, d)
    ranked, _ = C.estimated_greedy(edges, 3, scratch, 100)
    group = [r["node"] for r in ranked.filter("rank = 1").orderBy("step").collect()]  # three nodes
    value = C.exact_greedy(edges, 3, scratch, given=group)[1]
    best = C.exact_greedy(edges, 3, scratch)[1].select(F.col("centrality").alias("best"))
    return value.crossJoin(best).select((F.col("centrality") >= 0.9 * F.col("best")).alias("near_best"))


@register("SELECT true AS within")
def c9_given_group_estimate(spark, d):
    edges, scratch = geo(spark, d)
    guess = C.estimated_greedy(edges, 2, scratch, 50, given=[100, 103])[1].select(F.col("centrality").alias("guess"))
    truth = C.exact_greedy(edges, 2, scratch, given=[100, 103])[1]
    return truth.crossJoin(guess).select((F.abs(F.col("guess") - F.col("centrality")) <= 0.1 * F.col("centrality")).alias("within"))


@register(query(TRADE + ", edges AS (SELECT DISTINCT least(a, b)::BIGINT AS src, greatest(a, b)::BIGINT AS dst FROM nation_trade WHERE a <> b)" + BOTH, "SELECT node, degree FROM degrees"))
def a2_trade_degrees(spark, d):
    return E.degrees(trade_edges(spark, d))
