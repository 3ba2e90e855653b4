"""SQL of the graph queries, for DuckDB: the graphs as common tables, and the steps that queries share."""

from __future__ import annotations

TRADE = """
nation_trade AS (
  SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2)"""

GEO = (
    TRADE
    + """,
geo_pairs AS (
  SELECT 99 AS u, r_regionkey + 100 AS v FROM region
  UNION ALL SELECT n_nationkey, n_regionkey + 100 FROM nation
  UNION ALL SELECT s_nationkey, s_suppkey + 1000 FROM supplier
  UNION ALL SELECT a, b FROM (
    SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY quantity DESC, b) AS first
    FROM nation_trade JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey
    WHERE a <> b AND x.n_regionkey = y.n_regionkey) WHERE first = 1),
edges AS (SELECT DISTINCT least(u, v)::BIGINT AS src, greatest(u, v)::BIGINT AS dst FROM geo_pairs WHERE u <> v)"""
)

SPARSE = """
sold AS (SELECT o_custkey AS c, l_suppkey + 1000000 AS s, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
main AS (
  SELECT c, s FROM (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY quantity DESC, s) AS k FROM sold) WHERE k = 1
  UNION ALL SELECT c, s FROM (SELECT c, s, row_number() OVER (PARTITION BY s ORDER BY quantity DESC, c) AS k FROM sold) WHERE k = 1),
edges AS (SELECT DISTINCT least(c, s)::BIGINT AS src, greatest(c, s)::BIGINT AS dst FROM main)"""

ORDER_PART = """
edges AS (SELECT DISTINCT l_orderkey::BIGINT AS src, (l_partkey + 1000000000)::BIGINT AS dst FROM lineitem)"""

BOTH = """,
both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
nodes AS (SELECT DISTINCT src AS node FROM both_ways),
degrees AS (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY 1)"""

#: Least labels spread along edges until none falls.
COMPONENTS = """,
spread(node, label, round) AS (
  SELECT node, node, 0 FROM nodes
  UNION ALL
  SELECT node, label, round FROM (
    SELECT x.node, least(min(x.label), min(coalesce(y.label, x.label))) AS label, min(x.label) AS was, max(x.round) + 1 AS round
    FROM spread x LEFT JOIN both_ways e ON x.node = e.src LEFT JOIN spread y ON y.node = e.dst GROUP BY x.node)
  WHERE round <= (SELECT count(*) FROM nodes) AND round <= 60),
components AS (SELECT node, min(label) AS component FROM spread GROUP BY 1)"""

#: An edge is a bridge if its ends aren't connected without it.
BRIDGES = """,
reach(a, b, node) AS (
  SELECT src, dst, src FROM edges
  UNION
  SELECT r.a, r.b, e.dst FROM reach r JOIN both_ways e ON r.node = e.src
  WHERE NOT ((e.src = r.a AND e.dst = r.b) OR (e.src = r.b AND e.dst = r.a))),
bridges AS (
  SELECT src, dst, CASE WHEN x.degree = 1 OR y.degree = 1 THEN 'leaf' ELSE 'inner' END AS kind
  FROM edges e JOIN degrees x ON x.node = src JOIN degrees y ON y.node = dst
  WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.a = e.src AND r.b = e.dst AND r.node = e.dst))"""

#: Blocks: components without bridges, of the nodes that are no leaves.
BLOCKS = """,
ext AS (SELECT e.dst AS node, count(*) AS ext FROM both_ways e JOIN degrees d ON d.node = e.src AND d.degree = 1 GROUP BY 1),
core AS (SELECT node FROM degrees WHERE degree > 1),
kept AS (SELECT src, dst FROM both_ways e WHERE NOT EXISTS (SELECT 1 FROM bridges b WHERE b.src = least(e.src, e.dst) AND b.dst = greatest(e.src, e.dst))),
within(node, other) AS (SELECT node, node FROM core UNION SELECT w.node, k.dst FROM within w JOIN kept k ON k.src = w.other),
blocks AS (
  SELECT min(w.other) AS block, w.node, bool_or(w.node IN (SELECT unnest([src, dst]) FROM bridges WHERE kind = 'inner')) AS is_link, coalesce(max(x.ext), 0) AS ext
  FROM within w LEFT JOIN ext x ON x.node = w.node GROUP BY w.node)"""

#: The pseudo-inverse: L + J/n inverted in place, a pivot a step, less 1/n.
INVERSE = """,
idx AS (SELECT node, row_number() OVER (ORDER BY node) AS k, count(*) OVER () AS n FROM nodes),
gj(step, r, c, val) AS (
  SELECT 0, x.k, y.k, CASE WHEN x.k = y.k THEN d.degree::DOUBLE WHEN e.src IS NOT NULL THEN -1.0 ELSE 0.0 END + 1.0 / x.n
  FROM idx x CROSS JOIN idx y JOIN degrees d ON d.node = x.node LEFT JOIN both_ways e ON e.src = x.node AND e.dst = y.node
  UNION ALL
  SELECT g.step + 1, g.r, g.c,
    CASE WHEN g.r = g.step + 1 AND g.c = g.step + 1 THEN 1.0 / p.val WHEN g.r = g.step + 1 THEN g.val / p.val
         WHEN g.c = g.step + 1 THEN -g.val / p.val ELSE g.val - x.val * y.val / p.val END
  FROM gj g JOIN gj x ON x.r = g.r AND x.c = g.step + 1 JOIN gj y ON y.c = g.c AND y.r = g.step + 1 JOIN gj p ON p.r = g.step + 1 AND p.c = g.step + 1
  WHERE g.step < (SELECT count(*) FROM nodes)),
inverse AS (
  SELECT x.node AS i, y.node AS j, val - 1.0 / x.n AS val FROM gj JOIN idx x ON x.k = r JOIN idx y ON y.k = c WHERE step = (SELECT count(*) FROM nodes)),
diag AS (SELECT i AS node, val FROM inverse WHERE i = j),
pairs AS (SELECT i AS u, j AS v, x.val + y.val - 2 * m.val AS r FROM inverse m JOIN diag x ON x.node = i JOIN diag y ON y.node = j),
far AS (SELECT u AS node, sum(r) AS farness FROM pairs GROUP BY 1)"""


def query(*parts: str, recursive: bool = False) -> str:
    """The parts but the last are common tables; the last is the query itself."""
    return ("WITH RECURSIVE" if recursive else "WITH") + "".join(parts[:-1]) + "\n" + parts[-1]
