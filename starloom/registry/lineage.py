"""Graphs: supply edges from the facts, and the customers' referral tree."""

from pyspark.sql import functions as F

from starloom.operators import coverage as cov
from starloom.operators import lineage as g
from starloom.registry import derived as d
from starloom.registry.base import CTES, query, table

CTES["supply"] = """
SELECT DISTINCT 'S' || l_suppkey AS source_id, 'P' || l_partkey AS target_id FROM lineitem
UNION ALL SELECT DISTINCT 'P' || l_partkey, 'O' || l_orderkey FROM lineitem UNION ALL SELECT DISTINCT 'O' || o_orderkey, 'C' || o_custkey FROM orders"""


def supply(spark, sf):
    """supplier -> part -> order -> customer."""
    li = table(spark, sf, "lineitem")
    # Keys are made distinct before they become texts: numbers are a third as wide.
    edge = lambda df, a, pa, b, pb: df.select(a, b).distinct().select(d.text(pa, a).alias("source_id"), d.text(pb, b).alias("target_id"))
    return edge(li, "l_suppkey", "S", "l_partkey", "P").unionByName(edge(li, "l_partkey", "P", "l_orderkey", "O")).unionByName(edge(table(spark, sf, "orders"), "o_orderkey", "O", "o_custkey", "C"))


@query("lineage_closure", """
WITH RECURSIVE walk AS (SELECT 'S' || s_suppkey AS node_id FROM supplier WHERE s_acctbal > 9500 UNION SELECT e.target_id FROM walk w JOIN supply e ON e.source_id = w.node_id)
SELECT node_id, CASE substr(node_id, 1, 1) WHEN 'S' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS depth FROM walk""")
def lineage_closure(spark, sf):
    seeds = table(spark, sf, "supplier").where("s_acctbal > 9500").select(d.text("S", "s_suppkey").alias("node_id"))
    return g.closure(supply(spark, sf), seeds)


@query("metadata_references", """
SELECT o_orderkey AS edge_id, o_custkey AS source_id, l AS target_id, 'target_id' AS missing_end FROM (SELECT o_orderkey, o_custkey, o_orderkey % 2500 AS l FROM orders) WHERE l NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT o_orderkey, o_custkey, o_orderkey % 2500, 'source_id' FROM orders WHERE o_custkey NOT IN (SELECT p_partkey FROM part)""")
def metadata_references(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 2500).alias("target_id"))
    return g.unresolved_edges(edges, table(spark, sf, "part"), "p_partkey")


# Referral tree: customer n was referred by customer (n - 1) div 2; a customer with
# a strongly negative balance also refers back to its own referrer.
CTES["referral"] = """
SELECT (c_custkey - 1) // 2 AS source_id, c_custkey AS target_id FROM customer WHERE c_custkey > 0
UNION ALL SELECT c_custkey, (c_custkey - 1) // 2 FROM customer WHERE c_custkey > 60 AND c_acctbal < -900"""


def referral(spark, sf, back=True):
    c = table(spark, sf, "customer").select("c_custkey", F.expr("(c_custkey - 1) div 2").alias("p"), "c_acctbal")
    down = c.where("c_custkey > 0").select(F.col("p").alias("source_id"), F.col("c_custkey").alias("target_id"))
    return down.unionByName(c.where("c_custkey > 60 AND c_acctbal < -900").select(F.col("c_custkey").alias("source_id"), F.col("p").alias("target_id"))) if back else down


@query("lineage_cycles", """
WITH RECURSIVE fed AS (SELECT unnest([c_custkey, (c_custkey - 1) // 2]) AS node_id FROM customer WHERE c_custkey > 60 AND c_acctbal < -900 UNION SELECT r.target_id FROM fed f JOIN referral r ON r.source_id = f.node_id)
SELECT DISTINCT node_id FROM fed""")
def lineage_cycles(spark, sf):
    return g.cyclic_nodes(referral(spark, sf))


@query("lineage_upstream_only", """
WITH RECURSIVE t AS (SELECT c_custkey AS table_id, CASE WHEN c_acctbal > 9000 THEN 'replacement_mapping' WHEN c_acctbal > 4000 THEN 'missing_target' WHEN c_acctbal > 1000 THEN 'missing_evidence' ELSE 'explicit_exclusion' END AS classification, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS n_mappings FROM customer),
up AS (SELECT table_id FROM t WHERE classification = 'replacement_mapping' UNION SELECT (u.table_id - 1) // 2 FROM up u JOIN customer ON c_custkey = u.table_id WHERE u.table_id > 0 AND c_nationkey <> 5)
SELECT table_id FROM t WHERE classification IN ('missing_target', 'missing_evidence') AND n_mappings = 0 AND table_id IN (SELECT table_id FROM up)""")
def lineage_upstream_only(spark, sf):
    c = table(spark, sf, "customer")
    edges = c.where("c_custkey > 0").select(F.expr("(c_custkey - 1) div 2").alias("source_id"), F.col("c_custkey").alias("target_id"), F.when(F.col("c_nationkey") == 5, "inferred").otherwise("observed").alias("status"))
    bal = F.col("c_acctbal")
    kind = F.when(bal > 9000, "replacement_mapping").when(bal > 4000, "missing_target").when(bal > 1000, "missing_evidence").otherwise("explicit_exclusion")
    tables = c.select(F.col("c_custkey").alias("table_id"), kind.alias("classification"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1).otherwise(0).alias("n_mappings"))
    return g.upstream_only(edges, tables)


@query("lineage_hub_edges", """
SELECT 'c' || o_custkey AS source_id, 'o' || o_orderkey AS target_id, 'source' AS side FROM orders UNION ALL SELECT 'p' || o_orderpriority, 'o' || o_orderkey, 'source' FROM orders
UNION ALL SELECT 'o' || o_orderkey, 's' || o_orderstatus, 'target' FROM orders UNION ALL SELECT 'o' || o_orderkey, 'm' || month(o_orderdate), 'target' FROM orders""")
def lineage_hub_edges(spark, sf):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    mappings = table(spark, sf, "orders").select(
        text("o", F.col("o_orderkey")).alias("mapping_id"), F.array(text("c", F.col("o_custkey")), text("p", F.col("o_orderpriority"))).alias("sources"),
        F.array(text("s", F.col("o_orderstatus")), text("m", F.month("o_orderdate"))).alias("targets"))
    return g.hub_edges(mappings, "mapping_id", "sources", "targets")


@query("dependency_prune", """
WITH RECURSIVE dead AS (SELECT c_custkey AS item_id FROM customer WHERE c_acctbal < -800 UNION SELECT c.c_custkey FROM dead d JOIN customer c ON (c.c_custkey - 1) // 2 = d.item_id AND c.c_custkey > 0)
SELECT c_custkey AS item_id FROM customer WHERE c_custkey NOT IN (SELECT item_id FROM dead)""")
def dependency_prune(spark, sf):
    items = table(spark, sf, "customer").where("c_acctbal >= -800").select(F.col("c_custkey").alias("item_id"))
    needs = referral(spark, sf, back=False).select(F.col("target_id").alias("item_id"), F.col("source_id").alias("needs_id"))
    return g.prune_dependents(items, needs)


@query("tree_integrity", """
WITH n AS (SELECT r_regionkey AS tree_id, 'r' || r_regionkey AS node_id, NULL AS parent_id, ['r' || r_regionkey] AS path FROM region
 UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, ['r' || n_regionkey, 'n' || n_nationkey] FROM nation
 UNION ALL SELECT n_regionkey, 'c' || c_custkey, CASE WHEN c_acctbal < -950 THEN 'n-1' ELSE 'n' || c_nationkey END, ['r' || n_regionkey, CASE WHEN c_acctbal > 9900 THEN 'n?' ELSE 'n' || c_nationkey END, 'c' || c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, ['r' || n_regionkey, 'n' || c_nationkey, 'c' || c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 5000 AND 5100)
SELECT tree_id, nodes, roots, path_mismatches, duplicate_nodes, edges, unresolved_edges, CASE WHEN roots = 1 AND edges = nodes - 1 AND path_mismatches + duplicate_nodes + unresolved_edges = 0 THEN 'complete' ELSE 'failed' END AS status FROM (
 SELECT a.tree_id, count(*) AS nodes, count(*) FILTER (WHERE a.parent_id IS NULL) AS roots, count(*) FILTER (WHERE a.parent_id IS NOT NULL AND (p.path IS NULL OR p.path <> a.path[1:-2])) AS path_mismatches, count(*) - count(DISTINCT a.node_id) AS duplicate_nodes,
        count(a.parent_id) AS edges, count(*) FILTER (WHERE a.parent_id IS NOT NULL AND p.node_id IS NULL) AS unresolved_edges
 FROM n a LEFT JOIN (SELECT DISTINCT tree_id, node_id, path FROM n WHERE substr(node_id, 1, 1) <> 'c') p ON a.tree_id = p.tree_id AND a.parent_id = p.node_id GROUP BY 1)""")
def tree_integrity(spark, sf):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = table(spark, sf, "nation")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("tree_id"), text("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.array(text("r", "r_regionkey")).alias("path"))
    n = nation.select(F.col("n_regionkey").alias("tree_id"), text("n", "n_nationkey").alias("node_id"), text("r", "n_regionkey").alias("parent_id"), F.array(text("r", "n_regionkey"), text("n", "n_nationkey")).alias("path"))
    c = table(spark, sf, "customer").join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    up = text("n", "c_nationkey")
    places = lambda parent, middle: F.struct(parent.alias("parent_id"), F.array(text("r", "n_regionkey"), middle, text("c", "c_custkey")).alias("path"))
    first = places(F.when(F.col("c_acctbal") < -950, "n-1").otherwise(up), F.when(F.col("c_acctbal") > 9900, "n?").otherwise(up))
    twice = F.when(F.col("c_acctbal").between(5000, 5100), F.array(first, places(up, up))).otherwise(F.array(first))
    c = c.select(F.col("n_regionkey").alias("tree_id"), text("c", "c_custkey").alias("node_id"), F.explode(twice).alias("p")).select("tree_id", "node_id", "p.*")
    nodes = r.unionByName(n).unionByName(c)
    edges = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("from_id"), F.col("node_id").alias("to_id"))
    return g.tree_diagnostics(nodes, edges)


@query("context_closure", """
WITH RECURSIVE up AS (SELECT p_partkey AS node_id, p_partkey AS pos FROM part UNION ALL SELECT u.node_id, u.pos // 3 FROM up u JOIN part p ON p.p_partkey = u.pos WHERE p.p_size > 25 AND u.pos > 0)
SELECT node_id, min(pos) AS component FROM up GROUP BY 1""")
def context_closure(spark, sf):
    """A part is tied to part (key div 3) when its size is above 25, and otherwise to itself only."""
    p = table(spark, sf, "part")
    edges = p.select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") > 25, F.expr("p_partkey div 3")).otherwise(F.col("p_partkey")).alias("target_id"))
    return g.components(edges)


def packages(spark, sf):
    bal = F.col("c_acctbal")
    level = F.when(bal < -985, 0).when(bal < 1000, 1).when(bal < 6000, 2).when(bal < 9800, 3).otherwise(4)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), level.alias("own_level"), bal.between(9500, 9600).alias("is_blocked"))


@query("effort_propagation", """
WITH RECURSIVE pk AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < -985 THEN 0 WHEN c_acctbal < 1000 THEN 1 WHEN c_acctbal < 6000 THEN 2 WHEN c_acctbal < 9800 THEN 3 ELSE 4 END AS lv, CASE WHEN c_acctbal BETWEEN 9500 AND 9600 THEN 1 ELSE 0 END AS bl FROM customer),
up AS (SELECT id AS node_id, id AS pos FROM pk UNION ALL SELECT node_id, (pos - 1) // 2 FROM up WHERE pos > 0),
f AS (SELECT node_id, max(lv) AS level, max(bl) AS blocked, max(CASE WHEN lv = 0 THEN 1 ELSE 0 END) AS unknown FROM up JOIN pk ON pk.id = up.pos GROUP BY 1)
SELECT f.node_id, CASE WHEN unknown = 0 THEN level END AS level, CASE WHEN unknown = 1 THEN 'needs_discovery' WHEN blocked = 1 THEN 'blocked' ELSE 'ready' END AS readiness, unknown = 0 AND level > lv AS is_inherited FROM f JOIN pk ON pk.id = f.node_id""")
def effort_propagation(spark, sf):
    return cov.propagate_effort(packages(spark, sf), referral(spark, sf, back=False))


@query("effort_reasons", """
WITH RECURSIVE pk AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < -985 THEN 0 WHEN c_acctbal < 1000 THEN 1 WHEN c_acctbal < 6000 THEN 2 WHEN c_acctbal < 9800 THEN 3 ELSE 4 END AS lv, CASE WHEN c_acctbal BETWEEN 9500 AND 9600 THEN 1 ELSE 0 END AS bl FROM customer),
up AS (SELECT id AS node_id, id AS pos FROM pk UNION ALL SELECT node_id, (pos - 1) // 2 FROM up WHERE pos > 0),
f AS (SELECT node_id, max(lv) AS level, max(bl) AS blocked, max(CASE WHEN lv = 0 THEN 1 ELSE 0 END) AS unknown FROM up JOIN pk ON pk.id = up.pos GROUP BY 1),
d AS (SELECT f.node_id, CASE WHEN unknown = 0 THEN level END AS level, unknown = 0 AND blocked = 1 AS stopped FROM f)
SELECT id AS node_id, 'own_blocker' AS reason, NULL::BIGINT AS prerequisite_id FROM pk WHERE bl = 1 UNION ALL SELECT id, 'unknown_level', NULL FROM pk WHERE lv = 0
UNION ALL SELECT id, 'unassessed_prerequisite', node_id FROM pk JOIN d ON node_id = (id - 1) // 2 WHERE id > 0 AND level IS NULL
UNION ALL SELECT id, 'blocked_prerequisite', node_id FROM pk JOIN d ON node_id = (id - 1) // 2 WHERE id > 0 AND stopped
UNION ALL SELECT id, 'harder_prerequisite', node_id FROM pk JOIN d ON node_id = (id - 1) // 2 WHERE id > 0 AND lv > 0 AND level > lv""")
def effort_reasons(spark, sf):
    return cov.effort_reasons(packages(spark, sf), referral(spark, sf, back=False))
