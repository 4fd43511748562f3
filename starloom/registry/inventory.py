"""Metadata comparison, coverage and classification.

Parts are read as documented columns (brand = relation), orders as objects,
documents as files, so the inventories grow with the tables.
"""

from pyspark.sql import functions as F

from starloom.functions.scalars import cents
from starloom.operators import coverage as c
from starloom.operators import metadata as m
from starloom.operators import prefix
from starloom.registry.base import CTES, query, table

CTES["declared"] = """
SELECT CASE WHEN p_brand = 'Brand#9' THEN 'Brand#09' ELSE p_brand END AS relation, CASE WHEN p_size = 1 THEN 'old' ELSE 'c' END || p_partkey AS column_name, p_type AS data_type, p_size % 2 = 0 AS nullable, p_name AS description, CASE WHEN p_size = 1 THEN -1 - p_partkey ELSE p_partkey END AS id FROM part"""
CTES["physical"] = """
SELECT CASE WHEN p_brand = 'Brand#7' THEN 'Brand#07' ELSE p_brand END AS relation, CASE WHEN p_size = 50 THEN 'new' ELSE 'c' END || p_partkey AS column_name, CASE WHEN p_size = 2 THEN 'OTHER' ELSE p_type END AS data_type,
       CASE WHEN p_size = 3 THEN true ELSE p_size % 2 = 0 END AS nullable, CASE WHEN p_size = 4 THEN NULL WHEN p_size = 5 THEN upper(p_name) WHEN p_size = 6 THEN ' ' ELSE p_name END AS description, CASE WHEN p_size = 50 THEN -1 - p_partkey ELSE p_partkey END AS id
FROM part"""


def declared(spark, sf):
    relation = F.when(F.col("p_brand") == "Brand#9", "Brand#09").otherwise(F.col("p_brand"))
    name = F.concat(F.when(F.col("p_size") == 1, "old").otherwise("c"), "p_partkey")
    return table(spark, sf, "part").select(
        relation.alias("relation"), name.alias("column_name"), F.col("p_type").alias("data_type"), (F.col("p_size") % 2 == 0).alias("nullable"), F.col("p_name").alias("description"),
        F.when(F.col("p_size") == 1, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("id"))


def physical(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.when(F.col("p_brand") == "Brand#7", "Brand#07").otherwise(F.col("p_brand")).alias("relation"), F.concat(F.when(size == 50, "new").otherwise("c"), "p_partkey").alias("column_name"),
        F.when(size == 2, "OTHER").otherwise(F.col("p_type")).alias("data_type"), ((size == 3) | (size % 2 == 0)).alias("nullable"),
        F.when(size == 5, F.upper("p_name")).when(size == 6, " ").when(size != 4, F.col("p_name")).alias("description"),
        F.when(size == 50, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("id"))


@query("schema_reconcile", """
SELECT DISTINCT relation, NULL AS column_name, 'missing_relation' AS finding FROM declared WHERE relation NOT IN (SELECT relation FROM physical)
UNION ALL SELECT DISTINCT relation, NULL, 'undocumented_relation' FROM physical WHERE relation NOT IN (SELECT relation FROM declared)
UNION ALL SELECT relation, column_name, 'missing_column' FROM declared d WHERE relation IN (SELECT relation FROM physical) AND NOT EXISTS (SELECT 1 FROM physical p WHERE p.relation = d.relation AND p.column_name = d.column_name)
UNION ALL SELECT relation, column_name, 'undocumented_column' FROM physical d WHERE relation IN (SELECT relation FROM declared) AND NOT EXISTS (SELECT 1 FROM declared p WHERE p.relation = d.relation AND p.column_name = d.column_name)""")
def schema_reconcile(spark, sf):
    return m.schema_reconcile(declared(spark, sf), physical(spark, sf))


@query("schema_type_drift", """
SELECT d.relation, d.column_name, d.data_type AS raw_type, p.data_type AS native_type, d.data_type AS normalized_type, d.data_type <> p.data_type AS type_drift, d.nullable <> p.nullable AS nullability_drift
FROM declared d JOIN physical p USING (relation, column_name) WHERE d.data_type <> p.data_type OR d.nullable <> p.nullable""")
def schema_type_drift(spark, sf):
    return m.type_drift(declared(spark, sf), physical(spark, sf), declared(spark, sf))


@query("metadata_readback", """
SELECT d.relation, count(*) AS expected, count(*) FILTER (WHERE d.description = p.description) AS matched, count(*) FILTER (WHERE d.description <> p.description) AS different,
       count(*) FILTER (WHERE p.description IS NULL) AS absent, count(*) FILTER (WHERE p.column_name IS NULL) AS column_missing FROM declared d LEFT JOIN physical p ON d.relation = p.relation AND d.column_name = p.column_name GROUP BY 1""")
def metadata_readback(spark, sf):
    return m.readback(declared(spark, sf), physical(spark, sf), "description", ["relation"])


@query("environment_parity", """
SELECT coalesce(d.relation, p.relation) AS relation, coalesce(d.column_name, p.column_name) AS column_name, CASE WHEN p.id IS NULL THEN 'only_in_first' WHEN d.id IS NULL THEN 'only_in_second' ELSE 'different' END AS issue
FROM declared d FULL OUTER JOIN physical p ON d.relation = p.relation AND d.column_name = p.column_name
WHERE (d.id IS NULL OR p.id IS NULL OR d.data_type <> p.data_type OR d.nullable <> p.nullable) AND coalesce(d.relation, p.relation) NOT IN ('Brand#9', 'Brand#3')""")
def environment_parity(spark, sf):
    first, second = declared(spark, sf), physical(spark, sf)
    listed = first.select("relation", "column_name").unionByName(second.select("relation", "column_name"))
    exceptions = listed.where("relation IN ('Brand#9', 'Brand#3')").distinct()
    return m.environment_diff(first, second, ["data_type", "nullable"], exceptions)


@query("metadata_emit", """
SELECT relation, column_name, 'ALTER TABLE `' || relation || '` ALTER COLUMN `' || column_name || '` COMMENT ''' || replace(description || '''s part', '''', '''''') || '''' AS statement FROM physical WHERE description IS NOT NULL""")
def metadata_emit(spark, sf):
    return m.comment_statements(physical(spark, sf).withColumn("description", F.concat("description", F.lit("'s part"))))


@query("contract_diff", """
WITH j AS (SELECT coalesce(d.id, p.id) AS id, d.id AS di, p.id AS pi, d.data_type AS dt, p.data_type AS pt, d.description AS dd, p.description AS pd, d.relation AS dr, p.relation AS pr FROM declared d FULL OUTER JOIN physical p ON d.id = p.id)
SELECT id, 'removed' AS change, true AS is_breaking FROM j WHERE pi IS NULL UNION ALL SELECT id, 'added', false FROM j WHERE di IS NULL
UNION ALL SELECT id, 'renamed', true FROM j WHERE di = pi AND dr <> pr UNION ALL SELECT id, 'data_type_changed', true FROM j WHERE di = pi AND dt <> pt UNION ALL SELECT id, 'description_changed', false FROM j WHERE di = pi AND dd IS DISTINCT FROM pd""")
def contract_diff(spark, sf):
    return m.contract_diff(declared(spark, sf), physical(spark, sf), ["id"], "relation", ["data_type", "description"])


# Event types a scope has to report.
COMPONENTS = ["click", "error", "purchase", "refund", "signup", "view"]


@query("catalog_completeness", """
WITH x AS (SELECT user_id AS scope, event_type AS component, ts AS captured_at, CASE WHEN value > 200 THEN 'partial' ELSE 'complete' END AS status FROM events),
p AS (SELECT scope, component, count(*) AS n, max(captured_at) AS latest, count(*) FILTER (WHERE status <> 'complete') AS bad FROM x GROUP BY 1, 2)
SELECT scope, component, 'stale' AS finding FROM p WHERE datediff('day', CAST(latest AS DATE), DATE '2024-02-01') > 7 UNION ALL SELECT scope, component, 'incomplete' FROM p WHERE bad > 0 UNION ALL SELECT scope, component, 'repeated' FROM p WHERE n > 1
UNION ALL SELECT s.scope, c.component, 'missing' FROM (SELECT DISTINCT scope FROM x) s, (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) c(component) WHERE (s.scope, c.component) NOT IN (SELECT (scope, component) FROM p)""")
def catalog_completeness(spark, sf):
    extracts = table(spark, sf, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("component"), F.col("ts").alias("captured_at"), F.when(F.col("value") > 200, "partial").otherwise("complete").alias("status"))
    return m.catalog_findings(extracts, COMPONENTS, "2024-02-01", 7)


CTES["models"] = """
SELECT p_partkey AS model_id, CASE WHEN p_size = 1 THEN [] ELSE [p_type] END AS keys, [p_partkey // 2, CASE WHEN p_size = 2 THEN -p_partkey - 1 ELSE p_partkey // 3 END] AS depends_on FROM part
UNION ALL SELECT p_partkey, [p_type], [] FROM part WHERE p_size = 3"""
CTES["links"] = """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS relation_id, min(l_partkey) AS to_model, min(l_partkey) AS fm FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def models(spark, sf):
    p = table(spark, sf, "part")
    size, k = F.col("p_size"), F.col("p_partkey")
    keys = F.when(size == 1, F.array().cast("array<string>")).otherwise(F.array("p_type"))
    needs = F.array(F.floor(k / 2), F.when(size == 2, -k - 1).otherwise(F.floor(k / 3)))
    base = p.select(k.alias("model_id"), keys.alias("keys"), needs.alias("depends_on"))
    return base.unionByName(p.where("p_size = 3").select(k.alias("model_id"), F.array("p_type").alias("keys"), F.array().cast("array<bigint>").alias("depends_on")))


@query("design_consistency", """
WITH rel AS (SELECT 'r' || relation_id AS relation_id, to_model, CASE WHEN relation_id % 7 = 0 THEN ['a', 'b'] ELSE ['a'] END AS from_keys, CASE WHEN relation_id % 11 = 0 THEN ['PROMO'] ELSE NULL END AS forced FROM links),
r2 AS (SELECT r.*, coalesce(forced, [p_type]) AS to_keys, p_type, p_size FROM rel r JOIN part ON to_model = p_partkey)
SELECT CAST(model_id AS VARCHAR) AS entity, 'duplicate_id' AS finding FROM models GROUP BY model_id HAVING count(*) > 1
UNION ALL SELECT CAST(model_id AS VARCHAR), 'missing_key' FROM models WHERE len(keys) = 0
UNION ALL SELECT CAST(model_id AS VARCHAR), 'unknown_dependency' FROM (SELECT model_id, unnest(depends_on) AS d FROM models) WHERE d NOT IN (SELECT model_id FROM models)
UNION ALL SELECT relation_id, 'relationship_arity' FROM r2 WHERE len(from_keys) <> len(to_keys)
UNION ALL SELECT relation_id, 'relationship_key_mismatch' FROM r2 WHERE to_keys <> CASE WHEN p_size = 1 THEN [] ELSE [p_type] END""")
def design_consistency(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("to_model"), "p_type")
    links = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("to_model"))
    rid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rel = links.join(part, "to_model").select(
        F.concat(F.lit("r"), rid.cast("string")).alias("relation_id"), "to_model", F.when(rid % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("from_keys"),
        F.when(rid % 11 == 0, F.array(F.lit("PROMO"))).otherwise(F.array("p_type")).alias("to_keys"))
    return m.design_findings(models(spark, sf), rel)


@query("design_compare", """
SELECT p_type, p_name, CASE WHEN a > b THEN 'only_in_design' ELSE 'only_in_review' END AS side, abs(a - b) AS copies FROM (
  SELECT p_type, p_name, count(*) FILTER (WHERE p_size <= 25) AS a, count(*) FILTER (WHERE p_size > 25) AS b FROM part GROUP BY 1, 2) WHERE a <> b""")
def design_compare(spark, sf):
    p = table(spark, sf, "part")
    return m.multiset_diff(p.where("p_size <= 25"), p.where("p_size > 25"), ["p_type", "p_name"])


@query("proposal_reconcile", """
SELECT p_name, count(*) AS n_proposals, concat_ws(',', CASE WHEN min(p_brand) <> max(p_brand) THEN 'p_brand' END, CASE WHEN min(p_type) <> max(p_type) THEN 'p_type' END, CASE WHEN min(p_size) <> max(p_size) THEN 'p_size' END) AS disagreements,
       CASE WHEN min(p_brand) <> max(p_brand) OR min(p_type) <> max(p_type) OR min(p_size) <> max(p_size) THEN 'disagreed' ELSE 'agreed' END AS status FROM part GROUP BY 1""")
def proposal_reconcile(spark, sf):
    return m.merge_proposals(table(spark, sf, "part"), "p_name", ["p_brand", "p_type", "p_size"])


@query("dictionary_coverage", """
SELECT coalesce(d.relation, p.relation) AS relation, count(*) FILTER (WHERE d.id IS NOT NULL AND p.id IS NOT NULL) AS documented, count(*) FILTER (WHERE p.id IS NULL) AS undocumented, count(*) FILTER (WHERE d.id IS NULL) AS unknown,
       count(*) FILTER (WHERE p.id IS NOT NULL AND (p.description IS NULL OR trim(p.description) = '')) AS missing_description, CAST(0 AS BIGINT) AS missing_data_type
FROM declared d FULL OUTER JOIN physical p ON d.relation = p.relation AND d.column_name = p.column_name GROUP BY 1""")
def dictionary_coverage(spark, sf):
    return m.dictionary_coverage(declared(spark, sf), physical(spark, sf), ["description", "data_type"])


@query("column_lineage_join", """
SELECT a.p_partkey AS child_id, b.p_partkey AS parent_id, a.p_brand AS child_relation, a.p_type AS child_type, b.p_brand AS parent_relation, b.p_type AS parent_type, a.p_type = b.p_type AS same_type
FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey > 0""")
def column_lineage_join(spark, sf):
    p = table(spark, sf, "part")
    edges = p.where("p_partkey > 0").select(F.col("p_partkey").alias("child_id"), F.floor(F.col("p_partkey") / 2).alias("parent_id"))
    return m.column_edges(edges, p.select(F.col("p_partkey").alias("column_id"), F.col("p_brand").alias("relation"), F.col("p_type").alias("data_type")))


@query("name_candidates", """
WITH x AS (SELECT lower(p_name) AS name, CASE WHEN p_size > 25 THEN 'source' ELSE 'target' END AS side, p_brand AS relation FROM part),
n AS (SELECT s.name, count(*) AS n_candidates FROM x s JOIN x t ON s.name = t.name AND s.side = 'source' AND t.side = 'target' GROUP BY 1)
SELECT name, side, relation, count(*) AS n_columns, any_value(n_candidates) AS n_candidates FROM x JOIN n USING (name) GROUP BY 1, 2, 3""")
def name_candidates(spark, sf):
    p = table(spark, sf, "part")
    side = lambda test, name: p.where(test).select(name.alias("column_name"), F.col("p_brand").alias("relation"))
    return m.name_candidates(side("p_size > 25", F.upper("p_name")), side("p_size <= 25", F.col("p_name")))


@query("key_divergence", "SELECT p_name, count(DISTINCT p_type) AS n_definitions FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def key_divergence(spark, sf):
    return m.key_divergence(table(spark, sf, "part"), "p_name", "p_type")


@query("rule_conflicts", """
WITH r AS (SELECT p_name AS conflict_key, p_type AS definition, unnest([p_brand, 'all-' || substr(p_brand, 1, 7)]) AS model_id FROM part WHERE p_size <= 30)
SELECT model_id, conflict_key, count(DISTINCT definition) AS n_definitions, count(*) AS n_rules FROM r GROUP BY 1, 2 HAVING count(DISTINCT definition) > 1""")
def rule_conflicts(spark, sf):
    rules = table(spark, sf, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("conflict_key"), F.col("p_type").alias("definition"), F.when(F.col("p_size") <= 30, "accepted").otherwise("proposed").alias("status"),
        F.array("p_brand", F.concat(F.lit("all-"), F.substring("p_brand", 1, 7))).alias("model_ids"))
    return m.rule_conflicts(rules)


CTES["assets"] = "SELECT c_custkey AS asset_id, c_nationkey AS grain, CASE WHEN c_custkey % 50 = 7 THEN ' TBD ' ELSE c_mktsegment END AS population FROM customer"
CTES["asset_measures"] = """
SELECT o_custkey AS asset_id, 'm' || substr(o_orderpriority, 1, 1) AS measure_id,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 1000 = 3 THEN 'Unknown' WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 499000 THEN 'b' ELSE 'a' END AS expression,
       CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 100 = 0 THEN 'ratio' ELSE 'sum' END AS aggregation FROM orders"""


@query("shared_contract_groups", """
WITH open AS (SELECT asset_id FROM assets WHERE population = ' TBD ' UNION SELECT asset_id FROM asset_measures WHERE expression = 'Unknown' AND asset_id IN (SELECT asset_id FROM assets)),
known AS (SELECT * FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM open)),
g AS (SELECT grain, population, count(*) AS n_assets FROM known GROUP BY 1, 2),
v AS (SELECT DISTINCT grain, population, measure_id, expression, aggregation FROM known JOIN asset_measures USING (asset_id)),
w AS (SELECT DISTINCT grain, population, o_orderstatus AS dimension FROM known JOIN orders ON asset_id = o_custkey),
k AS (SELECT grain, population, measure_id, count(*) AS v, min(CASE WHEN aggregation IN ('sum', 'count') THEN 1 ELSE 0 END) AS a FROM v GROUP BY 1, 2, 3),
s AS (SELECT grain, population, max(v) AS v, min(a) AS a, count(*) AS n_measures FROM k GROUP BY 1, 2),
lacking AS (SELECT grain, population FROM v WHERE expression <> 'a' OR aggregation <> 'sum' OR (grain >= 3 AND measure_id > 'm3') UNION SELECT grain, population FROM w WHERE grain = 2 AND dimension = 'P')
SELECT n_assets, coalesce(n_measures, 0) AS n_measures, CASE WHEN v > 1 THEN 'needs_decision' WHEN grain < 6 AND population = 'BUILDING' AND (grain, population) NOT IN (SELECT (grain, population) FROM lacking) THEN 'reuse_candidate'
  WHEN n_assets < 2 THEN 'keep_separate' WHEN coalesce(a, 1) = 1 THEN 'shared_aggregate_candidate' ELSE 'shared_detail_candidate' END AS disposition, count(*) AS n_groups
FROM g LEFT JOIN s USING (grain, population) GROUP BY ALL
UNION ALL SELECT 1, NULL, 'needs_decision', count(*) FROM open""")
def shared_contract_groups(spark, sf):
    """Models of six grains: of three and more they lack two measures, of grain 2 a dimension; some contracts are open."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    assets = c.select(F.col("c_custkey").alias("asset_id"), F.col("c_nationkey").alias("grain"), F.when(F.col("c_custkey") % 50 == 7, " TBD ").otherwise(F.col("c_mktsegment")).alias("population"))
    priority = F.col("o_orderpriority")
    measures = o.select(
        F.col("o_custkey").alias("asset_id"), F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("measure_id"),
        F.when((priority == "1-URGENT") & (F.col("o_orderkey") % 1000 == 3), "Unknown").when((priority == "3-MEDIUM") & (F.col("o_totalprice") > 499000), "b").otherwise("a").alias("expression"),
        F.when((priority == "5-LOW") & (F.col("o_custkey") % 100 == 0), "ratio").otherwise("sum").alias("aggregation"), F.lit("additive").alias("additivity"))
    dimensions = o.select(F.col("o_custkey").alias("asset_id"), F.col("o_orderstatus").alias("dimension"))
    models = table(spark, sf, "nation").where("n_nationkey < 6").select(F.concat(F.lit("model"), "n_nationkey").alias("model_id"), F.col("n_nationkey").alias("grain"), F.lit("BUILDING").alias("population"))
    each = lambda values, name: models.select("model_id", "grain", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    have = each(["m1", "m2", "m3", "m4", "m5"], "measure_id").where("grain < 3 OR measure_id <= 'm3'").select("model_id", "measure_id", F.lit("a").alias("expression"), F.lit("sum").alias("aggregation"), F.lit("additive").alias("additivity"))
    shown = each(["F", "O", "P"], "dimension").where("grain <> 2 OR dimension <> 'P'").select("model_id", "dimension")
    groups = m.shared_contract_groups(assets, measures, models, have, dimensions, shown).groupBy("n_assets", "n_measures", "disposition").agg(F.count("*").alias("n_groups"))
    undecided = m.unknown_contracts(assets, measures).agg(F.count("*").alias("n_groups"))
    return groups.unionByName(undecided.select(F.lit(1).cast("long").alias("n_assets"), F.lit(None).cast("long").alias("n_measures"), F.lit("needs_decision").alias("disposition"), "n_groups"))


# ------------------------------------------------------------------ coverage

CTES["assignments"] = """
SELECT l_orderkey AS object_id, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'excluded' WHEN l_tax = 0.08 THEN 'interface' ELSE 'implementation' END AS kind, l_partkey AS model_id FROM lineitem"""
CTES["target_models"] = "SELECT CASE WHEN p_size > 5 THEN p_partkey ELSE -1 - p_partkey END AS model_id, CASE WHEN p_type = 'PROMO' THEN 'source' ELSE 'model' END AS object_kind FROM part"
CTES["scope"] = """
SELECT o_orderkey AS object_id, CASE WHEN ex > 0 AND ex = n THEN 'excluded' WHEN rl > 0 THEN 'assigned' ELSE 'unresolved' END AS status, coalesce(ex > 0 AND n > ex, false) AS is_conflict, coalesce(mt, 0) AS missing_targets, coalesce(io, 0) AS interface_only
FROM orders LEFT JOIN (SELECT object_id, count(*) AS n, count(*) FILTER (WHERE kind = 'excluded') AS ex, count(*) FILTER (WHERE kind = 'implementation' AND object_kind = 'model') AS rl,
  count(*) FILTER (WHERE kind <> 'excluded' AND object_kind IS NULL) AS mt, count(*) FILTER (WHERE kind = 'implementation' AND object_kind = 'source') AS io FROM assignments LEFT JOIN target_models USING (model_id) GROUP BY 1) ON o_orderkey = object_id"""


def scope(spark, sf):
    objects = table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"))
    kind = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "excluded").when(F.col("l_tax") == 0.08, "interface").otherwise("implementation")
    assignments = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), kind.alias("kind"), F.col("l_partkey").alias("model_id"))
    targets = table(spark, sf, "part").select(F.when(F.col("p_size") > 5, F.col("p_partkey")).otherwise(-1 - F.col("p_partkey")).alias("model_id"), F.when(F.col("p_type") == "PROMO", "source").otherwise("model").alias("object_kind"))
    return c.scope_status(objects, assignments, targets)


@query("scope_coverage", "SELECT status, is_conflict, count(*) AS objects, CAST(sum(missing_targets) AS BIGINT) AS missing_targets, CAST(sum(interface_only) AS BIGINT) AS interface_only FROM scope GROUP BY 1, 2")
def scope_coverage(spark, sf):
    return scope(spark, sf).groupBy("status", "is_conflict").agg(F.count("*").alias("objects"), F.sum("missing_targets").alias("missing_targets"), F.sum("interface_only").alias("interface_only"))


@query("scope_consumers", """
SELECT o_custkey AS consumer_id, count(*) AS objects, count(*) FILTER (WHERE s.object_id IS NULL) AS unknown_objects, count(*) FILTER (WHERE s.status <> 'assigned') AS uncovered_objects
FROM (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_orderkey END AS object_id FROM orders) c LEFT JOIN scope s USING (object_id) GROUP BY 1""")
def scope_consumers(spark, sf):
    lost = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    needs = table(spark, sf, "orders").select(F.col("o_custkey").alias("consumer_id"), F.when(lost, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("object_id"))
    return c.consumer_gaps(needs, scope(spark, sf))


@query("inventory_drift", """
WITH r AS (SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN -1 - doc_id ELSE doc_id END AS doc_id, md5(text) AS sha, CASE WHEN lang = 'es' THEN 'partial' ELSE 'parsed' END AS status FROM documents),
o AS (SELECT CASE WHEN d.source = 'src3' THEN 'src3-moved' ELSE d.source END AS source, d.doc_id, CASE WHEN l.quality = 0 THEN NULL WHEN d.lang = 'fr' THEN md5(d.text || '.') ELSE md5(d.text) END AS sha FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, doc_id, 'omitted' AS finding FROM r WHERE (source, doc_id) NOT IN (SELECT (source, doc_id) FROM o) UNION ALL SELECT source, doc_id, 'extra' FROM o WHERE (source, doc_id) NOT IN (SELECT (source, doc_id) FROM r)
UNION ALL SELECT source, doc_id, 'unreadable' FROM r JOIN o USING (source, doc_id) WHERE o.sha IS NULL UNION ALL SELECT source, doc_id, 'stale' FROM r JOIN o USING (source, doc_id) WHERE o.sha <> r.sha UNION ALL SELECT source, doc_id, 'partial' FROM r WHERE status <> 'parsed'""")
def inventory_drift(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    path = F.when(F.col("toxic") == 1, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id")
    recorded = docs.select("source", path, F.md5("text").alias("sha"), F.when(F.col("lang") == "es", "partial").otherwise("parsed").alias("status"))
    body = F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    moved = F.when(F.col("source") == "src3", "src3-moved").otherwise(F.col("source")).alias("source")
    observed = docs.select(moved, "doc_id", F.when(F.coalesce(F.col("quality") != 0, F.lit(True)), F.md5(body)).alias("sha"))
    return c.inventory_drift(recorded, observed, ["source", "doc_id"])


@query("mapping_coverage", """
WITH occ AS (SELECT lang AS asset, CASE WHEN l.quality = 0 THEN NULL ELSE d.source END AS domain, d.doc_id AS path, md5(d.text) AS sha, CASE WHEN l.toxic = 1 THEN 'excluded' WHEN l.doc_id IS NULL THEN 'unresolved' ELSE 'mapped' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)),
cur AS (SELECT CASE WHEN source = 'src5' THEN -1 - doc_id ELSE doc_id END AS path, CASE WHEN n_chars > 9000 THEN md5(text || '!') ELSE md5(text) END AS sha FROM documents),
x AS (SELECT o.asset, coalesce(o.domain, 'unassigned') AS domain, CASE WHEN o.sha IS DISTINCT FROM c.sha THEN 'stale' ELSE o.status END AS s FROM occ o LEFT JOIN cur c USING (path))
SELECT asset, domain, count(*) AS total, count(*) FILTER (WHERE s = 'mapped') AS mapped, count(*) FILTER (WHERE s = 'unresolved') AS unresolved, count(*) FILTER (WHERE s = 'excluded') AS excluded, count(*) FILTER (WHERE s = 'stale') AS stale FROM x GROUP BY 1, 2""")
def mapping_coverage(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars", "text")
    joined = docs.join(table(spark, sf, "labels").withColumn("_l", F.lit(True)), "doc_id", "left")
    occ = joined.select(
        F.col("lang").alias("asset"), F.when(F.coalesce(F.col("quality") != 0, F.lit(True)), F.col("source")).alias("domain"), F.col("doc_id").alias("path"), F.md5("text").alias("sha"),
        F.when(F.col("toxic") == 1, "excluded").when(F.col("_l").isNull(), "unresolved").otherwise("mapped").alias("status"))
    lost = F.when(F.col("source") == "src5", -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    now = docs.select(lost.alias("path"), F.md5(F.when(F.col("n_chars") > 9000, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha"))
    return c.mapping_coverage(occ, now)


@query("mapping_orphans", "SELECT c_custkey AS requirement_id FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey % 11 = 4 THEN -1 - o_custkey ELSE o_custkey END FROM orders)")
def mapping_orphans(spark, sf):
    lost = F.when(F.col("o_custkey") % 11 == 4, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return c.orphan_requirements(table(spark, sf, "customer").select(F.col("c_custkey").alias("requirement_id")), table(spark, sf, "orders").select(lost.alias("requirement_id")))


@query("reuse_coverage", """
WITH a AS (SELECT CASE WHEN p_size = 7 THEN -1 - p_partkey ELSE p_partkey END AS model_id, p_type AS disposition, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS owner, md5(p_name) AS b FROM part),
e AS (SELECT CASE WHEN p_size = 9 THEN -1 - p_partkey ELSE p_partkey END AS model_id, CASE WHEN p_size < 5 THEN md5(upper(p_name)) ELSE md5(p_name) END AS n FROM part)
SELECT CASE WHEN a.model_id IS NULL THEN '(added)' WHEN e.model_id IS NULL THEN '(removed)' ELSE a.disposition END AS disposition, count(*) AS total, count(*) FILTER (WHERE a.b <> e.n) AS stale, count(*) FILTER (WHERE a.model_id IS NOT NULL AND a.owner IS NULL) AS unassigned
FROM a FULL OUTER JOIN e ON a.model_id = e.model_id GROUP BY 1""")
def reuse_coverage(spark, sf):
    p = table(spark, sf, "part")
    moved = lambda size: F.when(F.col("p_size") == size, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("model_id")
    assigned = p.select(moved(7), F.col("p_type").alias("disposition"), F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("owner"), F.md5("p_name").alias("binding"))
    existing = p.select(moved(9), F.md5(F.when(F.col("p_size") < 5, F.upper("p_name")).otherwise(F.col("p_name"))).alias("binding"))
    return c.reuse_coverage(assigned, existing)


@query("inventory_dedupe", """
SELECT p_brand, p_name, count(*) AS n_occurrences, count(DISTINCT p_type) AS n_p_type, count(DISTINCT p_size) AS n_p_size FROM part GROUP BY 1, 2""")
def inventory_dedupe(spark, sf):
    return c.dedupe_objects(table(spark, sf, "part"), ["p_brand", "p_name"], ["p_type", "p_size"])


@query("inventory_references", """
SELECT p_brand, p_name, 'p_type' AS ref_kind, p_type AS ref_id, count(*) AS n_occurrences FROM part GROUP BY ALL
UNION ALL SELECT p_brand, p_name, 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY ALL""")
def inventory_references(spark, sf):
    refs = c.object_references(table(spark, sf, "part"), ["p_brand", "p_name"], ["p_type", "p_size"])
    return refs.where("ref_kind <> '_total'").drop("_total")


CTES["object_mappings"] = """
SELECT o_custkey AS object_id, CASE WHEN o_totalprice > 440000 AND o_orderpriority <> '4-NOT SPECIFIED' THEN 'mapped' ELSE 'unresolved' END AS status, CASE WHEN o_totalprice > 490000 THEN 'missing' ELSE 'present' END AS target_status,
       CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_totalprice > 480000 THEN 'stale' WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'accepted' END AS review_status, CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 475000 THEN 'out_of_scope' ELSE 'replace' END AS disposition
FROM orders"""
CTES["classified"] = """
SELECT c_custkey AS object_id, c_mktsegment AS domain, CASE WHEN u > 0 AND (x > 0 OR l) THEN 'missing_evidence' WHEN x > 0 OR l THEN 'explicit_exclusion' WHEN n > 0 AND u = 0 AND lost > 0 THEN 'missing_target' WHEN c_acctbal < 0 OR st > 0 THEN 'missing_evidence'
  WHEN u > 0 THEN 'replacement_mapping' WHEN n > 0 THEN 'missing_evidence' ELSE 'missing_target' END AS classification, l, x, xo, coalesce(n, 0) AS n_mappings
FROM (SELECT c.*, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(x, 0) AS x, coalesce(xo, 0) AS xo, coalesce(lost, 0) AS lost, coalesce(st, 0) AS st, c_acctbal > 9500 AS l FROM customer c LEFT JOIN (
  SELECT object_id, count(*) AS n, count(*) FILTER (WHERE status = 'mapped' AND target_status = 'present' AND review_status NOT IN ('stale', 'rejected') AND disposition = 'replace') AS u, count(*) FILTER (WHERE disposition = 'out_of_scope') AS x,
         count(*) FILTER (WHERE disposition = 'out_of_scope' AND review_status = 'accepted') AS xo, count(*) FILTER (WHERE target_status = 'missing') AS lost, count(*) FILTER (WHERE review_status = 'stale') AS st FROM object_mappings GROUP BY 1) ON c_custkey = object_id)"""


def classified(spark, sf):
    o = table(spark, sf, "orders")
    price, st, pr = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    mappings = o.select(
        F.col("o_custkey").alias("object_id"), F.when((price > 440000) & (pr != "4-NOT SPECIFIED"), "mapped").otherwise("unresolved").alias("status"), F.when(price > 490000, "missing").otherwise("present").alias("target_status"),
        F.when(st == "F", "accepted").when(price > 480000, "stale").when(st == "P", "rejected").otherwise("accepted").alias("review_status"), F.when((pr == "5-LOW") & (price > 475000), "out_of_scope").otherwise("replace").alias("disposition"))
    customers = table(spark, sf, "customer")
    objects = customers.select(F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("domain"), F.when(F.col("c_acctbal") < 0, "stale").otherwise("current").alias("evidence_status"))
    return c.classify_objects(objects, mappings, customers.where("c_acctbal > 9500").select(F.col("c_custkey").alias("object_id")))


@query("inventory_classify", """
SELECT domain, classification, (classification = 'replacement_mapping' OR (classification = 'explicit_exclusion' AND (l OR x = xo))) AS is_accounted, count(*) AS objects FROM classified GROUP BY ALL""")
def inventory_classify(spark, sf):
    return classified(spark, sf).groupBy("domain", "classification", "is_accounted").agg(F.count("*").alias("objects"))


@query("consumer_reconcile", """
WITH s AS (SELECT user_id AS consumer_id, CASE WHEN min(event_type) = 'click' THEN 'observed' ELSE 'declared' END AS status, CASE WHEN max(value) > 250 THEN 'retire_candidate' ELSE 'replace' END AS disposition, count(*) FILTER (WHERE value > 30) AS n_evidence, count(*) FILTER (WHERE value > 120) AS n_targets FROM events GROUP BY 1),
k AS (SELECT DISTINCT CASE WHEN o_custkey % 7 = 3 THEN -1 - o_custkey ELSE o_custkey END AS consumer_id FROM orders)
SELECT coalesce(s.consumer_id, k.consumer_id) AS consumer_id, CASE WHEN s.consumer_id IS NOT NULL AND disposition = 'retire_candidate' THEN 'explicit_exclusion' WHEN s.consumer_id IS NULL OR status <> 'observed' OR n_evidence = 0 THEN 'missing_evidence' WHEN n_targets = 0 THEN 'missing_target' ELSE 'replacement_mapping' END AS classification,
       s.consumer_id IS NOT NULL AS is_supplied, k.consumer_id IS NOT NULL AS is_known FROM s FULL OUTER JOIN k ON s.consumer_id = k.consumer_id""")
def consumer_reconcile(spark, sf):
    supplied = table(spark, sf, "events").groupBy(F.col("user_id").alias("consumer_id")).agg(
        F.when(F.min("event_type") == "click", "observed").otherwise("declared").alias("status"), F.when(F.max("value") > 250, "retire_candidate").otherwise("replace").alias("disposition"),
        F.count_if(F.col("value") > 30).alias("n_evidence"), F.count_if(F.col("value") > 120).alias("n_targets"))
    known = F.when(F.col("o_custkey") % 7 == 3, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return c.reconcile_consumers(supplied, table(spark, sf, "orders").select(known.alias("consumer_id")))


@query("classification_summary", """
SELECT domain, count(*) AS entries, count(*) FILTER (WHERE n > 1) AS shared_entries FROM (SELECT p_partkey, unnest(list_distinct([p_type, CASE WHEN p_size > 20 THEN 'LARGE' ELSE p_type END])) AS domain, len(list_distinct([p_type, CASE WHEN p_size > 20 THEN 'LARGE' ELSE p_type END])) AS n FROM part) GROUP BY 1""")
def classification_summary(spark, sf):
    domains = F.array_distinct(F.array("p_type", F.when(F.col("p_size") > 20, "LARGE").otherwise(F.col("p_type"))))
    return c.classification_summary(table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), domains.alias("domains")))


@query("attempt_tally", """
WITH a AS (SELECT role, conv_id, turn, length(text) > 120 AS ok, CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN NULL ELSE length(text) END AS usage FROM conversations),
f AS (SELECT role, conv_id, arg_min(ok, turn) AS first_ok, arg_max(ok, turn) AS last_ok, count(*) AS n, sum(usage) AS u, count(*) FILTER (WHERE usage IS NULL) AS unk FROM a GROUP BY 1, 2)
SELECT role, count(*) AS cases, count(*) FILTER (WHERE first_ok) AS first_pass_matches, count(*) FILTER (WHERE last_ok) AS final_matches, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(n - 1) AS BIGINT) AS repairs,
       CASE WHEN sum(unk) = 0 THEN CAST(sum(u) AS BIGINT) END AS usage_total, CAST(sum(n) - sum(unk) AS BIGINT) AS usage_known FROM f GROUP BY 1""")
def attempt_tally(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "role", "conv_id", "turn", F.length("text").cast("long").alias("size"), F.when(~((F.col("role") == "system") & (F.col("conv_id") % 2 == 0)), F.length("text").cast("long")).alias("usage"))
    return c.attempt_tally(turns, ["conv_id"], "turn", F.col("size") > 120, "usage", ["role"])


CTES["chain"] = """
SELECT event_id, user_id, CASE WHEN event_type = 'error' AND value > 40 THEN ts - INTERVAL 2 DAY ELSE ts END AS stamp, sha256(CAST(event_id AS VARCHAR) || event_type) AS digest,
       CASE WHEN event_type = 'signup' AND value > 50 THEN 'x' ELSE coalesce(lag(sha256(CAST(event_id AS VARCHAR) || event_type)) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) END AS link FROM events"""


@query("chain_verify", """
SELECT user_id, event_id, 'time_reversed' AS finding FROM (SELECT *, lag(stamp) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM chain) WHERE stamp < before
UNION ALL SELECT user_id, event_id, 'broken_link' FROM chain WHERE link = 'x'""")
def chain_verify(spark, sf):
    """Each user's events form a log."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts", F.sha2(F.concat(F.col("event_id").cast("string"), "event_type"), 256).alias("digest"))
    linked = prefix.previous_value(e, ["user_id"], ["event_id"], "digest", "_before")
    log = linked.select(
        "event_id", "user_id", F.when((F.col("event_type") == "error") & (F.col("value") > 40), F.expr("ts - interval 2 days")).otherwise(F.col("ts")).alias("at"), "digest",
        F.when((F.col("event_type") == "signup") & (F.col("value") > 50), "x").otherwise(F.coalesce("_before", F.lit(c.ZERO_DIGEST))).alias("link"))
    return c.chain_findings(log, ["user_id"], ["event_id"], "at", "link", "digest")
