"""Comparison of declared, physical and documented metadata.

Inventories are ordinary tables (relation, column_name, …), so every comparison
is a join or one tagged aggregate on their keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN = ["relation", "column_name"]


def _sides(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    tag = lambda df, x, y: df.select(*keys, F.lit(x).alias("_a"), F.lit(y).alias("_b"))
    return tag(a, 1, 0).unionByName(tag(b, 0, 1)).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def schema_reconcile(declared: DataFrame, physical: DataFrame) -> DataFrame:
    """Relations and columns on one side only; columns count only for shared relations."""
    relations = _sides(declared, physical, ["relation"])
    shared = relations.where("_a = 1 AND _b = 1").select("relation")
    kind = lambda what: F.when(F.col("_b") == 0, f"missing_{what}").otherwise(f"undocumented_{what}")
    lone = relations.where("_a <> _b").select("relation", F.lit(None).cast("string").alias("column_name"), kind("relation").alias("finding"))
    columns = _sides(declared, physical, COLUMN).where("_a <> _b").join(shared, "relation", "left_semi")
    return lone.unionByName(columns.select(*COLUMN, kind("column").alias("finding")))


def type_drift(raw: DataFrame, native: DataFrame, normalized: DataFrame) -> DataFrame:
    """Columns present everywhere whose type or nullability is not the same everywhere."""
    side = lambda df, p: df.select(*COLUMN, F.col("data_type").alias(f"{p}_type"), F.col("nullable").alias(f"{p}_nullable"))
    joined = side(raw, "raw").join(side(native, "native"), COLUMN).join(side(normalized, "normalized"), COLUMN)
    same = lambda c: F.col(f"raw_{c}").eqNullSafe(F.col(f"native_{c}")) & F.col(f"native_{c}").eqNullSafe(F.col(f"normalized_{c}"))
    out = joined.withColumns({"type_drift": ~same("type"), "nullability_drift": ~same("nullable")})
    return out.where("type_drift OR nullability_drift").select(*COLUMN, "raw_type", "native_type", "normalized_type", "type_drift", "nullability_drift")


def readback(expected: DataFrame, observed: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """How much of the expected text was read back: matched, different, absent."""
    seen = observed.select(*COLUMN, F.col(value).alias("_seen"), F.lit(True).alias("_there"))
    joined = expected.join(seen, COLUMN, "left")
    equal = F.coalesce(F.col(value) == F.col("_seen"), F.lit(False))
    return joined.groupBy(*by).agg(
        F.count("*").alias("expected"), F.count_if(equal).alias("matched"),
        F.count_if(~equal & F.col("_seen").isNotNull()).alias("different"), F.count_if(F.col("_seen").isNull()).alias("absent"),
        F.count_if(F.col("_there").isNull()).alias("column_missing"))


def environment_diff(a: DataFrame, b: DataFrame, attributes: Sequence[str], exceptions: DataFrame) -> DataFrame:
    """Differing or one-sided columns of two environments, accepted exceptions left out."""
    x, y = a.select(*COLUMN, F.struct(*attributes).alias("_x")), b.select(*COLUMN, F.struct(*attributes).alias("_y"))
    found = x.join(y, COLUMN, "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y")))
    issue = F.when(F.col("_y").isNull(), "only_in_first").when(F.col("_x").isNull(), "only_in_second").otherwise("different")
    return found.select(*COLUMN, issue.alias("issue")).join(exceptions.select(*COLUMN), COLUMN, "left_anti")


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def comment_statements(columns: DataFrame) -> DataFrame:
    """One comment statement per documented column."""
    tick = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    text = F.concat(F.lit("ALTER TABLE "), tick("relation"), F.lit(" ALTER COLUMN "), tick("column_name"), F.lit(" COMMENT "), quoted(F.col("description")))
    return columns.where("description IS NOT NULL").select(*COLUMN, text.alias("statement"))


def contract_diff(before: DataFrame, after: DataFrame, key: Sequence[str], name: str, attributes: Sequence[str]) -> DataFrame:
    """Removed, added and renamed fields and changed attributes, one row per change."""
    b = before.select(*key, F.struct(name, *attributes).alias("_b"))
    a = after.select(*key, F.struct(name, *attributes).alias("_a"))
    joined = b.join(a, list(key), "full_outer")
    changes = F.array_compact(F.array(
        F.when(F.col("_a").isNull(), "removed"), F.when(F.col("_b").isNull(), "added"),
        *[F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_b")[c].eqNullSafe(F.col("_a")[c]), "renamed" if c == name else f"{c}_changed") for c in (name, *attributes)]))
    return joined.select(*key, F.explode(changes).alias("change")).withColumn("is_breaking", F.col("change").isin("removed", "renamed", "data_type_changed"))


def catalog_findings(extracts: DataFrame, required: Sequence[str], as_of: str, max_age_days: int) -> DataFrame:
    """Per scope: stale, incomplete, repeated and missing components.

    ``extracts``: scope, component, captured_at, status.
    """
    per_part = extracts.groupBy("scope", "component").agg(
        F.count("*").alias("_n"), F.max("captured_at").alias("_at"), F.count_if(F.col("status") != "complete").alias("_bad"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("_at").cast("date"))
    codes = F.array_compact(F.array(
        F.when(age > max_age_days, "stale"), F.when(F.col("_bad") > 0, "incomplete"), F.when(F.col("_n") > 1, "repeated")))
    found = per_part.select("scope", "component", F.explode(codes).alias("finding"))
    want = extracts.select("scope").distinct().select("scope", F.explode(F.array(*[F.lit(c) for c in required])).alias("component"))
    missing = want.join(per_part, ["scope", "component"], "left_anti").select("scope", "component", F.lit("missing").alias("finding"))
    return found.unionByName(missing)


def design_findings(models: DataFrame, relations: DataFrame) -> DataFrame:
    """Design rules over models (model_id, keys array, depends_on array) and relationships
    (relation_id, from_model, to_model, from_keys array, to_keys array)."""
    known = models.select("model_id").distinct()
    entity = F.col("model_id").cast("string").alias("entity")
    repeated = models.groupBy("model_id").agg(F.count("*").alias("_n")).where("_n > 1").select(entity, F.lit("duplicate_id").alias("finding"))
    keyless = models.where(F.size("keys") == 0).select(entity, F.lit("missing_key").alias("finding"))
    needs = models.select("model_id", F.explode("depends_on").alias("_d"))
    unknown = needs.join(known.withColumnRenamed("model_id", "_d"), "_d", "left_anti").select(entity, F.lit("unknown_dependency").alias("finding"))
    arity = relations.where(F.size("from_keys") != F.size("to_keys")).select(F.col("relation_id").alias("entity"), F.lit("relationship_arity").alias("finding"))
    target = models.groupBy(F.col("model_id").alias("to_model")).agg(F.min(F.array_sort("keys")).alias("_k"))
    wrong = relations.join(target, "to_model").where(F.array_sort("to_keys") != F.col("_k")).select(F.col("relation_id").alias("entity"), F.lit("relationship_key_mismatch").alias("finding"))
    out = repeated
    for part in (keyless, unknown, arity, wrong):
        out = out.unionByName(part)
    return out


def multiset_diff(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with unequal counts on both sides, in one shuffle (the two-way exceptAll)."""
    tag = lambda df, sign: df.select(*columns, F.lit(sign).cast("long").alias("_d"))
    folded = tag(a, 1).unionByName(tag(b, -1)).groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return folded.select(*columns, F.when(F.col("_d") > 0, "only_in_design").otherwise("only_in_review").alias("side"), F.abs("_d").alias("copies"))


def merge_proposals(proposals: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Proposals merged by id; attributes on which they disagree are listed."""
    folded = proposals.groupBy(key).agg(
        F.count("*").alias("n_proposals"), *[F.min(c).alias(f"_lo_{c}") for c in attributes], *[F.max(c).alias(f"_hi_{c}") for c in attributes])
    apart = F.array_compact(F.array(*[F.when(~F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}")), c) for c in attributes]))
    return folded.select(key, "n_proposals", F.array_join(apart, ",").alias("disagreements"), F.when(F.size(apart) > 0, "disagreed").otherwise("agreed").alias("status"))


def dictionary_coverage(inventory: DataFrame, documented: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per relation: documented, undocumented and unknown columns, and blank required fields."""
    inv = inventory.select(*COLUMN).distinct().withColumn("_i", F.lit(True))
    doc = documented.select(*COLUMN, *fields).withColumn("_d", F.lit(True))
    joined = inv.join(doc, COLUMN, "full_outer")
    blank = [F.count_if(F.col("_d") & (F.col(f).isNull() | (F.trim(F.col(f)) == ""))).alias(f"missing_{f}") for f in fields]
    return joined.groupBy("relation").agg(
        F.count_if(F.col("_i") & F.col("_d")).alias("documented"), F.count_if(F.col("_d").isNull()).alias("undocumented"), F.count_if(F.col("_i").isNull()).alias("unknown"), *blank)


def column_edges(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Column lineage edges with both ends' relation and type."""
    side = lambda p: columns.select(F.col("column_id").alias(f"{p}_id"), F.col("relation").alias(f"{p}_relation"), F.col("data_type").alias(f"{p}_type"))
    return edges.join(side("child"), "child_id").join(side("parent"), "parent_id").withColumn("same_type", F.col("child_type") == F.col("parent_type"))


def name_candidates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Case-folded names found on both sides: candidates, not decisions.

    One row per (name, side, relation) with the number of column pairs the name
    suggests; source and target meet at the name, so pairs are counted, not listed.
    """
    fold = lambda df, side: df.groupBy(F.lower("column_name").alias("name"), "relation").agg(F.count("*").alias("n_columns")).withColumn("side", F.lit(side))
    both = fold(source, "source").unionByName(fold(target, "target"))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n_columns")).otherwise(0))
    pairs = both.groupBy("name").agg((of("source") * of("target")).alias("n_candidates")).where("n_candidates > 0")
    return both.join(pairs, "name").select("name", "side", "relation", "n_columns", "n_candidates")


def key_divergence(rows: DataFrame, key: str, definition: str) -> DataFrame:
    """Key names that carry several definitions."""
    pairs = rows.select(key, F.sha2(F.col(definition).cast("string"), 256).alias("_h")).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("n_definitions")).where("n_definitions > 1")


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Accepted rules of one scope and key with unequal definitions.

    ``rules``: rule_id, conflict_key, definition, status, model_ids array.
    """
    scoped = rules.where("status = 'accepted'").select("conflict_key", F.sha2("definition", 256).alias("_h"), F.explode("model_ids").alias("model_id"))
    per = scoped.groupBy("model_id", "conflict_key", "_h").agg(F.count("*").alias("_n"))
    return per.groupBy("model_id", "conflict_key").agg(F.count("*").alias("n_definitions"), F.sum("_n").alias("n_rules")).where("n_definitions > 1")


# Words that leave a part of a contract open.
UNKNOWN_WORDS = ("", "unknown", "tbd", "unresolved")
_MEASURE = ("measure_id", "expression", "aggregation", "additivity")


def _open(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*UNKNOWN_WORDS)


def _signature(df: DataFrame, parts: Sequence[str]) -> Column:
    """Hash of the context parts; lists count as sets of declarations, so their order does not matter."""
    kinds = dict(df.dtypes)
    return F.sha2(F.to_json(F.struct(*[F.array_sort(c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in sorted(parts)])), 256)


def unknown_contracts(assets: DataFrame, measures: DataFrame) -> DataFrame:
    """asset_id of contracts with an open part of the context or an open measure expression; they need a decision first."""
    parts, kinds = [c for c in assets.columns if c != "asset_id"], dict(assets.dtypes)
    test = F.lit(False)
    for c in parts:
        test = test | (F.coalesce(F.exists(c, _open), F.lit(True)) if kinds[c].startswith("array") else _open(F.col(c)))
    vague = measures.where(_open(F.col("expression"))).select("asset_id")
    return assets.where(test).select("asset_id").unionByName(assets.join(vague, "asset_id", "left_semi").select("asset_id")).distinct()


def shared_contract_groups(
    assets: DataFrame, measures: DataFrame, existing: DataFrame, existing_measures: DataFrame,
    dimensions: DataFrame | None = None, existing_dimensions: DataFrame | None = None,
) -> DataFrame:
    """Known report contracts grouped by signature, with the reuse decision of each group.

    ``assets``: asset_id and the context columns; ``measures``: asset_id, measure_id,
    expression, aggregation, additivity; ``dimensions``: asset_id, dimension; ``existing``:
    model_id and the context columns; ``existing_measures`` and ``existing_dimensions``
    likewise by model_id. Contracts with unknown parts (``unknown_contracts``) are left out.
    A group may reuse a model only of its own signature that has all its measures, equal in
    every part, and all its dimensions.
    """
    parts = [c for c in assets.columns if c != "asset_id"]
    known = assets.join(unknown_contracts(assets, measures), "asset_id", "left_anti")
    tagged = known.select("asset_id", _signature(assets, parts).alias("signature"))
    models = existing.select("model_id", _signature(existing, parts).alias("signature"))
    group = tagged.groupBy("signature").agg(F.count("*").alias("n_assets"))
    versions = tagged.join(measures, "asset_id").select("signature", *_MEASURE).distinct()
    summable = F.col("aggregation").isin("sum", "count") & (F.col("additivity") == "additive")
    per_measure = versions.groupBy("signature", "measure_id").agg(F.count("*").alias("_v"), F.min(summable.cast("int")).alias("_add"))
    per_group = per_measure.groupBy("signature").agg(F.max("_v").alias("_v"), F.min("_add").alias("_add"), F.count("*").alias("n_measures"))

    def held(wanted: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Models that have every wanted row of their signature (those without any are not listed)."""
        asked = wanted.groupBy("signature").agg(F.count("*").alias("_asked"))
        there = models.join(rows.select("model_id", *columns).distinct(), "model_id")
        same = [F.col(f"_w.{c}").eqNullSafe(F.col(f"_t.{c}")) for c in ("signature", *columns)]
        met = wanted.alias("_w").join(there.alias("_t"), same).groupBy("_t.model_id").agg(F.count("*").alias("_met"))
        return models.join(asked, "signature", "left").join(met, "model_id", "left").where("coalesce(_met, 0) = coalesce(_asked, 0)").select("model_id", "signature")

    fit = held(versions, existing_measures, _MEASURE)
    if dimensions is not None:
        asked = tagged.join(dimensions, "asset_id").select("signature", "dimension").distinct()
        fit = fit.join(held(asked, existing_dimensions, ["dimension"]).select("model_id"), "model_id", "left_semi")
    built = fit.select("signature").distinct().withColumn("_built", F.lit(True))
    disposition = (
        F.when(F.col("_v") > 1, "needs_decision").when(F.col("_built"), "reuse_candidate").when(F.col("n_assets") < 2, "keep_separate")
        .when(F.coalesce("_add", F.lit(1)) == 1, "shared_aggregate_candidate").otherwise("shared_detail_candidate"))
    joined = group.join(per_group, "signature", "left").join(built, "signature", "left")
    return joined.select("signature", "n_assets", F.coalesce("n_measures", F.lit(0)).alias("n_measures"), disposition.alias("disposition"))
