"""Accounting: what is mapped, excluded, unresolved, stale, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators import prefix


def scope_status(objects: DataFrame, assignments: DataFrame, models: DataFrame) -> DataFrame:
    """assigned / excluded / unresolved per object, with conflicts and missing targets.

    ``assignments``: object_id, kind (implementation, interface, excluded), model_id.
    An implementation counts only when its target is an existing model.
    """
    known = models.select("model_id", F.col("object_kind").alias("_kind"))
    linked = assignments.join(known, "model_id", "left")
    real = (F.col("kind") == "implementation") & (F.col("_kind") == "model")
    per = linked.groupBy("object_id").agg(
        F.count("*").alias("_links"), F.count_if(F.col("kind") == "excluded").alias("_excluded"), F.count_if(real).alias("_real"),
        F.count_if((F.col("kind") != "excluded") & F.col("_kind").isNull()).alias("missing_targets"),
        F.count_if((F.col("kind") == "implementation") & F.col("_kind").isin("source", "interface")).alias("interface_only"))
    joined = objects.join(per, "object_id", "left").fillna(0, ["_links", "_excluded", "_real", "missing_targets", "interface_only"])
    status = F.when((F.col("_excluded") > 0) & (F.col("_excluded") == F.col("_links")), "excluded").when(F.col("_real") > 0, "assigned").otherwise("unresolved")
    return joined.select(
        "object_id", status.alias("status"), ((F.col("_excluded") > 0) & (F.col("_links") > F.col("_excluded"))).alias("is_conflict"), "missing_targets", "interface_only")


def consumer_gaps(consumers: DataFrame, status: DataFrame) -> DataFrame:
    """Per consumer: objects it needs that are unknown or not assigned."""
    joined = consumers.join(status.select("object_id", "status"), "object_id", "left")
    return joined.groupBy("consumer_id").agg(
        F.count("*").alias("objects"), F.count_if(F.col("status").isNull()).alias("unknown_objects"),
        F.count_if(F.col("status").isNotNull() & (F.col("status") != "assigned")).alias("uncovered_objects"))


def inventory_drift(recorded: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stale / omitted / unreadable / extra / partial per file.

    ``recorded``: keys, sha, status; ``observed``: keys, sha (null when unreadable).
    """
    r = recorded.select(*keys, F.col("sha").alias("_r"), F.col("status").alias("_status"), F.lit(True).alias("_in"))
    o = observed.select(*keys, F.col("sha").alias("_o"), F.lit(True).alias("_out"))
    both = F.col("_in") & F.col("_out")
    codes = F.array_compact(F.array(
        F.when(F.col("_out").isNull(), "omitted"), F.when(F.col("_in").isNull(), "extra"), F.when(both & F.col("_o").isNull(), "unreadable"),
        F.when(both & (F.col("_o") != F.col("_r")), "stale"), F.when(F.col("_in") & (F.col("_status") != "parsed"), "partial")))
    return r.join(o, list(keys), "full_outer").select(*keys, F.explode(codes).alias("finding"))


def mapping_coverage(occurrences: DataFrame, current: DataFrame) -> DataFrame:
    """mapped / unresolved / excluded / stale counts by asset and domain.

    ``occurrences``: asset, domain, path, sha, status; ``current``: path, sha now.
    """
    joined = occurrences.join(current.select("path", F.col("sha").alias("_now")), "path", "left")
    status = F.when(~F.col("sha").eqNullSafe(F.col("_now")), "stale").otherwise(F.col("status"))
    count = lambda s: F.count_if(F.col("_s") == s).alias(s)
    return joined.withColumn("_s", status).groupBy("asset", F.coalesce("domain", F.lit("unassigned")).alias("domain")).agg(
        F.count("*").alias("total"), *[count(s) for s in ("mapped", "unresolved", "excluded", "stale")])


def orphan_requirements(requirements: DataFrame, mappings: DataFrame) -> DataFrame:
    return requirements.join(mappings.select("requirement_id"), "requirement_id", "left_anti")


def reuse_coverage(assignments: DataFrame, existing: DataFrame) -> DataFrame:
    """Per disposition: total, stale, unassigned; added and removed models as own rows.

    ``assignments``: model_id, disposition, owner, binding; ``existing``: model_id, binding.
    """
    a = assignments.select("model_id", "disposition", "owner", F.col("binding").alias("_b"), F.lit(True).alias("_a"))
    e = existing.select("model_id", F.col("binding").alias("_now"), F.lit(True).alias("_e"))
    joined = a.join(e, "model_id", "full_outer")
    group = F.when(F.col("_a").isNull(), "(added)").when(F.col("_e").isNull(), "(removed)").otherwise(F.col("disposition"))
    both = F.col("_a") & F.col("_e")
    return joined.groupBy(group.alias("disposition")).agg(
        F.count("*").alias("total"), F.count_if(both & ~F.col("_b").eqNullSafe(F.col("_now"))).alias("stale"), F.count_if(F.col("_a") & F.col("owner").isNull()).alias("unassigned"))


def dedupe_objects(rows: DataFrame, key: Sequence[str], refs: Sequence[str]) -> DataFrame:
    """Register rows folded to objects: occurrences and distinct ids per kind of reference."""
    return object_references(rows, key, refs).groupBy(*key).agg(
        F.max("_total").alias("n_occurrences"), *[F.count_if(F.col("ref_kind") == r).alias(f"n_{r}") for r in refs])


def object_references(rows: DataFrame, key: Sequence[str], refs: Sequence[str]) -> DataFrame:
    """Distinct references of each object as rows (key, ref_kind, ref_id), never as one array per object."""
    flat = rows.select(*key, F.explode(F.array(
        F.struct(F.lit("_total").alias("ref_kind"), F.lit(None).cast("string").alias("ref_id")),
        *[F.struct(F.lit(r).alias("ref_kind"), F.col(r).cast("string").alias("ref_id")) for r in refs])).alias("_r")).select(*key, "_r.*")
    kept = flat.where((F.col("ref_kind") == "_total") | F.col("ref_id").isNotNull())
    counted = kept.groupBy(*key, "ref_kind", "ref_id").agg(F.count("*").alias("n_occurrences"))
    return counted.withColumn("_total", F.when(F.col("ref_kind") == "_total", F.col("n_occurrences")))


def classify_objects(objects: DataFrame, mappings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """replacement / explicit exclusion / missing target / missing evidence, with the accounted flag.

    ``objects``: object_id, evidence_status; ``mappings``: object_id, status, target_status,
    review_status, disposition; ``exclusions``: object_id.
    """
    stale_or_rejected = F.col("review_status").isin("stale", "rejected")
    usable = (F.col("status") == "mapped") & (F.col("target_status") == "present") & ~stale_or_rejected & (F.col("disposition") == "replace")
    out_of_scope = F.col("disposition").isin("out_of_scope", "retire_candidate")
    per = mappings.groupBy("object_id").agg(
        F.count("*").alias("_n"), F.count_if(usable).alias("_use"), F.count_if(out_of_scope).alias("_out"),
        F.count_if(out_of_scope & (F.col("review_status") == "accepted")).alias("_out_ok"),
        F.count_if(F.col("target_status") == "missing").alias("_lost"), F.count_if(F.col("review_status") == "stale").alias("_stale"))
    listed = exclusions.select("object_id").distinct().withColumn("_listed", F.lit(True))
    j = objects.join(per, "object_id", "left").join(listed, "object_id", "left").fillna(0, ["_n", "_use", "_out", "_out_ok", "_lost", "_stale"])
    excluded = F.coalesce("_listed", F.lit(False))
    c = (
        F.when((F.col("_use") > 0) & ((F.col("_out") > 0) | excluded), "missing_evidence")
        .when((F.col("_out") > 0) | excluded, "explicit_exclusion")
        .when((F.col("_n") > 0) & (F.col("_use") == 0) & (F.col("_lost") > 0), "missing_target")
        .when((F.col("evidence_status") != "current") | (F.col("_stale") > 0), "missing_evidence")
        .when(F.col("_use") > 0, "replacement_mapping")
        .when(F.col("_n") > 0, "missing_evidence").otherwise("missing_target"))
    accounted = (F.col("classification") == "replacement_mapping") | (
        (F.col("classification") == "explicit_exclusion") & (excluded | (F.col("_out_ok") == F.col("_out"))))
    return j.withColumn("classification", c).withColumn("is_accounted", accounted).select(*objects.columns, "classification", "is_accounted", F.col("_n").alias("n_mappings"))


def reconcile_consumers(supplied: DataFrame, known: DataFrame) -> DataFrame:
    """Union of supplied and known consumers, classified.

    ``supplied``: consumer_id, status, disposition, n_evidence, n_targets; ``known``: consumer_id.
    """
    s = supplied.withColumn("_s", F.lit(True))
    k = known.select("consumer_id").distinct().withColumn("_k", F.lit(True))
    c = (
        F.when(F.col("_s") & F.col("disposition").isin("out_of_scope", "retire_candidate"), "explicit_exclusion")
        .when(F.col("_s").isNull() | (F.col("status") != "observed") | (F.col("n_evidence") == 0), "missing_evidence")
        .when(F.col("n_targets") == 0, "missing_target").otherwise("replacement_mapping"))
    return s.join(k, "consumer_id", "full_outer").select("consumer_id", c.alias("classification"), F.col("_s").isNotNull().alias("is_supplied"), F.col("_k").isNotNull().alias("is_known"))


def classification_summary(entries: DataFrame) -> DataFrame:
    """Entries per domain and how many of them are shared with other domains (entry_id, domains array)."""
    flat = entries.select(F.explode("domains").alias("domain"), (F.size("domains") > 1).alias("_shared"))
    return flat.groupBy("domain").agg(F.count("*").alias("entries"), F.count_if("_shared").alias("shared_entries"))


def attempt_tally(attempts: DataFrame, case: Sequence[str], order: str, matched: Column, usage: str, by: Sequence[str]) -> DataFrame:
    """First-pass and final matches, repairs, and usage (null when any part is unknown)."""
    per = attempts.withColumn("_m", matched).groupBy(*by, *[c for c in case if c not in by]).agg(
        F.min_by("_m", order).alias("_first"), F.max_by("_m", order).alias("_final"), F.count("*").alias("_n"),
        F.sum(usage).alias("_u"), F.count_if(F.col(usage).isNull()).alias("_unknown"))
    return per.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if("_first").alias("first_pass_matches"), F.count_if("_final").alias("final_matches"),
        F.sum("_n").alias("attempts"), F.sum(F.col("_n") - 1).alias("repairs"),
        F.when(F.sum("_unknown") == 0, F.sum("_u")).alias("usage_total"), (F.sum("_n") - F.sum("_unknown")).alias("usage_known"))


def chain_findings(events: DataFrame, chain: Sequence[str], order: Sequence[str], at: str, link: str, digest: str) -> DataFrame:
    """Events whose time runs backwards or whose link is not the digest of the row before; ordered by ranges, so a busy chain is split."""

    packed = events.withColumn("_state", F.struct(F.col(at).alias("at"), F.col(digest).alias("digest")))
    seen = prefix.previous_value(packed, chain, order, "_state", "_prev")
    codes = F.array_compact(F.array(
        F.when(F.col(at) < F.col("_prev.at"), "time_reversed"),
        F.when(~F.col(link).eqNullSafe(F.coalesce(F.col("_prev.digest"), F.lit(ZERO_DIGEST))), "broken_link")))
    return seen.select(*chain, *order, F.explode(codes).alias("finding"))


# Fixed value: link of the first event of a chain.
ZERO_DIGEST = "0" * 64


def propagate_effort(packages: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """Difficulty and readiness inherited from all prerequisites.

    ``packages``: node_id, own_level (0 unknown), is_blocked; ``prerequisites``:
    source_id (the prerequisite) -> target_id. An unknown level below a package
    leaves it without a level.
    """
    from starloom.operators.lineage import propagate

    start = packages.select(
        "node_id", F.col("own_level").alias("level"), F.col("is_blocked").cast("int").alias("blocked"), (F.col("own_level") == 0).cast("int").alias("unknown"))
    done = propagate(start, prerequisites, {"level": "max", "blocked": "max", "unknown": "max"})
    own = packages.select("node_id", "own_level")
    return done.join(own, "node_id").select(
        "node_id", F.when(F.col("unknown") == 0, F.col("level")).alias("level"),
        F.when(F.col("unknown") == 1, "needs_discovery").when(F.col("blocked") == 1, "blocked").otherwise("ready").alias("readiness"),
        ((F.col("unknown") == 0) & (F.col("level") > F.col("own_level"))).alias("is_inherited"))


def effort_reasons(packages: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """Why a package is not ready, or harder than its own work: node_id, reason, prerequisite_id, one row each.

    Inputs as for ``propagate_effort``. ``own_blocker`` and ``unknown_level`` are of the
    package itself (no prerequisite); ``unassessed_prerequisite``, ``blocked_prerequisite``
    and ``harder_prerequisite`` name each direct prerequisite that passes its state on.
    A prerequisite that is no package, or the package itself, gives no reason.
    """
    from starloom.operators.lineage import cut_lineage

    done = cut_lineage(propagate_effort(packages, prerequisites))
    own = packages.select("node_id", F.explode(F.array_compact(F.array(
        F.when(F.col("is_blocked"), "own_blocker"), F.when(F.col("own_level") == 0, "unknown_level")))).alias("reason"), F.lit(None).cast(prerequisites.schema["source_id"].dataType).alias("prerequisite_id"))
    links = prerequisites.where("source_id <> target_id").select("source_id", "target_id").distinct()
    passed = links.join(done.select(F.col("node_id").alias("source_id"), "level", "readiness"), "source_id")
    passed = passed.join(packages.select(F.col("node_id").alias("target_id"), "own_level"), "target_id")
    codes = F.array_compact(F.array(
        F.when(F.col("level").isNull(), "unassessed_prerequisite"), F.when(F.col("readiness") == "blocked", "blocked_prerequisite"),
        F.when((F.col("own_level") > 0) & (F.col("level") > F.col("own_level")), "harder_prerequisite")))
    return own.unionByName(passed.select(F.col("target_id").alias("node_id"), F.explode(codes).alias("reason"), F.col("source_id").alias("prerequisite_id")))
