"""Dependency graphs held as node and edge tables.

Each round is one join of the edges with the rows that changed. Rounds end in a
reliable checkpoint, so plans stay short and a lost executor costs a re-read of
the round, not of the whole history. A node with very many edges is a skewed
join key with a single row on the other side, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.session import cut_lineage, scratch_path


def _contracted(links: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with its chains as single edges: (_s, _t, _w) and, per node inside a chain, (node_id, _head, _w).

    Inside a chain is a node with one edge in and one out that is no seed. Its way back
    to the chain's head doubles every round (pointer jumping), so the rounds grow with
    the logarithm of the longest chain. Rings without a way in have no head and no seed;
    their rows are dropped when a way is longer than there are nodes.
    """
    degree = links.select(F.col("_s").alias("node_id"), F.lit(0).alias("_in"), F.lit(1).alias("_out")).unionByName(
        links.select(F.col("_t").alias("node_id"), F.lit(1).alias("_in"), F.lit(0).alias("_out"))).groupBy("node_id").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    single = degree.where("_in = 1 AND _out = 1").select("node_id").join(seeds, "node_id", "left_anti")
    inside = cut_lineage(single)
    back = cut_lineage(
        inside.join(links.withColumnRenamed("_t", "node_id"), "node_id").select("node_id", F.col("_s").alias("_head"), F.lit(1).cast("long").alias("_w"))
        .join(inside.select(F.col("node_id").alias("_head"), F.lit(True).alias("_more")), "_head", "left").select("node_id", "_head", "_w", F.col("_more").isNotNull().alias("_more")))
    done, open_, most = back.where("NOT _more"), back.where("_more"), inside.count()
    while not open_.isEmpty():
        step = back.select(F.col("node_id").alias("_head"), F.col("_head").alias("_next"), F.col("_w").alias("_far"), F.col("_more").alias("_on"))
        back = cut_lineage(open_.join(step, "_head").select("node_id", F.col("_next").alias("_head"), (F.col("_w") + F.col("_far")).alias("_w"), F.col("_on").alias("_more")).where(F.col("_w") <= most)
                           .unionByName(done))
        done, open_ = back.where("NOT _more"), back.where("_more")
    ways = done.select("node_id", "_head", "_w")
    from_chain = links.join(ways.select(F.col("node_id").alias("_s"), "_head", F.col("_w").alias("_far")), "_s", "left")
    short = from_chain.select(F.coalesce("_head", "_s").alias("_s"), "_t", (F.coalesce("_far", F.lit(0)) + 1).alias("_w"))
    edges = short.join(inside.select(F.col("node_id").alias("_t")), "_t", "left_anti").join(inside.select(F.col("node_id").alias("_s")), "_s", "left_anti")
    return edges.groupBy("_s", "_t").agg(F.min("_w").alias("_w")), ways


def closure(edges: DataFrame, seeds: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Nodes reachable from the seeds (seeds included), as ``node_id`` and ``depth``.

    The first ``PLAIN_ROUNDS`` rounds are a plain breadth-first search, so a shallow graph
    costs one pass over its edges a level and nothing else; repeated edges do no harm.
    What lies deeper is searched with its chains contracted.
    """
    links = _written(edges.where(F.col(source) != F.col(target)).select(F.col(source).alias("_s"), F.col(target).alias("_t")), "links")
    frontier = _written(seeds.toDF("node_id").distinct(), "seeds")
    reached = frontier.withColumn("depth", F.lit(0))
    size = frontier.count()
    for depth in range(1, PLAIN_ROUNDS + 1):
        # A frontier's nodes are distinct: a busy one costs the edges' side, which streams past the hashed nodes.
        starts = frontier.withColumnRenamed("node_id", "_s").hint("broadcast" if size <= 2**16 else "shuffle_hash")
        step = links.join(starts, "_s", "left_semi").select(F.col("_t").alias("node_id")).distinct()
        frontier = cut_lineage(step.join(reached, "node_id", "left_anti"))
        size = frontier.count()
        if not size:
            return reached
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(depth)))
    open_ = links.join(reached.select(F.col("node_id").alias("_t")), "_t", "left_anti").select("_s", "_t").distinct()
    deeper = _contracted_closure(cut_lineage(open_), frontier).where("depth > 0")
    return reached.unionByName(deeper.withColumn("depth", F.col("depth") + PLAIN_ROUNDS))


# Rounds of ``closure`` before chains are contracted, which costs several passes over all edges.
PLAIN_ROUNDS = 4


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: columns are packed, and a reader takes only those it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _contracted_closure(links: DataFrame, start: DataFrame) -> DataFrame:
    """``closure`` of distinct edges (_s, _t) from distinct nodes.

    Chains are contracted first, so a long one costs the logarithm of its length in
    rounds. The search then goes edge by edge of what is left; a node that is reached
    again by a shorter way is sent on again, so depths are exact. Nodes inside chains
    get theirs from the head of the chain at the end.
    """
    short, ways = _contracted(links, start)
    short = cut_lineage(short)
    frontier = start.withColumn("depth", F.lit(0).cast("long"))
    reached, rounds = frontier, 0
    while not frontier.isEmpty():
        rounds += 1
        step = short.join(frontier.withColumnRenamed("node_id", "_s"), "_s").groupBy(F.col("_t").alias("node_id")).agg(F.min(F.col("depth") + F.col("_w")).alias("depth"))
        known = reached.groupBy("node_id").agg(F.min("depth").alias("_known"))
        frontier = cut_lineage(step.join(known, "node_id", "left").where("_known IS NULL OR depth < _known").select("node_id", "depth"))
        reached = reached.unionByName(frontier)
        if rounds % 16 == 0:
            reached = cut_lineage(reached.groupBy("node_id").agg(F.min("depth").alias("depth")))
    found = reached.groupBy("node_id").agg(F.min("depth").alias("depth"))
    chained = ways.join(found.withColumnRenamed("node_id", "_head"), "_head").select("node_id", (F.col("depth") + F.col("_w")).alias("depth"))
    return found.unionByName(chained).select("node_id", F.col("depth").cast("int").alias("depth"))


def unresolved_edges(edges: DataFrame, nodes: DataFrame, node: str, ends: Sequence[str] = ("source_id", "target_id")) -> DataFrame:
    """Edges with an end that no node row declares."""
    out = None
    for end in ends:
        known = nodes.select(F.col(node).alias(end)).distinct()
        missing = edges.join(known, end, "left_anti").select(*edges.columns, F.lit(end).alias("missing_end"))
        out = missing if out is None else out.unionByName(missing)
    return out


def cyclic_nodes(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Nodes on a cycle or behind one: those left when all nodes without open incoming edges are taken away.

    Chains are contracted first. Each node then has a counter of its incoming edges; a
    round sends only the edges of the nodes that reached zero and writes what it took
    off as a table of its own, so every edge is moved once and the written rows stay
    within the edges and their merging every 16 rounds.
    """
    links = cut_lineage(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct())
    contracted, ways = _contracted(links, links.select(F.col("_s").alias("node_id")).limit(0))
    short = cut_lineage(contracted.select("_s", "_t"))
    incoming = cut_lineage(short.groupBy(F.col("_t").alias("node_id")).agg(F.count("*").alias("_in")))
    every = cut_lineage(links.select(F.col("_s").alias("node_id")).unionByName(links.select(F.col("_t").alias("node_id"))).distinct())
    chained = cut_lineage(ways.select("node_id", "_head"))
    frontier = cut_lineage(short.select(F.col("_s").alias("node_id")).distinct().join(incoming, "node_id", "left_anti"))
    gone, taken, rounds = frontier, None, 0
    while not frontier.isEmpty():
        rounds += 1
        off = cut_lineage(short.join(frontier.select(F.col("node_id").alias("_s")), "_s", "left_semi").groupBy(F.col("_t").alias("node_id")).agg(F.count("*").alias("_off")))
        taken = off if taken is None else taken.unionByName(off)
        total = taken.join(off.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.sum("_off").alias("_off"))
        frontier = cut_lineage(total.join(incoming, "node_id").where("_off = _in").select("node_id"))
        gone = gone.unionByName(frontier)
        if rounds % 16 == 0:
            gone, taken = cut_lineage(gone), cut_lineage(taken.groupBy("node_id").agg(F.sum("_off").alias("_off")))
    released = chained.join(gone.select(F.col("node_id").alias("_head")), "_head", "left_semi").select("node_id")
    return every.join(gone.unionByName(released), "node_id", "left_anti")


def upstream_only(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Unmapped tables upstream of a replaced table, along observed edges only.

    ``edges``: source_id, target_id, status; ``tables``: table_id, classification, n_mappings.
    """
    observed = edges.where("status = 'observed'")
    replaced = tables.where("classification = 'replacement_mapping'").select("table_id")
    above = closure(observed, replaced, source="target_id", target="source_id").where("depth > 0")
    open_ = tables.where("classification IN ('missing_target', 'missing_evidence') AND n_mappings = 0")
    return open_.join(above.select(F.col("node_id").alias("table_id")), "table_id", "left_semi").select("table_id")


def hub_edges(mappings: DataFrame, mapping: str, sources: str, targets: str) -> DataFrame:
    """Many-to-many mappings as source -> mapping -> target edges (n + m, never n x m)."""
    ends = lambda c: mappings.select(mapping, F.explode(c).alias("_end"))
    inbound = ends(sources).select(F.col("_end").alias("source_id"), F.col(mapping).alias("target_id"), F.lit("source").alias("side"))
    outbound = ends(targets).select(F.col(mapping).alias("source_id"), F.col("_end").alias("target_id"), F.lit("target").alias("side"))
    return inbound.unionByName(outbound)


def prune_dependents(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Drop items that need something out of scope, until nothing changes.

    ``items``: item_id in scope; ``needs``: item_id, needs_id. Only items dropped in
    the last round are followed, so each edge is walked at most once.
    """
    links = cut_lineage(needs.select("item_id", "needs_id").distinct())
    scope = cut_lineage(items.select("item_id").distinct())
    outside = links.join(scope.select(F.col("item_id").alias("needs_id")), "needs_id", "left_anti")
    dropped = cut_lineage(outside.select("item_id").distinct().join(scope, "item_id", "left_semi"))
    lost, rounds = dropped, 0
    while not dropped.isEmpty():
        rounds += 1
        step = links.join(dropped.select(F.col("item_id").alias("needs_id")), "needs_id", "left_semi").select("item_id").distinct()
        dropped = cut_lineage(step.join(scope, "item_id", "left_semi").join(lost, "item_id", "left_anti"))
        lost = lost.unionByName(dropped)
        if rounds % 16 == 0:
            lost = cut_lineage(lost)
    return scope.join(lost, "item_id", "left_anti")


def propagate(nodes: DataFrame, edges: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Spread monotone values along ``source_id -> target_id`` until stable.

    ``rules``: column -> ``max`` (ordinals, flags) or ``bit_or`` (sets as bit masks; null is the empty set).
    A round sends on only the nodes that changed and writes only those that change again;
    the values of a node are its rows in ``nodes`` and in the rounds' tables, folded. Rounds
    are merged as soon as one is half as long as the one before, so there are a logarithm
    of them and each change is rewritten a logarithm of times. Repeated nodes are folded
    into one row; edges to ids that are no nodes say nothing.

    What arrives meets what is known in one aggregate by node. Rounds are many, so no round
    broadcasts more than 2^13 changed nodes; longer ones are merged with the edges.
    """
    fold = {"max": F.max, "bit_or": F.bit_or}
    names = list(rules)
    folded = lambda df: df.groupBy("node_id").agg(*[fold[r](c).alias(c) for c, r in rules.items()])
    links = cut_lineage(edges.select("source_id", "target_id").distinct())
    base = cut_lineage(folded(nodes.select("node_id", *[F.coalesce(c, F.lit(0)).alias(c) if r == "bit_or" else F.col(c) for c, r in rules.items()])))
    rounds: list[tuple[DataFrame, int]] = []
    changed, size = base, base.count()
    none = {c: F.lit(None).cast(base.schema[c].dataType) for c in names}
    while True:
        sent = links.join(changed.withColumnRenamed("node_id", "source_id").hint("broadcast" if size <= 2**13 else "merge"), "source_id").where("target_id IS NOT NULL")
        arriving = sent.select(F.col("target_id").alias("node_id"), *[none[c].alias(c) for c in names], *[F.col(c).alias(f"_in_{c}") for c in names], F.lit(False).alias("_own"))
        known = base
        for delta, _ in rounds:
            known = known.unionByName(delta)
        tagged = known.select("node_id", *names, *[none[c].alias(f"_in_{c}") for c in names], F.lit(True).alias("_own")).unionByName(arriving)
        met = tagged.groupBy("node_id").agg(
            *[fold[r](c).alias(c) for c, r in rules.items()], *[fold[r](f"_in_{c}").alias(f"_in_{c}") for c, r in rules.items()],
            F.bool_or("_own").alias("_own"), F.bool_and("_own").alias("_left"))
        now = met.where("_own AND NOT _left")
        after = {c: F.greatest(c, f"_in_{c}") if r == "max" else F.col(c).bitwiseOR(F.coalesce(f"_in_{c}", F.lit(0))) for c, r in rules.items()}
        moved = F.lit(False)
        for c in names:
            moved = moved | ~after[c].eqNullSafe(F.col(c))
        changed = cut_lineage(now.where(moved).select("node_id", *[after[c].alias(c) for c in names]))
        size = changed.count()
        if not size:
            return folded(known)
        rounds.append((changed, size))
        while len(rounds) > 1 and 2 * rounds[-1][1] >= rounds[-2][1]:
            (newer, _), (older, _) = rounds.pop(), rounds.pop()
            merged = cut_lineage(folded(older.unionByName(newer)))
            rounds.append((merged, merged.count()))


def components(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """Smallest node id of each undirected component, per node.

    Alternating large-star / small-star steps: every round links nodes to the
    smallest neighbour known, so rounds grow with the logarithm of the graph and
    a hub is reduced by a map-side ``min`` before its edges move. Rounds are many, so
    none of them broadcasts: each would leave a hashed table in the driver.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    isolated = pairs.where("u = v").select(F.col("u").alias("node_id")).distinct()
    links = cut_lineage(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        links = cut_lineage(_star_round(links))
        stamp = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp == before:
            break
        before = stamp
    labels = links.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node_id")).distinct().withColumn("component", F.col("node_id"))
    found = labels.unionByName(roots)
    alone = isolated.join(found.hint("merge"), "node_id", "left_anti").withColumn("component", F.col("node_id"))
    return found.unionByName(alone)


def _star_round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step of ``components`` over (u, v), u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(lowest.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least.hint("merge"), "u")
    small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return small.distinct()


def tree_diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Shape of each declared tree: roots, edges, parent paths, unresolved ends, repeats.

    ``nodes``: tree_id, node_id, parent_id, path; ``edges``: tree_id, from_id, to_id.
    Each input is read once: a node speaks for itself and claims a path for its parent,
    equal claims are counted in the map tasks, and what is said of one id meets by
    (tree, id). A repeated node's path is its smallest. A null tree is a tree; a tree
    of edges alone has no nodes and fails; an edge from a null id is unresolved.
    """
    counts = ("nodes", "roots", "children", "edges")
    blank = F.lit(None).cast(nodes.schema["path"].dataType)

    def said(of: str, path: Column = blank, claim: Column = blank, **n: Column) -> Column:
        return F.struct(F.col(of).alias("id"), path.alias("path"), claim.alias("claim"), *[n.get(c, F.lit(0)).cast("long").alias(c) for c in counts])

    one, above = F.lit(1), F.col("parent_id")
    own = said("node_id", path=F.col("path"), nodes=one, roots=above.isNull())
    child = said("parent_id", claim=F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), children=one)
    each = nodes.select("tree_id", F.explode(F.when(above.isNull(), F.array(own)).otherwise(F.array(own, child))).alias("s"))
    each = each.unionByName(edges.select("tree_id", said("from_id", edges=one).alias("s"))).select("tree_id", "s.*")
    per_claim = each.groupBy("tree_id", "id", "claim").agg(F.min("path").alias("path"), *[F.sum(c).alias(c) for c in counts])
    of_id = Window.partitionBy("tree_id", "id")
    rows = per_claim.select("tree_id", "id", "claim", *counts, F.min("path").over(of_id).alias("known_path"), F.sum("nodes").over(of_id).alias("known"))
    wrong = ~F.coalesce(F.col("claim") == F.col("known_path"), F.lit(False))
    total = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).alias(name)
    out = rows.groupBy("tree_id").agg(
        total("nodes", "nodes"), total("roots", "roots"), total(F.when(wrong, F.col("children")), "path_mismatches"),
        total(F.when(F.col("nodes") > 0, F.col("nodes") - 1), "duplicate_nodes"), total("edges", "edges"),
        total(F.when(F.col("id").isNull() | (F.col("known") == 0), F.col("edges")), "unresolved_edges"))
    good = (F.col("roots") == 1) & (F.col("edges") == F.col("nodes") - 1) & (F.col("path_mismatches") + F.col("duplicate_nodes") + F.col("unresolved_edges") == 0)
    return out.withColumn("status", F.when(good, "complete").otherwise("failed"))
