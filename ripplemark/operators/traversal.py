"""Queries over the graph: neighbourhoods, roles, projection, PageRank, cheapest paths, ranking, errors.

Loops keep narrow tables and write them out between rounds; each round is one
join on a node and one aggregation with partial sums, so hub nodes are combined
before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import written
from ..functions.scoring import composite_score, edge_weight, evidence_source, explanation, impact_category, impact_confidence, safe_cost, severity
from ..schema import CANDIDATE, CONTAIN, IMPLEMENT, IMPORT, INHERIT, INVOKE, OVERRIDE, PATH_OTHER_WEIGHT
from ..sieve import Sieve
from .mesh import ranks_and_steps

DECAY = 0.75


# ------------------------------------------------------------------ neighbourhood


def followed_edges(edges: DataFrame, edge_types: set[str] | None = None, include_candidates: bool = False) -> DataFrame:
    """Edges that a walk may take: given types, or all but unsure ones."""
    if edge_types is not None:
        return edges.filter(F.col("edge_type").isin(*sorted(edge_types)))
    return edges if include_candidates else edges.filter(F.col("edge_type") != CANDIDATE)


def ego_nodes(edges: DataFrame, seeds: DataFrame, k: int = 2, edge_types: set[str] | None = None, include_candidates: bool = False) -> DataFrame:
    """(node_id, hop) of all within k steps of seeds (node_id), in either direction."""
    usable = followed_edges(edges, edge_types, include_candidates)
    both = usable.select(F.col("src").alias("at"), F.col("dst").alias("to")).union(usable.select("dst", "src"))
    seen = written(seeds.select("node_id", F.lit(0).alias("hop")).distinct(), "ego")
    for hop in range(1, k + 1):
        edge = seen.filter(F.col("hop") == hop - 1).select(F.col("node_id").alias("at"))
        new = both.join(edge, "at", "left_semi").select(F.col("to").alias("node_id")).distinct()
        new = new.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(written(new, "ego"))
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_id), unsure ones too."""
    return edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id) of all that seeds reach in either direction; rounds go on until one finds nothing new."""
    both = written(edges.select(F.col("src").alias("at"), F.col("dst").alias("node_id")).union(edges.select("dst", "src")).distinct(), "undirected")
    seen = written(seeds.select("node_id").distinct(), "reached")
    edge = seen
    while True:
        edge = written(both.join(edge.select(F.col("node_id").alias("at")), "at", "left_semi").select("node_id").distinct().join(seen, "node_id", "left_anti"), "reached")
        if edge.isEmpty():
            break
        seen = seen.union(edge)
    return seen


# -------------------------------------------------------------------------- roles


def impact_roles(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, is_direct, is_candidate, is_callee, is_indirect) of the nodes that are no seeds.

    An unsure call counts only for a node without a confirmed one.
    """
    ids = seeds.select("node_id").distinct()
    into = edges.join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node_id"))
    into = into.agg(F.bool_or(F.col("edge_type").isin(INVOKE, OVERRIDE, INHERIT)).alias("is_direct"), F.bool_or(F.col("edge_type") == CANDIDATE).alias("maybe"))
    out = edges.filter(F.col("edge_type") == INVOKE).join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id"), F.lit(True).alias("is_callee")).distinct()
    rows = nodes.join(ids, "node_id", "left_anti").join(into, "node_id", "left").join(out, "node_id", "left")
    no = F.lit(False)
    rows = rows.withColumns({"is_direct": F.coalesce("is_direct", no), "is_callee": F.coalesce("is_callee", no)}).withColumn("is_candidate", F.coalesce("maybe", no) & ~F.col("is_direct"))
    rest = ~F.col("is_direct") & ~F.col("is_callee") & ~F.col("is_candidate") & F.col("category").isin("function", "method", "class", "struct")
    return rows.select("node_id", "is_direct", "is_candidate", "is_callee", rest.alias("is_indirect"))


def node_status(nodes: DataFrame, roles: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, status) as a viewer shows it: seed, direct or indirect caller, callee, test or normal."""
    seed = seeds.select("node_id", F.lit(True).alias("is_seed")).distinct()
    test = F.lower("file").contains("test")
    status = (
        F.when(F.col("is_seed"), "seed")
        .when(F.col("is_direct"), F.when(test, "test").otherwise("direct_caller"))
        .when(F.col("is_indirect"), F.when(test, "test").otherwise("indirect_caller"))
        .when(F.col("is_callee"), "callee")
        .when(test, "test")
        .otherwise("normal")
    )
    return nodes.join(seed, "node_id", "left").join(roles, "node_id", "left").select("node_id", status.alias("status"))


def file_rollup(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """(file, seeds, callers, total) of the shown nodes, the most affected files first."""
    rows = nodes.join(status, "node_id").groupBy("file")
    rows = rows.agg(F.count_if(F.col("status") == "seed").alias("seeds"), F.count_if(F.col("status").isin("direct_caller", "indirect_caller")).alias("callers"), F.count("*").alias("total"))
    return rows.orderBy(F.desc(F.col("seeds") * 10 + F.col("callers")), "file")


def search_names(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.filter(F.lower("name").contains(text.lower()))


# --------------------------------------------------------------------- projection


def _arrow(a: str, b: str, factor: float, kind: Column, confidence: Column) -> Column:
    weight = F.col("weight") * factor if factor != 1.0 else F.col("weight")
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), weight.alias("w"), kind.alias("edge_type"), confidence.alias("confidence"))


def _arrows_of(edges: DataFrame) -> tuple[DataFrame, Column]:
    """edges with their weights, and the arrows of one: there, and back if a change spreads back."""
    kind = F.col("edge_type")
    sure = F.coalesce("confidence", F.lit(1.0))
    one = F.lit(1.0)
    arrows = (
        F.when(kind.isin(INVOKE, CANDIDATE), F.array(_arrow("dst", "src", 1.0, kind, sure), _arrow("src", "dst", 0.30, kind, sure)))
        .when(kind == OVERRIDE, F.array(_arrow("dst", "src", 1.0, kind, one), _arrow("src", "dst", 0.80, kind, one)))
        .when(kind.isin(INHERIT, IMPLEMENT, IMPORT), F.array(_arrow("dst", "src", 1.0, kind, one)))
        .when(kind == CONTAIN, F.array(_arrow("src", "dst", 0.60, kind, one), _arrow("dst", "src", 0.60, kind, one)))
        .otherwise(F.array(_arrow("src", "dst", 0.50, kind, one)))
    )
    rows = edges.select("edge_seq", "src", "dst", "edge_type", "confidence").withColumn("weight", edge_weight(kind, F.col("confidence")))
    return rows, arrows


def _of_loops(arrows: Column) -> Column:
    """An edge from a node to itself has arrows of one pair, of which the last stands."""
    return F.when(F.col("src") == F.col("dst"), F.slice(arrows, -1, 1)).otherwise(arrows)


def impact_projection(edges: DataFrame, node_order: DataFrame | None = None, simple: bool = False) -> DataFrame:
    """(src, dst, weight, cost, edge_type, confidence): how a change spreads.

    Callers are reached from callees and so on; of several arrows on a pair the
    last one stands, in the order of the source's place, the pair's first edge
    and the edge.  node_order: (node_id, node_seq); edges' own order without it.
    simple: that no two edges join the same two nodes, whichever way, is known,
    so every arrow stands and none are brought together.
    """
    rows, arrows = _arrows_of(edges)
    if simple:
        return _as_arrows(rows.select(F.explode(_of_loops(arrows)).alias("x")))
    rows = rows.withColumn("pair_seq", F.min("edge_seq").over(Window.partitionBy("src", "dst")))
    if node_order is not None:
        rows = rows.join(node_order.select(F.col("node_id").alias("src"), "node_seq"), "src")
    else:
        rows = rows.withColumn("node_seq", F.lit(0).cast("long"))
    rows = rows.select("node_seq", "pair_seq", "edge_seq", F.posexplode(arrows).alias("k", "x"))
    last = rows.groupBy(F.col("x.a").alias("src"), F.col("x.b").alias("dst")).agg(F.max_by("x", F.struct("node_seq", "pair_seq", "edge_seq", "k")).alias("x"))
    return _as_arrows(last)


def impact_links(edges: DataFrame) -> DataFrame:
    """impact_projection of simple edges with an edge's arrows in one row: src, dst, weight, cost, back_weight, back_cost, edge_type, confidence, forward.

    back_weight is 0 where no arrow leads back; forward is 1 where src is the edge's own, else 0.
    """
    kind, src, dst = F.col("edge_type"), F.col("src"), F.col("dst")
    calls = kind.isin(INVOKE, CANDIDATE)
    turned = kind.isin(INVOKE, CANDIDATE, OVERRIDE, INHERIT, IMPLEMENT, IMPORT)  # their first arrow leads from dst
    there = F.when(kind == CONTAIN, 0.60).when(turned, 1.0).otherwise(0.50)
    back = F.when(calls, 0.30).when(kind == OVERRIDE, 0.80).when(kind == CONTAIN, 0.60)
    weight = edge_weight(kind, F.col("confidence"))
    loop = (src == dst) & back.isNotNull()  # of its two arrows, which are one pair's, the last stands
    rows = edges.select(
        F.when(turned, dst).otherwise(src).alias("a"),
        F.when(turned, src).otherwise(dst).alias("b"),
        (weight * F.when(loop, back).otherwise(there)).alias("w"),
        F.when(~loop, weight * back).alias("back"),
        "edge_type",
        F.when(calls, F.coalesce("confidence", F.lit(1.0))).otherwise(1.0).alias("confidence"),
        (~turned).cast("double").alias("forward"),
    )
    cost, back = safe_cost(F.col("w")), F.col("back")
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight"), cost.alias("cost"), F.coalesce(back, F.lit(0.0)).alias("back_weight"), safe_cost(back).alias("back_cost"), "edge_type", "confidence", "forward")


def _as_arrows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("x.a").alias("src"), F.col("x.b").alias("dst"), F.col("x.w").alias("weight"), safe_cost(F.col("x.w")).alias("cost"), F.col("x.edge_type").alias("edge_type"), F.col("x.confidence").alias("confidence"))


# ----------------------------------------------------------------------- PageRank


def personalized_pagerank(node_ids: DataFrame, arrows: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 50, tolerance: float | None = 1e-5) -> DataFrame:
    """(node_id, ppr) after that many rounds, or fewer once the summed change is below tolerance.

    Weight that reaches a node without arrows goes back to the seeds.  Without
    a tolerance no round asks the driver for anything; with one, each asks for
    its change and for the weight to go back.  Every round is written, with what
    the next one needs of a node.
    """
    seed = seeds.select("node_id").distinct().join(node_ids.select("node_id"), "node_id", "left_semi")
    n = seed.count()
    if not n:
        return node_ids.select("node_id", F.lit(0.0).alias("ppr")).limit(0)
    out = arrows.groupBy("src").agg(F.sum("weight").alias("total"))
    share = written(arrows.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "ppr-shares")
    start = node_ids.select("node_id").distinct().join(seed.withColumn("p0", F.lit(1.0 / n)), "node_id", "left").join(out.select(F.col("src").alias("node_id"), F.lit(True).alias("leads")), "node_id", "left")
    start = written(start.select("node_id", F.coalesce("p0", F.lit(0.0)).alias("p0"), F.coalesce("leads", F.lit(False)).alias("leads")), "ppr-start")
    now, lost = start.withColumn("p", F.col("p0")), None
    for _ in range(iterations):
        got = now.select("node_id", "p").join(share, now["node_id"] == share["src"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("share")).alias("flow"))
        after = now.join(got, F.col("node_id") == F.col("dst"), "left")
        if lost is None:  # one row beside each; AQE broadcasts it
            gone = now.filter(~F.col("leads")).agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("lost"))
            after = after.crossJoin(F.broadcast(gone))
        else:
            after = after.withColumn("lost", F.lit(lost))
        after = after.select("node_id", "p0", "leads", ((1 - alpha) * F.col("p0") + alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("p0"))).alias("q"), "p")
        after = written(after, "ppr")
        now = after.select("node_id", "p0", "leads", F.col("q").alias("p"))
        if tolerance is not None:
            change, lost = after.agg(F.sum(F.abs(F.col("q") - F.col("p"))), F.coalesce(F.sum(F.when(~F.col("leads"), F.col("q"))), F.lit(0.0))).first()
            if (change or 0.0) < tolerance:
                break
    return now.select("node_id", F.col("p").alias("ppr"))


# -------------------------------------------------------------------------- paths


def cheapest_paths(arrows: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(seed, node_id, cost, hops, path) of least cost from each seed, then fewest hops, then the smaller path.

    Only pairs that got better go on to the next round; there is no limit on
    hops, as a limit must not turn a dear short path into the cheapest one.  Rounds
    go on until no pair gets better, which costs above 0 bring about.  With
    max_hops the cheapest paths of more hops are left out: costs and hops are
    settled over all hops first, and paths made for what stays, hop by hop.
    """
    steps = written(arrows.select(F.col("src").alias("node_id"), F.col("dst").alias("to"), F.col("cost").alias("step")), "path-steps")
    start = seeds.select(F.col("node_id").alias("seed"), "node_id").distinct()
    if max_hops is None:
        return _settled(steps, start, True)
    known = _settled(steps, start, False)
    near = written(known.filter(F.col("hops") <= max_hops), "paths-near")
    parts = [written(start.select("seed", "node_id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("node_id").alias("path")), "paths-made")]
    for hop in range(1, max_hops + 1):
        tried = parts[-1].join(steps, "node_id").select("seed", F.col("to").alias("node_id"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("to")).alias("path"))
        made = tried.join(near.filter(F.col("hops") == hop), ["seed", "node_id", "cost"]).groupBy("seed", "node_id", "cost", "hops").agg(F.min("path").alias("path"))
        parts.append(written(made, "paths-made"))
    found = reduce(DataFrame.unionByName, parts)
    if found.count() < near.count():  # sums that round to one cost can leave a pair without its predecessor
        return _settled(steps, start, True).filter(F.col("hops") <= max_hops)
    return found


def _settled(steps: DataFrame, start: DataFrame, with_path: bool) -> DataFrame:
    """(seed, node_id, cost, hops[, path]) when no round betters any; steps: node_id, to, step."""
    names = ["cost", "hops", "path"] if with_path else ["cost", "hops"]
    first = [F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("node_id").alias("path")][: len(names)]
    known = written(start.select("seed", "node_id", F.struct(*first).alias("best"), F.lit(True).alias("fresh")), "paths")
    while True:
        tried = known.filter("fresh").select("seed", "node_id", "best.*").join(steps, "node_id")
        if with_path:  # without, a step back is dearer or longer, so it betters nothing
            tried = tried.filter(~F.array_contains("path", F.col("to"))).withColumn("path", F.concat("path", F.array("to")))
        tried = tried.withColumns({"cost": F.col("cost") + F.col("step"), "hops": F.col("hops") + 1})
        tried = tried.select("seed", F.col("to").alias("node_id"), F.struct(*names).alias("best"), F.lit(None).cast(known.schema["best"].dataType).alias("old"))
        both = known.select("seed", "node_id", "best", F.col("best").alias("old")).unionByName(tried)
        both = both.groupBy("seed", "node_id").agg(F.min("best").alias("best"), F.min("old").alias("old"))
        known = written(both.select("seed", "node_id", "best", (F.col("old").isNull() | (F.col("best") < F.col("old"))).alias("fresh")), "paths")
        if known.filter("fresh").isEmpty():
            break
    return known.select("seed", "node_id", "best.*")


def path_edges(paths: DataFrame, arrows: DataFrame) -> DataFrame:
    """paths with evidence: the arrows of each path in order."""
    steps = paths.filter("hops > 0").select("seed", "node_id", F.posexplode("path").alias("k", "dst"), F.col("path").alias("p")).filter("k > 0")
    steps = steps.withColumn("src", F.get("p", F.col("k") - 1)).drop("p").join(arrows.select("src", "dst", "weight", "edge_type", "confidence"), ["src", "dst"])
    step = F.struct("k", F.col("src").alias("from"), F.col("dst").alias("to"), "edge_type", "confidence", "weight")
    told = steps.groupBy("seed", "node_id").agg(F.array_sort(F.collect_list(step)).alias("evidence"))
    return paths.join(told, ["seed", "node_id"], "left")


def best_energies(paths: DataFrame, k_hops: int, decay: float = DECAY, *more: str) -> DataFrame:
    """(node_id, energy, hops, relation, seed, evidence, more) of the strongest path within k hops; ties to the smaller seed."""
    near = paths.filter((F.col("hops") > 0) & (F.col("hops") <= k_hops))
    near = near.withColumn("energy", F.aggregate("evidence", F.lit(1.0), lambda acc, s: acc * s["weight"] * decay))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("energy"), "seed"))).filter("_r = 1 and energy > 0")
    return best.select("node_id", "energy", "hops", F.element_at("evidence", -1)["edge_type"].alias("relation"), "seed", "evidence", *more)


# ------------------------------------------------------------------------- ranking


def seed_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, ppr) as rank_impact takes it by default, for several rankings of the same seeds."""
    arrows = written(impact_projection(edges, nodes.select("node_id", "node_seq")), "impact")
    return written(personalized_pagerank(nodes.select("node_id"), arrows, seeds), "ppr-of-seeds")


def rank_impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k_hops: int = 3, decay: float = DECAY, restart: float = 0.15, iterations: int = 50, tolerance: float | None = 1e-5, ppr: DataFrame | None = None) -> DataFrame:
    """Every node that a change of seeds reaches, by how much; ties by the nodes' order.

    ppr: what seed_pagerank gave for the same seeds, where it is there already; it does not depend on hops.
    """
    seeds = seeds.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi")
    arrows = written(impact_projection(edges, nodes.select("node_id", "node_seq")), "impact")
    if ppr is None:
        ppr = personalized_pagerank(nodes.select("node_id"), arrows, seeds, 1 - restart, iterations, tolerance)
    others = ppr.join(seeds, "node_id", "left_anti")
    top = others.agg(F.max("ppr").alias("top")).select(F.when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("top"))
    energies = best_energies(path_edges(cheapest_paths(arrows, seeds, k_hops), arrows), k_hops, decay)
    return _told(nodes.join(seeds, "node_id", "left_anti").join(energies, "node_id").join(ppr, "node_id").crossJoin(F.broadcast(top)))


def rank_linked(nodes: DataFrame, links: DataFrame, seeds: DataFrame, k_hops: int = 3, decay: float = DECAY, restart: float = 0.15, iterations: int = 50, tolerance: float = 1e-5) -> DataFrame | None:
    """rank_impact of a graph too large for loops over tables; links as impact_links has them, one arrow for any two nodes and way.

    None where hashes of ids or sums of costs don't settle it: two nodes are alike, a cheapest path lacks an arrow
    or leads over what is no node.
    """
    got = written(ranks_and_steps(nodes.select("node_id"), links, seeds, k_hops, 1 - restart, iterations, tolerance), "whole-ranks")
    if not got.filter("kind = 3").isEmpty():
        return None
    pairs = got.filter("kind = 0")
    met = pairs.select(F.col("node").alias("key")).distinct()
    keyed = nodes.withColumn("key", F.xxhash64("node_id"))
    near = written(Sieve(met).met(keyed, "key").join(met, "key", "left_semi"), "whole-near")
    steps = got.filter("kind = 1")
    for end in ("src", "node"):
        steps = steps.join(near.select(F.col("key").alias(end), F.col("node_id").alias(f"{end}_id")), end)
    steps = written(steps.select("seed", "src", "node", "hops", "src_id", "node_id", "edge_type", "confidence", "weight"), "whole-steps")
    start = pairs.filter("hops = 0").join(near, pairs["node"] == near["key"])
    step = F.struct((F.col("hops") - 1).alias("k"), F.col("src_id").alias("from"), F.col("node_id").alias("to"), "edge_type", "confidence", "weight")
    none = F.array().cast(steps.select(F.array(step).alias("x")).schema["x"].dataType)
    made = [written(start.select("seed", "node", F.struct(F.array("node_id").alias("path"), none.alias("evidence")).alias("best")), "whole-paths")]
    for hop in range(1, k_hops + 1):
        on = made[-1].select("seed", F.col("node").alias("src"), "best")
        tried = steps.filter(F.col("hops") == hop).join(on, ["seed", "src"])
        tried = tried.select("seed", "node", F.struct(F.concat("best.path", F.array("node_id")).alias("path"), F.concat("best.evidence", F.array(step)).alias("evidence")).alias("best"))
        made.append(written(tried.groupBy("seed", "node").agg(F.min("best").alias("best")), "whole-paths"))
    paths = reduce(DataFrame.unionByName, made)
    if paths.count() < pairs.count():
        return None
    ends = pairs.select("seed", "node", "hops", "ppr").filter("hops > 0").join(pairs.filter("hops = 0").select("node"), "node", "left_anti")
    rows = paths.join(ends, ["seed", "node"]).select(F.element_at("best.path", 1).alias("seed"), F.col("node").alias("node_id"), "hops", "best.evidence", "ppr")
    best = best_energies(rows, k_hops, decay, "ppr").withColumnRenamed("node_id", "key")
    top = got.filter("kind = 2").agg(F.max("ppr").alias("top")).select(F.when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("top"))
    return _told(written(near.join(best, "key").drop("key").crossJoin(F.broadcast(top)), "whole-best"))


def _told(rows: DataFrame) -> DataFrame:
    """The ranking's columns; rows: nodes with energy, hops, relation, evidence, ppr and the largest ppr, top."""
    rows = rows.withColumn("impact_score", composite_score(F.col("energy"), F.col("ppr") / F.col("top")))
    hops, relation, score = F.col("hops"), F.col("relation"), F.col("impact_score")
    told = F.transform("evidence", lambda s: F.struct(s["from"], s["to"], s["edge_type"], s["confidence"], F.round(s["weight"], 4).alias("weight")))
    rows = rows.select(
        "node_id",
        "name",
        "file",
        "line",
        "category",
        "impact_score",
        severity(score, hops, relation, F.col("category")).alias("severity"),
        hops.alias("hop_distance"),
        relation.alias("primary_relationship"),
        explanation(F.col("name"), F.col("file"), F.col("category"), hops, relation, score).alias("causal_explanation"),
        told.alias("evidence_path"),
        impact_category(relation, hops).alias("impact_category"),
        evidence_source(relation).alias("evidence_source"),
        impact_confidence(relation, hops).alias("confidence_classification"),
        F.lit(False).alias("is_modification_required"),
        "node_seq",
    )
    head = ["node_id", "name", "file", "line", "category", "impact_score"]
    return ranked(rows, "impact_score", "node_seq").select(*head, "rank", *[c for c in rows.columns if c not in head])


def ranked(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """rows with rank 1, 2, ... by score: a place in its sorted partition, after those of the partitions before."""
    order = (F.desc(score), F.col(tie))
    parts = written(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn("_place", place).join(F.broadcast(before.select("_part", "_before")), "_part")
    return out.withColumn("rank", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_part", "_place", "_before")


# ------------------------------------------------------------------------ evidence


def path_strength(steps: Column) -> Column:
    """Product over steps (edge_type, confidence) of base weight times confidence, each at least 0.0001."""
    return F.aggregate(steps, F.lit(1.0), lambda acc, s: acc * F.greatest(F.lit(1e-4), edge_base(s["edge_type"]) * F.coalesce(s["confidence"], F.lit(1.0))))


def edge_base(edge_type: Column) -> Column:
    from ..functions.scoring import base_weight

    return base_weight(edge_type, PATH_OTHER_WEIGHT)


def evidence_paths(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_length: int = 5, keep: int = 2) -> DataFrame:
    """(target, path_no, strength, path, steps): from seeds to each node along edges, and against them.

    The shortest paths first, then the strongest; a path found in both
    directions is listed twice.
    """
    weight = edge_weight(F.col("edge_type"), F.col("confidence"))
    last = edges.join(nodes.select(F.col("node_id").alias("src"), "node_seq"), "src").withColumn("pair_seq", F.min("edge_seq").over(Window.partitionBy("src", "dst")))
    plain = last.groupBy("src", "dst").agg(F.max_by(F.struct(weight.alias("w")), F.struct("node_seq", "pair_seq", "edge_seq")).alias("x"), F.min_by(F.struct("edge_type", "confidence"), "edge_seq").alias("first"))
    plain = written(plain.select("src", "dst", F.col("x.w").alias("weight"), safe_cost(F.col("x.w")).alias("cost"), F.col("first.edge_type").alias("edge_type"), F.col("first.confidence").alias("confidence")), "evidence-edges")
    against = plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "cost", "edge_type", "confidence")
    seeds = seeds.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi")
    parts = [path_edges(cheapest_paths(way, seeds, max_length), way).withColumn("way", F.lit(k)) for k, way in enumerate((plain, against))]
    rows = parts[0].unionByName(parts[1]).filter((F.col("hops") > 0) & (F.col("hops") <= max_length)).join(seeds, "node_id", "left_anti")
    rows = rows.withColumn("strength", path_strength(F.col("evidence")))
    order = Window.partitionBy("node_id").orderBy("hops", F.desc("strength"), "seed", "way")
    rows = rows.withColumn("path_no", F.row_number().over(order)).filter(F.col("path_no") <= keep)
    return rows.select(F.col("node_id").alias("target"), "path_no", "strength", "path", F.transform("evidence", lambda s: F.struct(s["edge_type"], s["confidence"])).alias("steps"))


# -------------------------------------------------------------------------- errors


#: Fixed value: what reads as an annotated parameter.
PARAMETER = r"([A-Za-z0-9_]+)\s*:\s*[A-Za-z0-9_\[\],\s]+(?:=\s*[^,)]+)?"


def added_parameters(diff_lines: DataFrame) -> DataFrame:
    """(param) that added lines (line) annotate and, from there on, never follow with an equals sign."""
    added = diff_lines.filter(F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    names = added.select("line", F.explode(F.regexp_extract_all("line", F.lit(PARAMETER), F.lit(1))).alias("param"))
    return names.filter(~F.expr("substring(line, instr(line, param))").contains("=")).select("param").distinct()


def predicted_errors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """What may break where: one row for each seed and call site of it, and for each override of it."""
    changed = added_parameters(diff_lines).agg((F.count("*") > 0).alias("changed"))
    seed = nodes.join(seeds.select("node_id").distinct(), "node_id", "left_semi").select(F.col("node_id").alias("dst"), F.col("name").alias("seed_name"), F.col("file").alias("seed_file"))
    at = nodes.select(F.col("node_id").alias("src"), "file", "line", F.col("name").alias("symbol"), "snippet")
    kinds = edges.filter(F.col("edge_type").isin(INVOKE, OVERRIDE)).select("src", "dst", "edge_type").distinct()
    rows = kinds.join(seed, "dst").join(at, "src").crossJoin(F.broadcast(changed))
    test = F.lower("file").contains("test")
    override = F.col("edge_type") == OVERRIDE
    level = F.when(~override & ~test & F.col("changed"), "CRITICAL").otherwise("HIGH")
    kind = F.when(override, "LiskovSubstitutionViolation / SignatureMismatch").when(test, "AssertionError / TestFailure").when(F.col("changed"), "TypeError: CallSignatureMismatch").otherwise("DownstreamRegressionRisk")
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    cause = F.when(override, F.concat(F.lit("Method '"), "symbol", F.lit("' overrides the changed '"), "seed_name", F.lit("'."))).when(test, F.concat(F.lit("A test calls the changed '"), "seed_name", F.lit("'."))).otherwise(F.concat(F.lit("'"), "symbol", F.lit("' in "), "file", F.lit(" calls '"), "seed_name", F.lit("', which changed in "), "seed_file", F.lit(".")))
    fix = F.when(override, F.concat(F.lit("Bring the override's parameters in line at "), place)).when(test, F.concat(F.lit("Review the test's expectations at "), place)).otherwise(F.concat(F.lit("Review the call's arguments at "), place))
    return rows.select(level.alias("severity"), kind.alias("error_type"), "file", "line", "symbol", "snippet", cause.alias("cause"), fix.alias("recommended_fix"), F.col("dst").alias("seed"), F.col("src").alias("node_id"))
