"""Co-occurrence networks and centrality.

Graphs are two DataFrames: nodes ``(node, usage, ...)`` and undirected edges ``(src, dst, weight)``
with ``src < dst``.  Building them is one explode + one grouped count.  The iterative measures
(PageRank, closeness, betweenness) are loops of joins + aggregations over those tables; lineage
is cut every round with ``checkpoint()`` into the session's checkpoint folder, as each round reads the
previous one more than once.  Exact betweenness holds one row for each pair of nodes and is meant for item
vocabularies (the options of a question); on larger graphs it takes ``pivots``.  Closeness keeps bits, not pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.encode import split_multi, split_multi_distinct
from panelspark.functions.literals import local_table
from panelspark.session import checkpoint_dir

def _pairs(arr: Column) -> Column:
    """All (a, b) with a before b in a sorted, de-duplicated item array.  The array is one
    respondent's answer to a multi-select question, so its size is bounded by the option list."""
    n = F.size(arr)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.transform(
            F.filter(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: j <= n),
            lambda j: F.struct(F.element_at(arr, i).alias("src"), F.element_at(arr, j).alias("dst")))))


def cooccurrence(df: DataFrame, multi: str, measure: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, usage[, avg_measure])`` and ``edges(src, dst, weight)``.

    Items of a row are split, trimmed and de-duplicated (a repeated answer does not make a
    self-loop); each unordered pair of a row's items adds 1 to the edge weight.  With ``measure``,
    nodes also get the mean of that measure over their users (null measure counts as 0).

    Rows are first collapsed to their distinct item set (``groupBy(items)`` with map-side partial
    aggregation, so a hot item set becomes one weighted row per task); nodes and pairs are then
    expanded from the weighted sets only.
    """
    keep = [F.coalesce(F.col(measure).cast("double"), F.lit(0.0)).alias("m")] if measure else []
    items = df.where(F.col(multi).isNotNull()).select(split_multi_distinct(multi).alias("items"), *keep)
    set_aggs = [F.count(F.lit(1)).alias("w")] + ([F.sum("m").alias("wm")] if measure else [])
    sets = items.groupBy("items").agg(*set_aggs)
    exploded = sets.select(F.explode("items").alias("node"), "w", *(["wm"] if measure else []))
    aggs = [F.sum("w").alias("usage")]
    if measure:
        aggs.append((F.sum("wm") / F.sum("w")).alias("avg_measure"))
    nodes = exploded.groupBy("node").agg(*aggs)
    edges = (sets.where(F.size("items") >= 2).select(F.explode(_pairs(F.col("items"))).alias("p"), "w")
             .groupBy(F.col("p.src").alias("src"), F.col("p.dst").alias("dst"))
             .agg(F.sum("w").alias("weight")))
    return nodes, edges


def bipartite(df: DataFrame, single: str, multi: str) -> DataFrame:
    """``(src=single answer, dst=item, weight)``; each listed item adds 1 (rows with an empty
    single answer are skipped)."""
    base = df.select(F.trim(F.col(single)).alias("src"), split_multi(multi).alias("items"))
    base = base.where(F.col("src").isNotNull() & (F.col("src") != ""))
    return (base.select("src", F.explode("items").alias("dst"))
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def flow_edges(df: DataFrame, top: int | None = 15) -> DataFrame:
    """Layered flow trust -> engagement stage -> purchase stage with respondent counts.

    Engagement and purchase stages merge levels (``frequently``/``Almost always`` -> High Engage,
    purchase codes 3 and 4 -> High Purchase); a null engagement reads Low Engage, a null purchase
    No Purchase.  Rows with an empty trust answer are skipped.  ``top`` keeps the heaviest edges.
    """
    from panelspark.functions.encode import map_lookup, ordinal
    trust = F.trim(F.col("trust_factor"))
    eng = F.coalesce(map_lookup(S.FLOW_ENGAGE_LABELS, "engagement_freq"), F.lit(S.FLOW_ENGAGE_DEFAULT))
    pur_code = F.coalesce(ordinal("purchase_freq", S.PURCHASE_MAP), F.lit(0))
    pur = F.coalesce(map_lookup(S.FLOW_PURCHASE_LABELS, pur_code), F.lit(S.FLOW_PURCHASE_DEFAULT))
    base = df.select(trust.alias("t"), eng.alias("e"), pur.alias("p")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    arr = F.array(F.struct(F.col("t").alias("src"), F.col("e").alias("dst")),
                  F.struct(F.col("e").alias("src"), F.col("p").alias("dst")))
    edges = (base.select(F.explode(arr).alias("x")).groupBy("x.src", "x.dst")
             .agg(F.count(F.lit(1)).alias("weight")))
    if top is not None:
        edges = edges.orderBy(F.desc("weight"), "src", "dst").limit(top)
    return edges


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "weight")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _node_count(nodes: DataFrame) -> int:
    return nodes.count()


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, degree, degree_centrality = degree / (n - 1))``; isolated nodes get 0."""
    n = _node_count(nodes)
    deg = _both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.select("node").join(deg, "node", "left").fillna(0, subset=["degree"])
    return out.withColumn("degree_centrality", F.col("degree") / F.lit(float(max(n - 1, 1))) if n > 1 else F.lit(0.0))


def weighted_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, strength)`` = sum of incident edge weights."""
    s = _both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"))
    if nodes is None:
        return s
    return nodes.select("node").join(s, "node", "left").fillna(0, subset=["strength"])


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 100,
             tol: float = 1e-6, fixed_iter: int | None = None) -> DataFrame:
    """Weighted PageRank on the undirected graph (each edge both ways, weight = strength).

    Start 1/N; each round: mass flows along edges in proportion to weight / out-strength, the
    mass of dangling nodes is spread evenly, then ``(1 - d)/N + d * inflow``.  Stops when the L1
    change is below ``N * tol`` (or after ``fixed_iter`` rounds); ranks that have not converged after
    ``max_iter`` rounds are an error.  Returns ``(node, pagerank)``.
    """
    spark = nodes.sparkSession
    both = _both_ways(edges)
    out_w = both.groupBy("src").agg(F.sum("weight").alias("out_w"))
    trans = both.join(out_w, "src").select("src", "dst", (F.col("weight") / F.col("out_w")).alias("p")).persist()
    known = nodes.select("node").distinct().join(out_w.select(F.col("src").alias("node"), F.lit(False).alias("dangles")),
                                                 "node", "left")
    known = _cut(known.select("node", F.coalesce("dangles", F.lit(True)).alias("dangles")))
    n, loose = known.agg(F.count(F.lit(1)), F.sum(F.col("dangles").cast("long"))).first()
    if n == 0:
        return local_table(spark, [], "node string, pagerank double")
    ranks, dangling = known.withColumn("pr", F.lit(1.0 / n)), loose / n
    for _ in range(fixed_iter if fixed_iter is not None else max_iter):
        flow = (trans.join(ranks.select(F.col("node").alias("src"), "pr"), "src")
                .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("p")).alias("inflow")))
        new = _cut(ranks.join(flow, "node", "left").select(
            "node", "dangles", F.col("pr").alias("old"),
            (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("inflow", F.lit(0.0)) + F.lit(dangling / n))).alias("pr")))
        err, dangling = new.agg(F.sum(F.abs(F.col("pr") - F.col("old"))),
                                F.coalesce(F.sum(F.when(F.col("dangles"), F.col("pr"))), F.lit(0.0))).first()
        ranks = new.drop("old")
        if fixed_iter is None and err < n * tol:
            break
    else:
        if fixed_iter is None:
            raise RuntimeError(f"PageRank has not converged in {max_iter} rounds")
    trans.unpersist()
    return ranks.select("node", F.col("pr").alias("pagerank"))


def shortest_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unweighted distances ``(s, v, dist)`` for every reachable pair, by frontier expansion.

    Each round joins the newest frontier with the adjacency list and anti-joins what is already
    reached, so work per round is proportional to the new pairs only.  The output holds one row
    per reachable pair of nodes (inherent to all-pairs distances).
    """
    adj = _both_ways(edges).select(F.col("src").alias("v"), F.col("dst").alias("nbr")).distinct().persist()
    reached = nodes.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("dist"))
    frontier = reached
    while True:
        step = (frontier.join(adj, "v").select("s", F.col("nbr").alias("v"), (F.col("dist") + 1).alias("dist"))
                .dropDuplicates(["s", "v"]))
        frontier = _cut(step.join(reached.select("s", "v"), ["s", "v"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    adj.unpersist()
    return reached


def closeness(nodes: DataFrame, edges: DataFrame, blocks_per_pass: int = 256) -> DataFrame:
    """Unweighted closeness with the component-size correction:
    ``(r - 1) / sum(dist) * (r - 1) / (n - 1)`` where r = nodes reachable from v (incl. v).

    Breadth-first search from 64 sources at a time, a bit for each: a row ``(node, block)`` holds in ``seen`` which
    sources of a block have reached the node.  A round sends the bits that are new to the neighbours, joins them by
    ``bit_or``, and adds ``round * bits`` to the node's sum of distances, so no table of pairs is kept.  Blocks are dealt
    to passes: a pass holds at most ``blocks_per_pass`` rows for each node, whatever the size of the graph.  The graph is
    undirected, so what reaches a node is what the node reaches.
    """
    n = _node_count(nodes)
    adj = _both_ways(edges).select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct().persist()
    # 64 consecutive numbers of a partition make a block; numbers are pinned before they are used
    known = _cut(nodes.select("node").distinct().withColumn("number", F.monotonically_increasing_id()))
    known = known.select("node", F.shiftright("number", 6).alias("block"), F.expr("shiftleft(1L, int(number & 63))").alias("bit"))
    blocks = known.select("block").distinct().count()
    passes = max(-(-blocks // blocks_per_pass), 1)
    zero = F.lit(0).cast("long")
    sums = None
    for k in range(passes):
        mine = known.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == k)
        state = mine.select("node", "block", F.col("bit").alias("seen"), F.col("bit").alias("fresh"),
                            zero.alias("tot"), F.lit(1).cast("long").alias("r"))
        hops = 0
        while True:
            hops += 1
            sent = state.where("fresh != 0").join(adj, "node").select(
                F.col("nbr").alias("node"), "block", zero.alias("seen"), F.col("fresh").alias("got"), zero.alias("tot"), zero.alias("r"))
            held = state.select("node", "block", "seen", zero.alias("got"), "tot", "r")
            merged = held.unionByName(sent).groupBy("node", "block").agg(
                F.bit_or("seen").alias("seen"), F.bit_or("got").alias("got"), F.sum("tot").alias("tot"), F.sum("r").alias("r"))
            fresh = F.col("got").bitwiseAND(F.bitwise_not("seen"))
            state = _cut(merged.select("node", "block", F.col("seen").bitwiseOR(F.col("got")).alias("seen"), fresh.alias("fresh"),
                                       (F.col("tot") + hops * F.bit_count(fresh)).alias("tot"),
                                       (F.col("r") + F.bit_count(fresh)).alias("r")))
            if state.where("fresh != 0").isEmpty():
                break
        part = state.groupBy("node").agg(F.sum("tot").alias("tot"), F.sum("r").alias("r"))
        sums = part if sums is None else _cut(sums.unionByName(part).groupBy("node").agg(F.sum("tot").alias("tot"), F.sum("r").alias("r")))
    adj.unpersist()
    c = F.when(F.col("tot") > 0, (F.col("r") - 1) / F.col("tot") * (F.col("r") - 1) / F.lit(float(max(n - 1, 1))))
    return sums.select("node", F.coalesce(c, F.lit(0.0)).alias("closeness"))


def pivot_count(n: int, error: float, risk: float = 0.05) -> int:
    """Pivots after which every node's sampled betweenness (normalised) is within ``error`` of the exact one, but for a
    chance of ``risk``.

    A pivot adds to a node a value between 0 and ``n / (n - 1)``; Hoeffding's bound for draws without replacement, over
    all n nodes, gives ``k = ln(2 n / risk) (n / (n - 1))^2 / (2 error^2)``, at most n."""
    if n < 2:
        return n
    return min(n, math.ceil(math.log(2 * n / risk) * (n / (n - 1)) ** 2 / (2 * error * error)))


def _pivots(nodes: DataFrame, pivots: int, seed: int) -> DataFrame:
    """``pivots`` nodes drawn by md5 of seed and node, which any engine repeats."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string")).cast("binary"))
    return nodes.select("node").distinct().orderBy(draw, "node").limit(pivots)


def betweenness(nodes: DataFrame, edges: DataFrame, normalized: bool = True, pivots: int | None = None, seed: int = 7) -> DataFrame:
    """Betweenness with edge weight read as a *distance* (as the source does); weights must be positive.

    ``pivots`` (default: all nodes, which is exact) takes that many seeded sources instead and scales what they give by
    ``n / pivots``: rows and work fall in that proportion, and ``pivot_count`` tells how many an error needs.

    All-source Brandes on DataFrames: (1) relaxation of the pairs that changed last gives ``d(s, v)``;
    (2) the shortest-path DAG keeps edges with ``d(s,u) + w = d(s,v)``; (3) path counts sigma and the
    depth of each node (its longest DAG path) propagate forward until the depths stand still, which they do
    after as many rounds as the DAG is deep; (4) dependencies delta propagate backward for that many
    rounds, so no test compares rounded sums.  Normalised by 1/((n-1)(n-2)) over ordered pairs (the
    undirected double count is part of that factor).
    """
    n = _node_count(nodes)
    adj = _both_ways(edges).select(F.col("src").alias("u"), F.col("dst").alias("v"),
                                   F.col("weight").cast("double").alias("w")).persist()
    if not adj.where(~(F.col("w") > 0)).isEmpty():
        raise ValueError("betweenness needs positive edge weights")
    # (1) distances
    sampled = pivots is not None and pivots < n
    if sampled and pivots < 1:
        raise ValueError("betweenness needs at least one pivot")
    sources = _cut(_pivots(nodes, pivots, seed)) if sampled else nodes
    dist = sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0.0).alias("d"))
    frontier = dist
    while True:
        cand = (frontier.withColumnRenamed("v", "u").join(adj, "u")
                .select("s", "v", (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("double").alias("old")))
        merged = _cut(dist.withColumn("old", F.col("d")).unionByName(cand).groupBy("s", "v")
                      .agg(F.min("d").alias("d"), F.min("old").alias("old")))
        dist = merged.drop("old")
        frontier = merged.where(F.col("old").isNull() | (F.col("d") < F.col("old"))).drop("old")
        if frontier.isEmpty():
            break
    # (2) DAG edges per source: u -> v with d(s,u) + w == d(s,v)
    du = dist.select("s", F.col("v").alias("u"), F.col("d").alias("du"))
    dv = dist.select("s", "v", F.col("d").alias("dv"))
    dag = (du.join(adj, "u").join(dv, ["s", "v"])
           .where(F.col("du") + F.col("w") == F.col("dv")).select("s", "u", "v").persist())
    # (3) sigma: number of shortest paths s -> v
    root = F.col("s") == F.col("v")
    sigma = dist.select("s", "v", F.when(root, F.lit(1.0)).otherwise(F.lit(0.0)).alias("sigma"), F.lit(0).alias("depth"))
    rounds = 0
    while True:
        inflow = (dag.join(sigma.withColumnRenamed("v", "u"), ["s", "u"])
                  .groupBy("s", "v").agg(F.sum("sigma").alias("inflow"), (F.max("depth") + 1).alias("deeper")))
        sigma = _cut(sigma.select("s", "v").join(inflow, ["s", "v"], "left").select(
            "s", "v", F.when(root, F.lit(1.0)).otherwise(F.coalesce("inflow", F.lit(0.0))).alias("sigma"),
            F.coalesce("deeper", F.lit(0)).alias("depth")))
        deepest = sigma.agg(F.max("depth")).first()[0] or 0
        if deepest <= rounds:
            break
        rounds += 1
    # (4) delta(s, v) = sum over DAG children x of sigma(s,v)/sigma(s,x) * (1 + delta(s,x))
    sv = sigma.select("s", F.col("v").alias("u"), F.col("sigma").alias("su"))
    sx = sigma.select("s", "v", F.col("sigma").alias("sx"))
    dag_w = dag.join(sv, ["s", "u"]).join(sx, ["s", "v"]).select("s", "u", "v", (F.col("su") / F.col("sx")).alias("ratio"))
    dag_w = dag_w.persist()
    delta = sigma.select("s", "v", F.lit(0.0).alias("delta"))
    for _ in range(rounds):
        back = (dag_w.join(delta, ["s", "v"])
                .groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("ratio") * (1 + F.col("delta"))).alias("nd")))
        delta = _cut(delta.select("s", "v").join(back, ["s", "v"], "left")
                     .select("s", "v", F.coalesce("nd", F.lit(0.0)).alias("delta")))
    bc = delta.where(F.col("s") != F.col("v")).groupBy(F.col("v").alias("node")).agg(F.sum("delta").alias("b"))
    scale = 1.0 / ((n - 1) * (n - 2)) if (normalized and n > 2) else (0.5 if not normalized else 1.0)
    if sampled:
        scale *= n / pivots
    out = nodes.select("node").join(bc, "node", "left").select(
        "node", (F.coalesce(F.col("b"), F.lit(0.0)) * F.lit(scale)).alias("betweenness"))
    adj.unpersist()
    dag.unpersist()
    dag_w.unpersist()
    return out


def centrality_table(nodes: DataFrame, edges: DataFrame, with_betweenness: bool = True) -> DataFrame:
    """Per node usage, degree centrality, strength, closeness, PageRank (and betweenness)."""
    out = (nodes.join(degree_centrality(nodes, edges), "node", "left")
           .join(weighted_degree(edges, nodes), "node", "left")
           .join(closeness(nodes, edges), "node", "left")
           .join(pagerank(nodes, edges), "node", "left"))
    if with_betweenness:
        out = out.join(betweenness(nodes, edges), "node", "left")
    return out


def top_node(table: DataFrame, metric: str) -> DataFrame:
    """Node with the highest ``metric`` (ties by node name)."""
    return table.orderBy(F.desc(metric), "node").limit(1).select(F.lit(metric).alias("metric"), "node",
                                                                 F.col(metric).cast("double").alias("value"))


def edge_weight(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Weight of the named undirected edge (0 when absent)."""
    lo, hi = sorted([a, b])
    hit = edges.where((F.col("src") == lo) & (F.col("dst") == hi)).agg(F.sum("weight").alias("weight"))
    return hit.select(F.lit(lo).alias("src"), F.lit(hi).alias("dst"),
                      F.coalesce(F.col("weight"), F.lit(0)).cast("long").alias("weight"))


def event_baskets(events: DataFrame) -> DataFrame:
    """Baskets of event types per (user, day): ``(user_id, day, event_types)`` joined by ';'."""
    return (events.groupBy("user_id", F.to_date("ts").alias("day"))
            .agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("event_types")))
