"""Registered queries: co-occurrence networks and centrality."""

from __future__ import annotations

from panelspark.operators import network as N
from panelspark.plans.common import encoded
from panelspark.plans.oracle import r, with_enc
from panelspark.plans.registry import register, rounded
from panelspark.sources.tables import read_table


def _split_sql(col: str) -> str:
    return f"list_filter(list_transform(string_split({col}, ';'), lambda x: trim(x)), lambda x: x <> '')"


def _items_cte(src: str, id_col: str, multi: str, extra: str = "") -> str:
    return f"""items AS (SELECT {id_col} AS rid, unnest(list_distinct({_split_sql(multi)})) AS item{extra}
               FROM {src} WHERE {multi} IS NOT NULL)"""


def _edges_sql(items: str = "items") -> str:
    return f"""SELECT a.item AS src, b.item AS dst, count(*) AS weight
FROM {items} a JOIN {items} b ON a.rid = b.rid AND a.item < b.item GROUP BY 1, 2"""


@register("platform_nodes", with_enc(f", {_items_cte('enc', 'id', 'platforms')}\n"
                                     "SELECT item AS node, count(*) AS usage FROM items GROUP BY 1"))
def q_platform_nodes(spark, sf_dir):
    nodes, _ = N.cooccurrence(encoded(spark, sf_dir), "platforms")
    return nodes


@register("platform_edges", with_enc(f", {_items_cte('enc', 'id', 'platforms')}\n" + _edges_sql()))
def q_platform_edges(spark, sf_dir):
    _, edges = N.cooccurrence(encoded(spark, sf_dir), "platforms")
    return edges


@register("content_nodes_purchase", with_enc(
    f", {_items_cte('enc', 'id', 'content_type', ', coalesce(CAST(purchase_ord AS DOUBLE), 0.0) AS m')}\n"
    f"SELECT item AS node, count(*) AS usage, {r('avg(m)')} AS avg_measure FROM items GROUP BY 1"))
def q_content_nodes_purchase(spark, sf_dir):
    nodes, _ = N.cooccurrence(encoded(spark, sf_dir), "content_type", measure="purchase_ord")
    return rounded(nodes)


@register("trust_motivation_edges", with_enc(f"""
SELECT src, dst, count(*) AS weight FROM (
  SELECT trim(trust_factor) AS src, unnest({_split_sql('purchase_motivation')}) AS dst FROM enc
  WHERE trust_factor IS NOT NULL AND trim(trust_factor) <> '') GROUP BY 1, 2"""))
def q_trust_motivation_edges(spark, sf_dir):
    return N.bipartite(encoded(spark, sf_dir), "trust_factor", "purchase_motivation")


_FLOW_SQL = with_enc("""
, f AS (
  SELECT trim(trust_factor) AS t,
         coalesce(CASE engagement_freq WHEN 'Rarely' THEN 'Low Engage' WHEN 'Sometimes' THEN 'Med Engage'
                  WHEN 'frequently' THEN 'High Engage' WHEN 'Almost always' THEN 'High Engage' END, 'Low Engage') AS e,
         CASE coalesce(purchase_ord, 0) WHEN 0 THEN 'No Purchase' WHEN 1 THEN 'Low Purchase' WHEN 2 THEN 'Mid Purchase'
              WHEN 3 THEN 'High Purchase' WHEN 4 THEN 'High Purchase' ELSE 'No Purchase' END AS p
  FROM enc WHERE trust_factor IS NOT NULL AND trim(trust_factor) <> ''),
fe AS (SELECT t AS src, e AS dst FROM f UNION ALL SELECT e AS src, p AS dst FROM f)
SELECT src, dst, count(*) AS weight FROM fe GROUP BY 1, 2 ORDER BY weight DESC, src, dst LIMIT 15""")


@register("flow_edges", _FLOW_SQL)
def q_flow_edges(spark, sf_dir):
    return N.flow_edges(encoded(spark, sf_dir), top=15)


_PLAT_GRAPH = f", {_items_cte('enc', 'id', 'platforms')}, nodes AS (SELECT DISTINCT item AS node FROM items), " \
              f"edges AS ({_edges_sql()}), both_ways AS (SELECT src, dst, weight FROM edges UNION ALL " \
              "SELECT dst, src, weight FROM edges)\n"


@register("platform_degree", with_enc(_PLAT_GRAPH + f"""
SELECT nodes.node, CAST(count(b.dst) AS BIGINT) AS degree,
       {r('count(b.dst) / ((SELECT count(*) FROM nodes) - 1.0)')} AS degree_centrality
FROM nodes LEFT JOIN both_ways b ON b.src = nodes.node GROUP BY nodes.node"""))
def q_platform_degree(spark, sf_dir):
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "platforms")
    return rounded(N.degree_centrality(nodes, edges))


@register("platform_strength", with_enc(_PLAT_GRAPH + """
SELECT nodes.node, CAST(coalesce(sum(b.weight), 0) AS BIGINT) AS strength
FROM nodes LEFT JOIN both_ways b ON b.src = nodes.node GROUP BY nodes.node"""))
def q_platform_strength(spark, sf_dir):
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "platforms")
    return N.weighted_degree(edges, nodes)


_EVENT_GRAPH = """, baskets AS (
  SELECT row_number() OVER () AS rid, types FROM (
    SELECT user_id, CAST(ts AS DATE) AS day, list_distinct(list(event_type)) AS types FROM events GROUP BY 1, 2)),
items AS (SELECT rid, unnest(types) AS item FROM baskets),
nodes AS (SELECT DISTINCT item AS node FROM items),
edges AS (SELECT a.item AS src, b.item AS dst, count(*) AS weight FROM items a JOIN items b
          ON a.rid = b.rid AND a.item < b.item GROUP BY 1, 2),
adj AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
"""


def _event_graph(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type"])
    return N.cooccurrence(N.event_baskets(ev), "event_types")


@register("event_type_edges", "WITH " + _EVENT_GRAPH.lstrip(", ") + "SELECT src, dst, weight FROM edges")
def q_event_type_edges(spark, sf_dir):
    """N1 on behavioural data: event types co-occurring in a user's day."""
    _, edges = _event_graph(spark, sf_dir)
    return edges


@register("event_type_closeness", "WITH RECURSIVE " + _EVENT_GRAPH.lstrip(", ") + f""",
walk(s, v, d) AS (
  SELECT node, node, 0 FROM nodes
  UNION
  SELECT w.s, a.dst, w.d + 1 FROM walk w JOIN adj a ON a.src = w.v WHERE w.d < (SELECT count(*) FROM nodes)),
dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY 1, 2),
agg AS (SELECT s AS node, sum(d) AS tot, count(*) AS r FROM dist GROUP BY 1)
SELECT node, {r('CASE WHEN tot > 0 THEN (r - 1.0) / tot * (r - 1.0) / ((SELECT count(*) FROM nodes) - 1.0) ELSE 0.0 END')} AS closeness
FROM agg""")
def q_event_type_closeness(spark, sf_dir):
    nodes, edges = _event_graph(spark, sf_dir)
    return rounded(N.closeness(nodes, edges))


@register("platform_closeness", with_enc(_PLAT_GRAPH.replace(", items AS", ", items AS", 1)
                                         .replace("both_ways AS", "adj AS") + f""",
walk(s, v, d) AS (
  SELECT node, node, 0 FROM nodes
  UNION
  SELECT w.s, a.dst, w.d + 1 FROM walk w JOIN adj a ON a.src = w.v WHERE w.d < (SELECT count(*) FROM nodes)),
dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY 1, 2),
agg AS (SELECT s AS node, sum(d) AS tot, count(*) AS r FROM dist GROUP BY 1)
SELECT node, {r('CASE WHEN tot > 0 THEN (r - 1.0) / tot * (r - 1.0) / ((SELECT count(*) FROM nodes) - 1.0) ELSE 0.0 END')} AS closeness
FROM agg""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_platform_closeness(spark, sf_dir):
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "platforms")
    return rounded(N.closeness(nodes, edges))


def _central_sql(multi: str, rounds: int = 60, damping: float = 0.85, tol: float = 1e-6) -> str:
    """CTEs ``usage``, ``degree``, ``close``, ``between`` and ``rank`` of a small item graph, in a style of their own:
    every simple path is listed, shortest ones are counted, and PageRank is unrolled to its first round below the
    tolerance."""
    steps, ranks = [], []
    for k in range(1, rounds + 1):
        prev = f"r{k - 1}"
        steps.append(f"""r{k} AS MATERIALIZED (
  SELECT nodes.node, (1 - {damping}) / nn.n + {damping} * (coalesce(f.inflow, 0.0) + d.dm / nn.n) AS pr
  FROM nodes CROSS JOIN nn
  CROSS JOIN (SELECT coalesce(sum(pr), 0.0) AS dm FROM {prev} WHERE node NOT IN (SELECT src FROM ow)) d
  LEFT JOIN (SELECT tr.dst AS node, sum({prev}.pr * tr.p) AS inflow FROM tr JOIN {prev} ON {prev}.node = tr.src
             GROUP BY 1) f ON f.node = nodes.node)""")
        ranks.append(f"SELECT {k} AS k, a.node, a.pr, abs(a.pr - b.pr) AS moved FROM r{k} a JOIN {prev} b ON a.node = b.node")
    return with_enc(f", {_items_cte('enc', 'id', multi)}," + f"""
nodes AS MATERIALIZED (SELECT item AS node, count(*) AS usage FROM items GROUP BY 1),
edges AS ({_edges_sql()}),
bw AS MATERIALIZED (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
degree AS (SELECT node, count(bw.src) AS degree, count(bw.src) / (any_value(nn.n) - 1) AS degree_centrality,
                  CAST(coalesce(sum(weight), 0) AS BIGINT) AS strength
           FROM nodes CROSS JOIN nn LEFT JOIN bw ON bw.src = node GROUP BY node),
walk(s, v, d, path) AS (
  SELECT node, node, CAST(0 AS BIGINT), [node] FROM nodes
  UNION ALL
  SELECT w.s, bw.dst, CAST(w.d + bw.weight AS BIGINT), list_append(w.path, bw.dst) FROM walk w JOIN bw ON bw.src = w.v
  WHERE NOT list_contains(w.path, bw.dst)),
hops AS (SELECT s, v, min(len(path)) - 1 AS h FROM walk GROUP BY 1, 2),
close AS (SELECT s AS node, CASE WHEN sum(h) > 0 THEN (count(*) - 1) / sum(h) * (count(*) - 1) / (any_value(nn.n) - 1) ELSE 0 END AS closeness
          FROM hops CROSS JOIN nn GROUP BY 1),
best AS (SELECT *, min(d) OVER (PARTITION BY s, v) AS least FROM walk WHERE s <> v),
sp AS (SELECT path, count(*) OVER (PARTITION BY s, v) AS ways FROM best WHERE d = least),
thru AS (SELECT unnest(path[2:len(path) - 1]) AS node, 1.0 / ways AS part FROM sp),
between AS (SELECT nodes.node, coalesce(sum(part), 0) / ((any_value(nn.n) - 1) * (any_value(nn.n) - 2)) AS betweenness
            FROM nodes CROSS JOIN nn LEFT JOIN thru ON thru.node = nodes.node GROUP BY 1),
ow AS MATERIALIZED (SELECT src, sum(weight) AS out_w FROM bw GROUP BY src),
tr AS MATERIALIZED (SELECT bw.src, bw.dst, bw.weight * 1.0 / ow.out_w AS p FROM bw JOIN ow ON bw.src = ow.src),
r0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT n FROM nn) AS pr FROM nodes),
""" + ",\n".join(steps) + ",\nrounds AS MATERIALIZED (" + "\nUNION ALL ".join(ranks) + f"""),
settled AS (SELECT min(k) AS k FROM (SELECT k FROM rounds CROSS JOIN nn GROUP BY k HAVING sum(moved) < any_value(nn.n) * {tol})),
pagerank AS (SELECT node, pr AS pagerank FROM rounds WHERE k = (SELECT k FROM settled))""").replace("WITH ", "WITH RECURSIVE ", 1)


_TABLE_SQL = """, central AS (SELECT nodes.node, usage, degree, degree_centrality, strength, closeness, pagerank, betweenness
  FROM nodes JOIN degree ON degree.node = nodes.node JOIN close ON close.node = nodes.node
  JOIN pagerank ON pagerank.node = nodes.node JOIN between ON between.node = nodes.node)
"""


@register("content_pagerank", _central_sql("content_type") + f" SELECT node, {r('pagerank')} AS pagerank FROM pagerank")
def q_content_pagerank(spark, sf_dir):
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "content_type")
    return rounded(N.pagerank(nodes, edges))


@register("content_betweenness", _central_sql("content_type") + f" SELECT node, {r('betweenness')} AS betweenness FROM between")
def q_content_betweenness(spark, sf_dir):
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "content_type")
    return rounded(N.betweenness(nodes, edges))


_PIVOTED = """, drawn AS (SELECT node FROM nodes ORDER BY md5('7:' || node), node LIMIT 4),
part AS (SELECT path, ways FROM sp WHERE path[1] IN (SELECT node FROM drawn)),
through AS (SELECT unnest(path[2:len(path) - 1]) AS node, 1.0 / ways AS share FROM part)
"""


@register("content_betweenness_pivots", _central_sql("content_type") + _PIVOTED + f"""
SELECT nodes.node, {r('coalesce(sum(share), 0) * any_value(nn.n) / 4 / ((any_value(nn.n) - 1) * (any_value(nn.n) - 2))')} AS betweenness
FROM nodes CROSS JOIN nn LEFT JOIN through ON through.node = nodes.node GROUP BY nodes.node""")
def q_content_betweenness_pivots(spark, sf_dir):
    """N9 from four seeded sources."""
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "content_type")
    return rounded(N.betweenness(nodes, edges, pivots=4))


@register("platform_centrality_table", _central_sql("platforms") + _TABLE_SQL + f"""
SELECT node, usage, degree, {r('degree_centrality')} AS degree_centrality, strength, {r('closeness')} AS closeness,
       {r('pagerank')} AS pagerank, {r('betweenness')} AS betweenness FROM central""")
def q_platform_centrality_table(spark, sf_dir):
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "platforms")
    return rounded(N.centrality_table(nodes, edges))


@register("content_edge_lookup", with_enc(f", {_items_cte('enc', 'id', 'content_type')}\n"
                                          "SELECT 'Fashion / Beauty' AS src, 'Food' AS dst, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight "
                                          "FROM (" + _edges_sql() + ") WHERE src = 'Fashion / Beauty' AND dst = 'Food'"))
def q_content_edge_lookup(spark, sf_dir):
    _, edges = N.cooccurrence(encoded(spark, sf_dir), "content_type")
    return N.edge_weight(edges, "Food", "Fashion / Beauty")


@register("platform_top_nodes", _central_sql("platforms") + _TABLE_SQL + "\nUNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS metric, node, {r(m)} AS value FROM central ORDER BY {m} DESC, node LIMIT 1)"
    for m in ("usage", "degree_centrality", "strength", "closeness", "pagerank", "betweenness")))
def q_platform_top_nodes(spark, sf_dir):
    """The top node for each centrality metric."""
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "platforms")
    table = N.centrality_table(nodes, edges).persist()
    out = None
    for m in ["usage", "degree_centrality", "strength", "closeness", "pagerank", "betweenness"]:
        t = N.top_node(table, m)
        out = t if out is None else out.unionByName(t)
    return rounded(out)


def _pagerank_unrolled_sql(rounds: int, damping: float = 0.85) -> str:
    steps = []
    for k in range(1, rounds + 1):
        prev = f"r{k - 1}"
        steps.append(f"""r{k} AS (
  SELECT nodes.node, (1 - {damping}) / nn.n + {damping} * (coalesce(f.inflow, 0.0) + d.dm / nn.n) AS pr
  FROM nodes CROSS JOIN nn
  CROSS JOIN (SELECT coalesce(sum(pr), 0.0) AS dm FROM {prev} WHERE node NOT IN (SELECT src FROM ow)) d
  LEFT JOIN (SELECT tr.dst AS node, sum({prev}.pr * tr.p) AS inflow FROM tr JOIN {prev} ON {prev}.node = tr.src
             GROUP BY 1) f ON f.node = nodes.node)""")
    return with_enc(f", {_items_cte('enc', 'id', 'content_type')}," + f"""
nodes AS (SELECT DISTINCT item AS node FROM items),
edges AS ({_edges_sql()}),
bw AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
ow AS (SELECT src, sum(weight) AS out_w FROM bw GROUP BY src),
tr AS (SELECT bw.src, bw.dst, bw.weight * 1.0 / ow.out_w AS p FROM bw JOIN ow ON bw.src = ow.src),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
r0 AS (SELECT node, 1.0 / (SELECT n FROM nn) AS pr FROM nodes),
""" + ",\n".join(steps) + f"""
SELECT node, {r('pr')} AS pagerank FROM r{rounds}""")


@register("content_pagerank_3_rounds", _pagerank_unrolled_sql(3))
def q_content_pagerank_3_rounds(spark, sf_dir):
    """N7 with a fixed number of rounds, so it can be compared with unrolled SQL."""
    nodes, edges = N.cooccurrence(encoded(spark, sf_dir), "content_type")
    return rounded(N.pagerank(nodes, edges, fixed_iter=3))
