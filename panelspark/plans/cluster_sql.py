"""SQL (DuckDB) for k-means (seeding unrolled, Lloyd rounds recursive), its silhouettes, and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from panelspark.plans.oracle import r

_CANDIDATES, _UNITS = 3, "1e9"


def kmeans_ctes(source: str, cols: Sequence[str], ks: Sequence[int], starts: int = 10, seed: int = 42, key: str = "id") -> str:
    """CTEs (after a first one named in ``source``) up to ``cen(k, cluster, z..)``, ``cl(pid, k, cluster)`` and ``best(k, s, cost)``."""
    d = len(cols)
    z = [f"z{j}" for j in range(d)]
    zs = ", ".join(z)

    def prefixed(a: str) -> str:
        return ", ".join(f"{a}.{c}" for c in z)

    def units(a: str, b: str) -> str:
        return f"CAST(floor(({' + '.join(f'({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})' for c in z)}) * {_UNITS} + 0.5) AS BIGINT)"

    def draw(step: int, weight: str) -> str:
        head = f"substr(md5(p.pid || ':{seed}:' || s || ':{step}'), 1, 13)"
        return f"-ln((CAST('0x' || {head} AS BIGINT) + 0.5) / {16.0 ** 13!r}) / {weight}"

    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{j}, stddev_pop(CAST({c} AS DOUBLE)) AS s{j}" for j, c in enumerate(cols))
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - m{j}) / CASE WHEN s{j} > 0 THEN s{j} ELSE 1 END AS z{j}" for j, c in enumerate(cols))
    parts = [
        f"km_rows AS MATERIALIZED (SELECT {key} AS id, {', '.join(cols)} FROM {source} WHERE {complete})",
        f"st AS MATERIALIZED (SELECT {stats} FROM km_rows)",
        f"pts AS MATERIALIZED (SELECT pid, w, {scaled} FROM (SELECT {', '.join(cols)}, min(id) AS pid, count(*) AS w FROM km_rows GROUP BY ALL), st)",
        "tw AS MATERIALIZED (SELECT CAST(sum(w) AS DOUBLE) AS tw FROM pts)",
        f"ss AS (SELECT unnest(range({starts})) AS s)",
        f"i0 AS MATERIALIZED (SELECT s, 0 AS c, {zs} FROM (SELECT s, p.*, row_number() OVER (PARTITION BY s ORDER BY {draw(0, 'w')}, pid) AS rn "
        "FROM pts p, ss) WHERE rn = 1)"]
    for j in range(1, max(ks)):
        before = f"least(n.d, {units('p', 'i')})" if j > 1 else units("p", "i")
        near = f"n{j - 1} n JOIN pts p USING (pid) JOIN i{j - 1} i ON i.s = n.s" if j > 1 else "pts p, i0 i"
        parts += [
            f"n{j} AS MATERIALIZED (SELECT p.pid, i.s, {before} AS d FROM {near})",
            f"r{j} AS MATERIALIZED (SELECT s, rn, {zs} FROM (SELECT s, p.*, row_number() OVER (PARTITION BY s ORDER BY {draw(j, '(CAST(w AS DOUBLE) * d)')}, pid) AS rn "
            f"FROM n{j} JOIN pts p USING (pid) WHERE d > 0) WHERE rn <= {_CANDIDATES})",
            f"t{j} AS MATERIALIZED (SELECT x.s, x.rn, sum(CAST(w AS DOUBLE) * least(n.d, {units('p', 'x')})) AS total "
            f"FROM r{j} x JOIN n{j} n ON n.s = x.s JOIN pts p ON p.pid = n.pid GROUP BY 1, 2)",
            f"i{j} AS MATERIALIZED (SELECT s, {j} AS c, {zs} FROM (SELECT x.*, row_number() OVER (PARTITION BY x.s "
            f"ORDER BY floor(total / tw / {_UNITS} * 1e6 + 0.5), x.rn) AS pick FROM r{j} x JOIN t{j} USING (s, rn), tw) WHERE pick = 1)"]
    ini = " UNION ALL ".join(f"SELECT * FROM i{j}" for j in range(max(ks)))
    fits = ", ".join(f"({k})" for k in ks)
    sums = ", ".join(f"sum(p.w * p.{c}) / sum(p.w) AS {c}" for c in z)
    moved = "sum(" + " + ".join(f"(n.{c} - o.{c}) * (n.{c} - o.{c})" for c in z) + ")"
    parts += [
        f"ini AS MATERIALIZED ({ini})",
        f"""it AS (SELECT 0 AS turn, k, s, c, {zs} FROM ini, (VALUES {fits}) f(k) WHERE c < k
  UNION ALL (
  WITH a AS (SELECT p.pid, i.k, i.s, min({units('p', 'i')} * 64 + i.c) AS best FROM pts p, it i GROUP BY ALL),
  g AS (SELECT a.k, a.s, a.best % 64 AS c, {sums} FROM a JOIN pts p USING (pid) GROUP BY ALL),
  n AS (SELECT o.turn + 1 AS turn, o.k, o.s, o.c, {', '.join(f'coalesce(g.{c}, o.{c}) AS {c}' for c in z)}
        FROM it o LEFT JOIN g ON g.k = o.k AND g.s = o.s AND g.c = o.c),
  m AS (SELECT n.k, n.s FROM n JOIN it o ON n.k = o.k AND n.s = o.s AND n.c = o.c GROUP BY ALL HAVING {moved} > 1e-4)
  SELECT n.* FROM n JOIN m USING (k, s) WHERE n.turn <= 100))""",
        f"fin AS MATERIALIZED (SELECT k, s, c, {zs} FROM it QUALIFY turn = max(turn) OVER (PARTITION BY k, s))",
        f"fa AS MATERIALIZED (SELECT p.pid, any_value(p.w) AS w, f.k, f.s, min({units('p', 'f')} * 64 + f.c) AS best FROM pts p, fin f GROUP BY p.pid, f.k, f.s)",
        f"cost AS (SELECT k, s, sum(w * ((best // 64) / {_UNITS})) AS cost FROM fa GROUP BY ALL)",
        "best AS MATERIALIZED (SELECT k, s, cost FROM cost, tw QUALIFY row_number() OVER (PARTITION BY k ORDER BY floor(cost / tw * 1e6 + 0.5), s) = 1)",
        "sizes AS (SELECT k, best % 64 AS c, sum(w) AS w FROM fa JOIN best b USING (k, s) GROUP BY ALL)".replace("SELECT k, best % 64", "SELECT fa.k, fa.best % 64"),
        f"""num AS MATERIALIZED (SELECT f.k, f.c, row_number() OVER (PARTITION BY f.k ORDER BY coalesce(w, 0) DESC, {', '.join(f'round(f.{c}, 6)' for c in z)}) AS cluster,
  {prefixed('f')} FROM fin f JOIN best USING (k, s) LEFT JOIN sizes USING (k, c))""",
        "cl AS MATERIALIZED (SELECT fa.pid, fa.w, fa.k, CAST(num.cluster AS INTEGER) AS cluster FROM fa JOIN best USING (k, s) JOIN num ON num.k = fa.k AND num.c = fa.best % 64)"]
    return ",\n".join(parts)


def rows_with_cluster(cols: Sequence[str], kept: str) -> str:
    """CTEs giving every complete row of enc its cluster (one k)."""
    same = " AND ".join(f"e.{c} = g.{c}" for c in cols)
    return f"""gk AS (SELECT {', '.join(cols)}, min(id) AS pid FROM km_rows GROUP BY ALL),
assigned AS (SELECT {kept}, cl.cluster FROM enc e JOIN gk g ON {same} JOIN cl USING (pid))"""


def centres_sql(cols: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT CAST(cluster AS INTEGER) AS cluster, '{c}' AS feature, "
                              f"{r(f'z{j} * CASE WHEN s{j} > 0 THEN s{j} ELSE 1 END + m{j}')} AS center FROM num, st" for j, c in enumerate(cols))


def scan_sql(d: int) -> str:
    """Rows of the scan from cl and best: exact silhouettes by every pair of distinct points."""
    distance = " + ".join(f"(a.z{j} - b.z{j}) * (a.z{j} - b.z{j})" for j in range(d))
    return f""", pr AS MATERIALIZED (SELECT a.pid, cb.k, cb.cluster, sum(cb.w * sqrt({distance})) AS total
  FROM pts a, pts b JOIN cl cb ON cb.pid = b.pid GROUP BY ALL),
cs AS (SELECT k, cluster, sum(w) AS cw FROM cl GROUP BY ALL),
ab AS (SELECT o.pid, o.k, o.w, any_value(own.cw) AS own, max(pr.total) FILTER (WHERE pr.cluster = o.cluster) / (any_value(own.cw) - 1) AS a,
   min(pr.total / cs.cw) FILTER (WHERE pr.cluster <> o.cluster) AS b
   FROM cl o JOIN pr ON pr.pid = o.pid AND pr.k = o.k JOIN cs ON cs.k = pr.k AND cs.cluster = pr.cluster
   JOIN cs own ON own.k = o.k AND own.cluster = o.cluster GROUP BY o.pid, o.k, o.w),
sil AS (SELECT k, sum(w * CASE WHEN own > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END) / sum(w) AS s FROM ab GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, {r('cost')} AS inertia, {r('sil.s')} AS silhouette,
       CAST(first_value(k) OVER (ORDER BY round(sil.s, 9) DESC, k) AS INTEGER) AS best_k FROM best JOIN sil USING (k)"""


def eigen_ctes(source: str, cols: Sequence[str], components: int, key: str = "id", squarings: int = 30) -> str:
    """CTEs up to ``zl(id, i, z)`` and ``ev(comp, ev, v)``: the correlation matrix is squared until only the projector
    on its first eigenvector is left, taken off with its eigenvalue, and the rest squared again."""
    n = len(cols)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    cells = ", ".join(f"{{'i': {i}, 'z': (CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1)}}"
                      for i, c in enumerate(cols))

    def squared(a: str) -> str:
        row = "{a}[({k}) * {n} + 1 : ({k}) * {n} + {n}]"
        return (f"list_transform(range({n * n}), lambda e: list_inner_product({row.format(a=a, k=f'e // {n}', n=n)}, "
                f"{row.format(a=a, k=f'e % {n}', n=n)}))")

    def trace(a: str) -> str:
        return f"list_sum(list_transform(range({n}), lambda t: {a}[t * {n} + t + 1]))"

    return f"""zl AS MATERIALIZED (SELECT id, x.i AS i, x.z AS z FROM (SELECT {key} AS id, unnest([{cells}]) AS x FROM {source} WHERE {complete})),
cm AS MATERIALIZED (SELECT list(v ORDER BY i, j) AS c FROM (SELECT a.i AS i, b.i AS j, sum(a.z * b.z) / (SELECT count(DISTINCT id) FROM zl) AS v
  FROM zl a JOIN zl b USING (id) GROUP BY ALL)),
pw AS (SELECT 1 AS comp, 0 AS step, c, list_transform(c, lambda x: x / {trace('c')}) AS p FROM cm
  UNION ALL
  SELECT comp + done, CASE WHEN done = 1 THEN 0 ELSE step + 1 END, c2, list_transform(q, lambda x: x / {trace('q')}) FROM (
    SELECT comp, step, done, lam, c2, CASE WHEN done = 1 THEN c2 ELSE {squared('p')} END AS q FROM (
      SELECT *, CASE WHEN done = 1 THEN list_transform(range({n * n}), lambda e: c[e + 1] - lam * p[e + 1]) ELSE c END AS c2 FROM (
        SELECT comp, step, c, p, CASE WHEN step = {squarings} THEN 1 ELSE 0 END AS done, list_inner_product(c, p) AS lam FROM pw
        WHERE comp <= {components}))) WHERE comp + done <= {components}),
pj AS MATERIALIZED (SELECT comp, p, list_inner_product(c, p) AS ev,
  list_transform(range({n}), lambda t: p[t * {n} + t + 1]) AS diag FROM pw WHERE step = {squarings}),
ev AS MATERIALIZED (SELECT comp, ev, list_transform(range({n}), lambda t: p[t * {n} + list_position(diag, list_max(diag))] / sqrt(list_max(diag))) AS v FROM pj)"""
