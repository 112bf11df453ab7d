"""SQL (DuckDB) for the random forest: weights from md5, a chain of CTEs for each level, scores of the leaves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from panelspark.operators.forest import poisson_steps


def forest_ctes(rows: str, features: Sequence[str], trees: int, depth: int, seed: int = 42) -> str:
    """CTEs from ``rows(id, label, fold, trains, features)`` to ``gains(fold, tree, feature, gain)`` and ``scored(fold, pid, score)``.

    A row trains in all folds but its own, if ``trains``; ``fold`` is -1 where there is one forest for all rows."""
    width, count = len(features), max(1, math.isqrt(len(features)))
    cols = ", ".join(features)
    weight = " + ".join(f"CAST(draw >= {s} AS BIGINT)" for s in poisson_steps())
    long_ = ", ".join(f"{{'j': {j}, 'v': CAST({c} AS DOUBLE)}}" for j, c in enumerate(features))
    parts = [
        f"fr AS MATERIALIZED (SELECT * FROM {rows})",
        f"fp AS MATERIALIZED (SELECT {cols}, label, fold, min(id) AS pid FROM fr GROUP BY ALL)",
        f"rid AS MATERIALIZED (SELECT fr.id, fr.trains, fp.pid FROM fr JOIN fp USING ({cols}, label, fold))",
        f"dr AS (SELECT id, pid, b, md5(id || ':{seed}:' || b) AS h FROM rid, (SELECT unnest(range({-(-trees // 8)})) AS b) WHERE trains)",
        f"dt AS (SELECT pid, b * 8 + k AS tree, CAST('0x' || substr(h, CAST(4 * k + 1 AS BIGINT), 4) AS BIGINT) AS draw FROM dr, (SELECT unnest(range(8)) AS k) WHERE b * 8 + k < {trees})",
        f"bw AS MATERIALIZED (SELECT pid, tree, sum({weight}) AS w FROM dt GROUP BY ALL HAVING sum({weight}) > 0)",
        f"fv AS MATERIALIZED (SELECT pid, x.j AS j, x.v AS v FROM (SELECT pid, unnest([{long_}]) AS x FROM fp))",
        "gs AS (SELECT DISTINCT fold AS grp FROM fp)",
        # every point walks every tree of every group; it weighs only where it trains
        f"a0 AS MATERIALIZED (SELECT grp, tree, pid, label, CASE WHEN fold >= 0 AND fold = grp THEN 0 ELSE coalesce(w, 0) END AS w, 1 AS node "
        f"FROM (SELECT fp.pid, label, fold, grp, tree FROM fp, gs, (SELECT unnest(range({trees})) AS tree)) LEFT JOIN bw USING (pid, tree) WHERE (fold >= 0 AND fold = grp) OR w > 0 OR fold < 0)"]
    for level in range(depth):
        n = level
        parts += [
            f"d{n} AS MATERIALIZED (SELECT tree, node, j FROM (SELECT tree, node, j, row_number() OVER (PARTITION BY tree, node ORDER BY md5('{seed}:' || tree || ':' || node || ':' || j)) AS o "
            f"FROM (SELECT DISTINCT tree, node FROM a{n}), (SELECT unnest(range({width})) AS j)) WHERE o <= {count})",
            f"h{n} AS (SELECT grp, tree, node, j, v, sum(w * (1 - label)) AS n0, sum(w * label) AS n1 FROM a{n} JOIN d{n} USING (tree, node) JOIN fv USING (pid, j) "
            f"WHERE w > 0 AND node >= {1 << n} GROUP BY ALL)",
            f"c{n} AS (SELECT grp, tree, node, j, v, CAST(sum(n0) OVER b AS DOUBLE) AS l0, CAST(sum(n1) OVER b AS DOUBLE) AS l1, CAST(sum(n0) OVER a AS DOUBLE) AS t0, "
            f"CAST(sum(n1) OVER a AS DOUBLE) AS t1, lead(v) OVER (PARTITION BY grp, tree, node, j ORDER BY v) AS nx FROM h{n} "
            "WINDOW a AS (PARTITION BY grp, tree, node, j), b AS (PARTITION BY grp, tree, node, j ORDER BY v))",
            f"g{n} AS (SELECT *, (l0 * l0 + l1 * l1) / (l0 + l1) + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / (t0 - l0 + t1 - l1) - (t0 * t0 + t1 * t1) / (t0 + t1) AS gain "
            f"FROM c{n} WHERE nx IS NOT NULL AND t0 > 0 AND t1 > 0)",
            f"s{n} AS MATERIALIZED (SELECT grp, tree, node, j, v, gain FROM g{n} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY grp, tree, node ORDER BY gain DESC, j, v) = 1)",
            f"a{n + 1} AS MATERIALIZED (SELECT a.grp, a.tree, a.pid, a.label, a.w, CASE WHEN s.j IS NULL THEN a.node WHEN fv.v <= s.v THEN 2 * a.node ELSE 2 * a.node + 1 END AS node "
            f"FROM a{n} a LEFT JOIN s{n} s USING (grp, tree, node) LEFT JOIN fv ON fv.pid = a.pid AND fv.j = s.j)"]
    gains = " UNION ALL ".join(f"SELECT grp, tree, j, gain FROM s{n}" for n in range(depth))
    parts += [f"gains AS MATERIALIZED ({gains})",
              f"leaf AS (SELECT grp, tree, node, sum(w * label) / sum(w) AS p FROM a{depth} WHERE w > 0 GROUP BY ALL)",
              f"scored AS MATERIALIZED (SELECT grp, pid, floor(sum(p) / {trees} * 1e9 + 0.5) / 1e9 AS score FROM a{depth} JOIN fp USING (pid) JOIN leaf USING (grp, tree, node) WHERE fold = grp GROUP BY ALL)",
              "imp AS (SELECT j, sum(gain / total) AS part FROM (SELECT *, sum(gain) OVER (PARTITION BY grp, tree) AS total FROM gains) GROUP BY j)"]
    return ",\n".join(parts)
