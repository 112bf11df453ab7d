"""Registered queries: classification metrics, PCA, regression, forests and k-means."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import clustering as K
from panelspark.operators import models as M
from panelspark.plans import cluster_sql as C
from panelspark.plans import forest_sql as FS
from panelspark.plans.common import encoded
from panelspark.plans.oracle import r, with_enc
from panelspark.plans.registry import register, rounded
from panelspark.sources.tables import read_table

# FIXED VALUES: model feature sets of the notebook / dashboard.
FEATURES_NB = ["spending_ord", "daily_time_ord", "engagement_ord", "product_interest_score", "satisfaction_score",
               "ad_click_ord", "retargeting_score", "age_ord", "searched_binary", "ad_influenced_binary"]
FEATURES_DASH = ["spending_ord", "daily_time_ord", "engagement_ord", "product_interest_score", "satisfaction_score",
                 "ad_click_ord", "retargeting_score", "searched_binary", "ad_influenced_binary"]
# ad_click_ord defines high_ad_responsive, so the leak-free set for that label drops it.
FEATURES_AD_LEAK_FREE = [c for c in FEATURES_NB if c != "ad_click_ord"]
CLUSTER_FEATURES = ["spending_ord", "daily_time_ord", "engagement_ord", "product_interest_score",
                    "satisfaction_score", "ad_click_ord", "retargeting_score"]
LENGTH_CUT = 1500  # documents at least this long are predicted "quality"


def _length_predictions(spark, sf_dir, target: str = "quality"):
    """Labels as truth, document length as score, a fixed length rule as the prediction."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", target])
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    j = lab.join(docs, "doc_id")
    return j.select("doc_id", F.col(target).alias("label"),
                    (F.col("n_chars") >= LENGTH_CUT).cast("int").alias("prediction"),
                    F.col("n_chars").cast("double").alias("score"))


_PRED_SQL = f"""WITH p AS (SELECT l.doc_id, l.quality AS label, CAST(d.n_chars >= {LENGTH_CUT} AS INTEGER) AS prediction,
                         CAST(d.n_chars AS DOUBLE) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@register("confusion_quality", _PRED_SQL + """,
grid AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(label, prediction)),
c AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2)
SELECT grid.label, grid.prediction, coalesce(c.n, 0) AS n FROM grid LEFT JOIN c
ON grid.label = c.label AND grid.prediction = c.prediction""")
def q_confusion_quality(spark, sf_dir):
    return M.confusion(_length_predictions(spark, sf_dir))


def _report_sql(source: str) -> str:
    """CTEs over ``source`` (label, prediction) and the report's rows."""
    return f""",
c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS n00, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS n01,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS n10, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS n11 FROM {source}),
m AS (SELECT *, coalesce(n00 / nullif(n00 + n10, 0), 0) AS p0, coalesce(n00 / nullif(n00 + n01, 0), 0) AS r0,
             coalesce(n11 / nullif(n11 + n01, 0), 0) AS p1, coalesce(n11 / nullif(n11 + n10, 0), 0) AS r1,
             n00 + n01 AS s0, n10 + n11 AS s1 FROM c),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1,
             s0 + s1 AS tot FROM m),
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk FROM {source}),
s AS (SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg,
             sum(rnk) FILTER (WHERE label = 1) AS r_pos FROM rk)
SELECT '0' AS "row", {r('p0')} AS precision, {r('r0')} AS recall, {r('f0')} AS f1, s0 AS support FROM f
UNION ALL SELECT '1', {r('p1')}, {r('r1')}, {r('f1')}, s1 FROM f
UNION ALL SELECT 'accuracy', {r('(n00 + n11) / tot')}, {r('(n00 + n11) / tot')}, {r('(n00 + n11) / tot')}, tot FROM f
UNION ALL SELECT 'macro avg', {r('(p0 + p1) / 2')}, {r('(r0 + r1) / 2')}, {r('(f0 + f1) / 2')}, tot FROM f
UNION ALL SELECT 'weighted avg', {r('(p0 * s0 + p1 * s1) / tot')}, {r('(r0 * s0 + r1 * s1) / tot')},
                 {r('(f0 * s0 + f1 * s1) / tot')}, tot FROM f"""


@register("classification_report_quality", _PRED_SQL + _report_sql("p"))
def q_classification_report_quality(spark, sf_dir):
    return rounded(M.classification_report(_length_predictions(spark, sf_dir)))


def _auc_sql(target: str) -> str:
    return f"""WITH p AS (SELECT l.{target} AS label, CAST(d.n_chars AS DOUBLE) AS score
                FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk FROM p),
s AS (SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg,
             sum(rnk) FILTER (WHERE label = 1) AS r_pos FROM rk)
SELECT n_pos, n_neg, {r('(r_pos - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)')} AS auc FROM s"""


@register("auc_quality_length", _auc_sql("quality"))
def q_auc_quality_length(spark, sf_dir):
    return rounded(M.auc(_length_predictions(spark, sf_dir, "quality")))


@register("auc_toxic_length", _auc_sql("toxic"))
def q_auc_toxic_length(spark, sf_dir):
    return rounded(M.auc(_length_predictions(spark, sf_dir, "toxic")))


@register("roc_quality_length", f"""WITH p AS (SELECT l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score
                FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
v AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY score)
SELECT score AS threshold,
       {r('sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(neg) OVER ()')} AS fpr,
       {r('sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(pos) OVER ()')} AS tpr
FROM v""")
def q_roc_quality_length(spark, sf_dir):
    return rounded(M.roc_points(_length_predictions(spark, sf_dir)))


# -- principal components --------------------------------------------------------------------------
def _pca_sql(components: int) -> str:
    return with_enc(",\n" + C.eigen_ctes("enc", FEATURES_DASH, components)).replace("WITH ", "WITH RECURSIVE ", 1)


@register("pca_scree_survey", _pca_sql(len(FEATURES_DASH)) + f""",
sh AS (SELECT comp, ev / sum(ev) OVER () AS share, sum(ev) OVER (ORDER BY comp) / sum(ev) OVER () AS cum FROM ev)
SELECT CAST(comp AS INTEGER) AS component, {r('share * 100')} AS explained_pct, {r('cum * 100')} AS cumulative_pct,
       CAST((SELECT min(comp) FROM sh WHERE cum >= 0.8 - 1e-12) AS INTEGER) AS n_for_threshold FROM sh""")
def q_pca_scree_survey(spark, sf_dir):
    return rounded(M.pca_scree(encoded(spark, sf_dir), FEATURES_DASH))


@register("pca_loadings_survey", _pca_sql(3) + f"""
SELECT names[i + 1] AS feature, CAST(comp AS INTEGER) AS component, {r('v[i + 1]')} AS loading
FROM ev, (SELECT unnest(range({len(FEATURES_DASH)})) AS i), (SELECT {FEATURES_DASH!r} AS names)""")
def q_pca_loadings_survey(spark, sf_dir):
    return rounded(M.pca_loadings(encoded(spark, sf_dir), FEATURES_DASH, k=3))


def _pca_power_sql(powers: int) -> str:
    """Traces of the powers of the correlation matrix, which are the power sums of its eigenvalues."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES_DASH)
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': corr({a}, {b})}}" for i, a in enumerate(FEATURES_DASH)
                      for j, b in enumerate(FEATURES_DASH))
    steps = [f"c1 AS MATERIALIZED (SELECT x.i AS i, x.j AS j, x.v AS v FROM (SELECT unnest([{cells}]) AS x FROM enc WHERE {complete}))"]
    steps += [f"c{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c{k - 1} a JOIN c1 b ON a.j = b.i GROUP BY 1, 2)"
              for k in range(2, powers + 1)]
    return with_enc(", " + ", ".join(steps)) + " UNION ALL ".join(
        f"SELECT {k} AS power, {r('sum(v)')} AS total FROM c{k} WHERE i = j" for k in range(1, powers + 1))


@register("pca_eigenvalue_sums", _pca_power_sql(len(FEATURES_DASH)))
def q_pca_eigenvalue_sums(spark, sf_dir):
    """M1 against SQL: as many power sums as there are components fix every eigenvalue."""
    p = len(FEATURES_DASH)
    value = F.col("explained_pct") / 100 * p
    sums = F.inline(F.array(*[F.struct(F.lit(k).alias("power"), F.pow(value, F.lit(k)).alias("part")) for k in range(1, p + 1)]))
    return rounded(M.pca_scree(encoded(spark, sf_dir), FEATURES_DASH).select(sums)
                   .groupBy("power").agg(F.sum("part").alias("total")))


def _embedding_columns(spark, sf_dir, dims: int = 64):
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    cols = [f"e{i}" for i in range(dims)]
    return emb.select(F.col("vec_id").alias("id"), "label",
                      *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


_EMB_COLS = [f"e{i}" for i in range(64)]
_EMB_SQL = "emb AS (SELECT vec_id AS id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings)"


@register("pca_project_embeddings", "WITH RECURSIVE " + _EMB_SQL + ",\n" + C.eigen_ctes("emb", _EMB_COLS, 2) + f"""
SELECT zl.id, any_value(emb.label) AS label, {r('sum(z * v[i + 1]) FILTER (WHERE comp = 1)')} AS pc1,
       {r('sum(z * v[i + 1]) FILTER (WHERE comp = 2)')} AS pc2 FROM zl JOIN emb USING (id), ev GROUP BY zl.id""")
def q_pca_project_embeddings(spark, sf_dir):
    emb, cols = _embedding_columns(spark, sf_dir)
    return rounded(M.pca_project(emb, cols, k=2, carry=("id", "label")))


def _solve_sql(source: str, unknowns: int, name: str = "beta") -> str:
    """CTEs that solve normal equations by elimination, one system for each row of ``source``: columns ``fold`` and
    ``a_i_j`` (j = unknowns: right side).  The last CTE ``name`` has ``fold, b_0, b_1, ...``."""
    steps, prev = [], source
    for k in range(unknowns):
        cols = [f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" if i != k else f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}"
                for i in range(unknowns) for j in range(k + 1, unknowns + 1)]
        steps.append(f"{name}_{k} AS MATERIALIZED (SELECT fold, {', '.join(cols)} FROM {prev})")
        prev = f"{name}_{k}"
    found = ", ".join(f"a_{i}_{unknowns} AS b_{i}" for i in range(unknowns))
    return ", ".join([*steps, f"{name} AS MATERIALIZED (SELECT fold, {found} FROM {prev})"])


def _products_sql(terms: list[str], label: str) -> str:
    """Sums of products of the terms with one another and with the label."""
    return ", ".join(f"sum(CAST({a} AS DOUBLE) * {b}) AS a_{i}_{j}" for i, a in enumerate(terms)
                     for j, b in enumerate([*terms, label]))


def _fit_sql(terms: list[str]) -> str:
    return " + ".join(f"b_{i} * {t}" for i, t in enumerate(terms))


def _ols_all_sql() -> str:
    cols, y = FEATURES_DASH, "purchase_ord"
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*cols, y])
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(cols))
    terms = ["1.0", *[f"z{i}" for i in range(len(cols))]]
    names = ["(intercept)", *cols]
    return with_enc(f""", z AS MATERIALIZED (SELECT CAST({y} AS DOUBLE) AS y, {z} FROM enc WHERE {complete}),
sums AS (SELECT 0 AS fold, {_products_sql(terms, 'y')} FROM z), {_solve_sql('sums', len(terms))},
m AS (SELECT sum(pow(y - ({_fit_sql(terms)}), 2)) AS sse, var_pop(y) * count(*) AS sst, count(*) AS n FROM z CROSS JOIN beta)
""" + "\nUNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'b_{i}')} AS coef, CAST(NULL AS DOUBLE) AS r2 FROM beta" for i, f in enumerate(names))
                    + f"\nUNION ALL SELECT '(all)', {r('sqrt(sse / n)')}, {r('1 - sse / sst')} FROM m")


def _drawn_sql(cols: list[str], y: str, stratify: bool) -> str:
    """CTEs ``p`` (complete rows, whether they train) and ``z`` (scaled as the training rows are)."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*cols, y])
    part = f"PARTITION BY {y}" if stratify else ""
    z = ", ".join(f"({c} - (SELECT avg({c}) FROM p WHERE train)) / (SELECT stddev_pop({c}) FROM p WHERE train) AS z{i}"
                  for i, c in enumerate(cols))
    return with_enc(f""", p AS MATERIALIZED (SELECT id, {', '.join(cols)}, CAST({y} AS DOUBLE) AS y,
    row_number() OVER ({part} ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1 < round(count(*) OVER ({part}) * 0.75) AS train
  FROM enc WHERE {complete}),
z AS MATERIALIZED (SELECT id, y, train, {z} FROM p)""")


def _ols_split_sql() -> str:
    cols = FEATURES_NB
    terms = ["1.0", *[f"z{i}" for i in range(len(cols))]]
    return _drawn_sql(cols, "purchase_ord", False) + f""",
sums AS (SELECT 0 AS fold, {_products_sql(terms, 'y')} FROM z WHERE train), {_solve_sql('sums', len(terms))},
m AS (SELECT sum(pow(y - ({_fit_sql(terms)}), 2)) AS sse, var_pop(y) * count(*) AS sst, count(*) AS n
      FROM z CROSS JOIN beta WHERE NOT train)
""" + "\nUNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'b_{i}')} AS coef, CAST(NULL AS DOUBLE) AS r2 FROM beta"
                          for i, f in enumerate(["(intercept)", *cols])) \
        + f"\nUNION ALL SELECT '(test)', {r('sqrt(sse / n)')}, {r('1 - sse / sst')} FROM m"


def _logistic_sql(rounds: int = 12) -> str:
    """CTEs up to ``pred`` (test rows, label, prediction, score): Newton's method on the training rows, penalty
    |b|^2 / 2 but for the intercept, its steps unrolled."""
    cols = FEATURES_AD_LEAK_FREE
    terms = ["1.0", *[f"z{i}" for i in range(len(cols))]]
    n = len(terms)
    sql = _drawn_sql(cols, "high_ad_responsive", True) + ", w0 AS (SELECT " + ", ".join(f"0.0 AS b_{i}" for i in range(n)) + ")"
    for k in range(rounds):
        hess = ", ".join(f"sum(q * (1 - q) * {a} * {b}) + {1.0 if i == j and i else 0.0} AS a_{i}_{j}"
                         for i, a in enumerate(terms) for j, b in enumerate(terms))
        grad = ", ".join(f"sum((y - q) * {a}) - {1.0 if i else 0.0} * any_value(b_{i}) AS a_{i}_{n}" for i, a in enumerate(terms))
        sql += f""", q{k} AS MATERIALIZED (SELECT z.*, w{k}.*, 1 / (1 + exp(-({_fit_sql(terms)}))) AS q FROM z CROSS JOIN w{k} WHERE train),
h{k} AS (SELECT 0 AS fold, {hess}, {grad} FROM q{k}), {_solve_sql(f'h{k}', n, f'd{k}')},
w{k + 1} AS MATERIALIZED (SELECT {', '.join(f'w{k}.b_{i} + d{k}.b_{i} AS b_{i}' for i in range(n))} FROM w{k} CROSS JOIN d{k})"""
    return sql + f""", pred AS (SELECT id, CAST(y AS INTEGER) AS label, 1 / (1 + exp(-({_fit_sql(terms)}))) AS score,
    CAST({_fit_sql(terms)} > 0 AS INTEGER) AS prediction FROM z CROSS JOIN w{rounds} WHERE NOT train)"""


def _ols_cv_sql() -> str:
    """Least squares does not depend on the scale of its features, so R2 follows from the answers as they are."""
    cols, y = FEATURES_NB, "purchase_ord"
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*cols, y])
    terms = ["1.0", *cols]
    return with_enc(f""", p AS MATERIALIZED (SELECT {', '.join(cols)}, CAST({y} AS DOUBLE) AS y,
    row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM enc WHERE {complete}),
f AS MATERIALIZED (SELECT *, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
    ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS part FROM p),
sums AS (SELECT k.fold, {_products_sql(terms, 'y')} FROM f JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(5)) k
         ON f.part <> k.fold GROUP BY k.fold), {_solve_sql('sums', len(terms))},
m AS (SELECT fold, 1 - sum(pow(y - ({_fit_sql(terms)}), 2)) / (var_pop(y) * count(*)) AS r2
      FROM f JOIN beta ON f.part = beta.fold GROUP BY fold)
SELECT fold, {r('r2')} AS r2, {r('avg(r2) OVER ()')} AS mean_r2, {r('stddev_pop(r2) OVER ()')} AS sd_r2 FROM m""")


@register("ols_purchase", _ols_split_sql())
def q_ols_purchase(spark, sf_dir):
    coefs, metrics = M.ols(encoded(spark, sf_dir), FEATURES_NB, "purchase_ord", train_frac=0.75)
    return rounded(coefs.select("feature", "coef", F.lit(None).cast("double").alias("r2"))
                   .unionByName(metrics.select(F.lit("(test)").alias("feature"), F.col("rmse").alias("coef"), "r2")))


@register("ols_purchase_all_rows", _ols_all_sql())
def q_ols_purchase_all_rows(spark, sf_dir):
    """M4 on all rows, with the dashboard's features."""
    coefs, metrics = M.ols(encoded(spark, sf_dir), FEATURES_DASH, "purchase_ord", train_frac=None)
    return rounded(coefs.select("feature", "coef", F.lit(None).cast("double").alias("r2"))
                   .unionByName(metrics.select(F.lit("(all)").alias("feature"), F.col("rmse").alias("coef"), "r2")))


@register("ols_purchase_cv", _ols_cv_sql())
def q_ols_purchase_cv(spark, sf_dir):
    return rounded(M.cross_validate_ols(encoded(spark, sf_dir), FEATURES_NB, "purchase_ord", k=5))


@register("logistic_ad_confusion", _logistic_sql() + """
SELECT g.label, g.prediction, count(pred.id) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(label, prediction)
LEFT JOIN pred ON pred.label = g.label AND pred.prediction = g.prediction GROUP BY 1, 2""")
def q_logistic_ad_confusion(spark, sf_dir):
    _, pred = M.logistic(encoded(spark, sf_dir), FEATURES_AD_LEAK_FREE, "high_ad_responsive")
    return M.confusion(pred)


@register("logistic_ad_report", _logistic_sql() + _report_sql("pred") + f"""
UNION ALL SELECT 'auc', {r('(r_pos - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)')}, NULL, NULL, n_pos + n_neg FROM s""")
def q_logistic_ad_report(spark, sf_dir):
    _, pred = M.logistic(encoded(spark, sf_dir), FEATURES_AD_LEAK_FREE, "high_ad_responsive")
    return rounded(M.classification_report(pred).unionByName(
        M.auc(pred).select(F.lit("auc").alias("row"), F.col("auc").alias("precision"),
                           F.lit(None).cast("double").alias("recall"), F.lit(None).cast("double").alias("f1"),
                           (F.col("n_pos") + F.col("n_neg")).alias("support"))))


_AD_ROWS = f"""SELECT id, CAST(high_ad_responsive AS INTEGER) AS label, {', '.join(FEATURES_AD_LEAK_FREE)} FROM enc
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*FEATURES_AD_LEAK_FREE, 'high_ad_responsive'])}"""
_AD_IMPORTANCE = f"""SELECT names[j + 1] AS feature, {r('coalesce(part, 0) / (SELECT sum(part) FROM imp)')} AS importance
FROM (SELECT unnest(range({len(FEATURES_AD_LEAK_FREE)})) AS j) LEFT JOIN imp USING (j), (SELECT {FEATURES_AD_LEAK_FREE!r} AS names)"""
_AUC_OF = """(sum(rnk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))"""


@register("forest_importance_ad", with_enc(f", ad AS (SELECT *, -1 AS fold, true AS trains FROM ({_AD_ROWS})),\n"
                                           + FS.forest_ctes("ad", FEATURES_AD_LEAK_FREE, 80, 4) + "\n" + _AD_IMPORTANCE))
def q_forest_importance_ad(spark, sf_dir):
    imp, _ = M.forest_importance(encoded(spark, sf_dir), FEATURES_AD_LEAK_FREE, "high_ad_responsive",
                                 trees=80, depth=4, train_frac=None)
    return rounded(imp)


@register("forest_split_auc_ad", with_enc(f""", ad0 AS ({_AD_ROWS}),
ad AS (SELECT *, -1 AS fold, row_number() OVER (PARTITION BY label ORDER BY md5(id || ':42'), id) <= round(count(*) OVER (PARTITION BY label) * 0.75) AS trains FROM ad0),
""" + FS.forest_ctes("ad", FEATURES_AD_LEAK_FREE, 100, 5) + f""",
tests AS (SELECT fr.label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk
  FROM fr JOIN rid USING (id) JOIN scored USING (pid) WHERE NOT fr.trains)
{_AD_IMPORTANCE} UNION ALL SELECT '(test auc)', {r(_AUC_OF)} FROM tests"""))
def q_forest_split_auc_ad(spark, sf_dir):
    """M10 with 100 trees on the stratified split: importances, and the AUC of the test rows."""
    imp, pred = M.forest_importance(encoded(spark, sf_dir), FEATURES_AD_LEAK_FREE, "high_ad_responsive", trees=100, depth=5)
    return rounded(imp.unionByName(M.auc(pred).select(F.lit("(test auc)").alias("feature"), F.col("auc").alias("importance"))))


def _split_sizes_sql() -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES_AD_LEAK_FREE)
    return with_enc(f""", c AS (SELECT high_ad_responsive AS label, count(*) AS n FROM enc
  WHERE {complete} AND high_ad_responsive IS NOT NULL GROUP BY 1)
SELECT label, CAST(round(n * 0.75) AS BIGINT) AS train, n - CAST(round(n * 0.75) AS BIGINT) AS test FROM c""")


@register("stratified_split_sizes", _split_sizes_sql())
def q_stratified_split_sizes(spark, sf_dir):
    """Rows of each class that train and that test."""
    label = "high_ad_responsive"
    base = encoded(spark, sf_dir).select("id", label, *FEATURES_AD_LEAK_FREE).dropna()
    train, test = M.split(base, 0.75, stratify=label)
    sides = train.select(label, F.lit(1).alias("t")).unionByName(test.select(label, F.lit(0).alias("t")))
    return sides.groupBy(F.col(label).alias("label")).agg(F.sum("t").alias("train"), F.sum(1 - F.col("t")).alias("test"))


_FOLDS = 5


def _fold_sql() -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES_AD_LEAK_FREE)
    return with_enc(f""", p AS (SELECT high_ad_responsive AS label, id,
    row_number() OVER (PARTITION BY high_ad_responsive ORDER BY id) - 1 AS pos,
    count(*) OVER (PARTITION BY high_ad_responsive) AS n FROM enc WHERE {complete} AND high_ad_responsive IS NOT NULL),
f AS (SELECT label, id, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
       ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM p)
SELECT label, fold, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM f GROUP BY 1, 2""")


@register("stratified_folds", _fold_sql())
def q_stratified_folds(spark, sf_dir):
    """Contiguous folds of each class."""
    label = "high_ad_responsive"
    base = encoded(spark, sf_dir).select("id", label, *FEATURES_AD_LEAK_FREE).dropna()
    return M.contiguous_folds(base, _FOLDS, "id", label).groupBy(F.col(label).alias("label"), "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("forest_cv_auc_ad", with_enc(f""", ad0 AS ({_AD_ROWS}),
ad1 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM ad0),
ad AS (SELECT *, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold,
  true AS trains FROM ad1),
""" + FS.forest_ctes("ad", FEATURES_AD_LEAK_FREE, 100, 5) + f""",
tests AS (SELECT fr.fold, fr.label, rank() OVER (PARTITION BY fr.fold ORDER BY score) + (count(*) OVER (PARTITION BY fr.fold, score) - 1) / 2.0 AS rnk
  FROM fr JOIN rid USING (id) JOIN scored USING (pid)),
per AS (SELECT fold, {_AUC_OF} AS auc FROM tests GROUP BY fold)
SELECT fold, {r('auc')} AS auc, {r('avg(auc) OVER ()')} AS mean_auc, {r('stddev_pop(auc) OVER ()')} AS sd_auc FROM per"""))
def q_forest_cv_auc_ad(spark, sf_dir):
    return rounded(M.forest_cv_auc(encoded(spark, sf_dir), FEATURES_AD_LEAK_FREE, "high_ad_responsive",
                                   k=5, trees=100, depth=5))


def _km_sql(ks, tail: str) -> str:
    return with_enc(",\n" + C.kmeans_ctes("enc", CLUSTER_FEATURES, ks) + tail).replace("WITH ", "WITH RECURSIVE ", 1)


_PROFILE_KEEP = ["made_purchase", "high_ad_responsive"]


@register("kmeans_profile", _km_sql([3], ",\n" + C.rows_with_cluster(CLUSTER_FEATURES, "e.*") + f"""
SELECT cluster, count(*) AS n, {r('avg(spending_ord)')} AS avg_spending, {r('avg(engagement_ord)')} AS avg_engagement,
       {r('avg(product_interest_score)')} AS avg_interest, {r('avg(satisfaction_score)')} AS avg_satisfaction,
       {r('avg(made_purchase)')} AS purchase_rate, {r('avg(high_ad_responsive)')} AS ad_responsive_rate,
       CASE WHEN avg(made_purchase) > 0.85 AND avg(engagement_ord) > 2.5 THEN 'High-Value Converter'
            WHEN avg(made_purchase) > 0.7 AND avg(engagement_ord) <= 2.5 THEN 'Passive Buyer'
            WHEN avg(made_purchase) <= 0.5 AND avg(engagement_ord) > 2 THEN 'Engaged Window-Shopper'
            ELSE 'Low-Engagement Observer' END AS segment FROM assigned GROUP BY cluster"""))
def q_kmeans_profile(spark, sf_dir):
    """K1, K3, K4: three clusters, the best of ten starts, described and named."""
    assigned, _, _, _ = K.kmeans(encoded(spark, sf_dir), CLUSTER_FEATURES, k=3, n_init=10, keep=("id", *_PROFILE_KEEP))
    return rounded(K.name_clusters(K.cluster_profile(assigned)))


@register("kmeans_centers", _km_sql([3], "\n" + C.centres_sql(CLUSTER_FEATURES)))
def q_kmeans_centers(spark, sf_dir):
    """K3: centres in answer units."""
    _, centers, stats, _ = K.kmeans(encoded(spark, sf_dir), CLUSTER_FEATURES, k=3, n_init=10)
    return rounded(K.centers_original_scale(spark, centers, CLUSTER_FEATURES, stats))


@register("kmeans_scan", _km_sql(range(2, 8), C.scan_sql(len(CLUSTER_FEATURES))))
def q_kmeans_scan(spark, sf_dir):
    """K2: inertia and exact plain-Euclidean silhouette of k = 2..7, all fitted together."""
    return rounded(K.k_scan(encoded(spark, sf_dir), CLUSTER_FEATURES, ks=range(2, 8), n_init=10))


@register("embedding_clusters", "WITH RECURSIVE " + _EMB_SQL + ",\n" + C.kmeans_ctes("emb", _EMB_COLS, [4]) + """
SELECT cl.cluster, emb.label, count(*) AS n FROM cl JOIN (SELECT id, min(id) OVER (PARTITION BY """ + ", ".join(_EMB_COLS) + """) AS pid FROM km_rows) p USING (pid)
JOIN emb ON emb.id = p.id GROUP BY ALL""")
def q_embedding_clusters(spark, sf_dir):
    """K1 on 64 continuous features, which do not collapse."""
    emb, cols = _embedding_columns(spark, sf_dir)
    assigned, _, _, _ = K.kmeans(emb, cols, k=4, n_init=10, keep=("id", "label"))
    return assigned.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


@register("segment_names_by_spending", with_enc(f"""
SELECT spending_ord AS cluster, count(*) AS n, {r('avg(spending_ord)')} AS avg_spending,
       {r('avg(engagement_ord)')} AS avg_engagement, {r('avg(product_interest_score)')} AS avg_interest,
       {r('avg(satisfaction_score)')} AS avg_satisfaction, {r('avg(made_purchase)')} AS purchase_rate,
       {r('avg(high_ad_responsive)')} AS ad_responsive_rate,
       CASE WHEN avg(made_purchase) > 0.85 AND avg(engagement_ord) > 2.5 THEN 'High-Value Converter'
            WHEN avg(made_purchase) > 0.7 AND avg(engagement_ord) <= 2.5 THEN 'Passive Buyer'
            WHEN avg(made_purchase) <= 0.5 AND avg(engagement_ord) > 2 THEN 'Engaged Window-Shopper'
            ELSE 'Low-Engagement Observer' END AS segment
FROM enc WHERE spending_ord IS NOT NULL GROUP BY spending_ord"""))
def q_segment_names_by_spending(spark, sf_dir):
    """K3 + K4 on a fixed labelling (spending band as the cluster)."""
    enc = encoded(spark, sf_dir).where(F.col("spending_ord").isNotNull())
    return rounded(K.name_clusters(K.cluster_profile(enc.withColumn("cluster", F.col("spending_ord")))))
