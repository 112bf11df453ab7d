"""Dimensionality reduction, regression and classification.

Regressions use MLlib estimators (distributed gradient / normal-equation solvers); components, folds and forests are
fitted from grouped sums of our own;
evaluation metrics are exact DataFrame aggregates: the confusion matrix is one grouped count,
AUC comes from average ranks of the scores (the Mann-Whitney identity, ties count 1/2) rather
than MLlib's binned curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.encode import column_stats, standardize_exprs
from panelspark.functions.literals import local_table
from panelspark.operators.forest import forest_points, grow, predicted, scored_points
from panelspark.operators.ranks import rank_table, running_sums
from panelspark.session import checkpoint_dir


MIN_ROWS, MIN_CLASS_ROWS, MIN_PCA_ROWS = 30, 5, 10


# -- splits and folds (M12, M5, M11) ---------------------------------------------------------------
def placed(df: DataFrame, order: Sequence[str], label: str | None = None) -> DataFrame:
    """Adds ``__pos`` (place in ``order``, from 0, within the row's class) and ``__size`` (rows of the class); without
    ``label`` all rows are one class.  Places come from range-partitioned running sums, so a class may hold most rows."""
    by = [label] if label else []
    out = running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, {"__pos": "__one"}, by).drop("__one")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))  # one row for each class of the label
    return out.join(F.broadcast(sizes), by) if by else out.crossJoin(F.broadcast(sizes))


def _split_cuts(drawn: DataFrame, train_frac: float, by: list[str]) -> DataFrame:
    """``(by..., __cut, __need)``: the draw of the first row of a class that does not train (null: all train), and how many
    of the rows with that very draw still do (above 0 for repeated keys only).

    Draws are md5 text, evenly spread, so the counts of 65,536 leading digits tell the place of the cut to within a
    65,536th of the class, and only the draws of that part are ordered.
    """
    checkpoint_dir(drawn.sparkSession)
    before = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)

    def holding(cells: DataFrame, order: str, base: Column) -> DataFrame:
        """The cell that holds the place sought, with the rows before it."""
        at = cells.withColumn("__before", F.coalesce(F.sum("__n").over(before.orderBy(order)), F.lit(0)) + base)
        return at.where((F.col("__before") <= F.col("__place")) & (F.col("__place") < F.col("__before") + F.col("__n")))

    head = F.substring("__draw", 1, 4)
    heads = drawn.groupBy(*by, head.alias("__head")).agg(F.count(F.lit(1)).alias("__n"))
    size = F.sum("__n").over(Window.partitionBy(*by))
    heads = heads.withColumn("__place", F.round(size * train_frac).cast("long")).checkpoint(eager=True)
    classes = heads.select(*by, "__place").distinct()  # one row for each class
    part = holding(heads, "__head", F.lit(0)).select(*[F.col(c).alias(f"__of_{c}") for c in by], "__head", "__place", F.col("__before").alias("__base"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], head == F.col("__head"))
    cells = (drawn.join(F.broadcast(part), same).groupBy(*by, "__draw", "__place", "__base").agg(F.count(F.lit(1)).alias("__n")))
    found = holding(cells, "__draw", F.col("__base")).select(
        *[F.col(c).alias(f"__of_{c}") for c in by], F.col("__draw").alias("__cut"), (F.col("__place") - F.col("__before")).alias("__need"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    return classes.join(F.broadcast(found), same, "left").select(*by, "__cut", "__need").checkpoint(eager=True)


def split(df: DataFrame, train_frac: float = 0.75, key: str = "id", seed: int = 42,
          stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeded split by the rows' places in the order of md5("key:seed"), which any engine can repeat: exactly the rounded share of all rows,
    or of each class of ``stratify``, trains; reruns and other partitionings agree.

    Only the draw at which a class is cut is looked for; both sides are then filters of the rows, which neither travel nor
    are written.  Rows of one repeated key on the cut are told apart by their values.
    """
    by = [stratify] if stratify else []
    drawn = df.withColumn("__draw", F.md5(F.concat_ws(":", F.col(key), F.lit(seed))))
    cuts = _split_cuts(drawn.select(*by, "__draw"), train_frac, by)
    placed_ = drawn.join(F.broadcast(cuts), by) if by else drawn.crossJoin(F.broadcast(cuts))
    trains = F.col("__cut").isNull() | (F.col("__draw") < F.col("__cut"))
    train, test = placed_.where(trains).select(*df.columns), placed_.where(~trains)
    if not cuts.where("__need > 0").isEmpty():
        values = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
        tied = placed_.where(F.col("__draw") == F.col("__cut")).withColumn(
            "__nth", F.row_number().over(Window.partitionBy(*by).orderBy(key, *values)))
        still = F.col("__nth") <= F.col("__need")
        train = train.unionByName(tied.where(still).select(*df.columns))
        test = test.where(F.col("__draw") != F.col("__cut")).select(*df.columns).unionByName(tied.where(~still).select(*df.columns))
    return train, test.select(*df.columns)


def contiguous_folds(df: DataFrame, k: int = 5, key: str = "id", stratify: str | None = None) -> DataFrame:
    """``fold`` column for k contiguous folds in ``key`` order (no shuffle), of all rows or of each class of
    ``stratify``; the first n % k folds hold one extra row."""
    at = placed(df, [key], stratify)
    small, extra = F.floor(F.col("__size") / k), F.col("__size") % k
    cut = extra * (small + 1)
    fold = F.when(F.col("__pos") < cut, F.floor(F.col("__pos") / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("__pos") - cut, small)))
    return at.select(*df.columns, fold.cast("int").alias("fold"))


def enough_rows(df: DataFrame, label: str | None = None, least: int = MIN_ROWS, per_class: int = MIN_CLASS_ROWS) -> bool:
    """sample guard of the fits: ``least`` rows, and ``per_class`` rows of 0 and of 1 where there is a label."""
    if label is None:
        return df.count() >= least
    n, ones = df.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(label) == 1).cast("long")), F.lit(0))).first()
    return n >= least and min(ones, n - ones) >= per_class


# -- features --------------------------------------------------------------------------------------
def standardized_features(df: DataFrame, cols: Sequence[str], out: str = "features", keep: Sequence[str] = (),
                          stats: dict | None = None) -> tuple[DataFrame, dict]:
    """P13 + assembler: z-scored columns (population sd) as one vector column; rows with a null
    feature are dropped (list-wise).  Returns the frame and the (mean, sd) used: those given
    (of training rows), else those of the rows themselves."""
    base = df.select(*keep, *cols).dropna(subset=list(cols))
    stats = column_stats(base, cols) if stats is None else stats
    z = base.withColumns(standardize_exprs(stats))
    vec = VectorAssembler(inputCols=list(cols), outputCol=out).transform(z)
    return vec, stats


def scaled_split(df: DataFrame, features: Sequence[str], label: str, train_frac: float | None, key: str, seed: int,
                 stratify: bool, scale_on: str = "train") -> tuple[DataFrame, DataFrame]:
    """Standardized ``(train, test)`` rows without nulls.  ``scale_on="train"`` takes means and deviations from the
    training rows, ``"all"`` from all rows; with ``train_frac=None`` both frames are all rows."""
    if scale_on not in ("train", "all"):
        raise ValueError("scale_on is 'train' or 'all'")
    base = df.select(key, F.col(label).cast("double").alias(label), *[c for c in features]).dropna()
    train, test = (base, base) if train_frac is None else split(base, train_frac, key, seed, label if stratify else None)
    stats = column_stats(train if scale_on == "train" else base, features)
    return tuple(standardized_features(x, features, keep=[key, label], stats=stats)[0] for x in (train, test))


# -- PCA (M1-M3) ---------------------------------------------------------------------------------
def _cross_products(width: int):
    """Sums of products of all pairs of elements of ``x``, a row for each pair from every batch."""
    i, j = np.divmod(np.arange(width * width), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())],
                                         names=["i", "j", "total"])
    return run


def jacobi_eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    Each vector's entry of largest magnitude is positive (the first of equal ones).  Eigenvalues equal to ten places are
    ordered by the place of that entry.
    """
    a, n = a.copy(), len(a)
    v = np.eye(n)
    for _ in range(sweeps):
        if np.abs(a - np.diag(np.diag(a))).max(initial=0.0) < 1e-15 * max(1.0, np.abs(a).max(initial=0.0)):
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if a[p, q] == 0.0:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + math.sqrt(theta * theta + 1))
                c = 1 / math.sqrt(t * t + 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[[p, q], :] = turn.T @ a[[p, q], :]
                a[:, [p, q]] = a[:, [p, q]] @ turn
                v[:, [p, q]] = v[:, [p, q]] @ turn
    lead = np.abs(np.round(v, 12)).argmax(0)
    v = v * np.where(v[lead, np.arange(n)] < 0, -1.0, 1.0)
    values = np.diag(a)
    order = sorted(range(n), key=lambda k: (-round(float(values[k]), 10), int(lead[k])))
    return values[order], v[:, order]


def pca_fit(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, dict]:
    """Eigenvalues, eigenvectors (columns) and the (mean, sd) used, of the standardized complete rows.

    The rows pass once for the scales and once for the products of all pairs of features; the matrix of features by
    features is all that reaches the driver.  No rows give a zero matrix.
    """
    base = df.select(*cols).dropna()
    stats = column_stats(base, cols)
    z = standardize_exprs(stats)
    width = len(cols)
    sums = (base.select(F.array(*[z[c] for c in cols]).alias("x")).mapInArrow(_cross_products(width), "i int, j int, total double")
            .groupBy("i", "j").agg(F.sum("total").alias("total")).collect())
    matrix = np.zeros((width, width))
    for r in sums:
        matrix[r["i"], r["j"]] = r["total"]
    n = base.count()
    values, vectors = jacobi_eigen((matrix + matrix.T) / (2.0 * max(n, 1)))
    return values, vectors, stats


def pca_scree(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """M1: ``(component, explained_pct, cumulative_pct, n_for_threshold)``; shares of no variance are null."""
    values, _, _ = pca_fit(df, cols)
    total = float(values.sum())
    share = [float(v) / total if total > 0 else None for v in values]
    cumulative = np.cumsum([v or 0.0 for v in share]).tolist()
    needed = next((i + 1 for i, c in enumerate(cumulative) if c >= threshold - 1e-12), len(cumulative))
    rows = [(i + 1, None if v is None else v * 100.0, None if v is None else c * 100.0, needed) for i, (v, c) in enumerate(zip(share, cumulative))]
    return local_table(df.sparkSession, rows, "component int, explained_pct double, cumulative_pct double, n_for_threshold int")


def pca_loadings(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """M2: long ``(feature, component, loading)``; each component's sign is fixed so that its
    largest-magnitude loading is positive."""
    _, vectors, _ = pca_fit(df, cols)
    rows = [(c, j + 1, float(vectors[i, j])) for j in range(min(k, len(cols))) for i, c in enumerate(cols)]
    return local_table(df.sparkSession, rows, "feature string, component int, loading double")


def pca_project(df: DataFrame, cols: Sequence[str], k: int = 2, carry: Sequence[str] = ("id",)) -> DataFrame:
    """M3: per-row scores ``pc1..pck`` of the standardized (centred) features, plus ``carry``."""
    _, vectors, stats = pca_fit(df, cols)
    z = standardize_exprs(stats)
    rows = df.select(*dict.fromkeys([*carry, *cols])).dropna(subset=list(cols))
    scores = [reduce(lambda x, y: x + y, [z[c] * F.lit(float(vectors[i, j])) for i, c in enumerate(cols)]).alias(f"pc{j + 1}") for j in range(k)]
    return rows.select(*carry, *scores)


# -- regression (M4, M5) ---------------------------------------------------------------------------
def _r2_rmse(pred: DataFrame, label: str) -> DataFrame:
    err = F.col(label) - F.col("prediction")
    return pred.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("sse"),
                    (F.variance(label) * (F.count(F.lit(1)) - 1)).alias("sst")).select(
        "n", (1 - F.try_divide("sse", "sst")).alias("r2"), F.sqrt(F.try_divide("sse", "n")).alias("rmse"))


def ols(df: DataFrame, features: Sequence[str], label: str, train_frac: float | None = 0.75,
        key: str = "id", seed: int = 42, scale_on: str = "train") -> tuple[DataFrame, DataFrame]:
    """M4: least squares on standardized features.  Returns ``(coefs(feature, coef), metrics(split,
    n, r2, rmse))``; with ``train_frac=None`` the fit and R2 use all rows (dashboard variant).  R2 of constant
    labels is null."""
    train, test = scaled_split(df, features, label, train_frac, key, seed, False, scale_on)
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0,
                          standardization=False)
    model = lr.fit(train)
    spark = df.sparkSession
    coefs = local_table(spark, 
        [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())] + [("(intercept)", float(model.intercept))],
        "feature string, coef double")
    m_test = _r2_rmse(model.transform(test), label).withColumn("split", F.lit("test" if train_frac else "all"))
    return coefs, m_test


def _r2_of(sums: np.ndarray, beta: np.ndarray) -> float | None:
    """R2 of coefficients on rows known by their sums of products of (1, features, label)."""
    xx, xy, yy, n = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1], sums[0, 0]
    sse = yy - 2 * beta @ xy + beta @ xx @ beta
    sst = yy - sums[0, -1] ** 2 / n if n else 0.0
    return float(1 - sse / sst) if sst > 1e-12 * max(1.0, yy) else None


def cross_validate_ols(df: DataFrame, features: Sequence[str], label: str, k: int = 5, key: str = "id") -> DataFrame:
    """M5: k contiguous folds; ``(fold, r2)`` rows plus mean and population sd in every row.

    One grouped aggregate gives every fold's sums of products.  The sums of the training rows of a fold are those of all
    rows less its own, and the error on its rows follows from its own sums, so no fold is fitted over rows again.
    """
    base = df.select(key, F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    z = standardize_exprs(column_stats(base, [*features, label]))
    folded = contiguous_folds(base, k, key)
    terms = [F.lit(1.0), *[z[c] for c in features], z[label]]
    m = len(terms)
    cells = [(i, j) for i in range(m) for j in range(i, m)]
    rows = folded.groupBy("fold").agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in cells]).collect()
    sums = {f: np.zeros((m, m)) for f in range(k)}
    for r in rows:
        for i, j in cells:
            sums[r["fold"]][i, j] = sums[r["fold"]][j, i] = r[f"s{i}_{j}"]
    total = sum(sums.values())
    scores = []
    for f in range(k):
        rest = total - sums[f]
        beta = np.linalg.lstsq(rest[:-1, :-1], rest[:-1, -1], rcond=None)[0]
        scores.append((f, _r2_of(sums[f], beta)))
    out = local_table(df.sparkSession, scores, "fold int, r2 double")
    w = Window.partitionBy()
    return out.withColumn("mean_r2", F.avg("r2").over(w)).withColumn("sd_r2", F.stddev_pop("r2").over(w))


def _no_fit(df: DataFrame, key: str, schema: str = "feature string, coef double") -> tuple[DataFrame, DataFrame]:
    """Empty results of a classifier that has too few rows."""
    none = df.where(F.lit(False)).select(key, F.lit(0).alias("label"), F.lit(0).alias("prediction"), F.lit(0.0).alias("score"))
    return local_table(df.sparkSession, [], schema), none


# -- classification (M6, M10, M11) -----------------------------------------------------------------
def logistic(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0, max_iter: int = 500,
             train_frac: float = 0.75, key: str = "id", seed: int = 42,
             scale_on: str = "train") -> tuple[DataFrame, DataFrame]:
    """M6: L2 logistic regression on standardized features, sklearn-style strength ``C``
    (regParam = 1 / (C * n_train)).  The split keeps the share of each class.  Returns ``(coefs, test
    predictions(key, label, prediction, score))``; both are empty below 30 rows or 5 rows of a class."""
    if not enough_rows(df.select(label, *features).dropna(), label):
        return _no_fit(df, key)
    train, test = scaled_split(df, features, label, train_frac, key, seed, True, scale_on)
    n_train = train.count()
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, elasticNetParam=0.0,
                               regParam=1.0 / (C * max(n_train, 1)), standardization=False, fitIntercept=True,
                               tol=1e-8).fit(train)
    coefs = local_table(df.sparkSession, 
        [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())] + [("(intercept)", float(model.intercept))],
        "feature string, coef double")
    pred = model.transform(test).select(key, F.col(label).cast("int").alias("label"),
                                        F.col("prediction").cast("int").alias("prediction"),
                                        vector_to_array("probability")[1].alias("score"))
    return coefs, pred


def forest_importance(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 5,
                      train_frac: float | None = 0.75, key: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Random forest (gini, sqrt feature subsets; ``operators.forest``) -> ``(feature, importance)`` and test
    predictions; ``train_frac=None`` fits on all rows (dashboard variant)."""
    base = df.select(key, label, *features).dropna()
    if not enough_rows(base, label):
        return _no_fit(df, key, "feature string, importance double")
    train, test = (base, base) if train_frac is None else split(base, train_frac, key, seed, label)
    model = grow(forest_points(train, features, label, key, trees, seed), len(features), trees, depth, seed)
    imp = local_table(df.sparkSession, [(f, float(v)) for f, v in zip(features, model.importances())], "feature string, importance double")
    return imp, predicted(test, model, features, label, key, trees)


def forest_cv_auc(df: DataFrame, features: Sequence[str], label: str, k: int = 5, trees: int = 100, depth: int = 5,
                  key: str = "id", seed: int = 42) -> DataFrame:
    """K contiguous folds of each class; ``(fold, auc)`` with mean and population sd; no row below 30 rows or 5
    rows of a class.  The forests of all folds grow together, a level being one aggregate."""
    base = df.select(key, label, *features).dropna()
    if not enough_rows(base, label):
        return local_table(df.sparkSession, [], "fold int, auc double, mean_auc double, sd_auc double").where(F.lit(False))
    folded = contiguous_folds(base, k, key, stratify=label)
    points = forest_points(folded, features, label, key, trees, seed, "fold")
    model = grow(points, len(features), trees, depth, seed, folds=k)
    out = auc_by(scored_points(points, model, len(features), trees), "fold", weight="n")
    w = Window.partitionBy()
    return out.withColumn("mean_auc", F.avg("auc").over(w)).withColumn("sd_auc", F.stddev_pop("auc").over(w))


# -- metrics (M7-M9) -------------------------------------------------------------------------------
def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M7: ``(label, prediction, n)`` over the full 2x2 grid (absent cells 0)."""
    cells = pred.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))
    grid = local_table(pred.sparkSession, [(a, b) for a in (0, 1) for b in (0, 1)], "label int, prediction int")
    return F.broadcast(grid).join(cells, ["label", "prediction"], "left").fillna(0, subset=["n"])


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M8: per class precision / recall / F1 / support, then accuracy, macro and weighted averages
    (``row`` names them); zero divisions give 0, as the usual report does."""
    cm = confusion(pred, label, prediction)
    c = {f"n{a}{b}": F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), F.col("n")).otherwise(0))
         for a in (0, 1) for b in (0, 1)}
    wide = cm.agg(*[v.alias(k) for k, v in c.items()])

    def prf(tp, fp, fn):
        p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
        r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
        return p.cast("double"), r.cast("double"), f1.cast("double")

    p0, r0, f0 = prf(F.col("n00"), F.col("n10"), F.col("n01"))
    p1, r1, f1 = prf(F.col("n11"), F.col("n01"), F.col("n10"))
    s0 = (F.col("n00") + F.col("n01")).cast("long")
    s1 = (F.col("n10") + F.col("n11")).cast("long")
    tot = s0 + s1
    acc = F.coalesce(F.try_divide(F.col("n00") + F.col("n11"), tot), F.lit(0.0)).cast("double")

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.alias("support"))

    w0 = F.try_divide(s0, tot)
    w1 = F.try_divide(s1, tot)
    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", acc, acc, acc, tot),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", (p0 * w0 + p1 * w1).cast("double"), (r0 * w0 + r1 * w1).cast("double"),
            (f0 * w0 + f1 * w1).cast("double"), tot))
    return wide.select(F.inline(rows))


def _pinned(counts: DataFrame) -> DataFrame:
    """Counts of scores, which ranks and sums both read, so that the rows are scored once."""
    checkpoint_dir(counts.sparkSession)
    return counts.checkpoint(eager=True)


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M9: (null where a class is absent) exact ROC AUC = (R_pos - n_pos (n_pos + 1) / 2) / (n_pos n_neg) with average ranks of
    the scores over both classes (tied scores count one half)."""
    lv = pred.select(F.col(label).cast("int").alias("g"), F.col(score).cast("double").alias("v")).where(
        F.col("v").isNotNull() & F.col("g").isNotNull())
    gv = _pinned(lv.groupBy("g", "v").agg(F.count(F.lit(1)).alias("cnt")))
    rt = rank_table(gv, "v", weight="cnt").select("v", "rank")
    per = gv.join(rt, "v").groupBy("g").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.col("rank")).alias("rs"))
    wide = per.agg(F.max(F.when(F.col("g") == 1, F.col("n"))).alias("n_pos"),
                   F.max(F.when(F.col("g") == 0, F.col("n"))).alias("n_neg"),
                   F.max(F.when(F.col("g") == 1, F.col("rs"))).alias("r_pos"))
    a = F.col("r_pos") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    a = F.try_divide(a, (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return wide.select(F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                       a.alias("auc"))


def auc_by(pred: DataFrame, by: str, label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """M9 for each value of ``by``: ``(by, auc)``, all ranked in one pass; a row counts ``weight`` times."""
    times = F.lit(1) if weight is None else F.col(weight)
    lv = pred.select(by, F.col(label).cast("int").alias("g"), F.col(score).cast("double").alias("v"), times.cast("long").alias("w")).dropna()
    gv = _pinned(lv.groupBy(by, "g", "v").agg(F.sum("w").alias("cnt")))
    ranks = rank_table(gv, "v", [by], weight="cnt").select(by, "v", "rank")
    ones = F.col("g") == 1
    per = gv.join(ranks, [by, "v"]).groupBy(by).agg(
        F.sum(F.when(ones, F.col("cnt")).otherwise(0)).cast("double").alias("p"), F.sum(F.when(ones, 0).otherwise(F.col("cnt"))).cast("double").alias("q"),
        F.sum(F.when(ones, F.col("cnt") * F.col("rank")).otherwise(0.0)).alias("r"))
    return per.select(by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q")).alias("auc"))


def roc_points(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M9: ``(threshold, fpr, tpr)`` at every distinct score.  Running class counts come from
    one range-partitioned pass for both classes (distinct scores can be as many as rows)."""
    lv = pred.select(F.col(label).cast("int").alias("g"), F.col(score).cast("double").alias("v")).where(
        F.col("v").isNotNull() & F.col("g").isNotNull())
    per = lv.groupBy("v").agg(F.sum(F.col("g")).cast("long").alias("pos"),
                              F.sum(1 - F.col("g")).cast("long").alias("neg"))
    run = running_sums(per, ["v"], {"bp": "pos", "bn": "neg"})
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))  # one row
    return run.join(F.broadcast(tot), F.lit(True)).select(
        F.col("v").alias("threshold"),
        F.try_divide((F.col("N") - F.col("bn")).cast("double"), F.col("N").cast("double")).alias("fpr"),
        F.try_divide((F.col("P") - F.col("bp")).cast("double"), F.col("P").cast("double")).alias("tpr"))
