"""Loading, renaming, previewing and exporting response tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workbook import SUFFIXES, read_workbooks


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(hpath)) and len(fs.globStatus(hpath)) > 0


def load_responses(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None,
                   fmt: str | None = None, header: bool = True) -> DataFrame:
    """Read the first existing candidate path (Hadoop file-system check, works for any
    scheme the cluster supports).  Parquet by default; ``.csv``, ``.json`` and workbooks picked by suffix."""
    for p in paths:
        if not _exists(spark, p):
            continue
        kind = fmt or ("csv" if p.endswith(".csv") else "json" if p.endswith(".json")
                       else "workbook" if p.lower().endswith(SUFFIXES) else "parquet")
        if kind == "workbook":
            return read_workbooks(spark, p, schema, header=header)
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        if kind == "csv":
            return reader.option("header", header).csv(p)
        if kind == "json":
            return reader.json(p)
        return reader.parquet(p)
    raise FileNotFoundError(f"none of the candidate paths exist: {list(paths)}")


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Question text -> short name for the columns that are present; others untouched.

    One projection; names with dots or odd characters are addressed by backtick quoting.
    """
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(present.get(c, c)) for c in df.columns])


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def preview(df: DataFrame, cols: Sequence[str], n: int = 50, order_by: str = "id") -> DataFrame:
    """First ``n`` rows by an explicit order (TakeOrdered: top-n per task, then merge)."""
    return select_existing(df, cols).orderBy(order_by).limit(n)


def export_csv(df: DataFrame, path: str, cols: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """Write a table as CSV with header (one part file per task; no single-task funnel).

    Array/struct columns are joined to strings first, since CSV holds scalars only.
    """
    out = select_existing(df, cols) if cols else df
    fixes = {}
    for f in out.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            fixes[f.name] = F.array_join(F.col(f.name).cast("array<string>"), ";")
    if fixes:
        out = out.withColumns(fixes)
    out.write.mode(mode).option("header", True).csv(path)
    return path


def export_reports(enc: DataFrame, out_dir: str, numeric_cols: Sequence[str], corr_cols: Sequence[str],
                   hypothesis_table: DataFrame | None = None, export_cols: Sequence[str] | None = None) -> dict:
    """The filtered rows (fixed column list), summary statistics, the pairwise Spearman
    matrix (wide, rounded to 3) and, when given, the hypothesis-test table -- each a CSV folder
    under ``out_dir``.  Returns the written paths."""
    import os

    from panelspark import schema as S
    from panelspark.operators.aggregate import describe_numeric
    from panelspark.operators.ranks import spearman_matrix

    paths = {}
    paths["rows"] = export_csv(enc, os.path.join(out_dir, "filtered_rows"), export_cols or S.EXPORT_COLUMNS)
    paths["summary"] = export_csv(describe_numeric(enc, numeric_cols), os.path.join(out_dir, "summary_statistics"))
    m = spearman_matrix(enc, corr_cols, mode="pairwise")
    wide = m.groupBy("x").pivot("y", list(corr_cols)).agg(F.first(F.round("rho", 3)))
    paths["correlation"] = export_csv(wide, os.path.join(out_dir, "correlation_matrix"))
    if hypothesis_table is not None:
        paths["hypotheses"] = export_csv(hypothesis_table, os.path.join(out_dir, "hypothesis_results"))
    return paths
