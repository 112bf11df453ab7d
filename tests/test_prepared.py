"""The prepared table follows its source files."""

import os
import shutil

from panelspark.plans import common

SF = "/root/testdata/sf0.001"


def test_a_changed_source_builds_anew_and_an_unchanged_one_does_not(spark, tmp_path):
    for table in common._SOURCES:
        shutil.copy(f"{SF}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    before = common.encoded(spark, str(tmp_path))
    files, rows = before.inputFiles(), before.count()
    assert common.encoded(spark, str(tmp_path)).inputFiles() == files
    assert common.source_version(spark, str(tmp_path)) != common.source_version(spark, SF)
    half = spark.read.parquet(f"{SF}/orders.parquet").limit(rows // 2).toPandas()
    half.to_parquet(f"{tmp_path}/orders.parquet", index=False, coerce_timestamps="us")
    after = common.encoded(spark, str(tmp_path))
    assert after.inputFiles() != files and after.count() == rows // 2 and before.count() == rows
    kept = [f.removeprefix("file://") for f in after.inputFiles()]
    assert all(map(os.path.exists, kept)) and common.release(spark) >= 2
    assert not any(map(os.path.exists, kept)) and common.release(spark) == 0
