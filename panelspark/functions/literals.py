"""Small fixed tables (answer domains, benchmark rows, stop lists, model summaries).

Built JVM-side as a local relation -- one literal array of structs inlined over a single row --
so no Python worker is started to deserialise driver-side rows.  Sizes are known up front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, st.fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
