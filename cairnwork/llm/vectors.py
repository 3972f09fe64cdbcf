"""Which rows of a table of vectors can be reckoned with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds neither nulls nor NaN or infinities."""
    element = rows.schema[vector_col].dataType.elementType
    if not isinstance(element, (T.FloatType, T.DoubleType)):
        rows, element = rows.withColumn(vector_col, F.col(vector_col).cast("array<double>")), T.DoubleType()
    # Null where the array holds a null and not the value, so such rows go as well; NaN equals NaN here.
    holds = [F.array_contains(vector_col, F.lit(float(x)).cast(element)) for x in ("nan", "inf", "-inf")]
    return rows.filter(~holds[0] & ~holds[1] & ~holds[2])


def usual_length(rows: DataFrame, vector_col: str = "embedding") -> int:
    """The length that most vectors have (of equally many the longer), 0 without rows."""
    found = rows.groupBy(F.size(vector_col).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return found["length"] if found else 0
