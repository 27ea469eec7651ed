"""What the vector operators share: which vectors take part, classes of equal ones, columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def with_direction(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<float or double>, h) and ``usable``: whether the vector has an id and a direction.

    Null, empty and zero vectors and those with null or non-finite components
    have none. h is equal for equal vectors.
    """
    kind = "array<double>" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "array<float>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    zero = F.lit(0.0).cast(kind[6:-1])
    plain = F.transform("embedding", lambda x: x + zero)  # no negative zero
    v = v.withColumn("usable", F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return v.withColumn("embedding", plain).withColumn("h", F.xxhash64("embedding"))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """The rows of each vector length apart, as vectors of different lengths have no product; a table has one length, as a rule."""
    lengths = [r.d for r in rows.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    return [rows.filter(F.size("embedding") == d) for d in lengths] if len(lengths) > 1 else [rows] * len(lengths)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of numbers' arrays as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(classes: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """A bounded, seeded sample of the distinct vectors, for fitting: at most ``most`` rows reach the driver."""
    table = classes.select("embedding", F.xxhash64(F.lit("sample"), "h").alias("o"), "h").orderBy("o", "h").limit(most).select("embedding").toArrow()
    return matrix(table.column(0))
