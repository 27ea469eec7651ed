"""Documents as rows: merged only where a field is absent, read into typed records, found by their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


def has_field(document: Column, name: str) -> Column:
    """Whether an object (variant) has the field at its top, whatever it holds, null too."""
    return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(document, "$", "map<string,variant>")), name), F.lit(False))


def with_fields(document: Column, more: dict[str, Column]) -> Column:
    """The object with these fields, in place of its own of the same name; values are any columns."""
    fields = F.try_variant_get(document, "$", "map<string,variant>")
    added = F.create_map(*(x for name, value in more.items() for x in (F.lit(name), F.to_variant_object(F.create_map(F.lit("v"), value)))))
    added = F.transform_values(added, lambda _, v: F.variant_get(v, "$.v", "variant"))
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*more))
    return F.to_variant_object(F.map_concat(kept, added))


def guarded(document: Column, guard: str, more: dict[str, Column], when: Column) -> Column:
    """The object with more fields where ``when`` holds and it lacks ``guard``; a second run changes nothing, as ``more`` has the guard."""
    if guard not in more:
        raise ValueError("the guard must be among the fields that are added")
    return F.when(F.coalesce(when, F.lit(False)) & ~has_field(document, guard), with_fields(document, more)).otherwise(document)


def backfilled(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Old events get the logical id of the session version that they name, once.

    ``events``: source, kind, detail (variant); ``versions``: version_id, logical_id.
    Reviews get it beside their reference; decisions refer to it from now on and
    keep the version as ``session_ref_version``. Events whose version is not known,
    or whose reference is no number, stay as they are.
    """
    reference = F.try_variant_get("detail", "$.session_ref", "long")
    known = versions.select(F.col("version_id").alias("_version"), F.col("logical_id").alias("_logical"))
    joined = events.join(known, reference == F.col("_version"), "left")
    found = F.col("_logical").isNotNull()
    review = guarded(F.col("detail"), "session_logical", {"session_logical": F.col("_logical")}, found & (F.col("source") == "legacy_review"))
    decision = guarded(F.col("detail"), "session_ref_version", {"session_ref": F.col("_logical"), "session_ref_version": F.col("_version")}, found & (F.col("source") == "owner") & (F.col("kind") == "finding_decision"))
    # A decision that was moved names a logical id, which may be another version's number; its guard keeps it.
    detail = F.when(F.col("source") == "owner", decision).otherwise(review)
    return joined.withColumn("detail", detail).drop("_version", "_logical")


def _unknown(value: Column, kind: T.DataType, path: str) -> list[Column]:
    """For each object inside, an array of the paths of fields that its type does not have."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        own = F.coalesce(F.transform(F.array_except(names, F.array(*map(F.lit, kind.names))), lambda n: F.concat(F.lit(path), n)), none)
        return [own, *(x for f in kind.fields for x in _unknown(F.try_variant_get(value, f"$.{f.name}", "variant"), f.dataType, f"{path}{f.name}."))]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        inside = lambda e: F.flatten(F.array(*_unknown(e, kind.elementType, path.rstrip(".") + "[].")))
        return [F.coalesce(F.array_distinct(F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), inside))), none)]
    return []


def records(documents: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Adds ``record``, the JSON text of ``column`` in the shape of ``schema``, and ``unknown``: sorted paths of fields that the shape does not have.

    A document with unknown fields, or one that is no object, has a null record, so
    that a newer writer's documents are not cut down unseen; ``unknown`` is null for what is no object.
    """
    v = F.try_parse_json(column)
    is_object = F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1) == "OBJECT", F.lit(False))
    unknown = F.array_sort(F.flatten(F.array(*_unknown(v, schema, ""))))
    marked = documents.withColumn("unknown", F.when(is_object, unknown))
    return marked.withColumn("record", F.when(F.size("unknown") == 0, F.from_json(column, schema)))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_indexed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes rows by the bucket of their key, sorted inside it, so that one key is in one folder and in few row groups there."""
    placed = df.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    placed.repartition(BUCKET).sortWithinPartitions(BUCKET, key).write.partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def load(spark: SparkSession, path: str, key: str, value: int | str, buckets: int) -> DataFrame:
    """The rows of one key: one folder is listed and read, and of its row groups those whose statistics and bloom filter may have it."""
    typed = F.lit(value).cast(spark.read.parquet(path).schema[key].dataType)
    place = spark.range(1).select(bucket_of(typed, buckets)).first()[0]
    return spark.read.parquet(path).filter((F.col(BUCKET) == place) & (F.col(key) == typed)).drop(BUCKET)


def load_many(spark: SparkSession, path: str, keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows of many keys; folders in which none of them lies are not read where the keys are few enough to be broadcast."""
    wanted = keys.select(key).distinct().withColumn(BUCKET, bucket_of(F.col(key), buckets))
    return spark.read.parquet(path).join(wanted, [BUCKET, key], "left_semi").drop(BUCKET)
