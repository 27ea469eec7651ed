"""Line-delimited JSON files with exact line numbers, whatever the lines hold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbook.sources.ranged import numbered_lines

#: White space of Unicode, which lines are stripped of.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: JSON types by the names that drift markers use. Fixed values.
MARKER_TYPES = {"STRING": "str", "BIGINT": "int", "DOUBLE": "float", "BOOLEAN": "bool", "ARRAY": "list", "VOID": "NoneType"}


#: Kinds of packed files: transcripts, sub-agents' transcripts, what is both (not below a session's folder), sub-agents' descriptions.
PACKED = ("session", "agent", "both", "meta", "other")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def type_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN or VOID; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def marker_type(v: Column) -> Column:
    out = F.lit("float")
    for name, means in MARKER_TYPES.items():
        out = F.when(type_of(v) == name, means).otherwise(out)
    return out


def at(text: Column) -> Column:
    """An ISO time, or null."""
    return text.try_cast("timestamp")


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, modified_after: datetime | None = None, range_bytes: int | None = None) -> DataFrame:
    """(path, line_no, line, v): non-blank lines without white space at their ends; ``v`` is null for broken ones.

    A file is read whole by one task, which keeps it below 2 GB and its line numbers
    exact; with ``range_bytes`` several tasks read it by ranges, at any size, with the
    same result. ``modified_after`` leaves older files out.
    """
    if range_bytes:
        return _with_values(numbered_lines(spark, path, glob, modified_after, range_bytes))
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _with_values(files.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long")))


def _kind(path: Column) -> Column:
    """Which of the ``PACKED`` kinds a file is of, by its path."""
    agent = path.rlike(r"/agent-[^/]*\.jsonl$")
    out = F.when(path.rlike(r"/agent-[^/]*\.meta\.json$"), "meta").when(agent, F.when(path.contains("/subagents/"), "agent").otherwise("both"))
    return out.when(path.endswith(".jsonl") & ~path.contains("/subagents/"), "session").otherwise("other")


def pack_lines(lines: DataFrame, to: str) -> None:
    """Writes (path, line_no, line) as text files that many small files share: each line behind its file's path and number.

    A file's lines lie together and in order; their numbers begin at 0 without gaps, and
    blank lines count. Paths are URIs, so they hold no tab; lines hold no line end.
    Each of the ``PACKED`` kinds has a folder, so that who asks for one does not read the others.
    """
    row = F.concat_ws("\t", "path", F.col("line_no").cast("string"), F.coalesce("line", F.lit("")))
    kept = lines.repartition("path").withColumn("kind", _kind(F.col("path"))).sortWithinPartitions("kind", "path", "line_no")
    kept.select(row.alias("value"), "kind").write.partitionBy("kind").text(to)


def read_packed(spark: SparkSession, packed: str, range_bytes: int | None = None, kinds: tuple[str, ...] = PACKED) -> DataFrame:
    """What ``read_lines`` gives of the files that ``pack_lines`` put together: tasks and listings go by bytes, not by files.

    With ``range_bytes`` the packed files are read by ranges, and a line's number is
    told by its place behind the first line of its file, not by the one written beside it.
    """
    if range_bytes:
        told = numbered_lines(spark, packed, range_bytes=range_bytes).filter(F.regexp_extract("path", r"/kind=(\w+)/[^/]*$", 1).isin(*kinds)).select("line_no", "line")
    else:
        text = spark.read.option("lineSep", "\n").text(packed)
        told = (text.filter(F.col("kind").isin(*kinds)) if "kind" in text.columns else text).select(F.col("value").alias("line"))  # nothing packed: no folder
    # Exploded, so that the filter on blank lines looks at the parts and does not split each line anew wherever it names one.
    told, parts = told.withColumn("parts", F.explode(F.array(F.split("line", "\t", 3)))), F.col("parts")
    number = F.col("line_no") - F.min("line_no").over(Window.partitionBy(parts[0])) if range_bytes else parts[1].cast("long")
    return _with_values(told.select(parts[0].alias("path"), number.alias("line_no"), parts[2].alias("line")))


def _with_values(lines: DataFrame) -> DataFrame:
    # An object's braces are no white space; stripping looks up each character of a line.
    stripped = lines.withColumn("line", F.when(F.col("line").startswith("{") & F.col("line").endswith("}"), F.col("line")).otherwise(F.btrim("line", F.lit(WHITE))))
    return stripped.filter("line != ''").withColumn("v", F.try_parse_json("line"))


def unknown_fields(line: Column, kind: Column, known: dict[str, list[str]], prefix: str) -> Column:
    """Markers of fields that a known kind of line should not have."""
    out = F.array().cast("array<string>")
    for name, fields in known.items():
        extra = F.array_except(F.json_object_keys(line), F.array(*map(F.lit, fields)))
        marked = F.concat(F.lit(f"{prefix}{name}."), F.array_join(extra, f"\n{prefix}{name}."))
        out = F.when(kind == name, F.when(F.size(extra) > 0, F.split(marked, "\n"))).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def status_counts(files: DataFrame) -> DataFrame:
    """How many files were new, existing, broken or refused."""
    return files.groupBy("status").agg(F.count("*").alias("n"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
