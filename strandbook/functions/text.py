"""Text functions: safe identifiers, what must not be stored, labels, redaction. All are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "<redacted>"

# The mark of local-only content, what looks like a path, a secret or an address, and the
# two forms of model names that may hold slashes.
LOCAL_MARK = "_lokal"
PATH = r"[/\\]|[A-Za-z]:\\"
SECRET = r"sk-|AKIA|ghp_|-----BEGIN"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: An address is looked for where a run of its signs begins, and not again from each of them.
EMAIL_FROM_ITS_START = r"(?<![A-Za-z0-9._%+-])" + EMAIL
MODEL_NAMES = r"^([A-Za-z0-9][A-Za-z0-9_.\-]*|hf\.co/[A-Za-z0-9][A-Za-z0-9_.\-]*)/[A-Za-z0-9][A-Za-z0-9_.\-]*(:[A-Za-z0-9_.\-]+)?$"
IDENTIFIER, UNKNOWN = r"^[A-Za-z0-9_.:\-]{1,48}$", "unbekannt:"
LOCAL_HOST = r"(?i)\b(localhost|127\.0\.0\.1|192\.168\.\d+\.\d+|10\.\d+\.\d+\.\d+)\b|\.local\b"
MOST_CHARS = 80


def hash_prefix(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text.cast("string"), 256), 1, digits)


def safe_identifier(name: Column) -> Column:
    """Short plain names stay, empty and null ones too; others become a mark and a hash prefix."""
    return F.when((name == "") | name.rlike(IDENTIFIER), name).when(name.isNotNull(), F.concat(F.lit(UNKNOWN), hash_prefix(name, 8)))


def violation(text: Column, length: bool = True) -> Column:
    """The first reason why a string must not be stored: length, local, path, secret, email; null if none."""
    out = F.when(F.length(text) > MOST_CHARS, "length") if length else F.when(F.lit(False), "length")
    out = out.when(text.contains(LOCAL_MARK), "local")
    out = out.when(text.rlike(PATH), "path").when(text.rlike(SECRET), "secret")
    return out.when(text.contains("@") & text.rlike(EMAIL_FROM_ITS_START), "email")  # the pattern is slow where there is no address


def is_model_name(text: Column) -> Column:
    """Model names may hold a slash (provider/model, hf.co/user/model), but nothing else that is forbidden."""
    slashless = ~text.rlike(r"[/\\]")
    return (F.length(text) <= MOST_CHARS) & ~text.contains(LOCAL_MARK) & (text != "") & (slashless | text.rlike(MODEL_NAMES))


def label(text: Column, most: int = 80) -> Column:
    """At most ``most`` characters; longer texts end in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def _by_token(text: Column, rule) -> Column:
    """Applies ``rule`` to each token and leaves the white space as it is."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\s"), t).otherwise(rule(t))), "")


def is_path_token(t: Column) -> Column:
    """A drive, tilde or dot before a separator, or two separators."""
    return t.rlike(r"^([A-Za-z]:[/\\]|~[/\\]|\.{1,2}[/\\])") | (F.length(F.regexp_replace(t, r"[^/\\]", "")) >= 2)


def redact_chat(text: Column) -> Column:
    """Replaces the whole text if it holds a secret, address or local host, else only path tokens."""
    bad = text.rlike(SECRET) | text.rlike(EMAIL) | text.contains(LOCAL_MARK)
    return F.when(bad, REDACTED).otherwise(_by_token(text, lambda t: F.when(is_path_token(t), "<path>").otherwise(t)))


def redact_error(text: Column, names: list[str] | None = None) -> Column:
    """Error texts keep their words: names, paths, hosts, addresses and keys are replaced one by one."""
    for name in names or []:
        text = F.regexp_replace(text, r"(?i)\b" + name + r"\b", "<name>")
    rule = lambda t: (
        F.when(t.rlike(SECRET) | t.rlike(r"^[A-Za-z0-9+/_=-]{32,}$"), "<key>").when(t.rlike(EMAIL), "<address>")
        .when(t.rlike(LOCAL_HOST) | t.rlike(r"^https?://"), "<host>").when(is_path_token(t), "<path>").otherwise(t))
    return _by_token(text, rule)


def plain_category(text: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def file_name(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_"), 1, most)


def project_name(cwd: Column) -> Column:
    """The last part of a path with either separator; null without one."""
    return F.get(F.reverse(F.filter(F.split(cwd, r"[\\/]+"), lambda x: x != "")), F.lit(0))


# What counts as evidence in a text, a line of a file, quoted code, or a test with a number soon after.
EVIDENCE = (r"\w+\.\w+:\d+", r"`[^`\n]+`", r"Test[^\d\n]{0,20}\d+")


def has_evidence(text: Column) -> Column:
    """Whether a text names any evidence."""
    return text.rlike(EVIDENCE[0]) | text.rlike(EVIDENCE[1]) | text.rlike(EVIDENCE[2])


def thousands(n: Column) -> Column:
    return F.regexp_replace(F.format_number(n, 0), ",", ".")


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%d h %02d min", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%d min %02d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d s", s))


# Records: every string of a nested column is scanned or cleaned, by a walk over the schema.

def _strings(column: Column, kind: T.DataType, path: str) -> list[Column]:
    """For each string inside, an array of ``path: class`` texts."""
    tell = lambda p, v: F.when(v.isNotNull(), F.concat(F.lit(f"{p}: "), v))
    if isinstance(kind, T.StringType):
        return [F.array_compact(F.array(tell(path, violation(column))))]
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _strings(column[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        inner = lambda e: F.flatten(F.array(*parts)) if (parts := _strings(e, kind.elementType, f"{path}[]")) else F.array().cast("array<string>")
        return [F.coalesce(F.flatten(F.transform(column, inner)), F.array().cast("array<string>"))]
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        keys = F.array_compact(F.transform(F.map_keys(column), lambda k: tell(f"{path}{{}}", violation(k))))
        return [F.coalesce(keys, F.array().cast("array<string>")), *_strings(F.map_values(column), T.ArrayType(kind.valueType), path)]
    return []


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds ``violations``: where strings must not be stored, and why."""
    found = [x for f in df.schema.fields if columns is None or f.name in columns for x in _strings(F.col(f.name), f.dataType, f.name)]
    return df.withColumn("violations", F.flatten(F.array(*found)) if found else F.array().cast("array<string>"))


def _cleaned(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(violation(column).isNotNull(), F.lit(REDACTED)).otherwise(column)
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_cleaned(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda e: _cleaned(e, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(F.map_filter(column, lambda k, v: violation(k).isNull()), lambda k, v: _cleaned(v, kind.valueType))
    return column


def clean(df: DataFrame, columns: list[str] | None = None, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Replaces such strings, drops such map keys, and counts them in ``redactions``; ``exempt`` columns stay."""
    names = [f for f in df.schema.fields if (columns is None or f.name in columns) and f.name not in exempt]
    counted = scan(df, [f.name for f in names])
    return counted.withColumns({f.name: _cleaned(F.col(f.name), f.dataType) for f in names}).withColumn("redactions", F.size("violations")).drop("violations")
