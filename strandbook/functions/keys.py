"""Keys of model catalogues: spellings of one model are brought together by normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the parts of a model's name mean.
#: Ways to order one model.
VARIANTS = ("flex", "batch", "free")
#: Words that say nothing about which model it is, when indices are looked up.
NOISE = ("instruct", "chat", "it", "preview", "latest", "exp", "v1", "v2", "v3", "free", "hf", "gguf")
#: Endings of routers and efforts, which are no model of their own.
ALIAS_WORDS = ("latest", "high", "medium", "low", "priority", "free", "nitro", "exacto", "online")
#: Families that some write with and others without a hyphen before the version.
PARTED_FAMILIES = ("gemma", "gemini")
RESELLERS = ("parasail",)
#: Tiers are families of their own within a line; modifiers are not.
TIERS = ("mini", "nano", "micro", "lite", "flash", "pro", "max", "ultra", "super", "plus", "turbo", "small", "medium", "large", "sol", "terra", "luna", "opus", "sonnet", "haiku", "fable", "mythos")
MODIFIERS = ("exp", "preview", "beta", "chat", "instruct", "it", "thinking", "reasoning", "non", "fast")
#: Letters that stand before or behind a version.
MARKERS = ("v", "r")

END = r"(?=-|$)"
MONTH, DAY = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12][0-9]|3[01])"


def display_form(model: Column) -> Column:
    """Without the provider before the last slash (a path at hf.co stays whole), the region behind @, and how it is ordered."""
    m = F.trim(model)
    m = F.when(F.lower(m).startswith("hf.co/"), m).otherwise(F.substring_index(m, "/", -1))
    return F.regexp_replace(F.substring_index(m, "@", 1), f"(?i):({'|'.join(VARIANTS)})$", "")


def short_name(model: Column) -> Column:
    """The display form in lower case; size tags stay, as they are models of their own."""
    return F.lower(display_form(model))


def is_cloud(model: Column) -> Column:
    """Whether a local runner's name says that the model runs elsewhere. Only the raw name tells."""
    return F.lower(model).rlike("[:-]cloud$")


def normal_key(model: Column) -> Column:
    """The short name with every run of other characters than letters and digits as one hyphen."""
    return F.trim(F.regexp_replace(short_name(model), r"[^a-z0-9]+", "-"), F.lit("-"))


def _parts(key: Column) -> Column:
    return F.filter(F.split(key, "-"), lambda t: t != "")


def sorted_key(model: Column) -> Column:
    """The parts of the normal key in order, so that their sequence does not matter, without a snapshot's date at the end."""
    return F.array_join(F.array_sort(_parts(F.regexp_replace(normal_key(model), r"(^|-)20[0-9]{6}$", ""))), "-")


def noiseless_key(model: Column) -> Column:
    """The sorted key without noise words; null if nothing else is left."""
    parts = F.filter(_parts(sorted_key(model)), lambda t: ~t.isin(*NOISE))
    return F.when(F.size(parts) > 0, F.array_join(parts, "-"))


def canonical_id(model: Column) -> Column:
    """The normal key without alias endings, cloud, a snapshot's date, and instruct; some families' versions are parted.

    A short date such as 2512 is a version and stays.
    """
    k = F.concat(F.lit("-"), normal_key(model))
    k = F.regexp_replace(k, f"(-({'|'.join(ALIAS_WORDS)}))+$", "")
    k = F.regexp_replace(k, "-cloud$", "")
    k = F.regexp_replace(k, "-20[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$", "")
    k = F.regexp_replace(k, f"-({'|'.join(PARTED_FAMILIES)})([0-9]+){END}", "-$1-$2")
    return F.trim(F.regexp_replace(k, f"-(it|instruct){END}", ""), F.lit("-"))


def _named(model: Column) -> Column:
    """The parts of the normal key, without a reseller in front."""
    return _parts(F.regexp_replace(normal_key(model), f"^({'|'.join(RESELLERS)})-", ""))


def _unsized(model: Column) -> Column:
    """The named parts without dates, builds and sizes (20b, a3b, and both parts of 2.4t)."""
    k = F.concat(F.lit("-"), F.array_join(_named(model), "-"))
    k = F.regexp_replace(k, f"-20[0-9][0-9]-{MONTH}-{DAY}{END}", "")
    k = F.regexp_replace(k, f"-[0-9]+(?=-[0-9]+t{END})", "")
    return _parts(F.regexp_replace(k, f"-(a?[0-9]+[bkmt]|[0-9]{{4}}){END}", ""))


def family(model: Column) -> Column:
    """Maker's line and tier: the name without versions, sizes and modifiers; the whole name if nothing else is left."""
    bare = F.transform(_unsized(model), lambda t: F.regexp_replace(F.regexp_replace(t, "^([a-z]*)[0-9]+$", "$1"), f"^({'|'.join(MARKERS)})$", F.when(t.rlike("[0-9]"), "").otherwise(t)))
    kept = F.filter(bare, lambda t: (t != "") & ~t.isin(*MODIFIERS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(_named(model)), "-")


def product_line(model: Column) -> Column:
    """The family without tiers; of a version with a marker behind it (5v) the marker stays."""
    parts = F.filter(_parts(family(model)), lambda t: ~t.isin(*TIERS))
    parts = F.transform(parts, lambda t: F.regexp_replace(t, f"^[0-9]+({'|'.join(MARKERS)})$", "$1"))
    return F.when(F.size(parts) > 0, F.array_join(parts, "-")).otherwise(family(model))


def version_tuple(model: Column) -> Column:
    """The version's parts as numbers, all but the first as decimal fractions (4.20 is 4.2); arrays compare like tuples.

    Without a version the array is empty, which is older than any other.
    """
    digits = F.filter(F.transform(_unsized(model), lambda t: F.regexp_extract(t, "^[a-z]*([0-9]+)$", 1)), lambda t: t != "")
    return F.transform(digits, lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.lit("0."), t)).cast("double"))


HF_NAME = r"(?i)^hf\.co/([^/]+)/(.+)-GGUF:(.+)$"


def shown_name(model: Column, bare: bool = False) -> Column:
    """The name as shown: hf.co paths as name, quantisation and organisation (or the ``bare`` name); others without provider, region, order and cloud or latest tag."""
    m = F.trim(model)
    part = lambda k: F.regexp_extract(m, HF_NAME, k)
    core = F.substring_index(F.substring_index(m, "/", -1), "@", 1)
    core = F.regexp_replace(F.regexp_replace(core, f"(?i):({'|'.join(VARIANTS)})$", ""), "(?i)(:cloud|-cloud|:latest)$", "")
    return F.when(m.rlike(HF_NAME), part(2) if bare else F.concat_ws(" · ", part(2), part(3), part(1))).otherwise(core)


def name_order(model: Column) -> Column:
    """What lists of local models are sorted by."""
    return F.lower(shown_name(model, bare=True))
