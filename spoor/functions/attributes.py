"""Columns over an evidence row's attributes: a map of lower-case keys to text, parsed once from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,string>"
#: File endings that make a name executable, and those that make a token look like a file.
EXECUTABLE = ("exe", "dll", "bat", "ps1", "scr", "pif")
FILE_LIKE = ("exe", "dll", "bat", "cmd", "ps1", "scr", "pif")


def json_object(text: Column) -> Column:
    """The JSON object's keys and values as text; null where text is no object."""
    return F.from_json(text, MAP)


def lower_keys(raw: Column) -> Column:
    """A map with its keys lower-cased (the later of clashing keys wins); null if it is empty. raw should be a column, not an expression: it is named several times."""
    plain = F.map_keys(raw) == F.transform(F.map_keys(raw), F.lower)
    # the general form runs only for rows with an upper-case key
    entries = F.transform(F.map_entries(raw), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(F.map_keys(raw), F.lower))
    last = F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.when((F.size(raw) > 0) & plain, raw).when(F.size(raw) > 0, F.map_from_entries(last))


def parse_attributes(text: Column) -> Column:
    """The JSON object's keys, lower-cased (the later of clashing keys wins), and values as text; null where text is no object or empty."""
    return lower_keys(json_object(text))


def with_attributes(df: DataFrame, text: str = "artifact_value") -> DataFrame:
    """df with attributes, as parse_attributes gives them, from one parse a row."""
    return df.withColumn("_object", json_object(F.col(text))).withColumn("attributes", lower_keys(F.col("_object"))).drop("_object")


def first_key(attributes: Column, *keys: str) -> Column:
    """The first of the keys that has a value."""
    return F.coalesce(*(F.try_element_at(attributes, F.lit(k)) for k in keys))


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def normalize_pid(value: Column) -> Column:
    """Canonical decimal text of an integer or its text; null for anything else."""
    bare = F.trim(value)
    return F.when(bare.rlike(r"^[+-]?\d{1,18}$"), bare.cast("long").cast("string"))


def norm_path(value: Column) -> Column:
    bare = F.trim(value)
    return F.when(bare != "", F.regexp_replace(F.translate(F.lower(bare), "\\", "/"), "^/+|/+$", ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def ends_with(value: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(value).rlike(r"\.(?:" + "|".join(endings) + ")$")


def is_executable(value: Column) -> Column:
    return ends_with(text_of(value), EXECUTABLE)


def cmd_token(command: Column) -> Column:
    return F.regexp_extract(text_of(command), r"\S+", 0)


def looks_like_path(token: Column) -> Column:
    return token.contains("/") | token.contains("\\") | ends_with(token, FILE_LIKE)


def build_document(**parts: Column) -> Column:
    """key: value lines of the non-null parts."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in parts.items()))


def content_hash(document: Column) -> Column:
    return F.sha2(document, 256)


def region_kind(family: Column, attributes: Column) -> Column:
    flag = F.lower(F.trim(first_key(attributes, "privatememory")))
    return F.when(family == "malfind", F.when(flag.isin("1", "true", "yes"), "PRIVATE-COMMITTED").when(flag.isin("0", "false", "no"), "MAPPED"))


def is_low_information(data: Column) -> Column:
    """No bytes, or at least four hex bytes that are all equal; other text: one character repeated."""
    bare = F.trim(text_of(data))
    parts = F.split(F.lower(bare), r"\s+")
    hexes = F.forall(parts, lambda p: p.rlike("^(?:0x)?[0-9a-f]{1,2}$"))
    values = F.array_distinct(F.transform(parts, lambda p: F.conv(F.regexp_replace(p, "^0x", ""), 16, 10)))
    return F.when(bare == "", True).when(hexes, (F.size(parts) >= 4) & (F.size(values) == 1)).otherwise(bare.rlike(r"^(.)\1*$"))


def parse_event_ts(value: Column) -> Column:
    """ISO 8601 only; years before 1990 are placeholders."""
    bare = F.trim(value)
    ts = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}.*)?$"), F.try_to_timestamp(bare))
    return F.when(F.year(ts) >= 1990, ts)


def distance_to_score(distance: Column) -> Column:
    return F.round(1 / (1 + distance), 4)


def format_duration(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60), F.bround(seconds % 60, 0).cast("long")
    long = F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))
    return F.when(seconds <= 0, F.lit("N/A")).when(minutes > 0, long).when(seconds > 0, F.format_string("%.1fs", F.bround(seconds.cast("double"), 1)))


def format_size(size: Column) -> Column:
    """Bytes as text in the largest unit, up to TB, of which there is at least one."""
    value = size.cast("double")
    out = F.format_string("%.2f TB", value / (1 << 40))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(value < 1 << 10 * (power + 1), F.format_string(f"%.2f {unit}", value / (1 << 10 * power))).otherwise(out)
    return F.when(value < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).when(value >= 1024, out)


def error_summary(error: Column, length: int = 160) -> Column:
    return F.left(F.element_at(F.split(F.trim(error), "\n"), -1), F.lit(length))
