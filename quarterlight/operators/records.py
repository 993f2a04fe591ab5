"""Records as VARIANT: JSON as it stands, with its nested objects, lists and types of numbers.

A path is a column or text like "metadata.file_size"; it goes through objects, not lists.  A
field that isn't there differs from one that is null.  Rules on any field are judged by the JSON type that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import RULE_FAILED, RULES, Rule

ABSENT, NULL = "absent", "null"


def parsed(json: Column) -> Column:
    """Null where the text is no JSON."""
    return F.try_parse_json(json)


def at(record: Column, path: Column | str) -> Column:
    """What is at the path, as a variant; null where the record has no such field."""
    steps = F.lit(path) if isinstance(path, str) else path
    return F.try_variant_get(record, F.concat(F.lit("$['"), F.replace(steps, F.lit("."), F.lit("']['")), F.lit("']")), "variant")


def kind(value: Column) -> Column:
    """absent, null, int, float, str, bool, dict or list.  A number that is whole but written with decimals is a float, up to
    18 digits; a longer whole number is an int."""
    name = F.schema_of_variant(value)
    digits = F.regexp_extract(name, r"^DECIMAL\(([0-9]+),0\)", 1).try_cast("int")
    named = F.when(value.isNull(), ABSENT).when(F.is_variant_null(value), NULL).when((name == "BIGINT") | (digits > 18), "int").when(name.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float")
    return named.when(name == "STRING", "str").when(name == "BOOLEAN", "bool").when(F.startswith(name, F.lit("OBJECT")), "dict").when(F.startswith(name, F.lit("ARRAY")), "list")


def text(value: Column) -> Column:
    """A value as messages show it; objects and lists as JSON."""
    k = kind(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.when(k == "bool", F.initcap(plain)).when(k == "float", F.try_variant_get(value, "$", "double").cast("string")).when(k.isin("dict", "list"), F.to_json(value)).when(~k.isin(ABSENT, NULL), plain)


def number(value: Column) -> Column:
    """Numbers, and the 1 or 0 of a truth value; null for anything else."""
    return F.when(kind(value).isin("int", "float", "bool"), F.try_variant_get(value, "$", "double"))


def empty(value: Column) -> Column:
    return F.coalesce(F.to_json(F.when(kind(value).isin("dict", "list"), value)).isin("{}", "[]"), F.lit(False))


def message_of(record: Column, rule: Rule) -> Column:
    """The rule's message where it is broken, else null."""
    value, said, p = at(record, rule.column), F.lit(rule.message), rule.parameters
    k = kind(value)
    there = ~k.isin(ABSENT, NULL)
    shown = lambda what: F.concat(said, F.lit(f" ({what}: "), text(value), F.lit(")"))
    if rule.kind == "required":
        return F.when(~there, said).when(empty(value), F.concat(said, F.lit(" (欄位為空)")))
    if rule.kind == "type":
        fits = {"int": ("int", "bool"), "str": ("str",), "float": ("float",), "dict": ("dict",), "list": ("list",), "bool": ("bool",)}[p["type"]]
        return F.when(there & ~k.isin(*fits), F.concat(said, F.lit(" (實際類型: "), k, F.lit(")")))
    if rule.kind == "range":
        out = F.when(k.isin("str", "dict", "list"), F.concat(F.lit(f"{RULE_FAILED}: '{'<' if 'min' in p else '>'}' not supported between instances of '"), k, F.lit("' and 'int'")))
        out = out.when(number(value) < p["min"], shown("值太小")) if "min" in p else out
        return out.when(number(value) > p["max"], shown("值太大")) if "max" in p else out
    if rule.kind == "format":
        return F.when(there & ~text(value).rlike(p["pattern"]), shown("格式不符"))
    raise ValueError(f"unknown kind of rule: {rule.kind}")


def judged(records: DataFrame, rules: tuple[Rule, ...] = RULES, record: str = "record") -> DataFrame:
    """``records`` with errors and warnings of rules on any path, in the rules' order; one pass."""
    of = lambda severity: F.array_compact(F.array(F.lit(None).cast("string"), *[message_of(F.col(record), r) for r in rules if r.severity == severity]))
    return records.withColumns({"errors": of("error"), "warnings": of("warning")})


def paths(records: DataFrame, keys: list[str], wanted: list[str], record: str = "record") -> DataFrame:
    """(keys, path, kind, value): each of the paths, wherever it leads."""
    rows = records.select(*keys, record, F.explode(F.array(*map(F.lit, wanted))).alias("path"))
    value = at(F.col(record), F.col("path"))
    return rows.select(*keys, "path", kind(value).alias("kind"), text(value).alias("value"))
