"""Declarative field workflows: ordered steps, each an action with parameters, compiled to one projection.

Every action is a function of (columns so far, parameters) to the columns it sets; nothing runs row by row in Python, and the
whole workflow is one plan that Catalyst can fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, collapsed, leading_zero_free, title_words

Fields = dict[str, Column]
ACTIONS: dict[str, Callable[[Fields, dict], Fields]] = {}
#: Grams in a unit of weight.
GRAMS = {"g": 1.0, "kg": 1000.0, "oz": 28.3495, "lb": 453.592}


def action(name: str):
    def keep(f: Callable[[Fields, dict], Fields]):
        ACTIONS[name] = f
        return f

    return keep


def run(df: DataFrame, steps: list[dict], variables: dict[str, str] | None = None) -> DataFrame:
    """df with the columns that the steps set. A step: {"action": ..., "params": {...}}; an unknown action is an error."""
    fields: Fields = {c: F.col(f"`{c}`") for c in df.columns}
    for step in steps:
        if step["action"] not in ACTIONS:
            raise ValueError(f"unknown action {step['action']}")
        fields |= ACTIONS[step["action"]](fields, substituted(step.get("params", {}), variables or {}))
    return df.select(*(v.alias(k) for k, v in fields.items()))


def substituted(value, variables: dict[str, str]):
    """{name} and {{name}} in strings replaced by variables; unknown names stay."""
    if isinstance(value, str):
        return re.sub(r"\{\{?(\w+)\}?\}", lambda m: str(variables.get(m[1], m[0])), value)
    if isinstance(value, dict):
        return {k: substituted(v, variables) for k, v in value.items()}
    return [substituted(v, variables) for v in value] if isinstance(value, list) else value


def transformed(x: Column, chain: list[dict]) -> Column:
    """A chain of text transformations; a null stays null but for `default`."""
    def one(v: Column, t: dict) -> Column:
        kind = t["type"]
        flag = "(?i)" if t.get("ignore_case") else ""
        made = {
            "replace": lambda: F.regexp_replace(v, flag + t["pattern"], t.get("replacement", "")),
            "strip": lambda: F.btrim(v, F.lit(t["chars"])) if t.get("chars") else F.trim(v),
            "lower": lambda: F.lower(v), "upper": lambda: F.upper(v), "title": lambda: title_words(v),
            "regex_extract": lambda: F.nullif(F.regexp_extract(v, flag + t["pattern"], t.get("group", 1)), F.lit("")),
            "prefix": lambda: F.concat(F.lit(t["value"]), v), "suffix": lambda: F.concat(v, F.lit(t["value"])),
            "default": lambda: F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit(t["value"])),
            "remove_prefix": lambda: F.when(F.startswith(v, F.lit(t["value"])), F.substr(v, F.lit(len(t["value"]) + 1))).otherwise(v),
            "remove_suffix": lambda: F.when(F.endswith(v, F.lit(t["value"])), F.substr(v, F.lit(1), F.length(v) - len(t["value"]))).otherwise(v),
        }
        if kind not in made:
            raise ValueError(f"unknown transformation {kind}")
        out = made[kind]()
        return F.coalesce(out, v) if t.get("preserve_on_no_match") else out

    return reduce(one, chain, x)


@action("transform_value")
def transform_value(fields: Fields, p: dict) -> Fields:
    return {p.get("target", p["field"]): transformed(fields[p["field"]], p["transformations"])}


@action("combine_fields")
def combine_fields(fields: Fields, p: dict) -> Fields:
    """A format with {field} places; null fields are empty, white space is collapsed."""
    parts = re.split(r"\{(\w+)\}", p["format"])
    cells = [F.coalesce(fields[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)]
    return {p["target"]: collapsed(F.concat(*cells))}


@action("parse_weight")
def parse_weight(fields: Fields, p: dict) -> Fields:
    """A weight in the target unit; null without a number and unit."""
    v = F.lower(fields[p["field"]])
    number = F.regexp_extract(v, r"(\d+(?:\.\d+)?)\s*(kg|g|oz|lb)s?\b", 1).try_cast("double")
    unit = F.create_map(*(F.lit(x) for kv in GRAMS.items() for x in kv))
    return {p.get("target", p["field"]): number * F.try_element_at(unit, F.regexp_extract(v, r"(\d+(?:\.\d+)?)\s*(kg|g|oz|lb)s?\b", 2)) / GRAMS[p.get("unit", "lb")]}


@action("extract_from_json")
def extract_from_json(fields: Fields, p: dict) -> Fields:
    """The value at a dotted path; numbers in it index lists; null where the path ends."""
    path = "$" + "".join(f"[{k}]" if k.isdigit() else f".{k}" for k in p["path"].split("."))
    return {p["target"]: F.get_json_object(fields[p["field"]], path)}


@action("parse_table")
def parse_table(fields: Fields, p: dict) -> Fields:
    """Rows of two cells of an HTML table as a map; the last of equal keys stays."""
    rows = F.regexp_extract_all(fields[p["field"]], F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    clean = lambda c: collapsed(F.regexp_replace(c, "<[^>]+>", " "))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    pairs = F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: F.struct(clean(c[0]).alias("key"), clean(c[1]).alias("value")))
    last = lambda own: F.filter(own, lambda q, i: F.array_position(own["key"], q["key"]) == i + 1)  # noqa: E731  from the last row to the first
    return {p["target"]: F.map_from_entries(F.reverse(bound(F.reverse(pairs), last)))}


@action("conditional")
def conditional(fields: Fields, p: dict) -> Fields:
    """Steps of `then` or `else` by field_exists or value_match; columns that neither sets stay."""
    v = fields.get(p["field"], F.lit(None).cast("string"))
    holds = v.isNotNull() & (F.trim(v.cast("string")) != "") if p["condition"] == "field_exists" else F.coalesce(v.cast("string") == F.lit(str(p.get("value"))), F.lit(False))

    def branch(steps: list[dict]) -> Fields:
        own = dict(fields)
        for s in steps:
            own |= ACTIONS[s["action"]](own, s.get("params", {}))
        return own

    a, b = branch(p.get("then", [])), branch(p.get("else", []))
    none = F.lit(None)
    return {k: F.when(holds, a.get(k, none)).otherwise(b.get(k, none)) for k in {**a, **b} if a.get(k) is not fields.get(k) or b.get(k) is not fields.get(k)}


@action("normalize_sku")
def normalize_sku(fields: Fields, p: dict) -> Fields:
    return {p.get("target", p["field"]): leading_zero_free(fields[p["field"]])}
