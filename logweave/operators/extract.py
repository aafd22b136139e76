"""Attribute extraction: the first matching pattern of a log's source gives attributes, keys and flags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import typed
from ..plans.rules import FiberType, Regex, Rules, source_type


def _captures(regex: Regex, names: list[str]) -> Column:
    """A struct of the named captures, null where the pattern has no such group or the group took no part."""
    groups = regex.groups
    if not regex.optional:
        return F.struct(*[(F.regexp_extract("raw_text", regex.jvm, groups[n]) if n in groups else F.lit(None).cast("string")).alias(n) for n in names])
    pattern = regex.python.pattern

    @F.pandas_udf("array<string>")  # the JVM function does not tell an empty group from an absent one
    def found(texts: pd.Series) -> pd.Series:
        import re

        compiled = re.compile(pattern)

        def one(text: str | None) -> list:
            m = compiled.search(text or "")
            return [m[n] if m and n in groups else None for n in names]

        return texts.map(one)

    values = found(F.col("raw_text"))
    return F.struct(*[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)])


def _match(fiber_type: FiberType) -> Column:
    """What the first matching pattern of a log's source tells: number, captures and flags; null where none matches."""
    names = [a.name for a in fiber_type.attributes if a.derived is None]
    case: Column | None = None
    for source_id, patterns in fiber_type.sources.items():
        for i, p in enumerate(patterns):
            regex = Regex(p.regex)
            flags = [F.array(*[F.lit(k) for k in ks]).cast("array<string>") for ks in (p.release_peer, p.release_self)]
            value = F.struct(F.lit(i).alias("pattern_idx"), _captures(regex, names).alias("raw") if names else F.struct(F.lit(0).alias("_")).alias("raw"), flags[0].alias("release_peer"), flags[1].alias("release_self"), F.lit(p.close).alias("close"))
            hit = (F.col("source_id") == source_id) & F.col("raw_text").rlike(regex.jvm)
            case = F.when(hit, value) if case is None else case.when(hit, value)
    return case


def _attributes(rows: DataFrame, fiber_type: FiberType, columns: list[str]) -> DataFrame:
    """Attributes of rows that match (``__m``), derived ones among them."""
    values = {a.name: F.col("__m.raw")[a.name] for a in fiber_type.attributes if a.derived is None}
    for a in fiber_type.derived_order():
        parts = [values[text] if is_attribute else F.lit(text) for is_attribute, text in a.parts()]
        values[a.name] = F.concat(*parts) if parts else F.lit("")
        rows = rows.withColumn(f"__d_{a.name}", values[a.name])
        values[a.name] = F.col(f"__d_{a.name}")
    attrs = F.struct(*[values[a.name].alias(a.name) for a in fiber_type.attributes])
    flags = [F.col(f"__m.{n}").alias(n) for n in ("release_peer", "release_self", "close")]
    return rows.select(*columns, F.lit(fiber_type.name).alias("fiber_type"), F.col("__m.pattern_idx").alias("pattern_idx"), attrs.alias("attrs"), *flags)


def extract(logs: DataFrame, fiber_type: FiberType) -> DataFrame:
    """Logs of the type: adds ``pattern_idx, attrs`` (raw strings by name), ``release_peer, release_self, close``."""
    # generated, so that the patterns are tried once and not for each use of what they tell
    told = F.explode(F.array_compact(F.array(_match(fiber_type)))).alias("__m")
    rows = logs.filter(F.col("source_id").isin(*fiber_type.sources)).select("*", told)
    return _attributes(rows, fiber_type, logs.columns)


def match_types(logs: DataFrame, rules: Rules) -> DataFrame:
    """The logs once for each type that they match, in one pass over them: ``__type`` and what the pattern tells
    (``__m``, captures by name). :func:`matched` gives a type's rows as :func:`extract` does."""
    rows, found = logs, []
    for i, t in enumerate(rules.types):
        rows = rows.withColumn(f"__m{i}", F.when(F.col("source_id").isin(*t.sources), _match(t)))
        told = F.col(f"__m{i}")
        captures = [x for a in t.attributes if a.derived is None for x in (F.lit(a.name), told["raw"][a.name])]
        raw = F.create_map(*captures) if captures else F.create_map().cast("map<string,string>")
        one = F.struct(told["pattern_idx"].alias("pattern_idx"), raw.alias("raw"), *[told[n].alias(n) for n in ("release_peer", "release_self", "close")])
        found.append(F.when(told.isNotNull(), F.struct(F.lit(t.name).alias("__type"), one.alias("__m"))))
    return rows.select(*logs.columns, F.inline(F.array_compact(F.array(*found))))


def matched(rows: DataFrame, fiber_type: FiberType) -> DataFrame:
    """The rows of one type of :func:`match_types`."""
    columns = [c for c in rows.columns if c not in ("__type", "__m")]
    return _attributes(rows.filter(F.col("__type") == fiber_type.name), fiber_type, columns)


def cast_attributes(extracted: DataFrame, fiber_type: FiberType) -> DataFrame:
    """Adds ``values``: the attributes by their types; a value that does not fit is null, a key of it stays."""
    fields = [typed(F.col(f"attrs.{a.name}"), a.type).alias(a.name) for a in fiber_type.attributes]
    return extracted.withColumn("values", F.struct(*fields))


def key_tokens(extracted: DataFrame, fiber_type: FiberType, normalize_keys: bool = False) -> DataFrame:
    """One row per log and key: ``key, value`` by the raw text, or by the typed one."""
    kinds = {a.name: a.type for a in fiber_type.attributes}

    def value(k: str) -> Column:
        raw = F.col(f"attrs.{k}")
        return F.coalesce(typed(raw, kinds[k]).cast("string"), raw) if normalize_keys else raw

    tokens = F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in fiber_type.keys])
    kept = F.filter(tokens, lambda t: t["value"].isNotNull())
    return extracted.withColumn("__t", F.explode(kept)).select(*extracted.columns, F.col("__t.key").alias("key"), F.col("__t.value").alias("value"))


def extract_source(logs: DataFrame, source_id: str) -> DataFrame:
    return extract(logs, source_type(source_id))


def pattern_coverage(logs: DataFrame, rules: Rules) -> DataFrame:
    """Logs by type, source and the pattern that matched first (-1: none did)."""
    parts = []
    for t in rules.types:
        case: Column | None = None
        for source_id, patterns in t.sources.items():
            for i, p in enumerate(patterns):
                hit = (F.col("source_id") == source_id) & F.col("raw_text").rlike(Regex(p.regex).jvm)
                case = F.when(hit, i) if case is None else case.when(hit, i)
        known = logs.filter(F.col("source_id").isin(*t.sources))
        parts.append(known.groupBy(F.lit(t.name).alias("fiber_type"), "source_id", F.coalesce(case, F.lit(-1)).alias("pattern_idx")).agg(F.count(F.lit(1)).alias("n_logs")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
