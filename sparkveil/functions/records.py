"""Expressions over records: redaction by key, roles, key lists, errors, retention, recommendations, policy overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ROLES


def redact_keys(record: Column, hidden: list[str]) -> Column:
    return F.transform_values(record, lambda k, v: F.when(F.lower(k).isin(hidden), "<REDACTED>").otherwise(v))


def redact_secrets(record: Column) -> Column:
    return F.transform_values(record, lambda k, v: F.when(F.lower(k).contains("secret") | F.lower(k).contains("token"), "[REDACTED]").otherwise(v))


def parse_keys(text: Column) -> Column:
    """Map of key to role from 'key:role,key'; a key without a role is a service account, empty parts are passed over, of equal keys the last holds."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.when(p.contains(":"), F.trim(F.regexp_replace(p, "^[^:]*:", ""))).otherwise("service_account").alias("role")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def role_rank(role: Column) -> Column:
    out = F.lit(0)
    for name, rank in ROLES.items():
        out = F.when(role == name, rank).otherwise(out)
    return out


def errors(checks: list[tuple[Column, str]]) -> Column:
    """Names of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(c, n) for c, n in checks]), lambda x: x.isNotNull())


def expired(changed: Column, now: Column, days: int) -> Column:
    return changed < now - F.expr(f"interval {days} days")


def flatten_entities(texts: list[Column], lists: list[Column]) -> Column:
    """Entities of texts with commas and of lists, trimmed, each once in order of first sight."""
    all_ = F.flatten(F.array(*[F.split(t, ",") for t in texts], *lists))
    return F.array_distinct(F.filter(F.transform(all_, lambda x: F.trim(x)), lambda x: x != ""))


def recommendations(kind: Column, density: Column) -> Column:
    """struct<denoise,target_size,preserve_text> by image kind and text density."""
    scan, sound, dense = F.upper(kind).isin("X-RAY", "CT", "MRI"), F.upper(kind) == "ULTRASOUND", density > 0.05
    denoise = F.when(dense, "bilateral").when(scan, "nlmeans").when(sound, "median").otherwise("bilateral")
    return F.struct(denoise.alias("denoise"), F.when(scan, 2048).otherwise(1024).alias("target_size"), dense.alias("preserve_text"))


def display_type(brightness: Column, width: Column, height: Column) -> Column:
    return F.when(brightness < 40, "ultrasound_like").when((width > height) & (brightness > 100), "monitor_like").otherwise("workstation_like")


def overlay(policies: DataFrame, overrides: DataFrame) -> DataFrame:
    """policies (entity, tier, operator, params) with overrides (entity, operator, params): their operator holds where there is one, their
    parameters go over the old ones, and an entity that was not there is contextual, with `replace` by default. Both are small tables."""
    o = overrides.select(F.upper("entity").alias("entity"), F.col("operator").alias("o"), F.col("params").alias("q"))
    old, new = F.coalesce("params", F.create_map().cast("map<string,string>")), F.coalesce("q", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return policies.join(o, "entity", "full").select("entity", F.coalesce("tier", F.lit("contextual")).alias("tier"), F.coalesce("o", "operator", F.lit("replace")).alias("operator"), merged.alias("params"))


def overlay_rows(policies: list[tuple], overrides: list[tuple]) -> list[tuple[str, str, str, str, str]]:
    """What overlay() gives for literal tables: (entity, tier, operator, masking_char, new_value), worked out row by row for comparison."""
    rows = {e: [t, o, dict(p)] for e, t, o, p in policies}
    for e, o, p in overrides:
        row = rows.setdefault(e.upper(), ["contextual", "replace", {}])
        row[1] = o or row[1]
        row[2].update(p or {})
    return [(e, t, o, p.get("masking_char", ""), p.get("new_value", "")) for e, (t, o, p) in rows.items()]
