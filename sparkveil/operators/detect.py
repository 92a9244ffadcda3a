"""Detection, scoring, overlap merge and anonymisation as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions import text as X
from sparkveil.functions.finders import Finder, finder
from sparkveil.functions.rules import ALIASES, PATTERNS, POLICIES

CONTEXT = 30


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt out over the cores where the scan has fewer partitions than that (a file of one row group); else as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    scanned = len(docs.inputFiles()) if docs.inputFiles() else cores
    return docs.repartition(cores) if scanned < cores else docs


def finders(rules: list[tuple[str, str, bool]]) -> list[tuple[int, str, Finder]]:
    return [(k, rule[0], finder(rule)) for k, rule in enumerate(rules)]


def _find(rules: list[tuple[str, str, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find_all = finders(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(i, k, name, s, e, t[s:e], t[max(0, s - CONTEXT) : e + CONTEXT]) for i, t in enumerate(part.column(1).to_pylist()) if t for k, name, find in find_all for s, e in find(t)]
                if rows:
                    i, *cols = zip(*rows, strict=True)
                    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["key", "ord", "phi_type", "start", "end", "text", "context"])

    return run


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: list[tuple[str, str, bool]] | None = None, base: float = 0.6) -> DataFrame:
    """(key, ord, phi_type, start, end, text, context, base): one pass over each text for all patterns, in Arrow batches.

    Null texts give no rows. ord numbers the patterns; context is the span with 30 characters on either side.
    """
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_find(PATTERNS if patterns is None else patterns), f"key {kind}, ord int, phi_type string, start int, end int, text string, context string")
    return found.withColumnRenamed("key", key).withColumn("base", F.lit(base))


def score(found: DataFrame) -> DataFrame:
    """Adds context_score, confidence (combined) and whether it reaches its type's threshold."""
    c = X.context_score(F.col("phi_type"), F.col("context"))
    d = X.detection_confidence(F.col("base"), F.length("text"), F.col("context_score"))
    out = found.withColumn("context_score", c).withColumn("confidence", X.combined_confidence(d, F.col("context_score")))
    return out.withColumn("kept", F.col("confidence") >= X.threshold_of(F.col("phi_type")))


def merge(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Greedy overlap merge: by confidence from high to low, then pattern and place, each detection is folded into the
    first kept span that it overlaps (widening it, its text staying) or kept. (key, phi_type, start, end, text, merged)."""
    kind = "array<struct<start:int,end:int,phi_type:string,text:string,merged:int>>"

    def step(kept: Column, d: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: (k["start"] < d["end"]) & (d["start"] < k["end"])), True)
        widened = F.transform(
            kept,
            lambda k, i: F.when(i + 1 == hit, F.struct(F.least(k["start"], d["start"]).alias("start"), F.greatest(k["end"], d["end"]).alias("end"), k["phi_type"].alias("phi_type"), k["text"].alias("text"), (k["merged"] + 1).alias("merged"))).otherwise(k),
        )
        return F.when(hit > 0, widened).otherwise(F.concat(kept, F.array(F.struct(d["start"].alias("start"), d["end"].alias("end"), d["phi_type"].alias("phi_type"), d["text"].alias("text"), F.lit(0).alias("merged")))))

    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("base")).alias("o"), "ord", "start", "end", "phi_type", "text"))).alias("all"))
    kept = F.aggregate("all", F.array().cast(kind), lambda a, d: step(a, d).cast(kind))
    return rows.select(key, F.explode(kept).alias("k")).select(key, "k.*")


def fold(found: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, str, str, int]]:
    """The greedy merge of one text's spans (ord, start, end, type, text) of equal confidence: (start, end, type, text, merged).

    Spans that overlap lie in one chain of overlaps; each chain is folded by itself, so the work grows with the chains' sizes.
    """
    out: list[list] = []
    chain: list[tuple[int, int, int, str, str]] = []
    reach = -1

    def close() -> None:
        kept: list[list] = []
        for order, s, e, name, t in sorted(chain):
            hit = next((k for k in kept if k[0] < e and s < k[1]), None)
            if hit:
                hit[0], hit[1], hit[4] = min(hit[0], s), max(hit[1], e), hit[4] + 1
            else:
                kept.append([s, e, name, t, 0, order, s])
        out.extend(kept)
        chain.clear()

    for span in sorted(found, key=lambda f: (f[1], f[2])):
        if span[1] >= reach and chain:
            close()
        chain.append(span)
        reach = max(reach, span[2])
    close()
    return [tuple(k[:5]) for k in out]


def _merge_rows(rules: list[tuple[str, str, bool]], clear: bool):
    """Each text with its merged spans; clear: only those that begin where the last one has ended, and the text between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find_all = finders(rules)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("phi_type", pa.string()), ("text", pa.string()), ("merged", pa.int32()), ("value", pa.string()), ("before", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out, rest = batch.slice(at, 500), [], []
                for t in part.column(1).to_pylist():
                    merged = fold([(k, s, e, name, t[s:e]) for k, name, find in find_all for s, e in find(t)]) if t else []
                    last, spans, previous = 0, [], 0
                    for s, e, name, found, n in sorted(merged):
                        if clear and s < previous:
                            previous = e
                            continue
                        spans.append({"start": s, "end": e, "phi_type": name, "text": found, "merged": n, "value": t[s:e], "before": t[last:s] if clear else None})
                        last = previous = e
                    out.append(spans)
                    rest.append(None if t is None else t[last:] if clear else "")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, span), pa.array(rest, pa.string())], names=["key", "spans", "rest"])

    return run


def merge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: list[tuple[str, str, bool]] | None = None, clear: bool = False) -> DataFrame:
    """(key, spans, rest) of every row: detected and merged in one pass, with no shuffle; as merge(detect(docs)) of each row by itself."""
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, spans array<struct<start:int,end:int,phi_type:string,text:string,merged:int,value:string,before:string>>, rest string"
    return rows.mapInArrow(_merge_rows(PATTERNS if patterns is None else patterns, clear), schema).withColumnRenamed("key", key)


def anonymise_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: list[tuple[str, str, bool]] | None = None, mode: str = "intended") -> DataFrame:
    """(key, n_spans, anonymized_text) of every row: as anonymise() of its own detections, without joins; a null text stays null.

    A widened span that begins before its predecessor's end is left as it is.
    """
    rows = merge_documents(docs, key, text, patterns, clear=True)
    parts = F.transform("spans", lambda s: F.concat(s["before"], X.apply_policy(entity(s["phi_type"], mode), s["value"])))
    return rows.select(key, F.size("spans").alias("n_spans"), F.concat(F.array_join(parts, ""), F.col("rest")).alias("anonymized_text"))


def entity(kind: Column, mode: str = "intended") -> Column:
    """Policy entity of an identifier type: by the alias table, or (as_written) its upper-case name."""
    upper = F.upper(kind)
    if mode == "as_written":
        return upper
    out = upper
    for name, alias in ALIASES.items():
        out = F.when(kind == name, alias).otherwise(out)
    return out


def policy_table(spark) -> DataFrame:
    return spark.createDataFrame(POLICIES, "entity string, tier string, operator string, params map<string,string>")


def anonymise(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "intended") -> DataFrame:
    """(key, n_spans, anonymized_text) of every document: merged spans replaced by their policies.

    Widened spans that overlap another one are cut at its start. A null text stays null.
    """
    new = merge(found, key).withColumn("entity", entity(F.col("phi_type"), mode))
    source = docs.select(key, F.col(text).alias("_text"))
    new = new.join(source, key).withColumn("value", F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start")))
    parts = new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", X.apply_policy(F.col("entity"), F.col("value")).alias("new")))).alias("parts"))
    clear = F.filter("parts", lambda p, i: (i == 0) | (F.coalesce(F.get("parts", i - 1)["end"], F.lit(0)) <= p["start"]))
    return source.join(parts, key, "left").select(key, F.coalesce(F.size(clear), F.lit(0)).alias("n_spans"), F.when(F.col("parts").isNull(), F.col("_text")).otherwise(X.rebuild(F.col("_text"), clear)).alias("anonymized_text"))
