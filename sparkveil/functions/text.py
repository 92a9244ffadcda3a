"""Scalar building blocks over text, spans and boxes, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ABBREVIATIONS, DETECTOR_CONFIDENCE, POLICIES, THRESHOLD, THRESHOLDS


def pattern(regex: str, ignore_case: bool = False) -> str:
    """Unicode-aware word boundaries, whatever the JDK's default is."""
    return ("(?iU)" if ignore_case else "(?U)") + regex


def spans(text: Column, regex: str) -> Column:
    """Array of (start, end, text) of the leftmost matches that do not overlap; code points, end excluded."""
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    walked = F.aggregate(
        F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        zero,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("start"), (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("text")))).alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, walked["out"]).otherwise(zero["out"])


def context_score(kind: Column, context: Column) -> Column:
    """0 without context; 0.5, 0.3 more beside a clinical word, 0.2 more for names beside a title; 1 at most."""
    low = F.lower(context)
    near = lambda *words: F.greatest(*[low.contains(w) for w in words]) if len(words) > 1 else low.contains(words[0])
    base = 0.5 + F.when(near("patient", "mrn", "dob", "ssn"), 0.3).otherwise(0.0) + F.when((kind == "names") & near("dr.", "nurse", "physician", "md"), 0.2).otherwise(0.0)
    return F.when(F.coalesce(context, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), base))


def detection_confidence(base: Column, size: Column, context: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 * base + F.least(F.lit(0.3), size / 100.0) + 0.2 * context)


def combined_confidence(detection: Column, context: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 * detection + 0.3 * context)


def threshold_of(kind: Column) -> Column:
    out = F.lit(THRESHOLD)
    for name, value in THRESHOLDS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def mask_digits(value: Column, char: str, n: int, from_end: bool) -> Column:
    """Digits of a value masked, n at most, from the end or the start; without digits its first n characters are."""
    if from_end:
        digits = F.regexp_replace(value, rf"[0-9](?=(?:[^0-9]*[0-9]){{0,{n - 1}}}[^0-9]*$)", char)
    else:
        digits = F.aggregate(
            F.split(value, ""), F.struct(F.lit(0).alias("k"), F.lit("").alias("s")),
            lambda a, c: F.struct((a["k"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("k"), F.concat(a["s"], F.when(c.rlike("^[0-9]$") & (a["k"] < n), char).otherwise(c)).alias("s")),
        )["s"]
    plain = F.concat(F.repeat(F.lit(char), F.least(F.length(value), F.lit(n))), F.substring(value, n + 1, 1 << 30))
    return F.when(value.rlike("[0-9]"), digits).otherwise(plain)


def apply_policy(entity: Column, value: Column) -> Column:
    """The replacement of a value by its entity's policy; without one, [REDACTED_<ENTITY>]."""
    out = F.concat(F.lit("[REDACTED_"), F.upper(entity), F.lit("]"))
    for name, _, operator, p in POLICIES:
        new = mask_digits(value, p["masking_char"], int(p["chars_to_mask"]), p["from_end"] == "true") if operator == "mask" else F.lit(p["new_value"])
        out = F.when(entity == name, new).otherwise(out)
    return out


def rebuild(text: Column, parts: Column) -> Column:
    """Text with each span (start, end, new) of an array sorted by start replaced; spans must not overlap."""
    walked = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["new"]).alias("out")),
    )
    return F.concat(walked["out"], F.substr(text, walked["at"] + 1, F.length(text)))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def email_partial(value: Column) -> Column:
    return F.regexp_replace(value, r"^(.)([^@]*)@(.+)$", "$1***@$3")


def truncated(text: Column, n: int = 120) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def overlap_of_smaller(a: list[Column], b: list[Column]) -> Column:
    """Area of the intersection of boxes (x1, y1, x2, y2) over the smaller box's area, 0 for empty ones."""
    inter = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    least = F.least(area(a), area(b))
    return F.when(least > 0, inter / least).otherwise(0.0)


# Types that a text is classified by, the first that finds something, and their confidences.
CLASSES = [("social_security_numbers", 0.99), ("email_addresses", 0.98), ("phone_numbers", 0.95), ("urls", 0.9), ("ip_addresses", 0.9), ("medical_record_numbers", 0.98), ("device_identifiers", 0.85), ("full_face_photos", 0.6)]


def classify(text: Column) -> Column:
    """Type of a text by the first rule that finds something in it, as `type|confidence`."""
    from .rules import PATTERNS

    rule = {name: pattern(p, i) for name, p, i in PATTERNS}
    out = F.lit("other|0.4")
    for name, c in reversed(CLASSES):
        out = F.when(text.rlike(rule[name]), f"{name}|{c}").otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "other|0.0").otherwise(out)


def typed_confidence(kind: Column, value: Column) -> Column:
    """Confidence of the detector of a single type."""
    out = F.when(kind == "medical_record_numbers", F.when(value.rlike("^[0-9A-Za-z-]{6,12}$"), 0.95).otherwise(0.6))
    out = out.when(kind == "social_security_numbers", F.when(value.rlike("^0{3}-0{2}-0{4}"), 0.5).otherwise(0.99))
    out = out.when(kind == "dates", F.when(value.rlike(pattern(r"\b(?:19|20)\d{2}\b")) & (F.length(value) >= 8), 0.95).otherwise(0.9))
    for name, c in DETECTOR_CONFIDENCE.items():
        out = out.when(kind == name, c)
    return out


def clinical_text(text: Column) -> Column:
    """Common misreadings mended (a nought beside letters, a one, a curly apostrophe), white space collapsed, abbreviations written out."""
    mended = F.replace(F.replace(F.when(text.rlike("\\p{L}"), F.replace(text, F.lit("0"), F.lit("O"))).otherwise(text), F.lit("1"), F.lit("I")), F.lit("\u2019"), F.lit("'"))
    words = F.filter(F.split(mended, r"\s+"), lambda w: w != "")
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(full, F.upper(w)), w)), " ")


def distinct_words(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.btrim(F.lower(w), F.lit(".,;:'\"()"))))
