"""Rectangle algebra over struct<x1,y1,x2,y2> columns, as Catalyst expressions; boxes are half open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    names = ("x1", "y1", "x2", "y2")
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v) if isinstance(v, int) else F.col(v)).cast("int").alias(n) for v, n in zip((x1, y1, x2, y2), names, strict=True)])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    return F.greatest(F.lit(0), width) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union has no area."""
    inter = intersection(a, b)
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def expand(b: Column, pixels: Column | int, width: Column | int | None = None, height: Column | int | None = None) -> Column:
    """The box grown on all sides, cut at the image's edges where they are given."""
    p = F.lit(pixels) if isinstance(pixels, int) else pixels
    out = [b["x1"] - p, b["y1"] - p, b["x2"] + p, b["y2"] + p]
    if width is not None:
        w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
        out = [F.greatest(F.lit(0), out[0]), F.greatest(F.lit(0), out[1]), F.least(w, out[2]), F.least(h, out[3])]
    return box(*out)


def union(boxes: Column) -> Column:
    """(least x1, y1, greatest x2, y2) of an array of boxes; null for an empty one."""
    pick = lambda n, f: f(F.transform(boxes, lambda b: b[n]))
    return F.when(F.size(boxes) > 0, box(pick("x1", F.array_min), pick("y1", F.array_min), pick("x2", F.array_max), pick("y2", F.array_max)))


def diagnosis(b: Column) -> Column:
    """Why a box cannot be masked: invalid_bbox where a side is missing, zero_area, or null."""
    missing = reduce(lambda x, y: x | y, [b[n].isNull() for n in ("x1", "y1", "x2", "y2")])
    return F.when(b.isNull() | missing, "invalid_bbox").when((b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"]), "zero_area")


def font_expansion(b: Column) -> Column:
    """Pixels by which a mask grows with the size of its letters: three tenths of the height, 8 at least."""
    return F.greatest(F.lit(8), F.floor((b["y2"] - b["y1"]) * 0.3).cast("int"))


def mask_rectangles(words: Column, region: Column, pixels: Column | int, width, height) -> Column:
    """Rectangles of a mask: the grown word boxes, else the grown region; those without area are left out."""
    all_ = F.when(F.size(words) > 0, words).otherwise(F.array(region))
    return F.filter(F.transform(all_, lambda b: expand(b, pixels, width, height)), lambda b: (b["x1"] < b["x2"]) & (b["y1"] < b["y2"]))


def surgical_rectangles(words: Column, region: Column, text: Column, pad: Column | int, width, height, merge_entity: bool = True) -> Column:
    """Narrow rectangles: over all words of the entity at once or one by one; of a label with a colon only the part from 40 percent of its width on."""
    split = region["x1"] + F.floor((region["x2"] - region["x1"]) * 0.4).cast("int")
    value = box(split, region["y1"], region["x2"], region["y2"])
    whole = F.when(F.coalesce(text, F.lit("")).contains(":"), value).otherwise(region)
    found = F.when(F.size(words) > 0, F.array(union(words)) if merge_entity else words).otherwise(F.array(whole))
    return F.transform(found, lambda b: expand(b, pad, width, height))


def covered_area(boxes: Column) -> Column:
    """Area of the union of an array of boxes, by the columns between neighbouring x and the merged y inside each.

    Exact; the work grows with the square of the number of boxes of one image.
    """
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(b["x1"], b["x2"])))))
    pairs = F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def column(p: Column) -> Column:
        inside = F.filter(boxes, lambda b: (b["x1"] <= p["a"]) & (b["x2"] >= p["b"]) & (b["y2"] > b["y1"]))
        rows = F.array_sort(F.transform(inside, lambda b: F.struct(b["y1"].alias("a"), b["y2"].alias("b"))))
        start = F.struct(F.lit(-(1 << 31)).cast("int").alias("top"), F.lit(0).cast("long").alias("sum"))
        step = lambda s, r: F.struct(F.greatest(s["top"], r["b"]).alias("top"), (s["sum"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["top"])).cast("long")).alias("sum"))
        return F.aggregate(rows, start, step)["sum"] * (p["b"] - p["a"])

    return F.aggregate(F.transform(pairs, column), F.lit(0).cast("long"), lambda s, v: s + v)


def inpainting_method(fraction: Column) -> Column:
    return F.when(fraction < 0.01, "telea").when(fraction > 0.1, "ns").otherwise("hybrid")
