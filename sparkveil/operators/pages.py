"""Pages: the rows of one key together, their words and regions as arrays, in one pass over dealt out texts.

Only texts are dealt out, so what moves grows with the input and not with the rows made of its words. A page is one document,
or all documents of one key: their words are then in order of word_id, and of their texts where that is equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 20  # bytes of text that are worked on at once; a page is never parted
ACROSS, DOWN = 80, 12  # characters of a line and its height in pixels

BOX = "x1 int, y1 int, x2 int, y2 int"


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places where a row differs from the one before, the first place included."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def changed_at(begins: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the number of the run that it is in."""
    return np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))


def changed(codes: np.ndarray) -> np.ndarray:
    """The number of the run that each row is in."""
    return changed_at(changes(codes), len(codes))


def codes(keys: pa.Array) -> np.ndarray:
    """Numbers of the keys, equal for equal ones and for nulls."""
    return pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def whole(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the first column's key changes, of `most` at most by the rows' sizes or of a single key."""
    held: list[pa.RecordBatch] = []

    def cut(b: pa.RecordBatch, to: int, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(begins[begins < to][1:], to)
        total, at, before = np.cumsum(size(b)), 0, 0
        while at < to:
            k = max(int(np.searchsorted(total[ends - 1], before + most, "right")) - 1, int(np.searchsorted(ends, at, "right")))
            yield b.slice(at, int(ends[k]) - at)
            at = int(ends[k])
            before = int(total[at - 1])

    for b in batches:
        if not b.num_rows:
            continue
        begins = changes(codes(b.column(0)))
        if held and len(begins) == 1 and held[0].column(0)[0].as_py() == b.column(0)[0].as_py():
            held.append(b)
            continue
        if held:
            b = pa.concat_batches([*held, b])
            begins = changes(codes(b.column(0)))
        last = int(begins[-1])
        yield from cut(b, last, begins)
        held = [b.slice(last)]
    if held:
        b = pa.concat_batches(held)
        yield from cut(b, b.num_rows, np.array([0]))


class Page:
    """Words of the pages of a slice (key, text), in order of page and word_id.

    keys: the pages' keys; row_page: the page of each row; page, word_id, word, start, end, box: by word; first: each page's first word.
    """

    def __init__(self, part: pa.RecordBatch) -> None:
        begins = changes(codes(part.column(0)))
        rows = part.num_rows
        self.keys = part.column(0).take(pa.array(begins))
        self.texts = part.column(1)
        self.row_page = changed(codes(part.column(0)))
        lists = pc.split_pattern(self.texts, " ")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.word = lists.flatten()
        total = int(n.sum())
        row = np.repeat(np.arange(rows), n)
        self.page, self.word_id = self.row_page[row], np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        if len(begins) < rows:
            order = np.lexsort((row, self.word_id, self.page))
            self.page, self.word_id, self.word = self.page[order], self.word_id[order], self.word.take(pa.array(order))
        self.length = pc.utf8_length(self.word).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = changes(self.page)
        place = np.cumsum(self.length + 1) - self.length - 1
        self.start = place - place[self.first][self.page]
        self.end = self.start + self.length
        x, y = self.start % ACROSS * 8, self.start // ACROSS * DOWN
        self.box = (x, y, x + self.length * 8, y + 10)

    def key_of(self, page: np.ndarray) -> pa.Array:
        return self.keys.take(pa.array(page))

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """The pages' keys as numbers, and whether they are there."""
        there = pc.is_valid(self.keys).to_numpy(zero_copy_only=False)
        return pc.fill_null(self.keys, 0).to_numpy(zero_copy_only=False).astype(np.int64), there


def union_boxes(box: tuple[np.ndarray, ...], begins: np.ndarray) -> list[np.ndarray]:
    """Least x1, y1 and greatest x2, y2 of the runs that begin there."""
    return [f.reduceat(c, begins) for f, c in zip((np.minimum, np.minimum, np.maximum, np.maximum), box, strict=True)]


class Regions:
    """Regions of three words of a slice's pages: page, region_id, box, text, first (each page's first region), begins (each region's first word)."""

    def __init__(self, p: Page) -> None:
        region = p.word_id // 3
        self.begins = changes(p.page, region)
        self.page, self.region_id = p.page[self.begins], region[self.begins]
        self.box = union_boxes(p.box, self.begins)
        self.first = changes(self.page)
        self._words = p.word

    def text(self) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(np.append(self.begins, len(self._words)), pa.int32()), self._words)
        return pc.binary_join(lists, " ")


def rest(a: np.ndarray, n: int) -> np.ndarray:
    """Remainder with the sign of the dividend, as SQL has it."""
    return np.fmod(a, n)


def ints(columns) -> list[pa.Array]:
    return [pa.array(c.astype(np.int32)) for c in columns]


def on_pages(docs: DataFrame, make: Callable[[Page], list], columns: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key and the columns) that make gives, as arrays, for the pages of a slice; null texts are left out."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole(batches, lambda b: pc.add(pc.binary_length(b.column(1)), 64).to_numpy(zero_copy_only=False), SLICE):
            yield pa.RecordBatch.from_arrays(make(Page(part)), names=names)

    return rows.repartition("key").sortWithinPartitions("key", "text").mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


def words(p: Page) -> list:
    return [p.key_of(p.page), *ints([p.word_id]), p.word, *ints([p.start, p.end, *p.box])]


def shares(p: Page, page: np.ndarray, number: np.ndarray) -> pa.Array:
    """number mod 100 as hundredths; null where the page's key is."""
    return pa.array(rest(number, 100) / 100.0, pa.float64(), mask=~p.numbers()[1][page])


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' component, given the links a to b."""
    label = np.arange(n)
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (label[label] != label).any():
            label = label[label]


def linked(page: np.ndarray, box: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """The least member of each box's component; boxes of a page are linked where they overlap by `threshold` of the smaller.

    Boxes are held against those that begin above their lower edge, the next one first; a threshold of 0 or less links all that have an area.
    """
    n = len(page)
    x1, y1, x2, y2 = (c.astype(np.int64) for c in box)
    area = (x2 - x1) * (y2 - y1)
    if threshold <= 0:
        some = np.flatnonzero(area > 0)
        first = some[changes(page[some])] if len(some) else some
        return components(n, some, first[np.searchsorted(first, some, "right") - 1])
    order = np.lexsort((y1, page))
    page, x1, y1, x2, y2, area = (c[order] for c in (page, x1, y1, x2, y2, area))
    i, k, links, many = np.arange(n), 0, [], 0
    label = np.arange(n)
    while len(i):
        k += 1
        i = i[i + k < n]
        j = i + k
        near = (page[i] == page[j]) & (y1[j] < y2[i])
        i, j = i[near], j[near]
        inter = np.maximum(0, np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j])) * np.maximum(0, np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]))
        least = np.minimum(area[i], area[j])
        hit = (least > 0) & (inter >= 1)
        hit[hit] = inter[hit] / least[hit] >= threshold
        links.append((order[i[hit]], order[j[hit]]))
        many += int(hit.sum())
        if many > 4 * n:  # links so far as one of each box to its component
            label, many = components(n, *map(np.concatenate, zip(*links, strict=True))), n
            links = [(np.arange(n), label)]
    return components(n, *map(np.concatenate, zip(*links, strict=True))) if links else label


def joined(page: np.ndarray, region_id: np.ndarray, box: tuple[np.ndarray, ...], confidence: np.ndarray, low: np.ndarray, threshold: float) -> tuple:
    """(page, region_id, x1, y1, x2, y2, confidence, low, merged) of the components of regions in order of page and region_id: of the best one, the least of ids among equals."""
    group = linked(page, box, threshold)
    order = np.lexsort((np.arange(len(page)), -confidence, group))
    begins = changes(group[order])
    best = order[begins]
    size = np.diff(np.append(begins, len(order)))
    return page[best], region_id[best], *union_boxes(tuple(c[order] for c in box), begins), confidence[best], np.logical_and.reduceat(low[order], begins), size


def first_true(flag: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its group that is flagged; rows of a group lie together."""
    out = np.zeros(len(flag), bool)
    at = np.flatnonzero(flag)
    if len(at):
        out[at[changes(group[at])]] = True
    return out
