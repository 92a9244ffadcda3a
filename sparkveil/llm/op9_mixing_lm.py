"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token (a word, or the end of a text) is spelled byte by byte, each byte as a path of binary decisions
through a fixed prefix code. Every decision is predicted from four contexts - the last three and
four bytes of the word, the whole word so far, and that with the class of the text (the last very
frequent word) - each hashed into a table of counts. A gate, chosen by how often the two longest
contexts were seen, holds the weights that mix the stretched predictions, and a second table
refines the result adaptively. Bits of probability add up to bits per byte.

A word in a class has one probability, whichever text it stands in. So distinct (word, class) pairs are dealt out by the
word's first four bytes, once: all that contexts of five bytes and more need is then in one place, and their tables
grow with the corpus, a table for each batch of beginnings. A beginning of very many pairs is cut between words that
differ in their first SPLIT bytes, and each piece counts the shorter contexts of the others as well. Contexts of up to four bytes, whose number does
not grow, share tables of fixed size, which are summed over all tasks and sent to them. Weights and
refinement are moved online, part by part, over all training pairs, each occurrence being predicted from the counts of all others;
the weights of all tasks are averaged. Last, every pair's probability is joined with the texts that hold it.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, durable, fold, mix64, release, table, to_signed, worker_cache

GLOBAL_BITS = (20, 22, 22)  # slots for the last three bytes, the last four, and beginnings of up to three with the class
CONTEXTS = 4
EARLY = 4  # bytes of a word that the global tables predict
LONG = 2  # from this context on, the gate looks at how it was seen
CHUNK_BITS = 14
HEAD = 1 << 19  # pairs that go to every task; the others are joined
CLASSES = 32  # very frequent words that name the class of a text
STATES = 6  # how often, and how evenly, a context was seen
GATES = STATES * STATES
BUCKETS = 33
RATE = 0.15  # of the weights' moves, against the size of past ones
STRETCH_WORDS = 500_000  # words whose distinct pairs are dealt out together
PART = 2_500  # distinct pairs that are worked on at once
SPLIT = 6  # bytes of a word by which beginnings of very many pairs are cut
BATCH = 12_000  # distinct pairs of a batch of beginnings, at least
HELD = 300_000  # pairs that a task has beyond its distinct ones, at most, when equal ones become one
DEALS = 3  # parts of the pairs for each partition
SPACE, NEWLINE = 0x20, 0x0A
END_HASH = np.uint64(0xA5A5A5A5DEADBEEF)
#: Bytes from frequent to rare; the others follow in natural order.
FREQUENT = b" enraitosldhucmgpbfvwkzjyxq,.-'\n\xc3\xa9\xa8\xb6\xbc\xa4\xb3\xad\xaa\xa7"


def prefix_code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, node, bit): a Huffman code of the bytes by rank, as paths of inner nodes and turns."""
    order = list(FREQUENT) + [b for b in range(256) if b not in FREQUENT]
    heap = [(1.0 / (rank + 2) ** 1.3, b, (b,)) for rank, b in enumerate(order)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        (wa, ka, a), (wb, kb, b) = heapq.heappop(heap), heapq.heappop(heap)
        for side, members in ((0, a), (1, b)):
            for m in members:
                paths[m].insert(0, (node, side))
        heapq.heappush(heap, (wa + wb, min(ka, kb), a + b))
    length = np.array([len(p) for p in paths])
    return np.cumsum(length) - length, length, np.array([n for p in paths for n, _ in p]), np.array([s for p in paths for _, s in p], dtype=np.float32)


class Speller:
    """Words of a text buffer, their hashes, and the decisions and context slots that spell them."""

    def __init__(self):
        self.start, self.length, self.node, self.bit = prefix_code()
        self.letters = mix64(np.arange(256 * 64, dtype=np.uint64) + np.uint64(99))
        self.nodes = (mix64(np.arange(255, dtype=np.uint64) + np.uint64(12345)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.path_salt = self.nodes[self.node]
        self.classes = mix64(np.arange(CLASSES + 1, dtype=np.uint64) + np.uint64(777))
        self.space = np.zeros(256, dtype=bool)
        self.space[[SPACE, *range(0x09, 0x0E)]] = True

    def sums(self, flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, sum): each byte's place in its word, and the sum of place-dependent letter hashes before it."""
        place = np.arange(len(flat)) - np.repeat(firsts, sizes)
        each = self.letters[(place & 63) << 8 | flat] * ((place >> 6 << 1) + 1).astype(np.uint64)
        total = np.cumsum(each, dtype=np.uint64)
        before = total - each
        return place, before - np.repeat(before[firsts], sizes)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, size, hash, document) of all words of lower-cased texts; starts count in the bytes."""
        flat = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        inside = ~self.space[flat]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        size = end - start
        return flat, start, size, self.hashes(flat, start, size), np.searchsorted(ends, start, side="right")

    def hashes(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hashes that words() gives, of words at start; END_HASH where the size is 0."""
        out = np.full(len(start), END_HASH)
        for i in range(0, len(start), 50_000):  # a few words at a time, for they need many bytes for each letter
            some = i + np.flatnonzero(size[i : i + 50_000])
            if not len(some):
                continue
            n = size[some]
            firsts = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(firsts, n)
            packed = flat[np.repeat(start[some], n) + place]
            each = self.letters[(place & 63) << 8 | packed] * ((place >> 6 << 1) + 1).astype(np.uint64)
            out[some] = mix64(np.add.reduceat(each, firsts) + n.astype(np.uint64))
        return out

    def spell(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, classes: np.ndarray, until: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, bit, contexts, late): for each decision the word's number, the turn, 32 bits of each context's hash, and whether EARLY bytes came before (and fewer than until).

        A word is the bytes at start and a space; size 0 is the end of a text and is spelled as a newline.
        """
        whole = size + 1
        firsts = np.cumsum(whole) - whole
        at = np.repeat(start - firsts, whole) + np.arange(int(whole.sum()))
        chars = flat[np.minimum(at, len(flat) - 1)]
        chars[firsts + size] = np.where(size > 0, SPACE, NEWLINE)
        place, prefix = self.sums(chars, firsts, whole)
        last = np.zeros((4, len(chars)), dtype=np.uint32)
        for k in range(4):
            last[k, k + 1 :] = np.where(place[k + 1 :] > k, chars[: len(chars) - k - 1], 0)
        three = last[0] | last[1] << np.uint32(8) | last[2] << np.uint32(16)
        four = three | last[3] << np.uint32(24)
        prefix = mix64(prefix + place.astype(np.uint64))
        contexts = [three * np.uint32(0x85EBCA6B) ^ np.uint32(0x1234567), four * np.uint32(0xC2B2AE35), prefix.astype(np.uint32), mix64(prefix ^ np.repeat(self.classes[classes], whole)).astype(np.uint32)]
        steps = self.length[chars]
        ends = np.cumsum(steps)
        path = np.repeat(self.start[chars] - (ends - steps), steps) + np.arange(int(ends[-1]) if len(ends) else 0)
        salt = self.path_salt[path]
        out = np.empty((CONTEXTS, len(path)), dtype=np.uint32)
        for i, c in enumerate(contexts):
            h = np.repeat(c, steps)
            h ^= salt
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x85EBCA77)
            out[i] = h
        word = np.repeat(np.arange(len(start)), np.add.reduceat(steps, firsts)) if len(start) else np.zeros(0, np.int64)
        return word, self.bit[path], out, np.repeat(place >= EARLY if until is None else (place >= EARLY) & (place < until), steps)


def speller() -> Speller:
    cache = worker_cache("mixing_lm")
    if "speller" not in cache:
        cache["speller"] = Speller()
    return cache["speller"]


def without_tables() -> None:
    """Gives back the memory of global tables that an earlier step has left in this process."""
    if worker_cache("mixing_lm").pop("tables", None) is not None:
        worker_cache("mixing_lm").pop("tables_of")
        release()


def state(counts: np.ndarray) -> np.ndarray:
    """Of (n, 2) counts: 0 never seen; 1, 2, 3 one turn only, once, up to eight times, more; 4, 5 both turns, up to 32 times, more."""
    n = counts[:, 0] + counts[:, 1]
    one = np.minimum(counts[:, 0], counts[:, 1]) <= 0
    return np.where(one, (n >= 1).astype(np.uint8) + (n >= 2) + (n > 8), 4 + (n > 32)).astype(np.uint8)


def stretched(counts: np.ndarray) -> np.ndarray:
    """ln of the odds of turn 1; counts: (n, 2)."""
    return np.log((counts[:, 1] + np.float32(0.05)) / (counts[:, 0] + np.float32(0.05)))


def start_weights() -> np.ndarray:
    w = np.full((GATES, CONTEXTS + 1), 0.25)
    w[:, CONTEXTS] = 0
    return w


def start_refine() -> np.ndarray:
    """(turns taken, all) by gate and bucket: as if each bucket had shown its own probability."""
    p = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
    return np.stack([np.tile(p * 30, GATES), np.full(GATES * BUCKETS, 30.0)])


def new_tables() -> list[np.ndarray]:
    """Global counts: (slots, 2) for each of GLOBAL_BITS."""
    return [np.zeros((1 << b, 2), dtype=np.float32) for b in GLOBAL_BITS]


def add(counts: np.ndarray, slots: np.ndarray, bit: np.ndarray, times: np.ndarray) -> None:
    np.add.at(counts.reshape(-1), slots.astype(np.int64) * 2 + bit.astype(np.int64), times)


def global_slots(h: np.ndarray) -> list[np.ndarray]:
    return [h[i] >> np.uint32(32 - b) for i, b in ((0, GLOBAL_BITS[0]), (1, GLOBAL_BITS[1]), (3, GLOBAL_BITS[2]))]


def count_globally(tables: list[np.ndarray], bit: np.ndarray, h: np.ndarray, late: np.ndarray, times: np.ndarray) -> None:
    three, four, short = global_slots(h)
    add(tables[0], three, bit, times)
    add(tables[1], four, bit, times)
    early = ~late
    add(tables[2], short[early], bit[early], times[early])


def taken(counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Both turns' counts of each slot as one complex number, which is read at once."""
    return counts.view(np.complex64).reshape(-1).take(slots.astype(np.int64))


class Batch:
    """The pairs of some beginnings of words, with the counts of their contexts of EARLY bytes and more."""

    def __init__(self, body: bytes):
        self.flat, self.size, self.classes, self.times, self.others = unpacked(body)
        self.start = np.cumsum(self.size) - self.size
        self.hashes = speller().hashes(self.flat, self.start, self.size)
        decisions = 5 * (int((self.size + 1)[self.times > 0].sum()) + sum((SPLIT - EARLY) * len(size) for _, size, _, _ in self.others))
        self.bits = min(26, max(10, decisions.bit_length()))
        self.late = np.zeros((1 << self.bits, 2), dtype=np.float32)

    def parts(self, only_training: bool) -> Iterator[tuple]:
        """(numbers of the pairs, spelling) of PART pairs at a time."""
        which = np.flatnonzero(self.times > 0) if only_training else np.arange(len(self.start))
        for i in range(0, len(which), PART):
            part = which[i : i + PART]
            yield part, speller().spell(self.flat, self.start[part], self.size[part], self.classes[part])

    def late_slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint32(32 - self.bits)
        return h[2] >> shift, (h[3] * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995)) >> shift

    def count(self) -> Batch:
        for part, (word, bit, h, late) in self.parts(True):
            times = self.times[part].astype(np.float32)[word]
            for slots in self.late_slots(h):
                add(self.late, slots[late], bit[late], times[late])
        for flat, size, classes, times in self.others:
            start = np.cumsum(size) - size
            for i in range(0, len(size), PART):
                word, bit, h, late = speller().spell(flat, start[i : i + PART], size[i : i + PART], classes[i : i + PART], SPLIT)
                for slots in self.late_slots(h):
                    add(self.late, slots[late], bit[late], times[i : i + PART].astype(np.float32)[word[late]])
        return self

    def inputs(self, tables: list[np.ndarray], bit: np.ndarray, h: np.ndarray, late: np.ndarray, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and gates; `without` (1 or 0) tells which decisions are taken out of the counts they are predicted from."""
        three, four, short = global_slots(h)
        early, late = np.flatnonzero(~late), np.flatnonzero(late)
        first, second = taken(tables[0], three), taken(tables[1], four)
        counts = [first, second, second.copy(), np.empty_like(first)]
        counts[3][early] = taken(tables[2], short[early])
        for i, slots in zip((2, 3), self.late_slots(h), strict=True):
            counts[i][late] = taken(self.late, slots[late])
        x = np.full((CONTEXTS + 1, len(bit)), 0.3, dtype=np.float32)
        seen = []
        own = None if without is None else (without * (1 - bit) + 1j * (without * bit)).astype(np.complex64)
        for i, c in enumerate(counts):
            if own is not None:
                c = c - own
            c = c.view(np.float32).reshape(-1, 2)
            if own is not None:
                np.maximum(c, 0, out=c)
            x[i] = stretched(c)
            if i >= LONG:
                seen.append(state(c))
        return x, seen[0] * np.uint8(STATES) + seen[1]


class Mixer:
    """Weights by gate, and the refining table."""

    def __init__(self, weights: np.ndarray, refine: np.ndarray | None = None):
        self.weights, self.refine = weights.astype(np.float32), refine

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = self.weights[:, CONTEXTS][gate] * x[CONTEXTS]
        for i in range(CONTEXTS):
            out += self.weights[:, i][gate] * x[i]
        return np.clip(out, -12, 12, out=out)

    def bucket(self, gate: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        return gate.astype(np.int32) * BUCKETS + np.rint((np.clip(mixed, -8, 8) + 8) * ((BUCKETS - 1) / 16)).astype(np.int32)

    def log10_chance(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the probability of each turn taken."""
        mixed = self.mix(x, gate)
        p = 1 / (1 + np.exp(-mixed))
        p = 0.5 * p + 0.5 * self.refine[self.bucket(gate, mixed)]
        return np.log10(np.where(bit > 0, p, 1 - p))


class Learner:
    """Weights and refinement of one task, moved online."""

    def __init__(self):
        self.refine, self.mass = start_refine(), 0.0
        self.model = Mixer(start_weights())
        self.squares = np.zeros((GATES, CONTEXTS + 1))

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray) -> None:
        """Predict the decisions, then move the weights of their gates and count how each bucket turned out."""
        mixed = self.model.mix(x, gate)
        b = self.model.bucket(gate, mixed)
        self.refine[0] += np.bincount(b, weights=times * bit, minlength=GATES * BUCKETS)
        self.refine[1] += np.bincount(b, weights=times, minlength=GATES * BUCKETS)
        wrong = times * (bit - 1 / (1 + np.exp(-mixed)))
        mass = np.bincount(gate, weights=times, minlength=GATES)
        pull = np.stack([np.bincount(gate, weights=wrong * x[k], minlength=GATES) for k in range(CONTEXTS + 1)], axis=1) / (mass + 50)[:, None]
        self.squares += pull * pull
        self.model.weights += (RATE * pull / np.sqrt(self.squares + 1e-6)).astype(np.float32)
        self.mass += float(times.sum())


def classes_of(hashes: np.ndarray, doc: np.ndarray, n: int, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word, and of each text's end: the number of the last marker word before it in its text, or 0."""
    if not len(hashes) or not len(markers):
        return np.zeros(len(hashes), np.int64), np.zeros(n, np.int64)
    order = np.argsort(markers)
    at = np.minimum(np.searchsorted(markers[order], hashes), len(markers) - 1)
    is_marker = markers[order][at] == hashes
    mark = np.where(is_marker, order[at] + 1, 0)
    last = np.maximum.accumulate(np.where(is_marker, np.arange(len(hashes)), -1))
    firsts = np.searchsorted(doc, np.arange(n))
    before = np.concatenate(([-1], last[:-1]))
    ends = np.concatenate((firsts[1:], [len(hashes)])) - 1
    final = np.where(ends >= firsts, last[np.maximum(ends, 0)], -1)
    return np.where(before >= firsts[doc], mark[np.maximum(before, 0)], 0), np.where(final >= firsts, mark[np.maximum(final, 0)], 0)


class Stretch:
    """The tokens of some texts as distinct (word, class) pairs; a text's end is a token of size 0."""

    def __init__(self, texts: list[bytes], markers: np.ndarray):
        flat, start, size, hashes, doc = speller().words(texts)
        n = len(texts)
        self.flat = flat if len(flat) else np.zeros(1, np.uint8)
        before, after = classes_of(hashes, doc, n, markers)
        classes = np.concatenate([before, after])
        names = np.concatenate([hashes, np.full(n, END_HASH)])
        self.owner = np.concatenate([doc, np.arange(n)])
        self.keys, first, self.pair, self.times = np.unique(pair_keys(names, classes), return_index=True, return_inverse=True, return_counts=True)
        self.start, self.size = np.concatenate([start, np.zeros(n, np.int64)])[first], np.concatenate([size, np.zeros(n, np.int64)])[first]
        self.classes = classes[first]
        self.sizes = np.bincount(self.owner, minlength=n)


def pair_keys(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return hashes + mix64(classes.astype(np.uint64) + np.uint64(31))


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").lower() if text else b""


def stretches(batches: Iterator[pa.RecordBatch], *names: str, words: int = STRETCH_WORDS):
    """Texts of the batches, about `words` words at a time: the other columns' values, and the lower-cased bytes."""
    others, docs, n = [], [], 0
    for rows in arrow_rows(batches, *names, "text"):
        for *other, text in zip(*rows, strict=True):
            docs.append(lowered(text))
            others.append(other)
            n += len(docs[-1]) + 1
            if n >= 6 * words:
                yield others, docs
                others, docs, n = [], [], 0
    if docs:
        yield others, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    without_tables()
    hashes, counts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(to_signed(hashes)), pa.array(counts), pa.array(np.zeros(len(hashes), bool))], names=["h", "c", "is_end"])

    for _, docs in stretches(batches):
        h, c = np.unique(speller().words(docs)[3], return_counts=True)
        both, at = np.unique(np.concatenate([hashes, h]), return_inverse=True)
        hashes, counts, ends = both, np.bincount(at, weights=np.concatenate([counts, c]), minlength=len(both)).astype(np.int64), ends + len(docs)
        if len(hashes) > 3_000_000:
            yield rows()
            hashes, counts = hashes[:0], counts[:0]
    yield rows()
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([ends], pa.int64()), pa.array([True])], names=["h", "c", "is_end"])


PAIR_SCHEMA = "p int, body binary"


def letters_of(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The letters of the words at start, one after the other."""
    out, at = np.empty(int(size.sum()), dtype=np.uint8), 0
    for i in range(0, len(start), 50_000):
        n = size[i : i + 50_000]
        ends = np.cumsum(n)
        out[at : at + int(ends[-1])] = flat[np.repeat(start[i : i + 50_000] - (ends - n), n) + np.arange(int(ends[-1]))]
        at += int(ends[-1])
    return out


def beginnings(flat: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of each word as a number."""
    out = np.zeros(len(start), dtype=np.uint64)
    for k in range(n):
        out |= np.where(size > k, flat[np.minimum(start + k, len(flat) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


def dealt(flat: np.ndarray, start: np.ndarray, size: np.ndarray, deals: int) -> np.ndarray:
    return ((mix64(beginnings(flat, start, size, EARLY)) >> np.uint64(33)) % np.uint64(deals)).astype(np.int32)


def _pairs(markers, deals: int = 1):
    """Distinct pairs of each stretch, with how often they occur in training texts (0 for other texts), a row for each of the parts they are dealt out to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_tables()
        for others, docs in stretches(batches, "learn"):
            s = Stretch(docs, markers.value)
            learn = np.array([o[0] for o in others], dtype=np.float64)
            times = np.bincount(s.pair, weights=learn[s.owner], minlength=len(s.keys)).astype(np.int64)
            deal = dealt(s.flat, s.start, s.size, deals)
            order = np.argsort(deal, kind="stable")
            size, deal, classes, times = s.size[order], deal[order], s.classes[order].astype("u1"), times[order]
            letters, ends = letters_of(s.flat, s.start[order], size), np.concatenate(([0], np.cumsum(size)))
            edges = np.flatnonzero(np.concatenate(([True], deal[1:] != deal[:-1], [True]))) if len(deal) else np.zeros(1, np.int64)
            size, times = size.astype("<i4"), times.astype("<i4")
            bodies = [pickle.dumps((letters[ends[i] : ends[j]].tobytes(), size[i:j].tobytes(), classes[i:j].tobytes(), times[i:j].tobytes())) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            for i in range(0, len(bodies), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(deal[edges[:-1]][i : i + 1000]), pa.array(bodies[i : i + 1000], pa.binary())], names=["p", "body"])

    return run


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # letters, sizes, classes, times


def merged(pairs: list[Pairs]) -> Pairs:
    """All pairs; equal ones become one."""
    flat, size, classes, times = (np.concatenate(c) for c in zip(*pairs, strict=True))
    start = np.cumsum(size, dtype=np.int64) - size
    _, first, which = np.unique(pair_keys(speller().hashes(flat, start, size), classes), return_index=True, return_inverse=True)
    return letters_of(flat, start[first], size[first]), size[first], classes[first], np.bincount(which, weights=times, minlength=len(first)).astype(np.int64)


def chosen(pairs: Pairs, which: np.ndarray, most: int | None = None) -> Pairs:
    """Some of the pairs, with the first bytes of their words."""
    flat, size, classes, times = pairs
    start = np.cumsum(size, dtype=np.int64) - size
    n = size[which] if most is None else np.minimum(size[which], most)
    return letters_of(flat, start[which], n), n, classes[which], times[which]


def packed(pairs: Pairs, others: list[Pairs]) -> bytes:
    def plain(p: Pairs) -> tuple[bytes, ...]:
        return p[0].tobytes(), p[1].astype("<i4").tobytes(), p[2].astype("u1").tobytes(), p[3].astype("<i8").tobytes()

    return zlib.compress(pickle.dumps((*plain(pairs), [plain(p) for p in others])), 1)


def _arrays(flat: bytes, size: bytes, classes: bytes, times: bytes, kind: str = "<i8") -> Pairs:
    return np.frombuffer(flat, dtype=np.uint8), np.frombuffer(size, "<i4").astype(np.int64), np.frombuffer(classes, "u1").astype(np.int64), np.frombuffer(times, kind)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Pairs]]:
    *own, others = pickle.loads(zlib.decompress(body))
    flat, size, classes, times = _arrays(*own)
    return flat if len(flat) else np.zeros(1, np.uint8), size, classes, times, [_arrays(*o) for o in others]


def cut(pairs: Pairs, batch: int) -> Iterator[bytes]:
    """Bodies of distinct pairs, `batch` or more in each but the last; beginnings of EARLY bytes are cut only if they have two batches or more.

    The pieces of such a beginning are whole beginnings of SPLIT bytes and hold, as `others`, what the other pieces count in shorter contexts.
    """
    flat, size, _, times = pairs
    if not len(size):
        return
    start = np.cumsum(size, dtype=np.int64) - size
    flat = flat if len(flat) else np.zeros(1, np.uint8)
    early, split = beginnings(flat, start, size, EARLY), beginnings(flat, start, size, SPLIT)
    order = np.lexsort((split, early))
    early, split = early[order], split[order]
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], early[1:] != early[:-1]))), [len(early)]))
    since = 0
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if j - i >= 2 * batch:
            if i > since:
                yield packed(chosen(pairs, order[since:i]), [])
            steps = [i]
            for e in (i + 1 + np.flatnonzero(split[i + 1 : j] != split[i : j - 1])).tolist():
                if e - steps[-1] >= batch:
                    steps.append(e)
            pieces = [order[a:b] for a, b in zip(steps, [*steps[1:], j], strict=True)]
            short = [merged([chosen(pairs, p[times[p] > 0], SPLIT)]) if (times[p] > 0).any() else None for p in pieces] if len(pieces) > 1 else [None]
            for k, p in enumerate(pieces):
                yield packed(chosen(pairs, p), [o for m, o in enumerate(short) if m != k and o is not None])
            since = j
        elif j - since >= batch:
            yield packed(chosen(pairs, order[since:j]), [])
            since = j
    if since < len(order):
        yield packed(chosen(pairs, order[since:]), [])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies of each deal's pairs; the rows of a deal follow each other."""
    without_tables()
    held: list[Pairs] = []
    deal, n, distinct = None, 0, 0

    def rows() -> Iterator[pa.RecordBatch]:
        for body in cut(merged(held), BATCH) if held else ():
            yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["body"])

    for deals, bodies in arrow_rows(batches, "p", "body", rows=100):
        for d, body in zip(deals, bodies, strict=True):
            if d != deal:
                yield from rows()
                deal, n, distinct, held = d, 0, 0, []
            held.append(_arrays(*pickle.loads(body), "<i4"))
            n += len(held[-1][1])
            if n >= 2 * distinct + HELD:
                held = [merged(held)]
                n = distinct = len(held[0][1])
    yield from rows()


MODEL_SCHEMA = "chunk int, body binary"


def planes(counts: np.ndarray) -> bytes:
    """The places and values of a chunk's counts other than 0, compressed with equal bytes of all beside each other."""
    flat = np.minimum(np.rint(counts.astype(np.float64)), (1 << 32) - 1).astype("<u4").ravel()
    at = np.flatnonzero(flat)
    step = np.diff(at, prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(np.concatenate([step, flat[at]]).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unplanes(body: bytes) -> np.ndarray:
    """All counts of a chunk."""
    step, value = np.ascontiguousarray(np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(2, -1)
    out = np.zeros(2 << CHUNK_BITS, dtype=np.uint32)
    out[np.cumsum(step)] = value
    return out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The global counts of a task's bodies, by chunk."""
    tables, some = new_tables(), False
    for (bodies,) in arrow_rows(batches, "body"):
        for body in bodies:
            b = Batch(body)
            for part, (word, bit, h, late) in b.parts(True):
                some = True
                count_globally(tables, bit, h, late, b.times[part].astype(np.float32)[word])
    if some:
        chunks, out = [], []
        for k, t in enumerate(tables):
            for i in range(0, len(t), 1 << CHUNK_BITS):
                part = t[i : i + (1 << CHUNK_BITS)]
                if part.any():
                    chunks.append(k << 24 | i >> CHUNK_BITS)
                    out.append(planes(part))
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(out, pa.binary())], names=["chunk", "body"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the bodies of each chunk; the rows of a chunk follow each other."""
    chunk, total = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([planes(total)], pa.binary())], names=["chunk", "body"])

    for chunks, bodies in arrow_rows(batches, "chunk", "body"):
        for c, body in zip(chunks, bodies, strict=True):
            part = unplanes(body).astype(np.float64)
            if c != chunk:
                if chunk is not None:
                    yield done()
                chunk, total = c, part
            else:
                total += part
    if chunk is not None:
        yield done()


def assembled(shared: dict) -> list[np.ndarray]:
    """The global tables from the summed chunks, kept by the process."""
    cache = worker_cache("mixing_lm")
    if cache.get("tables_of") != shared["name"]:
        cache.pop("tables", None)
        tables = new_tables()
        for chunk, body in shared["chunks"]:
            k, i = chunk >> 24, (chunk & 0xFFFFFF) << CHUNK_BITS
            tables[k][i : i + (1 << CHUNK_BITS)] = unplanes(body).reshape(-1, 2)
        cache["tables_of"], cache["tables"] = shared["name"], tables
    return cache["tables"]


def _weights(shared):
    """One row of mass, weights and refinement for each task, moved over all training pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner()
        for (bodies,) in arrow_rows(batches, "body"):
            for body in bodies:
                b = Batch(body).count()
                for part, (word, bit, h, late) in b.parts(True):
                    x, gate = b.inputs(assembled(shared.value), bit, h, late, np.ones(len(bit), np.float32))
                    learner.learn(x, gate, bit, b.times[part].astype(np.float32)[word])
        if learner.mass:
            got = np.concatenate([[learner.mass], (learner.model.weights * learner.mass).ravel(), (learner.refine - start_refine()).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], names=["v"])

    return run


def _chances(shared):
    """(pair, chance, c, times): log10 of each pair's probability, its word's training count and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Mixer(*shared.value["model"])
        for (bodies,) in arrow_rows(batches, "body"):
            for body in bodies:
                b = Batch(body).count()
                chance = np.zeros(len(b.start))
                for part, (word, bit, h, late) in b.parts(False):
                    x, gate = b.inputs(assembled(shared.value), bit, h, late, None)
                    chance[part] = np.bincount(word, weights=model.log10_chance(x, gate, bit), minlength=len(part))
                _, which = np.unique(b.hashes, return_inverse=True)
                c = np.bincount(which, weights=b.times).astype(np.int64)[which]
                yield pa.RecordBatch.from_arrays([pa.array(to_signed(pair_keys(b.hashes, b.classes))), pa.array(chance), pa.array(c), pa.array(b.times)], names=["pair", "chance", "c", "times"])

    return run


ROW = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, logs double, score double, pair long, times int"


def _score(shared):
    """A row for each text, with what the head pairs add up to, and a row for each of its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_tables()
        v = shared.value
        row = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
        names = [f.split()[0] for f in ROW.split(", ")]
        for others, docs in stretches(batches, "doc_id", "held_out"):
            s, n = Stretch(docs, v["markers"]), len(docs)
            at = np.minimum(np.searchsorted(v["keys"], s.keys), max(0, len(v["keys"]) - 1))
            head = v["keys"][at] == s.keys if len(v["keys"]) else np.zeros(len(s.keys), bool)
            of = lambda what, head=head, at=at: np.where(head, v[what][at], 0.0) if len(v["keys"]) else np.zeros(len(head))
            c = of("c")
            sums = [np.bincount(s.owner, weights=each[s.pair], minlength=n) for each in (of("chance"), np.where(head, np.log10(c + 0.5), 0), c > 0)]
            size = np.bincount(s.owner, weights=(s.size + 1)[s.pair], minlength=n).astype(np.int64)
            none = lambda k: [None] * k
            # A text's own row has a pair of its own, so the rows of all texts are dealt out evenly.
            mine = to_signed(mix64(np.arange(row, row + n, dtype=np.uint64)))
            cols = [np.arange(row, row + n), [o[0] for o in others], [o[1] for o in others], s.sizes, size, sums[2].astype(np.int64), sums[1], sums[0], mine, none(n)]
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(cols, kinds, strict=True)], names=names)
            rest = ~head[s.pair]
            if rest.any():
                owner, pair = s.owner[rest], s.pair[rest]
                both, times = np.unique(owner.astype(np.int64) * len(s.keys) + pair, return_counts=True)
                owner, pair, k = both // len(s.keys), both % len(s.keys), len(both)
                for i in range(0, k, 200_000):
                    o, q, m = owner[i : i + 200_000], pair[i : i + 200_000], len(owner[i : i + 200_000])
                    cols = [row + o, none(m), none(m), none(m), none(m), none(m), none(m), none(m), to_signed(s.keys[q]), times[i : i + m]]
                    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(cols, kinds, strict=True)], names=names)
            row += n

    return run


def score(docs: DataFrame, learn: Column, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    Rows that meet `learn` train the model. Tokens are words and one end; a null or empty text has
    the end alone. score: log10 of the probability that the mixed predictors give the whole text;
    bits_per_byte: the same over its words' bytes and a space for each. base_score: the smoothed unigram
    counts' log10. Words are known by a 64-bit hash. Rows are scored one by one, also where
    doc_ids repeat or are null; equal texts have equal scores up to rounding. Without training rows every turn is
    even. A very long text is one stretch of its task. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    counts = durable(rows.where("learn").select("text").mapInArrow(_count, "h long, c long, is_end boolean").groupBy("h", "is_end").agg(F.sum("c").alias("c")), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.sum(F.when(~F.col("is_end"), 1).otherwise(0)).alias("v"), F.sum(F.when(F.col("is_end"), F.col("c")).otherwise(0)).alias("ends")).first()
    total, kinds = sums["n"] or 0, (sums["v"] or 0) + (1 if sums["ends"] else 0)
    top = counts.where(~F.col("is_end")).orderBy(F.col("c").desc(), "h").limit(CLASSES).collect()
    markers = np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = rows.select("learn", "text").mapInArrow(_pairs(spark.sparkContext.broadcast(markers), DEALS * parts), PAIR_SCHEMA)
    bodies = durable(pairs.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_pack, "body binary"), "pairs")
    # Tables of fixed size, whatever the corpus.
    chunks = bodies.mapInArrow(_tables, MODEL_SCHEMA).repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_add, MODEL_SCHEMA)
    model = {"name": uuid.uuid4().hex, "chunks": [(r["chunk"], bytes(r["body"])) for r in durable(chunks, "chunks").toLocalIterator()]}
    weights, refine, mass = np.zeros((GATES, CONTEXTS + 1)), start_refine(), 0.0
    # A row for each task; toLocalIterator() alone would run one task after the other.
    for r in durable(bodies.mapInArrow(_weights(spark.sparkContext.broadcast(model)), "v array<double>"), "weights").toLocalIterator():
        v = np.array(r["v"])
        mass += v[0]
        weights += v[1 : 1 + weights.size].reshape(weights.shape)
        refine += v[1 + weights.size :].reshape(refine.shape)
    model["model"] = (weights / mass if mass else start_weights(), (refine[0] / refine[1]).astype(np.float32))
    chances = durable(bodies.mapInArrow(_chances(spark.sparkContext.broadcast(model)), "pair long, chance double, c long, times long"), "chances")
    n = chances.count()
    least = chances.agg(F.percentile_approx("times", 1 - HEAD / n, 100_000)).first()[0] if n > HEAD else -1  # a count that at most about HEAD pairs exceed
    head = chances.where(F.col("times") > least).toArrow().combine_chunks()
    keys = head["pair"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast({"markers": markers, "keys": keys[order], "chance": head["chance"].to_numpy()[order], "c": head["c"].to_numpy()[order].astype(np.float64)})
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(_score(shared), ROW)
    scored = scored.join(chances.where(F.col("times") <= least).select("pair", "chance", F.col("c").alias("count")), "pair", "left")
    base = float(np.log10(total + 0.5 * (kinds + 1)))
    own, sum_ = F.col("times").isNull(), lambda c: F.sum(F.when(F.col("times").isNull(), F.lit(0)).otherwise(c))
    each = scored.groupBy("row").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "logs", "score")],
        sum_(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("known"), sum_(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + 0.5)).alias("rest"), sum_(F.col("times") * F.coalesce("chance", F.lit(0.0))).alias("more"),
    )
    score_ = F.col("score") + F.coalesce("more", F.lit(0.0))
    return each.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"), score_.alias("score"), (-score_ * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op9_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold("doc_id", 5)
    return score(table(spark, sf_dir, "documents"), part != 1, part == 1)
