"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists.

1. Prefixes. Two linked sets of sizes a and b share at least T = ceil(percent * max(a, b) / 100) shingles. In the order of
   their hashes, the first a - T(a) + l shingles of the one and b - T(b) + l of the other have l in common at least.
   Only these prefixes are dealt out as (token, node); l is as large as what they must hold anyway, so
   a set stays in only while a good part of its prefix is shared with others, however common its passages are.
2. Families. A token that several sets share is an inverted list; lists of the same sets are one. Each set goes, with a
   sketch of about a bit for each shingle, to so many of its shortest lists that two linked sets meet in one of them. Sketches
   tell how many shingles two sets differ in at least, so most pairs that are not linked part there, and no linked pair does. What
   is left of the pairs joins sets into families.
3. Search. Each text goes to its family once and each set is searched for there: the long lists of the group's index
   are set aside, the short ones are merged, and sets that occur often enough there are looked up in the long lists by
   binary search. Families of very many sets are cut into blocks; a few leaders go to all of their blocks, and what
   different components have still in common by their sketches is searched for in pairs of blocks, so no link is missed.

Documents with equal sets are one node from the start, and only one of their texts is read again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, arrow_rows, bloom_joins, durable, mix64, shingle_set, table, to_signed, worker_cache, words_of
from .components import components

BLOCK = 2048  # sets that one task indexes and queries together, times two
BLOCK_SHINGLES = 2_000_000  # and their shingles
SKETCHES = 4  # times as many sets are compared by their sketches together
SKETCH_BITS = 1 << 16  # of a sketch at most
LEADERS = 32  # sets of a family of several blocks that go to each of them, about
NAMES = ["doc_id", "place", "n_shingles", "node", "token", "row", "sketch"]
_FEW = 24  # sketches that are compared one by one; more are compared by numpy
_WORDS = 1 << 20  # of sketches that are compared at once
_SEEN = 200_000  # sets that a task remembers to have dealt out
_HEAP = 256  # entries that are merged by a heap; more are merged as sorted runs by numpy


def _hashes() -> WordHashes:
    return worker_cache("words").setdefault("words", WordHashes())


def shared(n: int, percent: int) -> int:
    """l of a set of size n: tokens that its prefix has beyond the shortest one."""
    return max(1, n * (100 - percent) // 200)


def prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set; two linked sets have at least the smaller of their l in common there."""
    n = len(s)
    return s[: n - -(-n * percent // 100) + shared(n, percent)]


def enough(size: Column, percent: int) -> Column:
    """Open lists that a set needs to have a link: l of the smallest set that it can be linked with."""
    least = F.ceil(size * percent / 100)
    return F.greatest(F.lit(1), F.floor(least * (100 - percent) / 200)).cast("long")


def set_key(s: np.ndarray) -> int:
    return int(mix64(np.array([np.sum(mix64(s + np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64) + np.uint64(len(s))]))[0])


def _signed_key(s: np.ndarray) -> int:
    return int(np.uint64(set_key(s)).astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """A bit for each place, a power of two of them and as many as the set has shingles: whether an odd number of these fall there.

    Sketches of two sets differ in as many bits at most as the sets in shingles, also when the longer one is folded.
    """
    bits = min(SKETCH_BITS, max(64, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sign(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _hashes()
        seen: set[int] = set()
        for doc_ids, places, texts, rows in arrow_rows(batches, "doc_id", "place", "text", "row"):
            sizes, keys, tokens, owners, sketches = [], [], [], [], []
            for text in texts:
                s = shingle_set(words_of(text), n, cache)
                key = _signed_key(s) if len(s) else None
                sizes.append(len(s))
                keys.append(key)
                new = key is not None and key not in seen
                sketches.append(sketch(s) if new else None)
                if new:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    tokens.append(prefix(s, percent))
                    owners.append(np.full(len(tokens[-1]), key, dtype=np.int64))
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), none(len(sizes), pa.int64()), pa.array(rows, pa.int64()), pa.array(sketches, pa.binary())], names=NAMES)
            if tokens:
                token, own = np.concatenate(tokens), np.concatenate(owners)
                k = len(token)
                yield pa.RecordBatch.from_arrays([none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int64()), pa.array(own), pa.array(to_signed(token)), none(k, pa.int64()), none(k, pa.binary())], names=NAMES)

    return run


def needed(a: int, b: int, percent: int) -> int:
    """Least intersection of two sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class Index:
    """Inverted lists over sorted sets: list of a shingle = numbers of the sets that hold it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.end = np.append(self.first[1:], len(flat))

    def merge(self, lists: np.ndarray) -> np.ndarray:
        """All entries of the lists in ascending order."""
        runs = [self.owner[self.first[i] : self.end[i]] for i in lists]
        if sum(map(len, runs)) <= _HEAP:
            return np.fromiter(heapq.merge(*[r.tolist() for r in runs]), dtype=np.int64)
        return np.sort(np.concatenate(runs), kind="stable")

    def search(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the indexed sets linked with s (DivideSkip)."""
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        least = needed(len(s), -(-percent * len(s) // 100), percent)  # over all sizes that can be linked
        if len(at) < least or not len(at):
            return np.empty(0, np.int64)
        at = at[np.argsort((self.end - self.first)[at], kind="stable")]
        # Lists set aside: as many of the longest as leave sets that must still occur once in the rest.
        n_long = min(len(at), max(0, least - 1))
        short, long_ = at[: len(at) - n_long], at[len(at) - n_long :]
        found, counts = np.unique(self.merge(short), return_counts=True)
        t = -(-percent * (len(s) + self.sizes[found]) // (100 + percent))
        ok = (100 * np.minimum(len(s), self.sizes[found]) >= percent * np.maximum(len(s), self.sizes[found])) & (counts + n_long >= t)
        found, counts, t = found[ok], counts[ok], t[ok]
        for done, i in enumerate(long_):
            if done % 16 == 0:
                ok = counts + (n_long - done) >= t
                found, counts, t = found[ok], counts[ok], t[ok]
                if not len(found):
                    break
            if len(found) <= 4:  # for few sets, their own sorted shingles are probed with all that is left at once
                counts = counts + np.array([np.isin(self.keys[long_[done:]], self.sets[j], assume_unique=True).sum() for j in found])
                break
            run = self.owner[self.first[i] : self.end[i]]
            place = np.minimum(np.searchsorted(run, found), len(run) - 1)
            counts = counts + (run[place] == found)
        return found[counts >= t]


def links(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct sets.

    Every set outside the largest component is searched for among all, which finds each link between different components.
    """
    index, out = Index(sets), []
    parent, size = list(range(len(nodes))), [1] * len(nodes)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    largest, todo = 0, list(range(len(nodes)))
    while todo:
        left = []
        for i in todo:
            if size[root(largest)] > 1 and root(i) == root(largest):
                left.append(i)  # it need not be searched for while it is in the largest component
                continue
            for j in index.search(sets[i], percent).tolist():
                a, b = root(i), root(j)
                if a != b:
                    a, b = (a, b) if size[a] >= size[b] else (b, a)
                    parent[b] = a
                    size[a] += size[b]
                    out.append((nodes[i], nodes[j]))
            if size[root(i)] > size[root(largest)]:
                largest = i
        top = root(largest)
        todo = [i for i in left if root(i) != top]  # another component has become the largest since
    return out


def _alike_few(sizes: list[int], sketches: list[bytes], parts: list[int], percent: int) -> list[tuple[int, int]]:
    out, label = [], list(range(len(sizes)))
    bits, numbers = [8 * len(x) for x in sketches], [int.from_bytes(x, "little") for x in sketches]
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            need = needed(sizes[i], sizes[j], percent)
            if label[i] == label[j] or parts[i] == parts[j] or min(sizes[i], sizes[j]) < need:
                continue
            both, m = numbers[i] ^ numbers[j], max(bits[i], bits[j])
            while m > min(bits[i], bits[j]):
                m //= 2
                both = both >> m ^ both & (1 << m) - 1
            if (sizes[i] + sizes[j] - both.bit_count()) // 2 >= need:
                out.append((i, j))
                old, new = label[j], label[i]
                label = [new if x == old else x for x in label]
    return out


def alike(sizes: list[int], sketches: list[bytes], parts: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as numbers, of the pairs of sets of different parts that may be linked by what their sketches tell."""
    if len(sizes) <= _FEW:
        return _alike_few(sizes, sketches, parts, percent)
    order = sorted(range(len(sizes)), key=lambda i: (len(sketches[i]), sizes[i]))
    size, part = np.array([sizes[i] for i in order], dtype=np.int64), np.array([parts[i] for i in order], dtype=np.int64)
    words = np.array([len(sketches[i]) // 8 for i in order])
    out, label = [], np.arange(len(order))
    for m in np.unique(words).tolist():
        first, end = np.searchsorted(words, m), np.searchsorted(words, m, side="right")
        last = end + np.searchsorted(size[end:], size[end - 1] * 100 // percent, side="right") if words[-1] > m else end
        folded = np.empty((last - first, m), dtype=np.uint64)
        for k in range(first, last):
            folded[k - first] = np.bitwise_xor.reduce(np.frombuffer(sketches[order[k]], dtype="<u8").reshape(-1, m), axis=0)
        step = max(1, _WORDS // (m * (last - first)))
        for i in range(first, end, step):
            rows = np.arange(i, min(end, i + step))
            total = size[rows][:, None] + size[None, i:last]
            need = -(-percent * total // (100 + percent))
            differ = np.bitwise_count(folded[rows - first][:, None, :] ^ folded[None, i - first :, :]).sum(axis=2, dtype=np.int64)
            ok = ((total - differ) // 2 >= need) & (np.minimum(size[rows][:, None], size[None, i:last]) >= need) & (part[rows][:, None] != part[None, i:last])
            for k in rows.tolist():
                found = i + np.flatnonzero(ok[k - i])
                found = found[label[found] != label[k]]
                if len(found):
                    others, at = np.unique(label[found], return_index=True)
                    out += [(order[k], order[j]) for j in found[at].tolist()]
                    label[np.isin(label, others)] = label[k]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str], item) -> Iterator[dict]:
    """The items by node of each group (token, low, high) of two nodes or more; the rows of a group follow each other."""
    held, group = {}, None
    for tokens, lows, highs, nodes, *others in arrow_rows(batches, "token", "low", "high", "node", *names):
        for token, low, high, node, *other in zip(tokens, lows, highs, nodes, *others, strict=True):
            if (token, low, high) != group:
                if len(held) > 1:
                    yield held
                held, group = {}, (token, low, high)
            if node not in held and (value := item(node, *other)) is not None:
                held[node] = value
    if len(held) > 1:
        yield held


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for held in _grouped(batches, ["size", "part", "sketch"], lambda node, *item: item):
            nodes, (sizes, parts, sketches) = list(held), zip(*held.values(), strict=True)
            out += [(nodes[i], nodes[j]) for i, j in alike(list(sizes), list(sketches), list(parts), percent)]
            if len(out) >= 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _link(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _hashes()

        def shingles(node: int, text: str) -> np.ndarray | None:
            s = shingle_set(words_of(text), n, cache)
            return s if len(s) and _signed_key(s) == node else None  # rows that share a doc_id may have other texts

        for held in _grouped(batches, ["text"], shingles):
            yield _pairs(links(list(held), list(held.values()), percent))

    return run


def _open(held: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(token, node, size, n, weight, has): the lists (n sets each) of the sets that have enough of them.

    Lists of the same sets are one, of their summed weight; has: the weight of all lists of a set.
    """
    rows = held.join(sizes.select("node", "size"), "node")
    names = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"s{k}") for k in (1, 2)]
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *names).where("n > 1")
    lists = lists.groupBy("n", "s1", "s2").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight"))
    rows = rows.join(lists.select("token", "n", "weight"), "token")
    kept = rows.groupBy("node").agg(F.sum("weight").alias("has"), F.first("size").alias("of")).where(F.col("has") >= enough(F.col("of"), percent))
    return rows.join(kept.select("node", "has"), "node").select("token", "node", "size", "n", "weight", "has")


def _shortest(lists: DataFrame, percent: int) -> DataFrame:
    """(token, node, size) of so many of each set's shortest lists that two linked sets meet in the first of those they share."""
    rarer = F.coalesce(F.sum("weight").over(Window.partitionBy("node").orderBy("n", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lists.withColumn("rarer", rarer).where(F.col("rarer") <= F.col("has") - enough(F.col("size"), percent)).select("token", "node", "size")


def _blocks(members: DataFrame, block: int, shingles: int) -> DataFrame:
    """members (token, node, size, ...) of groups with two sets or more, with `blocks`, into how many their group is cut, and `own`, theirs."""
    cut = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / shingles)).cast("int").alias("blocks")
    own = F.pmod(F.xxhash64(F.lit(0), "node"), F.col("blocks")).cast("int")
    return members.join(members.groupBy("token").agg(cut, F.count(F.lit(1)).alias("sets")).where("sets > 1"), "token").withColumn("own", own)


def _in_pairs(members: DataFrame) -> DataFrame:
    """Each member once for each pair of blocks (low, high) that its own is of."""
    rows = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def _with_leaders(members: DataFrame) -> DataFrame:
    """Each member in its own block, some in all blocks of the group."""
    leader = F.pmod(F.xxhash64(F.lit("leader"), "node"), F.ceil(F.col("sets") / LEADERS)) == 0
    rows = members.withColumn("low", F.explode(F.when(leader, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    return rows.withColumn("high", F.col("low"))


def _found(rows: DataFrame, run, name: str) -> DataFrame:
    """Pairs (a, b) that run finds inside each group (token, low, high) of rows."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "token", "low", "high").sortWithinPartitions("token", "low", "high")
    return durable(rows.mapInArrow(run, "a long, b long"), name)


def _families(lists: DataFrame, sketches: DataFrame, percent: int, block: int) -> DataFrame:
    """(token, node): families of sets of different parts that may be linked by what their sketches tell. lists: (token, node, size, part)."""
    groups = _in_pairs(_blocks(lists, SKETCHES * block, SKETCHES * BLOCK_SHINGLES)).select("token", "low", "high", "node", "size", "part")
    return components(_found(groups.join(sketches, "node"), _alike(percent), "alike"), "a", "b").select(F.col("component").alias("token"), "node")


def linked(held: DataFrame, texts: DataFrame, sketches: DataFrame, sizes: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(node, component) of nodes with links. held: (token, node), texts: (place, text), sketches: (node, sketch), sizes: (node, place, size)."""
    spark = held.sparkSession
    lists = durable(_shortest(durable(_open(held, sizes, percent), "open"), percent), "lists")

    def search(groups: DataFrame) -> DataFrame:
        groups = durable(groups.select("token", "low", "high", "node", "size").join(sizes.select("node", "place"), "node"), "groups")
        with bloom_joins(spark):  # a text that no set is asked of need not be dealt out
            asked = texts.join(groups.where("size > 0").select("place", "token", "low", "high", "node"), "place")
            return _found(asked.select("token", "low", "high", "node", "text"), _link(n, percent), "links")

    def members(families: DataFrame) -> DataFrame:
        return durable(_blocks(families.join(sizes.select("node", "size"), "node"), block, BLOCK_SHINGLES), "members")

    whole = members(_families(lists.withColumn("part", F.col("node")), sketches, percent, block))
    found = search(_with_leaders(whole))
    joined = components(found, "a", "b")
    large = whole.where("blocks > 1").select("node")
    if large.limit(1).count() == 0:
        return joined
    # The blocks of a large family have met by their leaders alone.
    parts = large.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    rest = members(_families(lists.join(parts, "node"), sketches, percent, block))
    return components(found.union(search(_in_pairs(rest))), "a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    A row's set: distinct n-word shingles of its lower-cased text; with fewer words, the whole
    sequence as one; without words, or with a null text, empty, and linked with nothing. Rows link when
    100 * intersection >= percent * union; component_id is the least doc_id reachable. Rows with a
    null doc_id take part in links but name no component: where a component has no other row, component_id is
    null. Rows that share a doc_id are documents of their own with that name. Shingles are compared
    by 64-bit hashes. Other columns are ignored; an empty table gives no rows.

    row names a column of docs that numbers its rows (long). The result then has it too, and `least`: whether the row is the
    one of least (doc_id, row) in its component, a null doc_id last. A row without words is a component of its own.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("place"), "text", (F.lit(None) if row is None else F.col(row)).cast("long").alias("row"))
    signed = durable(rows.mapInArrow(_sign(n, percent), "doc_id long, place long, n_shingles long, node long, token long, row long, sketch binary"), "prefixes")
    plain = signed.where("token is null").select("doc_id", "place", "n_shingles", "node", "row")
    tokens = signed.where("token is not null").select("token", "node")
    common = tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    common = durable(common.select("token", F.lit(2).alias("least")), "common")
    with bloom_joins(docs.sparkSession):  # tokens of one set need not be dealt out again
        held = durable(tokens.join(common.where("least > 1").select("token"), "token", "left_semi").distinct(), "held")
    has = held.groupBy("node").agg(F.count(F.lit(1)).alias("has"))
    reps = plain.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"), F.max("n_shingles").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    sizes = durable(reps.join(has, "node").where(F.col("has") >= enough(F.col("size"), percent)).select("node", "place", "size"), "sizes")
    sketches = durable(signed.where("sketch is not null").select("node", "sketch").join(sizes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sketches")
    joined = linked(held, rows.select("place", "text"), sketches, sizes, n, percent, block)
    least = joined.join(reps, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("least"))
    named = reps.join(joined, "node", "left").join(least, "component", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("least", "first")["row"].alias("least"))
    more = [] if row is None else [F.col("row").alias(row), (F.col("row") == F.col("least")).alias("least")]
    with_words = plain.where("node is not null").join(named, "node").select("doc_id", "n_shingles", "component_id", *more)
    return with_words.union(plain.where("node is null").withColumn("least", F.col("row")).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *more))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT a AS doc_id, b AS other FROM p UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id) m USING (doc_id)
"""
