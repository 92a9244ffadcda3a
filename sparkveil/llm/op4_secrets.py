"""Secret scans: a random forest drops the false positives among long tokens.

A finding is described by its length, its character classes, how usual its character transitions are in the texts at
hand, its entropy, how much of it dictionary words cover, its document's path and the words beside it. Transitions are counted
over all documents. The forest is grown from labelled findings, a table or a list of (before, value, after, path, label);
`example_findings` and `more_findings` make such a set by rule where a caller has none.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table, worker_cache

#: Runs that may hide a secret: 12 characters of keys at least.
RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
PEM_END = re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")
KINDS = (("private_key", re.compile(r"-----BEGIN")), ("access_key_id", re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$")), ("prefixed_token", re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ)")), ("hex", re.compile(r"[0-9a-f]+$|[0-9A-F]+$")))
GOOD = re.compile(r"token|secret|passw|pwd|credential|api[_-]?key|apikey|access|private|auth|bearer|\bkey\b", re.I)
#: Values of any characters, shorter ones too, that are assigned to such a word, or that it is said to be; and passwords of addresses.
VALUE = re.compile(r"(?:token|secret|passw|pwd|credential|api[_-]?key|apikey|access|private|auth|bearer|\bkey\b)[\w\-]{0,30}[\"']?(?:\s{0,3}(?:=>|:=|[=:])|\s{1,3}is:?(?=\s))\s{0,3}(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"'<>,;]{4,}))", re.I)
LOGIN = re.compile(r"://[^\s:/@\"']{0,200}:([^\s@/\"']{1,200})@")
BAD = re.compile(r"sha\d*|commit|checksum|digest|uuid|guid|md5|\bhash|example|sample|dummy|placeholder|version|isbn|order|invoice|card|phone|tracking|revision|etag", re.I)
TEST_PATH = re.compile(r"test|example|fixture|mock|sample|docs?\b", re.I)
ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
DICTIONARY = (
    "access account action admin alpha amount android animal apple application array attribute background base binary block board body book border branch build button cache call center chain change char check class client clock cloud "
    "code color column common config connection constant content context control copy core count create current data date default delete demo description design detail device dict display document domain down edit element empty enable end "
    "error event example export extension field file filter final first folder format frame function global graph group handle hash head height hello home host html http image import index info input install instance item java json "
    "label language left length level library license line link list local login main manager message method middle mobile model module month name network node number object offset order output package page parameter password "
    "path phone pixel placeholder please point print private process product profile project property public python query random range read record region release remote request reset resource response result return right root sample schema script search secret section server "
    "service session set size socket sort source stack start state static status step storage store stream string style summary switch system table target task template temp test text theme time title token tool total tree type unit update upload user value variable version view web width window word world write year your"
).split()
WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)), re.I)
Findings = list[tuple[str, str, str, str, int]]  # (before, value, after, path, label)
FEATURES = 18
MAX_FINDINGS = 50_000  # labelled findings of a table that the forest is grown from, drawn by hash
PRIOR = 1000
PIECE = 1 << 21  # bytes of text whose transitions are counted together
BESIDE = 40  # characters before and after that are looked at


#: Classes of bytes: 0 white space, one for each letter of either case, digit and sign of keys, one for the rest of ASCII, one beyond it.
KEY_SIGNS = string.ascii_letters + string.digits + "_-/+="
CLASSES = len(KEY_SIGNS) + 3
CLASS = np.full(256, CLASSES - 2, np.uint8)
CLASS[list(b" \t\n\x0b\x0c\r")] = 0
CLASS[list(KEY_SIGNS.encode())] = np.arange(1, len(KEY_SIGNS) + 1)
CLASS[128:] = CLASSES - 1


def count_transitions(texts: pa.Array) -> np.ndarray:
    """How often each class of byte follows each inside the texts (CLASSES x CLASSES); null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    counts = np.zeros(CLASSES * CLASSES, np.int64)
    if not len(texts):
        return counts.reshape(CLASSES, CLASSES)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if ends[-1] > ends[0] else np.empty(0, np.uint8)
    for a in range(int(ends[0]), int(ends[-1]) - 1, PIECE):
        b = min(a + PIECE + 1, int(ends[-1]))
        kinds = CLASS[data[a:b]].astype(np.int32)
        pairs = kinds[:-1] * CLASSES + kinds[1:]
        last = ends[(ends > a) & (ends < b)] - 1 - a
        pairs[last] = 0  # no transition leads from one text to the next
        counts += np.bincount(pairs, minlength=CLASSES * CLASSES)
    counts = counts.reshape(CLASSES, CLASSES)
    counts[0], counts[:, 0] = 0, 0
    return counts


DICTIONARY_COUNTS = count_transitions(pa.array([" ".join([w, w.capitalize(), w.upper()]) for w in DICTIONARY]))


class Transitions:
    """Log chances of the next class of byte inside a word, from a corpus' counts.

    The dictionary's words, with half a count for what they lack, stand in for PRIOR transitions of each class, so
    that a small corpus does not make its own secrets look usual.
    """

    def __init__(self, counts: np.ndarray | None = None):
        smooth = DICTIONARY_COUNTS + 0.5
        chance = smooth / smooth.sum(axis=1, keepdims=True)
        if counts is not None:
            chance = (counts + PRIOR * chance) / (counts.sum(axis=1, keepdims=True) + PRIOR)
        self.log = np.log(chance)

    def describe(self, value: str) -> tuple[float, float]:
        """Mean log chance of the value's transitions, and the share of those below an even chance."""
        kinds = CLASS[np.frombuffer(value.encode("utf-8", "replace"), np.uint8)]
        log = self.log[kinds[:-1], kinds[1:]]
        return (float(log.mean()), float((log < -math.log(CLASSES)).mean())) if len(log) else (0.0, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((CLASSES, CLASSES), np.int64)
    for batch in batches:
        total += count_transitions(batch.column(0))
    a, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], names=["a", "b", "n"])


def learn_transitions(docs: DataFrame) -> Transitions:
    """Transitions of the whole texts of all rows; the driver gets at most CLASSES x CLASSES sums."""
    pairs = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "a long, b long, n long")
    counts = np.zeros((CLASSES, CLASSES))
    for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        counts[r["a"], r["b"]] = r["n"]
    return Transitions(counts)


WORD_TRANSITIONS = Transitions()


def describe(value: str, before: str, after: str, path: str | None, transitions: Transitions | None = None) -> list[float]:
    """The features of one finding; without transitions of a corpus those of the dictionary's words count."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    count = Counter(kinds)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    run = longest = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if ord(b) - ord(a) in (0, 1) else 1
        longest = max(longest, run)
    kind = next((i + 1 for i, (_, p) in enumerate(KINDS) if p.match(value)), 0)
    return [
        float(min(n, 500)), count["d"] / n, count["u"] / n, count["l"] / n, count["o"] / n, turns, entropy, entropy / math.log2(max(2, n)), longest / n,
        sum(map(len, WORDS.findall(value))) / n, float(kind), float(bool(GOOD.search(before))), float(bool(BAD.search(before) or BAD.search(after[:12]))), float(bool(ASSIGNED.search(before))),
        float(after[:1] in ('"', "'")), float(bool(path and TEST_PATH.search(path))), *(transitions or WORD_TRANSITIONS).describe(value),
    ]


def example_findings(n: int = 3000, seed: int = 5) -> Findings:
    """(before, value, after, path, label): findings labelled by the rule that made them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    words = lambda k: "".join(r.choice(DICTIONARY) for _ in range(k))
    prose = lambda: " ".join(pick(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(1, 6)))
    good = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "private_key", "passwd"]
    bad = ["sha256", "commit", "checksum", "etag", "uuid", "order", "version", "md5", "digest", "revision", "invoice"]
    out = []
    for _ in range(n):
        path = r.choice(["src", "web", "forum", "crawl", "src/app", "notes"])
        q = r.choice(['"', "'", ""])
        sign = r.choice([" = ", "=", ": ", ":"])
        what = r.random()
        if r.random() < 0.5:
            value = (
                pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 48, 64])) if what < 0.5 else "AKIA" + pick(string.ascii_uppercase + string.digits, 16) if what < 0.65
                else r.choice(["ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"]) + pick(alnum, r.randint(20, 40)) if what < 0.8 else pick(alnum + "+/", r.randint(16, 60))
            )
            alone = value.startswith(("AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-")) and r.random() < 0.6
            before = f"{prose()} " if alone else f"{prose()} {r.choice(good)}{sign}{q}"
            out.append((before, value, ("" if alone else q) + " " + prose(), path, 1))
        else:
            value = (
                pick("0123456789", r.randint(12, 19)) if what < 0.25 else pick(hexa, r.choice([32, 40, 64])) if what < 0.45 else words(r.randint(2, 4)) + str(r.randint(0, 2099)) if what < 0.6
                else "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)) if what < 0.7 else r.choice("0xaX1") * r.randint(12, 40) + "1" if what < 0.78
                else f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}" if what < 0.86 else f"{words(1)}-{words(1)}_{words(1)}{r.randint(1, 99)}" if what < 0.95 else "0123456789abcdef"[: r.randint(12, 16)]
            )
            hash_like = len(value) in (32, 40, 64) and set(value) <= set(hexa) and not value.isdigit() or value.count("-") == 4
            before = f"{prose()} {r.choice(bad)}{r.choice([' ', sign])}{q}" if hash_like or r.random() < 0.3 else f"{prose()} {r.choice(good)}{sign}{q}" if what >= 0.45 and r.random() < 0.4 else f"{prose()} "
            out.append((before, value, q + " " + prose(), path if r.random() < 0.8 else "tests/fixtures", 0))
    return out


def more_findings(n: int = 3000, seed: int = 6) -> Findings:
    """As example_findings: passwords, short values and runs without digits, and the words, names and paths that look like them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    lower, letters = string.ascii_lowercase, string.ascii_letters
    prose = lambda: " ".join(pick(lower, r.randint(2, 9)) for _ in range(r.randint(1, 6)))
    good = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "private_key", "passwd", "pwd", "key"]
    out = []
    for _ in range(n):
        path = r.choice(["src", "web", "forum", "crawl", "src/app", "notes"])
        q = r.choice(['"', "'", ""])
        set_ = f"{prose()} {r.choice(good)}{r.choice([' = ', '=', ': ', ':'])}{q}"
        what = r.random()
        if r.random() < 0.5:
            value = (
                pick(letters, r.randint(12, 40)) if what < 0.3 else pick(letters + string.digits + "!#$%&*@^?", r.randint(8, 20)) + r.choice("!#$%&*@^?") if what < 0.6
                else pick(letters + string.digits, r.randint(7, 11)) + r.choice(string.digits) if what < 0.8 else pick(lower, r.randint(16, 32))
            )
            if r.random() < 0.2:
                out.append((f"{prose()} {r.choice(['postgres', 'https', 'amqp'])}://{pick(lower, r.randint(3, 8))}:", value.replace("@", "!"), f"@{pick(lower, 6)}.org " + prose(), path, 1))
            else:
                out.append((set_, value, q + " " + prose(), path, 1))
        elif what < 0.5:  # long words, names and paths of a text
            value = (
                pick(lower, r.randint(12, 24)) if what < 0.2 else pick(lower, r.randint(12, 20)).capitalize() if what < 0.25 else r.choice("-_/").join(pick(lower, r.randint(3, 9)) for _ in range(r.randint(2, 5))).ljust(12, "e")
                if what < 0.4 else "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(2, 4))).ljust(12, "s") if what < 0.47 else r.choice("-_=*+/") * r.randint(12, 60)
            )
            value = value.upper() if r.random() < 0.25 else value
            out.append((f"{prose()}{r.choice([' ', ' ', ' ', ': '])}", value, r.choice([" ", ". ", ", "]) + prose(), path, 0))
        else:  # ordinary words and sentences that are assigned
            value = (
                r.choice(DICTIONARY).ljust(4, "s") if what < 0.7 else r.choice("-_. ").join(r.choice(DICTIONARY) for _ in range(r.randint(2, 5))) if what < 0.85
                else pick(lower, r.randint(4, 9)) if what < 0.95 else r.choice(["true", "false", "none", "null", "****", "required", "${" + r.choice(DICTIONARY) + "}", "<" + r.choice(DICTIONARY) + ">"])
            )
            out.append((set_, value, q + " " + prose(), path, 0))
    return out


class Forest:
    """A random forest of Gini trees on numpy arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees if len(x) else 0):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(nodes, x[rows], y[rows], depth, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, nodes: list[list[float]], x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y.mean())])  # feature, cut, left, right, share of label 1
        if depth and len(y) >= 8 and 0 < y.mean() < 1:
            best = (float(len(y) * y.mean() * (1 - y.mean())) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, t = x[order, f], y[order]
                left = np.cumsum(t)[:-1]
                n = np.arange(1, len(t))
                impure = left * (1 - left / n) + (t.sum() - left) * (1 - (t.sum() - left) / (len(t) - n))
                impure = np.where(v[1:] > v[:-1], impure, np.inf)
                i = int(np.argmin(impure))
                if impure[i] < best[0]:
                    middle = float((v[i] + v[i + 1]) / 2)
                    best = (float(impure[i]), int(f), middle if middle < v[i + 1] else float(v[i]))
            if best[1] >= 0:
                go = x[:, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2] = self._grow(nodes, x[go], y[go], depth - 1, rng)
                nodes[me][3] = self._grow(nodes, x[~go], y[~go], depth - 1, rng)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees; 1 without any tree, so that nothing is missed untrained."""
        if not self.trees or not len(x):
            return np.ones(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := t[at, 0] >= 0).any():
                f = np.maximum(t[at, 0], 0).astype(np.int64)
                at = np.where(inner, np.where(x[rows, f] <= t[at, 1], t[at, 2], t[at, 3]), at).astype(np.int64)
            total += t[at, 4]
        return total / len(self.trees)


def read_findings(findings: DataFrame, limit: int = MAX_FINDINGS) -> Findings:
    """Labelled findings of a table (before, value, after, path string, label 0 or 1), at most `limit`, drawn by a hash of the row.

    before and after are the text beside the value. Rows without a value or a label are left out, a null before or after
    is empty, a null path unknown; repeated rows count as often as they stand. Other columns are ignored.
    """
    rows = findings.where("value is not null and value <> '' and label is not null")
    rows = rows.select(F.coalesce("before", F.lit("")).alias("before"), "value", F.coalesce("after", F.lit("")).alias("after"), "path", F.col("label").cast("int").alias("label"))
    return [tuple(r) for r in rows.orderBy(F.xxhash64("before", "value", "after"), "label").limit(limit).collect()]


def train(findings: Findings, transitions: Transitions | None = None) -> Forest:
    """A forest from labelled findings (before, value, after, path, label); they are held on the driver."""
    x = np.array([describe(v, b[-BESIDE:], a[:BESIDE], p, transitions) for b, v, a, p, _ in findings]).reshape(len(findings), FEATURES)
    return Forest(x, np.array([f[4] for f in findings], dtype=np.float64))


def _model(docs: DataFrame, findings: Findings | DataFrame | None) -> tuple[Forest, Transitions]:
    """The forest and the transitions that judge the rows of docs."""
    transitions = learn_transitions(docs)
    if findings is None:
        findings = example_findings() + more_findings()
    elif isinstance(findings, DataFrame):
        findings = read_findings(findings)
    return train(findings, transitions), transitions


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of a text that may be secrets, in code points."""
    if not text:
        return []
    found = [m.span() for m in RUN.finditer(text)]
    found += [m.span(m.lastindex) for m in VALUE.finditer(text)]
    found += [m.span(1) for m in LOGIN.finditer(text)]
    at = 0
    while (begin := PEM_BEGIN.search(text, at)) and (end := PEM_END.search(text, begin.end())):
        found.append((begin.start(), end.end()))
        at = end.end()
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:  # spans that overlap are one
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def judge(texts: list[str | None], paths: list[str | None], spans: list[tuple[int, int, int]], forest: Forest, transitions: Transitions | None = None) -> np.ndarray:
    """The forest's probability of each span (text's number, start, end)."""
    x = [describe(texts[i][s:e], texts[i][max(0, s - BESIDE) : s], texts[i][e : e + BESIDE], paths[i], transitions) for i, s, e in spans]
    return forest.predict(np.array(x).reshape(len(spans), FEATURES))


def kind_of(value: str) -> str:
    return next((k for k, p in KINDS if p.match(value)), "opaque")


def _scan(forest: Forest, transitions: Transitions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("secrets")
        for ids, texts, paths in arrow_rows(batches, "doc_id", "text", "source"):
            spans = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
            p = judge(texts, paths, spans, forest, transitions)
            cols = [[ids[i] for i, _, _ in spans], [s for _, s, _ in spans], [e for _, _, e in spans], [kind_of(texts[i][s:e]) for i, s, e in spans]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array(p, pa.float64())], names=["doc_id", "start", "end", "kind", "probability"])

    return run


def find_secrets(docs: DataFrame, findings: Findings | DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, kind, probability, is_secret) of every candidate in every row of docs.

    start and end count code points, end excluded. A null or empty text has no candidates; a null source is
    an unknown path; each row counts for itself, also where doc_ids repeat. The secrets themselves are
    not returned. An empty table gives no rows, other columns are ignored; findings: labelled ones, a list or a table
    (read_findings); without them the examples made by rule are used.
    """
    model = _model(docs, findings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    found = rows.mapInArrow(_scan(*model), "doc_id long, start int, end int, kind string, probability double")
    return found.withColumn("is_secret", F.col("probability") >= threshold)


def _redact(forest: Forest, transitions: Transitions, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("secrets")
        for batch in batches:
            names = batch.schema.names
            texts, paths = (batch.column(names.index(c)).to_pylist() for c in ("text", "source"))
            spans = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
            chances = judge(texts, paths, spans, forest, transitions)
            parts: dict[int, list[tuple[int, int]]] = {}
            for (i, s, e), p in zip(spans, chances, strict=True):
                if p >= threshold:
                    parts.setdefault(i, []).append((s, e))
            for i, found in parts.items():
                text, out, at = texts[i], [], 0
                for s, e in found:
                    out += [text[at:s], f"[SECRET:{kind_of(text[s:e])}]"]
                    at = e
                texts[i] = "".join([*out, text[at:]])
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def redact_secrets(docs: DataFrame, findings: Findings | DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every row of docs, all its columns, with each secret of `text` replaced by [SECRET:kind].

    Null and empty texts stay as they are; each row is redacted for itself, also where rows or doc_ids repeat;
    columns of any other name pass unread, `source` comes back as a string. An empty table gives no rows.
    """
    rows = docs.withColumn("source", F.col("source").cast("string"))
    return rows.mapInArrow(_redact(*_model(docs, findings), threshold), rows.schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
