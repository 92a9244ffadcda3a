"""What the operators share: durable intermediate tables, words, row folds, worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BLOOM_BITS = 1 << 26  # 8 MB


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only on a local master (tests) a folder of this machine is set where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark.sparkContext, "_sparkveil_scratch", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="sparkveil-")
            spark.sparkContext._sparkveil_scratch = root
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut, and a lost executor costs nothing."""
    path = f"{scratch_dir(df.sparkSession)}/sparkveil/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bloom_joins(spark: SparkSession) -> Iterator[None]:
    """Within it, a shuffled join may drop rows without a partner before the exchange, by a Bloom filter of fixed size.

    Only a filter over the scan of the smaller side (its Filter(...).select(...)) is taken up by the optimiser.
    """
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "100g", "numBits": str(BLOOM_BITS), "maxNumBits": str(BLOOM_BITS), "expectedNumItems": str(BLOOM_BITS // 16)}
    wanted = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sweep(spark: SparkSession) -> None:
    """Delete every intermediate table of this application's scratch folder; call it once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/sparkveil")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null doc_id has a null fold."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(parts))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the UTF-8 text with A-Z lower-cased; bytes.split() parts at exactly these."""
    return text.encode("utf-8", "replace").lower().split() if text else []


_MULT = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers (the finaliser of SplitMix64)."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MULT[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MULT[1])
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word bytes -> 64-bit hash, kept for as long as the limit of entries allows."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(words: list[bytes], n: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, cache)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, 0x9E3779B97F4A7C15 + width, np.uint64)
    for k in range(width):
        out = mix64(out ^ h[k : len(h) - width + 1 + k])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def release() -> None:
    """Gives freed memory back to the system where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python process; functions sent by value lose their globals.

    Workers are used again by later jobs, so what another owner has left there is dropped and its memory given back.
    """
    cache = sys.__dict__.setdefault("_sparkveil_cache", {})
    if cache.get("owner") != owner:
        cache.clear()
        cache["owner"] = owner
        release()
    return cache


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 2000) -> Iterator[tuple[list, ...]]:
    """The Arrow batches as Python lists of the named columns, some rows at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(0, batch.num_rows, rows):
            yield tuple(c.slice(i, rows).to_pylist() for c in columns)


def to_signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)
