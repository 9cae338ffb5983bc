"""Shared parts of the text operators: scratch tables, and words and n-grams as numpy arrays.

Words are runs of bytes other than space and 0x09-0x0D, the same in UTF-8 bytes and in code points.
Hashes are 64-bit; a second, independently keyed hash picks the bucket a value travels to, so two
values meet only if both agree.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
PASS_BYTES = 1 << 20
#: Bytes of rows in a batch for a Python worker, in what stage() writes.
BATCH, _BATCH_SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=1)
def _own_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="gridwise-")


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a temporary folder, on one machine only."""
    folder, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder for tables between steps")
    return (folder or _own_scratch()).rstrip("/")


def free(columns: list[str], name: str) -> str:
    """name, with underscores before it as long as one of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: a cut of the lineage that outlives executors. While it is written,
    batches of rows go to Python workers in BATCH bytes at most, so that wide rows need little memory on either side."""
    path, conf = new_folder(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(_BATCH_SETTING, None)
    conf.set(_BATCH_SETTING, BATCH)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_BATCH_SETTING, before) if before else conf.unset(_BATCH_SETTING)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands what this process has freed back to the system. Arrow's pool and the C library (glibc) keep it for later
    use, and a Python worker that waits for its next task would hold it beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function over a task's batches, which gives back free memory when the task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """run, a function of a group's rows, which gives back free memory after each group."""

    def tidied(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(group)
        finally:
            give_back()

    return tidied


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_count(docs: DataFrame, chars_each: int = 8_000_000) -> int:
    """Buckets so that each gets the hashes of about chars_each characters, whatever the corpus holds."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, -(-chars // chars_each))


# ---- words and n-grams -------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Factors of the bytes of a word, by place; longer words are hashed whole.
_PLACES = np.array([pow(_WORD_BASE, i, 1 << 64) for i in range(257)], U64)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, n+1 offsets into them), about limit bytes at a time."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of some documents: start and end byte, document, and words before each document."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        n = len(off) - 1
        word = ~_SPACE[data]
        first, last = word.copy(), word.copy()
        if len(data):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            full = np.flatnonzero(off[1:] > off[:-1])
            first[off[full]] = word[off[full]]
            last[off[full + 1] - 1] = word[off[full + 1] - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        data = _LOWER[self.data] if lower else self.data
        if not len(self):
            return np.zeros(0, U64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        value = (data[place + np.repeat(self.start, size)].astype(U64) + U64(1)) * _PLACES[np.minimum(place, 256)]
        h = mix(np.add.reduceat(value, begin))
        for i in np.flatnonzero(size > 256):  # polynomials modulo 2**64 are weak for long strings
            h[i] = int.from_bytes(hashlib.blake2b(data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def ngrams(self, h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the hash of every run of n words inside one document."""
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :])
        total, done, run, size = None, 0, h, 1  # run: hashes of size words from each place, size doubling
        while True:
            if n & size:
                part = run[done:]
                total = part if total is None else total[: len(part)] + part[: len(total)] * U64(pow(base, done, 1 << 64))
                done += size
            if done == n:
                return at, mix(total[at])
            run, size = run[:-size] + run[size:] * U64(pow(base, size, 1 << 64)), 2 * size


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of each document's distinct n-word shingles, in order of both; a
    shorter document has its whole word sequence as its one shingle, one without words has none."""
    h = words.hashes(lower=True)
    at, grams = words.ngrams(h, n)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        own = np.array([whole_hash(h[words.first[d] : words.first[d + 1]]) for d in short], U64)
        doc, grams = np.concatenate((doc, short)), np.concatenate((grams, own))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def whole_hash(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little")


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a run of width words that begins at one of starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.subtract.at(d, starts + width, 1)
    return np.cumsum(d[:-1]) > 0


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def filesystem(uri: str):
    """The pyarrow filesystem and path of a folder of the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


# ---- rows that carry arrays between tasks -------------------------------------------------------


@lru_cache(maxsize=1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """An integer array as bytes: byte planes, compressed, so that shared high bytes cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return _codec()[0].compress(np.ascontiguousarray(planes).tobytes())


def unpack(packed: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(_codec()[1].decompress(packed), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def unpack_all(column, dtype) -> np.ndarray:
    parts = [unpack(b, dtype) for b in column if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def scattered(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[list[bytes]]]:
    """Entries dealt out by bucket: the buckets, and for each column its packed values in each of them."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(b)][: len(cut)]
    moved = [c[order] for c in columns]
    return b[cut].tolist(), [[pack(c[i:j]) for i, j in zip(cut.tolist(), ends, strict=True)] for c in moved]


def numbered(docs: DataFrame, columns: list[str] = ("doc_id", "text")) -> DataFrame:
    """docs(doc_id, text), or those columns, with row_id: doc_id itself where it is unique, else a number in
    (doc_id, text) order."""
    own = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}
    docs = docs.select(*(own.get(c, F.col(c)).alias(c) for c in columns if c != "row_id"))
    ids = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"] and not docs.groupBy("doc_id").count().filter("count > 1").head(1):
        return docs.withColumn("row_id", F.col("doc_id"))
    return stage(docs.sort("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges(a, b), component being the smallest id connected with it.

    Alternating large and small stars: every round is joins and minima by vertex, and the edges of a
    round are a table in the shared folder."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        near = both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(roots.join(edges.select(F.col("a").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component")))
