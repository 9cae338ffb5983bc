"""Mixing sources to target weights, in fixed-length blocks of words.

Sources in code-point order (null last) have repeating weights and share a total; a source's target stops
at a multiple of its size and the excess goes to the others by weight. Each source's documents, in
ascending doc_id order, are one stream of words cut into blocks. A source's target is a number of slots: whole
passes over its blocks, then a last pass that ends at the target (its last slot is cut short). Each output
shard draws how many of its slots every source fills, from a multinomial conditioned on the sources' totals.
Slot k of a source reads block perm(k mod blocks), perm being a keyed permutation of the source's block
numbers, so that slots and blocks meet in a join by (source, block). The draws of a shard depend on the seed and on
the sources' totals alone, and are made in the tasks that list its slots.

Prefix sums over documents use range partitions of (source, doc_id) and one base a partition and source,
so a source of any size is spread out. What reaches the driver is one row a source (sources are a list that people
write weights for) and one a partition and source that has rows there.

Null and empty texts have size 0 and take nothing; a null source is a source of its own, after the others;
equal doc_ids each keep a row, in each source, with its own other columns; a text of any length is cut across blocks; empty tables and tables
without words give targets of 0. Other columns are ignored by taken(), whatever their names, and kept by
mixed_documents(); mixed_blocks() replaces columns named shard, slot and position by its own. The same rows give the
same mix, whatever their partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from gridwise.llm.common import WORD, Words, free, read, stage, tidy

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, SHARD_BLOCKS, SEED = 512, 256, 20
#: Counts from which a draw uses the normal form of its distribution.
MANY = 100_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Targets of sources in their order: share of all sizes by weight, none above most times its size."""
    size = np.asarray(sizes, float)
    weight = np.array([weights[i % len(weights)] for i in range(len(size))], float)
    total, cap = share * size.sum(), most * size
    out, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    while open_.any() and total > 0:
        want = weight[open_] / weight[open_].sum() * total
        over = want > cap[open_]
        if not over.any():
            out[open_] = want
            break
        at = np.flatnonzero(open_)[over]
        out[at] = cap[at]
        total -= cap[at].sum()
        open_[at] = False
    return out


@dataclass
class Permutation:
    """A keyed permutation of 0..n-1: a Feistel network on the next power of four, walked back into range."""

    n: int
    key: str

    def __post_init__(self):
        self.half = max(1, (max(2, self.n) - 1).bit_length() + 1 >> 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{self.key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(6)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        h = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(31)) & np.uint64((1 << self.half) - 1)

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = np.asarray(x, np.uint64).copy()
        out = np.ones(len(x), bool)
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        while out.any():
            left, right = x[out] >> half, x[out] & mask
            for k in keys:
                left, right = right, left ^ self._round(right, k)
            if keys is self.keys:
                x[out] = (left << half) | right
            else:
                x[out] = (right << half) | left
            out[out] = x[out] >= self.n
        return x.astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def back(self, y: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        y = np.asarray(y, np.uint64)
        swap = lambda v: ((v & mask) << half) | (v >> half)  # noqa: E731  the halves come out crossed
        x = y.copy()
        out = np.ones(len(x), bool)
        while out.any():
            v = swap(x[out])
            left, right = v >> half, v & mask
            for k in reversed(self.keys):
                left, right = right, left ^ self._round(right, k)
            x[out] = (right << half) | left
            out[out] = x[out] >= self.n
        return x.astype(np.int64)


def slots_for(size: int, target: int, block: int, key: str) -> tuple[int, int]:
    """How many slots give target words of a source, and how many words the last slot gives."""
    if size <= 0 or target <= 0:
        return 0, 0
    blocks = -(-size // block)
    passes, rest = divmod(target, size)
    if not rest:
        return passes * blocks, size - (blocks - 1) * block if int(Permutation(blocks, key).of([blocks - 1])[0]) == blocks - 1 else block
    short = int(Permutation(blocks, key).back([blocks - 1])[0])  # the slot of a pass that reads the last, shorter block
    tail = size - (blocks - 1) * block
    before = short * block
    if rest <= before:
        n = -(-rest // block)
        last = rest - (n - 1) * block
    elif rest <= before + tail:
        n, last = short + 1, rest - before
    else:
        more = rest - before - tail
        n = short + 1 + -(-more // block)
        last = more - (n - short - 2) * block
    return passes * blocks + n, last


def sources_of(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> pd.DataFrame:
    """One row a source: its number, size and target. The driver holds one row a source."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    size = np.array([r["size"] for r in rows], np.int64)
    return pd.DataFrame({"source": pd.Series([r["source"] for r in rows], dtype=object), "source_no": np.arange(len(rows), dtype=np.int32), "source_size": size, "target": targets(size, weights, share, most)})


def positions(sizes: DataFrame) -> DataFrame:
    """sizes(doc_id, source_no, size) with start, the words of the same source before the document."""
    spark = sizes.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, source, at = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            no, size = b.column("source_no").to_numpy(), b.column("size").to_numpy()
            total = np.concatenate(([0], np.cumsum(size)))[:-1]
            new = np.flatnonzero(np.concatenate(([len(no) > 0 and no[0] != source], no[1:] != no[:-1])))
            start = total + at  # rows before the batch's first new source, all of them where it has none, go on with the last one
            for i, j in zip(new, np.append(new[1:], len(no)), strict=False):  # one turn a source that begins in the batch
                start[i:j] = total[i:j] - total[i]
            if len(no):
                source, at = int(no[-1]), int(start[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start), pa.array(np.full(len(no), part, np.int32))], [*b.schema.names, "start", "part"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["source_no", "doc_id", "row_hash"]
    ranged = sizes.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "size")
    placed = stage(ranged.mapInArrow(local, "doc_id long, source_no int, size long, row_hash long, start long, part int"), "mix-documents")
    parts = sorted(map(tuple, placed.groupBy("part", "source_no").agg(F.sum("size")).collect()))  # one row a partition and source
    bases, seen = [], {}
    for part, no, size in parts:
        bases.append((part, no, seen.get(no, 0)))
        seen[no] = seen.get(no, 0) + size
    bases = spark.createDataFrame(bases, "part int, source_no int, base long")
    return placed.join(bases, ["part", "source_no"]).select("doc_id", "source_no", "size", "row_hash", (F.col("start") + F.col("base")).alias("start"))


def slots(spark: SparkSession, sources: pd.DataFrame, block: int, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, source_no, block, n_words): what each slot of each output shard reads."""
    plan = []
    for r in sources.itertuples():
        n, last = slots_for(int(r.source_size), int(np.floor(r.target + 0.5)), block, f"{seed}/{r.source}")
        plan.append((int(r.source_no), f"{seed}/{r.source}", -(-int(r.source_size) // block), n, last))
    total = sum(p[3] for p in plan)
    shards = -(-total // shard_blocks)
    counts = [p[3] for p in plan]

    def read_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            for shard, before, drawn in shard_draws(counts, shards, int(ids[0]), int(ids[-1]) + 1, seed):
                for (no, key, blocks, slots_in_all, last), first, n in zip(plan, before, drawn, strict=True):
                    if not n:
                        continue
                    k = np.arange(first, first + n)
                    words = np.full(n, block, np.int64)
                    words[k == slots_in_all - 1] = last
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, shard, np.int32)), "slot": pa.array(k), "source_no": pa.array(np.full(n, no, np.int32)), "block": pa.array(Permutation(blocks, key).of(k % blocks)), "n_words": pa.array(words)})

    each = spark.range(0, shards, 1, max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return each.mapInArrow(read_slots, "shard int, slot long, source_no int, block long, n_words long")


def _share(rng, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good ones; by the normal form where the counts are large."""
    if not bad or not good:
        return n if good else 0
    if good < MANY and bad < MANY:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    deviation = (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    return min(max(round(n * good / total) + round(rng.normal(0, deviation)), n - bad, 0), good, n)


def _split(rng, left: list[int], n: int) -> list[int]:
    """n slots from what the sources have left: a multinomial without replacement."""
    out, rest = [], sum(left)
    for count in left:
        rest -= count
        out.append(_share(rng, count, rest, n))
        n -= out[-1]
    return out


def shard_draws(counts: list[int], shards: int, first: int, end: int, seed: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, slots of each source in the shards before it, its own slots of each) for the shards first to end - 1.

    A range of shards is split in halves; how many of its slots of each source go to the first half is drawn with a
    seed of the range's own. So any task draws the same for a shard, and only what lies above its shards."""
    each, more = divmod(sum(counts), max(1, shards))
    size = lambda lo, hi: (hi - lo) * each + max(0, min(hi, more) - min(lo, more))
    todo = [(0, shards, list(counts), [0] * len(counts))]
    while todo:
        lo, hi, mine, before = todo.pop()
        if hi <= first or lo >= end or lo >= hi:
            continue
        if hi - lo == 1:
            yield lo, before, mine
            continue
        mid = (lo + hi) // 2
        here = _split(np.random.default_rng([seed, lo, hi]), mine, size(lo, mid))
        todo.append((mid, hi, [a - b for a, b in zip(mine, here, strict=True)], [a + b for a, b in zip(before, here, strict=True)]))
        todo.append((lo, mid, here, before))


def row_hash(docs: DataFrame, row: Column | None = None) -> Column:
    """A hash of all columns of docs, or of those of a struct of them: rows with the same are the same row."""
    of = lambda f: F.col(f"`{f.name}`") if row is None else row.getField(f.name)
    plain = lambda f: F.to_json(F.struct(of(f))) if "map<" in f.dataType.simpleString() else of(f)  # noqa: E731  maps have no hash
    fields = docs.schema.fields
    return F.xxhash64(*map(plain, fields), *(of(f).isNull() for f in fields))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), row_hash(docs).alias("row_hash"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """The documents, (doc_id, source, size, row_hash, start, source_size, target), and the pieces that
    the slots read of them, (doc_id, source_no, source, row_hash, start, shard, slot, from_word, n_words)."""
    spark = docs.sparkSession
    sizes = stage(measured(docs), "mix-sizes")
    sources = sources_of(sizes, weights, share, most)
    table = spark.createDataFrame([(None if r.source is None else str(r.source), int(r.source_no), int(r.source_size), float(r.target)) for r in sources.itertuples()], "source string, source_no int, source_size long, target double")
    numbered = sizes.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source_no", "size", "row_hash")
    placed = stage(positions(numbered), "mix-positions")
    blocks = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    begin = F.col("block") * block
    lo = F.greatest(F.col("start"), begin)
    hi = F.least(F.col("start") + F.col("size"), begin + F.col("n_words"))
    pieces = (
        # the planner takes the slots for as few as the shards they come from: both sides are shuffled, whatever it thinks
        blocks.join(slots(spark, sources, block, seed).hint("merge"), ["source_no", "block"])
        .filter(hi > lo)
        .join(F.broadcast(table.select("source_no", "source")), "source_no")  # one row a source
        .select("doc_id", "source_no", "source", "row_hash", "start", "shard", "slot", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n_words"))
    )
    return placed.join(table, "source_no"), pieces


def taken(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document."""
    placed, pieces = mix(docs, **how)
    words = pieces.groupBy("source_no", "doc_id", "start").agg(F.sum("n_words").alias("taken"))
    same = (F.col("source_no") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")) & (F.col("size") > 0)
    out = placed.join(words.withColumnsRenamed({"source_no": "n", "doc_id": "d", "start": "s"}), same, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _cut(batches: Iterator[pa.RecordBatch], place=("shard", "slot", "position")) -> Iterator[pa.RecordBatch]:
    """The pieces of rows (..., text, pieces): texts cut at word borders, what stands between words kept; then shard, slot
    and position, the piece's first word in its source."""
    for batch in batches:
        rows = batch.num_rows
        names = batch.schema.names[:-1]
        at = names.index("text")
        for lo in range(0, rows, 200):
            part = batch.slice(lo, 200)
            which, texts, places = [], [], []
            for i, (text, pieces) in enumerate(zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)):
                raw = (text or "").encode()
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for p in pieces:
                    a, b = p["from_word"], p["from_word"] + p["n_words"]
                    begin = 0 if a == 0 else words.start[a]
                    end = len(raw) if b == len(words) else words.end[b - 1]
                    which.append(i)
                    texts.append(raw[begin:end].decode())
                    places.append((p["shard"], p["slot"], p["start"] + a))
            out = part.select(names).take(pa.array(which, pa.int64()))
            sizes = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            columns = [sizes.get(n, out.column(i)).cast(out.schema.field(i).type) for i, n in enumerate(names)]
            at_place = [pa.array([x[k] for x in places], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *at_place], [*names, *place])


def _mixed(docs: DataFrame, names: list[str], **how) -> DataFrame:
    """One row for each piece that a slot reads of a document: docs' columns, text and n_chars cut to the piece, and its
    place under these names."""
    _, pieces = mix(docs, **how)
    key = lambda row: [F.coalesce(F.col(row + "doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(row + "source").cast("string")), F.lit("")).alias("source_key")]  # noqa: E731  null apart from ''
    keys = ["key", "source_key", "row_hash"]
    piece = ["from_word", "n_words", "start", "shard", "slot"]
    pieces = pieces.select(*key(""), "row_hash", *piece).groupBy(*keys).agg(F.collect_list(F.struct(*piece)).alias("pieces"))
    texts = docs.select(F.struct("*").alias("row")).select("row", *key("row."), row_hash(docs, F.col("row")).alias("row_hash")).dropDuplicates(keys)  # of equal rows one reads for all
    rows = texts.join(pieces, keys).select("row.*", F.col("pieces").alias(free(docs.columns, "pieces")))
    place = StructType().add(names[0], IntegerType()).add(names[1], LongType()).add(names[2], LongType())
    return rows.mapInArrow(tidy(partial(_cut, place=tuple(names))), StructType(docs.schema.fields + place.fields))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows like docs, in no order."""
    names = [free(docs.columns, c) for c in ("shard", "slot", "position")]
    return _mixed(docs, names, **how).drop(*names)


def mixed_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix in its order: docs' columns with shard, source, slot and position. A shard is in one partition, its slots
    are shuffled by a keyed hash, and a slot's pieces follow one another as in the source."""
    names = ["shard", "slot", "position"]
    docs = docs.drop(*names)
    order = [F.xxhash64("shard", F.col("source").cast("string"), "slot"), F.col("source").cast("string"), F.col("slot"), F.col("position")]
    return _mixed(docs, names, **how).repartition("shard").sortWithinPartitions("shard", *order)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
