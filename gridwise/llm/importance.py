"""Target-distribution importance resampling: documents drawn as if from the distribution of a target's texts.

A document's features are its runs of up to MOST_WORDS words; each falls into the bucket of its CRC-32. A bucket's gain
is the logarithm of how much likelier the target is to use it, both counts smoothed by one; a document's weight is the
sum of its features' gains, from an array. With Gumbel noise of its doc_id added, the highest scores are a draw without
replacement in proportion to the weights.

The draw is an external merge. Eligible documents of a partition are sorted into runs of at most RUN_ROWS. Sampled keys
cut the order into ranges (the cuts decide only how even they are); a run's rows of a range go out in blocks, as packed
arrays. Counts of the ranges give each its first rank and how many rows it owes; ranges past the draw are not read. A
task gets its range's blocks in the order of their first keys, so that a run's next block comes exactly when the last is
used up, and merges them by a tournament tree over the runs, one block of each in memory, until it has what it owes.
A range with over FAN_IN runs is first merged, FAN_IN at a time, into fewer.

A null text has no words; a document without words weighs 0. Equal scores go to the smaller doc_id (null last), then to
fewer features; rows equal in all three are interchangeable and each counts. A null doc_id has the noise of an empty one.
A text is read whole, whatever its length. Empty tables: without documents the result is empty, without a target all
its counts are zero. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwise.llm.common import Words, pack, passes, read, segment_sum, stage, strings, unpack

BUCKETS, MOST_WORDS, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Rows of a sorted run, of a block and, about, of a range; runs that a tree merges.
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS, FAN_IN = 500_000, 4_096, 10_000, 256
#: Most ranges; keys sampled a range, and at most.
RANGES, SAMPLED, MOST_SAMPLED = 2_048, 40, 200_000

#: Bytes of text whose features are hashed at once; words longer than LONG are hashed by zlib.
PIECE, LONG = 1 << 20, 256
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Each byte as it counts: A-Z in lower case, whatever ends a word as a space.
_AS_WORD = np.full(256, 0x20, np.uint8)
_AS_WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
_AS_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_AS_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_AS_WORD[0x80:] = np.arange(0x80, 0x100)

SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"
BLOCKS = "range int, run long, score long, missing int, doc_id long, n_features long, row long, n long, keys binary"


# ---- features ----------------------------------------------------------------------------------


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to a CRC-32 by its distance from the end, and the CRC-32 of that many zero bytes: the sum is
    linear, so a string's CRC-32 is the exclusive or of its bytes' shares and of the zero string's."""
    zero = np.array([zlib.crc32(bytes(n)) for n in range(LONG + 1)], np.uint32)
    share = np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ int(zero[d + 1]) for b in range(256)] for d in range(LONG)], np.uint32)
    return share, zero


_SHARE, _ZERO = _crc_tables()


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[start:end] for each place, none of them empty."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    short = np.flatnonzero(size <= LONG)
    if len(short):
        n = size[short]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        byte = data[place + np.repeat(start[short], n)]
        out[short] = np.bitwise_xor.reduceat(_SHARE[np.repeat(n, n) - place - 1, byte], begin) ^ _ZERO[n]
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def feature_buckets(data: np.ndarray, off: np.ndarray, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, words, buckets' documents and buckets) of some documents' bytes: pairs of arrays, PIECE bytes at a time."""
    data = _AS_WORD[data]
    words = Words(data, off)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(words.start, words.start[lo] + PIECE)))
        found, doc = [], []
        for k in range(1, most + 1):
            first = np.arange(lo, min(hi, len(words) - k + 1))
            first = first[words.doc[first] == words.doc[first + k - 1]]
            if k == 1:
                found.append(crc32_of(data, words.start[first], words.end[first]))
            else:
                found.append(np.array([zlib.crc32(b" ".join(data[words.start[i + j] : words.end[i + j]].tobytes() for j in range(k))) for i in first.tolist()], np.uint32))
            doc.append(words.doc[first])
        yield words.doc[lo:hi], np.concatenate(doc), np.concatenate(found) % np.uint32(buckets)
        lo = hi


def bucket_counts(texts: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of texts(text) fall into each bucket: one row a bucket and task, then one a bucket."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in rows:
            for _, _, data, off in passes(strings(batch.column(0))):
                for _, _, bucket in feature_buckets(data, off, most, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counts = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():  # as many rows as there are buckets at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket, in doubles."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in pairs], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, most: int = MOST_WORDS, seed: int = SEED, least: int = LEAST_WORDS) -> DataFrame:
    """docs(doc_id, text) with their features, weight, score, and whether they have the least number of words."""
    buckets = len(gain)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, off in passes(strings(batch.column(1))):
                n, features, weight = (np.zeros(hi - lo, np.int64) for _ in range(3))
                for word_doc, doc, bucket in feature_buckets(data, off, most, buckets):
                    n += np.bincount(word_doc, minlength=hi - lo)
                    features += np.bincount(doc, minlength=hi - lo)
                    order = np.argsort(doc, kind="stable")
                    weight += segment_sum(gain[bucket[order]], np.searchsorted(doc[order], np.arange(hi - lo + 1)))
                score = weight + np.array([noise(i, seed) for i in ids[lo:hi]], np.int64)
                columns = [pa.array(ids[lo:hi], pa.int64()), pa.array(features), pa.array(weight), pa.array(score), pa.array(n >= least)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "score", "eligible"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)


# ---- sorted runs -------------------------------------------------------------------------------

#: Columns of a key, in the order in which they decide; score falls, the others rise.
KEY = ("score", "missing", "doc_id", "n_features", "row")
Key = tuple[int, int, int, int, int]


def packed_block(keys: np.ndarray, weight: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(np.column_stack((keys, weight)).T).reshape(-1))


def unpacked_block(block: bytes) -> tuple[list[Key], list[int]]:
    columns = unpack(block, np.int64).reshape(len(KEY) + 1, -1)
    return list(zip(*columns[:-1].tolist(), strict=True)), columns[-1].tolist()


def blocks_of(run: int, keys: np.ndarray, weight: np.ndarray, cuts: list[Key]) -> Iterator[tuple]:
    """Rows of BLOCKS for a sorted run; keys has the columns of KEY, the score negated. Range i ends before cuts[i]."""
    ends = [0, *(bisect_left(range(len(keys)), c, key=lambda i: tuple(keys[i].tolist())) for c in cuts), len(keys)]
    for r in range(len(ends) - 1):
        for lo in range(ends[r], ends[r + 1], BLOCK_ROWS):
            hi = min(lo + BLOCK_ROWS, ends[r + 1])
            yield (r, run, *keys[lo].tolist(), hi - lo, packed_block(keys[lo:hi], weight[lo:hi]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def sorted_runs(keys: DataFrame, cuts: list[Key]) -> DataFrame:
    """Rows (KEY, weight) of each partition as blocks of sorted runs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = np.concatenate(held)
            columns = columns[np.lexsort([columns[:, i] for i in reversed(range(len(KEY)))])]
            out = []
            for block in blocks_of(task << 24 | n, columns[:, :-1], columns[:, -1], cuts):
                out.append(block)
                if len(out) == 64:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        for batch in rows:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= RUN_ROWS:
                yield from flush()
                n, held, size = n + 1, [], 0
        if size:
            yield from flush()

    return keys.select(*KEY, "weight").mapInArrow(run, BLOCKS)


class Tournament:
    """The least of the next keys of some runs: a tree in which each node holds the run that wins below it."""

    def __init__(self, slots: int):
        self.size = 1 << max(0, slots - 1).bit_length()
        self.key: list[Key | None] = [None] * self.size
        self.win = [i % self.size for i in range(2 * self.size)]
        for node in range(self.size - 1, 0, -1):
            self.win[node] = self.win[2 * node]

    def put(self, slot: int, key: Key | None) -> None:
        """A run's next key; None once it has none."""
        self.key[slot] = key
        node = (slot + self.size) >> 1
        while node:
            left, right = self.win[2 * node], self.win[2 * node + 1]
            a, b = self.key[left], self.key[right]
            self.win[node] = left if b is None or a is not None and a < b else right
            node >>= 1

    def winner(self) -> int:
        return self.win[1]

    def next_best(self) -> Key | None:
        """The least key of all runs but the winner: it lost to the winner on the way up."""
        node, best = self.win[1] + self.size, None
        while node > 1:
            key = self.key[self.win[node ^ 1]]
            if key is not None and (best is None or key < best):
                best = key
            node >>= 1
        return best


def merged(blocks: Iterator[tuple[int, Key, bytes]], runs: int, owed: int) -> Iterator[tuple[list[Key], list[int]]]:
    """Sorted rows of blocks (run, first key, packed) that come in the order of their first keys, some at a time, owed
    in all. Each run has one block in memory: its next begins after all that this one holds."""
    tree, slot_of, held, place = Tournament(runs), {}, {}, {}
    blocks = iter(blocks)
    coming = next(blocks, None)
    while owed > 0:
        best = tree.key[tree.winner()]
        while coming is not None and (best is None or coming[1] < best):
            slot = slot_of.setdefault(coming[0], len(slot_of))
            held[slot], place[slot] = unpacked_block(coming[2]), 0
            tree.put(slot, held[slot][0][0])
            best = tree.key[tree.winner()]
            coming = next(blocks, None)
        if best is None:
            return
        slot, limit = tree.winner(), tree.next_best()
        if coming is not None and (limit is None or coming[1] < limit):
            limit = coming[1]
        keys, weight = held[slot]
        lo = place[slot]
        hi = len(keys) if limit is None else max(lo + 1, bisect_left(keys, limit, lo))
        hi = min(hi, lo + owed)
        yield keys[lo:hi], weight[lo:hi]
        owed -= hi - lo
        place[slot] = hi
        tree.put(slot, keys[hi] if hi < len(keys) else None)
        if hi == len(keys):
            held[slot] = ([], [])


def _streams(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator]]:
    """((range, group, runs, owed, first rank), its blocks) of rows in that order."""
    flat = (tuple(r.values()) for batch in rows for r in batch.to_pylist())
    ahead: list[tuple] = []

    def same(head: tuple) -> Iterator[tuple[int, Key, bytes]]:
        while True:
            row = ahead.pop() if ahead else next(flat, None)
            if row is None:
                return
            if row[:5] != head:
                ahead.append(row)
                return
            yield row[5], row[6:11], row[11]

    while True:
        row = ahead.pop() if ahead else next(flat, None)
        if row is None:
            return
        ahead.append(row)
        blocks = same(row[:5])
        yield row[:5], blocks
        for _ in blocks:  # what a merge left unread
            pass


def _dealt(blocks: DataFrame, groups: int) -> DataFrame:
    """Blocks by range and group, in the order of their first keys."""
    columns = ["range", "group", "runs", "owed", "base", "run", *KEY, "keys"]
    return blocks.select(*columns).repartition(groups, "range", "group").sortWithinPartitions("range", "group", *KEY)


def fewer_runs(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks whose runs were merged, at most FAN_IN at a time, until no range has more than FAN_IN; most is the highest
    number of runs that a range has."""
    while most > FAN_IN:
        groups = -(-most // FAN_IN)
        number = F.dense_rank().over(_by_range().orderBy("run")) - 1
        small = blocks.select("range", "run").distinct().select("range", "run", (number / FAN_IN).cast("int").alias("group"))
        owed = {"runs": F.lit(FAN_IN), "owed": F.lit(1 << 62), "base": F.lit(0).cast("long")}
        dealt = _dealt(blocks.join(small, ["range", "run"]).withColumns(owed), groups * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (r, group, runs, owed, _), stream in _streams(rows):
                held: list[tuple[Key, int]] = []
                for keys, weight in merged(stream, runs, owed):
                    held += zip(keys, weight, strict=True)
                    while len(held) >= BLOCK_ROWS:
                        yield _block_row(r, group, held[:BLOCK_ROWS])
                        held = held[BLOCK_ROWS:]
                if held:
                    yield _block_row(r, group, held)

        blocks = stage(dealt.mapInArrow(run, BLOCKS), "runs")
        most = groups
    return blocks


def _block_row(r: int, run: int, held: list[tuple[Key, int]]) -> pa.RecordBatch:
    return _batch([(r, run, *held[0][0], len(held), packed_block(np.array([k for k, _ in held], np.int64), np.array([w for _, w in held], np.int64)))])


def _by_range():
    from pyspark.sql import Window

    return Window.partitionBy("range")


def drawn(blocks: DataFrame, draw: int) -> DataFrame:
    """The first draw rows of all runs of blocks in their order, with ranks."""
    ranges = blocks.groupBy("range").agg(F.sum("n"), F.count_distinct("run")).orderBy("range").collect()  # RANGES at most
    plan, base = [], 0
    for r, n, runs in ranges:
        if base < draw:
            plan.append((r, min(FAN_IN, runs), min(n, draw - base), base))
        base += n
    blocks = fewer_runs(blocks.filter(F.col("range") <= plan[-1][0]), max(runs for r, _, runs in ranges if r <= plan[-1][0]))
    at = F.col("range")
    told = [F.element_at(F.create_map(*(F.lit(x) for p in plan for x in (p[0], p[i]))), at).alias(name) for i, name in ((1, "runs"), (2, "owed"), (3, "base"))]
    dealt = _dealt(blocks.select("*", F.lit(0).alias("group"), *told), len(plan))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, runs, owed, rank), stream in _streams(rows):
            held = []
            for keys, weight in merged(stream, runs, owed):
                held += [(*k, w) for k, w in zip(keys, weight, strict=True)]
                if len(held) >= BLOCK_ROWS:
                    yield _ranked(held, rank)
                    rank, held = rank + len(held), []
            if held:
                yield _ranked(held, rank)

    return dealt.mapInArrow(run, "doc_id long, n_features long, weight long, score long, row long, rank long")


def _ranked(held: list[tuple], rank: int) -> pa.RecordBatch:
    score, missing, doc_id, n_features, row, weight = zip(*held, strict=True)
    columns = [pa.array(doc_id, pa.int64(), mask=np.array(missing, bool)), *(pa.array(c, pa.int64()) for c in (n_features, weight, [-s for s in score], row)), pa.array(np.arange(rank + 1, rank + 1 + len(held)))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "score", "row", "rank"])


# ---- the draw ----------------------------------------------------------------------------------


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select((-F.col("score")).alias("score"), F.col("doc_id").isNull().cast("int").alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_features", "row", "weight")


def _cuts(keys: DataFrame, rows: int, draw: int, range_rows: int) -> list[Key]:
    """Keys that cut the drawn part of the order about evenly, from a sample of about MOST_SAMPLED keys at most."""
    wanted = min(RANGES, -(-draw // range_rows))
    part = min(1.0, wanted * SAMPLED / draw, MOST_SAMPLED / rows)
    sample = sorted(tuple(r) for r in keys.select(*KEY).sample(part, seed=1).collect())
    top = len(sample) * draw / rows
    return [sample[int(top * (i + 1) / wanted)] for i in range(wanted) if int(top * (i + 1) / wanted) < len(sample)]


def after(cut: Key) -> Column:
    """Whether a row of _keys() comes after a key."""
    out = F.lit(False)
    for name, value in reversed(list(zip(KEY, cut, strict=True))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, most: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each of docs(doc_id, text) with its features, weight, score, and the rank at which it is drawn to be like
    target(text), if it is: percent of the documents with the least number of words are."""
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    rows = stage(scored(docs, gain, most, seed, least).withColumn("row", F.monotonically_increasing_id()), "scored")
    many = rows.filter("eligible").count()
    draw = many * percent // 100
    result = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not draw:
        return rows.select(*result, undrawn)
    keys = _keys(rows.filter("eligible"))
    blocks = stage(sorted_runs(keys, _cuts(keys, many, draw, range_rows)), "runs")
    first = stage(drawn(blocks, draw), "drawn")
    last = _keys(first.filter(F.col("rank") == draw)).first()
    return first.select(*result, "rank").unionByName(_rest(rows, tuple(last[name] for name in KEY)).select(*result, undrawn))


def _rest(rows: DataFrame, last: Key) -> DataFrame:
    """The rows that the draw leaves: too short, or after the last one drawn."""
    short = rows.filter("not eligible").select("doc_id", "n_features", "weight", "score")
    return short.unionByName(
        _keys(rows.filter("eligible")).filter(after(last))
        .select(F.when(F.col("missing") == 0, F.col("doc_id")).alias("doc_id"), "n_features", "weight", (-F.col("score")).alias("score"))
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
OP13_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
    crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS of_byte FROM range(256) t(n)),
    source AS (SELECT row, unnest(words) AS w FROM docs), target AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
    bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: 16 * instr('123456789ABCDEF', substr(hex(encode(w)), 2 * i + 1, 1)) + instr('123456789ABCDEF', substr(hex(encode(w)), 2 * i + 2, 1))) AS b
              FROM (SELECT w FROM source UNION SELECT w FROM target)),
    bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
    s AS (SELECT bucket, count(*) AS s FROM source JOIN bucket USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM target JOIN bucket USING (w) GROUP BY bucket),
    totals AS (SELECT (SELECT count(*) FROM source)::DOUBLE + {BUCKETS} AS all_s, (SELECT count(*) FROM target)::DOUBLE + {BUCKETS} AS all_t),
    gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * all_s / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
    weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM source JOIN bucket USING (w) JOIN gain USING (bucket) GROUP BY row),
    scored AS (SELECT row, doc_id, len(words) AS n, coalesce(weight, 0) AS weight,
                      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
               FROM docs LEFT JOIN weights USING (row)),
    ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS rank, count(*) OVER () AS many FROM scored WHERE n >= {LEAST_WORDS})
    SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= {PERCENT} * many // 100 THEN rank END::BIGINT AS rank
    FROM scored LEFT JOIN ranked USING (row)
"""
