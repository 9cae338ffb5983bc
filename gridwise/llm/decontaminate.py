"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Texts are lower-cased (A-Z) words; a window or item is the multiset of its five-word shingles (a shorter item:
its whole sequence), weighted by how often each occurs. Weighted similarity is the sum of smaller weights
over the sum of larger ones; from SIMILARITY on, a document leaks an item.

Windows have as many words as an item (a shorter document is one window). A window can only reach the
similarity if enough of its shingles are items' shingles of that length, so only such windows are
fingerprinted: 64 bits, the signs of the weighted sum of shingle hash bits, a piece of the text at a time. Fingerprints are
cut into BLOCKS of 8 bits, each indexed with all values within radius // BLOCKS bits: if two fingerprints differ in at most
radius bits, some block differs in no more than that. What the blocks find within the radius is verified exactly.

The radius follows the numbers of shingles: where no shingle repeats in window or item, a bit of theirs differs at the
threshold with a probability that follows from how many they share, so the radius is the least that one pair in 1 / MISS
exceeds (0 bits up to six shingles, where only equal ones are similar; 18 to 23 beyond). A repeated shingle weighs more than one
and turns more bits, so with any in window or item it is RADIUS. tests/llm/test_radius.py measures what is found at the
threshold and how many unrelated items are verified.

Items are the stated query set; they are compared in blocks of ITEMS_AT_ONCE, a bounded index that goes
along with the task. Documents are read without a shuffle, once a block; with several blocks each one's result is a
table in the shared folder, so the driver holds one block at a time.

Null and empty texts and items leak nothing; a text of any length is searched whole; repeated rows of documents and
items each give rows; of equally similar windows the first is reported; empty tables give an empty result; other
columns are ignored by leaks(), whatever their names, and kept by without_leaks().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from itertools import islice
from math import ceil, comb, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.llm.common import Words, passes, read, stage, strings, tidy

SHINGLE, SIMILARITY = 5, 0.75
RADIUS, BLOCKS = 31, 8
MISS, PIECE = 1e-4, 1 << 14
ITEMS_AT_ONCE = 20_000
_FOUND = "doc_id long, item_id long, similarity double, first_word long, window_words long, n_windows long"
_FILTER_BITS = 22


def _bits(h: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each hash."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1)


def _prints(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows of width shingles that begin at starts (ascending)."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + PIECE, "right"))
        lo = int(starts[i])
        bits = _bits(grams[lo : int(starts[j - 1]) + width])
        sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
        out[i:j] = _fingerprints(sums[starts[i:j] - lo + width] - sums[starts[i:j] - lo])
        i = j
    return out


def _needed(width: int, n: int) -> int:
    """Shingles that a window of width and an item of n have to share: smaller weights >= 3/7 of both sizes."""
    return max(1, ceil(SIMILARITY / (1 + SIMILARITY) * (width + n) - 1e-9))


def _signs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of n signs, and their probabilities."""
    return 2 * np.arange(n + 1) - n, np.exp([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2) for k in range(n + 1)])


def _differs(common: int, a: int, b: int) -> float:
    """How likely a bit of two fingerprints differs: sums of common signs, and of a or b more of their own, of which one
    is positive."""
    at, weight = _signs(common)

    def positive(n: int) -> np.ndarray:
        own, p = _signs(n)
        above = np.concatenate((np.cumsum(p[::-1])[::-1], [0.0]))  # of sums from the i-th on
        return above[np.searchsorted(own, -at, "right")]

    x, y = positive(a), positive(b)
    return float((weight * (x * (1 - y) + (1 - x) * y)).sum())


@cache
def radius(width: int, n: int) -> int:
    """The bits in which a window of width distinct shingles and an item of n at the threshold differ at most, but for MISS."""
    least, most = _needed(width, n), min(width, n)
    if least > most:
        return 0
    p = max(_differs(c, width - c, n - c) for c in {least, min(least + 1, most)})  # even sums are ties: parity counts
    tail, r = 1.0, -1
    while tail > MISS and r < RADIUS:
        r += 1
        tail -= comb(64, r) * p**r * (1 - p) ** (64 - r)
    return r


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets."""
    less = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return less / (sum(a.values()) + sum(b.values()) - less) if less else 0.0


class Index:
    """Items by length: their shingles, fingerprints and blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.by_size, self.short = [], {}, {}
        owners: dict[int, set[int]] = {}
        (whole,) = passes(pa.array([t or "" for _, t in items], pa.string()), 1 << 40)
        words = Words(whole[2], whole[3])
        h = words.hashes(lower=True)
        at, grams = words.ngrams(h, SHINGLE)
        cut = np.searchsorted(words.doc[at], np.arange(len(items) + 1))
        for i, (item_id, _) in enumerate(items):
            size = int(words.count[i])
            if size == 0:
                continue
            mine = grams[cut[i] : cut[i + 1]]
            if size < SHINGLE:
                self.short.setdefault(size, []).append((_one_gram(h[words.first[i] : words.first[i + 1]]), item_id))
                continue
            k = len(self.items)
            self.items.append((item_id, Counter(mine.tolist()), int(_fingerprints(_bits(mine).sum(0, keepdims=True))[0])))
            self.by_size.setdefault(size, []).append(k)
            for g in mine.tolist():
                owners.setdefault(g, set()).add(size)
        self.known = np.array(sorted(owners), np.uint64)
        sizes = [sorted(owners[g]) for g in self.known.tolist()]
        self.size_at = np.concatenate(([0], np.cumsum([len(x) for x in sizes]))).astype(np.int64)
        self.sizes = np.array([s for x in sizes for s in x], np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.blocks = {}
        for size, members in self.by_size.items():
            plain = [max(self.items[k][1].values()) == 1 for k in members]
            for distinct in (True, False):
                some = [k for k, x in zip(members, plain, strict=True) if x == distinct]
                if some:
                    self.blocks.setdefault(size, {})[distinct] = (np.array(some), np.array([self.items[k][2] for k in some], np.uint64))
        self.tables: dict[tuple, list] = {}
        self.short = {size: _by_hash(members) for size, members in self.short.items()}

    def near(self, size: int, fingerprint: np.uint64, width: int, distinct: bool) -> list[int]:
        """Items of a size whose fingerprint is within the radius of a window's (of width shingles, without repeated ones if
        distinct), by their blocks."""
        out: list[int] = []
        own = np.array([fingerprint], np.uint64).view(np.uint8)
        for plain, (members, prints) in self.blocks[size].items():
            r = radius(width, size - SHINGLE + 1) if plain and distinct else RADIUS
            tables = self._tables(size, plain, r // BLOCKS)
            found = np.unique(np.concatenate([tables[b][own[b]] for b in range(BLOCKS)]))
            out += members[found[np.bitwise_count(prints[found] ^ fingerprint) <= r]].tolist()
        return out

    def _tables(self, size: int, plain: bool, bits: int) -> list:
        """For each block and value the items of a size whose block is within bits of it; made where first used."""
        if (size, plain, bits) not in self.tables:
            values = np.arange(256, dtype=np.uint8)
            close = np.bitwise_count(values[:, None] ^ values) <= bits
            mine = self.blocks[size][plain][1].view(np.uint8).reshape(-1, BLOCKS)
            self.tables[size, plain, bits] = [[np.flatnonzero(close[v][mine[:, b]]) for v in range(256)] for b in range(BLOCKS)]
        return self.tables[size, plain, bits]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some shingles an item has: their places, and their numbers in known."""
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        on = self.known[k] == grams[at]
        return at[on], k[on]

    def leaks(self, grams: np.ndarray, at: np.ndarray, k: np.ndarray, n_words: int) -> dict[int, tuple]:
        """Of one document, by its shingles and hits: item -> (similarity, first word, words, windows)."""
        out: dict[int, list] = {}
        n = self.size_at[k + 1] - self.size_at[k]
        sizes = self.sizes[np.repeat(self.size_at[k] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))]
        places = np.repeat(at, n)
        # A window holds a shingle twice if the latest earlier place of any shingle up to its end lies within it.
        order = np.argsort(grams, kind="stable")
        before = np.full(len(grams), -1, np.int64)
        same = grams[order[1:]] == grams[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        before = np.maximum.accumulate(before)
        for size in np.unique(sizes).tolist():
            width = min(size, n_words) - SHINGLE + 1  # shingles of a window
            hit = np.zeros(len(grams) + 1, np.int32)
            hit[places[sizes == size] + 1] = 1
            hit = np.cumsum(hit)
            starts = np.flatnonzero(hit[width:] - hit[:-width] >= _needed(width, size - SHINGLE + 1))
            if not len(starts):
                continue
            distinct = before[starts + width - 1] < starts
            for i, p, single in zip(starts.tolist(), _prints(grams, starts, width), distinct.tolist(), strict=True):
                near = self.near(size, p, width, single)
                if not near:
                    continue
                window = Counter(grams[i : i + width].tolist())
                for item in near:
                    s = similarity(window, self.items[item][1])
                    if s >= SIMILARITY:
                        best = out.setdefault(item, [-1.0, 0, 0, 0])
                        best[3] += 1
                        if s > best[0]:
                            best[:3] = [s, i, width + SHINGLE - 1]
        return out


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows = batch.column(0), strings(batch.column(1)), []
            for lo, hi, data, off in passes(texts):
                words = Words(data, off)
                h = words.hashes(lower=True)
                at, grams = words.ngrams(h, SHINGLE)
                hit, k = index.hits(grams)
                doc = words.doc[at]
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                where = doc[hit]
                cut = np.searchsorted(where, np.arange(hi - lo + 1))
                for d in np.unique(where).tolist():
                    i, j, a, b = cut[d], cut[d + 1], first[d], first[d + 1]
                    for item, found in index.leaks(grams[a:b], hit[i:j] - a, k[i:j], int(words.count[d])).items():
                        rows.append((ids[lo + d].as_py(), index.items[item][0], *found))
                for size, (known, items) in index.short.items():
                    at, grams = words.ngrams(h, size)
                    k = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    on = np.flatnonzero(known[k] == grams)
                    seen: dict[tuple[int, int], list[int]] = {}
                    for d, item, start in zip(words.doc[at[on]].tolist(), k[on].tolist(), at[on].tolist(), strict=True):
                        seen.setdefault((d, item), [start, 0])[1] += 1
                    for (d, item), (start, n) in seen.items():
                        rows += [(ids[lo + d].as_py(), item_id, 1.0, int(start - words.first[d]), size, n) for item_id in items[item]]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    return tidy(run)


def _clean(index: Index, at: int):
    """Rows whose text, column at, leaks no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(index)
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            keep = np.ones(batch.num_rows, bool)
            for found in search([pa.RecordBatch.from_arrays([ids, batch.column(at)], ["doc_id", "text"])]):
                keep[found.column(0).to_numpy()] = False
            yield batch.filter(pa.array(keep))

    return tidy(run)


def _by_hash(members: list[tuple[np.uint64, int]]) -> tuple[np.ndarray, list[list[int]]]:
    """The distinct hashes in order, and the items of each."""
    items: dict[int, list[int]] = {}
    for h, item_id in members:
        items.setdefault(int(h), []).append(item_id)
    return np.array(sorted(items), np.uint64), [items[h] for h in sorted(items)]


def _one_gram(h: np.ndarray) -> np.uint64:
    """The hash that Words.ngrams gives a run of these words."""
    w = Words(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    w.doc = np.zeros(len(h), np.int64)
    return w.ngrams(h, len(h))[1][0]


def indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """The items of benchmark(item_id, text), ITEMS_AT_ONCE in an index, and whether it is the last one."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()
    block = list(islice(rows, ITEMS_AT_ONCE))
    while block:
        following = list(islice(rows, ITEMS_AT_ONCE))
        yield Index([(r[0], r[1]) for r in block]), not following
        block = following


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, window_words, n_windows) of every leak of
    benchmark(item_id, text) in docs(doc_id, text): the most similar window and the number of windows."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [text.mapInArrow(_search(index), _FOUND) if last else stage(text.mapInArrow(_search(index), _FOUND), "leaks") for index, last in indexes(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], _FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item of the benchmark."""
    at = docs.columns.index("text")
    for index, last in indexes(benchmark):
        docs = docs.mapInArrow(_clean(index, at), docs.schema)
        docs = docs if last else stage(docs, "without-leaks")
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
