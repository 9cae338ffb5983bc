"""Substring dedup: repeated runs of words, by difference-cover anchors.

A window is WIDTH consecutive words of one document. Every word inside a window whose word sequence also
starts earlier (in a smaller document, or earlier in the same one) is removed; windows are judged on the
input.

Anchors are ANCHOR-word hashes at the positions that COVER holds modulo PERIOD. For any two positions
some shift below PERIOD brings both onto the cover, so two equal windows share an anchor at the same
place inside them (WIDTH = ANCHOR + PERIOD - 1). Only windows around an anchor that occurs twice can
repeat; these are extended to the whole window and compared by its hash: one shuffle of anchors, one of
windows (64 bits, with 32 bits of a second hash beside them; anchors need only be candidates). Each pass first merges equal values within a task, so a passage that many documents share
sends one entry a task, and the entries travel as packed arrays in buckets whose number follows
the size of the corpus. A window travels with the smallest of its inner anchors, as its neighbours mostly
do, so repeats come back as runs.

Null and empty texts, and texts of fewer than WIDTH words, lose nothing; repeated doc_ids are told apart
by text (equal rows one after another), a null doc_id comes first; a text of any length is one pass; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.llm.common import Words, bucket_count, covered, mix, numbered, passes, read, scattered, strings, unpack_all

WIDTH, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WIDTH - PERIOD + 1
#: Entries that a task gathers before it sends them.
GATHER = 1_500_000

_COVERED = np.zeros(PERIOD, bool)
_COVERED[list(COVER)] = True
_ENTRIES = "bucket int, key binary, check binary, doc binary, at binary, known_doc binary, known_at binary"


def _new(keys: np.ndarray, check: np.ndarray | None) -> np.ndarray:
    """Where another key begins, of keys in order."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if check is not None:
        new[1:] |= check[1:] != check[:-1]
    return new


def _sent(keys: np.ndarray, docs: np.ndarray, at: np.ndarray, home: np.ndarray, buckets: int, mark_first: bool, check: np.ndarray | None = None) -> pa.RecordBatch:
    """One entry for each distinct key (with its check), the earliest; the others go, already known to repeat, with
    their document. mark_first: the earliest of several is known to repeat too."""
    order = np.lexsort((at, docs, keys) if check is None else (at, docs, check, keys))
    keys, docs, at, home = keys[order], docs[order], at[order], home[order]
    check = None if check is None else check[order]
    first = _new(keys, check)
    known = ~first
    if mark_first and len(keys):
        known = known | np.append(known[1:], False)
    sent = [keys[first], docs[first], at[first]] + ([] if check is None else [check[first]])
    b1, (k, d, a, *c) = scattered((home[first] % np.uint64(buckets)).astype(np.int64), sent)
    kb = (mix(docs[known].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    b2, (kd, ka) = scattered(kb, [docs[known], at[known]])
    none = [None] * len(b2)
    return pa.RecordBatch.from_arrays(
        [pa.array(b1 + b2, pa.int32()), *(pa.array(x, pa.binary()) for x in (k + none, (c[0] if c else [None] * len(b1)) + none, d + none, a + none, [None] * len(b1) + kd, [None] * len(b1) + ka))],
        ["bucket", "key", "check", "doc", "at", "known_doc", "known_at"],
    )


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), strings(batch.column(1))
            for lo, hi, data, off in passes(texts):
                words = Words(data, off)
                at, grams = words.ngrams(words.hashes(), ANCHOR)
                place = at - words.first[words.doc[at]]
                on = _COVERED[place % PERIOD]
                held.append((grams[on], ids[lo:hi][words.doc[at[on]]], place[on].astype(np.int32)))
                n += int(on.sum())
                if n >= GATHER:
                    keys, docs, where = map(np.concatenate, zip(*held, strict=True))
                    yield _sent(keys, docs, where, keys >> np.uint64(20), buckets, True)
                    held, n = [], 0
        if n:
            keys, docs, where = map(np.concatenate, zip(*held, strict=True))
            yield _sent(keys, docs, where, keys >> np.uint64(20), buckets, True)

    return run


def _twice(group: pd.DataFrame) -> pd.DataFrame:
    """Anchors of a bucket that occur more than once."""
    keys, docs, at = (unpack_all(group[c], t) for c, t in (("key", np.uint64), ("doc", np.int64), ("at", np.int32)))
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:].copy() if len(k) else same[1:]
    on = order[same]
    return pd.DataFrame({"row_id": np.concatenate((docs[on], unpack_all(group["known_doc"], np.int64))), "at": np.concatenate((at[on], unpack_all(group["known_at"], np.int32)))})


def _windows(buckets: int):
    """Windows around repeated anchors, of rows (doc_id, row_id, text, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            if not batch.num_rows:
                continue
            ids, texts, anchors = batch.column(1).to_numpy(zero_copy_only=False), strings(batch.column(2)), batch.column(3)
            sizes = anchors.value_lengths().to_numpy(zero_copy_only=False)
            where = anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate(([0], np.cumsum(sizes)))
            for lo, hi, data, off in passes(texts):
                words = Words(data, off)
                h = words.hashes()
                inner_at, inner = words.ngrams(h, ANCHOR)
                starts, keys = words.ngrams(h, WIDTH, base=0x8CB92BA72F3D8DD7)
                if not len(starts):
                    continue
                check = (words.ngrams(mix(h + np.uint64(0x2545F4914F6CDD1D)), WIDTH)[1] >> np.uint64(32)).astype(np.uint32)
                marked = np.repeat(words.first[np.arange(hi - lo)], sizes[lo:hi]) + where[before[lo] : before[hi]]
                near = np.zeros(len(words) + PERIOD, np.int32)  # windows that hold a repeated anchor begin up to PERIOD - 1 words before it
                np.add.at(near, marked + 1, -1)
                np.add.at(near, np.maximum(marked - PERIOD + 1, 0), 1)
                on = np.cumsum(near)[starts] > 0
                smallest = np.full(len(words) + WIDTH, np.iinfo(np.uint64).max, np.uint64)
                smallest[inner_at] = inner
                for step in (1, 2, 4, 5):  # minima over 1+1, 2+2, 4+4 and 8+5 places
                    smallest[: len(smallest) - step] = np.minimum(smallest[: len(smallest) - step], smallest[step:])
                starts, keys = starts[on], keys[on]
                doc = words.doc[starts]
                held.append((keys, ids[lo:hi][doc], (starts - words.first[doc]).astype(np.int32), smallest[starts], check[on]))
                n += len(starts)
                if n >= GATHER:
                    *found, check = map(np.concatenate, zip(*held, strict=True))
                    yield _sent(*found, buckets, False, check)
                    held, n = [], 0
        if n:
            *found, check = map(np.concatenate, zip(*held, strict=True))
            yield _sent(*found, buckets, False, check)

    return run


def _later(group: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows of a bucket that have an equal, earlier one."""
    keys, check, docs, at = (unpack_all(group[c], t) for c, t in (("key", np.uint64), ("check", np.uint32), ("doc", np.int64), ("at", np.int32)))
    order = np.lexsort((at, docs, check, keys))
    on = order[~_new(keys[order], check[order])]
    docs = np.concatenate((docs[on], unpack_all(group["known_doc"], np.int64)))
    at = np.concatenate((at[on], unpack_all(group["known_at"], np.int32))).astype(np.int64)
    order = np.lexsort((at, docs))
    docs, at = docs[order], at[order]
    head = np.concatenate(([True], (docs[1:] != docs[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(head)
    return pd.DataFrame({"row_id": docs[begin], "start": at[begin].astype(np.int32), "n": np.diff(np.concatenate((begin, [len(at)]))).astype(np.int32)})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, runs = strings(batch.column(2)), batch.column(3).to_pylist()
        for lo in range(0, len(texts), 500):
            n_words, n_removed, kept = [], [], []
            for text, run in zip(texts.slice(lo, 500).to_pylist(), runs[lo : lo + 500], strict=True):
                words = text.encode().split()
                n_words.append(len(words))
                if run:
                    stay = np.ones(len(words), bool)
                    for r in run:
                        stay[r["start"] : r["start"] + r["n"] + WIDTH - 1] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) without repeated windows: doc_id, n_words, n_removed, kept (words left, one space between)."""
    buckets = bucket_count(docs)
    rows = numbered(docs).withColumn("row_id", F.coalesce("row_id", F.lit(int(np.iinfo(np.int64).min))))
    twice = rows.select("row_id", "text").mapInArrow(_anchors(buckets), _ENTRIES).groupBy("bucket").applyInPandas(_twice, "row_id long, at int")
    anchors = twice.groupBy("row_id").agg(F.collect_list("at").alias("anchors"))
    # both joins take the same columns of the documents, so that their texts are shuffled once
    near = rows.join(anchors, "row_id", "left").select("doc_id", "row_id", "text", "anchors")
    later = near.mapInArrow(_windows(buckets), _ENTRIES).groupBy("bucket").applyInPandas(_later, "row_id long, start int, n int")
    runs = later.groupBy("row_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return rows.join(runs, "row_id", "left").select("doc_id", "row_id", "text", "runs").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
    WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
    f AS (SELECT s, min((doc_id, i)) AS m FROM g GROUP BY s),
    c AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS j FROM g JOIN f USING (s) WHERE (doc_id, i) <> m),
    k AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)
"""
