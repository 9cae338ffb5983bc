"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct five-word shingles (A-Z lower-cased). Two documents link when
100 * intersection >= 75 * union, which bounds their symmetric difference: (s + t) // 7 for sizes s and t.

Sizes fall into bands [2**j, 2**(j+1)). A band has a fixed partition of the shingle domain into parts, and of every
part into CELLS cells. Of each part a document's signatures are the contents of the subsets of CELLS - 1 cells:
every subset is enumerated, empty contents and repeated ones left out (its own band's, and the next band's where a
partner may be that large). Two documents that differ by one shingle in a part still agree on the subset that leaves its
cell out; only a second difference in the part can cost the last one. There are more parts than half the largest
difference of the band breaks, so linked documents share a signature.

How many they share at least follows from a document's own parts. Let a of its parts have several non-empty cells
(CELLS signatures each) and b one (a single signature). The first difference in a part of the former kind costs at
most CELLS - 1 signatures, the second one more; in one of the latter kind the only one. So a linked partner of
difference k shares at least

    least = CELLS a + b - (CELLS - 1) min(k, a) - min(max(k - a, 0), a + b)

signatures. This count is used twice, without loss:

* a document with fewer than least signatures that anyone else has can have no partner;
* every document leaves out its least - 1 commonest signatures (by count, then hash, an order that all
  documents agree on): the rarest one that a pair shares stays in both.

So a passage that many documents share drops out before any pair is formed. Copies of one set are one class
with one representative. What is left is verified exactly: first each member of a signature against its
smallest member; then, where the members of such stars still lie in several components, pairs across these
that share rare differences from the first one's root (see across()). Groups are never expanded into all pairs.

A document with least <= 0 by chance of hashing ("weak"; with the parts used here its mean is eight or more deviations
above, at every size) is compared with all documents that share a shingle with it.

Texts without words (and null ones) have an empty set, link with nothing and are their own component;
shorter texts than five words have their whole sequence as one shingle; a text of any length is one set, in memory
once; repeated doc_ids are separate rows, also with equal texts; empty tables give empty results; other columns are
ignored, whatever their names, and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridwise.llm.common import Words, bucket_count, components, mix, numbered, passes, read, scattered, shingle_sets, stage, strings, tidy, tidy_group, unpack_all

SHINGLE, PERCENT = 5, 75
#: Cells of a part; subsets of all but one of them are signatures. (With more cells, a part of few filled cells would have
#: fewer distinct subsets than least_shared() counts.)
CELLS = 3
#: Signatures that a task gathers before it sends them, bytes of text in a pass, and of sets in a batch that goes out.
GATHER, PASS, SENT = 500_000, 1 << 19, 4 << 20
_ROWS = "kind int, row_id long, a long, b long, n int, least0 int, least1 int"


def parts(band: np.ndarray) -> np.ndarray:
    """Parts of the domain for sizes from 2**band."""
    low = np.left_shift(np.int64(1), band)
    return np.where(band < 4, 256, np.where(band < 6, 4 * low, np.where(band < 8, (7 * low + 9) // 10, (9 * low + 19) // 20)))


def least_shared(several: np.ndarray, single: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Signatures that a partner of difference k shares at least with a document of these parts."""
    return CELLS * several + single - (CELLS - 1) * np.minimum(k, several) - np.minimum(np.maximum(k - several, 0), several + single)


def _signatures(doc: np.ndarray, grams: np.ndarray, band: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct contents of each document's subsets of CELLS - 1 cells of a part, under its band's partition:
    document, signature, and for each document the number that a partner of difference k shares at least."""
    docs = len(band)
    width = parts(band)
    base = np.concatenate(([0], np.cumsum(width)))
    cell = (mix(grams + band[doc].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(11)) % (width[doc] * CELLS).astype(np.uint64)
    at = base[doc] * CELLS + cell.astype(np.int64)
    content, filled = np.zeros(int(base[-1]) * CELLS, np.uint64), np.zeros(int(base[-1]) * CELLS, bool)
    np.add.at(content, at, mix(grams ^ np.uint64(0x9FB21C651E98DF25)))
    filled[at] = True
    used = np.flatnonzero(filled.reshape(-1, CELLS).any(axis=1))
    content, filled = content.reshape(-1, CELLS)[used], filled.reshape(-1, CELLS)[used]
    several = filled.sum(axis=1) > 1
    kept = np.ones(filled.shape, bool)  # by the cell left out: with one cell filled, all other subsets are the same
    kept[~several] = False
    kept[np.flatnonzero(~several), (filled[~several].argmax(axis=1) + 1) % CELLS] = True
    which, left_out = np.nonzero(kept)
    whole = content.sum(axis=1)
    owner = np.searchsorted(base, used, side="right") - 1
    number = (used - base[owner]).astype(np.uint64)
    place = mix(number * np.uint64(64) + band[owner].astype(np.uint64))
    sig = mix(whole[which] - content[which, left_out] + place[which])
    count = lambda on: np.bincount(owner[on], minlength=docs)
    return owner[which], sig, least_shared(count(several), count(~several), k)


def differences(size: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest difference from a linked partner of the same band, and of any size."""
    top = size * 100 // PERCENT
    return (size + np.minimum(top, np.left_shift(np.int64(2), band) - 1)) // 7, (size + top) // 7


def bands(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each size, and whether a larger partner may lie in the next."""
    band = np.frexp(np.maximum(size, 1).astype(float))[1].astype(np.int64) - 1
    return band, (size > 0) & (size * 100 >= PERCENT * np.left_shift(np.int64(1), band + 1))


def _deal(buckets: int):
    """Per task: (bucket, packed signatures and documents) and (bucket, packed facts of documents)."""

    def send(held: list, facts: list) -> pa.RecordBatch:
        names = ["bucket", "sig", "doc", "next", "f_doc", "f_one", "f_two", "f_n", "f_least0", "f_least1"]
        doc, one, two, size, least0, least1 = map(np.concatenate, zip(*facts, strict=True))
        order = np.lexsort((doc, two, one))  # of equal sets in this task, the smallest document speaks for all
        same = np.zeros(len(doc), bool)
        same[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        owner, sig, nxt = map(np.concatenate, zip(*held, strict=True))
        on = ~same[owner]
        owner, sig, nxt = owner[on], sig[on], nxt[on]
        b1, (s, d, x) = scattered((sig >> np.uint64(32)).astype(np.int64) % buckets, [sig.astype(np.uint32), doc[owner], nxt])
        b2, f = scattered((mix(one) % np.uint64(buckets)).astype(np.int64), [doc, one, two, size.astype(np.int32), least0.astype(np.int32), least1.astype(np.int32)])
        none1, none2 = [None] * len(b1), [None] * len(b2)
        return pa.RecordBatch.from_arrays([pa.array(b1 + b2, pa.int32()), *(pa.array(c + none2, pa.binary()) for c in (s, d, x)), *(pa.array(none1 + c, pa.binary()) for c in f)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, facts, n, seen = [], [], 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), strings(batch.column(1))
            for lo, hi, data, off in passes(texts, PASS):
                doc, grams = shingle_sets(Words(data, off), SHINGLE)
                docs = hi - lo
                size = np.bincount(doc, minlength=docs)
                one, two = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
                np.add.at(one, doc, mix(grams + np.uint64(1)))
                np.add.at(two, doc, mix(grams ^ np.uint64(0xC2B2AE3D27D4EB4F)))
                one, two = mix(one + size.astype(np.uint64)), mix(two)
                band, wide = bands(size)
                k0, k1 = differences(size, band)
                owner, sig, least0 = _signatures(doc, grams, band, k0)
                held.append((owner + seen, sig, np.zeros(len(sig), np.uint8)))
                big = wide[doc]
                owner, sig, least1 = _signatures(doc[big], grams[big], np.where(wide, band + 1, 0), k1)
                held.append((owner + seen, sig, np.ones(len(sig), np.uint8)))
                facts.append((ids[lo:hi], one, two, size, least0, least1))
                n, seen = n + len(held[-1][1]) + len(held[-2][1]), seen + docs
                if n >= GATHER:
                    yield send(held, facts)
                    held, facts, n, seen = [], [], 0, 0
        if facts:
            yield send(held, facts)

    return tidy(run)


_DEALT = "bucket int, sig binary, doc binary, next binary, f_doc binary, f_one binary, f_two binary, f_n binary, f_least0 binary, f_least1 binary"


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: kind 1, documents' facts (set hashes a, b); kind 0, signatures a that several documents
    have, with their number b, for each of them (n: 1 in the next band's partition)."""
    bucket = int(group["bucket"].iloc[0]) if len(group) else 0
    sig = unpack_all(group["sig"], np.uint32)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    on, same = np.zeros(len(sig), bool), sig[1:] == sig[:-1]
    on[1:] |= same
    on[:-1] |= same
    at, sig = order[on], sig[on]
    del order, same, on
    cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((cut, [len(sig)])))
    count, zero = np.repeat(size, size), np.zeros(len(sig), np.int32)
    doc, nxt = unpack_all(group["doc"], np.int64)[at], unpack_all(group["next"], np.uint8)[at]
    facts = {c: unpack_all(group["f_" + c], t) for c, t in (("doc", np.int64), ("one", np.uint64), ("two", np.uint64), ("n", np.int32), ("least0", np.int32), ("least1", np.int32))}
    return pd.DataFrame({
        "kind": np.concatenate((zero, np.ones(len(facts["doc"]), np.int32))),
        "row_id": np.concatenate((doc, facts["doc"])),
        "a": np.concatenate(((np.int64(bucket) << 32) | sig.astype(np.int64), facts["one"].view(np.int64))),
        "b": np.concatenate((count, facts["two"].view(np.int64))),
        "n": np.concatenate((nxt.astype(np.int32), facts["n"])),
        "least0": np.concatenate((zero, facts["least0"])),
        "least1": np.concatenate((zero, facts["least1"])),
    })


def prune(members: DataFrame) -> DataFrame:
    """members(sig, row_id, next_band, count, least) that can still bring a partner."""
    own = Window.partitionBy("row_id", "next_band")
    ranked = members.withColumn("held", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("count"), F.desc("sig"))))
    return ranked.filter("held >= least and rank > least - 1").drop("held", "rank")


def _set(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for i in range(b.num_rows):
            x, y = _set(b.column(2), i), _set(b.column(3), i)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    return _both_sets(pairs, sets).mapInArrow(tidy(_verified), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column(1))
        for lo, hi, data, off in passes(texts, PASS):
            doc, grams = shingle_sets(Words(data, off), SHINGLE)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([grams[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["row_id", "grams"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "linked", "na", "nb", "e", "delta"]
    for b in batches:
        first, linked, na, nb, deltas, size = 0, [], [], [], [], 0
        for i in range(b.num_rows):
            x, y = _set(b.column(2), i), _set(b.column(3), i)
            delta = np.setxor1d(x, y, assume_unique=True)
            linked.append(7 * len(delta) <= len(x) + len(y))
            na.append(len(x))
            nb.append(len(y))
            deltas.append(delta.view(np.int64))
            size += delta.nbytes
            if size >= SENT or i == b.num_rows - 1:
                part = b.slice(first, i + 1 - first)
                counts = (pa.array(c, pa.int32()) for c in (na, nb, list(map(len, deltas))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_()), *counts, pa.array(deltas, pa.list_(pa.int64()))], names)
                first, linked, na, nb, deltas, size = i + 1, [], [], [], [], 0


def _both_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    right = pairs.join(sets.select(F.col("row_id").alias("b"), F.col("grams").alias("right")), "b")
    return right.join(sets.select(F.col("row_id").alias("a"), F.col("grams").alias("left")), "a").select("a", "b", "left", "right")


def judge(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with linked, both sizes, and delta, what is in one of the sets only (e: how many)."""
    return _both_sets(pairs, sets).mapInArrow(tidy(_judged), "a long, b long, linked boolean, na int, nb int, e int, delta array<long>")


def across(judged: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) between components, of members b of the same centre a.

    Members x and y of a centre differ from each other by the symmetric difference of their deltas from it, so
    linked members have deltas of which at least (e + f - (s + t) / 7) / 2 elements agree (e and f being the
    deltas' sizes, s and t the sets'). That is at least 1 unless both are linked with the centre, when nothing is
    left to find. For every band of f, a member keeps the rarest of its delta's elements, all but as many as must
    agree less one; linked members keep a common one. Near copies of one text thus meet where they share rare
    edits, not because they share the text."""
    label = found.select(F.col("id").alias("b"), "component")
    members = judged.drop("delta").join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    members = stage(members.withColumn("band", F.floor(F.log2("e") * 3 + 1e-9).cast("int")), "members")
    bands = members.groupBy("a").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.collect_set("band").alias("all"), F.collect_set(F.when(~F.col("linked"), F.col("band"))).alias("loose"),  # some dozens a centre
    ).filter("lo < hi").drop("lo", "hi")
    # a table of its own: the members of a large centre then only meet a row each, and may be split
    bands = stage(bands, "bands")

    def partner(band: Column) -> Column:
        low, high = F.floor(F.pow(F.lit(2.0), band / 3) - 1e-6), F.ceil(F.pow(F.lit(2.0), (band + 1) / 3) + 1e-6)
        largest = F.least(F.expr(f"nb * 100 div {PERCENT}"), F.col("na") + high)
        agree = F.greatest(F.lit(1), F.ceil((F.col("e") + low - (F.col("nb") + largest) / 7) / 2 - 1e-9))
        keep = F.when(agree <= F.least(F.col("e"), high), F.col("e") - agree + 1).otherwise(0)
        return F.struct(F.least("band", band).alias("low"), F.greatest("band", band).alias("high"), keep.cast("int").alias("keep"))

    wanted = F.filter(F.transform(F.when(F.col("linked"), F.col("loose")).otherwise(F.col("all")), partner), lambda p: p["keep"] > 0)
    members = stage(members.join(bands, "a").withColumn("partners", wanted).filter(F.size("partners") > 0).drop("all", "loose"), "members")
    each = judged.select("a", "b", "delta").join(members.select("a", "b"), ["a", "b"], "left_semi").select("b", F.explode("delta").alias("element"), "a")
    each = each.select("b", F.xxhash64("a", "element").alias("element"), "a")
    often = each.groupBy("element").agg(F.count("*").alias("often")).filter("often > 1")
    own = Window.partitionBy("a", "b")  # what nobody else has comes first and needs no row
    each = each.join(often, "element").withColumn("place", F.row_number().over(own.orderBy("often", "element"))).withColumn("common", F.count("*").over(own))
    each = each.join(members, ["a", "b"]).withColumn("rank", F.col("e") - F.col("common") + F.col("place"))
    each = each.withColumn("p", F.explode("partners")).filter("rank <= p.keep").select("a", "p.low", "p.high", "element", "b", "component", "linked", "band", "nb", "e", "rank")
    each = stage(each, "edits")
    key = ["a", "low", "high", "element"]
    # members that all lie in one component have nothing left to find
    mixed = each.groupBy(*key).agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first < last").select(*key)
    each = stage(each.join(mixed, key, "left_semi"), "edits")
    other = each.select(*key, *(F.col(c).alias(f"{c}_") for c in ("b", "component", "linked", "band", "nb", "e", "rank")))
    pairs = each.join(other, key).filter("b < b_ and component != component_ and not (linked and linked_) and band + band_ = low + high")
    # of elements in this order, a pair's rarest common one leaves no more than what follows it to agree on
    pairs = pairs.filter("1 + least(e - rank, e_ - rank_) >= (e + e_ - (nb + nb_) / 7) / 2 - 1e-9")
    pairs = pairs.filter(F.least("nb", "nb_") * 100 >= F.greatest("nb", "nb_") * PERCENT)
    return pairs.select(F.col("b").alias("a"), F.col("b_").alias("b")).distinct()


def _with_shingles(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "text").mapInArrow(tidy(_sets), "row_id long, grams binary")


def _each_shingle(sets: DataFrame) -> DataFrame:
    size = F.octet_length("grams")
    return sets.select("row_id", F.explode(F.transform(F.sequence(F.lit(1), size - 7, F.lit(8)), lambda i: F.substring("grams", i, F.lit(8)))).alias("gram"))


def _candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of rows(row_id, text): all documents' facts, classes of equal sets, their representatives, and the signatures of
    these that can bring a partner."""
    buckets = bucket_count(rows, 4_000_000)
    both = stage(rows.select("row_id", "text").mapInArrow(_deal(buckets), _DEALT).groupBy("bucket").applyInPandas(tidy_group(_shared), _ROWS), "signatures")
    facts = both.filter("kind = 1").select("row_id", "a", "b", "n", "least0", "least1")
    # a table of its own: the copies in a large class then only meet a row each, and may be split
    classes = stage(facts.filter("n > 0").groupBy("a", "b", "n").agg(F.min("row_id").alias("rep"), F.count("*").alias("size")), "classes")
    heads = facts.join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi").select("row_id", "n", "least0", "least1")
    members = (
        both.filter("kind = 0").select("row_id", F.col("a").alias("sig"), F.col("b").alias("count"), F.col("n").alias("next_band"))
        .join(heads, "row_id")
        .withColumn("least", F.greatest(F.when(F.col("next_band") == 1, F.col("least1")).otherwise(F.col("least0")), F.lit(1)))
        .select("sig", "row_id", "next_band", "count", "least", "n")
    )
    kept = stage(prune(members), "members")
    return facts, classes, heads, kept


def _weak(heads: DataFrame) -> DataFrame:
    return heads.filter("least0 < 1").select("row_id")


def _weak_links(rows: DataFrame, weak: DataFrame) -> DataFrame:
    """The links (a, b) of weak documents, compared with all that share a shingle with them."""
    every = _each_shingle(_with_shingles(rows))
    mine = _each_shingle(_with_shingles(rows.join(weak, "row_id", "left_semi"))).withColumnRenamed("row_id", "w")
    touched = stage(every.join(mine, "gram").filter("row_id != w").select(F.least("row_id", "w").alias("a"), F.greatest("row_id", "w").alias("b")).distinct(), "pairs")
    ends = touched.select(F.col("a").alias("row_id")).union(touched.select(F.col("b").alias("row_id"))).distinct()
    return verify(touched, stage(_with_shingles(rows.join(ends, "row_id", "left_semi")), "sets"))


def link_classes(rows: DataFrame) -> DataFrame:
    """rows(row_id, text) of unique row_id: row_id, n_shingles and component (a row_id) of each."""
    facts, classes, heads, kept = _candidates(rows)
    survivors = kept.select("row_id").distinct()
    sets = stage(_with_shingles(rows.join(survivors, "row_id", "left_semi")), "sets")
    lead = kept.groupBy("sig").agg(F.min("row_id").alias("a"), F.count("*").alias("c")).filter("c > 1")
    stars = stage(kept.join(lead, "sig").filter("row_id != a").select("a", F.col("row_id").alias("b")).distinct(), "pairs")
    links = stage(verify(stars, sets), "links")
    found = components(links)
    root = found.select(F.col("id").alias("a"), F.col("component").alias("root"))
    centres = kept.join(lead, "sig").select("a", "row_id").distinct().join(root, "a", "left").select(F.coalesce("root", "a").alias("a"), F.col("row_id").alias("b")).filter("a != b").distinct()
    label = found.select(F.col("id").alias("b"), "component")
    apart = centres.join(label, "b", "left").filter(F.coalesce("component", "b") != F.col("a")).select("a").distinct()
    judged = stage(judge(centres.join(apart, "a", "left_semi"), sets), "centres")
    more = stage(judged.filter("linked").select("a", "b").union(verify(stage(across(judged, found), "pairs"), sets)), "links")
    weak = _weak(heads)
    if weak.head(1):
        more = stage(more.union(_weak_links(rows, weak)), "links")
    if more.head(1):
        found = components(links.union(more))
    whole = facts.join(classes, ["a", "b", "n"], "left").withColumn("rep", F.coalesce("rep", "row_id")).select("row_id", "n", "rep")
    return whole.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("row_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))


def link_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(row_id, text) of unique row_id: (row_id, rep, size), each document's class of equal sets (rep null for empty
    sets), and all linked pairs (a, b), a < b, of representatives. Every member of a document's class is linked with it and
    with every member of the classes linked with its own. Members of a signature meet in pairs here, so the work grows
    with the square of a group of near copies, as its links do."""
    facts, classes, heads, kept = _candidates(rows)
    sets = stage(_with_shingles(rows.join(kept.select("row_id").distinct(), "row_id", "left_semi")), "sets")
    left, right = kept.select("sig", F.col("row_id").alias("a"), F.col("n").alias("na")), kept.select("sig", F.col("row_id").alias("b"), F.col("n").alias("nb"))
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    links = verify(left.join(right, "sig").filter("a < b").filter(close).select("a", "b").distinct(), sets)
    weak = _weak(heads)
    if weak.head(1):
        own = heads.select("row_id")
        found = _weak_links(rows, weak)
        found = found.join(own.withColumnRenamed("row_id", "a"), "a", "left_semi").join(own.withColumnRenamed("row_id", "b"), "b", "left_semi")
        links = links.union(found.select("a", "b")).distinct()
    members = facts.join(classes, ["a", "b", "n"], "left").select("row_id", "rep", "size")
    return members, stage(links, "links")


def link_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): doc_id and n_links, how many other rows its row is linked with directly."""
    rows = numbered(docs)
    members, links = link_pairs(rows.select("row_id", "text"))
    members = stage(members, "members")
    size = members.filter("row_id = rep").select(F.col("rep").alias("b"), F.col("size").alias("others"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    counted = members.join(near, "rep", "left").select("row_id", (F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "row_id").join(counted, "row_id").select("doc_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those linked, directly or not, with a smaller doc_id (of equal
    ones, the first in order of the text)."""
    rows = numbered(docs.select("doc_id", "text", F.struct("*").alias("row")), ["doc_id", "text", "row"])
    heads = link_classes(rows.select("row_id", "text")).filter("row_id = component").select("row_id")
    return rows.join(heads, "row_id", "left_semi").select("row.*")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id it is linked with."""
    rows = numbered(docs)
    rows = rows.select("doc_id", "row_id").join(link_classes(rows.select("row_id", "text")), "row_id")
    roots = rows.filter("row_id = component").select(F.col("row_id").alias("component"), F.col("doc_id").alias("component_id"))
    return rows.join(roots, "component").select("doc_id", "n_shingles", "component_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
    sh AS (SELECT DISTINCT doc_id, s FROM g), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    reach AS (SELECT DISTINCT a AS root, a AS node FROM e UNION SELECT r.root, e.b FROM reach r JOIN e ON e.a = r.node),
    m AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""
