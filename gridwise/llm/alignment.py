"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same byte, and which overlap.

A is a byte-level BPE file of the tokenizers library, given a space and the text; B is a sentencepiece model, given the
text, before which it writes a space itself. Both token sequences spell the same bytes, and a transducer walks them
together. Its state is the side that leads and the bytes by which it leads: the residual, always the end of that side's
last token. The next token of the other side overlaps that token (a link) and either leaves a shorter residual, or leads
itself by its own end, or uses the residual up, which closes a group. Transitions are remembered by residual and token;
upon them, a node stands for a residual with the tokens of the open group, so that a closed group is a number.

Neither vocabulary has a token that goes on past a space before a character other than white space, so texts are cut
there into pieces; a worker encodes and walks each distinct piece of a part (PART_BYTES of text, PIECES pieces) once.
Files for which that does not hold are encoded text by text.

Counting: a part sends each of its links once, with the number of its documents that hold it, to the bucket of the
link's A id; the bucket adds up, finds each A id's highest count, and answers each part. A bucket thus gets a link at
most once a part, however many documents have it.

A null or empty text, and one whose tokens spell other bytes, has no tokens: zeros and an empty digest. Repeated rows
and equal or null doc_ids are rows like any other; each counts as a document. A text is processed whole, whatever its
length; empty tables give an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.llm.common import pack, read, segment_sum, stage, unpack
from gridwise.llm.token_output import byte_letters

#: Text and distinct pieces after which a worker begins a new part; texts that are encoded together.
PART_BYTES, PIECES, AT_ONCE = 64 << 20, 400_000, 2 << 20
#: Pieces that are encoded as one text.
TOGETHER = 5_000
#: A space where both vocabularies begin a token.
CUT = re.compile(r"(?<=\S) (?=\S)")
_UNSURE = re.compile(r"\s | \s|^ | $")
SPACE_MARK = "▁"
ROOT = 0
B_BITS = 16

PARTS_SCHEMA = (
    "part long, bucket int, places binary, links binary, held binary, "
    "doc_id array<long>, digest array<string>, figures binary, sizes binary, pieces binary, times binary, piece_links binary, piece_sizes binary"
)
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def packed(values: np.ndarray) -> bytes:
    return pack(values) if len(values) else b""


def unpacked(values: bytes, dtype) -> np.ndarray:
    return unpack(values, dtype) if values else np.zeros(0, dtype)


class Transducer:
    """Groups of two token sequences that spell the same bytes; spell[0] and spell[1] give A's and B's tokens' bytes.

    A node's number is even if the next token is A's. The root, 0, is the empty residual with no tokens; nodes that
    close a group are kept as negative numbers of groups."""

    def __init__(self, spell_a: list[bytes], spell_b: list[bytes]):
        self.spell = spell_a, spell_b
        self.steps: dict[tuple[int, bytes, int], tuple[int, bytes]] = {}  # (who leads, residual, the other's token)
        self.forget()

    def forget(self) -> None:
        """Drops all nodes and groups, which are numbered anew; transitions stay."""
        self.next: dict[int, int] = {}
        self.node = [(0, b"", -1, ROOT, ROOT, -1)]  # who leads, residual, its last token; from which node, by which token, its link
        self.group: list[bytes] = [b""]
        self.group_a: list[int] = [0]  # its tokens of A
        self.group_links: list[tuple[int, ...]] = [()]
        if len(self.steps) > PIECES:
            self.steps = {}

    def step(self, leads: int, residual: bytes, token: int) -> tuple[int, bytes]:
        """Who leads after the other side's token, and by which bytes."""
        known = self.steps.get((leads, residual, token))
        if known is None:
            other = self.spell[1 - leads][token]
            known = (leads, residual[len(other) :]) if len(other) < len(residual) else (1 - leads, other[len(residual) :])
            self.steps[leads, residual, token] = known
        return known

    def grow(self, at: int, token: int) -> int:
        """The node or, negative, the group after a token at a node."""
        leads, residual, last, *_ = self.node[at >> 1]
        if not residual:  # at the root A's token leads by itself
            leads, residual, last, link = 0, self.spell[0][token], token, -1
        else:
            link = last << B_BITS | token if at & 1 else token << B_BITS | last
            before = leads
            leads, residual = self.step(leads, residual, token)
            last = last if leads == before else token
        if residual:
            self.node.append((leads, residual, last, at, token, link))
            new = (len(self.node) - 1) << 1 | (1 - leads)
        else:
            new = -self.close(at, token, link)
        self.next[at << B_BITS + 1 | token] = new
        return new

    def close(self, at: int, token: int, link: int) -> int:
        """The group of the tokens on the way from the root to a node, and one more."""
        ids, links = ([], []), [link]
        ids[at & 1].append(str(token))
        while at:
            *_, before, token, link = self.node[at >> 1]
            ids[before & 1].append(str(token))
            links.append(link)
            at = before
        self.group.append("|".join(",".join(reversed(side)) for side in ids).encode())
        self.group_a.append(len(ids[0]))
        self.group_links.append(tuple(x for x in reversed(links) if x >= 0))
        return len(self.group) - 1

    def walk(self, a: list[int], b: list[int]) -> list[int]:
        """The groups of two sequences, as places in group and group_links."""
        known, out, rest_a, rest_b = self.next, [], iter(a), iter(b)
        for token in rest_a:
            key = token
            while True:
                try:
                    at = known[key]
                except KeyError:
                    at = self.grow(key >> B_BITS + 1, token)
                if at < 0:
                    break
                token = next(rest_b) if at & 1 else next(rest_a)
                key = at << B_BITS + 1 | token
            out.append(-at)
        return out


def token_bytes(tokenizer, pieces) -> tuple[list[bytes], list[bytes]]:
    """What each id of A and of B spells."""
    byte = {c: i for i, c in enumerate(byte_letters())}
    names = tokenizer.get_vocab(with_added_tokens=True)
    a = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        a[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    b = []
    for i in range(pieces.get_piece_size()):
        name = pieces.id_to_piece(i)
        b.append(bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace(SPACE_MARK, " ").encode())
    return a, b


def cuts_hold(tokenizer, pieces) -> bool:
    """Whether both vocabularies begin a token at every CUT."""
    file = json.loads(tokenizer.to_str())
    before = file["pre_tokenizer"] or {}
    by_words = file["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    names = (pieces.id_to_piece(i) for i in range(pieces.get_piece_size()))
    return bool(by_words) and file["post_processor"] is None and not any(SPACE_MARK in name.lstrip(SPACE_MARK) for name in names)


class Lists:
    """Lists of numbers one after another: flat[first[i]:first[i + 1]]."""

    def __init__(self):
        self.flat, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def add(self, flat, size) -> None:
        self.flat = np.concatenate((self.flat, np.array(flat, np.int64)))
        self.size = np.concatenate((self.size, np.array(size, np.int64)))
        self.first = np.concatenate(([0], np.cumsum(self.size)))

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some lists one after another, and how many each has."""
        size = self.size[which]
        begin = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.first[which] - begin, size)], size


class Aligner:
    """Pieces of texts as token ids and groups, each distinct piece of a part once."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.spell_a, self.spell_b = token_bytes(self.a, self.b)
        self.size_a, self.size_b = (np.fromiter(map(len, spell), np.int64, len(spell)) for spell in (self.spell_a, self.spell_b))
        self.cuts = cuts_hold(self.a, self.b)
        self.transducer = Transducer(self.spell_a, self.spell_b)
        self.begin()

    def begin(self) -> None:
        """A new part: no piece is known."""
        self.transducer.forget()
        self.known: dict[str, int] = {}
        self.link_at: dict[int, int] = {}
        self.text: list[bytes] = []  # a piece's groups as text
        self.differs = np.zeros(0, bool)  # whether its tokens spell other bytes
        self.figures = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.links = Lists()  # places of a piece's links in link_at, one for each overlap
        self.group_links = Lists()

    def split(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return CUT.split(text) if _UNSURE.search(text) else text.split(" ")

    def learn(self, words: list[str]) -> None:
        """Encodes new pieces. Those that no white space begins or ends are encoded as one text of many, where each
        begins at a cut."""
        together, alone = [], []
        for w in words:
            (alone if not self.cuts or w[:1].isspace() or w[-1:].isspace() or not w else together).append(w)
        for lo in range(0, len(together), TOGETHER):
            self.encode(together[lo : lo + TOGETHER])
        for w in alone:
            self.encode([w])

    def encode(self, words: list[str]) -> None:
        """Pieces as one text; where its tokens spell other bytes, in halves."""
        text = " ".join(words)
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        if b"".join(map(self.spell_a.__getitem__, a)) == b"".join(map(self.spell_b.__getitem__, b)) == b" " + text.encode():
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
            many = (np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0) for size, ids in ((self.size_a, a), (self.size_b, b)))
            self.add(words, a, b, *many)
        elif len(words) > 1:
            self.encode(words[: len(words) // 2])
            self.encode(words[len(words) // 2 :])
        else:
            self.add(words, [], [], np.zeros(1, np.int64), np.zeros(1, np.int64))

    def add(self, words: list[str], a: list[int], b: list[int], n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Pieces with the tokens of all of them, and how many each has; none where they spell other bytes."""
        self.known.update(zip(words, range(len(self.text), len(self.text) + len(words)), strict=True))
        walked = self.transducer.walk(a, b)  # a piece ends a group
        known = len(self.group_links.size)
        new = self.transducer.group_links[known:]
        at = self.link_at
        self.group_links.add([at.setdefault(x, len(at)) for links in new for x in links], list(map(len, new)))
        groups = np.array(walked, np.int64)
        ends = np.cumsum(np.array(self.transducer.group_a, np.int64)[groups])
        last = np.concatenate(([0], np.searchsorted(ends, np.cumsum(n_a), side="right")))
        links, size = self.group_links.of(groups)
        many = segment_sum(size, last)
        self.links.add(links, many)
        text = list(map(self.transducer.group.__getitem__, walked))
        cut = last.tolist()
        self.text += [b";".join(text[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
        self.differs = np.concatenate((self.differs, n_a == 0))
        self.figures = np.concatenate((self.figures, np.column_stack((n_a, n_b, np.diff(last), many))))

    def pieces_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pieces, in order, and how many each text has; none for one without tokens."""
        split = [self.split(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.known]
        if new:
            self.learn(new)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        pieces = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        wrong = np.zeros(len(texts), bool)
        wrong[doc[self.differs[pieces]]] = True
        return pieces[~wrong[doc]], np.where(wrong, 0, sizes)

    def groups_text(self, pieces: np.ndarray) -> Iterator[bytes]:
        """A text's groups, some at a time."""
        for lo in range(0, len(pieces), 100_000):
            yield b";" * bool(lo) + b";".join(map(self.text.__getitem__, pieces[lo : lo + 100_000].tolist()))


def batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a column, about AT_ONCE bytes at a time; nulls are empty."""
    lo, some, size = 0, [], 0
    for i, text in enumerate(column):
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= AT_ONCE:
            yield lo, some
            lo, some, size = i + 1, [], 0
    if some:
        yield lo, some


def _row(**columns) -> pa.RecordBatch:
    kinds = {"part": pa.int64(), "bucket": pa.int32(), "doc_id": pa.list_(pa.int64()), "digest": pa.list_(pa.string())}
    names = [c.split()[0] for c in PARTS_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([columns.get(n)], kinds.get(n, pa.binary())) for n in names], names)


class Part:
    """What a task has of the part that it is in: documents that hold each link, and the text so far."""

    def __init__(self, number: int):
        self.number, self.size, self.held = number, 0, np.zeros(0, np.int64)

    def documents(self, aligner: Aligner, ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        """A row of documents: their figures, digests, and distinct pieces with how often each occurs."""
        pieces, many = aligner.pieces_of(texts)
        digests, first = [], np.concatenate(([0], np.cumsum(many)))
        for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
            digest = hashlib.sha256()
            for some in aligner.groups_text(pieces[lo:hi]):
                digest.update(some)
            digests.append(digest.hexdigest() if hi > lo else "")
        known, links_known = len(aligner.text), len(aligner.link_at)
        own, times = np.unique(np.repeat(np.arange(len(texts)), many) * known + pieces, return_counts=True)
        doc, pieces = own // max(known, 1), own % max(known, 1)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        figures = np.column_stack([segment_sum(aligner.figures[pieces, k] * times, first) for k in range(4)])
        links, size = aligner.links.of(pieces)
        pairs = np.unique(np.repeat(doc, size) * links_known + links)
        self.held = np.concatenate((self.held, np.zeros(links_known - len(self.held), np.int64)))
        if len(pairs):
            self.held += np.bincount(pairs % links_known, minlength=links_known)
        self.size += sum(map(len, texts))
        return _row(part=self.number, doc_id=ids, digest=digests, figures=packed(figures.reshape(-1)), sizes=packed(np.diff(first)), pieces=packed(pieces.astype(np.uint32)), times=packed(times.astype(np.uint32)))

    def full(self, aligner: Aligner, most: int) -> bool:
        return self.size >= most or len(aligner.text) >= PIECES

    def end(self, aligner: Aligner, buckets: int) -> Iterator[pa.RecordBatch]:
        """The links of each piece, then the part's links by bucket of their A id, with the documents that hold them."""
        yield _row(part=self.number, piece_links=packed(aligner.links.flat.astype(np.uint32)), piece_sizes=packed(aligner.links.size.astype(np.uint32)))
        links = np.fromiter(aligner.link_at, np.uint32, len(aligner.link_at))
        held = np.concatenate((self.held, np.zeros(len(links) - len(self.held), np.int64)))
        bucket = bucket_of(links, buckets)
        order = np.argsort(bucket, kind="stable")
        order = order[held[order] > 0]
        for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(some):
                yield _row(part=self.number, bucket=int(bucket[some[0]]), places=packed(some.astype(np.uint32)), links=packed(links[some]), held=packed(held[some]))


def bucket_of(links: np.ndarray, buckets: int) -> np.ndarray:
    return ((links >> B_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)


def _aligned(path_a: str, path_b: str, buckets: int, part_bytes: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, task, n = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        part = Part(task << 32)
        for batch in rows:
            ids = batch.column(0).to_pylist()
            for lo, texts in batches(batch.column(1)):
                yield part.documents(aligner, ids[lo : lo + len(texts)], texts)
                if part.full(aligner, part_bytes):
                    yield from part.end(aligner, buckets)
                    aligner.begin()
                    n += 1
                    part = Part(task << 32 | n)
        if part.size or part.held.size:
            yield from part.end(aligner, buckets)

    return run


def _counted(table: pa.Table) -> pa.Table:
    """One bucket: how many documents hold each link, and whether no link of its A id is held by more."""
    sent = [unpacked(x, np.uint32) for x in table["links"].to_pylist()]
    links, at = np.unique(np.concatenate(sent), return_inverse=True)
    count = np.zeros(len(links), np.int64)
    np.add.at(count, at, np.concatenate([unpacked(x, np.int64) for x in table["held"].to_pylist()]))
    a = links >> B_BITS
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    best = count == np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(a))))
    cut = np.cumsum([len(x) for x in sent])[:-1]
    each = np.split(at.reshape(-1), cut)
    return pa.table({"part": table["part"], "places": table["places"], "counts": pa.array([packed(count[x]) for x in each], pa.binary()), "best": pa.array([packed(best[x].astype(np.uint8)) for x in each], pa.binary())})


def _added(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """One part: its documents with the sums over their links."""
    rows = docs.to_pylist()
    own = [r for r in rows if r["piece_links"] is not None]
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    out = {n: [] for n in names}
    links = unpacked(own[0]["piece_links"], np.uint32) if own else np.zeros(0, np.uint32)
    first = np.concatenate(([0], np.cumsum(unpacked(own[0]["piece_sizes"], np.uint32).astype(np.int64)))) if own else np.zeros(1, np.int64)
    count, best = np.zeros(int(links.max()) + 1 if len(links) else 0, np.int64), np.zeros(int(links.max()) + 1 if len(links) else 0, np.int64)
    for r in answers.to_pylist():
        places = unpacked(r["places"], np.uint32)
        count[places], best[places] = unpacked(r["counts"], np.int64), unpacked(r["best"], np.uint8)
    piece_count, piece_best = segment_sum(count[links], first), segment_sum(best[links], first)
    for r in rows:
        if r["figures"] is None:
            continue
        figures = unpacked(r["figures"], np.int64).reshape(-1, 4)
        ends = np.concatenate(([0], np.cumsum(unpacked(r["sizes"], np.int64))))
        pieces, times = unpacked(r["pieces"], np.uint32), unpacked(r["times"], np.uint32).astype(np.int64)
        columns = [r["doc_id"], *figures.T.tolist(), segment_sum(piece_best[pieces] * times, ends).tolist(), segment_sum(piece_count[pieces] * times, ends).tolist(), r["digest"]]
        for n, values in zip(names, columns, strict=True):
            out[n] += values
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.table([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)


def aligned_parts(docs: DataFrame, path_a: str, path_b: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs(doc_id, text) as a table in the shared folder: parts with their documents, pieces and links."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    return stage(rows.mapInArrow(_aligned(path_a, path_b, buckets, part_bytes), PARTS_SCHEMA), "aligned")


def link_counts(parts: DataFrame) -> DataFrame:
    """(a, b, documents) of every link of aligned_parts()."""

    def run(table: pa.Table) -> pa.Table:
        links, at = np.unique(np.concatenate([unpacked(x, np.uint32) for x in table["links"].to_pylist()]), return_inverse=True)
        count = np.zeros(len(links), np.int64)
        np.add.at(count, at.reshape(-1), np.concatenate([unpacked(x, np.int64) for x in table["held"].to_pylist()]))
        return pa.table({"a": (links >> B_BITS).astype(np.int64), "b": (links & 0xFFFF).astype(np.int64), "documents": count})

    return parts.filter("bucket is not null").select("bucket", "links", "held").groupBy("bucket").applyInArrow(run, "a long, b long, documents long")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups) of docs(doc_id, text): every group as `A ids|B ids`, in order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in rows:
            ids = batch.column(0).to_pylist()
            for lo, texts in batches(batch.column(1)):
                pieces, many = aligner.pieces_of(texts)
                spelt = [b"".join(aligner.groups_text(p)).decode() for p in np.split(pieces, np.cumsum(many)[:-1])]
                found = [groups.split(";") if groups else [] for groups in spelt]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + len(texts)], pa.int64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "groups"])
                if len(aligner.text) >= PIECES:
                    aligner.begin()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, groups array<string>")


def align(docs: DataFrame, path_a: str, path_b: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document's tokens, groups and links, and what the whole corpus says of its links."""
    parts = aligned_parts(docs, path_a, path_b, part_bytes)
    asked = parts.filter("bucket is not null").select("part", "bucket", "places", "links", "held")
    answers = asked.groupBy("bucket").applyInArrow(_counted, "part long, places binary, counts binary, best binary")
    own = parts.filter("bucket is null").drop("bucket", "places", "links", "held")
    return own.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_added, RESULT_SCHEMA)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
