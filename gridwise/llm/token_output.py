"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

Format of a folder: for each shard, `NNNNN.tokens` (little-endian uint16 where all ids are below 65,536,
else uint32: the ids of its documents one after another), `NNNNN.docs` (int64 doc_id), `NNNNN.sizes` (uint64 ids a document) and `NNNNN.offsets`
(uint64, documents + 1; they count ids from the beginning of the whole output). Shards hold ascending
ranges of doc_id.

Documents are range-partitioned by doc_id and each partition writes its ids; one row a shard goes
through a prefix sum that gives the shard's base; a second pass writes the offsets on that base.
Files appear under their names by a rename, so a repeated task only replaces equal bytes.

Empty tables give no shards; null and empty texts give the end id alone; equal doc_ids are ordered by
text, each with a place of its own; a null doc_id comes first and is stored as the smallest int64; a text of any
length is encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridwise.llm.common import Words, filesystem, new_folder, passes, read, stage, strings, tidy

NO_ID = np.iinfo(np.int64).min
#: Words whose ids a worker remembers; beyond that it begins anew.
REMEMBERED = 500_000
#: Bytes of text that are encoded at once.
AT_ONCE = 2 << 20


#: A run of letters below U+0180 that normalise to themselves and lower-case one by one, then ASCII marks.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)")

def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else U+0100 onwards."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in prints else next(others)) for b in range(256))


#: Normaliser and pre-tokenizer of a file whose ids of a text are its space-separated pieces' ids in order: white space
#: is dropped and no rule looks across it. (Fixed values of that file.)
BY_PIECES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def goes_by_pieces(tokenizer) -> bool:
    """Whether the tokenizer is known to give a text the ids of its space-separated pieces, in order."""
    file = json.loads(tokenizer.to_str())
    added = [t["content"] for t in file["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]]
    return (file["normalizer"], file["pre_tokenizer"]) == BY_PIECES and not added and file["post_processor"] is None and not file["truncation"] and not file["padding"] and file["model"]["type"] == "BPE" and not file["model"].get("dropout")


def _equal(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, size: np.ndarray) -> bool:
    """Whether all of data[start:start+size] are other's bytes from other_start."""
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    return bool((data[place + np.repeat(start, size)] == other[place + np.repeat(other_start, size)]).all())


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    Where goes_by_pieces(), one distinct space-separated piece at a time: pieces are told apart by a 64-bit hash and
    compared with the one remembered under it, and a text of which one differs is encoded whole. A piece of
    plain letters and marks after them is two pre-tokens at most; its letters go to the library's model directly.
    With any other file, every text is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letters = {i: letters[i] for i in range(256)}
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.by_pieces = goes_by_pieces(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of pieces, ascending, with the place of their ids in flat
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.bytes, self.begin, self.wide = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the pieces
        self.cores: dict[str, bytes] = {}  # ids as bytes, which the garbage collector need not visit

    def core(self, letters: str) -> bytes:
        ids = self.cores.get(letters)
        if ids is None:
            seen = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
            ids = self.cores[letters] = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        return ids

    def marks(self, text: str) -> bytes:
        ids = self.cores.get(text)
        if ids is None:
            ids = self.cores[text] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return ids

    def ids_of(self, words: list[str]) -> list[bytes]:
        out, odd = [], []
        for w in words:
            m = _PLAIN.fullmatch(w)
            if m:
                out.append(self.core(m[1].lower()) + self.marks(m[2]) if m[2] else self.core(m[1].lower()))
            else:
                odd.append(len(out))
                out.append(w)
        for lo in range(0, len(odd), 10_000):
            part = odd[lo : lo + 10_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([out[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Remembers pieces, and their ids, by 64-bit hash."""
        if len(self.cores) > REMEMBERED // 3:
            self.cores.clear()
        ids = self.ids_of(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), np.uint32)))
        raw = [w.encode() for w in words]
        wide = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = len(self.bytes) + np.cumsum(wide) - wide
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(raw), np.uint8)))
        order = np.argsort(known := np.concatenate((self.known, hashes)), kind="stable")
        self.known, self.at, self.length = known[order], np.concatenate((self.at, at))[order], np.concatenate((self.length, sizes))[order]
        self.begin, self.wide = np.concatenate((self.begin, begin))[order], np.concatenate((self.wide, wide))[order]

    def whole(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() of each text as it is."""
        raw = data.tobytes()
        texts = [raw[i:j].decode() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        ids = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, given as bytes and offsets, with end_id after each text, and the number of each text's ids."""
        if not self.by_pieces:
            return self.whole(data, off, end_id)
        words = Words(data, off)
        n = len(off) - 1
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        new[at < len(self.known)] = self.known[at[at < len(self.known)]] != hashes[at < len(self.known)]
        if new.any():
            raw, w = data.tobytes(), first[new]
            if len(self.known) + len(w) > REMEMBERED:  # all of them anew
                self.forget()
                new[:], w = True, first
            self.learn(hashes[new], [raw[i:j].decode() for i, j in zip(words.start[w].tolist(), words.end[w].tolist(), strict=True)])
            at = np.searchsorted(self.known, hashes)
        codes = at[which]
        size = words.end - words.start
        if not np.array_equal(size, self.wide[codes]) or not _equal(data, words.start, self.bytes, self.begin[codes], size):
            return self.whole(data, off, end_id)  # two pieces have one hash
        length = self.length[codes]
        ends = np.concatenate(([0], np.cumsum(length)))
        counts = np.diff(ends[words.first]) + 1
        gathered = self.flat[np.repeat(self.at[codes] - ends[:-1], length) + np.arange(int(ends[-1]))]
        out = np.full(int(ends[-1]) + n, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts) - 1] = False  # the end ids
        out[keep] = gathered
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the ids of docs(doc_id, text) to folder and returns its shards:
    (shard, n_docs, n_tokens, width, base), base being the ids of all shards before."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        own, store, base = encoder(tokenizer_path), *filesystem(folder)
        width = 2 if max(own.size - 1, end_id) < 1 << 16 else 4
        store.create_dir(base, recursive=True)
        part = f"{base}/.{shard:05d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        with store.open_output_stream(part + ".tokens") as ids_to, store.open_output_stream(part + ".docs") as docs_to, store.open_output_stream(part + ".sizes") as sizes_to:
            for batch in batches:
                keys = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                texts = strings(batch.column(1))
                for _, _, data, off in passes(texts, AT_ONCE):
                    ids, counts = own.encode(data, off, end_id)
                    ids_to.write(ids.astype(f"<u{width}").tobytes())
                    sizes_to.write(counts.astype("<u8").tobytes())
                    n_tokens += len(ids)
                docs_to.write(keys.astype("<i8", copy=False).tobytes())
                n_docs += len(texts)
        for kind in ("tokens", "docs", "sizes"):
            if n_docs:
                store.move(f"{part}.{kind}", f"{base}/{shard:05d}.{kind}")
            else:
                store.delete_file(f"{part}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens], "width": pa.array([width], pa.int32())})

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = text.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = stage(ranged.mapInArrow(tidy(encode), "shard int, n_docs long, n_tokens long, width int"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = stage(shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-bases")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{shard:05d}.sizes") as f:
                    sizes = np.frombuffer(f.read(), "<u8")
                part = f"{base}/.{shard:05d}-{uuid.uuid4().hex}.offsets"
                with store.open_output_stream(part) as f:
                    f.write((np.concatenate((np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64))) + np.uint64(first)).astype("<u8").tobytes())
                store.move(part, f"{base}/{shard:05d}.offsets")
            yield batch

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(shards.repartition(n, "shard").mapInArrow(offsets, shards.schema), "token-index")


def _open(store, path: str, dtype: str):
    """The file as an array, memory-mapped where the store is a local or mounted one."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of folder."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for shard, width in zip(batch.column("shard").to_pylist(), batch.column("width").to_pylist(), strict=True):
                tokens, docs, offsets = (_open(store, f"{base}/{shard:05d}.{k}", t) for k, t in (("tokens", f"<u{width}"), ("docs", "<i8"), ("offsets", "<u8")))
                local = (offsets - offsets[0]).astype(np.int64)
                for lo in range(0, len(docs), 2_000):
                    hi = min(lo + 2_000, len(docs))
                    ids = tokens[local[lo] : local[hi]].astype("<u4")
                    crc = [zlib.crc32(ids[local[i] - local[lo] : local[i + 1] - local[lo]]) for i in range(lo, hi)]
                    keys = pa.array(docs[lo:hi], pa.int64(), mask=np.asarray(docs[lo:hi] == NO_ID))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(offsets[lo:hi].astype(np.int64)), pa.array(np.diff(local[lo : hi + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").mapInArrow(tidy(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes docs to a new folder of the shared store and returns what its files hold."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path, end_id), folder)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))
