"""Quality rules: word, symbol, line and repetition counts, then zstandard compression bands.

A text that compresses far better than prose of its length repeats itself; one that hardly compresses is
noise. The ratio (bytes to compressed bytes) of the whole text and of each chunk must lie in the band for
its length; a text is rejected when its own ratio is outside, or more than a share of its chunks are. The
chunks cover the text: the last one ends where it ends, and reaches back where it would be too short to
judge. The bands and the share are parameters. The least ratios lie above what words of random base64
letters and random printable ASCII reach at that length, and below prose; under 75 bytes the two do not
differ in their ratios, and only the largest ratio counts.

Null and empty texts have no words and fail the base rules; a text of any length is judged whole and compressed
chunk by chunk; equal rows are judged alike; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.llm.common import Words, covered, mix, passes, read, segment_sum, strings

#: (bytes below, least ratio, largest ratio), the last without an upper length.
WHOLE_BANDS = (
    (75, 0.5, 4.0), (100, 0.94, 4.0), (150, 1.04, 4.0), (200, 1.09, 4.0), (300, 1.16, 6.0), (400, 1.22, 6.0), (500, 1.26, 6.0),
    (700, 1.31, 6.0), (1_000, 1.36, 6.0), (1_500, 1.4, 8.0), (5_000, 1.45, 8.0), (None, 1.45, 10.0),
)
#: Chunks have the band of their length; a last chunk below LAST_BYTES reaches back to that length.
CHUNK_BYTES, LAST_BYTES, CHUNK_SHARE = 4_096, 1_024, 0.5
BASE_WORDS, REPEAT_WIDTH, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def repeat_words(words: Words, width: int = REPEAT_WIDTH) -> np.ndarray:
    """For each document, its words inside a width-word window that occurs in it twice or more."""
    at, grams = words.ngrams(words.hashes(), width)
    grams = mix(grams + words.doc[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))  # one document's windows only meet each other
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    same = g[1:] == g[:-1]
    again = np.zeros(len(g), bool)
    again[1:] |= same
    again[:-1] |= same
    return segment_sum(covered(len(words), at[order[again]], width), words.first)


def in_band(size: int, ratio: float, bands=WHOLE_BANDS) -> bool:
    _, least, most = next(b for b in bands if b[0] is None or size < b[0])
    return least <= ratio <= most


def chunks(text: bytes, chunk_bytes: int = CHUNK_BYTES, last_bytes: int = LAST_BYTES) -> Iterator[bytes]:
    """The chunks of a text: together all of its bytes."""
    for lo in range(0, len(text), chunk_bytes):
        hi = min(lo + chunk_bytes, len(text))
        yield text[max(0, min(lo, hi - last_bytes)) : hi]


def compression(text: bytes, compress, whole=WHOLE_BANDS, chunk_bytes=CHUNK_BYTES, chunk_bands=WHOLE_BANDS) -> tuple[float, int, int, bool]:
    """The ratio of a text, its chunks, those outside the band, and whether the ratio is inside its own."""
    ratio = len(text) / len(compress(text)) if text else 0.0
    n = bad = 0
    for part in chunks(text, chunk_bytes):
        n += 1
        bad += not in_band(len(part), ratio if len(part) == len(text) else len(part) / len(compress(part)), chunk_bands)
    return ratio, n, bad, in_band(len(text), ratio, whole)


def quality_rules(docs: DataFrame, level: int = 3, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """One row for each row of docs(doc_id, text): the counts, the ratios and the verdict."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi, data, off in passes(texts):
                words = Words(data, off)
                raw = data.tobytes()
                each = [raw[off[i] : off[i + 1]] for i in range(hi - lo)]
                points = (data & 0xC0) != 0x80
                before = np.concatenate(([0], np.cumsum(points, dtype=np.int64)))
                chars = before[words.end] - before[words.start] if len(words) else np.zeros(0, np.int64)
                n_words, repeats = words.count, repeat_words(words)
                failed = (n_words < BASE_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
                bands = [compression(x, compress) for x in each]
                kept = ~failed & np.array([ok and bad <= chunk_share * n for _, n, bad, ok in bands], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, (n_words.astype(np.int64), segment_sum(chars, words.first), segment_sum(_SYMBOL[data], off), np.array([duplicate_lines(x) for x in each], np.int64), repeats, failed, kept, np.array([b[0] for b in bands], float), np.array([b[1] for b in bands], np.int64), np.array([b[2] for b in bands], np.int64)))],
                    [x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, _SCHEMA)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
