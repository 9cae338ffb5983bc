"""Noise of every length fails the compression bands, prose does not, and bad tails count."""

import random
import string

import pytest

from gridwise.llm import quality_rules as q

BASE64, PRINTABLE = string.ascii_letters + string.digits + "+/", "".join(map(chr, range(32, 127)))


def verdict(text):
    import zstandard

    _, n, bad, ok = q.compression(text, zstandard.ZstdCompressor(level=3).compress)
    return n, bad, ok and bad <= q.CHUNK_SHARE * n


def noise(rng, size):
    words = ""
    while len(words) < size:
        words += "".join(rng.choices(BASE64, k=rng.randint(3, 10))) + " "
    return words[:size].encode()


@pytest.mark.parametrize("size", [100, 146, 199, 200, 299, 300, 399, 450, 594, 699, 944, 999, 1_200, 2_995, 4_095, 4_096, 4_999, 5_001, 7_993, 59_996])
def test_noise_is_rejected(size):
    rng = random.Random(size)
    for _ in range(20):
        assert not verdict(noise(rng, size))[2]
        assert not verdict("".join(rng.choices(PRINTABLE, k=size)).encode())[2]


def test_chunks_cover_the_text():
    for size in (0, 1, 1_000, 4_095, 4_096, 4_097, 5_000, 8_192, 12_000):
        text = bytes(i * 31 % 251 for i in range(size))
        parts = list(q.chunks(text))
        assert len(parts) == -(-size // q.CHUNK_BYTES) and text.endswith(parts[-1] if parts else b"")
        assert all(len(p) >= min(size, q.LAST_BYTES) for p in parts)
        assert b"".join(parts[:-1]) + (parts[-1][-(size - q.CHUNK_BYTES * (len(parts) - 1)) :] if parts else b"") == text


def test_bad_tails_count(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 4200").select("text").limit(3).collect()]
    good, rng = docs[0].encode()[: q.CHUNK_BYTES], random.Random(3)
    assert verdict(good)[:2] == (1, 0)
    assert verdict(good + noise(rng, 2_000))[:2] == (2, 1)
    assert verdict(good + noise(rng, 4_095))[:2] == (2, 1)
    assert verdict(good + noise(rng, 6_000)) == (3, 2, False)
    assert verdict(good + b"same " * 800)[:2] == (2, 1)


def test_prose_is_kept(spark):
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    docs = [r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null").select("text").collect()]
    docs = [d for d in docs if len(d.split()) >= q.BASE_WORDS]
    low = [d for d in docs if len(d) / len(compress(d)) < next(b for b in q.WHOLE_BANDS if b[0] is None or len(d) < b[0])[1]]
    assert len(docs) > 100 and not low
    assert verdict(b"we do not go to it as it is up to me or him if he is in or on it")[2]
    assert verdict(b"the cat sat on a mat and I saw it go in to the tub at ten by an oak")[2]


def test_verdicts_equal_brute_force(spark):
    """The verdict over again, from the parameters: base rules, the band of the whole text, bands of its chunks."""
    import brute
    import zstandard
    from data import documents

    def ratio(raw):
        return len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))

    def inside(raw):
        for below, least, most in q.WHOLE_BANDS:
            if below is None or len(raw) < below:
                return least <= ratio(raw) <= most

    rng = random.Random(12)
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) if rng.random() < 0.9 else " " for _ in range(n))
    docs = documents(6, 90) + [(1000 + i, noise(rng.randrange(100, 9_000))) for i in range(20)]
    docs += [(2000 + i, (docs[14][1] or "")[: 3_000 + 500 * i] + " " + noise(300 + 700 * i)) for i in range(14)]
    got = {r["doc_id"]: r for r in q.quality_rules(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    verdicts = set()
    for doc, text in docs:
        raw = (text or "").encode()
        parts = [raw[i : i + 4_096] for i in range(0, len(raw), 4_096)]
        if parts and len(parts[-1]) < 1_024:
            parts[-1] = raw[-1_024:]
        bad = sum(not inside(p) for p in parts)
        want = not brute.quality_base(text)[-1] and inside(raw) and 2 * bad <= len(parts)
        assert (got[doc]["kept"], got[doc]["n_chunks"], got[doc]["n_bad_chunks"]) == (want, len(parts), bad), doc
        verdicts.add((want, brute.quality_base(text)[-1], bad > 0, bool(raw) and inside(raw)))
    assert len(verdicts) >= 5
