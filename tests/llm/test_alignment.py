"""Cross-tokenizer alignment against offsets of whole texts, with awkward texts."""

import random
from bisect import bisect_right
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from data import documents

from gridwise.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na b\n", "a  b", "a 　b", "tab\t b \tc", "<|endoftext|> x <s> </s> <unk> <0x41>",
    "mark ▁ here", "▁", "a▁b c", "的是 了 不 在", "naïve café — don't they’ll we'd", "😀 😀😀 \U0001f468‍\U0001f469", "é ́x", "\x00 a\x01b", "a\x1c b\x1d c",
    "x" * 3000, "ő" * 999 + "ab" * 9000 + "а" * 5000, "ab " * 4000, "1234567 89 1,000.50", "   indented\n        code()  # x", "ʼn ﬁ ℌ ①", "​ ​z", "end\r\n", "! ?  ... ''s 's's",
]


def fuzz(n):
    rng = random.Random(5)
    alphabet = ["a", "the", "Q", " ", " ", " ", "  ", "\n", "\t", "'s", "é", "的", "́", "1", "23", ".", "😀", " ", "-", "ing", "\x85", " ", "<s>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def aligner():
    return al.Aligner(A, B)


def ends(ids, spell):
    out, at = [], 0
    for i in ids:
        at += len(spell[i])
        out.append(at)
    return out


def plain(aligner, text):
    """(A ids, B ids, groups, links) of a whole text by byte offsets."""
    if not text:
        return [], [], [], []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    want = b" " + text.encode()
    if b"".join(aligner.spell_a[i] for i in a) != want or b"".join(aligner.spell_b[i] for i in b) != want:
        return [], [], [], []
    ea, eb = ends(a, aligner.spell_a), ends(b, aligner.spell_b)
    groups, i, j = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        ia, jb = bisect_right(ea, end), bisect_right(eb, end)
        groups.append(",".join(map(str, a[i:ia])) + "|" + ",".join(map(str, b[j:jb])))
        i, j = ia, jb
    begin = [0, *eb[:-1]]
    links, lo = [], 0
    for k, x in enumerate(a):
        start = ea[k - 1] if k else 0
        while eb[lo] <= start:
            lo += 1
        at = lo
        while at < len(b) and begin[at] < ea[k]:
            links.append((x, b[at]))
            at += 1
    return a, b, groups, links


def table(aligner, docs):
    found = [(i, *plain(aligner, t)) for i, t in docs]
    held = Counter(p for *_, links in found for p in set(links))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = []
    for i, a, b, groups, links in found:
        digest = sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(map(str, rows)), held


def test_pieces_are_whole_texts(aligner):
    assert aligner.cuts
    for text in ODD + fuzz(1500):
        a, b, groups, _ = plain(aligner, text)
        pieces, _ = aligner.pieces_of([text])
        assert b"".join(aligner.groups_text(pieces)).decode() == ";".join(groups), text
        assert aligner.figures[pieces].sum(axis=0)[:2].tolist() == [len(a), len(b)]


def test_equals_plain(spark, aligner, monkeypatch):
    monkeypatch.setattr(al, "AT_ONCE", 20_000)
    docs = documents() + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, "a b"), (3, "one two"), (3, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "p") for i, t in docs], "doc_id long, text string, part int, bucket int, links string").repartition(5)
    want, held = table(aligner, docs)
    assert sorted(str(tuple(r)) for r in al.align(df, A, B).collect()) == want
    parts = al.aligned_parts(df, A, B)
    assert {(r["a"], r["b"]): r["documents"] for r in al.link_counts(parts).collect()} == held
    groups = {(r["doc_id"], tuple(r["groups"])) for r in al.groups(df, A, B).collect()}
    assert groups == {(i, tuple(plain(aligner, t)[2])) for i, t in docs}


def test_small_parts(spark, aligner):
    """Many parts a task: the same result."""
    docs = documents(3, 60) + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    parts = al.aligned_parts(df, A, B, part_bytes=1)
    assert parts.select("part").distinct().count() > 0
    assert sorted(str(tuple(r)) for r in al.align(df, A, B, part_bytes=1).collect()) == table(aligner, docs)[0]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert al.align(empty, A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, al.align(nothing, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_transducer():
    """A leads by what B still lacks; a step is remembered by residual and token, a group by its tokens."""
    t = al.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"b", b"abc"])
    assert [t.group[g] for g in t.walk([0, 1, 2], [0, 1, 3])] == [b"0,1|0,1", b"2|3"]
    assert t.group_links[1] == ((0 << 16) | 0, (0 << 16) | 1, (1 << 16) | 1)
    assert t.steps[0, b"ab", 0] == (0, b"b") and t.steps[0, b"b", 1] == (1, b"c") and t.steps[1, b"c", 1] == (0, b"")
    steps, groups = len(t.steps), len(t.group)
    t.walk([0, 1, 0], [0, 1, 0, 2])
    assert len(t.group) == groups + 1 and len(t.steps) == steps + 1
