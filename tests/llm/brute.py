"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def tokens(docs, tokenizer, end_id=1):
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] is not None, (d[1] or "").encode())):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def substrings(docs, width=20):
    first = {}
    for doc, text in sorted(docs):
        w = words(text)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (doc, i))
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (doc, i):
                gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def jaccard(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    inverted = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    shared = Counter()
    for rows in inverted.values():
        for a in range(len(rows)):
            for b in range(a):
                shared[rows[b], rows[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def quality_base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), failed


def conversation(rows):
    """turns_sha256, loss_chars, loss_sha256, n_turns of sorted (role, text) rows."""
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
