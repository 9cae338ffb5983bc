"""Small documents with every awkward case."""

import random


def documents(seed=7, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "Été", "的", "x y", "don't", "(a)", "3.14", "<|endoftext|>", "İs"]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, long_passage = prose(30), prose(120)
    out = [None, "", "   \n\t ", "one", "one two three four", prose(5), prose(19), prose(20), prose(21), "same " * 300, passage, passage + " tail", prose(40) + "\n" + prose(40) + "\n", "a b\na b\n\na b", prose(20_000)]
    base = prose(200).split(" ")
    for i in range(40):  # near copies, a few words apart from one another
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"edit{i}_{rng.randrange(9)}"
        out.append(" ".join(w))
    out += [" ".join(base)] * 10
    while len(out) < n:
        kind, text = rng.random(), prose(rng.choice([8, 25, 60, 150, 300]))
        if kind < 0.3:
            text = text + " " + passage + " " + prose(10)
        elif kind < 0.5:
            text = prose(5) + "  " + long_passage + "\n" + text
        elif kind < 0.6 and out[-1]:
            text = out[-1].upper()
        out.append(text)
    return list(enumerate(out))
