"""Windows keep the budget where the system turn and a turn fit it."""

import random

from gridwise.llm import chat_format

text = lambda n: "w " * (n - 2)  # noqa: E731  n tokens


def test_history_gives_way_to_the_first_new_turn():
    turns = [("system", text(20))] + [("user", text(100))] * 12 + [("assistant", text(900)), ("user", text(50)), ("assistant", text(1_010)), ("user", text(2_000)), ("user", text(10))]
    out = list(chat_format.windows_of(iter(turns), 1024, 256, chat_format.words_and_marks))
    assert [w["n_tokens"] for w in out if w["n_tokens"] > 1024] == [1_030, 2_020]
    assert all(len(chat_format.parse(w["text"])) == 2 for w in out if w["n_tokens"] > 1024)
    assert any(w["n_tokens"] == 1020 for w in out)  # the system turn, one turn of history, the turn of 900


def test_random_turns_keep_the_budget():
    rng = random.Random(1)
    for _ in range(50):
        turns = [(rng.choice(["user", "assistant"]), text(rng.choice([3, 50, 250, 700, 900, 1_024]))) for _ in range(40)]
        out = list(chat_format.windows_of(iter(turns), 1024, 256, chat_format.words_and_marks))
        assert max(w["n_tokens"] for w in out) <= 1024 and sum(w["n_new"] for w in out) == 40


def plain_windows(turns, budget, history, count):
    """Brute force, by sums over lists of turn numbers: (history turns, new turns) of each window."""
    tokens = [count(t) for _, t in turns]
    system = [0] if turns and turns[0][0] == "system" else []
    out, at = [], 0
    while at < len(turns):
        back = [i for i in range(at) if i not in system]
        while sum(tokens[i] for i in back) > history:
            back.pop(0)
        head = system if at else []
        while back and sum(tokens[i] for i in head + back) + tokens[at] > budget:
            back.pop(0)
        end = at + 1
        while end < len(turns) and sum(tokens[i] for i in head + back) + sum(tokens[at : end + 1]) <= budget:
            end += 1
        out.append((head + back, list(range(at, end))))
        at = end
    return out


def test_windows_equal_brute_force():
    rng = random.Random(6)
    for n in range(150):
        turns = [(rng.choice(["user", "assistant", "tool", "system"]), f"{i} [INST] " + text(rng.choice([2, 9, 40, 120, 300]))) for i in range(rng.randrange(1, 25))]
        if n % 2:
            turns[0] = ("system", turns[0][1])
        got = list(chat_format.windows_of(iter(turns), 200, 90, chat_format.words_and_marks))
        want = plain_windows(turns, 200, 90, chat_format.words_and_marks)
        assert [(w["first_new"], w["n_new"]) for w in got] == [(new[0], len(new)) for _, new in want]
        for w, (old, new) in zip(got, want, strict=True):
            assert chat_format.parse(w["text"]) == [turns[i] for i in old + new]
            loss = [chat_format.unescape(w["text"][a:b]) for a, b in zip(w["loss_start"], w["loss_end"], strict=True)]
            assert loss == [turns[i][1] for i in new if turns[i][0] == "assistant"]


def test_tokens_of_the_given_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, i, "user", "汉字" * 30 + f" turn {i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long")
    out = chat_format.format_conversations(df, budget=300, history=100).collect()
    size = {r[3]: len(plain.encode(r[3], add_special_tokens=False).ids) + 2 for r in rows}
    assert all(w["n_tokens"] == sum(size[t] for _, t in chat_format.parse(w["text"])) <= 300 for w in out) and len(out) > 5
