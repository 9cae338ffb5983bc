"""Chat formatting: budgeted, turn-aligned windows of conversations with a loss mask.

A conversation's turns follow one another by (turn, role, text). Their token counts are summed up; a new
window begins where the tokens of its new turns would pass the budget. Each window holds the system turn
(a first turn of role `system`), then turns repeated from just before it as history, up to a limit, then
its new turns. Of the history, the oldest turns are left out where the first new turn would pass the budget
with them. Loss spans cover the new assistant texts only, so every assistant text is learnt once and
repeated ones are masked. Only a turn that is above the budget alone, or with the system turn, makes a
window above it, with no other turn.

The template marks turns with control strings; a control string inside a role or text gets a backslash
after its first character, and one that already has backslashes there gets one more, which is undone by
taking one away.

Null texts and roles are empty; repeated rows are separate turns; rows with null conv_id or turn form the
null conversation or come first; a text of any length is a turn, in memory once; an empty table gives no windows;
other columns are ignored, whatever their names. Rows are sorted within partitions and read as a stream, so a
conversation of any length needs no more memory than one window. (It is one task all the same: where a window
begins depends on all turns before it.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.llm.common import read, stage

BUDGET, HISTORY = 1024, 256
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
_INSIDE = "|".join(re.escape(x[1:]) for x in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_INSIDE})")
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\(?={_INSIDE})")
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]", re.S)
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
WINDOWS = "conv_id long, window long, text string, n_tokens long, first_new long, n_new long, loss_start array<long>, loss_end array<long>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def words_and_marks(text: str) -> int:
    """A count of a turn's tokens without a tokenizer: its words and two marks."""
    return len(text.split()) + 2


@dataclass(frozen=True)
class TokensAndMarks:
    """A turn's tokens by a tokenizer file of the tokenizers library, and two marks."""

    path: str

    def __call__(self, text: str) -> int:
        return len(_tokenizer(self.path).encode(text, add_special_tokens=False).ids) + 2


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def given_tokens() -> TokensAndMarks:
    """The default count: the tokens that op1 writes."""
    import public_tokenizers

    return TokensAndMarks(public_tokenizers.path("word_bpe_49k.json"))


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends there."""
    before, after = _MARKS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "[/TURN]")
    inner = escape(text)
    return before + inner + after, len(before), len(before) + len(inner)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window."""
    return [(m.lastgroup if m["role"] is None else unescape(m["role"]), unescape(m[m.lastgroup])) for m in _TURN.finditer(text)]


def windows_of(turns: Iterator[tuple[str, str]], budget: int, history: int, count: Callable[[str], int]) -> Iterator[dict]:
    """The windows of one conversation's turns."""
    system: tuple[str, str, int] | None = None
    past: list[tuple[str, str, int]] = []  # turns before the window, within the history limit
    new: list[tuple[str, str, int]] = []
    used = number = first_new = seen = 0

    def window() -> dict:
        out, start, end, at = [], [], [], 0
        keep_system = [system] if system is not None and first_new > 0 else []
        shown = [(t, False) for t in keep_system + past] + [(t, True) for t in new]
        for (role, text, _), fresh in shown:
            piece, lo, hi = marked(role, text)
            if fresh and role == "assistant":
                start.append(at + lo)
                end.append(at + hi)
            out.append(piece)
            at += len(piece)
        return {"window": number, "text": "".join(out), "n_tokens": sum(t[2] for t, _ in shown), "first_new": first_new, "n_new": len(new), "loss_start": start, "loss_end": end}

    for role, text in turns:
        turn = (role, text, count(text))
        if new and used + turn[2] > budget:
            yield window()
            keep, total = [], 0
            tail = [t for i, t in enumerate(past + new) if not (system is not None and t is system)]
            for t in reversed(tail):
                total += t[2]
                if total > history:
                    break
                keep.append(t)
            past, new, first_new, number = keep[::-1], [], seen, number + 1
            used = (system[2] if system is not None else 0) + sum(t[2] for t in past)
            while past and used + turn[2] > budget:
                used -= past.pop(0)[2]
        if seen == 0 and role == "system":
            system = turn
        new.append(turn)
        used += turn[2]
        seen += 1
    if new:
        yield window()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """The rows of each conversation, as they come, of a stream in which they stand together."""
    from itertools import groupby

    rows = (row for b in batches for lo in range(0, b.num_rows, 1000) for row in b.slice(lo, 1000).to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] | None = None) -> DataFrame:
    """The windows of turns(conv_id, turn, role, text), as WINDOWS. count gives a text's tokens (given_tokens())."""
    count = count or given_tokens()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("first_new", pa.int64()), ("n_new", pa.int64()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])
        out: list[dict] = []
        for conv, rows in runs(batches):
            for w in windows_of(((r["role"] or "", r["text"] or "") for r in rows), budget, history, count):
                out.append({"conv_id": conv, **w})
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = turns.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(pack, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """What the windows hold for each conversation, by parsing their texts and loss spans."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in runs(batches):
            all_turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for w in rows:
                turns = parse(w["text"])
                for role, text in turns[len(turns) - w["n_new"] :]:
                    all_turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for lo, hi in zip(w["loss_start"], w["loss_end"], strict=True):
                    text = unescape(w["text"][lo:hi])
                    loss.update(text.encode())
                    loss_chars += len(text)
                chars += len(w["text"])
            out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(stage(format_conversations(turns.unionByName(extra)), "chat-windows"))
