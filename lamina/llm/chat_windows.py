"""Chat formatting in budgeted windows (operator 1).

A conversation's turns stream by in order. Prefix sums of their token counts choose
turn-aligned spans: a window holds the system turn, a limited history of turns that
earlier windows held, and new turns up to the budget. Only the assistant texts of new
turns are under the loss mask, so each is a target once. One window is in memory at a
time, however long the conversation.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written

BUDGET, HISTORY = 1024, 192
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# Control strings of common chat templates; none survives inside an escaped text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_SPLIT = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_BACK = re.compile(r"\\(.)", re.DOTALL)
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)
_PIECE = re.compile(r"\w+|[^\w\s]")
# Fixed value: the usual pattern that cuts text before byte-pair merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOWS = "conv_id long, window long, text string, loss array<struct<start:int,end:int>>, n_repeated int, n_new int, n_tokens long"
_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64())])
YIELD = 4 << 20


def escape(text: str) -> str:
    """Put a backslash inside every control string and before every backslash."""
    return _SPLIT.sub("\\\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def counter_of(vocabulary: bytes | None):
    """A token counter: byte-pair ranks (base64 and rank a line), or words and marks without."""
    if vocabulary is None:
        return lambda text: len(_PIECE.findall(text))
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    encoding = tiktoken.Encoding("lamina", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


class _Conversation:
    """Turns in, windows out; keeps the open window and the history before it."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.seen = self.window = 0
        self.turns: list[tuple[str, tuple[int, int] | None]] = []  # history, then new turns
        self.sums = [0]  # prefix sums of their tokens
        self.start = 0  # of the new turns

    def add(self, role: str, text: str, n_tokens: int, rendered: str, target: tuple[int, int] | None):
        """The window that this turn closes, if any."""
        out = None
        if not self.seen and role == "system":
            self.system = (rendered, n_tokens)
        base = self.system[1] if self.system else 0
        if self.system and not self.seen:
            self.seen = 1
            return None
        self.seen += 1
        if self.start < len(self.turns) and base + self.sums[-1] + n_tokens > self.budget:
            out = self.close()
            # history: the last turns within its own limit and what the new turn leaves
            room = min(self.history, self.budget - base - n_tokens)
            first = bisect_left(self.sums, self.sums[-1] - room) if room > 0 else len(self.turns)
            self.turns = self.turns[first:]
            self.sums = [s - self.sums[first] for s in self.sums[first:]]
            self.start = len(self.turns)
        self.turns.append((rendered, target))
        self.sums.append(self.sums[-1] + n_tokens)
        return out

    def close(self):
        parts, loss, at = [], [], 0
        if self.system:
            parts.append(self.system[0])
            at += len(self.system[0])
        for i, (rendered, target) in enumerate(self.turns):
            if target and i >= self.start:
                loss.append({"start": at + target[0], "end": at + target[1]})
            parts.append(rendered)
            at += len(rendered)
        repeated = self.start + (1 if self.system and self.window else 0)
        new = len(self.turns) - self.start + (1 if self.system and not self.window else 0)
        row = (self.conv_id, self.window, "".join(parts), loss, repeated, new, self.sums[-1] + (self.system[1] if self.system else 0))
        self.window += 1
        return row

    def last(self):
        return self.close() if self.start < len(self.turns) or not self.window else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n_tokens", pa.int64())])


def _counter(vocabulary_var):
    """Count tokens of rendered turns where they lie, before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(vocabulary_var.value)
        for batch in batches:
            n = [count(_rendered(role, text)[0]) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], schema=_TURNS)

    return run


def _rendered(role: str, text: str) -> tuple[str, int, int]:
    """(the marked turn, where its text begins and ends)."""
    head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def _formatter(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held, size = None, [], 0
        for batch in batches:
            for conv, role, text, n_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or conv != open_.conv_id:
                    if open_ and (row := open_.last()):
                        held.append(row)
                    open_ = _Conversation(conv, budget, history)
                rendered, start, end = _rendered(role, text)
                if row := open_.add(role, text, n_tokens, rendered, (start, end) if role == "assistant" else None):
                    held.append(row)
                size += len(rendered)
                if size > YIELD and held:
                    yield _batch(held)
                    held, size = [], 0
        if open_ and (row := open_.last()):
            held.append(row)
        if held:
            yield _batch(held)

    return run


def format_windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """Windows of (conv_id, turn, role, text): the text, its loss mask and what it repeats.

    ``loss`` holds code-point ranges of ``text``; the first ``n_repeated`` turns stand in
    earlier windows too. ``vocabulary``: the path, readable by the driver, of byte-pair
    ranks; without it words and punctuation marks are counted. A turn above the budget
    has a window of its own (with the system turn). Tokens are counted before the shuffle;
    the windows of one conversation depend on each other, so one task streams its turns,
    with one window in memory.

    Defined cases: null roles and texts read as empty; turns go by ``turn`` (null
    first), ties by role and text, repeated rows stay; null conv_ids are one
    conversation; an empty table gives no windows; other columns are not read.
    """
    raw = None
    if vocabulary:
        with open(vocabulary, "rb") as f:
            raw = f.read()
    sent = turns.sparkSession.sparkContext.broadcast(raw)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counter(sent), "conv_id long, turn long, role string, text string, n_tokens long")
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "n_tokens").mapInArrow(_formatter(budget, history), WINDOWS)


def parse_window(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(text)]


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_READ_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what the windows of each conversation say; windows arrive in order."""
    now: list | None = None

    def done():
        conv, n, turns, chars, loss, formatted, windows = now
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows)

    for batch in batches:
        held = []
        for conv, text, loss, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "n_repeated")), strict=True):
            if now is None or now[0] != conv:
                if now:
                    held.append(done())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said in parse_window(text)[repeated:]:
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
            now[6] += 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _READ_SCHEMA, strict=True)], schema=_READ_SCHEMA)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), _READ_SCHEMA, strict=True)], schema=_READ_SCHEMA)


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_windows``: counts and digests.

    Windows may come in any order and from any file: they are put in order first.
    """
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_reader, READ)


# A public vocabulary of byte pairs; where the driver doesn't have it words are counted.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_chat_formatting(spark, sf_dir: str, vocabulary: str | None = VOCABULARY) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    known = vocabulary if vocabulary and os.path.exists(vocabulary) else None
    return read_windows(written(format_windows(turns.unionByName(more), vocabulary=known), "windows"))
