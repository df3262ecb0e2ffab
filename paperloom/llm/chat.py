"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns: prefix sums of turn tokens choose how many new turns fit the budget
beside the system turn, which every window retains, and the last turns before (up to a history budget), which are
repeated for context. The loss mask of a window covers the texts of its new assistant turns alone, so every assistant
text is a target exactly once. A turn over the budget gets a window of its own and is never cut. A system turn of more
than half the budget stands in the first window only: repeated, it would leave the windows to itself.

The template is `<|im_start|>role`, a newline, the text, `<|im_end|>`, a newline. Inside texts and roles each `<`
followed by any number of `\\` and a `|` gets one more `\\` after the `<`, so that no control string can occur there;
taking one away again restores the text. Newlines and `\\` in roles are escaped with `\\`.

Conversations are streams: rows are partitioned by conversation, sorted by turn, and formatted with no more in memory
than one window and its history, however long a conversation is. Null texts and roles are empty, turns with equal
numbers go by role and text, null turns come first, rows with a null conv_id are one conversation, repeated rows are
turns like others; an empty table gives an empty table, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame

BUDGET, HISTORY = 512, 128
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
WINDOW_DDL = "conv_id long, window long, text string, n_repeated long, loss array<struct<start:long,end:long>>"
TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """Words and signs, and the three marks of a turn."""
    return sum(1 for _ in TOKEN.finditer(text)) + 3


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class _Windows:
    """The windows of one conversation, turn by turn. ends are the prefix sums of the tokens of the turns held."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history, self.number = conv, budget, history, 0
        self.system: tuple[str, str] | None = None
        self.fixed = 0  # tokens of the system turn that is retained
        self.turns: list[tuple[str, str]] = []
        self.ends = [0]
        self.new = 0  # where the new turns begin

    def _forget(self, k: int) -> None:
        """The first k turns held go."""
        del self.turns[:k]
        self.ends = [e - self.ends[k] for e in self.ends[k:]]
        self.new = max(0, self.new - k)

    def add(self, role: str, text: str):
        n = count_tokens(text)
        if self.new < len(self.turns) and self.fixed + self.ends[-1] + n > self.budget:
            yield self.flush()
        if self.new == len(self.turns):  # a long turn leaves less room for history
            self._forget(min(bisect_left(self.ends, self.ends[-1] + self.fixed + n - self.budget), len(self.turns)))
        self.turns.append((role, text))
        self.ends.append(self.ends[-1] + n)

    def flush(self):
        repeated = ([self.system] if self.system else []) + self.turns[: self.new]
        out, loss, at = [], [], 0
        for k, (role, text) in enumerate(repeated + self.turns[self.new :]):
            head, body = f"{OPEN}{_role(role)}\n", escape(text)
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            out.append(f"{head}{body}{CLOSE}\n")
            at += len(out[-1])
        row = (self.conv, self.number, "".join(out), len(repeated), loss)
        if self.number == 0 and self.turns[0][0] == "system":
            if self.ends[1] <= self.budget // 2:
                self.system, self.fixed = self.turns[0], self.ends[1]
            self._forget(1)
        self._forget(bisect_left(self.ends, self.ends[-1] - self.history))
        self.new, self.number = len(self.turns), self.number + 1
        return row


def _format(budget: int, history: int):
    def run(frames):
        now, first, rows, size = None, True, [], 0
        frame = lambda: pd.DataFrame(rows, columns=["conv_id", "window", "text", "n_repeated", "loss"]).astype({"conv_id": "Int64"})
        for f in frames:
            for conv, role, text in zip(f["conv_id"], f["role"], f["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if first or conv != now.conv:
                    if not first:
                        rows.append(now.flush())
                    now, first = _Windows(conv, budget, history), False
                for row in now.add(role or "", text or ""):
                    rows.append(row)
                    size += len(row[2])
            if len(rows) > 500 or size > 4 << 20:
                yield frame()
                rows, size = [], 0
        if not first:
            rows.append(now.flush())
        if rows:
            yield frame()

    return run


def format_chats(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window, text, n_repeated, loss) of rows(conv_id, turn, role, text); loss: code points [start, end)."""
    rows = rows.selectExpr("cast(conv_id as long) as conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInPandas(_format(budget, history), WINDOW_DDL)


def parse(text: str, n_repeated: int) -> list[tuple[str, str]]:
    """The new turns of a window."""
    turns = []
    for piece in text.split(OPEN)[1:]:
        head, _, rest = piece.partition("\n")
        turns.append((_unrole(head), unescape(rest[: rest.rindex(CLOSE)])))
    return turns[n_repeated:]


def _read(frames):
    now, rows = None, []

    def done():
        conv, n, turns, chars, loss, formatted = now
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    frame = lambda: pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
    for f in frames:
        for conv, text, repeated, loss in zip(f["conv_id"], f["text"], f["n_repeated"], f["loss"]):
            conv = None if pd.isna(conv) else int(conv)
            if now is None or conv != now[0]:
                if now is not None:
                    rows.append(done())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(text, int(repeated)):
                now[1] += 1
                now[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                target = unescape(text[span["start"] : span["end"]])
                now[3] += len(target)
                now[4].update(target.encode("utf-8", "surrogatepass"))
            now[5] += len(text)
        if len(rows) > 1000:
            yield frame()
            rows = []
    if now is not None:
        rows.append(done())
        yield frame()


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, from the windows as format_chats gives them (a conversation's together, in order)."""
    return windows.mapInPandas(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
