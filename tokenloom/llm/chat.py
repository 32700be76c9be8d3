"""Chat formatting (operator 3): budgeted windows over the turns of conversations, with loss masks.

A conversation's turns stream in order through one task, sorted by Spark. Prefix sums of the turns' tokens choose
turn-aligned spans: each window holds the system turn, limited history repeated from the window before, and as many
new turns as the budget takes. Only assistant texts of new turns are under the loss mask, so every assistant text is
learned from exactly once. A task keeps the system turn, the history and the turns of one window, whatever the
length of a conversation.

Template: <|im_start|>role, a newline, the text, <|im_end|> and a newline. Inside texts the sequence "<", n
backslashes, "|" is written with n+1 backslashes, so a text never holds "<|" and is read back exactly; in roles
backslashes and newlines are escaped as well.

Edge cases: null text and null role are empty; rows of one turn number are ordered by role and text, null turns
come first; repeated rows are turns of their own; rows with null conv_id form one conversation; a turn larger than
the budget has a window of its own without history; the system turn is the first turn if its role is system; extra
columns are left out; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import bound_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of the history that it may repeat, and of a turn's marks.
BUDGET, HISTORY, MARKS = 1024, 256, 4
TOKEN = re.compile(r"\w+|[^\w\s]")
WINDOW_SCHEMA = "conv_id long, window int, repeated int, n_tokens int, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Conversation:
    """Turns (role, text, tokens) of one conversation that wait for a window."""

    conv_id: int | None
    system: tuple | None = None
    history: list = field(default_factory=list)
    waiting: list = field(default_factory=list)
    windows: int = 0
    seen: bool = False

    def add(self, role: str, text: str) -> None:
        turn = (role, text, len(TOKEN.findall(text)) + MARKS)
        if not self.seen and role == "system":
            self.system = turn
        self.seen = True
        self.waiting.append(turn)

    def cut(self, budget: int, history: int, final: bool) -> Iterator[tuple]:
        """Windows that are full; with final, the rest too."""
        while self.waiting:
            repeated = ([self.system] if self.system and self.windows else []) + self.history
            room = budget - sum(t[2] for t in repeated)
            prefix = np.cumsum([t[2] for t in self.waiting])
            if prefix[0] > room and self.history:  # the first new turn needs the history's room
                self.history = []
                continue
            n = int(np.searchsorted(prefix, room, "right"))
            if n == len(self.waiting) and not final:
                return
            n = max(1, n)
            new, self.waiting = self.waiting[:n], self.waiting[n:]
            yield self.window(repeated, new)
            kept = np.cumsum([t[2] for t in reversed(new)])
            self.history = new[len(new) - int(np.searchsorted(kept, history, "right")) :]
            if self.system and self.windows == 1 and len(self.history) == len(new):
                self.history = self.history[1:]  # the system turn is repeated anyway

    def window(self, repeated: list, new: list) -> tuple:
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate([*repeated, *new]):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts.append(f"{head}{body}{END}\n")
            at += len(parts[-1])
        self.windows += 1
        return self.conv_id, self.windows - 1, len(repeated), sum(t[2] for t in [*repeated, *new]), "".join(parts), loss


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations, a conversation's windows in order within one partition. conversations: conv_id, turn, role, text."""
    columns = WINDOW_SCHEMA.replace(", loss array<struct<start:int,end:int>>", "").split(", ")
    names = [*[c.split()[0] for c in columns], "loss"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        for pdf in batches:
            out: list[tuple] = []
            for conv_id, role, text in zip(map(_id, pdf["conv_id"].tolist()), pdf["role"].tolist(), pdf["text"].tolist(), strict=True):
                if now is None or now.conv_id != conv_id:
                    out += now.cut(budget, history, True) if now else []
                    now = Conversation(conv_id)
                now.add(role if isinstance(role, str) else "", text if isinstance(text, str) else "")
                if len(now.waiting) >= 64:
                    out += now.cut(budget, history, False)
            yield _frame(out, names)
        if now:
            yield _frame(list(now.cut(budget, history, True)), names)

    bound_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text").mapInPandas(run, WINDOW_SCHEMA)


def _id(text: object) -> int | None:
    """A conversation's number from its text: pandas would round numbers that stand beside a null."""
    return int(text) if isinstance(text, str) else None


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([r[1:] for r in rows], columns=names[1:])
    out.insert(0, names[0], pd.array([r[0] for r in rows], "Int64"))
    return out


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body[: body.rindex(END)])))
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_windows of each conversation, read from its windows' texts and masks alone. windows: as format_windows leaves them, so no further shuffle is needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        now, turns, loss, sums = "none", hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]

        def row() -> list[tuple]:
            return [] if now == "none" else [(now, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3])]

        for pdf in batches:
            out: list[tuple] = []
            for conv_id, repeated, text, spans in zip(map(_id, pdf["conv_id"].tolist()), pdf["repeated"].tolist(), pdf["text"].tolist(), pdf["loss"].tolist(), strict=True):
                if conv_id != now:
                    out += row()
                    now, turns, loss, sums = conv_id, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                for role, said in read_turns(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    sums[0] += 1
                for s in spans:
                    learned = unescape(text[s["start"] : s["end"]])
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                    sums[1] += len(learned)
                sums[2] += len(text)
                sums[3] += 1
            yield _frame(out, names)
        yield _frame(row(), names)

    slim = windows.select(F.col("conv_id").cast("string").alias("conv_id"), "repeated", "text", "loss")
    return slim.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of conversation -1, whose texts hold control strings."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    columns = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    base = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return read_back(format_windows(base.unionByName(probe)))
