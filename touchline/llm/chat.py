"""Chat formatting by a finite-state machine over roles.

``format_chat`` turns conversations into text segments with a loss flag each. A
declarative template gives the strings around a turn, the allowed order of
roles and the roles that are learned. Control strings inside a text are escaped
by a backslash after their first character (and backslashes doubled), so that
``read_back`` restores every text.

Rows of a conversation come together by a shuffle on ``conv_id`` and are sorted
inside their partition; the functions below run over that sorted stream row by
row, so a conversation of any length needs the memory of one turn only.

Results by case: null text counts as empty, a null role as the role ""; rows of
equal ``turn`` are ordered by role, then text; rows with null ``conv_id`` form
one conversation of that id; a conversation out of order is formatted all the
same and marked by ``ok`` false; an empty table gives an empty one; further
columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """``around``: what stands before and after a role's text. ``moves``: state and role to the next state."""

    around: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE ", ">>", "<</ROLE>>")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>")
    learned: frozenset = frozenset({"assistant"})
    moves: dict = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: frozenset = frozenset({"answered"})

    def escape(self, text: str) -> str:
        inner = "|".join(map(re.escape, self.controls))
        return re.sub(f"(?=({inner}))(.)", r"\2\\", text.replace("\\", "\\\\"), flags=re.DOTALL)

    @staticmethod
    def unescape(text: str) -> str:
        # a doubled backslash stands for one, a single one was put in
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.around:
            before, after = self.around[role]
        else:
            before, after = self.other[0] + quote(role, safe="") + self.other[1], self.other[2]
        return [(before, False), (self.escape(text), role in self.learned), (after, False)]

    def take_turn(self, text: str) -> tuple[str, str, int] | None:
        """Role and (still escaped) text of the turn at the start, and where it ends; None if it is not complete."""
        for role, (before, after) in self.around.items():
            if before and text.startswith(before):
                end = text.find(after, len(before))
                return None if end < 0 else (role, text[len(before) : end], end + len(after))
        if text.startswith(self.other[0]):
            name = text.find(self.other[1], len(self.other[0]))
            end = text.find(self.other[2], max(name, 0))
            if name < 0 or end < 0:
                return None
            return unquote(text[len(self.other[0]) : name]), text[name + len(self.other[1]) : end], end + len(self.other[2])
        bare = next(r for r, (before, _) in self.around.items() if not before)
        after = self.around[bare][1]
        end = text.find(after)
        return None if end < 0 else (bare, text[:end], end + len(after))


TEMPLATE = Template()
#: A batch of segments goes on after so many rows or characters.
BATCH_ROWS, BATCH_CHARS = 5_000, 1 << 22


def format_chat(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Rows ``conv_id, segment, text, loss, ok``, in order inside each partition.

    ``ok`` says whether the turns so far are in order; the last segment of a
    conversation is empty and says whether the whole conversation is accepted.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        chars = 0
        now: object = run  # no conversation yet
        state, n = "start", 0
        names = ["conv_id", "segment", "text", "loss", "ok"]

        def frame() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=names)
            return df.astype({"conv_id": "Int64", "segment": "int64", "loss": bool, "ok": bool})

        for rows in frames:
            for conv, role, text in zip(rows["conv_id"].astype("Int64").tolist(), rows["role"].tolist(), rows["text"].tolist()):
                conv = None if conv is pd.NA else conv
                role, text = role or "", text or ""
                if now is run or conv != now:
                    if now is not run:
                        out.append((now, n, "", False, state in template.final))
                    now, state, n = conv, "start", 0
                state = template.moves.get((state, role), "wrong")
                for piece, loss in template.segments(role, text):
                    out.append((conv, n, piece, loss, state != "wrong"))
                    n += 1
                    chars += len(piece)
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield frame()
                    out, chars = [], 0
        if now is not run:
            out.append((now, n, "", False, state in template.final))
        if out:
            yield frame()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.mapInPandas(run, "conv_id long, segment long, text string, loss boolean, ok boolean")


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation what its segments say; they must be in order inside each partition, as ``format_chat`` leaves them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "accepted"]
        out: list[tuple] = []
        now: object = run
        buffer, turns, losses = "", hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        accepted = False

        def close() -> None:
            if buffer:
                raise ValueError(f"conversation {now}: its text ends inside a turn")
            out.append((now, n_turns, turns.hexdigest(), loss_chars, losses.hexdigest(), chars, accepted))

        for rows in frames:
            for conv, text, loss, ok in zip(rows["conv_id"].astype("Int64").tolist(), rows["text"].tolist(), rows["loss"].tolist(), rows["ok"].tolist()):
                conv = None if conv is pd.NA else conv
                if now is run or conv != now:
                    if now is not run:
                        close()
                    now, buffer, turns, losses = conv, "", hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = chars = 0
                chars += len(text)
                accepted = ok
                if loss:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    losses.update(plain.encode())
                buffer += text
                if not loss:  # a turn ends with a segment outside the loss
                    while buffer and (turn := template.take_turn(buffer)):
                        role, body, end = turn
                        turns.update(f"{role}\n{template.unescape(body)}\n".encode())
                        n_turns += 1
                        buffer = buffer[end:]
            if len(out) >= BATCH_ROWS:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out.clear()
        if now is not run:
            close()
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, accepted boolean"
    return formatted.mapInPandas(run, schema)
