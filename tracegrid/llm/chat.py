"""Chat formatting: a state machine over roles checks the order of turns; a declarative template gives segments with loss flags."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import through_python


@dataclass(frozen=True)
class Template:
    """How a conversation is written. `roles`: name in the table -> name in the header. `loss`: roles that are learnt from.

    `order`: state -> role -> next state; a conversation starts in "start" and is complete in a state of `final`.
    Inside names and texts, `escape` is put before itself and before the first character of each control string.
    """

    header: str = "### "
    colon: str = ": "
    end: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    roles: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple = ("assistant",)
    order: dict = field(default_factory=lambda: {"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple = ("answered",)

    def escaped(self, text: str) -> str:
        e = self.escape
        text = text.replace(e, e + e)
        for control in (self.header, self.colon, self.end):
            text = text.replace(control, e + control)
        return text

    def unescaped(self, text: str) -> str:
        out, at, e = [], 0, self.escape
        while (k := text.find(e, at)) >= 0:
            out += [text[at:k], text[k + 1 : k + 2]]
            at = k + 2
        return "".join([*out, text[at:]])

    def find(self, text: str, control: str, at: int = 0) -> int:
        """Where the control string stands unescaped."""
        while (k := text.find(control, at)) >= 0:
            back = k
            while back > 0 and text[back - 1] == self.escape:
                back -= 1
            if (k - back) % 2 == 0:
                return k
            at = k + 1
        return -1

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """The parts of a turn and whether each is learnt from."""
        name = self.roles.get(role, role if role is not None else "")
        known = role in self.roles or (role is not None and name not in self.roles.values())
        name = self.escaped(name) if known else self.escape + "0" + self.escaped(name)  # null, or a header name taken literally
        return [(self.header + name + self.colon, False), (self.escaped(text or ""), role in self.loss), (self.end + self.after, False)]

    def turn(self, written: str) -> tuple[str | None, str]:
        """Role and text of one written turn."""
        a = self.find(written, self.colon, len(self.header))
        name, body = written[len(self.header) : a], written[a + len(self.colon) :]
        body = self.unescaped(body[: self.find(body, self.end)])
        if name.startswith(self.escape + "0"):
            rest = self.unescaped(name[2:])
            return (rest or None), body
        name = self.unescaped(name)
        return next((k for k, v in self.roles.items() if v == name), name), body


DEFAULT = Template()
_KEYS = ["conv_id", "turn"]


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """A row for each turn: conv_id, turn, role, segments (text, loss), state after it, valid (so far), last.

    Rows of a conversation are brought together in the order of turn, then role, then text (nulls first), and pass through
    the state machine one by one; a task holds one batch and one state, however long a conversation is. A turn that the
    machine does not allow is formatted all the same; it and all later turns have valid = false and state "refused".
    Null text is empty; a null role is no role of the template. A null conv_id is a conversation of its own. Repeated rows
    are turns of their own. Empty tables give no rows. Other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), "start"
        for f in frames:
            out = []
            for conv, turn, role, text in zip(f["conv_id"], f["turn"], f["role"], f["text"], strict=True):
                conv = None if conv != conv else conv
                if conv != now:
                    now, state = conv, "start"
                state = template.order.get(state, {}).get(role, "refused")
                out.append((conv, turn, role, template.segments(role, text), state, state != "refused", state in template.final))
            frame = pd.DataFrame(out, columns=["conv_id", "turn", "role", "segments", "state", "valid", "complete"])
            frame["segments"] = [[{"text": t, "loss": y} for t, y in s] for s in frame["segments"]]
            yield frame

    return through_python(rows, run, _KEYS, "role string, segments array<struct<text: string, loss: boolean>>, state string, valid boolean, complete boolean")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What the formatted conversations say, one row each, read from the segments' text as it is written.

    Takes the rows as format_turns() leaves them: each conversation together and in order. Checksums are carried on from
    turn to turn, so a conversation's length does not matter.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete"]
        open_ = None
        close = lambda o: (o[0], o[1], o[2].hexdigest(), o[3], o[4].hexdigest(), o[5], o[6], o[7])
        for f in frames:
            done = []
            for conv, segments, valid, complete in zip(f["conv_id"], f["segments"], f["valid"], f["complete"], strict=True):
                conv = None if conv != conv else conv
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        done.append(close(open_))
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, False]
                written = "".join(s["text"] for s in segments)
                role, text = template.turn(written)
                learnt = template.unescaped("".join(s["text"] for s in segments if s["loss"]))
                open_[1] += 1
                open_[2].update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
                open_[3] += len(learnt)
                open_[4].update(learnt.encode("utf-8", "surrogatepass"))
                open_[5] += len(written)
                open_[6:] = [bool(valid), bool(complete)]
            yield pd.DataFrame(done, columns=cols)
        if open_ is not None:
            yield pd.DataFrame([close(open_)], columns=cols)

    return through_python(formatted.select("conv_id", "segments", "valid", "complete"), run, "conv_id", "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, complete boolean")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold the control strings of the usual template."""
    text = r"\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
