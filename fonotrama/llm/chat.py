"""Chat formatting with a grammar that is parsed back.

    conversation := turn*
    turn         := "[INST]" text "[/INST]"            (user)
                  | text "</s>"                        (assistant)
                  | "<<SYS>>" text "<</SYS>>"          (system)
                  | "<|role|>" role "<|text|>" text "<|end|>"   (any other)
    text         := plain characters, or a backslash and the character it protects

Each turn is rendered plain and parsed back. Only if the parse differs from the source are the control
strings in it protected, and only if it still differs are backslashes too; that last form always reads
back. A turn closes its own state, so turns that read back one by one read back in sequence.

The turns of a conversation are rendered one by one, wherever they are; only their renderings are
brought together, sorted, and read as a stream by a parser that keeps one turn and running digests.
A conversation of any length so needs constant memory.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role and
text, and repeated rows are repeated turns; rows with a null conversation id form one conversation; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

OPEN = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
CONTROL = ("[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>", *OTHER)
_TOKEN = re.compile("|".join(map(re.escape, CONTROL)))
_READ = re.compile(r"\\(.)|(" + _TOKEN.pattern + ")", re.S)
LOSS_ROLE = "assistant"


def protect(text: str, level: int) -> str:
    """0: as it is; 1: control strings protected; 2: backslashes too."""
    if level == 2:
        text = text.replace("\\", "\\\\")
    return _TOKEN.sub(lambda m: "\\" + m[0], text) if level else text


def _lay_out(role: str, text: str, level: int) -> str:
    if role in OPEN:
        return OPEN[role][0] + protect(text, level) + OPEN[role][1]
    return OTHER[0] + protect(role, level) + OTHER[1] + protect(text, level) + OTHER[2]


def render(role: str, text: str) -> str:
    for level in (0, 1, 2):
        out = _lay_out(role, text, level)
        if parse(out) == [(role, text)]:
            break
    return out


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The (role, text) turns, or None if it isn't of the grammar."""
    turns: list[tuple[str, str]] = []
    held: list[str] = []
    state, role, at = "", "", 0  # state: the control string that must come next; "" between turns and in an assistant's text
    closes = {"[INST]": ("user", "[/INST]"), "<<SYS>>": ("system", "<</SYS>>")}
    for m in _READ.finditer(formatted):
        held.append(formatted[at : m.start()])
        at = m.end()
        if m[1] is not None:
            held.append(m[1])
            continue
        token = m[2]
        if state == "":
            if token == "</s>":
                turns.append(("assistant", "".join(held)))
            elif "".join(held):
                return None  # text outside a turn
            elif token in closes:
                role, state = closes[token]
            elif token == OTHER[0]:
                state = OTHER[1]
            else:
                return None
        elif token != state:
            return None
        elif token == OTHER[1]:
            role, state = "".join(held), OTHER[2]
        else:
            turns.append((role, "".join(held)))
            state = ""
        held.clear()
    return turns if at == len(formatted) and state == "" and not held else None


def rendered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, formatted, loss_start, loss_end``: one row per turn, in any order; the loss span is
    in code points of ``formatted``, empty unless an assistant's."""
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        roles, texts = C.texts_of(batch, "role"), C.texts_of(batch)
        out = [render(r, t) for r, t in zip(roles, texts, strict=True)]
        ends = [len(o) - len("</s>") if r == LOSS_ROLE else 0 for r, o in zip(roles, out, strict=True)]
        return {"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": roles, "text": texts, "formatted": out, "loss_start": [0] * len(out), "loss_end": ends}

    return C.map_rows(rows, run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def read_back(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """Parse the formatted output and digest it per conversation."""
    rows = turns.select("conv_id", "turn", "role", "text", "formatted")
    rows = (rows.repartition(parts, "conv_id") if parts else rows.repartition("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
    schema = C.arrow_schema(ddl := "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # [conv_id, turns, digest of turns, loss characters, digest of loss text, characters]

        def close(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        for batch in batches:
            done = []
            for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(close(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = parse(piece)
                if found is None:
                    raise ValueError(f"conversation {conv}: the formatted text is not of the grammar")
                for role, text in found:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        now[3] += len(text)
                        now[4].update(text.encode())
                now[5] += len(piece)
            if done:
                yield C.to_batch(dict(zip(schema.names, zip(*done, strict=True), strict=True)), schema)
        if now is not None:
            yield C.to_batch({k: [v] for k, v in zip(schema.names, close(now), strict=True)}, schema)

    return C.map_arrow(rows, run, ddl)
