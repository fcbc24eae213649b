"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events ordered by ``seq``. Folding the log gives the final
messages, which are then rendered with a template that marks turns. Kinds of event:

* ``message``     a whole message (role and text)
* ``delta``       text appended to the last message if its role is the same, else a new one
* ``edit``        replaces the text of message ``target`` (its number, from 0)
* ``regenerate``  drops the assistant messages at the end of the log so far; the deltas or
                  the message that follow take their place

A log is partitioned by conversation and sorted inside its partition, and the fold reads the
sorted rows as a stream, so a partition never has to fit in memory; one conversation's
rendered text does. Null text is empty, a null role is an empty role, a null kind is
``message``. A null conversation id is a conversation of its own. Events with equal ``seq``
are ordered by kind, role and text; a repeated row is a repeated event. An edit of a message
that does not exist is ignored. An empty log gives nothing; texts of any length are kept whole;
other columns of the input are not read, whatever their names.

Template: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n``. In roles and texts each
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a mark, and the
original is restored exactly. The loss mask covers the text of assistant messages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import extended

START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Message:
    role: str
    text: str


def fold(events: Iterable[tuple[str, str, str, int | None]]) -> list[Message]:
    """Final messages of one log of (kind, role, text, target), in order."""
    out: list[Message] = []
    parts: list[str] = []  # deltas of the last message, joined once

    def settle() -> None:
        if parts:
            out[-1].text += "".join(parts)
            parts.clear()

    for kind, role, text, target in events:
        if kind == "delta" and out and out[-1].role == role:
            parts.append(text)
            continue
        settle()
        if kind == "edit":
            if target is not None and 0 <= target < len(out):
                out[target].text = text
        elif kind == "regenerate":
            while out and out[-1].role == "assistant":
                out.pop()
        elif kind in ("message", "delta"):
            out.append(Message(role, text))
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    settle()
    return out


def render(messages: list[Message]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (code points) under the loss mask."""
    parts, spans, at = [], [], 0
    for m in messages:
        head, body = f"{START}{_escape_role(m.role)}\n", escape(m.text)
        if m.role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[Message]:
    """The messages that a formatted text was made from."""
    return [Message(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def events(
    rows: DataFrame,
    *,
    conv_col: str = "conv_id",
    seq_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    kind_col: str | None = None,
    target_col: str | None = None,
) -> DataFrame:
    """An event log from a table; rows without a kind are whole messages."""
    return rows.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{seq_col}`").alias("seq"),
        F.coalesce(F.col(f"`{kind_col}`") if kind_col else F.lit("message"), F.lit("message")).alias("kind"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        (F.col(f"`{target_col}`") if target_col else F.lit(None)).cast("int").alias("target"),
    )


def format_chats(log: DataFrame) -> DataFrame:
    """conv, formatted, loss_spans (start and end, code points): one row for each log."""
    dealt = log.repartition("conv").sortWithinPartitions("conv", "seq", "kind", "role", "text", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def closed() -> dict:
            text, spans = render(fold(held))
            return {"conv": current, "formatted": text, "loss_spans": [[a, b] for a, b in spans]}

        for batch in batches:
            done = []
            for conv, kind, role, text, target in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "target")), strict=True):
                if held and conv != current:
                    done.append(closed())
                    held.clear()
                current = conv
                held.append((kind, role, text, target))
            if done:
                yield _batch(done, batch.schema.field("conv").type)
            kind_of_conv = batch.schema.field("conv").type
        if held:
            yield _batch([closed()], kind_of_conv)

    return dealt.mapInArrow(run, extended(log.select("conv").schema, "formatted string, loss_spans array<array<long>>"))


def _batch(rows: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema([("conv", conv_type), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The columns of the registered query, read back from the formatted texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{m.role}\n{m.text}\n" for m in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(v) for v in out.values())], names=[id_col, *out])

    schema = extended(
        formatted.select(F.col("conv").alias(id_col)).schema,
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
    return formatted.mapInArrow(run, schema)
