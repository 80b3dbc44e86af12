"""Chat formatting: event-sourced reconstruction of conversations, then rendering with a loss mask.

Events carry conv_id, message (place in the conversation), seq (order of arrival), kind, role and text:

* ``delta`` appends to the message; ``message`` sets it whole;
* ``edit`` replaces the message, ``regenerate`` empties it, and both drop what later messages held until then.

Logs are partitioned by conversation and sorted by sequence.  Messages are folded first, one row each, and
conversations are put together from messages, so a task holds one conversation's final messages, never its events.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a backslash is doubled, ``<|`` becomes
``<\\|``, and a line end in a role gets a backslash; dropping one backslash before any character undoes it.  The loss
mask is a list of code-point ranges of the formatted text: the assistant's texts, without their end marks.

Nulls: a null text is empty, a null role is ``user``, a null conversation id is one conversation, null places and
sequences sort first.  Equal events of one sequence number fold once each, in order of kind and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA_CHARS = 512
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*+)\n((?:[^<\\]|\\.|<(?!\|))*+)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def events_of_rows(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chars: int = DELTA_CHARS, revisions: bool = False) -> DataFrame:
    """A log that ends in a table of turns: each row a message, its text in deltas.

    Rows of a conversation that share a turn are messages of their own, in order of role and text.  With ``revisions``
    the log has a past: of three messages that follow each other, one was a draft that an ``edit`` replaced and one an
    answer cut short that was asked for again by ``regenerate``; both times a reply had begun and is thrown away.
    """
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("message", place.cast("long"))
    parts = F.expr(f"transform(sequence(0, greatest(0, (length(text) - 1) div {chars})), i -> substring(text, cast(i * {chars} as int) + 1, {chars}))")
    rows = rows.select("conv_id", "message", "role", parts.alias("parts"))

    def event(kind: str, text: Column, at: Column | int, role: Column | str = "role", later: int = 0) -> Column:
        role = F.col(role) if isinstance(role, str) else role
        return F.struct((F.col("message") + later).alias("message"), (F.col("message") * (1 << 32) + at).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    def streamed(texts: Column, start: int = 0) -> Column:
        return F.transform(texts, lambda x, i: event("delta", x, i + start))

    log = streamed(F.col("parts"))
    if revisions:
        head = F.get("parts", F.lit(0))
        reply = event("delta", F.lit("a reply that was thrown away"), 1, F.lit("assistant"), 1)
        edited = F.array(event("delta", F.concat(F.lit("draft <|im_end|> of "), F.reverse(F.left(head, F.lit(64)))), 0), reply, event("edit", head, 2))
        again = F.array(event("delta", F.left(head, F.lit(chars // 4)), 0), reply, event("regenerate", F.lit(""), 2))
        turn = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.col("message"), F.lit(3))
        log = F.when(turn == 1, F.concat(edited, streamed(F.slice("parts", F.lit(2), F.size("parts")), 3))).when(turn == 2, F.concat(again, streamed(F.col("parts"), 3))).otherwise(log)
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that remain.

    An event is dropped if an earlier message was edited or regenerated after it.
    """
    rows = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    rewound = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(earlier)
    rows = rows.withColumn("rewound", rewound).where("rewound IS NULL OR seq > rewound")
    whole = F.aggregate(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))),
        F.array().cast("array<string>"),
        lambda s, e: F.when(e["kind"] == "delta", F.concat(s, F.array(e["text"]))).when(e["kind"] == "regenerate", F.array().cast("array<string>")).otherwise(F.array(e["text"])),
        lambda s: F.array_join(s, ""),
    )
    return rows.groupBy("conv_id", "message").agg(F.max_by("role", F.struct("seq", "role")).alias("role"), whole.alias("text"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of (conv_id, message, role, text); loss_mask: array of (start, end)."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    rows = messages.select("conv_id", "message", "role", role.alias("head"), escaped(F.col("text")).alias("body"))
    shown = F.concat(F.lit("<|im_start|>"), "head", F.lit("\n"), "body", F.lit("<|im_end|>\n"))
    turn = F.struct("message", shown.alias("shown"), (F.length("head") + 13).alias("before"), F.length("body").alias("body"), (F.col("role") == "assistant").alias("loss"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = """aggregate(turns, named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,end:bigint>>)),
        (s, t) -> named_struct('at', s.at + length(t.shown), 'out', CASE WHEN t.loss
            THEN concat(s.out, array(named_struct('start', s.at + t.before, 'end', s.at + t.before + t.body))) ELSE s.out END),
        s -> s.out)"""
    return turns.select("conv_id", F.array_join(F.expr("transform(turns, t -> t.shown)"), "").alias("formatted"), F.expr(mask).alias("loss_mask"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises ValueError if it is none."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return out


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted text and its mask alone."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in ddl.split(", ")])

    def row(conv_id: int | None, formatted: str, mask: list[dict]) -> tuple:
        turns = parse(formatted)
        loss = "".join(_ESCAPED.sub(r"\1", formatted[m["start"] : m["end"]]) for m in mask)
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        return conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = [row(*r) for r in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rendered.select(F.col("conv_id").cast("long"), "formatted", "loss_mask").mapInArrow(run, ddl)


def formatted_conversations(conversations: DataFrame, **options) -> DataFrame:
    """Every conversation rendered from its log: (conv_id, formatted, loss_mask)."""
    return render(fold(events_of_rows(conversations, **options)))
