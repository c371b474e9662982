"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected, sorted by turn (ties by role, then text), and adjacent
turns of one role are merged by an array aggregation into one marked turn, whose texts stay apart::

    <|turn:user
    first text<|more|>second text<|end|>
    <|turn:assistant
    answer<|end|>

Inside texts and roles a backslash becomes ``\\b`` and the control opener ``<|`` becomes ``<\\p`` (in
roles a line feed also becomes ``\\n``), so no text can hold a control string; ``parse`` undoes this.

The loss mask is an array of (start, length) in characters of the formatted text: one span for each
text of the trained role.

Defined cases: a null text is empty, a null role is the empty role and never trained on, null turns
come first, a null conv_id is a conversation of its own, repeated rows are kept as turns, an empty table
gives no rows; columns other than the four that are read are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, MORE, END = "<|turn:", "<|more|>", "<|end|>\n"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def _unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return _unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array of start and length) for each conversation of (conv_id, turn, role, text)."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def merge(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        same = (F.size(done) > 0) & (last["role"] == t["role"])
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(one)))

    collected = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    merged = collected.select("conv_id", F.aggregate("turns", F.array().cast(kind), merge).alias("merged"))
    # Pieces of the output in order; those of a trained text are marked.
    pieces = F.flatten(F.transform("merged", lambda m: F.concat(
        F.array(_piece(F.concat(F.lit(TURN), _escape_role(m["role"]), F.lit("\n")), F.lit(False))),
        F.flatten(F.transform(m["texts"], lambda x, i: F.array(
            _piece(F.when(i > 0, F.lit(MORE)).otherwise(F.lit("")), F.lit(False)),
            _piece(_escape(x), m["role"] == trained),
        ))),
        F.array(_piece(F.lit(END), F.lit(False))),
    )))
    laid = merged.select("conv_id", pieces.alias("pieces"))

    def place(done: Column, p: Column) -> Column:
        at, spans, n = done["at"], done["spans"], F.length(p["text"])
        one = F.array(F.struct(at.alias("start"), n.alias("length")))
        return F.struct((at + n).alias("at"), F.when(p["loss"], F.concat(spans, one)).otherwise(spans).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return laid.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.aggregate("pieces", start, place, lambda d: d["spans"]).alias("loss"),
    )


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def parse(formatted: str | Column) -> Column:
    """The (role, text) structs of a formatted conversation, a struct for each turn."""
    whole = F.col(formatted) if isinstance(formatted, str) else formatted
    blocks = F.filter(F.split(whole, "<\\|turn:"), lambda x, i: i > 0)

    def turns(block: Column) -> Column:
        role = _unescape_role(F.substring_index(block, "\n", 1))
        body = F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)
        inner = F.substr(body, F.lit(1), F.length(body) - len(END))
        return F.transform(F.split(inner, "<\\|more\\|>"), lambda x: F.struct(role.alias("role"), _unescape(x).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: str, loss: str) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.col(loss), lambda s: _unescape(F.substr(F.col(formatted), s["start"] + 1, s["length"]))), "")


def digest(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations."""
    done = format_chats(turns)
    back = done.select("conv_id", "formatted", parse("formatted").alias("turns"), loss_text("formatted", "loss").alias("masked"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
