"""Chat formatting over typed content parts, in column expressions only.

A message holds ordered parts ``(type, text, ref, units)``. A visitor flattens them: text is
escaped; an image, audio clip or document becomes a placeholder, its reference is recorded in
order, and the tokens it expands to are ``units`` times the type's rate. The messages of a
conversation, sorted by turn, then role and content, become one string:

    <|begin|><|turn|>role\\ncontent<|end|>\\n ...

Control strings inside a text are escaped so that they cannot be taken for the template's, and
come back unchanged: a backslash becomes ``\\0``, the ``<`` of ``<|``, ``<s>`` or ``</s>`` becomes
``\\1``, the ``[`` of ``[INST]`` or ``[/INST]`` ``\\2``, and a new line in a role ``\\3``.

Defined results: a NULL or empty text, role or part list is empty, a NULL turn comes first, NULL is
a conversation id of its own. A part of an unknown type is treated as a document. Turns alike are
ordered by role, then content; repeated rows are turns of their own. Very long texts are carried
whole, so a conversation must fit a row. An empty table gives no rows. Only the named columns are
read, so further ones of any name change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOKENS = {"image": 1, "audio": 1, "document": 1}    # tokens a unit: image patch, audio frame, document token
BEGIN, TURN, END = "<|begin|>", "<|turn|>", "<|end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    text = F.regexp_replace(text, r"<(?=\||/?s>)", r"\\1")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"\\2")


def unescape(text: Column) -> Column:
    for code, char in (("\\3", "\n"), ("\\2", "["), ("\\1", "<"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """A message of one text part."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"),
                            F.lit(None).cast("bigint").alias("units")))


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind.isin("text", *TOKENS), kind).otherwise("document")


def flatten(parts: Column, tokens: dict[str, int] = TOKENS) -> tuple[Column, Column]:
    """The content string, and ``(type, ref, tokens)`` of what its placeholders stand for."""
    parts = F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,units:bigint>>"))
    content = F.array_join(F.transform(parts, lambda p: F.when(
        _kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), _kind(p), F.lit("|>")))), "")
    rate = F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv])
    files = F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p: F.struct(
        _kind(p).alias("type"), p["ref"].alias("ref"),
        (F.coalesce(p["units"], F.lit(0)) * F.element_at(rate, _kind(p))).alias("tokens")))
    return content, files


def format_conversations(messages: DataFrame, tokens: dict[str, int] = TOKENS) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans (start, length in code points), attachments,
    attachment_tokens`` for ``messages (conv_id, turn, role, parts)``."""
    content, files = flatten(F.col("parts"), tokens)
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\3"))
    turns = messages.select("conv_id", F.struct("turn", role.alias("role"), content.alias("content"), files.alias("files")).alias("t")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit("\n")))
    turns = turns.withColumn("head", head)
    whole = F.transform(F.arrays_zip("turns", "head"), lambda x: F.concat(x["head"], x["turns"]["content"], F.lit(END)))
    start = F.aggregate(
        F.arrays_zip("turns", "head"),
        F.struct(F.lit(len(BEGIN)).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["turns"]["content"]) + len(END)).cast("bigint").alias("at"),
            F.when(x["turns"]["role"] == LEARNED, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(x["head"])).cast("bigint").alias("start"),
                F.length(x["turns"]["content"]).cast("bigint").alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    attachments = F.flatten(F.transform("turns", lambda t: t["files"]))
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(whole, "")).alias("formatted"), start["spans"].alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """``(role, text)`` of each turn, from the formatted string alone; placeholders stay."""
    body = F.substring(formatted, len(BEGIN) + 1, 1 << 30)
    turns = F.filter(F.split(body, r"<\|end\|>\n", -1), lambda t: t != "")
    turns = F.transform(turns, lambda t: F.substring(t, len(TURN) + 1, 1 << 30))
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(t, "\n", 1)).alias("role"),
        unescape(t.substr(F.instr(t, "\n") + 1, F.length(t))).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask."""
    return unescape(F.array_join(F.transform(spans, lambda s: formatted.substr(
        (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))
