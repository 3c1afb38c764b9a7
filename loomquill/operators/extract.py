"""Entries to content parts: which blocks are kept, and how long ones are cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions.columns import head, json_text, tail

BLOCK = "array<struct<type:string,text:string,thinking:string,name:string,input:string,content:string,is_error:boolean>>"


def keep_conversation(entries: DataFrame) -> DataFrame:
    """User and assistant entries only."""
    return entries.filter(F.col("type").isin(*C.KEPT_TYPES))


def cut_thinking(text: Column) -> Column:
    return F.when(F.length(text) > C.THINKING_CAP, F.concat(head(text, C.THINKING_HEAD), F.lit(C.OMITTED), tail(text, C.THINKING_TAIL))).otherwise(text)


def cut_result(text: Column, is_error: Column) -> Column:
    rest = F.when(is_error, F.concat(F.lit(C.ERROR_INFO), tail(text, C.RESULT_TAIL))).otherwise(F.lit(C.OMITTED_END))
    return F.when(F.length(text) > C.RESULT_CAP, F.concat(head(text, C.RESULT_HEAD), rest)).otherwise(text)


def summarize_input(name: Column, tool_input: Column) -> Column:
    """A tool call's input in short: the telling fields of known tools, else the compact JSON's beginning, keys in their order."""
    get = lambda key: json_text(tool_input, f"$.{key}")
    command = get("command")
    return (
        F.when(name == "Bash", F.concat(F.lit("Command: "), head(command, C.COMMAND_CAP), F.when(F.length(command) > C.COMMAND_CAP, F.lit("...")).otherwise("")))
        .when(name == "Edit", F.concat(F.lit("File: "), get("file_path"), F.lit("\nOld: "), head(get("old_string"), C.EDIT_CAP), F.lit("...\nNew: "), head(get("new_string"), C.EDIT_CAP), F.lit("...")))
        .when(name == "Write", F.concat(F.lit("File: "), get("file_path"), F.lit("\nContent: "), head(get("content"), C.WRITE_CAP), F.lit("...")))
        .when(name == "Read", F.concat(F.lit("File: "), get("file_path")))
        .when(name == "Agent", F.concat(F.lit("Prompt: "), head(get("prompt"), C.PROMPT_CAP)))
        .otherwise(F.concat(F.lit("Input: "), head(F.coalesce(tool_input, F.lit("{}")), C.INPUT_CAP)))
    )


def _result_text(content: Column) -> Column:
    """A tool result's text: itself, or its text blocks joined by line feeds."""
    shape = F.schema_of_variant(F.try_parse_json(content))
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(F.coalesce(shape.startswith("ARRAY<OBJECT") | (content == "[]"), F.lit(False)), F.array_join(texts, "\n")).otherwise(F.coalesce(content, F.lit("")))


def content_parts(entries: DataFrame) -> DataFrame:
    """Adds ``parts``: array of (type, text, truncated, is_error), in order.  Blocks of other types leave no part."""

    def part(kind: str, text: Column, truncated: Column, is_error: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), truncated.alias("truncated"), is_error.alias("is_error"))

    never, none = F.lit(False), F.lit(None).cast("boolean")

    def convert(b: Column) -> Column:
        thinking, result = F.coalesce(b["thinking"], F.lit("")), _result_text(b["content"])
        name, failed = F.coalesce(b["name"], F.lit("unknown")), F.coalesce(b["is_error"], F.lit(False))
        return (
            F.when(b["type"] == "text", part("text", F.coalesce(b["text"], F.lit("")), never, none))
            .when(b["type"] == "thinking", part("thinking", cut_thinking(thinking), F.length(thinking) > C.THINKING_CAP, none))
            .when(b["type"] == "tool_use", part("tool_use", F.concat(F.lit("[Tool: "), name, F.lit("]\n"), summarize_input(name, b["input"])), F.lit(True), none))
            .when(b["type"] == "tool_result", part("tool_result", cut_result(result, failed), F.length(result) > C.RESULT_CAP, failed))
        )

    plain = F.array(part("text", F.col("content"), never, none))
    listed = F.filter(F.transform(F.from_json("content", BLOCK), convert), lambda p: p.isNotNull())
    return entries.withColumn("parts", F.when(F.col("is_array"), F.coalesce(listed, F.filter(plain, lambda p: F.lit(False)))).otherwise(plain))


def drop_parts(with_parts: DataFrame, level: int) -> DataFrame:
    """Parts left at a fallback level: 0 all, 1 without thinking and tool results, 2 and more text only."""
    gone = [(), ("thinking", "tool_result"), ("thinking", "tool_result", "tool_use")][min(level, 2)]
    return with_parts if not gone else with_parts.withColumn("parts", F.filter("parts", lambda p: ~p["type"].isin(*gone)))
