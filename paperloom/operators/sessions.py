"""Conversation logs: token budgets, compaction, usage, tool calls, verdicts and scores.

A conversation may hold a large share of all messages: its totals are partial aggregates, they
come back salted, and running sums go through blocks of turns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.arrays import let
from paperloom.functions.text import WS, trim_ws
from paperloom.operators.ranking import attach, running

TURN_BLOCK = 1024
PROTECT_LAST = 6
MIN_TEXT = 300
TOOL_NOTE, TEXT_NOTE = "[이전 도구 결과 생략 — 약 ", "[이전 메시지 생략 — 약 "  # fixed values


def turn_blocks(turn: str = "turn") -> dict[str, Column]:
    return {"_block": F.floor(F.col(turn) / TURN_BLOCK)}


def message_chars(text: Column, parts: Column) -> Column:
    """Characters of a message: its text, or the sum over its parts.

    A part counts its text, else its output, else its JSON. ``parts``: array of
    struct(text, output, json).
    """
    per_part = F.transform(
        parts,
        lambda p: F.coalesce(F.length(p["text"]), F.length(p["output"]), F.length(p["json"]), F.lit(0)),
    )
    return F.coalesce(F.length(text), F.aggregate(per_part, F.lit(0), lambda a, n: a + n), F.lit(0))


def message_parts(content: Column) -> Column:
    """Parts of a message from its JSON array, as ``message_chars`` takes them.

    The array is read as VARIANT values by path. A part has its text if that is a string, else its
    output: a text is itself, of a list of items their texts or JSON, of anything else the JSON; a
    part with neither has its own JSON. What is no JSON array has no parts.
    """
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    get = lambda v, path: F.try_variant_get(v, path, "string")
    is_text = lambda v, path: F.coalesce(kind(v, path) == "STRING", F.lit(False))

    def output(p: Column) -> Column:
        items = F.transform(
            F.try_variant_get(p, "$.output.value", "array<variant>"),
            lambda x: F.when(is_text(x, "$.text"), get(x, "$.text")).otherwise(F.to_json(x)),
        )
        shape = get(p, "$.output.type")
        return (
            F.when(shape.isin("text", "error-text"), get(p, "$.output.value"))
            .when(shape.isin("json", "error-json"), F.to_json(F.try_variant_get(p, "$.output.value", "variant")))
            .when(shape == "content", F.array_join(items, ""))
            .otherwise(F.to_json(F.try_variant_get(p, "$.output", "variant")))
        )

    values = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    return F.transform(
        values,
        lambda p: F.struct(
            F.when(is_text(p, "$.text"), get(p, "$.text")).alias("text"),
            F.when(~is_text(p, "$.text"), output(p)).alias("output"),
            F.to_json(p).alias("json"),
        ),
    )


def _chars(messages: DataFrame) -> Column:
    if "parts" not in messages.columns:
        return F.coalesce(F.length("text"), F.lit(0))
    return message_chars(F.col("text"), F.col("parts"))


def tokens(chars: Column) -> Column:
    return F.ceil(chars / 3).cast("bigint")


def estimate_tokens(messages: DataFrame) -> DataFrame:
    """One estimate per conversation: all characters over three, rounded up once.

    A message without text counts what its ``parts`` hold, if there is such a column.
    """
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        tokens(F.sum(_chars(messages))).alias("tokens"),
    )


def compact(messages: DataFrame, budget: int) -> DataFrame:
    """Messages of conversations over ``budget`` with their oldest ones shortened.

    System messages and the last 6 stay. Tool results always shrink to a note, user and assistant
    texts of 300 characters or more do, oldest first, until the estimate fits. ``messages``:
    conv_id, turn, role, text, one row per message (a tool message: one row per result, ``part``).
    A message may have ``parts`` instead of a text: of a tool message each output becomes a note,
    those of others stay, as a call must not lose its result.
    """
    has_parts = "parts" in messages.columns
    length = _chars(messages)
    is_tool = F.col("role") == "tool"
    plain = F.col("text").isNotNull()
    shrinkable = is_tool | (F.col("role").isin("user", "assistant") & plain & (length >= MIN_TEXT))
    note = F.concat(
        F.when(is_tool, TOOL_NOTE).otherwise(TEXT_NOTE), length.cast("string"), F.lit("자]")
    )
    already = is_tool & F.startswith(F.col("text"), F.lit("[이전 도구 결과 생략"))
    after = F.when(shrinkable & ~already, note).otherwise(F.col("text"))
    staged = messages.withColumns({"_after": after, "_len": length, "_can": shrinkable})
    left = F.length("_after")
    if has_parts:
        by_parts = is_tool & ~plain & F.col("parts").isNotNull()
        staged = staged.withColumns(
            {"_after": F.when(~by_parts, F.col("_after")), "_parts_after": F.when(by_parts, _noted_parts(F.col("parts"))).otherwise(F.col("parts"))}
        )
        left = F.when(by_parts, message_chars(F.lit(None).cast("string"), F.col("_parts_after"))).otherwise(F.length("_after"))
    saving = F.when(F.col("_can"), F.col("_len") - F.coalesce(left, F.lit(0))).otherwise(0)
    per_turn = staged.groupBy("conv_id", "turn").agg(
        F.sum(saving).alias("_saving"), F.some("_can").alias("_can")
    )
    placed = running(
        per_turn,
        ["conv_id"],
        ["turn"],
        turn_blocks(),
        sums={"_idx": F.lit(1), "_saved": F.col("_saving")},
    )
    totals = (
        messages.groupBy("conv_id")
        .agg(F.sum(length).alias("_total"), F.countDistinct("turn").alias("_n"))
        .filter(tokens(F.col("_total")) > budget)
    )
    candidates = attach(placed, totals, ["conv_id"]).filter(
        F.col("_can") & (F.col("_idx") <= F.col("_n") - PROTECT_LAST)
    )
    # The first message after which the estimate fits is the last one to shrink.
    fits = tokens(F.col("_total") - F.col("_saved")) <= budget
    stops = candidates.groupBy("conv_id").agg(F.min(F.when(fits, F.col("turn"))).alias("_stop"))
    chosen = (
        attach(candidates, stops, ["conv_id"])
        .filter(F.col("_stop").isNull() | (F.col("turn") <= F.col("_stop")))
        .select("conv_id", "turn", F.lit(True).alias("_shrink"))
    )
    shrink = F.coalesce("_shrink", F.lit(False)) & F.col("_can")
    same = [c for c in messages.columns if c not in ("text", "parts")]
    noted = [F.when(shrink, F.col("_parts_after")).otherwise(F.col("parts")).alias("parts")] if has_parts else []
    return staged.join(chosen, ["conv_id", "turn"], "left").select(
        *same,
        F.when(shrink, F.col("_after")).otherwise(F.col("text")).alias("text"),
        *noted,
        shrink.alias("compacted"),
    )


def _noted_parts(parts: Column) -> Column:
    """Outputs of tool results replaced by a note, those that are one already left."""

    def noted(p: Column) -> Column:
        note = F.concat(F.lit(TOOL_NOTE), F.length(p["output"]).cast("string"), F.lit("자]"))
        done = p["output"].isNull() | F.startswith(p["output"], F.lit(TOOL_NOTE.split(" —")[0]))
        return p.withField("output", F.when(done, p["output"]).otherwise(note))

    return F.transform(parts, noted)


def _short(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(
        n.cast("string")
    )


def usage_totals(turns: DataFrame, budget: int) -> DataFrame:
    """Cumulative tokens per session, and how full the context is after each turn.

    ``turns``: session_id, turn, input_tokens, output_tokens.
    """
    out = running(
        turns,
        ["session_id"],
        ["turn"],
        turn_blocks(),
        sums={"total_input": F.col("input_tokens"), "total_output": F.col("output_tokens")},
    )
    pct = F.floor(F.col("input_tokens") * 100.0 / budget + 0.5).cast("int")
    return out.withColumn("percent", pct).withColumns(
        {
            "band": F.when(F.col("percent") >= 90, "red").when(F.col("percent") >= 70, "yellow").otherwise("dim"),
            "shown": F.concat(
                F.lit("컨텍스트: "),
                _short(F.col("input_tokens")),
                F.lit(" / "),
                _short(F.lit(budget)),
                F.lit(" 토큰 ("),
                F.col("percent").cast("string"),
                F.lit("%)"),
            ),
        }
    )


# Tools that change documents.
EDITING_TOOLS = (
    "propose_edit",
    "propose_find_replace",
    "propose_cell_edit",
    "propose_redact_pii",
    "propose_form_fill",
    "propose_table_structure",
    "propose_form_object",
    "propose_sheet_edit",
    "write_new_document",
    "write_new_spreadsheet",
    "restore_backup",
)
THRASH_THRESHOLD = 5


def thrashing(
    calls: DataFrame, by: Sequence[str], threshold: int = THRASH_THRESHOLD, tools: Sequence[str] = EDITING_TOOLS
) -> DataFrame:
    """The editing tool a turn called most, if often enough; of equals the one seen first.

    ``calls``: the ``by`` columns, pos, tool.
    """
    counts = (
        calls.filter(F.col("tool").isin(list(tools)))
        .groupBy(*by, "tool")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    )
    worst = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), "first", "tool")).alias("w"))
    return worst.filter(-F.col("w.neg") >= threshold).select(
        *by, F.col("w.tool").alias("tool"), (-F.col("w.neg")).alias("calls")
    )


READ_OR_WRITE = ["read_document", "write_new_document", "write_new_spreadsheet"]


def open_documents(calls: DataFrame) -> DataFrame:
    """Documents a session read, compared or wrote, with the place each was first named.

    ``calls``: session_id, pos, tool, input (JSON).
    """
    field = lambda name: F.get_json_object("input", f"$.{name}")
    paths = (
        F.when(F.col("tool").isin(READ_OR_WRITE), F.array(field("path")))
        .when(F.col("tool") == "compare_documents", F.array(field("pathA"), field("pathB")))
    )
    named = calls.select("session_id", "pos", F.posexplode(paths).alias("k", "path"))
    return (
        named.filter(F.col("path").isNotNull() & (trim_ws(F.col("path")) != ""))
        .groupBy("session_id", "path")
        .agg(F.min(F.struct("pos", "k")).alias("f"))
        .select("session_id", "path", F.col("f.pos").alias("first_pos"), F.col("f.k").alias("first_arg"))
    )


def approval_stats(approvals: DataFrame) -> DataFrame:
    """Approved and rejected proposals per kind and reason. ``approvals``: kind, approved, reason."""
    return approvals.groupBy("kind", F.when(~F.col("approved"), F.col("reason")).alias("reason")).agg(
        F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("rejected")
    )


def error_class(status: Column, name: Column, message: Column) -> Column:
    """First rule that fits. Statuses, names and phrases are fixed values."""
    text = F.lower(F.coalesce(message, F.lit("")))
    says = lambda *phrases: text.rlike("|".join(phrases))
    code = F.coalesce(status, F.lit(0))
    kind = F.coalesce(name, F.lit(""))
    return (
        F.when(code.isin(401, 403) | (kind == "AuthenticationError"), "auth")
        .when((code == 429) | (kind == "RateLimitError"), "rate_limit")
        .when(
            code.between(500, 599)
            | (kind == "InternalServerError")
            | says("overloaded", "service unavailable"),
            "server",
        )
        .when(
            says(
                "context_length", "too many tokens", "maximum context", "context window", "prompt is too long"
            )
            | (kind == "ContextLengthExceededError"),
            "context_length",
        )
        .when(
            says("enotfound", "econnrefused", "fetch failed", "network") | (kind == "NetworkError"), "network"
        )
        .otherwise("other")
    )


def classify_errors(errors: DataFrame) -> DataFrame:
    return errors.withColumn("class", error_class(F.col("status"), F.col("name"), F.col("message")))


def _verdict(json: Column) -> Column:
    """Struct(pass, reason) of a JSON object with a boolean and a string; null otherwise."""

    def typed(v: Column) -> Column:
        ok, why = F.try_variant_get(v, "$.pass", "variant"), F.try_variant_get(v, "$.reason", "variant")
        right = (F.schema_of_variant(ok) == "BOOLEAN") & (F.schema_of_variant(why) == "STRING")
        return F.when(
            right,
            F.struct(
                F.try_variant_get(v, "$.pass", "boolean").alias("pass"),
                F.try_variant_get(v, "$.reason", "string").alias("reason"),
            ),
        )

    # Only an object can hold both fields.
    return F.when(F.startswith(json, F.lit("{")), let(F.try_parse_json(json), typed))


# Where a verdict may stand in an answer.
FENCED = rf"(?s)```(?:json)?{WS}*(.+?)```"
FIRST_OBJECT = r"(?s)\{.*?\"pass\"\s*:\s*(?:true|false).*?\}"


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """Verdicts out of free text: all of it, a fenced block, the first object with ``pass``, else fail."""
    text = trim_ws(F.col("text"))
    failed = F.struct(
        F.lit(False).alias("pass"),
        F.concat(F.lit("judge 응답 파싱 실패 — raw: "), F.substring(text, 1, 200)).alias("reason"),
    )
    found = F.coalesce(
        _verdict(text),
        _verdict(trim_ws(F.regexp_extract(text, FENCED, 1))),
        _verdict(F.regexp_extract(text, FIRST_OBJECT, 0)),
        failed,
    )
    return answers.select(
        *[c for c in answers.columns if c != "text"], found.alias("v")
    ).select(*[c for c in answers.columns if c != "text"], "v.pass", "v.reason")


def score_runs(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """Pass rate per model and tier with subtotals; a run with an error is a fail.

    ``runs``: model, spec_id, pass, error; ``specs``: spec_id, tier, auto_verifiable. The spec list is
    a small fixed table next to the runs; Spark broadcasts it by its size.
    """
    checked = specs.filter(F.coalesce("auto_verifiable", F.lit(True))).select(
        "spec_id", F.coalesce("tier", F.lit("feasible")).alias("tier")
    )
    ok = F.coalesce("pass", F.lit(False)) & F.col("error").isNull()
    return (
        runs.join(checked, "spec_id")
        .rollup("model", "tier")
        .agg(F.count("*").alias("runs"), F.count_if(ok).alias("passed"))
        .withColumn("rate", F.round(F.col("passed") / F.col("runs"), 4))
    )


# Phrases that admit a limit, and phrases that claim completion.
LIMITATION = (
    rf"(지원(하지|되지)?{WS}*(않|안)|지원하지{WS}*않|불가|할{WS}*수{WS}*없|현재(는)?{WS}*(도구|지원)|직접{WS}*편집할{WS}*수{WS}*없"
    rf"|한계|제공하지{WS}*않|어렵습니다)"
)
COMPLETION = (
    r"(완료(했습니다|되었습니다|하였습니다)|수정(했습니다|되었습니다|하였습니다)|정비(했습니다|되었습니다)"
    r"|통일(했습니다|되었습니다)|적용(했습니다|되었습니다|하였습니다))"
)


def answer_flags(answers: DataFrame, features: Sequence[str]) -> DataFrame:
    """Does an answer admit a limit and name the feature, or claim completion instead?"""
    text = F.col("text")
    names = F.lit(False)
    for word in features:
        names = names | F.contains(text, F.lit(word))
    return answers.select(
        *[c for c in answers.columns if c != "text"],
        (text.rlike(LIMITATION) & names).alias("flagged_limitation"),
        text.rlike(COMPLETION).alias("claims_completion"),
    )
