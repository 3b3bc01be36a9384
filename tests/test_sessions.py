import math
import random

from conftest import rows

from pyspark.sql import functions as F

from paperloom.operators import sessions as ss

MESSAGES = "conv_id long, turn int, role string, text string"


def sequential_compact(messages, budget):
    """The rule, one message at a time."""
    texts = [m[3] for m in messages]
    total = lambda: math.ceil(sum(map(len, texts)) / 3)
    if total() <= budget:
        return texts
    for i, (_, _, role, text) in enumerate(messages[: max(0, len(messages) - 6)]):
        if role == "tool":
            if not text.startswith("[이전 도구 결과 생략"):
                texts[i] = f"[이전 도구 결과 생략 — 약 {len(text)}자]"
        elif role in ("user", "assistant") and len(text) >= 300:
            texts[i] = f"[이전 메시지 생략 — 약 {len(text)}자]"
        else:
            continue
        if total() <= budget:
            break
    return texts


def test_compaction_equals_the_rule(spark):
    rng = random.Random(11)
    convs = []
    for c in range(120):
        n = rng.randrange(1, 16)
        convs.append([
            (c, t, rng.choice(["user", "assistant", "tool", "system"]), "x" * rng.choice([1, 20, 299, 300, 1000, 3000]))
            for t in range(n)
        ])
    convs[0] = [(0, t, "tool", "[이전 도구 결과 생략 — 약 5자]") for t in range(10)]
    df = spark.createDataFrame([m for c in convs for m in c], MESSAGES)
    for budget in (100, 900, 2500):
        got = {(r.conv_id, r.turn): r.text for r in ss.compact(df, budget).collect()}
        want = {(m[0], m[1]): t for c in convs for m, t in zip(c, sequential_compact(c, budget))}
        assert got == want


def test_one_conversation_with_most_messages(spark):
    df = spark.range(6000).selectExpr(
        "if(id < 5000, 0, id) AS conv_id", "cast(if(id < 5000, id, 0) as int) AS turn", "'user' AS role", "repeat('x', 300) AS text"
    )
    out = ss.compact(df, 400_000)
    assert out.count() == 6000
    saved = 300 - len("[이전 메시지 생략 — 약 300자]")
    assert out.filter("compacted").count() == math.ceil((5000 * 300 - 3 * 400_000) / saved)


def test_tokens_and_usage(spark):
    df = spark.createDataFrame([(1, 0, "user", "abcd"), (1, 1, "user", "ab"), (2, 0, "user", "a😀")], MESSAGES)
    assert rows(ss.estimate_tokens(df), "conv_id", "tokens") == [(1, 2), (2, 1)]
    turns = spark.createDataFrame(
        [("s", 1, 700, 5), ("s", 2, 895, 5), ("s", 3, 995, 1)], "session_id string, turn int, input_tokens long, output_tokens long"
    )
    assert rows(ss.usage_totals(turns, 1000), "turn", "total_input", "total_output", "percent", "band") == [
        (1, 700, 5, 70, "yellow"), (2, 1595, 10, 90, "red"), (3, 2590, 11, 100, "red")
    ]
    shown = ss.usage_totals(turns.selectExpr("session_id", "turn", "input_tokens + 44500 AS input_tokens", "output_tokens"), 120_000)
    assert rows(shown, "shown")[0] == ("컨텍스트: 45.2k / 120.0k 토큰 (38%)",)


def test_thrashing(spark):
    calls = [("t1", i, "propose_edit") for i in range(5)] + [("t1", 9, "read_document")] * 9
    calls += [("t2", i, t) for i, t in enumerate(["propose_cell_edit", "propose_edit"] * 5)] + [("t3", 0, "propose_edit")] * 4
    df = spark.createDataFrame(calls, "turn string, pos int, tool string")
    assert rows(ss.thrashing(df, ["turn"]), "turn", "tool", "calls") == [
        ("t1", "propose_edit", 5), ("t2", "propose_cell_edit", 5)
    ]


def test_open_documents(spark):
    df = spark.createDataFrame(
        [("s", 1, "read_document", '{"path":"a"}'), ("s", 2, "compare_documents", '{"pathA":"b","pathB":"a"}'),
         ("s", 3, "read_document", '{"path":" "}'), ("s", 4, "scan_pii", '{"path":"z"}'), ("s", 5, "write_new_document", '{"path":"c"}')],
        "session_id string, pos int, tool string, input string",
    )
    assert rows(ss.open_documents(df), "first_pos", "path") == [(1, "a"), (2, "b"), (5, "c")]


def test_verdicts(spark):
    texts = [
        ' {"pass": true, "reason": "ok"} ', 'x\n```json\n{"pass": false, "reason": "no"}\n```', '```\n{"pass": true, "reason": "r"}```',
        'so {"pass": true, "reason": "in prose"} end', '{"pass": "true", "reason": "s"}', '{"pass": true}', "plain " + "y" * 300,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r["pass"], r.reason) for r in ss.parse_verdicts(df).orderBy("id").collect()]
    assert got[:4] == [(True, "ok"), (False, "no"), (True, "r"), (True, "in prose")]
    assert all(not p and r.startswith("judge 응답 파싱 실패 — raw: ") for p, r in got[4:])
    assert got[6][1].endswith(("plain " + "y" * 300)[:200])


def test_errors_scores_and_flags(spark):
    df = spark.createDataFrame(
        [(401, None, None), (None, "RateLimitError", "overloaded"), (529, None, ""), (None, None, "Prompt is TOO long"),
         (None, None, "fetch failed"), (404, "X", "boom")],
        "status int, name string, message string",
    )
    assert [r["class"] for r in ss.classify_errors(df).collect()] == [
        "auth", "rate_limit", "server", "context_length", "network", "other"
    ]
    runs = spark.createDataFrame(
        [("m", "#1", True, None), ("m", "#2", True, "timeout"), ("m", "#3", True, None), ("n", "#1", False, None)],
        "model string, spec_id string, pass boolean, error string",
    )
    specs = spark.createDataFrame([("#1", None, None), ("#2", "structural", True), ("#3", "hard", False)], "spec_id string, tier string, auto_verifiable boolean")
    got = {(r.model, r.tier): (r.runs, r.passed) for r in ss.score_runs(runs, specs).collect()}
    assert got == {
        (None, None): (3, 1), ("m", None): (2, 1), ("n", None): (1, 0),
        ("m", "feasible"): (1, 1), ("m", "structural"): (1, 0), ("n", "feasible"): (1, 0),
    }
    texts = ["머리말은 지원하지 않습니다", "지원하지 않습니다", "머리말을 수정했습니다."]
    answers = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert rows(ss.answer_flags(answers, ["머리말"]), "id", "flagged_limitation", "claims_completion") == [
        (0, True, False), (1, False, False), (2, False, True)
    ]
    approvals = spark.createDataFrame([("edit", True, None), ("edit", False, "typo")], "kind string, approved boolean, reason string")
    assert rows(ss.approval_stats(approvals), "reason", "approved", "rejected") == [("typo", 0, 1), (None, 1, 0)]


def test_message_chars(spark):
    df = spark.createDataFrame(
        [(None, [("ab", None, None), (None, "out", None), (None, None, '{"a":1}')]), ("abc", None)],
        "text string, parts array<struct<text:string,output:string,json:string>>",
    )
    assert [r[0] for r in df.select(ss.message_chars(df.text, df.parts)).collect()] == [12, 3]


PARTS = "conv_id long, turn long, role string, text string, parts array<struct<text:string,output:string,json:string>>"


def test_parts_count_like_texts(spark):
    tool = lambda n: [(None, "r" * n, "{}")]
    df = spark.createDataFrame(
        [(1, 0, "tool", None, tool(300)), (2, 0, "assistant", None, [("안녕하세요", None, "{}")]), (3, 0, "user", "abc", None), (4, 0, "user", None, None), (5, 0, "tool", None, tool(900))],
        PARTS,
    )
    assert rows(ss.estimate_tokens(df), "conv_id", "tokens") == [(1, 100), (2, 2), (3, 1), (4, 0), (5, 300)]


def test_parts_are_compacted_part_by_part(spark):
    tool = [(None, "r" * 900, "{}"), (None, ss.TOOL_NOTE + "7자]", "{}"), ("text part", None, "{}")]
    call = [("t" * 900, None, "{}")]
    data = [(1, 0, "system", "s" * 900, None), (1, 1, "assistant", None, call), (1, 2, "tool", None, tool), (1, 3, "user", "u" * 900, None)]
    data += [(1, k, "user", "short", None) for k in range(4, 10)]
    got = {r.turn: r for r in ss.compact(spark.createDataFrame(data, PARTS), 950).collect()}
    assert [k for k in got if got[k].compacted] == [2]
    assert [p.output for p in got[2].parts] == [ss.TOOL_NOTE + "900자]", ss.TOOL_NOTE + "7자]", None]
    assert got[1].parts[0].text == "t" * 900 and got[3].text == "u" * 900
    got = {r.turn: r for r in ss.compact(spark.createDataFrame(data, PARTS), 100).collect()}
    assert [k for k in sorted(got) if got[k].compacted] == [2, 3] and got[1].parts[0].text == "t" * 900


def test_parts_of_json(spark):
    import json

    content = [
        {"type": "text", "text": "ab"},
        {"type": "tool-result", "output": {"type": "text", "value": "a" * 300}},
        {"type": "tool-result", "output": {"type": "json", "value": {"k": [1, 2]}}},
        {"type": "tool-result", "output": {"type": "content", "value": [{"type": "text", "text": "xyz"}, {"n": 1}]}},
        {"type": "tool-call", "input": {"q": 1}},
        {"text": 5},
        {"type": "tool-result", "output": {"type": "execution-denied"}},
    ]
    compact = lambda x: len(json.dumps(x, separators=(",", ":")))
    want = 2 + 300 + compact({"k": [1, 2]}) + 3 + compact({"n": 1}) + compact(content[4]) + compact(content[5]) + compact({"type": "execution-denied"})
    df = spark.createDataFrame([(json.dumps(content),), ("no json",), ('{"a": 1}',), (None,), ("[]",)], "content string")
    got = [r[0] for r in df.select(ss.message_chars(F.lit(None).cast("string"), ss.message_parts(F.col("content")))).collect()]
    assert got == [want, 0, 0, 0, 0]
