"""Conversations, tool calls, verdicts and scores over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import sessions as op
from paperloom.plans.registry import query
from paperloom.sources.tables import load, load_wide


@query(
    "estimate_tokens",
    """SELECT conv_id, count(*) AS messages, ceil(sum(length(text)) / 3)::bigint AS tokens
    FROM conversations GROUP BY conv_id""",
)
def estimate_tokens(spark, sf_dir):
    return op.estimate_tokens(load(spark, sf_dir, "conversations"))


_BUDGET = 2500
# Five conversations joined to one, so that many messages lie before the last six; some
# answers count as tool results.
_LONG_SQL = """
m AS (SELECT conv_id // 5 AS conv_id, conv_id % 5 * 10 + turn AS turn,
    CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'tool' ELSE role END AS role,
    CASE WHEN conv_id % 6 = 0 AND turn = 1 THEN '[이전 도구 결과 생략 — 약 9자]' ELSE text END AS text
  FROM conversations)
"""


def long_conversations(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 5").alias("conv_id"),
        F.expr("conv_id % 5 * 10 + turn").alias("turn"),
        F.expr("if(role = 'assistant' and conv_id % 3 = 0, 'tool', role)").alias("role"),
        F.expr("if(conv_id % 6 = 0 and turn = 1, '[이전 도구 결과 생략 — 약 9자]', text)").alias("text"),
    )


@query(
    "compact",
    f"""WITH {_LONG_SQL},
    p AS (SELECT *, role = 'tool' OR (role IN ('user', 'assistant') AND length(text) >= 300) AS can,
        CASE WHEN role = 'tool' AND NOT starts_with(text, '[이전 도구 결과 생략') THEN '[이전 도구 결과 생략 — 약 ' || length(text) || '자]'
          WHEN role IN ('user', 'assistant') AND length(text) >= 300 THEN '[이전 메시지 생략 — 약 ' || length(text) || '자]'
          ELSE text END AS short FROM m),
    q AS (SELECT *, row_number() OVER w AS idx, count(*) OVER (PARTITION BY conv_id) AS n,
        sum(length(text)) OVER (PARTITION BY conv_id) AS total,
        sum(CASE WHEN can THEN length(text) - length(short) ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS saved
      FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT conv_id, min(turn) AS stop FROM q
      WHERE can AND idx <= n - 6 AND ceil(total / 3) > {_BUDGET} AND ceil((total - saved) / 3) <= {_BUDGET} GROUP BY conv_id)
    SELECT conv_id, turn, role, CASE WHEN c THEN short ELSE text END AS text, c AS compacted FROM (
      SELECT q.*, can AND idx <= n - 6 AND ceil(total / 3) > {_BUDGET} AND turn <= coalesce(stop, 1000000) AS c
      FROM q LEFT JOIN s USING (conv_id))""",
)
def compact(spark, sf_dir):
    return op.compact(long_conversations(spark, sf_dir), _BUDGET)


@query(
    "usage_totals",
    """WITH t AS (SELECT conv_id AS session_id, turn, length(text) * 40 AS input_tokens,
        ceil(length(text) / 3)::bigint AS output_tokens FROM conversations),
    r AS (SELECT *, (sum(input_tokens) OVER w)::bigint AS total_input, (sum(output_tokens) OVER w)::bigint AS total_output,
        floor(input_tokens * 100.0 / 120000 + 0.5)::int AS percent FROM t
      WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT *, CASE WHEN percent >= 90 THEN 'red' WHEN percent >= 70 THEN 'yellow' ELSE 'dim' END AS band FROM r""",
)
def usage_totals(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        "turn",
        (F.length("text") * 40).cast("bigint").alias("input_tokens"),
        op.tokens(F.length("text")).alias("output_tokens"),
    )
    return op.usage_totals(turns, 120_000).drop("shown")


@query(
    "thrashing",
    """WITH c AS (SELECT user_id, ts::date AS day, event_type AS tool, count(*) AS n, min(event_id) AS f
      FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, f) AS k FROM c)
    SELECT user_id, day, tool, n AS calls FROM r WHERE k = 1 AND n >= 3""",
)
def thrashing(spark, sf_dir):
    calls = load(spark, sf_dir, "events").select(
        "user_id",
        F.to_date("ts").alias("day"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("tool"),
    )
    return op.thrashing(calls, ["user_id", "day"], 3, ["click", "purchase", "signup"])


@query(
    "open_documents",
    """WITH c AS (SELECT user_id AS session_id, event_id AS pos, event_type AS t, 'f' || (event_id % 40) AS a,
        CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'g' || (event_id % 30) END AS b FROM events),
    p AS (SELECT session_id, pos, 0 AS k, a AS path FROM c WHERE t IN ('view', 'signup', 'click')
      UNION ALL SELECT session_id, pos, 1, b FROM c WHERE t = 'click'),
    f AS (SELECT session_id, path, min(pos * 2 + k) AS o FROM p WHERE trim(path) <> '' GROUP BY ALL)
    SELECT session_id, path, o // 2 AS first_pos, (o % 2)::int AS first_arg FROM f""",
)
def open_documents(spark, sf_dir):
    calls = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("pos"),
        F.expr(
            """case event_type when 'view' then 'read_document' when 'signup' then 'write_new_document'
            when 'click' then 'compare_documents' else 'scan_pii' end"""
        ).alias("tool"),
        F.expr(
            """to_json(if(event_type = 'click',
              named_struct('path', cast(null as string), 'pathA', 'f' || event_id % 40,
                'pathB', if(event_id % 3 = 0, ' ', 'g' || event_id % 30)),
              named_struct('path', 'f' || event_id % 40, 'pathA', cast(null as string), 'pathB', cast(null as string))))"""
        ).alias("input"),
    )
    return op.open_documents(calls)


@query(
    "approval_stats",
    """WITH a AS (SELECT o_orderpriority AS kind, o_orderstatus <> 'F' AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 'typo'
        WHEN o_orderkey % 3 = 1 THEN 'scope' END AS reason FROM orders)
    SELECT kind, CASE WHEN NOT ok THEN reason END AS reason, count(*) FILTER (ok) AS approved,
      count(*) FILTER (NOT ok) AS rejected FROM a GROUP BY ALL""",
)
def approval_stats(spark, sf_dir):
    return op.approval_stats(
        load(spark, sf_dir, "orders").select(
            F.col("o_orderpriority").alias("kind"),
            (F.col("o_orderstatus") != "F").alias("approved"),
            F.expr("case o_orderkey % 3 when 0 then 'typo' when 1 then 'scope' end").alias("reason"),
        )
    )


_ERR = """CASE WHEN o_orderkey % 9 = 0 THEN 401 WHEN o_orderkey % 9 = 1 THEN 429 WHEN o_orderkey % 9 = 2 THEN 503 END"""
_NAME = "CASE WHEN o_orderkey % 9 = 3 THEN 'RateLimitError' WHEN o_orderkey % 18 = 4 THEN 'NetworkError' END"
_MSG = """CASE o_orderkey % 7 WHEN 0 THEN 'Overloaded: try later' WHEN 1 THEN 'prompt is too long' WHEN 2 THEN
  'getaddrinfo ENOTFOUND host' WHEN 3 THEN 'fetch failed (network)' ELSE 'boom ' || o_orderpriority END"""


@query(
    "classify_errors",
    f"""WITH e AS (SELECT {_ERR} AS status, {_NAME} AS name, lower({_MSG}) AS t FROM orders)
    SELECT CASE WHEN status = 401 THEN 'auth' WHEN status = 429 OR name = 'RateLimitError' THEN 'rate_limit'
      WHEN status = 503 OR contains(t, 'overloaded') THEN 'server' WHEN contains(t, 'too long') THEN 'context_length'
      WHEN contains(t, 'enotfound') OR contains(t, 'network') OR name = 'NetworkError' THEN 'network' ELSE 'other' END AS class,
      count(*) AS n FROM e GROUP BY 1""",
)
def classify_errors(spark, sf_dir):
    errors = load(spark, sf_dir, "orders").select(
        F.expr(_ERR).alias("status"), F.expr(_NAME).alias("name"), F.expr(_MSG).alias("message")
    )
    return op.classify_errors(errors).groupBy("class").agg(F.count("*").alias("n"))


@query(
    "parse_verdicts",
    """WITH c AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_orderpriority AS r, o_orderkey % 2 = 0 AS p FROM orders)
    SELECT id, CASE WHEN k IN (0, 1, 2) THEN p ELSE false END AS pass,
      CASE WHEN k IN (0, 1, 2) THEN r ELSE 'judge 응답 파싱 실패 — raw: ' || CASE k
        WHEN 3 THEN '{"pass": "true", "reason": "' || r || '"}' WHEN 4 THEN '{"pass": true, "reason": 5}'
        WHEN 5 THEN 'no verdict ' || r ELSE substr('{"pass": true, "reason": "' || repeat(r, 40), 1, 200) END END AS reason
    FROM c""",
)
def parse_verdicts(spark, sf_dir):
    json = """'{"pass": ' || (o_orderkey % 2 = 0) || ', "reason": "' || o_orderpriority || '"}'"""
    answers = load_wide(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select(
        F.col("o_orderkey").alias("id"),
        F.expr(
            f"""case o_orderkey % 7 when 0 then '  ' || {json} || '\n'
            when 1 then 'My verdict:\n```json\n' || {json} || '\n```\nbye'
            when 2 then 'I think ' || {json} || ' is right {{x}}'
            when 3 then '{{"pass": "true", "reason": "' || o_orderpriority || '"}}'
            when 4 then '{{"pass": true, "reason": 5}}' when 5 then 'no verdict ' || o_orderpriority
            else '{{"pass": true, "reason": "' || repeat(o_orderpriority, 40) end"""
        ).alias("text"),
    )
    return op.parse_verdicts(answers)


@query(
    "score_runs",
    """WITH s AS (SELECT '#' || n_nationkey AS spec_id, CASE WHEN n_regionkey % 2 = 0 THEN 'structural' ELSE 'feasible' END AS tier
      FROM nation WHERE n_nationkey % 6 <> 0),
    r AS (SELECT o_orderpriority AS model, '#' || (o_orderkey % 25) AS spec_id,
        o_orderstatus = 'O' AND o_orderkey % 17 <> 0 AS ok FROM orders)
    SELECT model, tier, count(*) AS runs, count(*) FILTER (ok) AS passed FROM r JOIN s USING (spec_id)
    GROUP BY ROLLUP (model, tier)""",
)
def score_runs(spark, sf_dir):
    specs = load(spark, sf_dir, "nation").select(
        F.expr("'#' || n_nationkey").alias("spec_id"),
        F.expr("if(n_regionkey % 2 = 0, 'structural', null)").alias("tier"),
        F.expr("n_nationkey % 6 <> 0").alias("auto_verifiable"),
    )
    runs = load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"),
        F.expr("'#' || o_orderkey % 25").alias("spec_id"),
        (F.col("o_orderstatus") == "O").alias("pass"),
        F.expr("if(o_orderkey % 17 = 0, 'timeout', null)").alias("error"),
    )
    return op.score_runs(runs, specs).drop("rate")


_ANSWER = """CASE o_orderkey % 5 WHEN 0 THEN '머리말 편집은 현재 도구로 지원되지 않습니다.' WHEN 1 THEN '수정했습니다. ' || o_orderpriority
  WHEN 2 THEN '머리말을 적용하였습니다' WHEN 3 THEN '이 작업은 할 수 없습니다' ELSE '쪽번호는 한계가 있어 어렵습니다' END"""


@query(
    "answer_flags",
    f"""SELECT o_orderkey AS id, o_orderkey % 5 IN (0, 4) AS flagged_limitation,
      o_orderkey % 5 IN (1, 2) AS claims_completion FROM orders""",
)
def answer_flags(spark, sf_dir):
    answers = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr(_ANSWER).alias("text")
    )
    return op.answer_flags(answers, ["머리말", "쪽번호"])
