from pyspark.sql import functions as F

from paperloom.llm import chat


def read(spark, rows):
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, formatted string"))
    return {r.conv_id: r for r in made.select("conv_id", "formatted", "segments", "first_bad_turn", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained")).collect()}


def test_marks_inside_texts_and_roles_come_back(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x <|<|", "a\nb", "\\n", "", "<", "|>"]
    roles = ["user", "assistant", "a\nb", "\\n", "\\", "<|im_start|>", "\\\n\\\\n", ""]
    rows = [(1, i, r, t, "", "") for i, (r, t) in enumerate(zip(roles, nasty))]
    got = read(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == list(zip(roles, nasty))
    assert got.trained == nasty[1]
    assert got.formatted.count("<|im_start|>") == len(rows)
    assert "".join(s.text for s in got.segments) == got.formatted


def test_machine_finds_the_first_wrong_turn(spark):
    orders = {1: "su a", 2: "ua", 3: "au", 4: "uau", 5: "uua", 6: "s", 7: "ux"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "stranger"}
    rows = [(k, i, names[c], "t", "", "") for k, order in orders.items() for i, c in enumerate(order.replace(" ", ""))]
    got = {k: r.first_bad_turn for k, r in read(spark, rows).items()}
    assert got == {1: None, 2: None, 3: 1, 4: None, 5: 2, 6: None, 7: 2}


def test_edge_rows(spark):
    long = "x<|" * 50_000
    rows = [(1, None, "user", None, "s", "f"), (1, 0, None, "b", "s", "f"), (None, 0, "assistant", "n", "s", "f"), (2, 1, "assistant", long, "s", "f"), (2, 1, "assistant", long, "s", "f"), (2, 1, "assistant", "a", "s", "f")]
    got = read(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("", "b")]
    assert got[None].trained == "n"
    assert got[2].trained == "a" + long + long
    assert read(spark, rows[:0]) == {}


def test_other_template(spark):
    template = chat.Template(begin="<|turn|>", end="<|done|>", after_turn="", trained=("bot",), first=("bot",), follows=(("bot", ()),))
    rows = spark.createDataFrame([(1, 0, "bot", "hi <|done|>")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(rows, template).select("formatted", chat.read_turns(F.col("formatted"), template).alias("t")).first()
    assert row.formatted == "<|turn|>bot\nhi <\\|done|><|done|>"
    assert [tuple(t) for t in row.t] == [("bot", "hi <|done|>")]


def test_long_conversations_are_folded_in_parts(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}", "", "") for i in range(3 * chat.PART + 1)]
    rows += [(2, i, "user" if i % 2 == 0 or i == 130 else "assistant", f"t{i}", "", "") for i in range(200) if i != 131]
    rows += [(3, i, "" if i == chat.PART else ("user", "assistant")[i % 2], "x", "", "") for i in range(chat.PART + 2)]
    got = read(spark, rows)
    assert got[1].first_bad_turn is None and got[1].trained == "".join(r[3] for r in rows[: 3 * chat.PART + 1] if r[2] == "assistant")
    assert got[2].first_bad_turn == 132 and got[3].first_bad_turn == chat.PART + 1
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got.values())


def test_the_query_runs_the_machine(spark):
    made = chat.op5_chat_format(spark, "/root/testdata/sf0.001")
    plan = made.select("loss_sha256", "first_bad_turn")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(slice(_turns" in plan
    # Flags and texts come out of the same fold, whichever column is read.
    assert "aggregate(slice(_turns" in made.select("loss_chars")._jdf.queryExecution().optimizedPlan().toString()
