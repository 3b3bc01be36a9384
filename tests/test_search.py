import random

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import ranking, search


def brute_excerpts(text, query, context=2):
    lines = text.split("\n")
    blocks = []
    for i in (i for i, x in enumerate(lines) if query.lower() in x.lower()):
        s, e = max(0, i - context), min(len(lines) - 1, i + context)
        if blocks and s <= blocks[-1][1] + 1:
            blocks[-1][1] = e
        else:
            blocks.append([s, e])
    return [(s + 1, e + 1) for s, e in blocks]


def test_excerpts_equal_a_sequential_merge(docs_of):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["HIT x", "a", "b", ""]) if rng.random() < 0.5 else "c" for _ in range(60)) for _ in range(50)]
    got = {}
    for r in search.search_excerpts(docs_of(*texts), "hit").orderBy("doc_id", "block_no").collect():
        got.setdefault(r.doc_id, []).append((r.start_line, r.end_line))
    assert got == {i: b for i, t in enumerate(texts, 1) if (b := brute_excerpts(t, "hit"))}


def test_excerpt_cap(docs_of):
    text = "\n".join("hit" if i % 6 == 0 else "x" for i in range(600))
    whole = search.search_excerpts(docs_of(text), "HIT").collect()
    assert len(whole) == 100 and not any(r.truncated for r in whole)
    got = search.search_excerpts(docs_of(text), "HIT", max_blocks=50).collect()
    assert len(got) == 50 and all(r.truncated and r.total_blocks == 100 for r in got)


def test_hits(spark):
    cells = spark.createDataFrame([(1, 0, 2, 1, "금액 " + "가" * 70)], "doc_id long, table_idx int, row int, col int, text string")
    paras = spark.createDataFrame(
        [(1, 0, 1, "x" * 50 + "금액" + "y" * 50), (1, 1, 1, "금액")], "doc_id long, section int, para_no int, text string"
    )
    got = {(r.kind, r.section): r.text for r in search.find_hits(cells, paras, "금액").collect()}
    assert got["표", None] == "금액 " + "가" * 70
    assert got["본문", 0] == "…" + "x" * 29 + "금액" + "y" * 29 + "…"
    assert got["본문", 1] == "금액"


def test_term_ways_agree(spark, docs_of):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "한글단어", "x", "deltaepsilon"]
    docs = docs_of(*[" ".join(rng.choices(words, k=8)) for _ in range(60)])
    terms = spark.createDataFrame(
        [(1, "alpha beta"), (2, "글단"), (3, "taeps"), (4, "X"), (5, "gamma x alpha"), (6, "nope"), (7, "  "), (8, "ha be")],
        "term_id int, term string",
    )
    want = {
        (d.doc_id, t.term_id)
        for d in docs.collect()
        for t in terms.collect()
        if t.term.strip() and t.term.strip().lower() in d.text.lower()
    }
    assert set(rows(search.find_terms(docs, terms), "doc_id", "term_id")) == want


def test_whole_terms(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "한글", "x", "rare%d"]
    text = lambda n: "".join((w % rng.randrange(40) if "%" in w else w) + rng.choice([" ", "\n", "  "]) for w in rng.choices(words, k=n))
    texts = [(i, text(60).upper() if i % 5 == 0 else text(60)) for i in range(50)] + [(None, text(60)), (50, None), (50, ""), (3, text(60))]
    # Pieces of documents, cut anywhere, some changed in one place; frequent words alone.
    terms = [(k, texts[k % 50][1][k : k + 4 * k]) for k in range(1, 70)]
    terms += [(100 + k, "z".join([t[:9], t[10:]])) for k, t in terms[10:30]] + [(200, "alpha beta x"), (201, "x x x x"), (202, "\nalpha beta gamma\n"), (203, None), (204, " ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = search.find_terms(docs, spark.createDataFrame(terms, "term_id int, term string")).collect()
    want = [(i, k) for i, t in texts for k, term in terms if term and term.strip(" ") and term.strip(" ").lower() in (t or "").lower()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(want) > 60 and any(i is None for i, _ in want)
    assert search.find_terms(docs, spark.createDataFrame([], "term_id int, term string")).collect() == []


def test_short_terms_of_every_length(spark):
    """Terms of one to three words, cut from the texts at any place, so that every size of key occurs."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abé한", k=rnd.choice([1, 2, 3, 6, 20, 40])))
    texts = [(i, "".join(word() + rnd.choice([" ", "  ", "\n", "\u2028", "\t"]) for _ in range(25))) for i in range(60)]
    cut = [t[a : a + n] for k, (_, t) in enumerate(texts) for n in (1, 2, 3, 4, 7, 8, 15, 16, 40) for a in [rnd.randrange(len(t) - n)] if k % 2]
    terms = [(k, t) for k, t in enumerate(cut) if t.strip(" \t\n")] + [(1000, "b\n"), (1001, "\ta"), (1002, "a \u2028"), (1003, "ab " + "b" * 50), (None, "ba ab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = search.find_terms(docs, spark.createDataFrame(terms, "term_id int, term string")).collect()
    want = [(i, k) for i, t in texts for k, term in terms if term.strip(" ").lower() in t.lower()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_terms_that_share_an_id(spark, docs_of):
    """A term is found whether or not another term of its id is."""
    terms = [(1, "alpha beta gamma delta"), (1, "no such words here"), (2, "beta gamma"), (2, "x"), (3, "gamma delta"), (3, "gamma delta")]
    docs = docs_of("Alpha beta gamma delta x", "beta  gamma")
    got = search.find_terms(docs, spark.createDataFrame(terms, "term_id int, term string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (1, 2), (1, 3), (1, 3)]


def test_words_stay_where_few_terms_are_sought(spark, tmp_path):
    """With a small table of terms, only texts and what is found in them are shuffled."""
    rnd = random.Random(8)
    noise = lambda: " ".join(str(rnd.random()) for _ in range(40))
    docs = [(i, f"some words of text {noise()} that hold term{i % 3} here") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, "that hold term1 here"), (2, "old term2"), (3, "ext")], "term_id int, term string").coalesce(1).write.parquet(f"{tmp_path}/terms")
    # Below the size of the documents, above that of the terms.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 50_000)
    found = search.find_terms(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/terms"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") <= 1
    assert found.count() == 100 + 100 + 300


CELLS = "doc_id long, section int, table_idx int, row int, col int, row_span int, col_span int, text string"
FORM = [
    (1, 0, 0, 0, 0, 1, 2, "신청서 양식"),
    (1, 0, 0, 1, 0, 1, 1, "성명"),
    (1, 0, 0, 1, 1, 1, 1, ""),
    (1, 0, 0, 2, 0, 1, 1, "생년월일"),
    (1, 0, 0, 2, 1, 1, 1, ""),
    (1, 0, 1, 0, 0, 1, 1, "성명"),
    (1, 1, 2, 0, 0, 1, 1, "생년월일 비고"),
]


def test_ranks_of_a_spread_group(spark):
    """Buckets change the tasks of a ranking, not its rows; null keys and null values too."""
    rnd = random.Random(3)
    data = [(rnd.choice(["hot", "hot", "x", None]), rnd.choice([None, *range(6)]), i) for i in range(300)]
    df = spark.createDataFrame(data, "source string, n long, id long")
    order = [F.desc("n"), F.col("id")]
    spread = {"_n": F.coalesce(-F.col("n"), F.lit(99)), "_ids": F.floor(F.col("id") / 20)}
    want = ranking.cap(df, ["source"], order)
    got = ranking.cap(df, ["source"], order, buckets=spread)
    assert rows(got, *want.columns) == rows(want, *want.columns) and got.schema["rank"].dataType == want.schema["rank"].dataType
    assert rows(ranking.cap(df, ["source"], order, 3, spread), *want.columns) == rows(ranking.cap(df, ["source"], order, 3), *want.columns)
    assert ranking.cap(df.limit(0), ["source"], order, buckets=spread).count() == 0


def test_anchor_rule_over_sections(spark):
    cells = spark.createDataFrame(FORM, CELLS)
    anchors = spark.createDataFrame(
        [(1, "신청서"), (1, "성명"), (1, "비고"), (1, "양식성명"), (1, "없음"), (1, " 생년월일 ")], "doc_id long, anchor string"
    )
    got = {r.anchor: (r.status, r.table_idx) for r in search.resolve_anchor(cells, anchors).collect()}
    assert got == {
        "신청서": ("found", 0),
        "성명": ("ambiguous", None),
        "비고": ("found", 2),
        "양식성명": ("found", 0),
        "없음": ("not_found", None),
        " 생년월일 ": ("found", 0),
    }


def test_anchors_in_pieces_of_tables(spark):
    """Whatever the size of a piece, the same as a search in the whole text of every table."""
    rnd = random.Random(5)
    cells, texts = [], {}
    for doc in (1, 2, 3, None):
        for table in range(4):
            # Long cells, empty ones, null ones; rows in disorder.
            grid = [(r, c, rnd.choice(["", None, "ab", "abc" * 7, "".join(rnd.choices("abc", k=rnd.randint(1, 90)))])) for r in range(6) for c in range(3)]
            grid = [(r, c, None if doc == 2 and table == 3 else t) for r, c, t in grid]
            texts[doc, table // 2, table] = "".join(t or "" for _, _, t in grid)
            cells += [(doc, table // 2, table, r, c, t) for r, c, t in rnd.sample(grid, len(grid))]
    asked = [(doc, " " + "".join(rnd.choices("abc", k=k)) + " ") for doc in (1, 2, 3, None) for k in (1, 2, 4, 5, 6, 7) for _ in range(3)]
    for (doc, _, _), text in texts.items():
        asked += [(doc, text[i : i + k].strip()) for i, k in ((0, 150), (40, 70), (len(text) - 9, 9), (3, 64))]
    asked += [(1, ""), (2, None), (9, "a"), (1, "ab"), (1, "ab")]

    def want(doc, anchor):
        found = [key for key, text in sorted(texts.items(), key=repr) if key[0] == doc and anchor is not None and anchor.strip() in text]
        found = [key for key in found if key[1] == found[0][1]]
        status = "not_found" if not found else "found" if len(found) == 1 else "ambiguous"
        return (doc, anchor, status, *(found[0][1:] if len(found) == 1 else (None, None)), len(found))

    df = spark.createDataFrame(cells, "doc_id long, section int, table_idx int, row int, col int, text string")
    anchors = spark.createDataFrame(asked, "doc_id long, anchor string")
    expected = sorted((want(*a) for a in asked), key=repr)
    assert {e[2] for e in expected} == {"not_found", "found", "ambiguous"}
    for size in (1, 64, search.PIECE_CHARS):
        got = search.resolve_anchor(df, anchors, size)
        assert rows(got, "doc_id", "anchor", "status", "section", "table_idx", "matches") == expected, size
    assert search.resolve_anchor(df.limit(0), anchors).filter("status <> 'not_found'").count() == 0
    asks = df.withColumn("reach", F.lit(10).cast("long"))
    assert search.table_pieces(asks, 64).filter(F.length("piece_text") > 64 + 9).count() == 0


def test_labels(spark):
    import unicodedata

    cells = spark.createDataFrame([r if r[7] != "생년월일" else (*r[:7], unicodedata.normalize("NFD", r[7])) for r in FORM], CELLS)
    requests = spark.createDataFrame(
        [(1, 1, "생년월일", "right", None), (1, 2, "성명", "right", None), (1, 3, "성명", "right", 0),
         (1, 4, "신청서 양식", "right", None), (1, 5, "신청서 양식", "below", None), (1, 6, "주소", "right", None)],
        "doc_id long, request_no int, label string, direction string, table_idx int",
    )
    got = {r.request_no: (r.status, r.row, r.col) for r in search.resolve_labels(cells, requests).collect()}
    assert got == {
        1: ("found", 2, 1),
        2: ("label_ambiguous", None, None),
        3: ("found", 1, 1),
        4: ("target_missing", None, None),
        5: ("found", 1, 0),
        6: ("label_missing", None, None),
    }


def test_running_equals_a_plain_window(spark):
    """One group holds most rows; two levels of buckets."""
    df = spark.range(5000).selectExpr(
        "if(id % 3 = 0, id % 11, 99) AS g", "id * 7919 % 5000 AS o", "id % 13 AS v", "id % 97 AS m"
    )
    got = ranking.running(
        df, ["g"], ["o"], {"b1": F.floor(F.col("o") / 1000), "b2": F.floor(F.col("o") / 50)},
        sums={"s": F.col("v")}, maxes={"x": F.col("m")},
    )
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("v").over(w), "x": F.max("m").over(w)})
    assert rows(got, "g", "o", "s", "x") == rows(want, "g", "o", "s", "x")
    before = ranking.running(df, ["g"], ["o"], {"b": F.floor(F.col("o") / 100)}, maxes={"x": F.col("m")}, inclusive=False)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    assert rows(before, "g", "o", "x") == rows(df.withColumn("x", F.max("m").over(w)), "g", "o", "x")


def test_attach_keeps_every_row(spark):
    many = spark.range(1000).selectExpr("id", "if(id < 900, 1, id) AS k")
    facts = spark.createDataFrame([(1, "a"), (950, "b")], "k long, f string")
    assert ranking.attach(many, facts, ["k"]).count() == 901
    assert ranking.attach(many, facts, ["k"], "left").count() == 1000


def test_gaps_and_renumbering(docs_of):
    docs = docs_of("1. a\n2. b\n4. c\n5. d\ntext\n7. e\n9. f")
    assert rows(ranking.sequence_gaps(docs), "line_no", "previous", "found", "expected") == [(3, 2, 4, 3), (7, 7, 9, 8)]
    assert rows(ranking.renumber(docs), "line_no", "new_number") == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 7), (7, 8)]


def test_first_occurrence_and_offsets(spark, docs_of):
    got = rows(ranking.first_occurrences(docs_of("a\nORG x\nORG"), "ORG"), "line_no", "is_first")
    assert got == [(2, True), (3, False)]
    sections = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 3)], "doc_id long, section int, tables long")
    assert rows(ranking.section_offsets(sections), "section", "global_offset") == [(0, 0), (1, 2), (2, 2)]
