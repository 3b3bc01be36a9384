import difflib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperloom.operators import unified
from paperloom.operators.dictionary import rename_dictionary
from paperloom.operators.edits import rename_terms


@given(st.lists(st.sampled_from("abcde "), max_size=14), st.lists(st.sampled_from("abcde "), max_size=14), st.integers(0, 4))
def test_hunks_turn_the_old_text_into_the_new(a, b, context):
    before, after = "\n".join(a), "\n".join(b)
    found = unified.hunks(before.split("\n"), after.split("\n"), context)
    named = [dict(zip(("before_start", "before_lines", "after_start", "after_lines", "body"), h)) for h in found]
    assert unified.patched(before, named) == after
    assert (found == []) == (before == after)
    for h in named:
        signs = [x[0] for x in h["body"].split("\n")]
        assert signs.count(" ") + signs.count("-") == h["before_lines"]
        assert signs.count(" ") + signs.count("+") == h["after_lines"]


@given(st.lists(st.sampled_from("abc"), max_size=10), st.lists(st.sampled_from("abc"), max_size=10))
def test_alignment_is_in_order(a, b):
    found = unified.aligned(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_header_and_context():
    a = [f"line {k}" for k in range(1, 21)]
    b = [*a[:9], "changed", *a[10:], "more"]
    ours = unified.hunks(a, b)
    theirs = [x for x in difflib.unified_diff(a, b, lineterm="") if x.startswith("@@")]
    assert [f"@@ -{p},{n} +{q},{m} @@" for p, n, q, m, _ in ours] == theirs
    assert ours[0][4].split("\n") == [" line 7", " line 8", " line 9", "-line 10", "+changed", " line 11", " line 12", " line 13"]
    moved = unified.hunks(list("abc"), list("cab"))
    assert [h[4] for h in moved] == ["+c\n a\n b\n-c"]


def test_patches_of_a_table(spark):
    rnd = random.Random(1)
    text = lambda: "\n".join(rnd.choice(["x", "y", "본문 2025년", f"l{rnd.randrange(30)}"]) for _ in range(rnd.randint(0, 60)))
    rows = [(i, text(), text()) for i in range(80)] + [(100, None, "a"), (101, "a", None), (102, "", ""), (None, "p\nq", "q\np"), (103, "same", "same"), (104, None, None)]
    pairs = spark.createDataFrame(rows, "pair_id long, before string, after string")
    diff = unified.unified_diff(pairs)
    got = {r.pair_id: r for r in unified.patch_texts(pairs.selectExpr("pair_id", "before AS text"), diff).collect()}
    assert all(r.applied for r in got.values()) and len(got) == len(rows)
    assert all((got[i].text or "") == (after or "") for i, _, after in rows)
    wrong = pairs.selectExpr("pair_id", "concat('other ', before) AS text").filter("pair_id < 5")
    assert not any(r.applied for r in unified.patch_texts(wrong, diff).collect() if r.pair_id in {x.pair_id for x in diff.collect()})


def apply(spark, texts, pairs, **how):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    terms = spark.createDataFrame(pairs, "find string, replace string")
    return [(r.text, r.replaced) for r in rename_dictionary(docs, terms, **how).orderBy("doc_id").collect()]


@pytest.mark.parametrize("shard_chars", [1 << 20, 6])
def test_dictionary_takes_the_leftmost_longest(spark, shard_chars):
    pairs = [("문화", "M"), ("문화기획팀", "팀A"), ("기획팀", "B"), ("ab", "1"), ("abc", "2"), ("bcd", "3"), ("x", None), ("", "no"), (None, "no"), ("dup", "z"), ("dup", "a")]
    texts = ["문화기획팀과 문화, 기획팀", "abcd ab bcd abcbcd", "xXx", "", None, "dup", "nothing here", "abcd ab bcd abcbcd"]
    want = [("팀A과 M, B", 3), ("2d 1 3 23", 5), ("X", 2), ("", 0), (None, 0), ("a", 1), ("nothing here", 0), ("2d 1 3 23", 5)]
    assert apply(spark, texts, pairs, shard_chars=shard_chars) == want
    assert apply(spark, ["AB x İx"], [("aB", "1"), ("X", "2")], case_sensitive=False, shard_chars=shard_chars) == [("1 2 İ2", 3)]


def test_empty_dictionary(spark):
    assert apply(spark, ["a", None], []) == [("a", 0), (None, 0)]


def test_dictionary_equals_replacements_in_turn(spark):
    """Terms that never meet in a text, and whose replacements make no new ones."""
    rnd = random.Random(3)
    terms = [(f"<{k}>", f"[{k % 7}]") for k in range(300)]
    texts = [" ".join(rnd.choice([f"<{rnd.randrange(400)}>", "word"]) for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    some = terms[:40]
    in_turn = [(r.text, r.replaced) for r in rename_terms(docs, some).orderBy("doc_id").collect()]
    assert apply(spark, texts, some) == in_turn == apply(spark, texts, some, shard_chars=50)
    whole = []
    for t in texts:
        n = 0
        for find, to in terms:
            n += t.count(find)
            t = t.replace(find, to)
        whole.append((t, n))
    assert apply(spark, texts, terms) == whole


def test_texts_are_scanned_in_bounded_runs(monkeypatch):
    import pyarrow as pa

    from paperloom.operators import dictionary

    monkeypatch.setattr(dictionary, "BATCH_BYTES", 10)
    texts = ["가나", "x" * 50, None, "", "abc", "defgh", "ijk", "l"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts})
    runs = [b.column("text").to_pylist() for b in dictionary.bounded(iter([batch, batch.slice(0, 0), batch.slice(7)]))]
    assert sum(runs, []) == [*texts, "l"]
    assert all(len(run) == 1 or sum(len((t or "").encode()) for t in run) <= 10 for run in runs)
