from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm import rules


def plain(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            repeats += line in seen
            seen.add(line)
    spaces = " \t\n\r\x0b\x0c"
    return len(words), sum(c not in spaces for c in text), sum(c in "#*$%&|<>" for c in text), repeats, len(inside)


@given(st.text(alphabet="ab#| \n\té　", max_size=80))
def test_measures_match_their_definition(text):
    assert rules.measure_text(text.encode()) == plain(text)


def test_hosts_fall_by_shrunk_rate(spark):
    good = " ".join(f"w{i}" for i in range(12))
    rows = [(i, good, "fine") for i in range(40)]
    rows += [(100 + i, "too short", "bad") for i in range(38)] + [(150, good, "bad")]
    rows += [(200, "short", "tiny"), (201, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.apply_rules(docs).collect()}
    assert got[0] == (False, True)
    assert got[150] == (False, False)  # its host falls
    assert got[201] == (False, True)  # one failure of two is shrunk towards the corpus
    assert got[200] == (True, False)


def test_edge_rows(edge_docs, no_docs):
    rows = rules.apply_rules(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 5))
    assert {r.n_repeat_words for r in rows if r.doc_id == 4} == {40_000}
    assert rules.apply_rules(no_docs).collect() == []
