import collections
import random

import numpy as np
import pytest

from paperloom.llm import linededup

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, min_chars):
    def key(line):
        k = line.strip(SPACES)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders, last = collections.Counter(), {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    for i, lines in split:
        for k in {key(x) for x in lines}:
            holders[k] += 1
            last[k] = max(last.get(k, i), i, key=order)
    out = []
    for i, lines in split:
        left = [x for x in lines if not (len(key(x)) >= min_chars and holders[key(x)] >= min_docs and last[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def run(spark, rows, min_docs=5, min_chars=40):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, hi string, shard int")
    got = linededup.drop_shared_lines(docs, min_docs, min_chars).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr)


@pytest.mark.parametrize("min_docs, min_chars", [(2, 1), (3, 6), (5, 8)])
def test_matches_brute_force(spark, min_docs, min_chars):
    rnd = random.Random(min_docs)
    lines = ["".join(rnd.choice("abÉéÄ日 ") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    vary = lambda s: rnd.choice([s, s.upper() if s.isascii() else s, "  " + s + "\t\r", s + "\x0b", " " + s])
    rows = [(i, "\n".join(vary(rnd.choice(lines)) for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, rows[4][1]), (None, lines[0]), (7, rows[7][1]), (7, lines[1])]
    assert run(spark, rows, min_docs, min_chars) == brute(rows, min_docs, min_chars)


def test_hot_line_and_long_text(spark):
    hot = "This line stands in every document of the corpus, word for word."
    rows = [(i, f"{i} own line number {i} that nobody else holds, long enough\n{hot}\n{hot}") for i in range(400)]
    rows.append((9999, "\n".join(f"line {k} of a very long document, all its own and different" for k in range(30_000)) + "\n" + hot.upper()))
    got = run(spark, rows)
    assert got == brute(rows, 5, 40)
    assert sum(r[2] for r in got) == 800


def test_below_the_bounds_nothing_goes(spark):
    short, long = "x" * 39, "y" * 40
    rows = [(i, short) for i in range(9)] + [(20 + i, long) for i in range(4)]
    assert run(spark, rows) == brute(rows, 5, 40)
    assert sum(r[2] for r in run(spark, rows + [(50, long)])) == 4
    assert run(spark, []) == []


def test_edge_rows(spark, edge_docs):
    got = linededup.drop_shared_lines(edge_docs, keep=("lang", "owner")).collect()
    assert len(got) == edge_docs.count()
    assert {r.n_dropped for r in got} == {0}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    rnd = np.random.default_rng(n)
    hi, lo = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    places = linededup.Places.build(hi, lo)
    assert sorted(places.find(hi, lo).tolist()) == list(range(n))
    # Others get a place or none; levels are compact.
    other = places.find(lo, hi)
    assert ((other >= -1) & (other < max(n, 1))).all()
    assert n < 100 or len(places.bits) < 4 * n
    with pytest.raises(ValueError):
        linededup.Places.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_shards_and_slices_do_not_change_results(spark):
    rnd = random.Random(2)
    lines = [f"shared line {k} " + "z" * 40 for k in range(50)]
    docs = spark.createDataFrame([(i, "\n".join(rnd.choice(lines) for _ in range(8))) for i in range(200)], "doc_id long, text string")
    names = linededup.line_names(docs)
    one = linededup.lines_to_drop(names, linededup.line_index(names))
    many = linededup.lines_to_drop(names, linededup.line_index(names, shard_names=7), slice_questions=20)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(many) != []
