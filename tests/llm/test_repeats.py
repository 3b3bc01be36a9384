import collections
import random
import re

import numpy as np
import pytest

from paperloom.llm import repeats


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, data):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone]))
        out.append((i, len(t), int(gone.sum()), edges.tolist(), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, length, **how):
    docs = spark.createDataFrame([(i, t, "o", 1) for i, t in rows], "doc_id long, text string, owner string, runs int")
    got = repeats.remove_repeats(docs, length, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, list(r.spans), bytes(r.kept_bytes)) for r in got), key=repr)


@pytest.mark.parametrize("length", [16, 30, 64, 400])
def test_matches_all_windows(spark, length):
    rnd = random.Random(length)
    letters = "abé \n"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [make(rnd.choice([length // 2, length, length + 1, 3 * length])) for _ in range(8)]
    rows = []
    for i in range(60):
        text = "".join(rnd.choice([make(rnd.randint(0, length)), rnd.choice(passages), rnd.choice(passages)[rnd.randint(0, 5) :]]) for _ in range(rnd.randint(0, 6)))
        rows.append((i, text))
    rows += [(100, "ab" * length), (101, "a" * (length + 1)), (102, rows[3][1]), (103, "x" + rows[3][1])]
    assert run(spark, rows, length) == brute(rows, length)


def test_passage_of_exactly_the_length_in_many_places(spark):
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    shared, short = make(400), make(399)
    rows = [(i, make(rnd.randint(0, 300)) + (shared if i % 3 else short) + make(rnd.randint(0, 300))) for i in range(90)]
    got = run(spark, rows, 400)
    assert got == brute(rows, 400)
    assert sum(r[2] for r in got) >= 60 * 400


def test_edge_rows(spark):
    long = "".join(random.Random(3).choice("abcdef ") for _ in range(300_000))
    rows = [(1, None), (2, ""), (None, "q" * 500), (3, "r" * 400), (4, long), (5, "s" * 399), (6, "t" * 401), (6, "t" * 401), (7, long[1000:1399])]
    assert run(spark, rows, 400) == brute(rows, 400)
    assert run(spark, [], 400) == []
    with pytest.raises(ValueError):
        repeats.anchors(np.zeros(50, np.uint8), 8)


def test_whole_characters_stay(spark):
    text = "é" * 300
    rows = [(1, "x" + text + "y"), (2, "zz" + text)]
    for _, _, _, _, kept in run(spark, rows, 400, characters=True):
        kept.decode()


def test_texts_beyond_one_step(monkeypatch):
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 101, 3000).astype(np.uint8)
    whole = repeats.anchors(text, 64)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    parts = repeats.anchors(text, 64)
    at = lambda c: np.repeat(c[0], c[2] - c[1] + 1).tolist()
    assert at(whole) == at(parts)


def words_brute(rows, size):
    """Bytes left when every word in a repeated run of size words goes."""
    split = [(i, t or "", [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]) for i, t in rows]
    seen = collections.Counter(tuple(t[a:b] for a, b in w[k : k + size]) for _, t, w in split for k in range(len(w) - size + 1))
    out = []
    for i, t, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(t[a:b] for a, b in w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        edges = []
        for k, ((a, b), g) in enumerate(zip(w, gone)):
            if g and k and gone[k - 1]:
                edges[-1] = b
            elif g:
                edges += [a, b]
        cuts = [0, *edges, len(t)]
        out.append((i, "".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [4, 7, 50])
def test_windows_of_words(spark, size):
    rnd = random.Random(size)
    make = lambda n: [rnd.choice(["a", "bé", "日本", "longer", "x1", "."]) for _ in range(n)]
    passages = [make(rnd.choice([size - 1, size, size + 1, 3 * size])) for _ in range(8)]
    text = lambda: "".join(w + rnd.choice([" ", "\n", "  ", "\t "]) for _ in range(rnd.randint(0, 5)) for w in rnd.choice([make(rnd.randint(0, 2 * size)), rnd.choice(passages)]))
    rows = [(i, text()) for i in range(80)] + [(100, None), (101, ""), (102, "a " * 3 * size), (103, " \n"), (5, "x"), (6, "  " + " ".join(passages[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, bytes(r.kept_bytes).decode()) for r in repeats.remove_repeats(docs, words=size).collect()), key=repr)
    assert got == words_brute(rows, size)
    assert sum(len(t) for _, t in got) < sum(len(t or "") for _, t in rows)
