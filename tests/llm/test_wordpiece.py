import random

from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm import wordpiece
from paperloom.llm.bpe import RANKS, read_ranks


def greedy(word, vocabulary):
    count, at = 0, 0
    while at < len(word):
        size = max((n for n in range(1, len(word) - at + 1) if word[at : at + n] in vocabulary), default=0)
        if not size:
            return 1
        count, at = count + 1, at + size
    return count


@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=20))
def test_automaton_counts_greedy_pieces(vocabulary, words):
    got = wordpiece.Automaton(vocabulary).counts(words).tolist()
    assert got == [greedy(w, set(vocabulary)) if w else 0 for w in words]


def test_whole_texts(small):
    import public_tokenizers

    vocabulary = set(read_ranks(public_tokenizers.path(RANKS)))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count_tokens(small).collect()}
    docs = small.select("doc_id", "text").collect()
    assert set(got) == {d.doc_id for d in docs}
    for doc in random.Random(1).sample(docs, 25):
        words = doc.text.encode().split()
        assert got[doc.doc_id] == (len(words), sum(greedy(b" " + w, vocabulary) for w in words))


def test_edge_rows(edge_docs, no_docs):
    rows = wordpiece.count_tokens(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: (r.n_words, r.n_tokens) for r in rows}
    assert by_id[2] == by_id[3] == by_id[5] == (0, 0)
    assert by_id[4] == (40_001, 40_001)
    assert by_id[None][0] == 5
    assert wordpiece.count_tokens(no_docs).collect() == []


def test_cache_that_overflows_starts_anew(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(wordpiece, "CACHE_WORDS", 2)
    known = wordpiece.Counts(public_tokenizers.path(RANKS))
    known.add({b"one"})
    known.add({b"two", b"three"})
    assert set(known) == {b"two", b"three"}
