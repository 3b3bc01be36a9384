import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from paperloom.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    (packed, _), = bpe.encode_texts([text.encode()], PATH)
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_match_the_library():
    known, rnd = library(), random.Random(3)
    letters = list("ab'srtvelmd  \n\t\r1٣ 9!?é日 　x́\U0001f600R'")
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    made += ["a" * 5000, " " * 700 + "\n", "it's we'rest 'sure ''s 'll'", "<|endoftext|>", "'", "x'", " '"]
    got = bpe.encode_texts([t.encode() for t in made], PATH)
    for text, (packed, offsets) in zip(made, got):
        assert np.frombuffer(packed, "<u4").tolist() == known.encode_ordinary(text)
        assert bpe.decode_ids(packed, offsets, PATH) == text.encode()


def test_blocks_join_at_any_length():
    known = library()
    for n in range(bpe.BLOCK - 3, bpe.BLOCK + 4):
        text = "x" * (n % 7) + " don't" * 90
        text = text[:n]
        assert ids(text) == known.encode_ordinary(text)


def test_cache_that_overflows_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    known = bpe.Pieces(bpe.read_ranks(PATH))
    first = [b" alpha", b" betaxq", b" gammazz"]
    known.add(first)
    want = [known[p] for p in first]
    known.add([b" deltaq", b" epsilonq", b" zetaqqq"])
    known.add(first)
    assert [known[p] for p in first] == want


def test_bytes_that_are_no_text_come_back():
    data = b"ok \xff\xfe \xc3( end"
    (packed, offsets), = bpe.encode_texts([data], PATH)
    assert bpe.decode_ids(packed, offsets, PATH) == data


def test_edge_rows(edge_docs, no_docs):
    rows = bpe.digests(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    known = library()
    for row, text in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(edge_docs.collect(), key=lambda r: (r.doc_id or 0,))):
        want = known.encode_ordinary(text.text or "")
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text.text or "").encode()).hexdigest()
    assert bpe.digests(no_docs).collect() == []
    apart = bpe.decode(bpe.encode(edge_docs, keep=("id",)))
    together = bpe.round_trip(edge_docs, keep=("id",))
    assert sorted(map(str, apart.collect())) == sorted(map(str, together.collect()))
