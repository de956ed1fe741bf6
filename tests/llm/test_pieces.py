import os
import random

import numpy as np
import pytest

from loomlog.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.MODEL)


def as_unigram(data: bytes) -> bytes:
    """The model file with its kind set to unigram (field 3 of message field 2)."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    out, i = bytearray(), 0
    while i < len(data):
        tag, j = varint(i)
        assert tag & 7 == 2
        size, j = varint(j)
        body = data[j : j + size]
        if tag >> 3 == 2:
            at = body.index(b"\x18\x02")
            body = body[:at] + b"\x18\x01" + body[at + 2 :]
        out += data[i:j] + body
        i = j + size
    return bytes(out)


def sequential(v, text):
    """One lattice over the whole text, without cuts."""
    return v.solve(" " + text) if text else (0, [])


def texts():
    rng = random.Random(8)
    words = ["the", "there", "Theaaa", "ünder", "x", "ing", "日本語テキスト", "▁", "▁▁a", "\n", "\t", "𝄞", "aaaaaaaaaaaaaaaaaaaaa", "  ", "    ", "1234567", "é", "-->"]
    out = ["".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    return out + ["", " ", "a", " " * 100, "漢" * 90, "x" * 200, "ab" * 57 + " " + "ab" * 40, "the " * 100]


def test_equals_the_library(vocabulary):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(pieces.MODEL, "rb").read()))
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choices("abcdeéürtions", k=rng.randrange(1, 12))) for _ in range(rng.randrange(1, 25)))
        # The library's n-best lattice; its one-best shortcut can stop short of the best sum.
        assert vocabulary.encode(text)[1] == lib.nbest_encode_as_ids(text, 2)[0]
        assert lib.decode(lib.encode(text)) == vocabulary.decode(vocabulary.encode(text)[1]) == text


def test_runs_equal_the_whole_lattice(vocabulary):
    for text in texts():
        assert vocabulary.encode(text) == sequential(vocabulary, text)
        assert vocabulary.decode(vocabulary.encode(text)[1]) == text


def test_matrix_products_are_associative():
    rng = random.Random(1)
    a, b, c = (np.array([[rng.choice([pieces.NEG, rng.randrange(-50, 0)]) for _ in range(4)] for _ in range(4)], dtype=object) for _ in range(3))
    assert (pieces.times(pieces.times(a, b), c) == pieces.times(a, pieces.times(b, c))).all()


def test_scan_equals_sequential(spark, vocabulary):
    rows = list(enumerate(texts())) + [(500, None), (None, "no id " * 20), (3, texts()[3])]
    out = pieces.encode(spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA), chunk=20, block=2).collect()
    got = sorted((str(r.doc_id), r.n_chunks, r.score, r.ids, r.round_trip) for r in out)
    want = []
    for k, t in rows:
        score, ids = (None, None) if t is None else sequential(vocabulary, t)
        n = 0 if t is None else -(-(len(t) + 1) // 20) if len(t) >= 20 else 1
        want.append((str(k), n, None if t is None else float(score), ids, None if t is None else True))
    assert got == sorted(want)


def test_decode_and_empty(spark, vocabulary):
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts())] + [(99, None, "")], SCHEMA)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {**dict(enumerate(texts())), 99: None}
    assert pieces.encode(docs.limit(0)).count() == 0
