import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from panelloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return pieces.pieces_of(PATH)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def lattice():
    """The library on the same pieces, told that they are a unigram model."""
    data = open(PATH, "rb").read()
    out = b""
    for number, value in pieces._fields(data):
        if number == 2:
            value = b"".join(_varint(k << 3) + _varint(v) for k, v in ((3, 1), (35, 1)))
        out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def brute(codec, text):
    """Best score over all segmentations, position by position."""
    scores = {p: s for p, s, k in zip(codec.pieces, codec.scores, codec.kinds, strict=True) if k == pieces.NORMAL}
    best = [0.0] + [-1e300] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[j - 1] not in scores:
            best[j] = max(best[j], best[j - 1] + codec.unk_score)
    return best[-1]


def total(codec, ids):
    return sum(codec.scores[i] for i in ids if codec.kinds[i] == pieces.NORMAL)


def test_scores_are_the_best(codec, documents):
    words = sorted({w for r in documents.collect() for w in (r.text or "").split()})
    for w in random.Random(0).sample(words, 400):
        cut = codec.normalise(w)
        known = [c for c in cut if c in codec.pieces]
        ids = codec.viterbi(cut)
        if len(known) == len(cut):
            assert total(codec, ids) == pytest.approx(brute(codec, cut))


def test_agrees_with_the_library(codec, lattice, documents):
    words = sorted({w for r in documents.collect() for w in (r.text or "").split()})
    for w in random.Random(1).sample(words, 400):
        mine = np.frombuffer(codec.encode(w), "<u4").tolist()
        best = lattice.nbest_encode(w, nbest_size=2)[0]
        assert mine == best or total(codec, mine) == total(codec, best)


def test_cuts_change_nothing(codec, documents):
    for r in documents.limit(20).collect():
        text = (r.text or "")[:400]
        whole = codec.viterbi(codec.normalise(text))
        assert total(codec, np.frombuffer(codec.encode(text), "<u4").tolist()) == pytest.approx(total(codec, whole))


def test_decoding(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ["", " ", "  two  spaces ", "tab\tand\nline\n\n", "日本語 🙂 é", "\x00\x01", "a" * 3000]:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert codec.decode(ids) == text == library.decode(ids)


def test_trie_finds_all_prefixes():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, b"\xff\x00": 5, b"abd": 6}
    trie = pieces.DoubleArray(keys)
    assert list(trie.prefixes(b"abcx", 0)) == [(1, 1), (2, 2), (3, 3)]
    assert list(trie.prefixes(b"abd", 0)) == [(1, 1), (2, 2), (3, 6)]
    assert list(trie.prefixes(b"z\xff\x00", 1)) == [(3, 5)]
    assert list(trie.prefixes(b"q", 0)) == []


def test_small_cache_is_only_slower(codec):
    small = pieces.UnigramPieces(open(PATH, "rb").read(), cache=3)
    assert small.encode("one two three four one two") == codec.encode("one two three four one two")


def test_table(edge_docs, no_docs):
    rows = pieces.piece_table(edge_docs, PATH, with_ids=True).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.round_trip for r in rows if r.doc_id != 4 or True) is True
    assert {r.n_pieces for r in rows if r.doc_id == 1} == {0}
    assert pieces.piece_table(no_docs, PATH).count() == 0


def test_lockstep_equals_one_by_one(codec, monkeypatch):
    dice = random.Random(7)
    letters = "abc de\n日本語ßéİ😀\x00▁zq'"
    cuts = ["".join(dice.choices(letters, k=dice.randint(1, 40))) for _ in range(3000)] + ["\ud800x", "a" * 48, "😀" * 48, "é", "the", "▁the"]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.viterbi_many(cuts)] == [codec.viterbi(x) for x in cuts]
    texts = [None, "", " ", *(" ".join(dice.choices(cuts, k=30)) for _ in range(200)), "x" * 500, "one\n\ntwo"]
    want = [codec.encode(t) for t in texts]
    fresh = pieces.UnigramPieces(open(PATH, "rb").read(), cache=300)
    asked = []
    monkeypatch.setattr(fresh, "viterbi", lambda cut: asked.append(cut) or codec.viterbi(cut))
    monkeypatch.setattr(pieces, "TOGETHER", 700)
    assert fresh.encode_many(texts) == want and len(fresh.seen) <= 300
    asked.clear()
    whole = pieces.UnigramPieces(open(PATH, "rb").read())
    monkeypatch.setattr(whole, "viterbi", lambda cut: asked.append(cut) or codec.viterbi(cut))
    monkeypatch.setattr(pieces, "TOGETHER", 1 << 18)
    assert whole.encode_many(texts) == want
    assert all(len(x) > pieces.KEPT_CUT for x in asked)  # all short cuts were segmented together
