import random
import zlib

import numpy as np
import pytest

from panelloom.llm import langid


def test_automaton_reads_all_substrings_and_no_others():
    dice = random.Random(2)
    for _ in range(30):
        text = [dice.randint(2, 4) for _ in range(40)]
        table = langid.suffix_automaton(text)
        inside = {tuple(text[i:j]) for i in range(40) for j in range(i + 1, min(41, i + 6))}
        for _ in range(200):
            w = [dice.randint(2, 5) for _ in range(dice.randint(1, 5))]
            s = 1
            for c in w:
                s = table[s].get(c, 0) if s else 0
            assert bool(s) == (tuple(w) in inside)


def naive_phrases(parser, lang, text):
    sample = "".join(map(chr, parser.trained[lang]))
    n = at = 0
    while at < len(text):
        length = 1
        while at + length < len(text) and text[at : at + length + 1] in sample and text[at : at + length] in sample:
            length += 1
        at += length
        n += 1
    return n


def test_phrases_are_greedy_longest_matches():
    samples = {"x": "the cat sat on the mat and the dog", "y": "le chat est sur le tapis et le chien"}
    parser = langid.CrossParser(samples)
    parser.trained = {k: parser.encode(langid.code_points(v)).tolist() for k, v in samples.items()}
    dice = random.Random(4)
    texts = ["".join(dice.choices("the cats lex zq", k=dice.randint(1, 200))) for _ in range(40)]
    coded = [parser.encode(langid.code_points(t)) for t in texts]
    got = parser.phrases(coded)
    for k, c in enumerate(coded):
        s = "".join(map(chr, c.tolist()))
        for i, lang in enumerate(parser.langs):
            assert got[i, k] == naive_phrases(parser, lang, s)


@pytest.mark.parametrize("lane", [7, 64, langid.LANE])
def test_lanes_join_to_one_parse(monkeypatch, lane):
    """Phrases of 10,000-character texts, whatever the lanes, equal a plain greedy parse."""
    monkeypatch.setattr(langid, "LANE", lane)
    samples = {"x": "ab" * 50 + "the cat sat on the mat and the dog", "y": "le chat est sur le tapis et le chien"}
    parser = langid.CrossParser(samples)
    parser.trained = {k: parser.encode(langid.code_points(v)).tolist() for k, v in samples.items()}
    dice = random.Random(7)
    texts = ["ab" * 5000, "".join(dice.choices("the cats lex zq", k=10_000)), "", "the mat and the " * 700, "a", "q" * 3000, "the cat sat on the ma" * 400]
    coded = [parser.encode(langid.code_points(t)) for t in texts]
    got = parser.phrases(coded)
    for k, c in enumerate(coded):
        s = "".join(map(chr, c.tolist()))
        assert got[:, k].tolist() == [naive_phrases(parser, lang, s) for lang in parser.langs]


def test_tables_follow_the_transitions_not_the_alphabet():
    """A language of 2,500 letters beside one of 26: the tables stay small."""
    dice = random.Random(3)
    samples = {"zh": "".join(chr(0x4E00 + int(2500 * dice.random() ** 2)) for _ in range(20_000)), "en": "".join(dice.choices("abcdefgh ijk", k=20_000))}
    parser = langid.CrossParser(samples)
    assert sum(x.nbytes for x in (parser.base, parser.moves, parser.again, parser.strange)) < 10_000_000
    assert [x for x, _ in parser.predict([samples["zh"][300:900], samples["en"][50:90], "12 34"])] == ["zh", "en", "und"]


def test_samples_are_whole_texts(spark):
    rows = [(i, "en", f"text number {i} " * 20) for i in range(40)] + [(100, "long", "x" * 500), (101, "long", "y" * 300 + " z"), (103, "en", "w" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = langid.training_samples(docs, 10, 2000, 400)
    texts = {r[2] for r in rows if r[1] == "en" and len(r[2]) <= 400 and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert all(x in texts for x in got["en"].split("\n")) and 1500 < len(got["en"]) <= 2010
    assert got["long"] == ("y" * 300 + " z" if zlib.crc32(b"101") % 4 != 2 else "x" * 500)


def test_held_out_accuracy(documents):
    rows = langid.identify(documents).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(edge_docs, no_docs, documents):
    samples = langid.training_samples(documents)
    rows = langid.identify(edge_docs, samples).collect()
    assert len(rows) == edge_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    kept = langid.of_known_language(edge_docs, samples)
    assert kept.columns == edge_docs.columns and kept.where("doc_id in (0, 1, 2)").count() == 0
    assert kept.where("doc_id = 3").count() == 4 - 1 + 1
    assert langid.identify(no_docs).count() == 0 and langid.of_known_language(no_docs).count() == 0
    assert langid.identify(edge_docs, {}).where("lang_pred <> 'und'").count() == 0


def test_samples_leave_the_held_out_fold_alone(documents):
    some = langid.training_samples(documents, 5, 2000)
    assert set(some) == {"en", "fr", "de", "es"} and max(map(len, some.values())) <= 2000
    held = [r.text for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.text]
    open_ = {r.text for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    joined = "\n".join(some.values())
    assert not any(t[:300] in joined for t in held if len(t) > 300 and t not in open_ and not any(o and t[:300] == o[:300] for o in open_))
