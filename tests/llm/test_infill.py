import hashlib
import random
import re

import duckdb
import pytest

from panelloom.llm import infill as fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """By the code points of the whole text, without an index."""
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ALPHABET = ["a", "é", "日本", "\U0001f600", "z\xa0y", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", " ", "<", "P>", "<S", ">", "\x00"]


@pytest.mark.parametrize("every,chunk", [(1, 1), (2, 3), (3, 7), (64, 1 << 20)])
def test_checkpoints_find_every_cut(every, chunk):
    dice = random.Random(every)
    for _ in range(150):
        text = "".join(dice.choices(ALPHABET, k=dice.randint(0, 40)))
        units = UNITS.findall(text)
        index = fim.Checkpoints(text.encode(), every, chunk)
        assert index.n == len(units)
        assert index.units == list(range(0, len(units) + 1, every))
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.cut(u) == (len(head.encode()), len(head))


def test_index_is_sparse():
    text = b"word " * 200_000
    index = fim.Checkpoints(text)
    assert index.n == 200_001 and len(index.places) == 200_001 // fim.EVERY + 1
    assert index.cut(199_999) == (199_998 * 5 + 4, 199_998 * 5 + 4)


def test_against_brute_force(spark, documents):
    dice = random.Random(3)
    rows = [(i, "".join(dice.choices(ALPHABET, k=dice.randint(0, 60)))) for i in range(400)] + [(r.doc_id, r.text) for r in documents.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(map(str, r))
    got = fim.infill(df).collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((str(i), digest(brute(i, t)[5]), digest(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in fim.infill_digests(df).collect()) == want


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    key = lambda r: tuple(map(str, r))
    got = fim.infill(edge_docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert fim.infill(no_docs).count() == 0 and fim.infill_digests(no_docs).columns[-1] == "restored_sha256"


def test_sentinels_stay_plain_and_rates_hold(spark):
    rows = [(i, "one <P> two") for i in range(20)] + [(100 + i, "one two three four") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    forms = [r.form for r in fim.infill(df).collect() if r.doc_id >= 100]
    assert 230 < 600 - forms.count("plain") < 370 and forms.count("spm") > 2.5 * forms.count("psm")
    assert {r.form for r in fim.infill(df).where("doc_id < 100").collect()} == {"plain"}
    assert {r.form for r in fim.infill(df, rate=100, suffix_first=0).where("doc_id >= 100").collect()} == {"psm"}


def test_sql(spark, documents, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = fim.infill_digests(documents)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(fim.SQL).fetchall()))
