import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 64), st.sampled_from(["bit", "byte"]))
@settings(max_examples=80, deadline=None)
def test_planes_round_trip(ids, block, planes):
    x = np.array(ids, dtype="<u4")
    assert np.array_equal(tokens.unpack_ids(tokens.pack_ids(x, block, planes)), x)


def test_bad_segment():
    with pytest.raises(ValueError):
        tokens.unpack_ids(b"x" * 20)


def test_word_by_word_equals_whole_texts(documents):
    enc = tokens.WordEncoder(PATH, cache=500)
    plain = [chr(i) for i in range(0x20, 0x180) if not tokens._OTHER.search(chr(i))] + ["\n", "\t", "'s", "'LL", "1st"]
    dice = random.Random(0)
    texts = [r.text or "" for r in documents.collect()] + ["".join(dice.choices(plain, k=80)) for _ in range(1500)] + ["<|endoftext|> a", "hello <|endoftext|> world", "a<|startoftext|>b", "<|ENDOFTEXT|> x <|endoftext", "日本 x\x1cy", ""]
    plainly = Tokenizer.from_file(PATH)
    for text, e in zip(texts, plainly.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == e.ids


def brute(rows):
    plainly = Tokenizer.from_file(PATH)
    out, at = [], 0
    coded = [(d, np.array([*plainly.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in rows]
    for d, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]))):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("per_shard", [7, 20_000])
@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_table_against_brute_force(documents, space_of, per_shard, planes):
    docs = documents.limit(60).cache()
    got = sorted(tuple(r) for r in tokens.token_table(docs, space_of("t"), PATH, per_shard=per_shard, planes=planes).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge_docs, no_docs, space_of):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = tokens.token_table(edge_docs, space_of("t"), PATH, per_shard=4).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    want = brute(rows)
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got), key=str) == sorted((r[:1] + r[2:] for r in want), key=str)
    assert sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == sum(r[2] for r in want)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r[0] for r in sorted(want, key=key)]
    assert tokens.token_table(no_docs, space_of("t"), PATH).count() == 0


def test_added_tokens_are_the_library_s(spark, space_of):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|startoftext|><|endoftext|>"), (3, "plain words"), (4, "a < | endoftext | > b")]
    got = sorted(tuple(r) for r in tokens.token_table(spark.createDataFrame(rows, "doc_id long, text string"), space_of("t"), PATH).collect())
    assert got == brute(rows)
    assert np.frombuffer(tokens.WordEncoder(PATH).encode(rows[0][1]), "<u2").tolist() == [3306, 49407, 1002]
