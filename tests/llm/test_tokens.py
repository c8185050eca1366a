from __future__ import annotations

import hashlib
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodegraph.llm import bpe, token_files
from lodegraph.llm.byte_tokens import ByteTokens
from lodegraph.llm.word_bpe import WordBPE

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " a ", "a   b ", "x\n\n  y", "a \tb", "a  b c", "<|endoftext|> hi <|startoftext|>x", "\x1c a \x1cb", "é è", "don't 's ́a", "\x85 a \x85b", "漢字 😀😀", "ΑΣ ΣΑΣ İ ẞ K", "aa" * 400, "Ⅷ ² ½", "a\x00b", "hello, WORLD. hello, world.", " !a  !b", "12 345,6"]


@pytest.fixture(scope="module")
def byte_pair():
    return ByteTokens(BYTES), Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_pair():
    return WordBPE(WORDS), Tokenizer.from_file(WORDS)


def test_byte_tokens(byte_pair):
    own, library = byte_pair
    got = own.encode([*ODD, None])
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in [*ODD, ""]]


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("ab ,.'\n\t1É"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(byte_pair, word_pair, text):
    assert byte_pair[0].encode([text])[0].tolist() == byte_pair[1].encode(text, add_special_tokens=False).ids
    ids = word_pair[1].encode(text, add_special_tokens=False).ids
    assert word_pair[0].encode(text) == ids
    assert word_pair[0].decode(ids) == word_pair[1].decode(ids, skip_special_tokens=False)


def test_words_are_not_taken_up_one_by_one(byte_pair):
    words = [a + e + b + c + d for a in ("Tre", "éan", "on") for e in "aeiouyäöüé" for b in "bcdfghjklm" for c in ("ab", "ing", "ou") for d in ("ly", "tion", "heß", "in", "ÿs")]
    texts = ["A " + " ".join(w + stop for w in words) + f".\n{words[k]}, end\n" for k, stop in enumerate(("", ".", ",", "&&&", ")."))]
    encoder, calls = ByteTokens(BYTES), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert [g.tolist() for g in got] == [byte_pair[1].encode(t, add_special_tokens=False).ids for t in texts]
    # each of 4500 words in 5 forms; Python's calls, those to libraries too, are for batches of them
    assert len(calls) < len(words)


def test_pieces_in_one_batch(byte_pair):
    own, library = byte_pair
    texts = [f"{a}{x}{b}" for x in (*ODD, "word.\nNext", "é,\nñ!", "a'\nb", "x.'s", "\n", "a\n b", "a.\u2028b", "ÿ Ā", "word.'") for a in ("", "on ", "on.\n") for b in ("", ".", " on", "\nOn, ")]
    no_such_byte = ByteTokens(BYTES)
    no_such_byte.between = b""
    for encoder in (own, own, no_such_byte, ByteTokens(BYTES, cache=3), ByteTokens(BYTES, long=2)):
        assert [g.tolist() for g in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.encode([]) == []


def test_word_bpe(word_pair):
    own, library = word_pair
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode_decode([text]) == [(" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
    own.encode("ertionerest thonouedly nderhest")
    assert 0 < own.failed < own.speculated


def test_full_caches_start_anew():
    small, library = WordBPE(WORDS, cache=5), Tokenizer.from_file(WORDS)
    for text in ("one two three four", "five six seven", "one two three four"):
        assert small.encode(text) == library.encode(text, add_special_tokens=False).ids
    few = ByteTokens(BYTES, cache=3)
    for text in ("one two three four", "five six seven", "one two three four"):
        assert few.encode([text])[0].tolist() == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [1, 50256, 7, 65535], [2**32 - 1, 0, 5], list(range(1000))])
def test_planes_round_trip(bits, ids):
    given_ids = np.array(ids, dtype=np.uint32)
    assert token_files.unpack(token_files.pack(given_ids, bits), len(ids), bits).tolist() == ids


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_crc32_join(a, b):
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("p", [token_files.TokenFiles(block_ids=7, bits=True), token_files.TokenFiles(batch_bytes=50)])
def test_token_files(spark, make_docs, tmp_path, p):
    rows = [(9, "the last one " * 9), (1, "hello world"), (4, None), (4, "again"), (None, "no id"), (7, "")]
    token_files.write(make_docs(rows, extra=True), f"file://{tmp_path}/t", BYTES, p, shards=3)
    got = [tuple(r) for r in token_files.read_documents(spark, f"file://{tmp_path}/t").orderBy("start").collect()]
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    for i, text in [(None, "no id"), (1, "hello world"), (4, None), (4, "again"), (7, ""), (9, "the last one " * 9)]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    index = spark.read.parquet(f"file://{tmp_path}/t/index").orderBy("start").collect()
    assert index[0]["start"] == 0 and sum(r["n_ids"] for r in index) == start and max(r["n_ids"] for r in index) <= p.block_ids


def test_no_documents(spark, make_docs, tmp_path):
    token_files.write(make_docs([]), f"file://{tmp_path}/e", BYTES)
    assert token_files.read_documents(spark, f"file://{tmp_path}/e").count() == 0
    assert bpe.digests(make_docs([]), WORDS).count() == 0


def test_bpe_queries(spark, make_docs):
    library = Tokenizer.from_file(WORDS)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "twice"), (None, None)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.digests(make_docs(rows, extra=True), WORDS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = {r.doc_id: r for r in bpe.encode_decode(make_docs([(1, "Hi there")]), WORDS).collect()}
    assert whole[1].decoded == "hi</w> there</w>"


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="word-end"):
        WordBPE(_broken())


def _broken():
    import json
    import tempfile

    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:1]
    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False, encoding="utf-8") as out:
        json.dump(spec, out)
    return out.name
