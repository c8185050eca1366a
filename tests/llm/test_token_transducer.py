"""Token counts against the library, and the machines against plain restatements."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lodegraph.llm import queries, token_transducer
from lodegraph.llm.token_transducer import TokenCounter, WordMachine, word_transition

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = [*"'strevlmdaBZ01.! \n\t", "'re", "'ll", "İ", "ß", "é", "é", "́", "中", "文", "ａ", "٣", "½", "²", "\x1c", "\x85", " ", "​", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "😀", "\0", "Σ", "ς", "ǅ", "ﬁ", "가", "ᄀ", "ᅡ", "ᆨ", "Å", "…", "—", "’s", "𝔸", "Ⅷ", "ŉ", "ᾳ"]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_random_texts(library, counter):
    texts = random_texts(1500, 1)
    assert counter.count(texts).tolist() == library(texts)
    assert [int(counter.count([t])[0]) for t in texts[:300]] == library(texts[:300])


def test_pieces_bounds_and_chunks(library):
    """Small pieces, chunks, remembered words and states change no count."""
    texts = random_texts(400, 2) + [None, "", "x" * 3000, "it's " * 500, "中文" * 600, "'" * 99]
    small = TokenCounter(PATH, cache=40, long=5, piece=7, states=60)
    small.words.chunk = 3
    assert small.count(texts).tolist() == library(texts)
    assert len(small.counts) < 200 and max(len(w.encode()) for w in small.counts) <= 5 and len(small.machine.parts) < 200


def test_word_machine_and_its_maps():
    """Starts of words as the file's pattern has them, and chunks' maps as running each from all states gives them."""
    rnd, machine, letters = random.Random(3), WordMachine(chunk=4), " as rvle1.'"
    kind = {c: k for k, c in enumerate(letters)}
    kind |= {"t": token_transducer.ENDS}
    pattern = re.compile(r"'s|'t|'re|'ve|'ll|[a-z]+|1|[.']+")
    for _ in range(400):
        text = "".join(rnd.choice(letters.replace(" ", "") + "t ") for _ in range(rnd.randint(0, 40))) + " "
        kinds = np.array([{" ": 0, "a": 1, "s": 2, "t": 2, "r": 3, "v": 4, "l": 5, "e": 6, "1": 7, ".": 8, "'": 9}[c] for c in text], np.uint8)
        want = np.zeros(len(text), bool)
        want[[m.start() for m in pattern.finditer(text)]] = True
        assert machine.word_starts(kinds).tolist() == want.tolist(), text
        rows = -(-len(kinds) // 4)
        dealt = np.zeros((rows, 4), np.uint8)
        dealt.reshape(-1)[: len(kinds)] = kinds
        state, entries = token_transducer.BETWEEN, []
        for row in dealt.tolist():
            entries.append(state)
            for k in row:
                state = word_transition(state, k)[0]
        assert machine.entries(dealt).tolist() == entries


def test_counts_of_prefixes_by_moves(counter, library):
    """What the transitions emit adds up to the count of every word."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeiouthnsrl") for _ in range(rnd.randint(1, 14))) for _ in range(800)] + ["q" * 500]
    assert [counter.machine.count(w.encode()) for w in words] == library(words)


def test_query(spark, library, make_docs):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(table, library([r["text"] for r in table]), strict=True)}
    got = queries.op13_transducer_token_counts(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()} == want
    odd = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "word " * 3000)]
    rows = token_transducer.count_tokens(make_docs(odd, extra=True), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 5, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 5, 1, False), (3, 5, 1, False), (4, 15000, 3000, True)]
    assert token_transducer.count_tokens(make_docs([]).limit(0), PATH).count() == 0
