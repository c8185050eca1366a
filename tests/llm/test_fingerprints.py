from __future__ import annotations

import hashlib

import pytest

from lodegraph.llm.fingerprints import Fingerprints, edit_likeness, near_components
from test_near_dedup import brute


@pytest.mark.parametrize("range_bytes", [40, 1 << 27])
def test_edited_texts(spark, make_docs, range_bytes):
    rows = [(k * 3, f"word{k} " * k + "é" * (k % 4)) for k in range(14)] + [(50, None), (51, ""), (60, "same text of more words here"), (61, "same text of more words here")]
    got = {r.doc_id: r for r in edit_likeness(make_docs(rows, extra=True), Fingerprints(range_bytes=range_bytes, batch_rows=2)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for at, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and (edited != text or r.near_edited == 1)
    assert got[60].fingerprint == got[61].fingerprint and got[61].near_next == 1


def test_ties_nulls_and_a_lone_document(spark, make_docs):
    rows = [(5, "b b"), (5, "a a"), (None, "zz"), (1, "cccc")]
    got = [(r.doc_id, r.edited_sha256) for r in edit_likeness(make_docs(rows)).collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(got, key=str) == sorted([(5, sha("a b")), (5, sha("b c")), (1, sha("cczz")), (None, sha("za"))], key=str)
    assert edit_likeness(make_docs([(1, "abcd")])).first().near_next == 1
    assert edit_likeness(make_docs([])).count() == 0


def test_components(spark, make_docs):
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(0, 12, 3)] + [(20, " ".join(base)), (21, " ".join(base[::-1])), (22, None)]
    got = {r.doc_id: r.component_id for r in near_components(spark, make_docs(rows, extra=True)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 5, 80).items()}


def test_components_with_odd_rows(spark, make_docs):
    base = [f"w{k}" for k in range(80)]
    rows = [(1, " ".join(base)), (2, None), (2, " ".join([*base[:-1], "x"])), (3, ""), (4, "other words altogether in this one"), (None, " ".join(base)), (5, " ".join(base * 300))]
    got = {r.doc_id: r.component_id for r in near_components(spark, make_docs(rows, extra=True)).collect()}
    # a very long text that repeats another has nearly its shingles
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    assert near_components(spark, make_docs([])).count() == 0
