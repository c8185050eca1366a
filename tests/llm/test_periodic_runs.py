"""Runs against all stretches tried one by one, and the query against its contract worked out in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodegraph.llm import periodic_runs, queries
from lodegraph.llm.periodic_runs import Ends, Runs

SF = "/root/testdata/sf0.001"


def plain(words, least=6, times=4):
    """All runs, by trying every period from every place."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        at = 0
        while at + q < n:
            stop = at
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            size = stop + q - at
            if stop > at and size >= max(least, times * q):
                own = words[at : at + size]
                if not any(all(own[k] == own[k + p] for k in range(size - p)) for p in range(1, q)):
                    out.append((at, size, q))
            at = stop + 1
    return sorted(out)


def some_words(rnd):
    letters = rnd.choice([1, 2, 2, 3, 5])
    words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 50))]
    for _ in range(rnd.randint(0, 3)):
        unit = [rnd.randrange(letters) for _ in range(rnd.randint(1, 6))]
        at = rnd.randint(0, len(words))
        words[at:at] = (unit * 12)[: rnd.randint(1, 40)]
    return words


@pytest.mark.parametrize("spec", [Runs(), Runs(2, 2), Runs(4, 3), Runs(10, 4), Runs(3, 2)])
def test_runs_of_random_words(spec):
    rnd = random.Random(5)
    texts = [some_words(rnd) for _ in range(300)]
    want = [plain(w, spec.least, spec.times) for w in texts]
    assert [periodic_runs.runs_of(w, spec) for w in texts] == want
    # together in one batch, where words that can't be in a run are left out before
    found = [runs for _, runs in periodic_runs.find(pa.array([" ".join(map(str, w)) for w in texts]), spec)]
    assert found == want and any(want)


def test_ordered_ends():
    rnd, ends, have = random.Random(1), Ends(5000), [5000]
    for x in rnd.sample(range(4999), 3000):
        before, after = ends.add(x)
        assert before == max((y for y in have if y < x), default=-1) and after == min((y for y in have if y > x), default=-1)
        have.append(x)
    assert list(ends) == sorted(have) and len(ends.blocks) > 2 and max(map(len, ends.blocks)) <= 2 * Ends.BLOCK


def test_long_periodic_texts_take_near_linear_time():
    assert periodic_runs.runs_of(["a"] * 60_000) == [(0, 60_000, 1)]
    assert periodic_runs.runs_of([str(k % 700) for k in range(30_000)]) == [(0, 30_000, 700)]


def expected(doc_id, text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_by_its_contract(spark, make_docs):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    short = [(r["doc_id"], r["text"]) for r in table if len(r["text"] or "") < 2000]
    extra = [(None, "a b " * 9), (10**12, " x y\tx y\vz " * 5), (7, None), (7, ""), (8, "\n"), (9, "no no no no no no no"), (9, "no no no no no no no")]
    # whole words of ids whose checksum is divisible by ten
    hit = [(k, "one two three four five " * 6) for k in range(3000) if zlib.crc32(str(k).encode()) % 10 == 0][:60]
    rows = short + extra + hit
    got = periodic_runs.digests(periodic_runs.looped(make_docs(rows, extra=True))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 40
    whole = queries.op11_periodic_runs(spark, SF)
    assert whole.count() == len(table) and tuple(whole.columns) == COLUMNS


def test_runs_and_collapsed_texts(make_docs):
    rows = {r["doc_id"]: r for r in periodic_runs.word_runs(make_docs([(1, "so  it goes on " + "la di da " * 5 + "end"), (2, None)])).collect()}
    assert [tuple(x) for x in rows[1]["runs"]] == [(4, 15, 3)] and rows[1]["collapsed"] == "so it goes on la di da end"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == ""
