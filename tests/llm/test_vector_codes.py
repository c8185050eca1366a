"""Codebooks and codes against plain Python integers, and against DuckDB."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import queries, vector_codes
from lodegraph.llm.vector_codes import Codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, spec):
    """The contract on lists of Python integers."""
    usable = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(v, [math.floor(spec.scale * x) for x in e], label) for v, e, label in usable]
    width = len(kept[0][1]) // spec.parts
    part = lambda x, p: x[p * width : (p + 1) * width]
    first = kept[: spec.entries]
    books = [[part(x, p) for _, x, _ in first] for p in range(spec.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(x):
        told = [min((far(part(x, p), c), k) for k, c in enumerate(books[p])) for p in range(spec.parts)]
        return [k for _, k in told], sum(d for d, _ in told)

    for _ in range(spec.rounds):
        near = [assign(x)[0] for _, x, _ in kept]
        renewed = []
        for p in range(spec.parts):
            own = [[part(x, p) for (_, x, _), n in zip(kept, near, strict=True) if n[p] == k] for k in range(len(books[p]))]
            renewed.append([[sum(c) // len(some) for c in zip(*some, strict=True)] if some else books[p][k] for k, some in enumerate(own)])
        books = renewed
    told = [(v, *assign(x), label) for v, x, label in kept]
    totals = {}
    for *_, error, label in told:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((v is None, v or 0, "".join(f"{k:02x}" for k in code), error, totals[label], digest) for v, code, error, label in told)


def told(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(2)
    good = [(rnd.randrange(60), [rnd.choice([-1.5, 0.25, rnd.gauss(0, 1), 0.001]) for _ in range(8)], rnd.choice([None, None, 1, 2])) for _ in range(150)]
    same = [(3, [0.5] * 8, 1)] * 5 + [(None, [-0.5] * 8, None)] * 2
    bad = [(1, None, 1), (2, [], 1), (4, [1.0] * 7 + [None], 2), (5, [float("nan")] * 8, 2), (0, [float("-inf")] + [0.0] * 7, None)]
    return [(v, e and [x if x is None else float(np.float32(x)) for x in e], k) for v, e, k in good + same + bad]


@pytest.mark.parametrize("spec", [Codes(parts=4, entries=16), Codes(parts=2, entries=64, rounds=3, scale=10), Codes(parts=8, entries=200, rounds=0), Codes(parts=4, few_labels=0)])
def test_odd_vectors(spark, odd, spec):
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("of", "slot", "n", "vector", "id", "codes", "s0", "error")}).repartition(5)
    assert told(vector_codes.compress(spark, df, spec)) == plain(odd, spec)


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(spark, empty).count() == 0
    assert vector_codes.compress(spark, spark.createDataFrame([(1, [None], 1), (2, None, None)], SCHEMA)).count() == 0
    for rows in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 15, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Exception, match="components"):
            vector_codes.compress(spark, spark.createDataFrame(rows, SCHEMA)).collect()


def test_nearest_is_exact_at_the_bound():
    rnd = np.random.default_rng(1)
    most = int(2.0 ** (30 - (64).bit_length() / 2))
    x = rnd.integers(-most, most + 1, (20, 64))
    books = rnd.integers(-most, most + 1, (16, 8, 4))
    near, far = vector_codes.nearest(x, books)
    for r in range(20):
        for p in range(16):
            each = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[r, p * 4 : p * 4 + 4], c, strict=True)) for c in books[p]]
            assert (near[r, p], far[r, p]) == (each.index(min(each)), min(each))


def test_query_against_plain_and_duckdb(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = queries.op12_vector_codes(spark, SF)
    assert told(got) == plain(rows, Codes())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.oracle_sql()["op12_vector_codes"]).fetchall()
    assert sorted(map(tuple, want)) == sorted(tuple(r) for r in got.collect())
