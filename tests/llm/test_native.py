"""Chat formatting and quality rules, held against plain Python and DuckDB."""

from __future__ import annotations

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import chat, quality_rules
from lodegraph.llm.quality_rules import QualityRules, apply_rules, binomial_tail, statistics

TURNS = "conv_id long, turn long, role string, text string"


def _rows(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()), key=str)


def _duck(sql, columns, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return sorted((tuple(str(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=str)


def test_snapshots_collapse(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", None), ("assistant", "d")]
    rows = [(c, t, r, x) for c, n in ((1, 2), (2, 4), (3, 3), (4, 4)) for t, (r, x) in enumerate(talk[:n])]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "other"), (6, 0, "user", ""), (7, 0, "user", None), (None, 3, None, "x"), (8, 1, "user", "q"), (8, 1, "user", "q")]
    df = spark.createDataFrame(rows, TURNS).withColumn("copies", F.lit(1)).withColumn("p1", F.lit("clash"))
    got = chat.format_chats(spark, df)
    kept = {(r.conv_id, r.n_turns, r.copies) for r in got.collect()}
    assert kept == {(2, 4, 2), (5, 2, 1), (6, 1, 1), (7, 1, 1), (None, 1, 1), (8, 2, 1)}
    parts = [r for r in got.orderBy("conv_id", "turn_no").collect() if r.conv_id == 2]
    whole = "".join(p.segment for p in parts)
    assert whole.startswith("<|user|>\na<|end|>\n") and all(whole[p.start :].startswith(p.segment) for p in parts)
    assert _rows(got, chat_columns) == _duck(chat.ORACLE, chat_columns, conversations=df)


chat_columns = ["conv_id", "turn_no", "role", "segment", "start", "n_turns", "copies"]


@pytest.mark.parametrize("parts", [1, 7])
def test_long_conversations_in_parts(spark, parts):
    """A conversation of half of all turns, one of rows without conv_id, prefixes of both, ties and very long texts."""
    rng = random.Random(3)
    long = [(1, t // 2, rng.choice(["user", "assistant"]), f"turn {t} " * rng.randrange(1, 40)) for t in range(120)]
    rows = long + [(2, t, r, x) for _, t, r, x in sorted(long, key=lambda r: r[1:])[:50]] + [(None, t, "user", f"n{t}") for t in range(60)]
    rows += [(3, t, "user", f"n{t}") for t in range(60)] + [(4, t, "user", f"n{t}") for t in range(20)] + [(5, 0, "user", "x" * 200_000), (6, 0, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    got = chat.format_chats(spark, df, parts)
    assert _rows(got, chat_columns) == _duck(chat.ORACLE, chat_columns, conversations=df)
    assert {r.conv_id for r in got.select("conv_id").distinct().collect()} == {1, 3, 5, 6}


def test_no_conversations(spark):
    assert chat.format_chats(spark, spark.createDataFrame([], TURNS)).count() == 0


def test_native_plans(spark, make_docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    turns = spark.createDataFrame([(1, 0, "user", "a")], TURNS)
    for df in (apply_rules(spark, make_docs(["a b"]), labels), chat.format_chats(spark, turns)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    # what is written in between has no Python either
    dealt = chat.dealt_turns(turns)
    numbered = chat.numbered_turns(dealt)
    for df in (statistics(make_docs(["a b"])), dealt, numbered, chat.prefix_hashes(numbered)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def _texts():
    rng = random.Random(2)
    some = [" ".join(rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 90))) for _ in range(20)]
    loop = " ".join(f"w{k}" for k in range(11))
    return [*some, None, "", " \n\t ", "x\nx\n \nx\r\ny", f"{loop} {loop} end {loop}", "a # b | c d", "é " * 30, " ".join("same" for _ in range(9)), f" {loop}\v{loop}\f", "A\\x20b [\\d]"]


def test_statistics(spark, make_docs):
    texts = _texts()
    got = {r.doc_id: r for r in statistics(make_docs(texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), repr(t)


@pytest.mark.parametrize(("n", "x", "p"), [(10, 0, 0.3), (200, 3, 0.05), (5000, 60, 0.02), (50, 50, 0.1)])
def test_binomial_tail(spark, n, x, p):
    got = spark.sql(f"select {n}L n, {x}L x").select(F.expr(binomial_tail("n", "x", p))).first()[0]
    want = 1.0 if x >= n * p else sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_cutoffs_need_evidence_and_hold(spark, make_docs):
    clean = " ".join(f"word{k}" for k in range(30))
    noisy = " ".join(f"w{k}###" for k in range(30))
    docs = make_docs([clean] * 40 + [noisy] * 5, extra=True)
    labels = spark.createDataFrame([(k, 1 if k < 40 else 0) for k in range(45)], "doc_id long, quality int")
    strict, loose = QualityRules(risk=0.02), QualityRules(risk=0.9)
    assert all(r.kept for r in apply_rules(spark, docs, labels, strict).collect())
    assert [r.kept for r in apply_rules(spark, docs, labels, loose).orderBy("doc_id").collect()] == [True] * 40 + [False] * 5
    assert all(r.kept for r in apply_rules(spark, docs, labels.limit(0), loose).collect())


def test_steps_are_tested_in_order(spark, make_docs):
    """Counts by hand: 200 good documents, 3 of which the second step rejects and 30 the third."""
    share = lambda k: " ".join([f"w{i}#" for i in range(k)] + [f"word{i}" for i in range(30 - k)])
    docs = make_docs([share(0)] * 167 + [share(12)] * 3 + [share(6)] * 30 + [share(29)])
    labels = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int")
    rules = QualityRules(cutoffs={"symbol_share": (0.2, 0.08, 0.03), "upper_share": (0.5,)})
    table = quality_rules._shares(statistics(docs), rules)
    assert rules.ladder() == [{"symbol_share": c, "upper_share": 0.5} for c in (0.2, 0.08, 0.03)]
    tail = lambda x: sum(math.comb(200, k) * 0.03**k * 0.97 ** (200 - k) for k in range(x + 1))
    counts = [sum(n for n, s in ((167, 0), (3, 12), (30, 6)) if s / (s * 3 + sum(len(f"word{i}") for i in range(30 - s)) or 1) > c) for c in (0.2, 0.08, 0.03)]
    want = next((k for k, x in enumerate(counts) if tail(x) > 0.05), 3)
    assert [(r.stratum, r.step) for r in quality_rules.certified_steps(table, labels, rules).collect()] == [("en", want)]


def test_default_rules_bite_on_the_corpus(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    rows = apply_rules(spark, read("documents"), read("labels")).collect()
    quality = {r.doc_id: r.quality for r in read("labels").collect()}
    lost = [r for r in rows if not r.kept and not r.base_failed]
    good = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert len(lost) > 20 and sum(not r.kept for r in good) <= QualityRules().risk * len(good)


def test_tied_turns_stand_in_the_order_of_their_text(spark):
    df = spark.createDataFrame([(1, 0, "user", t) for t in "badc"] + [(1, 0, "user", None), (1, None, "user", "z")], TURNS)
    got = chat.format_chats(spark, df)
    assert [r.segment.split("\n")[1] for r in got.orderBy("turn_no").collect()] == ["z<|end|>", "<|end|>", "a<|end|>", "b<|end|>", "c<|end|>", "d<|end|>"]
    assert _rows(got, chat_columns) == _duck(chat.ORACLE, chat_columns, conversations=df)


def test_rules_against_duckdb(spark, make_docs):
    rows = [(k % 30, t) for k, t in enumerate(_texts() * 3)] + [(None, "a b")]
    docs = make_docs(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    labels = spark.createDataFrame([(k, k % 3 and 1) for k in range(25)] + [(None, 1), (3, None)], "doc_id long, quality int")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rules = QualityRules(risk=0.8)
    assert _rows(apply_rules(spark, docs, labels, rules), columns) == _duck(quality_rules.oracle(rules), columns, documents=docs, labels=labels)
    assert apply_rules(spark, make_docs([]), labels).count() == 0
