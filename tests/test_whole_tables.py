"""Queries leave out no row of their tables: against plain loops over those tables."""

from __future__ import annotations

from collections import Counter

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def read(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).column(c).to_pylist() for c in columns), strict=True))


@pytest.fixture(scope="module")
def graph():
    made = [("part" if size % 2 == 0 else "spare", k, f"v{size % 3}", f"root{k % 5}/Dockerfile", size) for k, size in read("part", "p_partkey", "p_size")]
    used = [(k, "" if n % 4 == 0 else f"v{n % 3}", f"root{s % 5}/Dockerfile", n) for k, s, n in read("lineitem", "l_partkey", "l_suppkey", "l_linenumber")]
    return made, used


def image(name, key, version):
    return f"reg.example.com/{name}/{key}" + (f":{version}" if version else "")


def rows(spark, name, *columns):
    return Counter(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect())


def match(p, c):
    return "exact" if p == c else "unknown" if "" in (p, c) else "mismatch"


def test_resolver_sees_every_row(spark, graph):
    made, used = graph
    own = {k: (v, file, line) for name, k, v, file, line in made if name == "part"}
    edges = Counter((image("part", k, own[k][0]), *own[k][1:], image("part", k, v), file, line, match(own[k][0], v)) for k, v, file, line in used if k in own)
    outside = Counter((image("part", k, v), file, line) for k, v, file, line in used if k not in own)
    asked = {k for k, *_ in used}
    unused = Counter((image(name, k, v), file, line) for name, k, v, file, line in made if name == "spare" or k not in asked)
    assert rows(spark, "resolve_edges", "p_ref", "p_file", "p_line", "c_ref", "c_file", "c_line", "version_match") == edges
    assert rows(spark, "resolve_external", "ref", "file", "line") == outside
    assert rows(spark, "resolve_dangling", "ref", "file", "line") == unused
    assert edges.total() + outside.total() == len(used) and outside and unused
    by_match = Counter()
    for e, n in edges.items():
        by_match["resolved", e[-1]] += n
    want = Counter({(b, m, n): 1 for (b, m), n in by_match.items()}) + Counter([("external", "", outside.total()), ("dangling", "", unused.total())])
    assert rows(spark, "bucket_counts", "bucket", "version_match", "n") == want
    assert Counter(tuple(r) for r in entry.entry(spark).collect()) == want
    nodes = {e[0]: "resolved" for e in edges} | {e[3]: "resolved" for e in edges} | {e[0]: "external" for e in outside} | {e[0]: "dangling" for e in unused}
    assert rows(spark, "node_bucket_promotion", "ref", "bucket") == Counter(nodes.items()) == rows(spark, "artifact_distinct", "ref", "bucket")
    assert rows(spark, "mermaid_node_ids", "ref") == Counter([(r,) for r in nodes])
    versions = Counter((own[k][0], v) for k, v, *_ in used if k in own)
    assert rows(spark, "version_match_matrix", "p_version", "c_version", "n") == Counter((*v, n) for v, n in versions.items())
    roots = Counter()
    for (_, p_file, _, _, c_file, _, _), n in edges.items():
        if "root4" not in (p_file[:5], c_file[:5]):
            roots[c_file[:5], p_file[:5]] += n
    assert rows(spark, "repo_edges", "from_label", "to_label", "n") == Counter((*k, n) for k, n in roots.items())


def test_side_inputs_are_whole(spark):
    region = dict(read("nation", "n_nationkey", "n_regionkey"))
    people = {k: (name, region[nation] + 1 if k % 2 == 0 else 0) for k, name, nation in read("customer", "c_custkey", "c_name", "c_nationkey")}
    want = Counter((o, c, *people[c]) for o, c in read("orders", "o_orderkey", "o_custkey") if c in people)
    assert rows(spark, "symbol_db_provenance", "token", "node_id", "source_file", "line") == want
    assert {line for *_, line in want} == {0, *(r + 1 for r in region.values())}
    turns = read("conversations", "conv_id", "turn", "text")
    both = [(source, text, ("docs/" if source and turn % 2 else "") + f"c{conv % 9}", turn) for source in (0, 1) for conv, turn, text in turns]
    first = {}
    for source, *key in sorted(both, key=lambda r: r[0]):
        first.setdefault(tuple(key), source)
    got = entry.queries()["merge_refs_dedup"](spark, SF).collect()
    assert Counter((r.text, r.file, r.line, r.source) for r in got) == Counter((*k, s) for k, s in first.items())
    assert {r.source for r in got} == {0, 1}


def test_every_turn_is_a_script(spark):
    """Rows of one turn with one text count each."""
    turns = spark.createDataFrame([(1, 0, "run a\nrun b"), (1, 0, "run a\nrun b"), (1, 1, None), (2, 0, "sudo x \\\n  y")], "conv_id long, turn long, text string")
    import tempfile

    folder = tempfile.mkdtemp()
    turns.withColumn("role", turns.text).write.parquet(f"{folder}/conversations.parquet")
    got = entry.queries()["script_commands"](spark, folder).collect()
    assert Counter((r.conv_id, r.turn, r.nth, r.line, r.command) for r in got) == Counter([(1, 0, n, k, f"run {c}") for n in (1, 2) for k, c in ((1, "a"), (2, "b"))] + [(2, 0, 1, 1, "x y")])
