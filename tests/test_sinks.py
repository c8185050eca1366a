"""Reports that executors render and write, against plain Python over collected rows."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import DataFrame

from lodegraph import schema
from lodegraph.plans import coverage, report, resolve
from lodegraph.plans.extract import Facts
from lodegraph.plans.sinks import Report, Rows, json_items, json_text, quoted

ODD = ['plain', 'a "quoted" \\ one', "tab\tnew\nline\r\a\b\f\v", "<&>   ", "\x01\x1f\x7f", "ünï 😀 ​ ﻿", "", " padded "]


@pytest.fixture(scope="module")
def graph(spark):
    rows = []
    for k, odd in enumerate(ODD):
        rows.append(("producer", "gomod", "r", "go_module", f"m{odd}x", f"a/{odd}", k))
        rows.append(("consumer", "gomod", "r", "go_module" if k % 2 else "extra kind", f"m{odd}x", f"b/{odd}", k + 1))
    rows += [("consumer", "t", "r", "service", "s", "b/s", 3)] * 3 + [("producer", "t", "r", "service", "s", "a/s", 0)] * 2
    facts = spark.createDataFrame(rows, schema.FACTS).repartition(7)
    failed = spark.createDataFrame([("ci", "r", "it's <broken>")], "extractor string, root string, error string")
    return report.Graph.of(Facts(facts, [("gocode", "no & backend")], failed), ["a", "b"])


def edges(g):
    return [r.asDict() for r in g.edges.orderBy(*resolve.EDGE_ORDER).collect()]


def written(told: Report, path) -> str:
    told.write(str(path))
    return "".join(f.read_bytes().decode() for section in sorted(Path(path).iterdir()) for f in sorted(section.glob("part-*")))


def plain_json(g):
    end = lambda r, s: {"ref": r[f"{s}_ref"], "provenance": {"file": r[f"{s}_file"], "line": r[f"{s}_line"]}}
    found = sorted(tuple(r) for r in resolve.artifacts(g.facts).select("kind", "ref", "bucket").collect())
    out = {
        "artifacts": [dict(zip(("kind", "ref", "bucket"), r, strict=True)) for r in found] or None,
        "edges": [{"kind": r["kind"], "producer": end(r, "p"), "consumer": end(r, "c"), "version_match": r["version_match"]} for r in edges(g)],
    }
    if g.skipped:
        out["skipped"] = [{"name": n, "reason": w} for n, w in g.skipped]
    if failed := [tuple(r) for r in g.failed.collect()]:
        out["failed"] = [{"extractor": e, "root": r, "error": w} for e, r, w in failed]
    return json_text(out) + "\n"


def test_map_json(graph, tmp_path, monkeypatch):
    want = plain_json(graph)
    told = report.map_json(graph)
    assert told.text() == want and json.loads(want)["edges"]
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    monkeypatch.setattr(DataFrame, "collect", None)
    # neither rows nor lines come to the driver
    assert written(told, tmp_path / "json") == want


def test_mermaid_and_markdown(graph, tmp_path):
    node = lambda kind, ref: "n" + hashlib.sha1(f"{kind}\0{ref}".encode()).hexdigest()[:12]
    out, refs = ["graph LR"], {(r.kind, r.ref) for r in resolve.artifacts(graph.facts).collect()}
    for kind in ("go_module", "extra kind", "service"):
        label = schema.KIND_LABELS.get(kind, kind)
        out.append(f"  subgraph k{hashlib.sha1(f'kind:{kind}'.encode()).hexdigest()[:8]}[{quoted(label)}]")
        out += [f"    {node(kind, ref)}[{quoted(ref)}]" for k, ref in sorted(refs) if k == kind] + ["  end"]
    out += [f"  {node(r['kind'], r['p_ref'])} -->|resolved:{r['version_match']}| {node(r['kind'], r['c_ref'])}" for r in edges(graph)]
    want = "\n".join(out) + "\n"
    assert report.mermaid(graph).text() == want
    assert written(report.mermaid(graph), tmp_path / "mermaid") == want
    told = report.markdown(graph, "artifact")
    body = told.text()
    left = [tuple(r) for r in graph.dangling.select(*resolve.LEFT_ORDER).orderBy(*resolve.LEFT_ORDER).collect()]
    listed = "".join(f"- `{ref}` ({kind}) — {file}{f':{line}' if line > 0 else ''}\n" for kind, ref, file, line in left)
    assert want in body and f"\n## Dangling producers\n\n{listed}\n## Skipped extractors\n\n- `gocode` — no & backend\n\n## Skipped inputs\n\n- `ci` in `r` — it's <broken>\n" in body
    assert body.startswith(f"# artifact map\n\n- Resolved edges: {graph.edges.count()}\n") and "\n\n## Graph\n\n```mermaid\ngraph LR\n" in body
    assert written(told, tmp_path / "md") == body


def test_last_items_that_are_alike(spark):
    df = spark.createDataFrame([(k, str(k)) for k in [1, 2, 2, 3, 3, 3]], "k int, text string").repartition(3)
    assert Report(spark, json_items(Rows(df, ("k",)))).text() == "1,\n2,\n2,\n3,\n3,\n3\n"
    assert json_items(Rows(df.limit(0), ("k",))) == []
    assert Report(spark, json_items(Rows(spark.createDataFrame([(None, "n")], "k int, text string"), ("k",)))).text() == "n\n"


def test_empty_graph(spark):
    g = report.Graph.of(Facts(spark.createDataFrame([], schema.FACTS), [], spark.createDataFrame([], "extractor string, root string, error string")), [])
    assert report.map_json(g).text() == plain_json(g) == '{\n  "artifacts": null,\n  "edges": []\n}\n'
    assert report.mermaid(g).text() == "graph LR\n"


def test_coverage_reports(spark, tmp_path):
    entities = spark.createDataFrame([(k, f"Name{odd}{k}", "function", "p", f"f{odd}", True, odd) for k, odd in enumerate(ODD)], schema.ENTITIES)
    refs = spark.createDataFrame([(k, f"Other{odd}", "code_span", f"d{odd}", k) for k, odd in enumerate(ODD)] + [(99, "Nameplain0", "code_span", "d", 1)], schema.DOC_REFS)
    c = coverage.compute(entities, refs, 0)
    s = c.summary().first()
    want = {"coverage": s["coverage"], "staleness": s["staleness"], "total_entities": len(ODD), "covered_count": 1}
    want["uncovered"] = [{"Name": r.name, "Kind": r.kind, "Package": r.package, "File": r.file, "Exported": r.exported, "DocComment": r.doc_comment} for r in c.uncovered.orderBy("ord").collect()]
    want["stale"] = [{"Text": r.text, "Kind": r.kind, "File": r.file, "Line": r.line} for r in c.stale.orderBy("ord").collect()]
    assert report.coverage_json(c).text() == json_text(want) + "\n"
    told = report.coverage_text(c, verbose=True)
    body = told.text()
    uncovered = sorted(((r.kind, r.name, r.ord, r.file) for r in c.uncovered.collect()))
    assert f"\nUncovered ({len(uncovered)}):\n" + "".join(f"  {kind:<10} {name:<30} {file}\n" for kind, name, _, file in uncovered) in body
    assert f"\nStale ({len(ODD)}):\n" + "".join(f"  `Other{odd}`  d{odd}:{k}\n" for k, odd in enumerate(ODD)) in body
    assert "\nCovered (1):\n" + f"  {'function':<10} {'Nameplain0':<30} fplain\n" in body
    assert written(told, tmp_path / "text") == body
