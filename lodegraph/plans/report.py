"""Reports of ordered rows: JSON, Mermaid, Markdown, text.

Each report is a `sinks.Report`: rows are rendered by executors, and either written by them or
streamed to the driver in order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions import identity
from lodegraph.plans import resolve
from lodegraph.plans.coverage import Coverage
from lodegraph.plans.extract import Facts
from lodegraph.plans.lineage import cut
from lodegraph.plans.sinks import Report, Rows, json_column, json_items, json_object, json_text, quoted, quoted_column


@dataclass
class Graph:
    """A resolved artifact graph. `title` heads the Markdown report."""

    facts: DataFrame
    edges: DataFrame
    external: DataFrame
    dangling: DataFrame
    failed: DataFrame
    roots: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    title: str = "artifact map"

    @classmethod
    def of(cls, facts: Facts, roots: list[str]) -> Graph:
        f = facts.facts
        return cls(f, cut(resolve.resolved_edges(f)), cut(resolve.external(f)), cut(resolve.dangling(f)), cut(facts.failed), roots, facts.skipped)

    def report(self) -> Report:
        return Report(self.edges.sparkSession)


def artifact_rows(facts: DataFrame) -> Rows:
    """Artifacts (kind, ref, bucket) as items of a JSON array."""
    columns = ("kind", "ref", "bucket")
    item = json_object({c: json_column(F.col(c)) for c in columns}, 4)
    return Rows(resolve.artifacts(facts).withColumn("text", F.concat(F.lit("    "), item)), columns)


def map_json(g: Graph) -> Report:
    """artifacts, edges, and, where there are any, skipped and failed."""
    text = lambda c: json_column(F.col(c))
    artifacts = json_items(artifact_rows(g.facts))
    end = lambda s: {"ref": text(f"{s}_ref"), "provenance": {"file": text(f"{s}_file"), "line": F.col(f"{s}_line").cast("string")}}
    edge = json_object({"kind": text("kind"), "producer": end("p"), "consumer": end("c"), "version_match": text("version_match")}, 4)
    edges = json_items(Rows(g.edges.withColumn("text", F.concat(F.lit("    "), edge)), resolve.EDGE_ORDER))
    more = {}
    if g.skipped:
        more["skipped"] = [{"name": n, "reason": w} for n, w in sorted(g.skipped)]
    if failed := _failed(g):
        more["failed"] = [{"extractor": e, "root": r, "error": w} for e, r, w in failed]
    tail = "".join(f',\n  "{name}": {json_text(value, 2)}' for name, value in more.items())
    out = g.report().add('{\n  "artifacts": [' if artifacts else '{\n  "artifacts": null,', *artifacts)
    between = "  ],\n" if artifacts else ""
    if edges:
        return out.add(between + '  "edges": [', *edges, "  ]" + tail + "\n}")
    return out.add(between + '  "edges": []' + tail + "\n}")


def _failed(g: Graph) -> list[tuple[str, str, str]]:
    return [tuple(r) for r in g.failed.select("extractor", "root", "error").orderBy("extractor", "root").collect()]


def _labelled(kind: Column) -> Column:
    out = kind
    for name, label in schema.KIND_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def mermaid(g: Graph) -> Report:
    """One subgraph a kind, its artifacts by reference, and an arrow from producer to consumer for each edge."""
    kind = F.col("kind")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, schema.KIND_ORDER)), kind), F.lit(0)), F.lit(len(schema.KIND_ORDER) + 1))
    nodes = resolve.nodes(resolve.artifacts(g.facts)).select("kind", "ref", rank.alias("rank"))
    kinds = nodes.select("kind", "rank").distinct()
    place = lambda at: F.lit(at).alias("at")
    heads = kinds.select("rank", "kind", place(0), F.lit("").alias("ref"), F.concat(F.lit("  subgraph "), identity.kind_node_id(kind), F.lit("["), quoted_column(_labelled(kind)), F.lit("]")).alias("text"))
    told = nodes.select("rank", "kind", place(1), "ref", F.concat(F.lit("    "), identity.node_id(kind, F.col("ref")), F.lit("["), quoted_column("ref"), F.lit("]")).alias("text"))
    ends = kinds.select("rank", "kind", place(2), F.lit("").alias("ref"), F.lit("  end").alias("text"))
    arrow = F.concat(F.lit("  "), identity.node_id(kind, F.col("p_ref")), F.lit(" -->|resolved:"), "version_match", F.lit("| "), identity.node_id(kind, F.col("c_ref")))
    return g.report().add("graph LR", Rows(heads.unionByName(told).unionByName(ends), ("rank", "kind", "at", "ref")), Rows(g.edges.withColumn("text", arrow), resolve.EDGE_ORDER))


def mermaid_repos(g: Graph) -> Report:
    """Roots that edges touch, and arrows from consuming to producing root with how many edges; artifacts where there are no roots."""
    if not g.roots:
        return mermaid(g)
    roots = g.edges.sparkSession.createDataFrame([(r,) for r in g.roots], "root string")
    counted = resolve.repo_edges(g.facts, roots).collect()  # at most the number of roots squared
    out = ["graph LR"]
    node = lambda label: "r" + hashlib.sha1(f"repo:{label}".encode()).hexdigest()[:12]
    for label in sorted({x for r in counted for x in (r["from_label"], r["to_label"])}):
        out.append(f"  {node(label)}[{quoted(label)}]")
    for r in sorted(counted, key=lambda r: (r["from_label"], r["to_label"])):
        if r["from_label"] != r["to_label"]:
            n = "1 artifact" if r["n"] == 1 else f"{r['n']} artifacts"
            out.append(f"  {node(r['from_label'])} -->|{quoted(n)}| {node(r['to_label'])}")
    return g.report().add("\n".join(out))


def markdown(g: Graph, group: str = "repo") -> Report:
    """Counts, the diagram, and lists of what is external, dangling, skipped and failed."""
    failed = _failed(g)
    external, dangling = g.external.count(), g.dangling.count()
    out = [f"# {g.title}\n", f"- Resolved edges: {g.edges.count()}", f"- External dependencies: {external}", f"- Dangling producers: {dangling}"]
    out += [f"- Skipped extractors: {len(g.skipped)}"] if g.skipped else []
    out += [f"- Skipped inputs (parse failures): {len(failed)}"] if failed else []
    told = g.report().add("\n".join([*out, "\n## Graph\n", "```mermaid"]), *(mermaid(g) if group == "artifact" else mermaid_repos(g)).sections, "```")
    for title, part, n in (("External dependencies", g.external, external), ("Dangling producers", g.dangling, dangling)):
        if n:
            item = F.concat(F.lit("- `"), "ref", F.lit("` ("), "kind", F.lit(") — "), identity.provenance(F.col("file"), F.col("line")))
            told.add(f"\n## {title}\n", Rows(part.withColumn("text", item), resolve.LEFT_ORDER))
    if g.skipped:
        told.add("\n".join(["\n## Skipped extractors\n", *(f"- `{n}` — {w}" for n, w in sorted(g.skipped))]))
    if failed:
        told.add("\n".join(["\n## Skipped inputs\n", *(f"- `{e}` in `{r}` — {w}" for e, r, w in failed)]))
    return told


def _wide(c: str, n: int) -> Column:
    return F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(F.col(c))


def coverage_text(c: Coverage, verbose: bool = False, title: str = "documentation coverage report") -> Report:
    """Counts and ratios, then uncovered entities by kind and name, stale references in order, and, if verbose, covered entities."""
    s = c.summary().first()
    out = [title, "=" * len(title) + "\n"]
    out += [f"Source: {s['packages']} packages, {s['entities']} exported entities", f"Docs:   {s['doc_files']} files, {s['refs']} code references\n"]
    out += [f"Coverage:  {s['covered']}/{s['entities']} ({s['coverage'] * 100:.1f}%)", f"Staleness: {s['stale']}/{s['refs']} ({s['staleness'] * 100:.1f}%)"]
    told = Report(c.uncovered.sparkSession).add("\n".join(out))
    item = F.concat(F.lit("  "), _wide("kind", 10), F.lit(" "), _wide("name", 30), F.lit(" "), "file")
    listed = lambda df: Rows(df.withColumn("text", item), ("kind", "name", "ord"))
    if s["entities"] > s["covered"]:
        told.add(f"\nUncovered ({s['entities'] - s['covered']}):", listed(c.uncovered))
    if s["stale"]:
        told.add(f"\nStale ({s['stale']}):", _in_order(c.stale, F.concat(F.lit("  `"), "text", F.lit("`  "), "file", F.lit(":"), F.col("line").cast("string"))))
    if verbose and s["covered"]:
        told.add(f"\nCovered ({s['covered']}):", listed(c.covered))
    return told


def _in_order(refs: DataFrame, text: Column) -> Rows:
    return Rows(refs.withColumn("text", text), ("source", "ord") if "source" in refs.columns else ("ord",))


def _number(x: float) -> float | int:
    return int(x) if x == int(x) else x


def coverage_json(c: Coverage) -> Report:
    """Ratios and counts, with uncovered entities and stale references where there are any."""
    s = c.summary().first()
    counts = {"coverage": _number(s["coverage"]), "staleness": _number(s["staleness"]), "total_entities": s["entities"], "covered_count": s["covered"]}
    text = lambda f: json_column(F.col(f))
    plain = lambda f: F.col(f).cast("string")
    lists = []
    if s["entities"] > s["covered"]:
        one = json_object({"Name": text("name"), "Kind": text("kind"), "Package": text("package"), "File": text("file"), "Exported": plain("exported"), "DocComment": text("doc_comment")}, 4)
        lists.append(("uncovered", Rows(c.uncovered.withColumn("text", F.concat(F.lit("    "), one)), ("ord",))))
    if s["stale"]:
        one = json_object({"Text": text("text"), "Kind": text("kind"), "File": text("file"), "Line": plain("line")}, 4)
        lists.append(("stale", _in_order(c.stale, F.concat(F.lit("    "), one))))
    open_ = json_text(counts).removesuffix("\n}")
    told = Report(c.uncovered.sparkSession)
    for name, rows in lists:
        told.add(f'{open_},\n  "{name}": [', *json_items(rows))
        open_ = "  ]"
    return told.add(open_ + "\n}")
