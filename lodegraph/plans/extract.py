"""The extractors by name, and their facts over scanned roots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.operators import capnp, dockerfile, gomod, gosource, html, markdown, symbol_db, toml_tables, workflow
from lodegraph.operators.parsing import FAILED, failures
from lodegraph.plans.lineage import cut
from lodegraph.sources.files import kept_by, lines

#: Files to facts: role, root, kind, ref, file, line. A file that can't be read gives a row of role FAILED with its error in ref.
Extractor = Callable[[DataFrame], DataFrame]
#: Extractors whose facts name files by their path below the root.
RELATIVE = ("dockerfile", "ci", "gocode")


def _gomod(files: DataFrame) -> DataFrame:
    return gomod.facts(lines(kept_by(files, "gomod").filter("name = 'go.mod'")))


def _cargo(files: DataFrame) -> DataFrame:
    own = kept_by(files, "cargo").filter("name = 'Cargo.toml'")
    return toml_tables.cargo_facts(lines(own)).unionByName(failures(toml_tables.errors(own), "cargo"))


def _wrangler(files: DataFrame) -> DataFrame:
    own = kept_by(files, "wrangler").filter("name = 'wrangler.toml'")
    return toml_tables.wrangler_facts(lines(own)).unionByName(failures(toml_tables.errors(own), "wrangler"))


def _capnp(files: DataFrame) -> DataFrame:
    return capnp.facts(lines(kept_by(files, "capnp").filter("name like '%.capnp'")))


def _dockerfile(files: DataFrame) -> DataFrame:
    return dockerfile.facts(kept_by(files, "dockerfile").filter(F.col("name").rlike(dockerfile.FILE_NAME)))


def _workflow_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("rel").rlike(workflow.FILE_PATH))


@dataclass
class Facts:
    """facts (schema.FACTS), skipped (name, reason) and failed (extractor, root, error)."""

    facts: DataFrame
    skipped: list[tuple[str, str]]
    failed: DataFrame


def isolated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and failures among `rows` (schema.FACTS, with failed ones): an extractor that fails on a root gives it no facts, and its first error is kept.

    Facts of a kind that there isn't are left out, and the first of each extractor and root is listed as a failure, if nothing else failed.
    """
    named = F.concat(F.lit("unknown kind "), F.col("kind"), F.lit(" of "), F.col("ref"))
    unknown = rows.filter((F.col("role") != FAILED) & ~F.col("kind").isin(*schema.KINDS)).groupBy("extractor", "root").agg(F.min_by(named, F.struct("file", "line", "ref")).alias("error"))
    rows = rows.filter((F.col("role") == FAILED) | F.col("kind").isin(*schema.KINDS))
    failed = rows.filter(F.col("role") == FAILED).groupBy("extractor", "root").agg(F.min_by("ref", F.struct("file", "ref")).alias("error"))
    # a row at most for each extractor and root
    kept = rows.filter(F.col("role") != FAILED).join(F.broadcast(failed.select("extractor", "root")), ["extractor", "root"], "left_anti")
    listed = failed.unionByName(unknown.join(failed, ["extractor", "root"], "left_anti"))
    return kept.select("role", "extractor", "root", "kind", "ref", "file", "line"), listed


@dataclass
class Registry:
    """Extractors in order.

    `unavailable` names those to skip with the reason; `owner` fills in a workflow's repository owner;
    `symbol_db` is a symbol database that symbols are taken from instead of Go sources, and if it is
    configured but missing, gocode is skipped. With `root_qualified` every fact's file begins with
    its root, so that all of them count in diagrams by root, and a root `.` gives symbols too.
    """

    owner: str | None = None
    unavailable: dict[str, str] = field(default_factory=dict)
    extra: dict[str, Extractor] = field(default_factory=dict)
    symbol_db: str | None = None
    root_qualified: bool = False

    def extractors(self) -> dict[str, Extractor]:
        own: dict[str, Extractor] = {
            "gomod": _gomod,
            "dockerfile": _dockerfile,
            "ci": lambda files: workflow.facts(_workflow_files(files), self.owner),
            "gocode": self._gocode,
            "cargo": _cargo,
            "wrangler": _wrangler,
            "capnp": _capnp,
        }
        return own | self.extra

    def backend(self) -> str:
        """What gocode reads: symbol-db or source."""
        return "source" if self.symbol_db is None else "symbol-db"

    def _gocode(self, files: DataFrame) -> DataFrame:
        if self.symbol_db is None:
            return gosource.facts(kept_by(files, "gocode"), of_dot=self.root_qualified)
        found = symbol_db.read(files.sparkSession, self.symbol_db)
        one = symbol_db.facts(found["defs"], found["refs"], found["nodes"], found["ast"], "").drop("root", "extractor")
        # the database counts for each root
        roots = files.select("root").distinct()
        return one.join(F.broadcast(roots), F.lit(True)).select("role", "root", "kind", "ref", "file", "line")

    def skipped(self, files: DataFrame) -> dict[str, str]:
        out = dict(self.unavailable)
        if self.symbol_db is not None and (why := symbol_db.missing(files.sparkSession, self.symbol_db)):
            out["gocode"] = why
        return out

    def _named(self, name: str, rows: DataFrame) -> DataFrame:
        file = F.col("file")
        if self.root_qualified:
            base = F.regexp_replace("root", "/+$", "")
            file = F.concat(base, F.lit("/"), file) if name in RELATIVE and self.backend() == "source" else F.when(F.col("root") == ".", F.concat(F.lit("./"), file)).otherwise(file)
        return rows.select("role", F.lit(name).alias("extractor"), "root", "kind", "ref", file.alias("file"), F.col("line").cast("int").alias("line"))

    def create_views(self, files: DataFrame) -> list[str]:
        """Makes each available extractor's facts over `files` a temporary view for SQL, `facts_` and its name (`-` as `_`); returns the names."""
        skipped, names = self.skipped(files), []
        for name, extract in self.extractors().items():
            if name not in skipped:
                kept, _ = isolated(self._named(name, extract(files)))
                names.append(f"facts_{name.replace('-', '_')}")
                kept.createOrReplaceTempView(names[-1])
        return names

    def gather(self, files: DataFrame) -> Facts:
        """All extractors' facts over all roots. A root that an extractor fails on gives it no facts, and its first error is kept.

        Facts are written once, as every report reads them several times.
        """
        skipped, files, out = self.skipped(files), cut(files), None
        for name, extract in self.extractors().items():
            if name not in skipped:
                one = self._named(name, extract(files))
                out = one if out is None else out.unionByName(one)
        if out is None:
            out = files.sparkSession.createDataFrame([], schema.FACTS)
        facts, failed = isolated(cut(out))
        return Facts(facts, sorted(skipped.items()), failed)


def entities(files: DataFrame, exported_only: bool = True) -> DataFrame:
    """schema.ENTITIES of the files' Go code; ord follows file, kind of declaration, line."""
    go = kept_by(files, "gocode").filter("name like '%.go' and not name like '%\\\\_test.go'")
    found = gosource.entities(cut(gosource.code_lines(go)), exported_only)
    rank = F.array_position(F.array(*map(F.lit, gosource.KINDS)), F.col("kind"))
    return _ordered(found.withColumn("rank", rank), ["root", "file", "rank", "line", "pos"]).select("ord", "name", "kind", "package", "file", "exported", "doc_comment")


def doc_refs(files: DataFrame, html_pages: bool = False) -> DataFrame:
    """schema.DOC_REFS of the files' Markdown, or HTML; ord follows file and place."""
    kept = kept_by(files, "docs")
    if html_pages:
        found, order = html.refs(kept.filter(F.col("name").rlike(html.FILE_NAME))), ["root", "file", "pos"]
    else:
        found, order = markdown.refs(kept.filter(F.col("name").rlike(markdown.FILE_NAME))), ["root", "file", "line", "pos"]
    return _ordered(found, order).select("ord", "text", "kind", "file", F.col("line").cast("int").alias("line"))


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ord: the row's place in `order`, from 1.

    Rows are dealt out by ranges of the order and written; a range's rows are counted, ranges, which are few, are
    summed up, and rows are numbered within their range. No task has all rows.
    """
    at = F.spark_partition_id().alias("part")
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return within.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("ord", (F.col("before") + F.col("at")).cast("long"))
