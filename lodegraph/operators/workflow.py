"""CI workflow facts: YAML scalars become rows, scripts become lines, commands become facts.

A small helper reads a file's YAML nodes and resolves its own environment, which is
a few names; words are filled in, and script lines continued and split, in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions.identity import workflow_image
from lodegraph.functions.text import stripped
from lodegraph.operators.parsing import earliest, fact, failures, per_file
from lodegraph.plans.lineage import cut

FILE_PATH = r"^\.github/workflows/[^/]+\.(?i:yml|yaml)$"
#: Shell words that are no programs.
BUILTINS = ("if", "then", "else", "elif", "fi", "for", "while", "do", "done", "case", "esac", "echo", "cd", "export", "set", "true", "false", "mkdir", "cp", "mv", "rm", "ls", "cat", "test", "[", "[[", "exit", "return", "source", ".")
#: Fixed value: how often an expression may lead to another.
DEPTH = 10
_EXPR = r"\$\{\{\s*([^}]*?)\s*\}\}"
SCALARS = "line int, what string, name string, value string"


class Expressions:
    """Literals of expressions: env.NAME of a workflow's own env, and the repository owner."""

    def __init__(self, env: dict[str, str], owner: str | None):
        self.env, self.owner, self.known = env, owner, {}

    def literal(self, name: str, depth: int = 0) -> str | None:
        """What the expression `name` stands for; None where that isn't known, or more than DEPTH steps away."""
        if name == "github.repository_owner":
            return self.owner or None
        value = self.env.get(name.removeprefix("env.")) if name.startswith("env.") else None
        if value is None or "${{" not in value:
            return value
        if (name, depth) not in self.known:
            self.known[name, depth] = self.filled(value, depth + 1) if depth < DEPTH else None
        return self.known[name, depth]

    def filled(self, text: str, depth: int = 0) -> str | None:
        """`text` with its expressions filled in; None where one can't be."""
        found = {m[1]: self.literal(m[1], depth) for m in re.finditer(_EXPR, text)}
        if None in found.values():
            return None
        out = re.sub(_EXPR, lambda m: found[m[1]], text)
        return None if "${{" in out else out


def _scalars(content: str, owner: str | None) -> list[tuple[int, str, str, str]]:
    """(line, what, name, value): what is literal (an expression's name and value), env or run. Values of env are filled in."""
    import yaml

    top = yaml.compose(content, Loader=yaml.SafeLoader)
    if not isinstance(top, yaml.MappingNode):
        return []
    pairs = lambda node: [(k.value, v) for k, v in node.value if isinstance(v, yaml.ScalarNode)] if isinstance(node, yaml.MappingNode) else []
    own = next((value for key, value in top.value if key.value == "env"), None)
    known = Expressions({k: v.value for k, v in pairs(own)}, owner)
    names = ["github.repository_owner", *(f"env.{k}" for k in known.env)]
    out = [(0, "literal", n, v) for n in names if (v := known.literal(n)) is not None]
    stack, seen = [top], set()
    while stack:
        node = stack.pop()
        if id(node) in seen:
            continue
        seen.add(id(node))
        if isinstance(node, yaml.SequenceNode):
            stack += node.value
        if not isinstance(node, yaml.MappingNode):
            continue
        for key, value in node.value:
            if key.value == "env":
                out += [(v.start_mark.line + 1, "env", k, text) for k, v in pairs(value) if (text := known.filled(v.value)) is not None]
            if key.value == "run" and isinstance(value, yaml.ScalarNode):
                out.append((value.start_mark.line + 1, "run", "", value.value))
            stack.append(value)
    return out


def scalars(files: DataFrame, owner: str | None = None) -> DataFrame:
    """(root, file, SCALARS, error) of workflow files (root, rel, content); a file that is no YAML gives one row with an error."""
    return per_file(files, lambda content: _scalars(content, owner), SCALARS)


def filled(word: Column, literals: Column) -> Column:
    """`word` with expressions replaced by `literals`, a map by name; null where one isn't in it."""
    names = F.array_distinct(F.regexp_extract_all(word, F.lit(_EXPR), 1))

    def one(done: Column, name: Column) -> Column:
        value = F.regexp_replace(F.element_at(literals, name), r"([\\$])", r"\\$1")
        return F.regexp_replace(done, F.concat(F.lit(r"\$\{\{\s*\Q"), name, F.lit(r"\E\s*\}\}")), value)

    return F.nullif(F.when(F.contains(word, F.lit("${{")), F.regexp_replace(F.aggregate(names, word, one), r"(?s)^.*\$\{\{.*$", "")).otherwise(word), F.lit(""))


def commands(runs: DataFrame) -> DataFrame:
    """(root, file, line, fields): commands of scripts (root, file, line, value), continued lines joined, without comments, sudo and assignments."""
    each = runs.withColumn("script", F.xxhash64("line", "value"))
    split = each.select("root", "file", "script", F.col("line").alias("base"), F.posexplode(F.split("value", "\n")).alias("at", "text")).distinct()
    w = Window.partitionBy("root", "file", "script", "base").orderBy("at")
    more = F.col("text").rlike(r"\\[ \t]*$")
    begun = split.withColumn("own", F.when(F.coalesce(F.lag(more).over(w), F.lit(False)), F.lit(None)).otherwise(F.col("at")))
    begun = begun.withColumn("start", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.struct("at", F.regexp_replace("text", r"\\[ \t]*$", " ").alias("t"))
    whole = begun.groupBy("root", "file", "script", "base", "start").agg(stripped(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "")).alias("all"))
    assignment = r"""(?:sudo|[^\s=/.:$]+=[^\s$(`"']*)(?:\s+|$)"""
    bare = F.regexp_replace("all", f"^(?:{assignment})+", "")
    told = whole.filter("all <> '' and not all like '#%'").select("root", "file", (F.col("base") + F.col("start")).cast("int").alias("line"), F.split(bare, r"\s+").alias("fields"))
    return told.filter("fields[0] <> ''")


def _image_words(fields: Column) -> Column:
    """Words after `docker verb` that may name an image: those after -t and --tag, and those that are no flags."""
    after = F.slice(fields, F.lit(3), F.greatest(F.lit(0), F.size(fields) - 2))
    return F.filter(after, lambda x: ~x.startswith("-"))


def facts(files: DataFrame, owner: str | None = None) -> DataFrame:
    """Facts of workflow files (root, rel, content), one for each identity and file, the earliest; `file` is the path below the root.

    Image references in env values and in docker build and push are produced, in docker pull and run
    consumed; other commands consume their program. Lines of docker without a recognisable image
    consume docker. Files that are no YAML give failures.
    """
    rows = cut(scalars(files, owner))
    literals = rows.filter("what = 'literal'").groupBy("root", "file").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", "value")))).alias("literals"))
    produced = rows.filter("what = 'env'").withColumn("ref", workflow_image(F.col("value"))).filter("ref is not null").select(*fact(schema.PRODUCER, schema.IMAGE, "ref"))
    told = cut(commands(rows.filter("what = 'run'").select("root", "file", "line", "value")).withColumn("cmd", F.xxhash64("root", "file", "line", "fields")))
    docker = told.filter("fields[0] = 'docker' and size(fields) > 1 and fields[1] in ('build', 'push', 'pull', 'run')")
    words = docker.select("root", "file", "line", "cmd", F.col("fields")[1].alias("verb"), F.posexplode(_image_words(F.col("fields"))).alias("pos", "word")).join(literals, ["root", "file"], "left")
    known = F.coalesce("literals", F.create_map().cast("map<string,string>"))
    images = words.withColumn("word", filled(F.col("word"), known)).withColumn("ref", workflow_image(F.col("word"))).filter("ref is not null")
    first = images.groupBy("root", "file", "line", "cmd", "verb").agg(F.min_by("ref", "pos").alias("ref"))
    made = first.select(*fact(F.when(F.col("verb").isin("build", "push"), F.lit(schema.PRODUCER)).otherwise(F.lit(schema.CONSUMER)), schema.IMAGE, "ref"))
    head = F.col("fields")[0]
    name = F.element_at(F.split(head, "/"), -1)
    others = told.join(first.select("cmd").distinct(), "cmd", "left_anti").filter(~head.rlike(r"""[|&;<>()$`"']""") & (name != "") & ~name.isin(*BUILTINS))
    programs = others.select(*fact(schema.CONSUMER, schema.BINARY, name))
    return earliest(produced.unionByName(made).unionByName(programs)).unionByName(failures(rows, "ci"))
