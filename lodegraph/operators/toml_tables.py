"""TOML key-value lines with their tables, and the manifests that use them.

Headers are carried down a file by a running window, and lines inside a multi-line
array, inline table or string are joined to the line they start on.
"""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions.text import stripped
from lodegraph.operators.parsing import earliest, per_file

_STRINGS = r'"(?:[^"\\]|\\.)*"|\'[^\']*\''
_KEY = r"""(?:[A-Za-z0-9_-]+|"[^"]*"|'[^']*')"""
#: Tables of dependencies.
DEPENDENCIES = ("dependencies", "dev-dependencies", "build-dependencies")


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), 0))


def _segments(dotted: Column) -> Column:
    return F.transform(F.regexp_extract_all(dotted, F.lit(_KEY), 0), lambda s: F.regexp_replace(s, "^[\"']|[\"']$", ""))


def key_values(lines: DataFrame) -> DataFrame:
    """(root, file, line, table_line, table, key, value) of `lines` (root, file, line, text); table and key are arrays, value is raw text."""
    bare = stripped(F.regexp_replace("text", rf"^((?:[^\"'#]|{_STRINGS})*+)#.*$", "$1"))
    plain = F.regexp_replace("bare", _STRINGS, '""')
    cleaned = lines.withColumn("bare", bare).withColumn("plain", plain)
    header = F.col("bare").rlike(r"^\[\[?[^\[\]=]+\]\]?$")
    depth = F.when(header, F.lit(0)).otherwise(_count(F.col("plain"), r"[\[{]") - _count(F.col("plain"), r"[\]}]"))
    w = Window.partitionBy("root", "file").orderBy("line")
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    nested = cleaned.withColumn("depth", depth).withColumn("held", F.coalesce(F.sum("depth").over(before), F.lit(0)) > 0)
    started = nested.withColumn("start", F.last(F.when(~F.col("held"), F.col("line")), ignorenulls=True).over(upto))
    is_header = F.col("bare").rlike(r"^\[\[?[^\[\]=]+\]\]?$") & ~F.col("held")
    tabled = started.withColumn("header", F.last(F.when(is_header, F.struct(F.col("line").alias("line"), F.regexp_replace("bare", r"^\[+|\]+$", "").alias("name"))), ignorenulls=True).over(upto)).filter(~is_header)
    # statements are some lines each
    whole = tabled.filter("bare <> ''").groupBy("root", "file", F.col("start").alias("line"), "header").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "bare"))), lambda x: x["bare"]), " ").alias("all"))
    key = F.regexp_extract("all", rf"^({_KEY}(?:\s*\.\s*{_KEY})*)\s*=", 1)
    value = stripped(F.regexp_replace("all", rf"^{_KEY}(?:\s*\.\s*{_KEY})*\s*=", ""))
    table = F.coalesce(_segments(F.col("header.name")), F.array().cast("array<string>"))
    return whole.filter(key != "").select("root", "file", "line", F.coalesce("header.line", F.lit(0)).alias("table_line"), table.alias("table"), _segments(key).alias("key"), value.alias("value"))


def string_value(value: Column) -> Column:
    """A quoted string's content; empty for other values."""
    return F.coalesce(F.regexp_extract(value, r"""^["']([^"']*)["']$""", 1), F.lit(""))


def inline_field(value: Column, name: str) -> Column:
    """The string under `name` in an inline table; empty without."""
    return F.regexp_extract(value, rf"""^\{{(?:.*[,{{\s])?{name}\s*=\s*["']([^"']*)["']""", 1)


_TOKEN = re.compile(r'"""(?:[^\\]|\\.)*?"""|\'\'\'.*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|#[^\n]*|[{}\n]', re.S)


def one_line_tables(content: str) -> str:
    """`content` with inline tables that go over lines put on one, as later versions of TOML allow them."""
    depth = 0

    def each(m: re.Match) -> str:
        nonlocal depth
        depth += (m[0] == "{") - (m[0] == "}")
        return (" " if depth > 0 else m[0]) if m[0] == "\n" or (m[0][0] == "#" and depth > 0) else m[0]

    return re.sub(r",\s*\}", "}", _TOKEN.sub(each, content)) if "{" in content else content


def errors(files: DataFrame) -> DataFrame:
    """(root, file, error) of `files` (root, path, content): an error for those whose form is no TOML's; what is given twice passes."""

    def parse(content: str) -> list[tuple]:
        text = content.replace("\r\n", "\n")
        for form in (text, one_line_tables(text)):
            try:
                tomllib.loads(form)
                return []
            except tomllib.TOMLDecodeError as e:
                # manifests are read expression by expression, so that a key or a table given twice is no matter of form
                if str(e).startswith("Cannot"):
                    return []
                error = e
        raise error

    return per_file(files, parse, "nothing string", "path").select("root", "file", "error")


def cargo_facts(lines: DataFrame) -> DataFrame:
    """Crates: the package name is produced, dependencies of any table path consumed; a rename's package wins over its alias."""
    kv = key_values(lines)
    at = F.expr(f"array_position(transform(table, s -> s in ({', '.join(map(repr, DEPENDENCIES))})), true)")
    placed = kv.withColumn("at", at.cast("int"))
    name = placed.filter(F.expr("table = array('package') and key = array('name')")).select("root", "file", "line", F.lit(schema.PRODUCER).alias("role"), string_value(F.col("value")).alias("ref"))
    direct = placed.filter("at > 0 and at = size(table)")
    package = inline_field(F.col("value"), "package")
    used = direct.select("root", "file", "line", F.lit(schema.CONSUMER).alias("role"), F.when(package != "", package).otherwise(F.col("key")[0]).alias("ref"))
    below = placed.filter("at > 0 and at = size(table) - 1")
    renamed = F.max(F.when(F.expr("key = array('package')"), string_value(F.col("value"))))
    sub = below.groupBy("root", "file", "table_line", "table").agg(F.min("line").alias("line"), renamed.alias("pkg"))
    subs = sub.select("root", "file", "line", F.lit(schema.CONSUMER).alias("role"), F.coalesce(F.nullif("pkg", F.lit("")), F.element_at("table", -1)).alias("ref"))
    every = name.unionByName(used).unionByName(subs)
    return earliest(every.withColumn("kind", F.lit(schema.CRATE)))


def wrangler_facts(lines: DataFrame) -> DataFrame:
    """Services: the top-level name is produced, services bound in tables or inline arrays are consumed."""
    kv = key_values(lines)
    in_services = F.coalesce(F.element_at("table", -1) == "services", F.lit(False))
    safe = kv.withColumn("bound", F.when(F.size("table") > 0, in_services).otherwise(F.lit(False)))
    name = safe.filter(F.expr("size(table) = 0 and key = array('name')")).select("root", "file", "line", F.lit(schema.PRODUCER).alias("role"), string_value(F.col("value")).alias("ref"))
    tables = safe.filter(F.expr("bound and key = array('service')")).select("root", "file", "line", F.lit(schema.CONSUMER).alias("role"), string_value(F.col("value")).alias("ref"))
    inline = F.regexp_extract_all("value", F.lit(r"""\{(?:[^{}]*[,\s{])?service\s*=\s*["']([^"']*)["'][^{}]*\}"""), 1)
    listed = safe.filter(F.expr("not bound and key = array('services') and value like '[%'")).select("root", "file", "line", F.lit(schema.CONSUMER).alias("role"), F.explode(inline).alias("ref"))
    return earliest(name.unionByName(tables).unionByName(listed).withColumn("kind", F.lit(schema.SERVICE)))
