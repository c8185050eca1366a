"""go.mod facts, from lines: block statements are carried down each file by a running window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions.identity import module_refs
from lodegraph.functions.text import stripped
from lodegraph.operators.parsing import failures

_WORD = r'(?:"[^"]*"|`[^`]*`|[^\s"`()]+)'
#: The statements that there are.
STATEMENTS = ("module", "go", "toolchain", "godebug", "require", "exclude", "replace", "retract", "tool", "ignore")


_NUMBER = r"(?:0|[1-9]\d*)"
_PRE = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
#: Versions: v1, v1.2, and v1.2.3 with what may follow.
VERSION = rf"^v{_NUMBER}(?:\.{_NUMBER}(?:\.{_NUMBER}(?:-{_PRE}(?:\.{_PRE})*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)?)?$"
GO_VERSION = rf"^[1-9]\d*\.{_NUMBER}(?:\.{_NUMBER})?(?:[a-z]+\d+)?$"
_GOPKG = r"^gopkg\.in/"


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, '^["`]|["`]$', "")


def major_of(path: Column) -> Column:
    """The major version that a module path ends in, with the sign before it, as /v2 or .v2; empty without, null where the ending is none."""
    bad = path.rlike(r"/v[0-9.]+$") & ~path.rlike(r"/v(?:[2-9]|[1-9]\d+)$")
    plain = F.when(~bad, F.regexp_extract(path, r"(/v\d+)$", 1))
    gopkg = F.regexp_replace(F.regexp_extract(path, r"(\.v(?:0|[1-9]\d*)(?:-unstable)?)$", 1), "-unstable$", "")
    return F.when(path.rlike(_GOPKG), F.nullif(gopkg, F.lit(""))).otherwise(plain)


def version_fault(path: Column, version: Column) -> Column:
    """What is wrong with a required module's path or version; null where nothing is."""
    major = F.regexp_extract(version, r"^(v\d+)", 1)
    own = major_of(path)
    unmarked = F.when((own == "") & ~major.isin("v0", "v1") & ~version.endswith("+incompatible"), F.concat(F.lit("should be v0 or v1, not "), major))
    marked = F.when((own != "") & (major != F.substring(own, 2, 20)) & ~((own == ".v1") & version.startswith("v0.0.0-")), F.concat(F.lit("should be "), F.substring(own, 2, 20), F.lit(", not "), major))
    form = F.when(~version.rlike(VERSION), F.concat(version, F.lit(": must be of the form v1.2.3")))
    return F.coalesce(F.when(own.isNull(), F.concat(path, F.lit(": invalid module path"))), form, F.concat(path, F.lit("@"), version, F.lit(": invalid version: "), F.coalesce(unmarked, marked)))


def replacement_fault(rest: Column) -> Column:
    """What is wrong with `old [version] => new [version]`; null where nothing is."""
    part = lambda k: _unquoted(F.regexp_extract(rest, rf"^({_WORD})(?:\s+({_WORD}))?\s+=>\s+({_WORD})(?:\s+({_WORD}))?$", k))
    old, version, new, to = (part(k) for k in (1, 2, 3, 4))
    folder = new.rlike(r"^(?:\.{1,2}(?:[/\\\\]|$)|/|[A-Za-z]:)")
    return F.coalesce(
        F.when(major_of(old).isNull(), F.concat(old, F.lit(": invalid module path"))),
        F.when(version != "", version_fault(old, version)),
        F.when((to == "") & ~folder, F.lit("replacement module without version must be directory path")),
        F.when((to != "") & folder, F.lit("replacement module directory path cannot have version")),
        F.when((to != "") & ~to.rlike(VERSION), F.concat(to, F.lit(": must be of the form v1.2.3"))),
    )


def statements(lines: DataFrame) -> DataFrame:
    """`lines` (root, file, line, text) with code, comment, block (the statement whose block a line stands in), verb and rest."""
    code = stripped(F.regexp_replace("text", "//.*$", ""))
    comment = stripped(F.regexp_replace(F.regexp_extract("text", "(//.*)$", 1), "^/+", ""))
    marked = lines.withColumn("code", code).withColumn("comment", comment)
    opens, closes = F.regexp_extract("code", r"^(\w+)\s*\($", 1), F.col("code") == ")"
    w = Window.partitionBy("root", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    block = F.last(F.when(opens != "", opens).when(closes, F.lit("")), ignorenulls=True).over(w)
    stated = marked.withColumn("block", F.coalesce(block, F.lit("")))
    verb = F.when(F.col("block") != "", F.col("block")).otherwise(F.regexp_extract("code", r"^(\w+)(?:\s|$)", 1))
    rest = F.when(F.col("block") != "", F.col("code")).otherwise(stripped(F.regexp_replace("code", r"^\w+", "")))
    return stated.withColumn("verb", verb).withColumn("rest", rest)


def errors(said: DataFrame) -> DataFrame:
    """(root, file, error): the first line of each file that can't be read: an unknown statement, one without what it needs or with a version that is none or not of its path's major, a second module or go statement, or a block that stays open."""
    code, rest = F.col("code"), F.col("rest")
    word = lambda k: _unquoted(F.regexp_extract("rest", rf"^({_WORD})(?:\s+({_WORD}))?", k))
    once = F.col("verb").isin("module", "go")
    nth = F.count(F.when(once & (code != "") & (code != ")") & ~rest.rlike(r"^\($"), 1)).over(Window.partitionBy("root", "file", "verb").orderBy("line"))
    plain = (code != "") & (code != ")") & ~rest.rlike(r"^\($")
    wrong = (
        F.when((F.col("block") == "") & (code == ")"), F.lit("unexpected )"))
        .when((F.col("block") != "") & rest.rlike(r"^\w*\s*\($"), F.lit("block in a block"))
        .when(plain & ~F.col("verb").isin(*STATEMENTS), F.concat(F.lit("unknown statement: "), F.substring_index("code", " ", 1)))
        .when(plain & F.col("verb").isin("require", "exclude") & ~rest.rlike(rf"^{_WORD}\s+{_WORD}$"), F.lit("needs a module and a version"))
        .when(plain & (F.col("verb") == "replace") & ~rest.rlike(rf"^{_WORD}(\s+{_WORD})?\s+=>\s+{_WORD}(\s+{_WORD})?$"), F.lit("needs old => new"))
        .when(plain & (F.col("verb") == "module") & ~rest.rlike(rf"^{_WORD}$"), F.lit("needs a module path"))
        .when(plain & (F.col("verb") == "go") & ~rest.rlike(GO_VERSION), F.concat(F.lit("invalid go version: "), rest))
        .when(plain & once & (F.col("nth") > 1), F.concat(F.lit("repeated "), "verb", F.lit(" statement")))
        .when(plain & F.col("verb").isin("require", "exclude"), version_fault(word(1), word(2)))
        .when(plain & (F.col("verb") == "replace"), replacement_fault(rest))
    )
    last = F.max_by(F.when(code == ")", F.lit("")).when(rest.rlike(r"^\($"), F.col("verb")).otherwise(F.col("block")), "line")
    found = said.withColumn("nth", nth).withColumn("wrong", wrong).groupBy("root", "file").agg(F.min(F.when(F.col("wrong").isNotNull(), F.struct("line", "wrong"))).alias("at"), last.alias("open"), F.max("line").alias("end"))
    said_ = F.when(F.col("at").isNotNull(), F.concat_ws(":", "file", F.col("at.line").cast("string"), F.concat(F.lit(" "), "at.wrong"))).when(F.col("open") != "", F.concat_ws(":", "file", F.col("end").cast("string"), F.lit(" block stays open")))
    return found.select("root", "file", said_.alias("error"))


def facts(lines: DataFrame) -> DataFrame:
    """Facts of `lines` (root, file, line, text) of go.mod files, every mention, indirect ones too, and failures of those that can't be read.

    The module path is produced; required modules and the left sides of replacements are
    consumed, commented replacements too unless they stand inside a block's line. Each path also
    counts for its owning repository.
    """
    said = statements(lines)
    path = _unquoted(F.regexp_extract("rest", f"^({_WORD})", 1))
    plain = said.filter("verb in ('module', 'require', 'replace') and code <> ')' and not rest rlike '^[(]$'").select("root", "file", "line", F.when(F.col("verb") == "module", F.lit(schema.PRODUCER)).otherwise(F.lit(schema.CONSUMER)).alias("role"), path.alias("path"))
    # a comment before or after a statement counts, one beside a line in a block doesn't
    outside = said.filter("comment rlike '^replace .*=>' and (block = '' or code = ')')")
    old = F.regexp_extract("comment", r"^replace\s+(\S+).*?=>", 1)
    commented = outside.select("root", "file", "line", F.lit(schema.CONSUMER).alias("role"), old.alias("path"))
    every = plain.unionByName(commented).filter("path <> '' and path <> '=>'")
    return every.select("role", "root", F.lit(schema.GO_MODULE).alias("kind"), F.explode(module_refs(F.col("path"))).alias("ref"), "file", "line").unionByName(failures(errors(said), "gomod"))
