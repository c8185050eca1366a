"""Go declarations and imports, from lines.

A small helper blanks out comments and the insides of strings, keeping lines and
columns. Lines are then cut into tokens on columns, with the semicolons that ends of lines stand for, and
declarations decided by windows over the tokens of a file: brackets' depth, the group that a bracket opens,
and where a group's next declaration begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions.text import exported, stripped
from lodegraph.operators.parsing import fact
from lodegraph.plans.lineage import cut

_LITERAL = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*'?""", re.S)
LINES = "root string, file string, line int, text string, code string, comment boolean"
_IDENTIFIER = r"[\pL_][\pL\pN_]*"
#: Names, numbers, literals (raw ones by their ends), and single characters of what else there is.
_TOKEN = rf'{_IDENTIFIER}|[0-9][\pL\pN_.]*|"[^"]*"|\'[^\']*\'|\S'
#: Keywords, those that may end a statement, and those that declare.
_KEYWORDS = ("break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var")
_ENDING = ("break", "continue", "fallthrough", "return")
_DECLARING = ("type", "const", "var")
#: Order of declaration queries.
KINDS = ("function", "method", "type", "constant", "variable")


def _blank(m: re.Match) -> str:
    s = m.group()
    keep = s[0] if s[0] in "\"`'" else " "
    return keep + re.sub(r"[^\n]", " ", s[1:-1]) + (keep if len(s) > 1 else "")


def code_lines(files: DataFrame) -> DataFrame:
    """LINES of Go files (root, rel, content): text as it is, code with literals blanked, and whether nothing but comment stands there."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for root, rel, content in frame.itertuples(index=False):
                whole = bytes(content).decode("utf-8", "replace")
                code = _LITERAL.sub(_blank, whole)
                for at, (a, b) in enumerate(zip(whole.split("\n"), code.split("\n"), strict=True)):
                    out.append((root, rel, at + 1, a, b, bool(a.strip()) and not b.strip()))
            yield pd.DataFrame(out, columns=["root", "file", "line", "text", "code", "comment"])

    return files.select("root", "rel", "content").mapInPandas(each, LINES)


def _window() -> Window:
    return Window.partitionBy("root", "file").orderBy("line")


def _upto() -> Window:
    return _window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> Window:
    return _window().rowsBetween(Window.unboundedPreceding, -1)


def imports(lines: DataFrame) -> DataFrame:
    """(root, file, line, path) of every import with a double-quoted path; `lines` are LINES."""
    opens = F.col("code").rlike(r"^import\s*\(")
    grouped = lines.withColumn("group", F.coalesce(F.last(F.when(opens, F.lit(True)).when(F.col("code").rlike(r"^\s*\)"), F.lit(False)), ignorenulls=True).over(_before()), F.lit(False)))
    inside = F.col("group") & F.col("code").rlike(r'^\s*(?:[\pL_.][\pL\pN_]*\s+)?"')
    alone = F.col("code").rlike(r'^import\s*\(?\s*(?:[\pL_.][\pL\pN_]*\s+)?"')
    return grouped.filter(inside | alone).select("root", "file", "line", F.regexp_extract("text", r'"([^"]*)"', 1).alias("path")).filter("path <> ''")


def packages(lines: DataFrame) -> DataFrame:
    """(root, file, package)."""
    named = lines.select("root", "file", "line", F.regexp_extract("code", r"^\s*package\s+([\pL_][\pL\pN_]*)", 1).alias("package")).filter("package <> ''")
    return named.groupBy("root", "file").agg(F.min_by("package", "line").alias("package"))


def tokens(lines: DataFrame) -> DataFrame:
    """(root, file, line, pos, t) of `lines` (LINES): tokens in order, with a semicolon where the end of a line ends a statement.

    A literal is its quotes; a raw one over several lines is a token where it begins and one where it ends.
    """
    raw = F.length("code") - F.length(F.replace(F.col("code"), F.lit("`"), F.lit("")))
    open_raw = F.sum(raw).over(_upto()) % 2 == 1
    cut_ = lines.withColumn("ts", F.regexp_extract_all("code", F.lit(f"({_TOKEN})"), 1)).withColumn("open_raw", open_raw)
    last = F.try_element_at("ts", F.lit(-1))
    doubled = last.isin("+", "-") & (F.try_element_at("ts", F.lit(-2)) == last)
    word = last.rlike(rf"^{_IDENTIFIER}$")
    ends = (word & (~last.isin(*_KEYWORDS) | last.isin(*_ENDING))) | last.rlike(r"""^[0-9"'`)\]}]""") | doubled
    ended = F.when(F.coalesce(ends & ~F.col("open_raw"), F.lit(False)), F.array_append("ts", F.lit(";"))).otherwise(F.col("ts"))
    return cut_.select("root", "file", "line", F.posexplode(ended).alias("pos", "t"))


def declarations(lines: DataFrame) -> DataFrame:
    """(root, file, line, pos, kind, own, receiver) of declarations in `lines` (LINES), in functions too; own is the bare name."""
    file = ["root", "file"]
    w = Window.partitionBy(*file).orderBy("line", "pos")
    t = F.col("t")
    opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
    depth = F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.concat_ws(" ", *(F.lead("t", k).over(w) for k in range(1, 9)))
    told = tokens(lines).select(*file, "line", "pos", "t", depth.alias("depth"), F.lag("t").over(w).alias("prev"), F.when(t == "func", ahead).alias("ahead"), opens.alias("opens"))
    told = told.withColumn("level", F.col("depth") + F.col("opens").cast("int"))
    own_group = F.when(F.col("opens"), F.when((t == "(") & F.col("prev").isin(*_DECLARING), F.col("prev")).otherwise(""))
    within = Window.partitionBy(*file, "level").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("group", F.last(own_group, ignorenulls=True).over(within))
    named = t.rlike(rf"^{_IDENTIFIER}$") & ~t.isin(*_KEYWORDS)
    word = F.when(F.col("prev").isin(*_DECLARING), F.col("prev")).when((F.col("group") != "") & F.col("prev").isin("(", ";") & ~F.col("opens"), F.col("group"))
    told = told.withColumn("named", named).withColumn("word", F.when(named, word)).withColumn("next", F.lead("t").over(w))
    told = told.withColumn("spec", F.count("word").over(w))

    statement = F.coalesce(F.col("prev") == ";", F.lit(True)) & (F.col("depth") == 0)
    funcs = told.filter((F.col("t") == "func") & statement)
    receiver = rf"^\( (?:{_IDENTIFIER} )?(?:\* )?({_IDENTIFIER}) (?:, )?\) ({_IDENTIFIER}) \("
    plain, of, method = F.regexp_extract("ahead", rf"^({_IDENTIFIER}) [(\[]", 1), F.regexp_extract("ahead", receiver, 1), F.regexp_extract("ahead", receiver, 2)
    made = funcs.select(*file, "line", "pos", F.when(plain != "", "function").otherwise("method").alias("kind"), F.when(plain != "", plain).otherwise(method).alias("own"), of.alias("receiver")).filter("own <> ''")

    # a declaration's names: every other token from its start on, as long as commas stand between
    spec = Window.partitionBy(*file, "spec").orderBy("line", "pos")
    at = F.row_number().over(spec)
    specs = told.filter("spec > 0").withColumn("at", at).withColumn("word", F.first("word").over(spec))
    good = F.when(F.col("at") % 2 == 1, F.col("named")).otherwise(F.col("t") == ",")
    listed = specs.withColumn("good", F.min(good).over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("good and at % 2 = 1")
    types = listed.filter("word = 'type' and at = 1 and next <> '='").withColumn("kind", F.lit("type"))
    values = listed.filter("word <> 'type'").withColumn("kind", F.when(F.col("word") == "const", "constant").otherwise("variable"))
    return types.unionByName(values).select(*file, "line", "pos", "kind", F.col("t").alias("own"), F.lit("").alias("receiver")).unionByName(made)


def doc_comments(lines: DataFrame) -> DataFrame:
    """(root, file, line, doc_comment): what stands right above each line of code, back to a gap of two lines."""
    code = ~F.col("comment") & (stripped("code") != "")
    # lines without code belong to the next line that has some
    below = F.first(F.when(code, F.col("line")), ignorenulls=True).over(_window().rowsBetween(1, Window.unboundedFollowing))
    above = lines.withColumn("below", F.when(~code, below)).filter("below is not null")
    held = above.groupBy("root", "file", F.col("below").alias("line")).agg(F.sort_array(F.collect_list(F.struct("line", "text", "comment"))).alias("above"), F.max("comment").alias("any")).filter("any")
    gap = F.expr("aggregate(sequence(1, greatest(1, size(above) - 1)), 0, (g, i) -> if(size(above) > 1 and not above[i - 1].comment and not above[i].comment, i, g))")
    taken = F.expr("slice(above, gap + 1, size(above) - gap)")
    return held.withColumn("gap", gap).select("root", "file", "line", F.regexp_replace(F.array_join(F.transform(taken, lambda x: x["text"]), "\n"), r"^\s+|\s+$", "").alias("doc_comment"))


def entities(lines: DataFrame, exported_only: bool = True) -> DataFrame:
    """(root, file, line, pos, kind, name, package, exported, doc_comment) of declarations, by kind, line and pos within a file.

    Functions, methods of named receivers without type parameters (as Receiver.Name), types but no
    aliases, and names of const and var declarations, in functions too. A function's doc
    comment is what stands right above it, with one blank line at most in between.
    """
    found = declarations(lines).withColumn("exported", exported(F.col("own")))
    if exported_only:
        found = found.filter("exported")
    doc = F.when(F.col("kind").isin("function", "method"), F.col("doc_comment"))
    named = found.join(packages(lines), ["root", "file"], "left").join(doc_comments(lines), ["root", "file", "line"], "left")
    name = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "own")).otherwise(F.col("own"))
    return named.select("root", "file", "line", "pos", "kind", name.alias("name"), F.coalesce("package", F.lit("")).alias("package"), "exported", F.coalesce(doc, F.lit("")).alias("doc_comment"))


def module_paths(files: DataFrame) -> DataFrame:
    """(root, module) from each root's own go.mod."""
    own = files.filter("rel = 'go.mod'").select("root", F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("text"))
    return own.select("root", stripped(F.regexp_extract("text", r"^\s*module (.*)$", 1)).alias("module")).filter("module <> ''").groupBy("root").agg(F.first("module").alias("module"))


def facts(files: DataFrame, exported_only: bool = True, of_dot: bool = False) -> DataFrame:
    """Produced symbols and consumed imports of Go files (root, rel, name, content); tests are left out, files are named below their root.

    A root named `.` gives imports only, unless `of_dot`.
    """
    go = files.filter("name like '%.go' and not name like '%\\\\_test.go'")
    lines = cut(code_lines(go))
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    owned = entities(lines if of_dot else lines.filter("root <> '.'"), exported_only).join(module_paths(files), "root", "left")
    path = F.when(F.col("module").isNull(), F.lit(None)).when(folder == "", F.col("module")).otherwise(F.concat_ws("/", "module", folder))
    made = owned.withColumn("line", F.lit(0)).select(*fact(schema.PRODUCER, schema.GO_SYMBOL, F.concat_ws(".", path, "name")))
    used = imports(lines).select(*fact(schema.CONSUMER, schema.GO_MODULE, "path"))
    return made.unionByName(used)
