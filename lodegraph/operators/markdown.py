"""References in Markdown: identifier-shaped headings and code spans.

A small helper tells a file's blocks apart and finds spans in them; what counts as a
reference is decided on columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators.parsing import per_file

FILE_NAME = r"(?i)\.(md|markdown)$"
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"( {0,3}(?:[-*+]|\d{1,9}[.)]))(?:( {1,4})(?=\S)| *$|\t)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|=+[ \t]*)$")
_DELIMITERS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_RUN = re.compile(r"\\[\s\S]|`+")


#: Tags whose blocks go on to a blank line, and to their own end.
_BLOCK_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
_RAW_TAGS = "script pre style textarea"
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
#: How blocks of HTML begin and what ends them; None is a blank line. The last kind begins no block within a paragraph.
_HTML = tuple(
    (re.compile(rf" {{0,3}}(?:{begins})", re.I), ends and re.compile(ends, re.I))
    for begins, ends in (
        (rf"<(?:{_RAW_TAGS.replace(' ', '|')})(?:[\s>]|$)", rf"</(?:{_RAW_TAGS.replace(' ', '|')})>"),
        (r"<!--", r"-->"),
        (r"<\?", r"\?>"),
        (r"<!\[CDATA\[", r"\]\]>"),
        (r"<![A-Za-z]", r">"),
        (rf"</?(?:{_BLOCK_TAGS.replace(' ', '|')})(?:\s|/?>|$)", None),
        (rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$", None),
    )
)
_DEFINITION = re.compile(r""" {0,3}\[(?!\s*\])(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""")
_BARE_DEFINITION = re.compile(r" {0,3}\[(?!\s*\])(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)[ \t]*(?:\n|$)")


def html_block(line: str, in_paragraph: bool) -> tuple[bool, re.Pattern | None]:
    """Whether a block of HTML begins at this line, and what ends it; None for a blank line."""
    for k, (begins, ends) in enumerate(_HTML):
        if begins.match(line) and not (in_paragraph and k == len(_HTML) - 1):
            return True, ends
    return False, None


def without_definitions(block: str) -> str:
    """A paragraph without the link definitions at its beginning, which are no text."""
    while found := _DEFINITION.match(block) or _BARE_DEFINITION.match(block):
        block = block[found.end() :]
    return block


def spans(block: str) -> list[tuple[int, str]]:
    """(place, content) of the code spans of a block: text between two runs of as many backticks."""
    out, at = [], 0
    runs: dict[int, list[int]] = {}
    for m in re.finditer("`+", block):
        runs.setdefault(len(m[0]), []).append(m.start())
    while found := _RUN.search(block, at):
        at = found.end()
        if found[0][0] == "`":
            same = runs[len(found[0])] if len(found[0]) in runs else []
            k = bisect_left(same, at)
            if k < len(same):
                out.append((found.start(), block[at : same[k]]))
                at = same[k] + len(found[0])
    return out


def cells(row: str) -> list[str]:
    """The cells of a table's row; a pipe after a backslash is part of its cell."""
    return [c.strip() for c in re.split(r"(?<!\\)\|", row.strip().strip("|"))]


def references(content: str) -> list[tuple[int, int, str, str]]:
    """(line, pos, text, kind) of headings marked by # and of code spans elsewhere, in order by line and pos.

    Lines in fenced and indented code blocks and in blocks of HTML, comments too, don't count, nor do link definitions.
    A span may go over lines within its paragraph or item; in a table it lies in one cell.
    """
    out: list[tuple[int, int, str, str]] = []
    lines = [x.rstrip("\r") for x in content.split("\n")]
    held: list[str] = []
    begun, fence, table, indent, blank = 0, "", False, 0, True
    html, html_end = False, None

    def flush() -> None:
        nonlocal begun
        block = "\n".join(held)
        if "`" in block:
            text_ = without_definitions(block)
            begun += block[: len(block) - len(text_)].count("\n")
            block = text_
            out.extend((begun + block.count("\n", 0, at), k, code, "code_span") for k, (at, code) in enumerate(spans(block)))
        held.clear()

    for number, raw in enumerate(lines, 1):
        line = re.sub(r"^(?: {0,3}> ?)+", "", raw)
        if html:
            html = not html_end.search(line) if html_end else bool(line.strip())
            if html or html_end:
                blank = True
                continue
        own = line[indent:] if not line[:indent].strip() else line
        mark = _FENCE.match(own)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
            continue
        if not line.strip():
            flush()
            blank, table = True, False
            continue
        if line[:indent].strip():  # back out of the item
            indent, own, mark = 0, line, _FENCE.match(line)
        if mark and not (mark[1][0] == "`" and "`" in mark[2]):
            flush()
            fence, table, blank = mark[1], False, True
            continue
        if not held and blank and re.match(r"(?: {4}| {0,3}\t)", own):
            continue
        begins, html_end = html_block(own, bool(held)) if not table else (False, None)
        if begins:
            flush()
            html, blank = html_end is None or not html_end.search(own), True
            continue
        heading = _HEADING.match(own)
        if heading:
            flush()
            out.append((number, 0, (heading[1] or "").strip(), "heading"))
            blank, table = True, False
            continue
        if held and not table and "|" in own and "-" in own and _DELIMITERS.match(own) and len(cells(own)) == len(cells(held[-1])):
            top = held.pop()
            flush()
            out.extend((number - 1, k, code, "code_span") for k, code in enumerate(c for cell in cells(top) for _, c in spans(cell)))
            table = True
            continue
        if table:
            out.extend((number, k, code, "code_span") for k, code in enumerate(c for cell in cells(own) for _, c in spans(cell)))
            continue
        if _RULE.match(own):
            flush()
            blank = True
            continue
        item = _ITEM.match(own)
        if item:
            flush()
            indent += len(item[1]) + len(item[2] or " ")
            own = line[indent:] if not line[:indent].strip() else own[item.end() :]
        if not held:
            begun = number
        held.append(own)
        blank = False
    flush()
    return out


def refs(files: DataFrame) -> DataFrame:
    """(root, file, line, pos, text, kind) of Markdown `files` (root, rel, content), in order by line and pos.

    A heading counts if its whole text looks like an identifier; code spans in headings are
    not looked at. Other code spans count unless they are flags, paths or have blanks.
    """
    found = per_file(files, references, "line int, pos int, raw string, kind string").select("root", "file", "line", "pos", text.stripped("raw").alias("text"), "kind")
    t = F.col("text")
    return found.filter(F.when(F.col("kind") == "heading", text.looks_like_identifier(t)).otherwise((t != "") & ~text.common_non_identifier(t)))
