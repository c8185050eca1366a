"""References in HTML: code elements and identifier-shaped headings."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators.parsing import per_file

FILE_NAME = r"(?i)\.(html|htm)$"
#: Elements that make a claim.
SPANS, HEADINGS = ("code", "tt"), ("h1", "h2", "h3", "h4", "h5", "h6")


class _Claims(HTMLParser):
    """Collects the text of claiming elements. Any start tag inside one goes a level down, any end tag a level up."""

    def __init__(self, content: str):
        super().__init__(convert_charrefs=True)
        self.content, self.found, self.lines = content, [], {}
        self.tag, self.kind, self.line, self.depth, self.parts = "", "", 0, 0, []
        self.feed(content)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.kind:
            self.found.append((self.line, len(self.found), self.tag, "".join(self.parts), self.kind))
        self.kind, self.depth, self.parts = "", 0, []

    def _claim(self, tag: str) -> None:
        if tag in SPANS or tag in HEADINGS:
            raw = self.get_starttag_text() or ""
            if raw not in self.lines:
                self.lines[raw] = self.content.count("\n", 0, max(0, self.content.find(raw))) + 1
            self.tag, self.kind, self.line = tag, "code_span" if tag in SPANS else "heading", self.lines[raw]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.kind:
            self.depth += 1
        else:
            self._claim(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self.kind:
            self._claim(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.kind and self.depth:
            self.depth -= 1
        else:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.kind:
            self.parts.append(data)


def claims(pages: DataFrame) -> DataFrame:
    """(root, file, line, pos, tag, text, kind) of all claiming elements of `pages` (root, rel, content), in order by pos.

    An outer element claims what is in it, up to as many end tags as there were start tags, so a tag
    without an end, such as br, makes it run on. The line is that of the first equal start tag of the file.
    """
    raw = per_file(pages, lambda content: _Claims(content).found, "line int, pos int, tag string, raw string, kind string")
    return raw.select("root", "file", "line", "pos", "tag", text.stripped("raw").alias("text"), "kind")


def refs(pages: DataFrame) -> DataFrame:
    """(root, file, line, pos, text, kind) of `pages` (root, rel, content), in order by pos.

    code and tt give code spans unless they are flags, paths or have blanks; h1 to h6 give
    headings if their text looks like an identifier.
    """
    t = F.col("text")
    return claims(pages).drop("tag").filter(F.when(F.col("kind") == "heading", text.looks_like_identifier(t)).otherwise((t != "") & ~text.common_non_identifier(t)))
