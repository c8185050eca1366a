"""Markdown: blocks of HTML, link definitions, spans, and places."""

from __future__ import annotations

import time

import pytest

from lodegraph.operators import markdown


def found(text):
    return [(line, raw) for line, _, raw, _ in markdown.references(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The `GraphCache` type. Call `NewGraphCache()` now.\n", [(1, "GraphCache"), (1, "NewGraphCache()")]),
        ("<div>\n`No`\n</div>\n`No`\n\n`Yes`\n", [(6, "Yes")]),
        ("text\n<div>\n`No`\n\n`Yes`\n", [(5, "Yes")]),
        ("<span class='x'>\n`No`\n\n`Yes`\n", [(4, "Yes")]),
        ("text\n<span>\n`Yes`\n", [(3, "Yes")]),
        ("<b>bold</b> and `Yes`\n", [(1, "Yes")]),
        ("<pre>\n`No`\n\n`No`\n</pre> `No`\n`Yes`\n", [(6, "Yes")]),
        ("<script>`No`</script>\n`Yes`\n", [(2, "Yes")]),
        ("<!-- `No`\n\n`No` -->\n`Yes`\n", [(4, "Yes")]),
        ("text\n<!-- `No` -->\n`Yes`\n", [(3, "Yes")]),
        ("<?php `No`\n\n?>\n`Yes`\n", [(4, "Yes")]),
        ("<![CDATA[\n`No`\n]]>\n`Yes`\n", [(4, "Yes")]),
        ("<!DOCTYPE `No`>\n`Yes`\n", [(2, "Yes")]),
        ("- item\n\n  <div>\n  `No`\n\n  `Yes`\n", [(6, "Yes")]),
        ("> <div>\n> `No`\n>\n> `Yes`\n", [(4, "Yes")]),
        ("    <div>\n\n`Yes`\n", [(3, "Yes")]),
        ("[a]: /url \"`No`\"\n`Yes`\n", [(2, "Yes")]),
        ("[a]: /url\n[b]: <x y> '`No`'\n\n`Yes`\n", [(4, "Yes")]),
        ("[a]:\n/url\n\"two `No`\nlines\"\ntext `Yes`\n", [(5, "Yes")]),
        ("text\n[a]: /url \"`Yes`\"\n", [(2, "Yes")]),
        ("[a]: /url \"`Yes`\" more\n", [(1, "Yes")]),
        ("[ ]: `Yes`\n", [(1, "Yes")]),
        ("a ``b`c`` and `d\ne`\n", [(1, "b`c"), (1, "d\ne")]),
        ("\\`no` and `yes`\n", [(1, " and ")]),
        ("intro\n\n| A | B |\n|---|---|\n| `RowOne` | x |\n| `RowTwo` | <div> |\n", [(5, "RowOne"), (6, "RowTwo")]),
        ("# `Head`\n\n## MemoryStore\n", [(1, "`Head`"), (3, "MemoryStore")]),
    ],
)
def test_blocks(text, want):
    assert found(text) == want


def test_spans_take_linear_time():
    def took(n):
        block = " ".join("`" * (k % 300 + 1) for k in range(n))
        start = time.process_time()
        markdown.spans(block)
        return time.process_time() - start

    took(500)
    assert took(20_000) < 12 * took(5_000) + 0.2
