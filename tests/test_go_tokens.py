"""Go declarations from tokens: groups on one line, receivers over lines, local declarations, and what only looks like one."""

from __future__ import annotations

import pytest

from lodegraph.operators import gosource

SOURCES = {
    "var (One = 1)": [("variable", "One")],
    "const (Two = 2; Three = 3)": [("constant", "Two"), ("constant", "Three")],
    "func F() { var Local int; const Inner = 1 }": [("function", "F"), ("variable", "Local"), ("constant", "Inner")],
    "func (\n\ts *Server,\n) Start(\n\ta int,\n) error { return nil }": [("method", "Server.Start")],
    "func (Server) Stop() {}\nfunc (*Server) Go() {}": [("method", "Server.Stop"), ("method", "Server.Go")],
    "func (g *Gen[T]) Hidden() {}\nfunc Map[K any](x K) {}": [("function", "Map")],
    "type (A struct{ X int; Y string }; B = A; C[T any] []T)": [("type", "A"), ("type", "C")],
    "type Alias = int\ntype Real int": [("type", "Real")],
    "var A, B int = 1, 2\nvar C, D = f(E, G)": [("variable", n) for n in "ABCD"],
    "var F = func(x T) error { var In = 2; return nil }": [("variable", "F"), ("variable", "In")],
    "var (\n\tX = map[string]int{\n\t\t\"a\": Y,\n\t}\n\tZ func(\n\t\tQ int,\n\t) int\n)": [("variable", "X"), ("variable", "Z")],
    "const (\n\tP = iota\n\tQ\n\n\tR, S = iota, 1 // T\n)": [("constant", n) for n in "PQRS"],
    "var Raw = `\nvar No = 1\nconst (Nope = 2)\n`\nvar Yes = 1": [("variable", "Raw"), ("variable", "Yes")],
    'var S = "var No = 1; const X = 2"; var U = \'{\'; var V = 1': [("variable", "S"), ("variable", "U"), ("variable", "V")],
    "func F(x any) { switch x.(type) {\n\tcase Int: var Z = 1\n\t}\n}": [("function", "F"), ("variable", "Z")],
    "type I interface {\n\tMethod(A int) B\n\tE\n}": [("type", "I")],
    "/* var No = 1 */ var Yes /* X */ = 2": [("variable", "Yes")],
    "func F() {\n\tx++\n\tvar Y = x\n\tgo func() { const W = 1 }()\n}": [("function", "F"), ("variable", "Y"), ("constant", "W")],
    "type T struct {\n\tFoo func(Bar int) (Baz error)\n}\nfunc (t T) Do() (Out int) { return }": [("type", "T"), ("method", "T.Do")],
    "var Ünï, É = 1, 2": [("variable", "Ünï"), ("variable", "É")],
}


def test_declarations(spark):
    rows = [("r", str(k), f"package p\n{body}\n".encode()) for k, body in enumerate(SOURCES)]
    lines = gosource.code_lines(spark.createDataFrame(rows, "root string, rel string, content binary"))
    found = {}
    for r in gosource.entities(lines).orderBy("file", "line", "pos").collect():
        found.setdefault(int(r.file), []).append((r.kind, r.name))
    for k, (body, want) in enumerate(SOURCES.items()):
        # a method or function stands at its word `func`, before what it declares
        assert sorted(found.get(k, [])) == sorted(want), (body, found.get(k))


def test_positions_follow_the_source(spark):
    lines = gosource.code_lines(spark.createDataFrame([("r", "f", b"package p\nconst (Two = 2; Three, Four = 3, 4)\n")], "root string, rel string, content binary"))
    assert [r.name for r in gosource.entities(lines).orderBy("line", "pos").collect()] == ["Two", "Three", "Four"]


@pytest.mark.parametrize(
    ("above", "doc"),
    [("// F does.\n", "// F does."), ("// a\n// b\n", "// a\n// b"), ("// gone\n\n\n// kept\n", "// kept"), ("// near\n\n", "// near"), ("/* x\n y */\n", "/* x\n y */"), ("// far\n\n\n", ""), ("var x = 1 // no\n", ""), ("", "")],
)
def test_doc_comments(spark, above, doc):
    lines = gosource.code_lines(spark.createDataFrame([("r", "f", f"package p\n\nvar q = 2\n\n\n{above}func F() {{}}\n".encode())], "root string, rel string, content binary"))
    [row] = gosource.entities(lines).collect()
    assert (row.name, row.doc_comment, row.package) == ("F", doc, "p")
