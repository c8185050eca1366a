from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import symbol_db
from lodegraph.plans import extract, report, resolve
from lodegraph.sources import files


@pytest.fixture
def tree(tmp_path):
    def write(root, **contents):
        for name, body in contents.items():
            path = tmp_path / root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body)
        return str(tmp_path / root)

    return write


def _found(spark, roots, extractor, **options):
    out = extract.Registry(**options).extractors()[extractor](files.scan_local(spark, roots))
    return sorted((r.role, r.kind, r.ref, r.file.rsplit("/", 1)[-1], r.line) for r in out.collect())


def test_gomod(spark, tree):
    root = tree(
        "lib",
        **{
            "go.mod": """module github.com/team/lib/sub

go 1.22

require (
\tgithub.com/team/tool v1.2.3
\t"example.com/q" v0.1.0 // indirect
)

require example.com/one v1.0.0

replace example.com/old v1 => ../old

// replace example.com/gone v1.0.0 => ../gone
""",
            "vendor/go.mod": "module skipped.example/x\n",
        },
    )
    assert _found(spark, [root], "gomod") == [
        ("consumer", "go_module", "example.com/gone", "go.mod", 14),
        ("consumer", "go_module", "example.com/old", "go.mod", 12),
        ("consumer", "go_module", "example.com/one", "go.mod", 10),
        ("consumer", "go_module", "example.com/q", "go.mod", 7),
        ("consumer", "go_module", "github.com/team/tool", "go.mod", 6),
        ("producer", "go_module", "github.com/team/lib", "go.mod", 1),
        ("producer", "go_module", "github.com/team/lib/sub", "go.mod", 1),
    ]


def test_cargo(spark, tree):
    root = tree(
        "rs",
        **{
            "Cargo.toml": """[package]
name = "engine" # the crate

[dependencies]
serde = "1"
alias = { version = "1", package = "real-crate" }
multi = { version = "1",
  features = ["a", "b"] }

[target.'cfg(unix)'.dependencies]
nix = "0.27"

[dev-dependencies.helper]
path = "../helper"
package = "true-helper"

[workspace.dependencies]
serde = "2"
""",
            "target/Cargo.toml": '[package]\nname = "skipped"\n',
        },
    )
    assert _found(spark, [root], "cargo") == [
        ("consumer", "cargo_crate", "multi", "Cargo.toml", 7),
        ("consumer", "cargo_crate", "nix", "Cargo.toml", 11),
        ("consumer", "cargo_crate", "real-crate", "Cargo.toml", 6),
        ("consumer", "cargo_crate", "serde", "Cargo.toml", 5),
        ("consumer", "cargo_crate", "true-helper", "Cargo.toml", 14),
        ("producer", "cargo_crate", "engine", "Cargo.toml", 2),
    ]


def test_wrangler(spark, tree):
    root = tree(
        "w",
        **{
            "wrangler.toml": """name = "front"
services = [{ binding = "A", service = "auth" }, { service = "billing", binding = "B" }]

[[services]]
binding = "C"
service = "queue"

[[env.live.services]]
service = "auth"

[durable_objects]
name = "not-a-service"
""",
        },
    )
    assert _found(spark, [root], "wrangler") == [
        ("consumer", "service", "auth", "wrangler.toml", 2),
        ("consumer", "service", "billing", "wrangler.toml", 2),
        ("consumer", "service", "queue", "wrangler.toml", 6),
        ("producer", "service", "front", "wrangler.toml", 1),
    ]


def test_capnp(spark, tree):
    root = tree(
        "c",
        **{
            "config.capnp": """const config :Config = (
  services = [ (name = "main", worker = .w), # (name = "no", worker = .n)
    (name = "ext", service = "other") ],
  image = "img:1", to = "peer#1",
  name = "late",
  worker = .l
);
""",
            "schema.capnp": 'struct S { name = "x"; worker = 1; }\n',
        },
    )
    assert _found(spark, [root], "capnp") == [
        ("consumer", "container_image", "img:1", "config.capnp", 4),
        ("consumer", "service", "other", "config.capnp", 3),
        ("consumer", "service", "peer#1", "config.capnp", 4),
        ("producer", "service", "late", "config.capnp", 5),
        ("producer", "service", "main", "config.capnp", 2),
    ]


def test_dockerfile(spark, tree):
    root = tree(
        "d",
        **{
            "Dockerfile": """ARG GO=1.22
ARG BASE
# comment
FROM --platform=$BUILDPLATFORM golang:${GO} AS Builder
RUN go build \\
  ./...
COPY --from=busybox:${TAG:-1} /a /b
FROM gcr.io/Distroless/static
COPY --from=builder /x /x
COPY --from=0 /y /y
""",
            "sub/app.Dockerfile": "FROM alpine\n",
            "Dockerfile.txt.md": "FROM ok\n",
            "myDockerfile": "FROM not\n",
        },
    )
    assert _found(spark, [root], "dockerfile") == [
        ("consumer", "container_image", "docker.io/library/alpine", "app.Dockerfile", 1),
        ("consumer", "container_image", "docker.io/library/busybox", "Dockerfile", 7),
        ("consumer", "container_image", "docker.io/library/golang", "Dockerfile", 4),
        ("consumer", "container_image", "docker.io/library/ok", "Dockerfile.txt.md", 1),
        ("consumer", "container_image", "gcr.io/Distroless/static", "Dockerfile", 8),
        ("producer", "container_image", "Dockerfile", "Dockerfile", 8),
        ("producer", "container_image", "Dockerfile#builder", "Dockerfile", 4),
        ("producer", "container_image", "Dockerfile.txt.md", "Dockerfile.txt.md", 1),
        ("producer", "container_image", "sub/app.Dockerfile", "app.Dockerfile", 1),
    ]


WORKFLOW = """name: ci
env:
  REG: ghcr.io/${{ github.repository_owner }}
  IMAGE: ${{ env.REG }}/app:latest
  PLAIN: hello
jobs:
  one:
    env:
      EXTRA: ${{ matrix.x }}/no
    steps:
      - run: sudo CGO=0 go test ./...
      - run: |
          # comment
          docker build \\
            -t ${{ env.IMAGE }} .
          docker pull quay.io/x/y:1
          docker ps
          docker push ${{env.IMAGE}} && docker run "${{ secrets.X }}"
          echo hi
          ./bin/tool "$X" | cat
"""


def test_workflow(spark, tree):
    root = tree("ci", **{".github/workflows/a.yml": WORKFLOW, ".github/workflows/deep/b.yml": WORKFLOW})
    # a block's first line counts from its indicator; an expression with blanks falls apart into words, which name no image
    assert _found(spark, [root], "ci", owner="team") == [
        ("consumer", "cli_binary", "docker", "a.yml", 13),
        ("consumer", "cli_binary", "go", "a.yml", 11),
        ("consumer", "cli_binary", "tool", "a.yml", 19),
        ("consumer", "container_image", "quay.io/x/y", "a.yml", 15),
        ("producer", "container_image", "ghcr.io/team", "a.yml", 3),
        ("producer", "container_image", "ghcr.io/team/app", "a.yml", 4),
    ]
    nobody = _found(spark, [root], "ci")
    assert [f for f in nobody if f[0] == "producer"] == []
    plan = extract.Registry(owner="team").extractors()["ci"](files.scan_local(spark, [root]))
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_expressions():
    from lodegraph.operators.workflow import DEPTH, Expressions

    chain = {f"A{k}": f"${{{{ env.A{k + 1} }}}}" for k in range(DEPTH + 3)} | {f"A{DEPTH + 3}": "end"}
    known = Expressions(chain | {"LOOP": "${{ env.LOOP }}", "TWO": "${{env.A12}}-${{ github.repository_owner }}", "GONE": "${{ secrets.X }}"}, "team")
    assert known.literal("env.A10") == "end" and known.literal("env.A0") is None
    assert known.literal("env.TWO") == "end-team" and known.literal("env.LOOP") is None and known.literal("env.GONE") is None
    assert known.filled("plain") == "plain" and known.filled("${{ open") is None


def test_tabs_around_everything(spark, tree):
    """Each extractor takes tabs for white space."""
    root = tree(
        "t",
        **{
            "go.mod": "module example.com/t\nrequire\t(\n\texample.com/a\tv1.0.0\t// indirect\n\t)\n",
            "Cargo.toml": "\t[package]\n\tname\t=\t\"crate\"\t\n\t[dependencies]\t\n\tserde\t= \"1\"\n",
            "wrangler.toml": "\tname\t= \"front\"\n\t[[services]]\n\tservice\t=\t\"back\"\n",
            "c.capnp": "\tconst x :X = (\n\tservice\t= \"s\"\t)\n",
            "Dockerfile": "FROM\talpine\tAS\tbase\nCOPY\t--from=busybox\t/a /b\n",
            ".github/workflows/w.yml": "jobs:\n  a:\n    steps:\n    - run: |\n        \tgo\ttest\n",
            "a.go": "package p\n\tvar (\n\t\tTop = 1\n\t)\n",
        },
    )
    refs = lambda extractor: {(f[0][0], f[2]) for f in _found(spark, [root], extractor)}
    assert refs("gomod") == {("p", "example.com/t"), ("c", "example.com/a")}
    assert refs("cargo") == {("p", "crate"), ("c", "serde")}
    assert refs("wrangler") == {("p", "front"), ("c", "back")}
    assert refs("capnp") == {("c", "s")}
    assert refs("dockerfile") == {("c", "docker.io/library/alpine"), ("p", "Dockerfile#base"), ("p", "Dockerfile"), ("c", "docker.io/library/busybox")}
    assert refs("ci") == {("c", "go")}
    assert refs("gocode") == {("p", "example.com/t.Top")}


def test_dockerfile_forms():
    from lodegraph.operators import dockerfile

    args = {"V": "1", "E": ""}
    words = ["a:$V", "a:${V}", "${X:-b}", "${X:-${V}}", "${E:-x}", "${E-x}", "${V:+y}", "${X:+y}", "${V:?no}", "${X:?no}", "${X?no}", "${V", "'$V'b$V", "$X"]
    assert [dockerfile.expand(w, args) for w in words] == ["a:1", "a:1", "b", "1", "x", "", "y", "", "1", "${X:?no}", "${X?no}", "${V", "$Vb1", ""]
    told = "# escape=`\nARG B=base\nFROM $B AS One\nRUN a `\n  # note\n\n  b\nRUN <<EOF cat\nFROM fake\nEOF\nCOPY --from=one <<-'X' /c\n\tX\nFROM two\n"
    assert dockerfile.instructions(told) == [(2, "ARG", "B=base"), (3, "FROM", "$B AS One"), (4, "RUN", "a   b"), (8, "RUN", "<<EOF cat"), (11, "COPY", "--from=one <<-'X' /c"), (13, "FROM", "two")]
    assert dockerfile.references(told) == [(3, "from", "base", "one"), (11, "copy", "one", ""), (13, "from", "two", "")]
    for wrong in ("", "# only\n", "RUN x\n", "FROM a b\n", "FROM a\nNOPE b\n", "FROM a\nRUN <<E\nx\n"):
        with pytest.raises(ValueError):
            dockerfile.references(wrong)


def test_markdown_blocks():
    from lodegraph.operators.markdown import references

    text = "a `one\ntwo` b\n\n- item\n\n      `code`\n  and `kept`\n\n    `code`\n\n````\n```\n`in`\n```\n````\n> quoted `q`\n\n| `h` | x |\n| --- | --- |\n| `a\\|b` | `c` | `d`\n\nTitle `t`\n===\n<!-- `no`\n`no` -->\n\\`no `` x`y ``\n~~~\n`in`\n"
    assert [(r[0], r[2]) for r in references(text) if r[3] == "code_span"] == [(1, "one\ntwo"), (7, "kept"), (9, "code"), (16, "q"), (18, "h"), (20, "a\\|b"), (20, "c"), (20, "d"), (22, "t"), (26, " x`y ")]
    assert [r[2] for r in references("# A #\n####### no\n#\n#no\n   ## B\n")] == ["A", "", "B"]


def test_html_depth_and_characters(spark, tree):
    root = tree("h", **{"p.html": "<p>\n<code>a&#x2e;b&eacute;</code>\n<code>x<br>y</code> z<i></i> w</p>\n<code>end", "q.htm": "<!-- <code>no</code> --><script>'<code>no</code>'</script><tt>T</tt>"})
    found = extract.doc_refs(files.scan_local(spark, [root]), html_pages=True).orderBy("ord").collect()
    # br goes a level down and is never closed, so the second claim runs on and is no identifier for its blanks
    assert [(r.text, r.line) for r in found] == [("a.b\u00e9", 2), ("end", 2), ("T", 1)]


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("gomod", {"go.mod": "module m\n"}, {"sub/go.mod": "module n\nrequire (\n"}),
        ("cargo", {"Cargo.toml": '[package]\nname = "c"\n'}, {"sub/Cargo.toml": "[package\n"}),
        ("wrangler", {"wrangler.toml": 'name = "w"\n'}, {"sub/wrangler.toml": "name = \n"}),
        ("dockerfile", {"Dockerfile": "FROM a\n"}, {"sub/Dockerfile": "RUN a\n"}),
        ("ci", {".github/workflows/a.yml": "jobs: {a: {steps: [{run: go test}]}}\n"}, {".github/workflows/b.yml": "a: [\n"}),
    ],
)
def test_one_unreadable_file_drops_that_extractor_and_root_only(spark, tree, name, good, bad):
    broken, sound = tree("broken", **good, **bad), tree("sound", **good)
    one = extract.Registry().extractors()[name]
    rows = one(files.scan_local(spark, [broken, sound])).withColumn("extractor", F.lit(name)).unionByName(spark.createDataFrame([("producer", "x", "f", 1, broken, "service", "other")], "role string, ref string, file string, line int, root string, kind string, extractor string"))
    facts, failed = extract.isolated(rows)
    assert {(r.extractor, r.root) for r in facts.collect()} == {(name, sound), ("other", broken)}
    [error] = failed.collect()
    assert (error.extractor, error.root) == (name, broken) and error.error.startswith(f"{name}: ")


def test_walk_enters_only_what_an_extractor_reads(tmp_path):
    for path in ("go.mod", "node_modules/a/x.go", "node_modules/a/go.mod", ".git/go.mod", ".github/workflows/c.yml", ".github/workflows/deep/c.yml", ".github/c.yml", "c.yml", "vendor/a.go", "vendor/a.md", ".hid/go.mod", ".hid/a.go", "target/Cargo.toml", "big.bin", "sub/a.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    found = {p.removeprefix(f"{tmp_path}/") for p in files.walk(str(tmp_path))}
    assert found == {"go.mod", "node_modules/a/x.go", "node_modules/a/go.mod", ".github/workflows/c.yml", "vendor/a.md", ".hid/go.mod", "sub/a.md"}
    assert {p.removeprefix(f"{tmp_path}/") for p in files.walk(str(tmp_path), ("docs",))} == {"vendor/a.md", "sub/a.md"}


def test_symbols_from_a_database(spark, tmp_path):
    import sqlite3

    root = tmp_path / "r"
    root.mkdir()
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.executescript(
            "create table nodes (id text, source_file text); create table _ast (node_id text, start_row int);"
            "create table node_defs (token text, node_id text); create table node_refs (token text, node_id text);"
            "insert into nodes values ('1', 'a.go'), ('2', 'b.go'); insert into _ast values ('1', 4);"
            "insert into node_defs values ('p.F', '1'), ('', '1'), ('p.G', '9'); insert into node_refs values ('p.F', '2');"
        )
    db.close()
    (root / "go.mod").write_text("module m\n")
    found = extract.Registry(symbol_db=str(tmp_path / "s.db")).gather(files.scan_local(spark, [str(root)]))
    assert sorted((r.role, r.ref, r.file, r.line) for r in found.facts.filter("extractor = 'gocode'").collect()) == [("consumer", "p.F", "b.go", 0), ("producer", "p.F", "a.go", 5)]
    gone = extract.Registry(symbol_db=str(tmp_path / "gone.db")).gather(files.scan_local(spark, [str(root)]))
    assert gone.skipped == [("gocode", f"symbol database: not readable at {tmp_path}/gone.db")] and gone.facts.count() == 1


def test_root_dot_and_qualified_files(spark, tree, monkeypatch):
    root = tree("dot", **{"go.mod": "module example.com/d\n", "a.go": 'package p\nimport "fmt"\nfunc Run() {}\n', "Dockerfile": "FROM a\n"})
    monkeypatch.chdir(root)
    scanned = files.scan_local(spark, ["."])
    assert {(r.ref, r.file) for r in extract.Registry().gather(scanned).facts.filter("extractor in ('gocode', 'gomod')").collect()} == {("fmt", "a.go"), ("example.com/d", "go.mod")}
    found = {(r.ref, r.file) for r in extract.Registry(root_qualified=True).gather(scanned).facts.filter("extractor in ('gocode', 'gomod')").collect()}
    assert found == {("fmt", "./a.go"), ("example.com/d.Run", "./a.go"), ("example.com/d", "./go.mod")}


GO = """// Package p does things.
package p

import (
\t"fmt"
\tq "example.com/q"
)

import "os"

// Run runs
// all of it.
func Run() { var Inner = 1; fmt.Println("func Fake()", Inner) }

/* Gone */


func Far[T any](x T) {}

func (s *Server) Start(addr string) error { return nil }
func (s Server) Stop() {}
func (g *Gen[T]) Hidden() {}
func low() {}

type (
\tServer struct {
\t\tName string
\t}
\tAlias = Server
)

const (
\tA, B = 1, 2
\tc    = 3
)

var Top = `
func Raw() {}
`
"""


def test_go_facts_and_entities(spark, tree):
    root = tree("g", **{"go.mod": "module example.com/g\n", "sub/a.go": GO, "a_test.go": "package p\nfunc TestX() {}\n", "vendor/v.go": GO})
    found = _found(spark, [root], "gocode")
    assert [f[2] for f in found if f[0] == "consumer"] == ["example.com/q", "fmt", "os"]
    names = {f[2].removeprefix("example.com/g/sub.") for f in found if f[0] == "producer"}
    assert names == {"Run", "Inner", "Far", "Server.Start", "Server.Stop", "Server", "A", "B", "Top"}
    rows = {(r.name, r.kind): r for r in extract.entities(files.scan_local(spark, [root])).collect()}
    assert rows["Run", "function"].doc_comment == "// Run runs\n// all of it."
    assert rows["Far", "function"].doc_comment == ""
    assert rows["Run", "function"].package == "p" and rows["A", "constant"].file == "sub/a.go"
    assert sorted(r.ord for r in rows.values()) == list(range(1, len(rows) + 1))


MARKDOWN = """# ParseFile
## Two words
Use `Render.Map` and ``a`b`` or `--flag`, `~/x`, `two words`.

| a | b |
| - | - |
| `Cell` | x |

```go
`Fenced`
```
### `Inside`
"""


def test_markdown_and_html_refs(spark, tree):
    root = tree("docs", **{"a.md": MARKDOWN, ".hidden/b.md": "# Hidden\n", "p.html": "<h1>Title</h1>\n<p><code>x.Run()</code>\n<tt>-f</tt> <h2>Not this</h2> <code>a &lt; b</code><code><b>Bold</b></code></p>"})
    scanned = files.scan_local(spark, [root])
    assert [(r.text, r.kind, r.line) for r in extract.doc_refs(scanned).orderBy("ord").collect()] == [("ParseFile", "heading", 1), ("Render.Map", "code_span", 3), ("a`b", "code_span", 3), ("Cell", "code_span", 7)]
    assert [(r.text, r.kind, r.line) for r in extract.doc_refs(scanned, html_pages=True).orderBy("ord").collect()] == [("Title", "heading", 1), ("x.Run()", "code_span", 2), ("Bold", "code_span", 2)]


def test_registry_reports_and_renders(spark, tree):
    a = tree("roota", **{"go.mod": "module example.com/lib\n", ".github/workflows/x.yml": "a: [\n"})
    b = tree("rootb", **{"go.mod": "module example.com/app\nrequire example.com/lib v1.0.0\n"})
    g = report.Graph.of(extract.Registry(unavailable={"gocode": "no backend"}).gather(files.scan_local(spark, [a, b])), [a, b])
    assert g.edges.count() == 1
    assert [(r.extractor, r.root) for r in g.failed.collect()] == [("ci", a)]
    repo = report.mermaid_repos(g).text()
    assert repo.startswith("graph LR\n") and '-->|"1 artifact"|' in repo and '["roota"]' in repo
    diagram = report.mermaid(g).text()
    assert diagram.count("subgraph") == 1 and "resolved:exact" in diagram and diagram == report.mermaid(g).text()
    body = report.markdown(g).text()
    assert "- Resolved edges: 1" in body and "- `gocode` — no backend" in body and "## Skipped inputs" in body
    out = report.map_json(g).text()
    assert '"bucket": "dangling"' in out and '"skipped"' in out and '"failed"' in out


def test_empty_map(spark, tree):
    root = tree("none", **{"x.txt": ""})
    g = report.Graph.of(extract.Registry().gather(files.scan_local(spark, [root])), [root])
    assert report.map_json(g).text() == '{\n  "artifacts": null,\n  "edges": []\n}\n'


def test_shared_scan_names_files_as_the_local_one(spark, tree):
    root = tree("s", **{"go.mod": "module m\n", "sub/x.md": "# A\n"})
    key = lambda df: sorted((r.root, r.path, r.rel, r.name, bytes(r.content)) for r in df.collect())
    assert key(files.scan_shared(spark, [root])) == key(files.scan_local(spark, [root]))


def test_symbol_database(spark):
    defs = spark.createDataFrame([("p.F", "1"), ("", "1"), ("p.G", "9")], "token string, node_id string")
    refs = spark.createDataFrame([("p.F", "2")], "token string, node_id string")
    nodes = spark.createDataFrame([("1", "a.go"), ("2", None)], "id string, source_file string")
    ast = spark.createDataFrame([("1", 4)], "node_id string, start_row int")
    f = symbol_db.facts(defs, refs, nodes, ast, "r")
    assert sorted((r.role, r.ref, r.file, r.line) for r in f.collect()) == [("consumer", "p.F", "", 0), ("producer", "p.F", "a.go", 5)]
    assert resolve.resolved_edges(f).count() == 1
