"""Inputs that fail a pass, further forms of build arguments, kinds, views for SQL, and symbol databases of many batches."""

from __future__ import annotations

import sqlite3
from collections import Counter

import pytest

from lodegraph import schema
from lodegraph.operators import gomod, symbol_db, toml_tables
from lodegraph.operators.dockerfile import expand
from lodegraph.plans import extract
from lodegraph.sources import files

GO_MODS = {
    "require example.com/lib v1.2.3": None,
    "require example.com/lib v1": None,
    "require example.com/lib v0.0.0-20200101000000-abcdef123456": None,
    "require example.com/lib v1.2.3-rc.1+meta": None,
    "require example.com/lib/v2 v2.0.1": None,
    "require example.com/lib v2.0.0+incompatible": None,
    "require gopkg.in/yaml.v3 v3.0.1": None,
    "require gopkg.in/check.v1 v0.0.0-20161208181325-20d25e280405": None,
    "require example.com/lib notaversion": "must be of the form v1.2.3",
    "require example.com/lib 1.2.3": "must be of the form v1.2.3",
    "require example.com/lib v1.02.3": "must be of the form v1.2.3",
    "require example.com/lib v1.2-rc": "must be of the form v1.2.3",
    "require example.com/lib v2.0.0": "should be v0 or v1, not v2",
    "require example.com/lib/v2 v1.0.0": "should be v2, not v1",
    "require example.com/lib/v1 v1.0.0": "invalid module path",
    "require example.com/lib/v2.1 v2.1.0": "invalid module path",
    "require gopkg.in/yaml v1.0.0": "invalid module path",
    "require gopkg.in/yaml.v3 v2.0.0": "should be v3, not v2",
    "exclude example.com/lib bad": "must be of the form v1.2.3",
    "replace example.com/lib => ../lib": None,
    "replace example.com/lib v1.0.0 => example.com/other v1.0.1": None,
    "replace example.com/lib => example.com/other": "must be directory path",
    "replace example.com/lib => ./lib v1.0.0": "cannot have version",
    "replace example.com/lib v9.0.0 => ../lib": "should be v0 or v1, not v9",
    "go 1.22.1": None,
    "go 1.21rc2": None,
    "go one": "invalid go version",
    "go 1.22\ngo 1.23": "repeated go statement",
    "module example.com/again": "repeated module statement",
}


def test_go_mod_versions_and_paths(spark):
    rows = [("r", f"{k}", at + 1, text) for k, body in enumerate(GO_MODS) for at, text in enumerate(f"module example.com/app\n\n{body}\n".split("\n"))]
    lines = spark.createDataFrame(rows, "root string, file string, line int, text string")
    got = {int(r.file): r.error for r in gomod.errors(gomod.statements(lines)).collect()}
    for k, (body, want) in enumerate(GO_MODS.items()):
        assert (got[k] is None) == (want is None) and (want or "") in (got[k] or ""), (body, got[k])
    block = "module m\nrequire (\n\texample.com/a v1.0.0 // indirect\n\texample.com/b/v3 v1.0.0\n)\n".split("\n")
    lines = spark.createDataFrame([("r", "f", at + 1, text) for at, text in enumerate(block)], "root string, file string, line int, text string")
    assert gomod.errors(gomod.statements(lines)).first().error == "f:4: example.com/b/v3@v1.0.0: invalid version: should be v3, not v1"


@pytest.mark.parametrize(("body", "fails"), [("[a]\nx = 1\n[b]\nx = 1\n", False), ("x = 1\nx = 2\n", False), ("[a]\nx = 1\n[a]\ny = 1\n", False), ("services = [{a = 1}]\n[[services]]\na = 2\n", False), ("a = {\n  x = 1,\n  y = 2,\n}\n", False), ("x = \n", True), ("[a\n", True), ("x = 1 y = 2\n", True), ("a = [1,\n", True)])
def test_forms_of_toml(spark, body, fails):
    """A manifest is read expression by expression: its form counts, and what is given twice passes."""
    df = spark.createDataFrame([("r", "p", "p", body.encode())], "root string, path string, rel string, content binary")
    assert (toml_tables.errors(df).filter("error is not null").count() == 1) == fails


def test_a_manifest_that_cannot_be_read_fails_its_pass(spark, tmp_path):
    for root, body in (("good", '[package]\nname = "a"\n'), ("bad", '[package]\nname = "a"\nname = \n')):
        (tmp_path / root).mkdir()
        (tmp_path / root / "Cargo.toml").write_text(body)
    roots = [str(tmp_path / "good"), str(tmp_path / "bad")]
    found = extract.Registry().gather(files.scan_local(spark, roots))
    assert {(r.root, r.ref) for r in found.facts.collect()} == {(roots[0], "a")}
    [failed] = found.failed.collect()
    assert (failed.extractor, failed.root) == ("cargo", roots[1]) and "Invalid value" in failed.error


VALUE = "registry.io/team/app:1.2.3-rc"


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("${X#*/}", "team/app:1.2.3-rc"),
        ("${X##*/}", "app:1.2.3-rc"),
        ("${X#nothing}", VALUE),
        ("${X%:*}", "registry.io/team/app"),
        ("${X%%/*}", "registry.io"),
        ("${X%-??}", "registry.io/team/app:1.2.3"),
        ("${X/team/crew}", "registry.io/crew/app:1.2.3-rc"),
        ("${X//./_}", "registry_io/team/app:1_2_3-rc"),
        ("${X/${Y:-team}/z}", "registry.io/z/app:1.2.3-rc"),
        ("${X#\\*}", VALUE),
        ("${Z#\\*}", "b*"),
        ("${Z//\\*/-}", "-b-"),
        ("${U%x}end", "end"),
        ("${X##${P}*/}", "app:1.2.3-rc"),
        ("${X/team}", "${X/team}"),
        ("${X#abc", "${X#abc"),
    ],
)
def test_patterns_of_build_arguments(word, want):
    assert expand(word, {"X": VALUE, "Z": "*b*", "P": "reg"}) == want


def test_unknown_kinds_are_listed(spark):
    def extractor(kind):
        return lambda _: spark.createDataFrame([("producer", "r", kind, f"x{k}", "f", k) for k in range(3)] + [("consumer", "r", schema.SERVICE, "s", "f", 1)], "role string, root string, kind string, ref string, file string, line int")

    registry = extract.Registry(unavailable=dict.fromkeys(extract.Registry().extractors(), "off"), extra={"good": extractor(schema.CRATE), "odd": extractor("go_modul")})
    found = registry.gather(spark.createDataFrame([], files.FILES))
    assert Counter((r.extractor, r.kind) for r in found.facts.collect()) == {("good", schema.CRATE): 3, ("good", schema.SERVICE): 1, ("odd", schema.SERVICE): 1}
    assert [tuple(r) for r in found.failed.collect()] == [("odd", "r", "unknown kind go_modul of x0")]


def test_facts_as_views(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "go.mod").write_text("module example.com/a\nrequire example.com/b v1.0.0\n")
    (tmp_path / "r" / "Dockerfile").write_text("FROM alpine:3\n")
    registry, scanned = extract.Registry(), files.scan_local(spark, [str(tmp_path / "r")])
    names = registry.create_views(scanned)
    assert names == ["facts_gomod", "facts_dockerfile", "facts_ci", "facts_gocode", "facts_cargo", "facts_wrangler", "facts_capnp"]
    every = Counter(tuple(r) for name in names for r in spark.sql(f"select * from {name}").collect())
    assert every == Counter(map(tuple, registry.gather(scanned).facts.collect()))
    assert spark.sql("select p.ref from facts_gomod p where p.role = 'producer'").first().ref == "example.com/a"


def _database(path, n, views=False, rowid=True):
    with sqlite3.connect(path) as db:
        db.executescript("create table nodes (id text, source_file text); create table _ast (node_id text, start_row int); create table node_refs (token text, node_id text);")
        db.execute("create table node_defs (token text, node_id text)" if rowid else "create table node_defs (token text, node_id text, primary key (token, node_id)) without rowid")
        db.executemany("insert into nodes values (?, ?)", ((str(k), f"f{k % 7}.go") for k in range(n)))
        db.executemany("insert into _ast values (?, ?)", ((str(k), k) for k in range(0, n, 2)))
        db.executemany("insert into node_defs values (?, ?)", ((f"p.N{k}", str(k)) for k in range(n)))
        db.executemany("insert into node_refs values (?, ?)", ((f"p.N{k}", str(n - 1 - k)) for k in range(n)))
        # gaps in the row numbers, a number as text, bytes as text, nothing
        db.executescript("delete from nodes where id = '5'; insert into nodes values (77777777, null); insert into nodes values (x'6162', 'b');")
        if views:
            db.executescript("create view v_defs as select token, node_id from node_defs where token <> 'p.N1'; create view v_refs as select token, node_id as referrer_node_id from node_refs;")
    db.close()
    return str(path)


@pytest.mark.parametrize(("views", "rowid"), [(False, True), (True, True), (False, False)])
def test_a_database_of_many_batches(spark, tmp_path, views, rowid):
    n = 45_000
    path = _database(tmp_path / "some file.db", n, views, rowid)
    found = symbol_db.read(spark, path, size=10_000)
    assert Counter(map(tuple, found["defs"].collect())) == Counter((f"p.N{k}", str(k)) for k in range(n) if not (views and k == 1))
    assert Counter(map(tuple, found["refs"].collect())) == Counter((f"p.N{k}", str(n - 1 - k)) for k in range(n))
    assert Counter(map(tuple, found["nodes"].collect())) == Counter([(str(k), f"f{k % 7}.go") for k in range(n) if k != 5] + [("77777777", None), ("ab", "b")])
    assert Counter(map(tuple, found["ast"].collect())) == Counter((str(k), k) for k in range(0, n, 2))
    assert found["nodes"].rdd.getNumPartitions() == 5 and found["defs"].rdd.getNumPartitions() == (1 if views or not rowid else 5)


def test_an_empty_database(spark, tmp_path):
    found = symbol_db.read(spark, _database(tmp_path / "e.db", 0))
    assert found["defs"].count() == 0 and found["nodes"].count() == 2
