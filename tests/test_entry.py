from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lodegraph import cli


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("Use `Run` here, and `Gone`.\n")
    (tmp_path / "a.go").write_text("package p\n\nfunc Run() {}\nfunc Zzqx() {}\n")
    assert cli.main(["verify", "--source", str(tmp_path)], spark) == 0
    assert "Coverage:  1/2 (50.0%)" in capsys.readouterr().out
    assert cli.main(["verify", "--source", str(tmp_path), "--max-uncovered", "0"], spark) == 2
    assert "1 uncovered entity (budget 0): p.Zzqx" in capsys.readouterr().err
    assert cli.main(["map", str(tmp_path), "--format", "json"], spark) == 0
    assert '"artifacts"' in capsys.readouterr().out
    assert cli.main(["version"], spark) == 0
    capsys.readouterr()
    # the same report written by executors, and of folders that they walk
    assert cli.main(["verify", "--source", str(tmp_path), "--docs", str(tmp_path / "docs"), "--shared", "--format", "json"], spark) == 0
    said = capsys.readouterr().out
    out = tmp_path / "out"
    assert cli.main(["verify", "--source", str(tmp_path), "--format", "json", "--output", str(out)], spark) == 0
    assert capsys.readouterr().out == "" and "".join(f.read_text() for f in sorted(out.glob("*/part-*"))) == said and '"total_entities": 2' in said


def test_symbol_database_verifier_refuses(spark, capsys):
    assert cli.main(["verify", "--verifier", "symbol-db"], spark) == 2


@pytest.mark.parametrize("name", ["bucket_counts", "coverage_summary"])
def test_against_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "lineitem", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()
