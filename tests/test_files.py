from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def test_discovery_counts_records(spark, tmp_path):
    from talweg.sources import files as L

    (tmp_path / "a.csv").write_bytes('﻿id,text\r\n1,"two\nlines, and a comma"\r\n2,"a ""quote"""\r\n\r\n3,x\r\n'.encode())
    (tmp_path / "b.csv").write_text("id,other\n1,2\n")
    (tmp_path / "c.csv").write_bytes(b"\xff\xfe\x00id,text\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("more,text,id\n")
    got = {r["path"].rpartition("/")[2]: r for r in L.discovered(spark, str(tmp_path), ["id", "text"]).collect()}
    assert set(got) == {"a.csv", "e.csv"} and got["a.csv"]["rows"] == 3 and got["e.csv"]["rows"] == 0
    raw = (tmp_path / "a.csv").read_bytes()
    assert got["a.csv"]["length"] == len(raw) and got["a.csv"]["sha256"] == hashlib.sha256(raw).hexdigest()
    (tmp_path / "f.csv").write_text('id,text\n1,"a\nb"\n2\n3,x,y\n')
    faults = {(r["path"].rpartition("/")[2], r["record"], r["n_fields"]) for r in L.structural_faults(spark, str(tmp_path), pattern="*.csv").collect()}
    assert faults == {("f.csv", 3, 1), ("f.csv", 4, 3), ("c.csv", -1, -1)}


def test_footers_and_release_faults(spark, tmp_path):
    from talweg.sources import files as L

    def write(name, table, **meta):
        pq.write_table(table.replace_schema_metadata({k: v for k, v in meta.items()}), tmp_path / name)

    one = pa.table({"id": pa.array([1, 2], pa.int64()), "text": ["a", "b"]})
    write("a.parquet", one, release="r1")
    write("b.parquet", one, release="r2")
    columns = ["id:int64", "text:string"]
    found = L.footers(spark, str(tmp_path))
    assert {(r["rows"], tuple(r["columns"])) for r in found.collect()} == {(2, tuple(columns))}
    faults = lambda **kw: sorted((r["path"] and r["path"].rpartition("/")[2], r["fault"]) for r in L.release_faults(L.footers(spark, str(tmp_path)), columns, **kw).collect())
    assert faults() == [] and faults(files=2, rows=4) == []
    assert faults(metadata={"release": "r1"}) == [("b.parquet", "metadata: release")]
    write("c.parquet", one.select(["text", "id"]), release="r1")
    write("d.parquet", one.append_column("more", [[1, 2]]), release="r1")
    (tmp_path / "e.parquet").write_bytes(b"PAR1 not")
    got = {r for r in [(r["path"] and r["path"].rpartition("/")[2], r["fault"]) for r in L.release_faults(L.footers(spark, str(tmp_path)), columns, files=2, rows=4).collect()]}
    assert {("c.parquet", "order of columns"), ("d.parquet", "columns not expected: more:int64"), (None, "mixed"), (None, "files: 5"), (None, "rows: 8")} <= got
    assert [f for p, f in got if p == "e.parquet"][0].startswith("unreadable")


def test_a_ledger_names_each_source_once(spark, tmp_path):
    from talweg import schema as S
    from talweg.sources import tables as T

    line = lambda k: ",".join([k] + ["x"] * (len(S.LEDGER.names) - 1))
    at = S.LEDGER.names.index("source_id")
    assert at == 0
    (tmp_path / "l.csv").write_text("\n".join([",".join(S.LEDGER.names), line("a"), line("b")]) + "\n")
    assert T.read_ledger(spark, f"{tmp_path}/l.csv").count() == 2
    (tmp_path / "m.csv").write_text("\n".join([",".join(S.LEDGER.names), line("a"), line("b"), line("a")]) + "\n")
    with pytest.raises(ValueError, match="repeated source_id: \\['a'\\]"):
        T.read_ledger(spark, f"{tmp_path}/m.csv")
