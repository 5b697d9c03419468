"""Queries against their SQL on small odd tables."""

from __future__ import annotations

import duckdb
import pytest

from talweg.plans import ORACLES, QUERIES

EVENTS = """SELECT (row_number() OVER ())::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM (
  SELECT i // 40 AS user_id, TIMESTAMP '2024-01-01' + to_microseconds((hash(i) % 122)::BIGINT * 21600000000 + [-500001, -500000, -499999, 499999, 500000, 0][i % 6 + 1]) AS ts FROM range(400) t(i)
  UNION ALL SELECT 20 + i, TIMESTAMP '2024-01-01 05:59:59' + to_microseconds([499999, 500000, 500001][i]) FROM range(3) t(i)
  UNION ALL SELECT 23 + i % 2, TIMESTAMP '2024-01-01' + to_hours(6 * (i // 2)) + to_microseconds(CASE i % 2 WHEN 0 THEN 21599500000 ELSE 0 END) FROM range(12) t(i)
  UNION ALL SELECT 30, TIMESTAMP '1969-12-31' + to_hours(i * 4) FROM range(12) t(i)
  UNION ALL SELECT * FROM (VALUES (31, NULL), (31, TIMESTAMP '2024-01-03'), (NULL, TIMESTAMP '2024-01-03'), (NULL, NULL)) v)"""


@pytest.mark.parametrize("name", ["activity_islands", "gap_merge_segments", "right_aligned_windows"])
def test_frames_are_those_of_sql(spark, tmp_path, name):
    db = duckdb.connect()
    db.sql(f"COPY ({EVENTS}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    rel = db.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_crops_are_those_of_sql(spark, tmp_path):
    db = duckdb.connect()
    # hundredths and a half, whose product with 100 is a half in single precision only or in double precision only
    db.sql(f"""COPY (SELECT k AS vec_id, list_transform(range(64), lambda i: ((CASE i % 2 WHEN 0 THEN 1 ELSE -1 END) * (k * 64 + i + 0.5) / 100)::FLOAT) AS embedding, 0 AS label FROM range(40) t(k)
      UNION ALL SELECT 40, list_transform(range(64), lambda i: CASE WHEN i % 9 > 0 THEN i::FLOAT END), 0 UNION ALL SELECT 41, [1.0::FLOAT], 0 UNION ALL SELECT 42, NULL, 0) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    rel = db.sql(ORACLES["fixed_crops"])
    got = QUERIES["fixed_crops"](spark, str(tmp_path)).select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_events_without_a_value_have_no_tone(spark, tmp_path):
    from talweg.plans.evaluation import _waveforms

    rows = "(0, TIMESTAMP '2024-01-01', 1, 'view', 2.5), (1, TIMESTAMP '2024-01-01 01:00:00', 1, 'view', NULL), (2, TIMESTAMP '2024-01-02', 1, 'error', 2.5)"
    duckdb.sql(f"COPY (SELECT e::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value FROM (VALUES {rows}) x(e, t, u, k, v)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    waves = {str(r["day"]): r for r in _waveforms(spark, str(tmp_path)).collect()}
    first, second = waves["2024-01-01"]["samples"], waves["2024-01-02"]
    assert len(first) == 960 and None not in first[:480] and set(first[480:]) == {None} and second["active"] == second["samples"] and None not in second["active"]
    got = {r["sample"]: r["n_samples"] for r in QUERIES["augmented_waveforms"](spark, str(tmp_path)).collect()}
    assert got == {"1/2024-01-01": None, "1/2024-01-02": 480}
