"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# The manifest-like view that most queries start from, in SQL.
ASSETS = """assets AS (
  SELECT 'doc:' || d.doc_id AS sample_id, sha256(text) AS sha256,
         sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_hash,
         lang AS language, source AS source_name, 'grp:' || (d.doc_id // 4) AS parent_group_id,
         'spk:' || (d.doc_id // 8) AS speaker_pseudo_id,
         CASE quality WHEN 1 THEN 'bonafide' WHEN 0 THEN 'spoof' ELSE 'unlabelled' END AS label,
         d.doc_id AS doc_id, n_chars,
         ('0x' || substr(sha256('20260808:doc:' || d.doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM assets)"""


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("{ASSETS}", ASSETS)
        return f

    return add
