"""Queries on ledgers, consents and protocols, and on the remaining scalar functions and checks.

Rows of ledgers, consents and protocols are made from the given tables by expressions that mean the
same in both dialects; the rules themselves are written out once more in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg import schema
from talweg.functions import keys, text
from talweg.operators import graph, overlap, pairing, protocols, sampling, timeseries, validation
from talweg.plans.registry import query
from talweg.plans.tables import assets, table
from talweg.streaming import journal

S = SparkSession


def _made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).cast("string").alias(c) for c, e in columns.items()])


def _sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'CAST({e} AS VARCHAR) AS {c}' for c, e in columns.items())} FROM {source}"


LEDGER = {
    "source_id": "CASE WHEN i % 17 = 0 THEN ' ' ELSE concat('s', i) END",
    "usage_scope": "CASE WHEN i % 5 = 0 THEN 'personal' ELSE 'commercial_clean' END",
    "train_dev_test_use": "CASE WHEN i % 7 = 0 THEN 'allowed' WHEN i % 7 < 4 THEN ' Research_Only' ELSE 'product_allowed' END",
    "ood_evaluation_use": "CASE WHEN i % 11 = 0 THEN 'prohibited' WHEN i % 11 = 1 THEN '' ELSE 'product_allowed' END",
    "bonafide_group_provenance": "CASE WHEN i % 13 = 0 THEN 'guess' ELSE 'verified' END",
    "spoof_voice_group_provenance": "CASE WHEN i % 4 = 0 THEN 'not_applicable' ELSE 'Verified' END",
    "license": "CASE WHEN i % 19 = 0 THEN '' ELSE 'cc' END",
    "source_url": "'https://x.org'",
    "artifact_name": "concat('a', i)",
    "expected_size_bytes": "CASE WHEN i % 9 = 0 THEN '0' WHEN i % 9 = 1 THEN 'many' ELSE concat('', i) END",
    "last_modified_utc": "CASE WHEN i % 6 = 0 THEN '2026-02-30' WHEN i % 6 = 1 THEN '2026-02-03T10:00:00Z' WHEN i % 6 = 2 THEN 'May' ELSE '' END",
    "sha256": "CASE WHEN i % 3 = 0 THEN '' WHEN i % 10 = 0 THEN 'abc' ELSE repeat('Ab', 32) END",
    "rights_basis": "'r'",
    "status": "CASE WHEN i % 5 = 1 THEN 'pending' WHEN i % 5 = 2 THEN 'Owner_authorized_personal_research' ELSE 'verified' END",
    "notes": "CASE WHEN i % 23 = 0 THEN '' ELSE 'n' END",
}
DATE = r"regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}(T\d{{2}}:\d{{2}}:\d{{2}}Z)?') AND try_strptime({0}[1:10], '%Y-%m-%d') IS NOT NULL"


@query(
    f"""WITH r AS ({_sql(LEDGER, "(SELECT s_suppkey AS i FROM supplier)")}),
v AS (SELECT artifact_name AS row_name, list_filter([
  {", ".join(f"CASE WHEN trim({c}) = '' THEN '{c}: blank' END" for c in schema.LEDGER.names if c not in ("last_modified_utc", "sha256"))},
  CASE WHEN NOT regexp_full_match(expected_size_bytes, '[0-9]+') THEN 'expected_size_bytes: not an integer' WHEN expected_size_bytes = '0' THEN 'expected_size_bytes: not positive' END,
  CASE WHEN last_modified_utc <> '' AND NOT ({DATE.format("last_modified_utc")}) THEN 'last_modified_utc: not ISO-8601' END,
  CASE WHEN sha256 <> '' AND length(sha256) <> 64 THEN 'sha256: not a digest' END,
  CASE WHEN lower(trim(train_dev_test_use)) NOT IN ('product_allowed', 'research_only', 'prohibited') THEN 'train_dev_test_use: not allowed' END,
  CASE WHEN ood_evaluation_use NOT IN ('product_allowed', 'research_only', 'prohibited') THEN 'ood_evaluation_use: not allowed' END,
  CASE WHEN bonafide_group_provenance = 'guess' THEN 'bonafide_group_provenance: not allowed' END,
  CASE WHEN status <> 'pending' AND sha256 = '' THEN 'sha256: approved without digest' END], lambda x: x IS NOT NULL) AS issues FROM r)
SELECT row_name, array_to_string(issues, '; ') AS issues FROM v WHERE len(issues) > 0"""
)
def ledger_rows_issues(spark: S, sf_dir: str) -> DataFrame:
    rows = _made(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")), LEDGER)
    return rows.select(F.col("artifact_name").alias("row_name"), F.array_join(validation.ledger_issues(), "; ").alias("issues")).where("issues <> ''")


CONSENTS = {
    "consent_record_id": "CASE WHEN i % 11 = 0 THEN 'A B' ELSE concat('c-', i) END",
    "speaker_pseudo_id": "concat('spk', i % 400)",
    "language": "CASE WHEN i % 5 = 0 THEN 'other' WHEN i % 5 = 1 THEN 'RU' ELSE 'mixed' END",
    "collection_version": "CASE WHEN i % 13 = 0 THEN '' ELSE '1' END",
    "product_training_authorized": "CASE WHEN i % 7 = 0 THEN 'no' WHEN i % 7 = 1 THEN 'false' ELSE 'true' END",
    "synthetic_derivatives_authorized": "CASE WHEN i % 8 = 0 THEN 'false' ELSE 'True' END",
    "commercial_deployment_authorized": "'true'",
    "status": "CASE WHEN i % 4 = 0 THEN 'revoked' WHEN i % 31 = 0 THEN 'lost' ELSE 'active' END",
    "signed_at": "CASE WHEN i % 9 = 0 THEN 'today' ELSE '2026-01-02' END",
    "revoked_at": "CASE WHEN i % 6 = 0 THEN '2026-03-04' ELSE '' END",
}
_CONSENTS = _sql(CONSENTS, "(SELECT c_custkey AS i FROM customer)")


@query(
    f"""WITH r AS ({_CONSENTS}),
v AS (SELECT consent_record_id, speaker_pseudo_id, list_filter([
  CASE WHEN collection_version = '' THEN 'collection_version: blank' END,
  CASE WHEN consent_record_id = 'A B' THEN 'consent_record_id: not opaque' END,
  CASE WHEN language = 'other' THEN 'language: not allowed' END,
  CASE WHEN status = 'lost' THEN 'status: not allowed' END,
  CASE WHEN product_training_authorized = 'no' THEN 'product_training_authorized: not boolean' END,
  CASE WHEN signed_at = 'today' THEN 'signed_at: not ISO-8601' END,
  CASE WHEN status = 'active' AND revoked_at <> '' THEN 'revoked_at: set on active' END,
  CASE WHEN status = 'revoked' AND revoked_at = '' THEN 'revoked_at: missing' END], lambda x: x IS NOT NULL) AS issues FROM r)
SELECT consent_record_id, speaker_pseudo_id, array_to_string(issues, '; ') AS issues FROM v WHERE len(issues) > 0"""
)
def consent_rows_issues(spark: S, sf_dir: str) -> DataFrame:
    rows = _made(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i")), CONSENTS)
    return rows.select("consent_record_id", "speaker_pseudo_id", F.array_join(validation.consent_issues(), "; ").alias("issues")).where("issues <> ''")


@query(
    f"""WITH r AS ({_CONSENTS}), s AS (SELECT speaker_pseudo_id, product_training_authorized <> 'true' AS p, lower(synthetic_derivatives_authorized) <> 'true' AS d FROM r WHERE status = 'active')
SELECT speaker_pseudo_id, NOT bool_or(p OR d) AS eligible, concat_ws(',', CASE WHEN bool_or(p) THEN 'product_training_authorized' END, CASE WHEN bool_or(d) THEN 'synthetic_derivatives_authorized' END) AS missing,
  count(*)::BIGINT AS n_active FROM s GROUP BY 1"""
)
def eligible_speakers(spark: S, sf_dir: str) -> DataFrame:
    return validation.eligible_speakers(_made(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i")), CONSENTS))


PROTOCOL_LEDGER = {
    "source_id": "concat('src', i)",
    "status": "CASE WHEN i % 6 = 5 THEN 'pending' WHEN i % 6 = 4 THEN 'owner_authorized_personal_research' ELSE 'verified' END",
    "usage_scope": "CASE WHEN i % 4 = 3 THEN 'personal' ELSE 'commercial_clean' END",
    "train_dev_test_use": "CASE WHEN i % 5 = 2 THEN 'prohibited' WHEN i % 5 = 3 THEN 'research_only' ELSE 'product_allowed' END",
    "ood_evaluation_use": "CASE WHEN i % 3 = 2 THEN 'research_only' ELSE 'product_allowed' END",
    "bonafide_group_provenance": "CASE WHEN i % 7 = 6 THEN 'unknown' ELSE 'verified' END",
    "spoof_voice_group_provenance": "CASE WHEN i % 2 = 1 THEN 'source_provided' ELSE 'verified' END",
}
PROTOCOL = f"""WITH {{ASSETS}}, l AS ({_sql(PROTOCOL_LEDGER, "range(14) t(i)")}),
m AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'ood' WHEN split = 'test' THEN 'dev' ELSE split END AS split, source_name,
  CASE WHEN split = 'dev' OR doc_id % 2 = 0 THEN 'spoof' ELSE 'bonafide' END AS label, 'f' || (doc_id % 90) AS generator_family, 'v' || (doc_id % 45) AS voice_id FROM a),
q AS (SELECT * FROM m JOIN l ON source_id = source_name),
req AS (SELECT unnest(%s) AS split),
licence AS (SELECT 'source missing from the ledger' AS rule, source_name AS value FROM m WHERE source_name NOT IN (SELECT source_id FROM l)
  UNION SELECT 'source not approved', source_name FROM q WHERE status = 'pending'),
splits AS (SELECT 'split empty' AS rule, split AS value FROM req WHERE split NOT IN (SELECT split FROM m)
  UNION SELECT 'split lacks a label', split FROM m WHERE split IN (SELECT split FROM req) GROUP BY split HAVING count(DISTINCT label) < 2)
SELECT * FROM licence UNION SELECT * FROM splits"""


def _protocol(spark: S, sf_dir: str, purpose: str) -> DataFrame:
    doc = F.col("doc_id")
    split = F.when(doc % 9 == 0, "ood").when(F.col("split") == "test", "dev").otherwise(F.col("split"))
    label = F.when((F.col("split") == "dev") | (doc % 2 == 0), "spoof").otherwise("bonafide")
    rows = assets(spark, sf_dir).select(
        split.alias("split"), "source_name", label.alias("label"), F.concat(F.lit("f"), doc % 90).alias("generator_family"), F.concat(F.lit("v"), doc % 45).alias("voice_id")
    )
    return validation.training_protocol_issues(rows, _made(spark.range(14).withColumnRenamed("id", "i"), PROTOCOL_LEDGER), purpose)


@query(
    PROTOCOL.replace("%s", "['train', 'dev', 'test']")
    + " UNION SELECT 'use prohibited', source_name || ':train_dev_test_use' FROM q WHERE split IN (SELECT split FROM req) AND train_dev_test_use = 'prohibited'"
)
def research_protocol_issues(spark: S, sf_dir: str) -> DataFrame:
    return _protocol(spark, sf_dir, "research")


@query(
    PROTOCOL.replace("%s", "['train', 'dev', 'test', 'ood']")
    + """ UNION SELECT 'use not for products', source_name || ':train_dev_test_use' FROM q WHERE split <> 'ood' AND train_dev_test_use <> 'product_allowed'
UNION SELECT 'use not for products', source_name || ':ood_evaluation_use' FROM q WHERE split = 'ood' AND ood_evaluation_use <> 'product_allowed'
UNION SELECT 'status not verified', source_name FROM q WHERE status <> 'verified' UNION SELECT 'scope not commercial', source_name FROM q WHERE usage_scope = 'personal'
UNION SELECT 'groups not verified', source_name || ':' || label FROM q WHERE CASE label WHEN 'bonafide' THEN bonafide_group_provenance ELSE spoof_voice_group_provenance END <> 'verified'
UNION SELECT 'generator family in ood and elsewhere', generator_family FROM m WHERE label = 'spoof' GROUP BY generator_family HAVING bool_or(split = 'ood') AND bool_or(split <> 'ood')
UNION SELECT 'no generator family in ood', 'ood' FROM m WHERE label = 'spoof' AND split = 'ood' HAVING count(*) = 0
UNION SELECT 'voice in several splits', voice_id FROM q WHERE label = 'spoof' AND spoof_voice_group_provenance = 'verified' GROUP BY voice_id HAVING count(DISTINCT split) > 1"""
)
def product_protocol_issues(spark: S, sf_dir: str) -> DataFrame:
    return _protocol(spark, sf_dir, "product")


SUITE = """d AS (SELECT source AS test, 't' || (doc_id // 2) AS text, CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE 'h' || (doc_id // 2) END AS hashed, CASE WHEN doc_id % 2 = 0 OR doc_id % 77 = 0 THEN 'spoof' ELSE 'bonafide' END AS label, lang FROM documents)"""


@query(
    f"""WITH {SUITE}, p AS (SELECT test, text, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS l, count(DISTINCT hashed) AS h FROM d GROUP BY 1, 2),
s AS (SELECT lang, string_agg(DISTINCT test, ',' ORDER BY test) AS tests FROM d GROUP BY 1 HAVING count(DISTINCT test) > 1)
SELECT 'pair' AS rule, test || '/' || text AS key, l AS detail FROM p WHERE n <> 2 OR l <> 'bonafide,spoof' OR h <> 1
UNION ALL SELECT 'shared value', 'lang:' || lang, tests FROM s
UNION ALL SELECT 'too few tests', 'suite', n::VARCHAR FROM (SELECT count(DISTINCT test) AS n FROM d) WHERE n < 30"""
)
def unseen_suite_protocol(spark: S, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("test"),
        F.concat(F.lit("t"), F.floor(doc / 2)).alias("text"),
        F.when(doc % 50 == 0, "x").otherwise(F.concat(F.lit("h"), F.floor(doc / 2))).alias("hashed"),
        F.when((doc % 2 == 0) | (doc % 77 == 0), "spoof").otherwise("bonafide").alias("label"),
        "lang",
    )
    return protocols.unseen_suite_issues(d, "test", "text", "hashed", ["lang"], least=30)


@query(
    """WITH d AS (SELECT doc_id, lang AS language, 't' || (doc_id // 2) AS text_id, CASE WHEN doc_id % 60 = 0 THEN 'x' ELSE 'h' || (doc_id // 2) END AS text_hash, CASE WHEN doc_id % 2 = 0 THEN 'spoof' ELSE 'bonafide' END AS label, 'g' || (doc_id // 5) AS parent FROM documents),
f AS (SELECT * FROM d WHERE doc_id % 8 < 2), o AS (SELECT * FROM d WHERE doc_id % 8 >= 2),
p AS (SELECT language, text_id, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) <> 2 OR count(DISTINCT label) <> 2 OR count(DISTINCT text_hash) <> 1),
s AS (SELECT DISTINCT parent FROM f WHERE parent IN (SELECT parent FROM o))
SELECT 'pair' AS rule, language || '/' || text_id AS key, n::VARCHAR AS detail FROM p
UNION ALL SELECT 'overlap with train', 'parent', count(*)::VARCHAR || ',' || min(parent) FROM s HAVING count(*) > 0"""
)
def final_input_protocol(spark: S, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("language"),
        F.concat(F.lit("t"), F.floor(doc / 2)).alias("text_id"),
        F.when(doc % 60 == 0, "x").otherwise(F.concat(F.lit("h"), F.floor(doc / 2))).alias("text_hash"),
        F.when(doc % 2 == 0, "spoof").otherwise("bonafide").alias("label"),
        F.concat(F.lit("g"), F.floor(doc / 5)).alias("parent"),
    )
    return protocols.final_input_issues(d.where("doc_id % 8 < 2"), {"train": d.where("doc_id % 8 >= 2")}, ["parent"])


@query(
    """WITH r AS (SELECT source AS source_name, doc_id // 3 AS k, lang AS label FROM documents), g AS (SELECT source_name, k, count(DISTINCT label) AS n FROM r GROUP BY 1, 2)
SELECT source_name, count(*)::BIGINT AS n_rows, count(*) FILTER (n > 1)::BIGINT AS n_conflicts FROM g GROUP BY 1"""
)
def route_history(spark: S, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.floor(F.col("doc_id") / 3).alias("k"), F.col("lang").alias("label"))
    return protocols.route_history(rows, ["source_name", "k"], "label")


@query(
    """WITH {ASSETS}, k AS (SELECT DISTINCT 'parent_group_id' AS field, parent_group_id AS value, split = 'test' AS o FROM a UNION SELECT 'text_hash', text_hash, split = 'test' FROM a)
SELECT field, value FROM k GROUP BY 1, 2 HAVING count(*) = 2"""
)
def ood_leaks(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).withColumn("split", F.when(F.col("split") == "test", "ood").otherwise(F.col("split")))
    return graph.ood_leaks(a, ["parent_group_id", "text_hash"])


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000 AND o_orderstatus <> 'P', false)")
def outsider_rows(spark: S, sf_dir: str) -> DataFrame:
    return overlap.outsiders(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "P")).select("o_orderkey")


@query(
    """WITH l AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 10 <> 3), r AS (SELECT DISTINCT doc_id FROM labels)
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'right' ELSE 'left' END AS only_in FROM l FULL JOIN r ON l.doc_id = r.doc_id WHERE l.doc_id IS NULL OR r.doc_id IS NULL"""
)
def set_equality(spark: S, sf_dir: str) -> DataFrame:
    return pairing.set_equality(table(spark, sf_dir, "documents").where("doc_id % 10 <> 3"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'started' WHEN 1 THEN 'generated' WHEN 2 THEN 'failed' WHEN 3 THEN 'odd' END AS event,
  CASE WHEN event_id % 3 = 0 THEN repeat('a', 64) WHEN event_id % 3 = 1 THEN 'zz' END AS output_sha256, CASE WHEN event_id % 4 = 0 THEN 'boom' END AS error FROM events),
v AS (SELECT event_id, list_filter([CASE WHEN coalesce(event NOT IN ('started', 'generated', 'failed'), true) THEN 'event: not allowed' END,
  CASE WHEN event = 'generated' AND coalesce(length(output_sha256) <> 64, true) THEN 'output_sha256: missing' END, CASE WHEN event <> 'generated' AND output_sha256 IS NOT NULL THEN 'output_sha256: not generated' END,
  CASE WHEN event = 'failed' AND error IS NULL THEN 'error: missing' END, CASE WHEN event <> 'failed' AND error IS NOT NULL THEN 'error: not failed' END], lambda x: x IS NOT NULL) AS i FROM e)
SELECT event_id, array_to_string(i, '; ') AS issues FROM v WHERE len(i) > 0"""
)
def journal_event_issues(spark: S, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(k % 5 == 0, "started").when(k % 5 == 1, "generated").when(k % 5 == 2, "failed").when(k % 5 == 3, "odd").alias("event"),
        F.when(k % 3 == 0, F.repeat(F.lit("a"), 64)).when(k % 3 == 1, "zz").alias("output_sha256"),
        F.when(k % 4 == 0, "boom").alias("error"),
    )
    return rows.select("event_id", F.array_join(journal.event_issues(), "; ").alias("issues")).where("issues <> ''")


@query(
    """SELECT vec_id, list_transform(embedding[11:50], lambda x: x::DOUBLE)::VARCHAR AS cut, list_transform((embedding || embedding)[1:100], lambda x: x::DOUBLE)::VARCHAR AS filled
FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x * 100)::INT) AS embedding FROM embeddings WHERE len(embedding) = 64)"""
)
def fixed_crops(spark: S, sf_dir: str) -> DataFrame:
    hundred = F.lit(100).cast("float")  # in single precision, as the SQL multiplies
    e = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", F.transform("embedding", lambda x: F.round(x * hundred).cast("int")).alias("e"))

    def shown(values):
        return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.concat(x.cast("string"), F.lit(".0"))), ", ", "NULL"), F.lit("]"))

    return e.select("vec_id", shown(timeseries.cropped(F.col("e"), 40, 10)).alias("cut"), shown(timeseries.cropped(F.col("e"), 100)).alias("filled"))


@query(
    """SELECT doc_id, CASE WHEN lang IN ('fr', '') THEN NULL ELSE lang END AS known, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'first' END, lang) AS chosen,
  CASE WHEN doc_id % 4 = 0 THEN 'kept' WHEN doc_id % 4 = 1 THEN 'missing' ELSE 'digested' END AS status, CASE WHEN doc_id % 4 > 1 THEN sha256('a b ' || doc_id) END AS digest,
  'audio/' || substr(sha256('d' || doc_id), 1, 2) || '/' || sha256('d' || doc_id) || '.wav' AS path FROM documents"""
)
def identifiers_and_paths(spark: S, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    value = F.when(doc % 4 == 0, F.concat(F.lit("id-"), doc)).when(doc % 4 == 1, " ").otherwise(F.concat(F.lit("a b "), doc))
    named = text.identifier(value)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.unknown_to_null(F.col("lang"), ("fr", "")).alias("known"),
        text.first_non_empty(F.when(doc % 3 == 0, " ").when(doc % 3 == 1, "first"), F.col("lang")).alias("chosen"),
        named["status"].alias("status"),
        named["sha256"].alias("digest"),
        keys.content_path(F.sha2(F.concat(F.lit("d"), doc), 256), ".wav", "audio").alias("path"),
    )


@query(
    """WITH n AS (SELECT lang, source, count(*)::BIGINT AS n_rows FROM documents GROUP BY 1, 2)
SELECT * FROM n WHERE n_rows % 4 <> 0 OR (SELECT min(n_rows) <> max(n_rows) FROM n)"""
)
def uneven_batch_cells(spark: S, sf_dir: str) -> DataFrame:
    return sampling.uneven_cells(table(spark, sf_dir, "documents"), ["lang", "source"], 4)


@query(
    """WITH c AS (SELECT DISTINCT source, lang, doc_id % 40 AS v FROM documents WHERE doc_id % 2 = 0), h AS (SELECT DISTINCT source, lang, doc_id % 40 AS v FROM documents WHERE doc_id % 2 = 1 AND lang <> 'es' UNION SELECT 'src1', 'xx', 4),
g AS (SELECT source, lang, coalesce(bool_or(v IN (SELECT v FROM h)), false) AS alias_known FROM c GROUP BY 1, 2)
SELECT source, lang, (source, lang) NOT IN (SELECT (source, lang) FROM h) AS novel, source IN (SELECT source FROM h) AS family_known, alias_known FROM g"""
)
def route_alias_disclosure(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 40).alias("v"))
    past = d.where("doc_id % 2 = 1 AND lang <> 'es'").select("source", "lang", "v").union(spark.createDataFrame([("src1", "xx", 4)], "source string, lang string, v long"))
    return overlap.route_exposure(d.where("doc_id % 2 = 0"), past, ("source", "lang"), F.col("v"))
