"""Queries on the composite protocols of roles: training selection, calibration inputs, final layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators import protocols
from talweg.plans.registry import query
from talweg.plans.tables import SEED, assets, table

S = SparkSession
FIELDS = ("sample_id", "sha256", "text_hash", "parent_group_id")


def _ledger(spark: S) -> DataFrame:
    """Sources src0 to src13: of every third one the licence is pending, of the next it allows no training."""
    n = spark.range(14).select(F.concat(F.lit("src"), F.col("id")).alias("source_id"), F.col("id"))
    status = F.when(F.col("id") % 3 == 0, "pending").otherwise("verified")
    use = F.when(F.col("id") % 4 == 1, "none").when(F.col("id") % 4 == 2, "research_only").otherwise("product_allowed")
    return n.select("source_id", status.alias("status"), use.alias("train_dev_test_use"))


LEDGER = """l AS (SELECT 'src' || i AS source_id, CASE WHEN i % 3 = 0 THEN 'pending' ELSE 'verified' END AS status, CASE i % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'research_only' ELSE 'product_allowed' END AS use_ FROM range(14) t(i))"""


def _licence(rows: str) -> str:
    return f"""SELECT 'licence' AS rule, u.source_name AS key, CASE WHEN status IS NULL THEN 'missing' ELSE 'not_approved' END AS detail FROM (SELECT DISTINCT source_name FROM {rows}) u LEFT JOIN l ON l.source_id = u.source_name WHERE status IS NULL OR status <> 'verified'"""


def _uses(rows: str, uses: str) -> str:
    return f"""SELECT 'use' AS rule, source_id AS key, use_ AS detail FROM l WHERE source_id IN (SELECT source_name FROM {rows}) AND use_ NOT IN ({uses})"""


def _shared(a: str, b: str, fields: tuple[str, ...], rule: str) -> str:
    one = lambda f: f"SELECT '{rule}' AS rule, '{f}' AS key, count(*)::VARCHAR AS detail FROM (SELECT DISTINCT {f} FROM {a} WHERE {f} <> '' INTERSECT SELECT DISTINCT {f} FROM {b}) HAVING count(*) > 0"
    return " UNION ALL ".join(one(f) for f in fields)


@query(
    f"""WITH {{ASSETS}}, {LEDGER}, r AS (SELECT *, split AS role FROM a WHERE split IN ('train', 'dev') AND label <> 'unlabelled' AND source_name <> 'src2'),
p AS (SELECT DISTINCT role, source_name FROM r WHERE source_name <> 'src1' UNION SELECT 'dev', 'srcX'), t AS (SELECT * FROM r WHERE role = 'train'), d AS (SELECT * FROM r WHERE role = 'dev'),
c AS (SELECT role, language || '/' || label AS cell, count(*) AS n, count(*) + (language = 'de')::INT AS n_expected FROM r GROUP BY role, language, label)
SELECT 'sources' AS rule, h.role AS key, h.source_name || ': not planned' AS detail FROM (SELECT DISTINCT role, source_name FROM r) h WHERE (role, source_name) NOT IN (SELECT role, source_name FROM p)
UNION ALL SELECT 'sources', 'dev', 'srcX: absent'
UNION ALL SELECT 'cell', role || ':' || cell, n || '/' || n_expected FROM c WHERE n <> n_expected
UNION ALL {_licence("r")} UNION ALL {_uses("r", "'research_only', 'product_allowed'")} UNION ALL {_shared("t", "d", (*FIELDS, "source_name"), "overlap")}
UNION ALL SELECT 'dev lacks', x, 'language' FROM (VALUES ('de'), ('kk')) v(x) WHERE x NOT IN (SELECT language FROM d WHERE language IS NOT NULL)"""
)
def training_selection(spark: S, sf_dir: str) -> DataFrame:
    """Train and dev of all labelled documents against a plan that is wrong in one source of each kind and in every German cell."""
    a = assets(spark, sf_dir).where("split IN ('train', 'dev') AND label <> 'unlabelled' AND source_name <> 'src2'").withColumn("role", F.col("split"))
    planned = a.where("source_name <> 'src1'").select("role", "source_name").distinct().unionByName(spark.createDataFrame([("dev", "srcX")], "role string, source_name string"))
    cells = a.groupBy("role", "language", "label").agg(F.count("*").alias("n"))
    cells = cells.select("role", F.concat_ws("/", "language", "label").alias("cell"), (F.col("n") + F.when(F.col("language") == "de", 1).otherwise(0)).alias("n_expected"))
    return protocols.training_selection_issues(a, planned, cells, _ledger(spark), FIELDS, ["de", "kk"])


@query(
    f"""WITH {{ASSETS}}, {LEDGER}, r AS (SELECT *, (CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id - 1 END)::VARCHAR AS text_id FROM a WHERE split = 'test' AND label <> 'unlabelled'),
p AS (SELECT text_id, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS l, count(DISTINCT text_hash) AS h FROM r GROUP BY 1), t AS (SELECT * FROM a WHERE split = 'train'), d AS (SELECT * FROM a WHERE split = 'dev')
SELECT 'rows' AS rule, 'calibration' AS key, count(*)::VARCHAR AS detail FROM r HAVING count(*) <> 7
UNION ALL SELECT 'label', label, count(*)::VARCHAR FROM r GROUP BY label HAVING count(*) <> 4
UNION ALL SELECT 'scope', 'test/' || language, count(*)::VARCHAR FROM r WHERE language <> 'de' GROUP BY language
UNION ALL SELECT 'sources', 'calibration', source_name || ': not planned' FROM (SELECT DISTINCT source_name FROM r) WHERE source_name NOT IN ('src1', 'srcY') UNION ALL SELECT 'sources', 'calibration', 'srcY: absent'
UNION ALL SELECT 'sources', 'calibration', 'src1: absent' WHERE 'src1' NOT IN (SELECT source_name FROM r)
UNION ALL {_licence("r")} UNION ALL {_uses("r", "'research_only'")}
UNION ALL SELECT 'pairs', 'calibration', count(*)::VARCHAR FROM p HAVING count(*) <> 3
UNION ALL SELECT 'pair', text_id, l FROM p WHERE n <> 2 OR l <> 'bonafide,spoof' OR h <> 1
UNION ALL {_shared("r", "t", FIELDS, "overlap with train")} UNION ALL {_shared("r", "d", FIELDS, "overlap with dev")}"""
)
def calibration_inputs(spark: S, sf_dir: str) -> DataFrame:
    """All labelled test documents held against the plan of a small calibration set: every rule finds something."""
    a = assets(spark, sf_dir)
    text_id = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1).cast("string")
    rows = a.where("split = 'test' AND label <> 'unlabelled'").withColumn("text_id", text_id)
    plan = {"rows": 7, "labels": {"bonafide": 4, "spoof": 4}, "sources": ["src1", "srcY"], "pairs": 3, "split": "test", "language": "de"}
    return protocols.calibration_input_issues(rows, plan, _ledger(spark), {"train": a.where("split = 'train'"), "dev": a.where("split = 'dev'")}, FIELDS)


_FAMILIES = "CASE WHEN label = 'spoof' THEN 'fam' || (doc_id % 9) ELSE '' END AS generator_family"


@query(
    f"""WITH {{ASSETS}}, x AS (SELECT *, {_FAMILIES}, (doc_id % 5 = 0)::VARCHAR AS code_switch FROM a WHERE label <> 'unlabelled'),
f AS (SELECT *, CASE WHEN language = 'de' THEN 'layer-de' WHEN language = 'en' THEN 'layer-en' ELSE 'layer-other' END AS layer FROM x WHERE split = 'test'), o AS (SELECT *, split AS role FROM x WHERE split <> 'test' AND doc_id % 9 < 5 AND source_name <> 'src3'),
p AS (SELECT * FROM (VALUES ('layer-de', 10, 5, 'de'), ('layer-en', 1000000, 500000, 'en'), ('layer-none', 2, 1, 'kk')) v(layer, n_rows, n_pairs, language)),
g AS (SELECT layer, count(*) AS n, count(*) FILTER (label = 'spoof') AS s, count(*) FILTER (label = 'bonafide') AS b, count(DISTINCT text_hash) AS t FROM f GROUP BY 1), k AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(b, 0) AS b, coalesce(t, 0) AS t FROM p LEFT JOIN g USING (layer)),
r AS (SELECT layer AS role, * EXCLUDE (layer) FROM f UNION ALL BY NAME SELECT * FROM o), u AS (SELECT DISTINCT role, unnest(['sample_id', 'sha256', 'text_hash', 'parent_group_id']) AS field, unnest([sample_id, sha256, text_hash, parent_group_id]) AS value FROM r)
SELECT 'not planned' AS rule, layer AS key, n::VARCHAR AS detail FROM g WHERE layer NOT IN (SELECT layer FROM p)
UNION ALL SELECT 'rows', layer, n::VARCHAR FROM k WHERE n <> n_rows UNION ALL SELECT 'balance', layer, b || '/' || s FROM k WHERE s <> n_pairs OR b <> n_pairs UNION ALL SELECT 'texts', layer, t::VARCHAR FROM k WHERE t <> n_pairs
UNION ALL SELECT 'repeated text and label', layer, count(*)::VARCHAR FROM (SELECT layer FROM f GROUP BY layer, text_hash, label HAVING count(*) > 1) GROUP BY layer
UNION ALL SELECT 'scope', f.layer, count(*)::VARCHAR FROM f JOIN p USING (layer) WHERE f.language <> p.language OR code_switch <> 'false' GROUP BY 2
UNION ALL SELECT DISTINCT 'observed source', layer, source_name FROM f WHERE source_name IN (SELECT source_name FROM o)
UNION ALL SELECT DISTINCT 'observed family', layer, generator_family FROM f WHERE label = 'spoof' AND generator_family IN (SELECT generator_family FROM o WHERE label = 'spoof')
UNION ALL SELECT 'overlap', x.role || '/' || y.role || '/' || x.field, count(*)::VARCHAR FROM u x JOIN u y ON x.field = y.field AND x.value = y.value AND x.role < y.role GROUP BY 2"""
)
def final_layers(spark: S, sf_dir: str) -> DataFrame:
    """All labelled test documents as three final layers against what train and dev have observed."""
    family = F.when(F.col("label") == "spoof", F.concat(F.lit("fam"), F.col("doc_id") % 9)).otherwise("")
    a = assets(spark, sf_dir).where("label <> 'unlabelled'").withColumns({"generator_family": family, "code_switch": (F.col("doc_id") % 5 == 0).cast("string")})
    layer = F.when(F.col("language") == "de", "layer-de").when(F.col("language") == "en", "layer-en").otherwise("layer-other")
    layers = a.where("split = 'test'").withColumn("layer", layer)
    observed = a.where("split <> 'test' AND doc_id % 9 < 5 AND source_name <> 'src3'").withColumn("role", F.col("split"))
    plan = spark.createDataFrame([("layer-de", 10, 5, "de", "false"), ("layer-en", 1_000_000, 500_000, "en", "false"), ("layer-none", 2, 1, "kk", "false")], "layer string, n_rows long, n_pairs long, language string, code_switch string")
    return protocols.final_layer_issues(layers, observed, plan, FIELDS)


@query(
    f"""WITH RECURSIVE o AS (SELECT o_orderkey, 'g' || o_custkey AS grp, CASE WHEN o_orderkey % 2 = 0 THEN 'kk' ELSE 'ru' END AS lang, o_orderkey % 40 AS t FROM orders),
bad AS (SELECT DISTINCT grp FROM o WHERE o_orderkey % 503 = 0 OR substr(grp, 2)::BIGINT % 7 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || lang || ':' || o_orderkey)) AS i FROM o WHERE grp NOT IN (SELECT grp FROM bad) AND t <> 13),
w AS (SELECT lang, 0::BIGINT AS i, []::VARCHAR[] AS f, []::BIGINT[] AS d, false AS taken, target FROM (VALUES ('kk', 15), ('ru', 18)) v(lang, target)
  UNION ALL SELECT r.lang, r.i, CASE WHEN list_contains(f, grp) OR list_contains(d, t) THEN f ELSE list_append(f, grp) END, CASE WHEN list_contains(f, grp) OR list_contains(d, t) THEN d ELSE list_append(d, t) END,
    NOT (list_contains(f, grp) OR list_contains(d, t)), target FROM w JOIN r ON r.lang = w.lang AND r.i = w.i + 1 WHERE len(f) < target)
SELECT o_orderkey, r.lang, grp, row_number() OVER (PARTITION BY r.lang ORDER BY r.i)::INT AS position FROM w JOIN r ON r.lang = w.lang AND r.i = w.i WHERE taken"""
)
def final_inputs(spark: S, sf_dir: str) -> DataFrame:
    """Orders as candidate records: exposed groups screened out whole, texts normalised (one is rejected), then distinct in group and text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("g"), "o_custkey").alias("grp"), F.when(F.col("o_orderkey") % 2 == 0, "kk").otherwise("ru").alias("lang"))
    n = F.col("o_orderkey") % 40
    o = o.withColumns({"text": F.when(n == 13, "zzz").otherwise(F.concat(F.lit("METI "), n, F.when(F.col("lang") == "kk", "-тен").otherwise(" лет"))), "name": F.concat(F.lit("n"), "o_orderkey")})
    seen = o.where("o_orderkey % 503 = 0").select("name", F.lit("").alias("grp"))
    used = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.lit(None).cast("string").alias("name"), F.concat(F.lit("g"), "c_custkey").alias("grp"))
    out = protocols.final_inputs(o, {"seen": seen, "used": used}, key="o_orderkey", group="grp", text="text", language="lang", fields=["name", "grp"], seed=SEED, targets={"kk": 15, "ru": 18})
    return out.select("o_orderkey", "lang", "grp", "position")
