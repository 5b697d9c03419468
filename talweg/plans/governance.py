"""Queries on validation, overlap, pairing and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.functions.keys import rank_hex
from talweg.operators import graph, overlap, pairing, protocols, sampling, validation
from talweg.plans.registry import query
from talweg.plans.tables import SEED, assets, table
from talweg.sources import projection
from talweg.storage import stored

FIELDS = ("parent_group_id", "speaker_pseudo_id", "text_hash")
S = SparkSession


@query(
    """WITH {ASSETS}, m AS (SELECT sample_id, CASE WHEN doc_id % 13 = 0 THEN 'zz' ELSE sha256 END AS sha256,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE source_name END AS source_name,
  CASE WHEN doc_id % 19 = 0 THEN '../x.wav' ELSE language || '/' || doc_id || '.wav' END AS relative_path, split, label, language,
  CASE WHEN label = 'spoof' OR doc_id % 11 = 0 THEN source_name ELSE '' END AS generator_family,
  CASE WHEN label = 'spoof' AND doc_id % 7 <> 0 THEN 'v' ELSE '' END AS voice_id, n_chars FROM a),
r AS (SELECT sample_id, CASE
  WHEN source_name = '' THEN ['source_name: blank']
  WHEN NOT regexp_full_match(lower(sha256), '[0-9a-f]{64}') THEN ['sha256: not a digest']
  WHEN relative_path LIKE '..%' THEN ['relative_path: not portable']
  ELSE list_filter([
    CASE WHEN label NOT IN ('bonafide', 'spoof') THEN 'label: not allowed' END,
    CASE WHEN language NOT IN ('en', 'fr', 'es') THEN 'language: not allowed' END,
    CASE WHEN n_chars / 15.0 <= 20 THEN 'duration_s: not positive' END,
    CASE WHEN label = 'spoof' AND voice_id = '' THEN 'spoof lacks voice_id' END,
    CASE WHEN label = 'bonafide' AND generator_family <> '' THEN 'bonafide has generator_family' END], lambda x: x IS NOT NULL) END AS issues FROM m)
SELECT sample_id, unnest(issues) AS issue FROM r"""
)
def validate_rows_issues(spark: S, sf_dir: str) -> DataFrame:
    """Row rules with short-circuit and accumulated issues; the shortest 300 characters stand for no duration."""
    a, doc = assets(spark, sf_dir), F.col("doc_id")
    rows = a.withColumns(
        {
            "sha256": F.when(doc % 13 == 0, "zz").otherwise(F.col("sha256")),
            "relative_path": F.when(doc % 19 == 0, "../x.wav").otherwise(F.concat("language", F.lit("/"), doc, F.lit(".wav"))),
            "generator_family": F.when((F.col("label") == "spoof") | (doc % 11 == 0), F.col("source_name")).otherwise(""),
            "voice_id": F.when((F.col("label") == "spoof") & (doc % 7 != 0), "v").otherwise(""),
            "duration_s": F.when(F.col("n_chars") / 15.0 <= 20, "0").otherwise("1.5"),
        }
    ).withColumn("source_name", F.when(doc % 17 == 0, "").otherwise(F.col("source_name")))
    for name in ("generator_name", "generator_version"):
        rows = rows.withColumn(name, F.when(F.col("label") == "spoof", "g").otherwise(""))
    given = ("source_license", "rights_basis", "text_id", "codec", "device", "capture_route")
    rows = rows.withColumns({n: F.lit("x") for n in given} | {"code_switch": F.lit("unknown"), "original_sr": F.lit("16000"), "created_at": F.lit("2026-08-08T00:00:00Z")})
    return validation.issues_of(rows, validation.manifest_issues(("en", "fr", "es")), "sample_id")


@query(
    """WITH {ASSETS}, v AS (SELECT 'sha256' AS field, sha256 AS value FROM a UNION ALL SELECT 'text_hash', text_hash FROM a),
g AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL HAVING count(*) > 1)
SELECT field, value, unnest(range(2, n + 1))::BIGINT AS occurrence FROM g"""
)
def duplicate_keys(spark: S, sf_dir: str) -> DataFrame:
    return validation.duplicate_occurrences(assets(spark, sf_dir), ("sha256", "text_hash"))


@query(
    """WITH {ASSETS}, v AS (SELECT 'parent_group_id' AS field, parent_group_id AS value, split FROM a
  UNION ALL SELECT 'speaker_pseudo_id', speaker_pseudo_id, split FROM a UNION ALL SELECT 'text_hash', text_hash, split FROM a)
SELECT field, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM v GROUP BY field, value HAVING count(DISTINCT split) > 1"""
)
def cross_split_leakage(spark: S, sf_dir: str) -> DataFrame:
    return validation.cross_split_leakage(assets(spark, sf_dir), FIELDS)


@query(
    """WITH {ASSETS}, r AS (SELECT source_name AS family, CASE WHEN source_name IN ('src1', 'src2') OR (source_name = 'src3' AND doc_id % 2 = 0) THEN 'ood' ELSE split END AS split
  FROM a WHERE label = 'spoof')
SELECT family, count(*) FILTER (split = 'ood')::BIGINT AS n_ood, count(*) FILTER (split <> 'ood')::BIGINT AS n_other,
  count(*) FILTER (split <> 'ood') = 0 AS isolated FROM r GROUP BY family HAVING count(*) FILTER (split = 'ood') > 0"""
)
def ood_family_isolation(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    ood = F.col("source_name").isin("src1", "src2") | ((F.col("source_name") == "src3") & (F.col("doc_id") % 2 == 0))
    a = a.withColumn("split", F.when(ood, "ood").otherwise(F.col("split")))
    return validation.ood_families(a.withColumn("generator_family", F.col("source_name")))


def _ledger(spark: S) -> DataFrame:
    ids = spark.range(14)
    return ids.select(F.concat(F.lit("src"), "id").alias("source_id"), F.when(F.col("id") % 3 == 0, "pending").when(F.col("id") % 3 == 1, "verified").otherwise("owner_authorized_personal_research").alias("status"))


@query(
    """WITH l AS (SELECT 'src' || i AS source, CASE WHEN i % 3 = 0 THEN 'pending' WHEN i % 3 = 1 THEN 'verified' ELSE 'owner_authorized_personal_research' END AS status FROM range(14) t(i)),
u AS (SELECT DISTINCT source FROM documents)
SELECT u.source, CASE WHEN status IS NULL THEN 'missing' ELSE 'not_approved' END AS problem FROM u LEFT JOIN l USING (source) WHERE status IS NULL OR status NOT IN ('verified', 'owner_authorized_personal_research')"""
)
def ledger_coverage(spark: S, sf_dir: str) -> DataFrame:
    return validation.ledger_coverage(table(spark, sf_dir, "documents").select(F.col("source").alias("source_name")), _ledger(spark))


@query(
    """WITH r AS (SELECT source AS value, lang AS role FROM documents)
SELECT value, count(DISTINCT role)::BIGINT AS n_roles, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM r GROUP BY value HAVING count(DISTINCT role) > 1"""
)
def role_source_disjoint(spark: S, sf_dir: str) -> DataFrame:
    return validation.shared_by_roles(table(spark, sf_dir, "documents"), "source", "lang")


@query(
    """WITH {ASSETS}, c AS (SELECT DISTINCT * FROM (SELECT 'parent_group_id' AS field, parent_group_id AS value, split FROM a
  UNION ALL SELECT 'speaker_pseudo_id', speaker_pseudo_id, split FROM a UNION ALL SELECT 'text_hash', text_hash, split FROM a))
SELECT x.field, count(*)::BIGINT AS n_overlap, min(x.value) AS example FROM c x JOIN c y ON x.field = y.field AND x.value = y.value
WHERE x.split = 'test' AND y.split = 'train' GROUP BY x.field"""
)
def overlap_by_field(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    return overlap.overlap_by_field(a.where("split = 'test'"), a.where("split = 'train'"), FIELDS)


@query(
    """WITH {ASSETS}, c AS (SELECT DISTINCT * FROM (SELECT 'parent_group_id' AS field, parent_group_id AS value, split FROM a
  UNION ALL SELECT 'speaker_pseudo_id', speaker_pseudo_id, split FROM a UNION ALL SELECT 'text_hash', text_hash, split FROM a))
SELECT x.split AS role_a, y.split AS role_b, x.field, count(*)::BIGINT AS n_values FROM c x JOIN c y ON x.field = y.field AND x.value = y.value AND x.split < y.split GROUP BY ALL"""
)
def pairwise_role_overlap(spark: S, sf_dir: str) -> DataFrame:
    return overlap.pairwise_role_overlap(assets(spark, sf_dir), "split", FIELDS)


@query("SELECT o_custkey AS key, count(DISTINCT o_orderpriority)::BIGINT AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def functional_dependency(spark: S, sf_dir: str) -> DataFrame:
    return validation.functional_violations(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    """WITH {ASSETS}, t AS (SELECT * FROM a WHERE split = 'train'), c AS (SELECT * FROM a WHERE split = 'dev'),
d AS (SELECT sample_id, text_hash, list_filter([
  CASE WHEN sha256 IN (SELECT sha256 FROM t) THEN 'sha256' END,
  CASE WHEN parent_group_id IN (SELECT parent_group_id FROM t) THEN 'parent_group_id' END,
  CASE WHEN text_hash IN (SELECT text_hash FROM t) THEN 'text_hash' END], lambda x: x IS NOT NULL) AS direct FROM c),
h AS (SELECT DISTINCT text_hash FROM d WHERE len(direct) > 0)
SELECT sample_id, array_to_string(CASE WHEN len(direct) > 0 THEN direct WHEN text_hash IN (SELECT text_hash FROM h) THEN ['paired_text_group'] ELSE [] END, ',') AS reasons FROM d"""
)
def anti_join_reasons(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    out = overlap.anti_join_reasons(a.where("split = 'dev'"), a.where("split = 'train'"), ("sha256", "parent_group_id", "text_hash"), "sample_id")
    return out.select("sample_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH {ASSETS}, h AS (SELECT * FROM a WHERE doc_id % 10 = 3)
SELECT sample_id FROM a WHERE parent_group_id NOT IN (SELECT parent_group_id FROM h) AND text_hash NOT IN (SELECT text_hash FROM h)"""
)
def group_taint_exclusion(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", "doc_id", "parent_group_id", "text_hash")
    return overlap.group_taint_exclusion(a, a.where("doc_id % 10 = 3"), "sample_id", ("parent_group_id", "text_hash")).select("sample_id")


@query(
    """WITH l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
b AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark)
SELECT doc_id, count(*)::BIGINT AS n_lines FROM l SEMI JOIN b USING (line) WHERE line <> '' GROUP BY doc_id"""
)
def benchmark_contamination(spark: S, sf_dir: str) -> DataFrame:
    """Documents that share whole lines with the benchmark, by set intersection."""
    def lines(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''").distinct()

    d, b = lines(table(spark, sf_dir, "documents"), "doc_id"), lines(table(spark, sf_dir, "benchmark"))
    return d.join(b, "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(
    """WITH {ASSETS}, f AS (SELECT *, doc_id % 10 = 3 AS hit, n_chars < 200 AS short FROM a)
SELECT sample_id, bool_or(hit) OVER w AS group_hit, bool_or(short) OVER w AS group_short FROM f WINDOW w AS (PARTITION BY parent_group_id)"""
)
def group_screen(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", "doc_id", "n_chars", "parent_group_id")
    out = overlap.group_screen(a, {"hit": F.col("doc_id") % 10 == 3, "short": F.col("n_chars") < 200}, "parent_group_id")
    return out.select("sample_id", "group_hit", "group_short")


@query(
    """WITH {ASSETS}, p AS (SELECT * FROM a WHERE split = 'train'), q AS (SELECT * FROM a WHERE split = 'dev'), c AS (SELECT * FROM a WHERE split = 'test')
SELECT parent_group_id, count(*)::BIGINT AS n_rows, count(*) FILTER (sha256 IN (SELECT sha256 FROM p))::BIGINT AS n_train_sha256,
  count(*) FILTER (speaker_pseudo_id IN (SELECT speaker_pseudo_id FROM p))::BIGINT AS n_train_speaker_pseudo_id,
  count(*) FILTER (sha256 IN (SELECT sha256 FROM q))::BIGINT AS n_dev_sha256,
  count(*) FILTER (speaker_pseudo_id IN (SELECT speaker_pseudo_id FROM q))::BIGINT AS n_dev_speaker_pseudo_id FROM c GROUP BY 1"""
)
def group_screen_counts(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    scopes = {"train": a.where("split = 'train'"), "dev": a.where("split = 'dev'")}
    return overlap.screened_groups(a.where("split = 'test'"), scopes, ("sha256", "speaker_pseudo_id"), "parent_group_id").drop("clean")


@query(
    """WITH {ASSETS}, c AS (SELECT * FROM a WHERE split = 'test'), fs AS (SELECT * FROM (VALUES ('sha256', true), ('parent_group_id', false)) t(field, blocking)),
n AS (SELECT s.split AS scope, 'sha256' AS field, count(DISTINCT c.sha256) AS n FROM c JOIN a s ON c.sha256 = s.sha256 WHERE s.split <> 'test' GROUP BY 1
  UNION ALL SELECT s.split, 'parent_group_id', count(DISTINCT c.parent_group_id) FROM c JOIN a s ON c.parent_group_id = s.parent_group_id WHERE s.split <> 'test' GROUP BY 1)
SELECT sc.scope, fs.field, coalesce(n.n, 0)::BIGINT AS n_overlap, fs.blocking FROM (VALUES ('train'), ('dev')) sc(scope) CROSS JOIN fs LEFT JOIN n ON n.scope = sc.scope AND n.field = fs.field"""
)
def exposure_audit(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    scopes = {s: a.where(F.col("split") == s) for s in ("train", "dev")}
    return overlap.exposure_audit(a.where("split = 'test'"), scopes, ("sha256", "parent_group_id"), ("sha256",))


@query(
    """WITH {ASSETS}, c AS (SELECT sample_id, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE language END AS language, CASE WHEN doc_id % 14 = 0 THEN NULL ELSE source_name END AS source_name FROM a)
SELECT sample_id, array_to_string(list_filter([CASE WHEN c.language IS DISTINCT FROM a.language THEN 'language' END, CASE WHEN c.source_name IS DISTINCT FROM a.source_name THEN 'source_name' END], lambda x: x IS NOT NULL), ',') AS broken
FROM c JOIN a USING (sample_id) WHERE c.language IS DISTINCT FROM a.language OR c.source_name IS DISTINCT FROM a.source_name"""
)
def lineage_binding(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", "doc_id", "language", "source_name")
    c = a.withColumns({"language": F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("language")), "source_name": F.when(F.col("doc_id") % 14 != 0, F.col("source_name"))})
    return overlap.lineage_breaks(c, a, "sample_id", ("language", "source_name")).select("sample_id", F.array_join("broken", ",").alias("broken"))


@query("WITH c AS (SELECT o_orderkey, o_custkey % 50 AS o_custkey FROM orders) SELECT o_orderkey, o_custkey FROM (SELECT * FROM c EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders)")
def exact_row_binding(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return overlap.unbound_rows(o.withColumn("o_custkey", F.col("o_custkey") % 50), o)


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(c_name), '00011')")
def substring_match(spark: S, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return overlap.mentions(c, "BUILD", ["c_mktsegment"]).select("c_custkey").union(overlap.mentions(c, "00011", ["c_name"]).select("c_custkey")).distinct()


@query(
    """WITH r AS (SELECT source AS test, lang AS value, 'lang' AS field FROM documents), s AS (SELECT field, value, test FROM r WHERE test <> 'src0')
SELECT field, value, min(test) AS first_test, string_agg(DISTINCT test, ',' ORDER BY test) AS tests FROM s GROUP BY 1, 2 HAVING count(DISTINCT test) > 1"""
)
def test_isolation(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("test"), F.col("source").alias("ord"), "lang")
    return overlap.test_isolation(d, "test", "ord", ("lang",), F.col("test") == "src0")


@query(
    """WITH {ASSETS}, c AS (SELECT DISTINCT source_name, language FROM a WHERE split = 'test'), h AS (SELECT DISTINCT source_name, language FROM a WHERE split = 'dev' AND source_name <> 'src4' AND language <> 'fr')
SELECT c.source_name, c.language, h.source_name IS NULL AS novel, c.source_name IN (SELECT source_name FROM h) AS family_known FROM c LEFT JOIN h USING (source_name, language)"""
)
def route_novelty(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    past = a.where("split = 'dev' AND source_name <> 'src4' AND language <> 'fr'")
    return overlap.route_exposure(a.where("split = 'test'"), past, ("source_name", "language"))


@query(
    """SELECT conv_id, count(*)::BIGINT AS n_rows, string_agg(DISTINCT role, ',' ORDER BY role) AS labels,
  count(*) = 2 AND count(DISTINCT role) = 2 AND min(role) = 'assistant' AND max(role) = 'user' AS complete FROM conversations GROUP BY conv_id"""
)
def exact_pairs(spark: S, sf_dir: str) -> DataFrame:
    return pairing.pair_groups(table(spark, sf_dir, "conversations"), "conv_id", "role", ("user", "assistant"))


@query(
    """WITH {ASSETS}, t AS (SELECT parent_group_id AS text_id, min(sample_id) AS source_id, min_by(text_hash, sample_id) AS ha FROM a WHERE doc_id % 2 = 0 GROUP BY 1),
s AS (SELECT parent_group_id AS text_id, min(sample_id) AS spoof_id, min_by(text_hash, sample_id) AS hb FROM a WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT text_id, sha256('20260808' || chr(0) || 'pairs' || chr(0) || text_id) AS rank, source_id, spoof_id, ha = hb AS same_hash FROM t JOIN s USING (text_id) ORDER BY rank, text_id LIMIT 100"""
)
def frozen_pairs(spark: S, sf_dir: str) -> DataFrame:
    """The first 100 pairs in rank order: freezing a fixed number is the operator."""
    a = assets(spark, sf_dir).select(F.col("parent_group_id").alias("text_id"), "sample_id", "text_hash", "doc_id")

    def side(odd: int) -> DataFrame:
        m = F.min(F.struct("sample_id", "text_hash")).alias("m")
        return a.where(F.col("doc_id") % 2 == odd).groupBy("text_id").agg(m).select("text_id", "m.sample_id", "m.text_hash")

    ranks = a.select("text_id").distinct().withColumn("rank", rank_hex(SEED, "pairs", F.col("text_id")))
    return pairing.frozen_pairs(side(0), side(1), "text_id", ranks, 100)


@query(
    """WITH d AS (SELECT doc_id AS id, doc_id % 7 = 0 AS tr, doc_id % 11 = 0 AS ar, doc_id % 29 = 0 AS lost FROM documents),
f AS (SELECT id, tr, NOT tr AND NOT lost AS raw, ar, NOT tr AND NOT lost AND (NOT ar OR id % 5 = 0) AS ready FROM d)
SELECT id, CASE WHEN (tr AND raw) OR (ar AND ready) THEN 'rejected_but_present' WHEN tr THEN 'text_rejected' WHEN NOT raw THEN 'unaccounted' WHEN ar THEN 'audio_rejected' WHEN ready THEN 'ready' ELSE 'unaccounted' END AS state FROM f"""
)
def pair_reconciliation(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    tr, ar = d.where("id % 7 = 0"), d.where("id % 11 = 0")
    raw = d.where("id % 7 <> 0 AND id % 29 <> 0")
    return pairing.reconciled(d, raw, raw.where("id % 11 <> 0 OR id % 5 = 0"), tr, ar, "id")


@query(
    """WITH p AS (SELECT doc_id, source FROM documents), r AS (
  SELECT doc_id, 'r1' AS reviewer, source, CASE WHEN doc_id % 5 = 0 THEN 'no' ELSE 'yes' END AS q1 FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'r1' ELSE 'r2' END, CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE source END, 'yes' FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id + 1000000000, 'r1', source, 'yes' FROM documents WHERE doc_id % 100 = 7),
j AS (SELECT p.doc_id, r.reviewer, r.doc_id AS k, p.source IS NOT DISTINCT FROM r.source AS same, q1 FROM p LEFT JOIN r ON p.doc_id = r.doc_id)
SELECT doc_id, count(k)::BIGINT AS n_reviews, CASE WHEN bool_or(k IS NOT NULL AND NOT same) THEN 'mismatch' WHEN count(k) > count(DISTINCT reviewer) THEN 'duplicate'
  WHEN count(k) < 2 THEN 'not_eligible' WHEN count(k) = 2 AND bool_and(q1 = 'yes') THEN 'eligible' ELSE 'rejected' END AS state FROM j GROUP BY doc_id
UNION ALL SELECT doc_id, count(*), 'foreign' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM p) GROUP BY doc_id"""
)
def review_gate_two_reviewers(spark: S, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", "source")
    doc = F.col("doc_id")
    first = p.where("doc_id % 3 <> 0").select("doc_id", F.lit("r1").alias("reviewer"), "source", F.when(doc % 5 == 0, "no").otherwise("yes").alias("q1"))
    second = p.where("doc_id % 2 = 0").select("doc_id", F.when(doc % 13 == 0, "r1").otherwise("r2").alias("reviewer"), F.when(doc % 17 == 0, "other").otherwise(F.col("source")).alias("source"), F.lit("yes").alias("q1"))
    third = p.where("doc_id % 100 = 7").select((doc + 1000000000).alias("doc_id"), F.lit("r1").alias("reviewer"), "source", F.lit("yes").alias("q1"))
    return pairing.review_gate(p, first.union(second).union(third), "doc_id", ("source",), ("q1",))


@query(
    """WITH n AS (SELECT doc_id, 'new' AS path FROM documents WHERE doc_id % 3 = 0), o AS (SELECT doc_id, 'old' AS path FROM documents WHERE doc_id % 4 = 0)
SELECT d.doc_id, CASE WHEN n.path IS NOT NULL THEN 'new' WHEN o.path IS NOT NULL THEN 'reused' ELSE 'missing' END AS came_from, coalesce(n.path, o.path) AS path
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)"""
)
def coalesce_reuse(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return pairing.coalesced(d, d.where("doc_id % 3 = 0").withColumn("path", F.lit("new")), d.where("doc_id % 4 = 0").withColumn("path", F.lit("old")), "doc_id", ["path"])


@query(
    """SELECT o_orderkey, o_orderkey % 2 = 0 AND o_custkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS reuse FROM orders"""
)
def reusable_rows(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sha"))
    prior = o.where("o_orderkey % 2 = 0").withColumn("sha", F.when(F.col("sha") % 5 == 0, F.lit(-1)).otherwise(F.col("sha")))
    return pairing.reusable(o, prior, o.where("o_orderkey % 3 <> 0"), "o_orderkey", "sha").select("o_orderkey", "reuse")


@query(
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey AS k, count(*) AS n, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem WHERE l_linenumber < 5 OR l_orderkey % 2 = 0 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS l_orderkey, coalesce(l.n, 0)::BIGINT AS n_left, coalesce(r.n, 0)::BIGINT AS n_right FROM l FULL JOIN r ON l.k = r.k
WHERE l.n IS DISTINCT FROM r.n OR l.lo IS DISTINCT FROM r.lo OR l.hi IS DISTINCT FROM r.hi"""
)
def multiset_reconciliation(spark: S, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return pairing.multiset_difference(rows, rows.where("l_linenumber < 5 OR l_orderkey % 2 = 0"), ["l_orderkey"], "l_partkey")


@query(
    """SELECT l_linestatus, l_returnflag, l_linenumber, count(*)::BIGINT AS n_rows, sum(l_quantity)::DOUBLE AS quantity FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_returnflag), (l_linenumber), ())"""
)
def grouping_sets_inventory(spark: S, sf_dir: str) -> DataFrame:
    sets = [["l_returnflag"], ["l_linestatus", "l_returnflag"], ["l_linenumber"], []]
    return pairing.grouping_inventory(table(spark, sf_dir, "lineitem"), sets, {"n_rows": F.count("*"), "quantity": F.sum("l_quantity").cast("double")})


@query(
    """WITH {ASSETS}, c AS (SELECT language || '/' || label AS cell, count(*) AS n FROM a GROUP BY 1), e AS (SELECT 'en/bonafide' AS cell, 5 AS n_expected UNION ALL SELECT 'xx/spoof', 2)
SELECT coalesce(c.cell, e.cell) AS cell, coalesce(n, 0)::BIGINT AS n_rows, coalesce(n_expected, 0)::BIGINT AS n_expected, coalesce(n, 0) = coalesce(n_expected, 0) AS matches FROM c FULL JOIN e ON c.cell = e.cell"""
)
def cell_counts(spark: S, sf_dir: str) -> DataFrame:
    want = spark.createDataFrame([("en/bonafide", 5), ("xx/spoof", 2)], "cell string, n_expected long")
    return validation.cell_counts(assets(spark, sf_dir), ("language", "label"), want)


@query(
    """WITH {ASSETS}, x AS (SELECT parent_group_id AS text_id, min(sample_id) FILTER (doc_id % 2 = 0) AS bonafide_id, min(sample_id) FILTER (doc_id % 2 = 1) AS spoof_id FROM a GROUP BY 1)
SELECT text_id, bonafide_id, spoof_id, b.text_hash = s.text_hash AND b.doc_id % 3 <> 0 AND s.doc_id % 3 <> 0 AS locked FROM x JOIN a b ON b.sample_id = bonafide_id JOIN a s ON s.sample_id = spoof_id"""
)
def pair_lock(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select(F.col("parent_group_id").alias("text_id"), "sample_id", "text_hash", "doc_id")
    rows = a.withColumn("label", F.when(F.col("doc_id") % 2 == 0, "bonafide").otherwise("spoof"))
    one = rows.groupBy("text_id", "label").agg(F.min(F.struct("sample_id", "text_hash")).alias("m")).select("text_id", "label", "m.*")
    return pairing.pair_lock(one, a.select("sample_id", (F.col("doc_id") % 3 != 0).alias("approved")), ["text_id"])


RANK = "sha256('20260808:' || sample_id)"


@query(f"""WITH {{ASSETS}}, r AS (SELECT *, row_number() OVER (PARTITION BY language, label ORDER BY {RANK}, sample_id) AS rank FROM a) SELECT language, label, rank::INT AS rank, sample_id FROM r WHERE rank <= 5""")
def topn_per_stratum_hash(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("language", "label", "sample_id")
    return sampling.top_per_stratum(a, ["language", "label"], [rank_hex(SEED, F.col("sample_id"), sep=":"), "sample_id"], 5).select("language", "label", "rank", "sample_id")


@query(f"""WITH {{ASSETS}} SELECT text_hash, min_by(sample_id, {RANK}) AS sample_id FROM a GROUP BY text_hash""")
def best_per_text(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("text_hash", rank_hex(SEED, F.col("sample_id"), sep=":").alias("rank"), "sample_id")
    return sampling.first_per_key(a, ["text_hash"], ["rank", "sample_id"]).select("text_hash", "sample_id")


@query(
    f"""WITH {{ASSETS}}, b AS (SELECT text_hash, min(language) AS language, min_by(sample_id, {RANK}) AS sample_id FROM a GROUP BY text_hash),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY sha256('texts:' || text_hash), text_hash) AS rank FROM b) SELECT language, rank::INT AS rank, sample_id FROM r WHERE rank <= 20"""
)
def two_stage_text_selection(spark: S, sf_dir: str) -> DataFrame:
    """One record per text, then texts by another hash."""
    a = assets(spark, sf_dir).select("text_hash", rank_hex(SEED, F.col("sample_id"), sep=":").alias("rank"), "sample_id", "language")
    low = a.groupBy("text_hash").agg(F.min("language").alias("language"))
    one = sampling.first_per_key(a.drop("language"), ["text_hash"], ["rank", "sample_id"]).drop("rank").join(low, "text_hash")
    out = sampling.top_per_stratum(one, ["language"], [rank_hex("texts", F.col("text_hash"), sep=":"), "text_hash"], 20)
    return out.select("language", "rank", "sample_id")


@query(
    f"""WITH {{ASSETS}}, q AS (SELECT source_name, row_number() OVER (ORDER BY sha256('cat:' || source_name), source_name) AS o, count(*) OVER () AS k FROM (SELECT DISTINCT source_name FROM a)),
z AS (SELECT source_name, o, 50 // k + CASE WHEN o <= 50 % k THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT a.sample_id, z.source_name, z.o, row_number() OVER (PARTITION BY a.source_name ORDER BY {RANK}, sample_id) AS rank, quota FROM a JOIN z USING (source_name))
SELECT sample_id, source_name, row_number() OVER (ORDER BY rank, o)::INT AS position FROM r WHERE rank <= quota"""
)
def balanced_interleave(spark: S, sf_dir: str) -> DataFrame:
    """Fifty rows, as evenly over sources as possible, dealt in rounds."""
    a = assets(spark, sf_dir).select("sample_id", "source_name")
    categories = a.select("source_name").distinct()
    key = rank_hex("cat", F.col("source_name"), sep=":")
    quota = sampling.balanced_quota(categories, "source_name", key, 50)
    order = categories.withColumn("o", F.row_number().over(Window.orderBy(key, "source_name")))
    rows = sampling.ranked(a, ["source_name"], [rank_hex(SEED, F.col("sample_id"), sep=":"), "sample_id"])
    rows = rows.join(quota, "source_name").join(order, "source_name").where("rank <= quota")
    return sampling.interleaved(rows, "rank", ["o"]).select("sample_id", "source_name", "position")


COUNTS = "SELECT p_brand AS stratum, p_type AS grp, count(*) AS n FROM part GROUP BY ALL"


def _counts(spark: S, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("stratum"), F.col("p_type").alias("grp")).agg(F.count("*").alias("n"))


@query(
    f"""WITH c AS ({COUNTS}), b AS (SELECT *, least(9, n) - 1 AS room, 60 - count(*) OVER (PARTITION BY grp) AS rest FROM c),
s AS (SELECT *, unnest(range(1, room + 1)) AS level FROM b WHERE room > 0),
k AS (SELECT grp, stratum, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY level, n DESC, stratum) AS i FROM s) WHERE i <= rest GROUP BY ALL)
SELECT b.grp, b.stratum, (1 + coalesce(more, 0))::BIGINT AS quota FROM b LEFT JOIN k USING (grp, stratum)"""
)
def bounded_quota(spark: S, sf_dir: str) -> DataFrame:
    return sampling.bounded_quota(_counts(spark, sf_dir), "grp", "stratum", "n", F.lit(60), 1, 9)


@query(
    f"""WITH c AS ({COUNTS}), b AS (SELECT *, (n - 1)::DOUBLE AS spare, (40 - count(*) OVER w)::DOUBLE AS rest, sum((n - 1)::DOUBLE) OVER w AS total FROM c WINDOW w AS (PARTITION BY grp)),
e AS (SELECT *, CASE WHEN total > 0 THEN rest * spare / total ELSE 0 END AS exact FROM b), q AS (SELECT *, 1 + least(spare, floor(exact)) AS q0 FROM e),
m AS (SELECT *, 40 - sum(q0) OVER (PARTITION BY grp) AS missing, CASE WHEN q0 < n THEN 1 ELSE 0 END AS open FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY open DESC, exact - floor(exact) DESC, stratum) AS i FROM m)
SELECT grp, stratum, (q0 + CASE WHEN i <= missing AND open = 1 THEN 1 ELSE 0 END)::BIGINT AS quota FROM r"""
)
def largest_remainder_quota(spark: S, sf_dir: str) -> DataFrame:
    return sampling.largest_remainder(_counts(spark, sf_dir), "grp", "stratum", "n", F.lit(40), 1)


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders),
f AS (SELECT *, ['f0', 'f1'][(i % 2 + 1)::INT] AS family FROM r), v AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, family ORDER BY o_orderkey) - 1 AS j FROM f)
SELECT o_orderkey, family, CASE family WHEN 'f0' THEN ['a', 'b', 'c'][(j % 3 + 1)::INT] ELSE ['x', 'y'][(j % 2 + 1)::INT] END AS voice FROM v"""
)
def round_robin_profiles(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.two_level_round_robin(o, ["o_orderkey"], {"f0": ["a", "b", "c"], "f1": ["x", "y"]}, ["o_orderpriority"]).select("o_orderkey", "family", "voice")


@query(
    f"""WITH {{ASSETS}}, r AS (SELECT sample_id, language || source_name AS component, {RANK} AS rank FROM a), i AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY rank, sample_id) = 1 AS covers FROM r)
SELECT sample_id, component, covers FROM i ORDER BY covers DESC, CASE WHEN covers THEN component END, rank, sample_id LIMIT 150"""
)
def cover_then_fill(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", F.concat("language", "source_name").alias("component"), rank_hex(SEED, F.col("sample_id"), sep=":").alias("rank"))
    return sampling.cover_then_fill(a, "component", ["rank", "sample_id"], 150).select("sample_id", "component", "covers")


@query(
    f"""WITH {{ASSETS}}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {RANK}, sample_id) AS rank FROM a)
SELECT sample_id, label, rank::INT AS rank, CASE WHEN rank <= 30 THEN 'target' ELSE 'reserve' END AS state FROM r WHERE rank <= 40"""
)
def target_reserve_rank(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", "label")
    return sampling.target_reserve(a, ["label"], [rank_hex(SEED, F.col("sample_id"), sep=":"), "sample_id"], 30, 10)


@query(f"WITH {{ASSETS}} SELECT sample_id FROM a WHERE label = 'bonafide' ORDER BY {RANK}, sample_id LIMIT 25")
def global_hash_limit(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).where("label = 'bonafide'").select("sample_id")
    return a.orderBy(rank_hex(SEED, F.col("sample_id"), sep=":"), "sample_id").limit(25)


@query(
    """WITH {ASSETS}, r AS (SELECT sample_id, CASE WHEN label = 'unlabelled' THEN 'unlabelled' WHEN n_chars < 300 THEN 'short' WHEN language NOT IN ('en', 'de') THEN 'language'
  WHEN parent_group_id IN (SELECT parent_group_id FROM a WHERE doc_id % 10 = 3) THEN 'exposed' END AS reason FROM a)
SELECT reason, count(*)::BIGINT AS n_rows FROM r GROUP BY reason"""
)
def candidate_rejections(spark: S, sf_dir: str) -> DataFrame:
    """First rejection reason of each row, as a histogram; null is accepted."""
    a = assets(spark, sf_dir).select("sample_id", "label", "n_chars", "language", "parent_group_id", "doc_id")
    hit = a.where("doc_id % 10 = 3").select("parent_group_id").distinct().withColumn("_hit", F.lit(True))
    rules = [(F.col("label") == "unlabelled", "unlabelled"), (F.col("n_chars") < 300, "short"), (~F.col("language").isin("en", "de"), "language"), (F.col("_hit"), "exposed")]
    out = a.join(hit, "parent_group_id", "left").withColumn("reason", sampling.first_reason(rules))
    return out.groupBy("reason").agg(F.count("*").alias("n_rows"))


@query(
    """WITH q AS (SELECT 'r' || l_linenumber AS route, (count(*) % 5 + 1)::BIGINT AS quota FROM lineitem GROUP BY 1), s AS (SELECT route, sha256('route:' || route) AS o, unnest(range(1, quota + 1)) AS slot FROM q)
SELECT route, row_number() OVER (ORDER BY slot, o, route)::INT AS position FROM s"""
)
def route_interleave(spark: S, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("r"), F.col("l_linenumber")).alias("route")).agg((F.count("*") % 5 + 1).alias("quota"))
    return sampling.quota_slots(q.withColumn("o", rank_hex("route", F.col("route"), sep=":")), "route", "quota", "o")


@query(
    f"""WITH {{ASSETS}} SELECT sample_id, ((row_number() OVER (PARTITION BY language, label ORDER BY {RANK}, sample_id) - 1) // 4)::BIGINT AS batch FROM a"""
)
def balanced_batches(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", "language", "label")
    return sampling.balanced_batches(a, ["language", "label"], [rank_hex(SEED, F.col("sample_id"), sep=":"), "sample_id"], 4).select("sample_id", "batch")


@query(
    """WITH {ASSETS}, e AS (SELECT sha256 FROM a WHERE split = 'dev'), c AS (SELECT source_name, count(*) AS raw, count(*) FILTER (sha256 IN (SELECT sha256 FROM e)) AS history, count(*) FILTER (n_chars < 300) AS excluded FROM a GROUP BY 1)
SELECT source_name, raw::BIGINT AS raw, greatest(0, raw - excluded - history)::BIGINT AS capacity,
  CASE WHEN greatest(0, raw - excluded - history) >= 40 THEN 'enough' WHEN greatest(0, raw - excluded - history) > 0 THEN 'partial' ELSE 'none' END AS decision FROM c"""
)
def capacity_decision(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    e = a.where("split = 'dev'").select("sha256").distinct().withColumn("_h", F.lit(True))
    g = a.join(e, "sha256", "left").groupBy("source_name").agg(F.count("*").alias("raw"), F.count_if("_h").alias("history"), F.count_if(F.col("n_chars") < 300).alias("excluded"))
    left = F.greatest(F.lit(0), F.col("raw") - F.col("excluded") - F.col("history"))
    return g.select("source_name", "raw", left.alias("capacity"), F.when(left >= 40, "enough").when(left > 0, "partial").otherwise("none").alias("decision"))


@query(
    """WITH {ASSETS}, f AS (SELECT language, text_hash FROM a), t AS (SELECT language, count(DISTINCT text_hash) AS texts FROM f GROUP BY 1), x AS (SELECT DISTINCT text_hash FROM a WHERE split = 'train')
SELECT language, texts::BIGINT AS n_texts, (SELECT count(DISTINCT text_hash) FROM f WHERE f.language = t.language AND text_hash NOT IN (SELECT text_hash FROM x))::BIGINT AS n_fresh FROM t"""
)
def text_group_inventory(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    pairs = a.select("language", "text_hash").distinct()
    used = a.where("split = 'train'").select("text_hash").distinct().withColumn("_u", F.lit(True))
    return pairs.join(used, "text_hash", "left").groupBy("language").agg(F.count("*").alias("n_texts"), F.count_if(F.col("_u").isNull()).alias("n_fresh"))


@query(
    """WITH RECURSIVE {ASSETS}, k AS (SELECT sample_id, unnest(['parent_group_id:' || parent_group_id, 'speaker_pseudo_id:' || speaker_pseudo_id, 'text_hash:' || text_hash]) AS key FROM a),
e AS (SELECT DISTINCT x.key AS p, y.key AS q FROM k x JOIN k y USING (sample_id)),
r AS (SELECT DISTINCT key, key AS root FROM k UNION SELECT e.q, r.root FROM r JOIN e ON e.p = r.key),
c AS (SELECT key, min(root) AS component FROM r GROUP BY 1), s AS (SELECT DISTINCT sample_id, component FROM k JOIN c USING (key)),
v AS (SELECT *, ('0x' || substr(sha256('20260808:' || component), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM s)
SELECT sample_id, component, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM v"""
)
def component_split_assignment(spark: S, sf_dir: str) -> DataFrame:
    """Splits of whole components over group, speaker and text; no key crosses splits afterwards."""
    a = assets(spark, sf_dir).select("sample_id", *FIELDS).withColumn("split", F.lit(None).cast("string"))
    return graph.assigned_splits(a, "sample_id", FIELDS, SEED)


@query("SELECT NULL::VARCHAR AS field, NULL::VARCHAR AS value, NULL::VARCHAR AS splits WHERE false")
def component_split_leakage(spark: S, sf_dir: str) -> DataFrame:
    """The leakage report of the component assignment, which has no rows."""
    a = assets(spark, sf_dir).select("sample_id", *FIELDS)
    out = graph.assigned_splits(a.withColumn("split", F.lit(None).cast("string")), "sample_id", FIELDS, SEED)
    return validation.cross_split_leakage(a.join(out.select("sample_id", "split"), "sample_id"), FIELDS)


@query(
    """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY sha256('20260808:' || o_orderkey)) AS i, o_orderkey, o_custkey, o_orderdate AS day FROM orders),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS f, []::VARCHAR[] AS d, false AS taken
  UNION ALL SELECT o.i, CASE WHEN list_contains(f, o_custkey) OR list_contains(d, day::VARCHAR) THEN f ELSE list_append(f, o_custkey) END,
    CASE WHEN list_contains(f, o_custkey) OR list_contains(d, day::VARCHAR) THEN d ELSE list_append(d, day::VARCHAR) END, NOT (list_contains(f, o_custkey) OR list_contains(d, day::VARCHAR))
  FROM g JOIN o ON o.i = g.i + 1 WHERE len(f) < 200)
SELECT o_orderkey, o_custkey, day FROM g JOIN o USING (i) WHERE taken"""
)
def greedy_two_key_distinct(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(rank_hex(SEED, F.col("o_orderkey"), sep=":").alias("rank"), "o_orderkey", "o_custkey", F.col("o_orderdate").alias("day"))
    return graph.greedy_distinct(o, "rank", "o_custkey", "day", 200).select("o_orderkey", "o_custkey", "day")


@query()
def bipartite_matching(spark: S, sf_dir: str) -> DataFrame:
    """Texts and speakers, each at most once (which of the largest matchings is not fixed; ``matching_certificate`` has SQL)."""
    a = assets(spark, sf_dir).select("text_hash", "speaker_pseudo_id")
    return graph.matched(a, "text_hash", "speaker_pseudo_id")


@query(
    """WITH e AS (SELECT DISTINCT o_custkey // 10 AS l, o_orderdate::DATE AS r FROM orders WHERE o_orderkey % 3 = 0)
SELECT (SELECT count(*) FROM e)::BIGINT AS n_edges, (SELECT count(DISTINCT l) FROM e)::BIGINT AS n_lefts, (SELECT count(DISTINCT r) FROM e)::BIGINT AS n_rights,
  0::BIGINT AS repeated, 0::BIGINT AS foreign_pairs, 0::BIGINT AS uncovered_edges, 0::BIGINT AS gap"""
)
def matching_certificate(spark: S, sf_dir: str) -> DataFrame:
    """A largest matching of groups of customers with days, proved: pairs are edges, none shares an end, and a cover of all edges is as small as the matching is large."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    e = stored(o.select(F.floor(F.col("o_custkey") / 10).alias("l"), F.to_date("o_orderdate").alias("r")).distinct(), "certificate-edges")
    pairs = graph.matched(e, "l", "r")
    lefts, rights = graph.vertex_cover(e, pairs, "l", "r")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = e.agg(F.count("*").alias("n_edges"), F.countDistinct("l").alias("n_lefts"), F.countDistinct("r").alias("n_rights"))
    ends = pairs.agg((2 * F.count("*") - F.countDistinct("l") - F.countDistinct("r")).alias("repeated"), F.count("*").alias("n_pairs"))
    bare = n(e.join(lefts, "l", "left_anti").join(rights, "r", "left_anti"), "uncovered_edges")
    one = counts.crossJoin(ends).crossJoin(n(pairs.join(e, ["l", "r"], "left_anti"), "foreign_pairs")).crossJoin(bare).crossJoin(n(lefts, "a")).crossJoin(n(rights, "b"))
    return one.select("n_edges", "n_lefts", "n_rights", "repeated", "foreign_pairs", "uncovered_edges", (F.col("a") + F.col("b") - F.col("n_pairs")).alias("gap"))


@query(
    """WITH r AS (SELECT source AS source_name, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'dev' ELSE 'train' END AS role, CASE WHEN quality = 1 THEN 'bonafide' ELSE 'spoof' END AS label
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND (source <> 'src3' OR quality = 1)
  UNION ALL SELECT 'src1', 'train', 'spoof'),
p AS (SELECT 'dev' AS role, 'src' || i AS source_name FROM range(1, 5) t(i) UNION ALL SELECT 'train', 'src' || i FROM range(5, 20) t(i) UNION ALL SELECT 'train', 'src0'),
l AS (SELECT 'src' || i AS source, CASE WHEN i % 3 = 0 THEN 'pending' WHEN i % 3 = 1 THEN 'verified' ELSE 'owner_authorized_personal_research' END AS status FROM range(14) t(i)),
h AS (SELECT DISTINCT role, source_name FROM r)
SELECT 'sources' AS rule, coalesce(h.role, p.role) AS key, coalesce(h.source_name, p.source_name) || CASE WHEN h.role IS NULL THEN ': absent' ELSE ': not planned' END AS detail FROM h FULL JOIN p ON h.role = p.role AND h.source_name = p.source_name WHERE h.role IS NULL OR p.role IS NULL
UNION ALL SELECT 'labels', role, string_agg(DISTINCT label, ',' ORDER BY label) FROM r GROUP BY role HAVING count(DISTINCT label) < 2
UNION ALL SELECT 'source in several roles', source_name, string_agg(DISTINCT role, ',' ORDER BY role) FROM r GROUP BY source_name HAVING count(DISTINCT role) > 1
UNION ALL SELECT 'licence', u.source_name, CASE WHEN status IS NULL THEN 'missing' ELSE 'not_approved' END FROM (SELECT DISTINCT source_name FROM r) u LEFT JOIN l ON l.source = u.source_name WHERE status IS NULL OR status NOT IN ('verified', 'owner_authorized_personal_research')"""
)
def source_matrix_protocol(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id").where("source <> 'src3' OR quality = 1")
    role = F.when(F.col("source").isin("src1", "src2", "src3"), "dev").otherwise("train")
    rows = d.select(F.col("source").alias("source_name"), role.alias("role"), F.when(F.col("quality") == 1, "bonafide").otherwise("spoof").alias("label"))
    rows = rows.union(spark.createDataFrame([("src1", "train", "spoof")], "source_name string, role string, label string"))
    plan = [("dev", f"src{i}") for i in range(1, 5)] + [("train", f"src{i}") for i in range(5, 20)] + [("train", "src0")]
    return protocols.source_matrix_issues(rows, _ledger(spark), spark.createDataFrame(plan, "role string, source_name string"))


@query(
    """WITH p AS (SELECT parent, 'train' AS part FROM (SELECT DISTINCT doc_id // 4 AS parent FROM documents WHERE doc_id % 3 <> 0)), q AS (SELECT DISTINCT doc_id // 4 AS parent FROM documents WHERE doc_id % 3 = 0),
s AS (SELECT source FROM documents WHERE doc_id % 3 <> 0 INTERSECT SELECT source FROM documents WHERE doc_id % 3 = 0),
c AS (SELECT lang || '/' || CASE WHEN doc_id % 2 = 0 THEN 'spoof' ELSE 'bonafide' END AS cell, count(*) AS n FROM documents GROUP BY 1)
SELECT 'not disjoint' AS rule, 'parent' AS key, min('g' || parent) AS detail FROM p WHERE parent IN (SELECT parent FROM q) HAVING count(*) > 0
UNION ALL SELECT 'pinned overlap', 'source', n::VARCHAR FROM (SELECT count(*) AS n FROM s) WHERE n <> 3
UNION ALL SELECT 'cell', coalesce(c.cell, e.cell), coalesce(n, 0) || '/' || coalesce(want, 0) FROM c FULL JOIN (SELECT 'en/spoof' AS cell, 10 AS want) e ON c.cell = e.cell WHERE coalesce(n, 0) <> coalesce(want, 0)"""
)
def combined_train_protocol(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("language"), "source", F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4)).alias("parent"), F.when(F.col("doc_id") % 2 == 0, "spoof").otherwise("bonafide").alias("label")
    )
    cells = spark.createDataFrame([("en/spoof", 10)], "cell string, n_expected long")
    return protocols.combined_train_issues({"a": d.where("doc_id % 3 <> 0"), "b": d.where("doc_id % 3 = 0")}, cells, ["parent"], {"source": 3})


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) + CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS rank, CASE WHEN doc_id % 50 = 0 THEN 'xx' ELSE lang END AS lang FROM documents)
SELECT 'binding' AS rule, r.doc_id::VARCHAR AS key, 'lang' AS detail FROM r JOIN documents d USING (doc_id) WHERE r.lang <> d.lang
UNION ALL SELECT 'ranks', source, 'gap' FROM r GROUP BY source HAVING min(rank) <> 1"""
)
def selection_binding(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    s = sampling.ranked(d, ["source"], ["doc_id"]).withColumn("rank", F.col("rank") + F.when(F.col("source") == "src2", 1).otherwise(0))
    s = s.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang")))
    return protocols.selection_binding_issues(s, d, "doc_id", ["lang"], ["source"], "rank")


@query(
    """SELECT l_returnflag, count(*)::BIGINT AS n_files, count(DISTINCT l_partkey)::BIGINT AS n_digests, sum(l_quantity::DECIMAL(18,6))::DOUBLE AS total, min(l_quantity)::DOUBLE AS least, quantile_cont(l_quantity, 0.5)::DOUBLE AS median, max(l_quantity)::DOUBLE AS most FROM lineitem GROUP BY 1"""
)
def duration_audit(spark: S, sf_dir: str) -> DataFrame:
    out = projection.duration_audit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_partkey")
    return out.withColumns({c: F.col(c).cast("double") for c in ("total", "least", "median", "most")})
