"""Queries on composed selections, audits and bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.keys import rank_hex
from talweg.operators import composed, dedupe, metrics, pairing, perceptual, sampling, timeseries
from talweg.plans.evaluation import PRINTS, _prints, _waveforms
from talweg.plans.registry import query
from talweg.plans.tables import SCORED, SEED, assets, scored_orders, table
from talweg.session import arrow_rows
from talweg.storage import stored

S = SparkSession


@query(
    """SELECT 'spk:' || (doc_id // 8) AS speaker_pseudo_id, count(*)::BIGINT AS n_rows, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS n_missing FROM documents GROUP BY 1"""
)
def missing_by_speaker(spark: S, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("relative_path"), F.concat(F.lit("spk:"), F.floor(F.col("doc_id") / 8)).alias("speaker_pseudo_id"))
    return composed.missing_by_speaker(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("relative_path")))


@query("""WITH {ASSETS} SELECT sample_id FROM a WHERE split = 'test' AND text_hash NOT IN (SELECT text_hash FROM a WHERE split = 'dev') AND text_hash IN (SELECT text_hash FROM a WHERE doc_id % 3 = 0)""")
def held_out_by_text(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    return composed.held_out_by_text(a.where("split = 'test'"), a.where("split = 'dev'"), a.where("doc_id % 3 = 0")).select("sample_id")


@query(
    """WITH d AS (SELECT doc_id, doc_id // 3 AS k FROM documents), s AS (SELECT * FROM d WHERE doc_id % 2 = 0), b AS (SELECT k, min(doc_id) AS one, count(*) AS n FROM d WHERE doc_id % 2 = 1 AND doc_id % 5 > 0 GROUP BY 1),
u AS (SELECT k, count(*) AS m FROM s GROUP BY 1)
SELECT s.doc_id AS spoof_id, CASE WHEN n = 1 AND m = 1 THEN one END AS bonafide_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 OR m > 1 THEN 'shared' END AS problem FROM s JOIN u USING (k) LEFT JOIN b USING (k)"""
)
def bonafide_counterparts(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("k"))
    return composed.counterparts(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 AND doc_id % 5 > 0"), ["k"], "doc_id")


@query(
    f"""WITH {SCORED} SELECT language AS test, count(*)::BIGINT AS n_rows, count(*) FILTER (label = 'bonafide')::BIGINT AS n_bonafide, count(*) FILTER (label = 'spoof')::BIGINT AS n_spoof,
string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM o GROUP BY 1"""
)
def suite_report(spark: S, sf_dir: str) -> DataFrame:
    o = scored_orders(spark, sf_dir).select(F.col("language").alias("test"), "label", F.col("source").alias("source_name"), F.col("family").alias("generator_family"))
    return composed.suite_report(o, "test")


@query(
    """WITH {ASSETS}, h AS (SELECT source_name, text_hash, sample_id, sha256('20260808:' || sample_id) AS r FROM a), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY source_name, text_hash ORDER BY r) = 1)
SELECT source_name, sample_id, row_number() OVER (PARTITION BY source_name ORDER BY r)::INT AS rank FROM b QUALIFY rank <= 5"""
)
def unique_text_per_source(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("source_name", "text_hash", "sample_id", rank_hex(SEED, F.col("sample_id"), sep=":").alias("r"))
    return composed.unique_text_per_group(a, "source_name", "text_hash", ["r"], 5).select("source_name", "sample_id", "rank")


@query(
    """WITH {ASSETS}, b AS (SELECT speaker_pseudo_id, sample_id, sha256('group:' || speaker_pseudo_id) AS group_rank FROM a QUALIFY row_number() OVER (PARTITION BY speaker_pseudo_id ORDER BY sha256('20260808:' || sample_id)) = 1)
SELECT * FROM b ORDER BY group_rank LIMIT 12"""
)
def one_per_client_group(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("speaker_pseudo_id", "sample_id", rank_hex(SEED, F.col("sample_id"), sep=":").alias("r"))
    out = composed.one_per_group(a, "speaker_pseudo_id", rank_hex("group", F.col("speaker_pseudo_id"), sep=":"), ["r"], 12)
    return out.select("speaker_pseudo_id", "sample_id", "group_rank")


@query(
    """WITH d AS (SELECT doc_id, source, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'target' ELSE 'reserve' END AS state FROM documents WHERE doc_id % 7 > 0)
SELECT doc_id, source, state, row_number() OVER (PARTITION BY source ORDER BY CASE state WHEN 'target' THEN 0 ELSE 1 END, n_chars, doc_id)::INT AS position FROM d QUALIFY position <= 6"""
)
def frozen_per_route(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(F.col("doc_id") % 3 == 0, "target").otherwise("reserve").alias("state"))
    return composed.frozen(d, F.col("doc_id") % 7 > 0, "source", "n_chars", "doc_id", "state", 6).select("doc_id", "source", "state", "position")


@query(
    """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS position FROM documents)
SELECT *, CASE lang WHEN 'en' THEN ['calm', 'fast', 'low'][(position - 1) % 3 + 1] WHEN 'de' THEN ['warm', 'dry'][(position - 1) % 2 + 1] END AS profile FROM d"""
)
def route_tasks(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return composed.route_tasks(d, "lang", "doc_id", {"en": ["calm", "fast", "low"], "de": ["warm", "dry"]})


@query(
    """WITH f AS (SELECT o_orderkey, o_orderkey AS rank FROM orders), s AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey + 7 ELSE o_orderkey END AS r FROM orders WHERE o_orderkey % 3 > 0
  UNION ALL SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 200 = 5),
b AS (SELECT s.*, rank AS q, count(*) OVER (PARTITION BY s.o_orderkey) AS n FROM s LEFT JOIN f USING (o_orderkey)),
p AS (SELECT o_orderkey, row_number() OVER (ORDER BY r, o_orderkey) AS i, row_number() OVER (ORDER BY q, o_orderkey) AS j FROM b WHERE q IS NOT NULL AND n = 1)
SELECT DISTINCT o_orderkey, CASE WHEN q IS NULL THEN 'foreign' ELSE 'repeated' END AS fault FROM b WHERE q IS NULL OR n > 1 UNION ALL SELECT o_orderkey, 'order' FROM p WHERE i <> j"""
)
def ordered_subset(spark: S, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    s = o.where("o_orderkey % 3 > 0").select(F.when(k % 101 == 0, -k).otherwise(k).alias("o_orderkey"), F.when(k % 50 == 1, k + 7).otherwise(k).alias("rank"))
    s = s.union(o.where("o_orderkey % 200 = 5").select(k, k))
    return composed.order_breaks(s, o.withColumn("rank", k), "o_orderkey", "rank")


@query(
    """WITH {ASSETS}, b AS (SELECT sample_id, text_hash, sha256('20260808:' || sample_id) AS r FROM a WHERE n_chars > 200 AND text_hash NOT IN (SELECT text_hash FROM a WHERE split = 'test') QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY r) = 1)
SELECT sample_id FROM b ORDER BY r LIMIT 40"""
)
def fresh_text_selection(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", "text_hash", "n_chars", "split", rank_hex(SEED, F.col("sample_id"), sep=":").alias("r"))
    return composed.fresh_text_selection(a, a.where("split = 'test'"), F.col("n_chars") > 200, "text_hash", ["r"], 40).select("sample_id")


@query(
    """WITH {ASSETS} SELECT sample_id, sha256 AS raw_sha256, CASE WHEN substr(sha256, 1, 1) = 'a' THEN 'blocked' WHEN doc_id % 2 = 0 THEN 'eligible' ELSE 'pool_exact' END AS decision, CASE WHEN doc_id % 2 = 0 THEN 'eligible' ELSE 'pool_exact' END AS was FROM a"""
)
def raw_digest_overrides(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("sample_id", F.col("sha256").alias("raw_sha256"), F.when(F.col("doc_id") % 2 == 0, "eligible").otherwise("pool_exact").alias("decision"))
    new = a.where("raw_sha256 LIKE 'a%'").select("raw_sha256", F.lit("blocked").alias("decision")).distinct()
    return composed.overridden(a, new)


@query(
    """WITH d AS (SELECT doc_id AS sample_id, 'p' || (doc_id // 2) || '/' || (doc_id % 2) AS p, sha256(text) AS s FROM documents), r AS (SELECT p, s FROM d WHERE sample_id % 9 > 0 UNION ALL SELECT p, s FROM d WHERE sample_id % 20 = 1 UNION ALL SELECT 'gone', s FROM d WHERE sample_id = 3),
n AS (SELECT p, s, count(*) AS n FROM r GROUP BY 1, 2)
SELECT sample_id, coalesce(n, 0)::BIGINT AS n_results, CASE WHEN sample_id IS NULL THEN 'foreign' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem FROM d FULL JOIN n ON d.p = n.p AND d.s = n.s"""
)
def rekeyed_results(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2), F.lit("/"), F.col("doc_id") % 2).alias("raw_relative_path"), F.sha2("text", 256).alias("raw_sha256")
    )
    by = ["raw_relative_path", "raw_sha256"]
    odd = d.where("sample_id = 3").select(F.lit("gone").alias(by[0]), by[1])
    return composed.rekeyed(d.where("sample_id % 9 > 0").select(*by).union(d.where("sample_id % 20 = 1").select(*by)).union(odd), d)


@query(
    f"""WITH {SCORED}, r AS (SELECT label, logit, unnest([{{{{'field': 'family', 'value': CASE WHEN family = 'fam1' THEN '' ELSE family END}}}}, {{{{'field': 'source', 'value': source || CASE WHEN label = 'spoof' THEN 's' ELSE CASE WHEN source = 'src0' THEN 's' ELSE '' END END}}}}]) AS p FROM o),
g AS (SELECT p.field AS field, CASE WHEN p.value = '' THEN 'not_applicable' ELSE p.value END AS value, label, logit FROM r)
SELECT field, value, count(*)::BIGINT AS n, count(*) FILTER (label = 'bonafide')::BIGINT AS n_bonafide, count(*) FILTER (label = 'spoof')::BIGINT AS n_spoof,
  CASE WHEN count(DISTINCT label) = 2 THEN (count(*) FILTER (label = 'spoof' AND logit >= 0) / (count(*) FILTER (label = 'spoof'))::DOUBLE + count(*) FILTER (label = 'bonafide' AND logit < 0) / (count(*) FILTER (label = 'bonafide'))::DOUBLE) / 2 END AS balanced_accuracy
FROM g GROUP BY 1, 2""".replace("{{", "{").replace("}}", "}")
)
def field_strata(spark: S, sf_dir: str) -> DataFrame:
    o = scored_orders(spark, sf_dir)
    marked = F.concat("source", F.when((F.col("label") == "spoof") | (F.col("source") == "src0"), "s").otherwise(""))
    o = o.withColumn("family", F.when(F.col("family") == "fam1", "").otherwise(F.col("family"))).withColumn("source", marked)
    return composed.field_strata(o, ["family", "source"], "logit")


@query(
    """WITH {ASSETS}, p AS (SELECT doc_id // 2 AS pair, min(sample_id) FILTER (doc_id % 2 = 1) AS b, min(sample_id) FILTER (doc_id % 2 = 0) AS s FROM a GROUP BY 1 HAVING count(*) = 2),
i AS (SELECT pair, unnest([b, s]) AS sample_id FROM p WHERE pair % 3 = 0)
SELECT 'gate' AS protocol_id, sha256('gate:' || pair || ':' || sample_id) AS annotation_id, pair, label, sample_id, language AS relative_path, a.sha256 AS audio_sha256, text_hash, 't' || pair AS tokens FROM i JOIN a USING (sample_id)"""
)
def review_packet(spark: S, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("doc_id", "sample_id", "label", F.col("language").alias("relative_path"), F.col("sha256").alias("audio_sha256"), "text_hash")
    pairs = a.groupBy(F.floor(F.col("doc_id") / 2).alias("pair")).agg(F.min(F.when(F.col("doc_id") % 2 == 1, F.col("sample_id"))).alias("bonafide_id"), F.min(F.when(F.col("doc_id") % 2 == 0, F.col("sample_id"))).alias("spoof_id"), F.count("*").alias("n"))
    evidence = pairs.where("pair % 3 = 0").select("pair", F.concat(F.lit("t"), F.col("pair")).alias("tokens"))
    return composed.review_packet(pairs.where("n = 2").drop("n"), a.drop("doc_id"), evidence, "gate")


@query("SELECT o_orderkey, o_totalprice::DOUBLE / 1000 - 100 AS logit FROM orders")
def batched_scores(spark: S, sf_dir: str) -> DataFrame:
    """A scorer passed in, over frames of 256 rows; the check that every row has one score follows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    return composed.scored_once(o, "o_orderkey", ["price"], lambda frame: frame["price"] / 1000 - 100)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 2 ELSE 0 END::BIGINT AS n_scores FROM orders WHERE o_orderkey % 40 IN (0, 1)")
def scores_not_once(spark: S, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return composed.not_scored_once(o.where("o_orderkey % 40 <> 1").union(o.where("o_orderkey % 40 = 0")), o, "o_orderkey")


@query(
    f"""WITH {SCORED}, p AS (SELECT label, 1 / (1 + exp(-logit)) AS p FROM o)
SELECT count(*) FILTER (label = 'spoof' AND p >= 0.5)::BIGINT AS tp, count(*) FILTER (label = 'bonafide' AND p >= 0.5)::BIGINT AS fp, count(*) FILTER (label = 'spoof' AND p < 0.5)::BIGINT AS fn, count(*) FILTER (label = 'bonafide' AND p < 0.5)::BIGINT AS tn,
  round_even(avg((p - CASE label WHEN 'spoof' THEN 1 ELSE 0 END) ** 2), 4) AS brier FROM p"""
)
def probability_report(spark: S, sf_dir: str) -> DataFrame:
    o = scored_orders(spark, sf_dir).withColumn("p", metrics.sigmoid(F.col("logit")))
    spoof, high = F.col("label") == "spoof", F.col("p") >= 0.5
    return o.agg(
        F.count_if(spoof & high).alias("tp"), F.count_if(~spoof & high).alias("fp"), F.count_if(spoof & ~high).alias("fn"), F.count_if(~spoof & ~high).alias("tn"),
        composed.reported(F.avg((F.col("p") - spoof.cast("double")) ** 2)).alias("brier"),
    )


@query(
    """SELECT doc_id, lang AS head, CASE WHEN doc_id % 3 > 0 THEN source || CASE WHEN doc_id % 3 = 2 THEN ':' || doc_id ELSE '' END END AS tail,
  CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE doc_id::VARCHAR END AS last FROM documents"""
)
def parsed_keys(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "doc:").otherwise(""), F.concat_ws(":", "lang", F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.when(F.col("doc_id") % 3 == 2, F.col("doc_id").cast("string"))))
    return d.select("doc_id", composed.key_parts(name, "doc:").alias("k")).select("doc_id", "k.head", "k.tail", "k.last")


@query(
    """WITH s AS (SELECT user_id, least(32767, greatest(-32768, (value * CASE WHEN user_id % 3 = 0 THEN 0.4 WHEN user_id % 3 = 1 THEN 40 ELSE 900 END)::BIGINT)) AS v FROM events WHERE value IS NOT NULL),
q AS (SELECT user_id, count(*) / 4.0::DOUBLE AS sec, max(abs(v)) / 32768.0::DOUBLE AS peak, 20 * log10(greatest(sqrt(avg((v / 32768.0::DOUBLE) ** 2)), 1e-12)) AS db, avg(CASE WHEN abs(v) >= 32700 THEN 1.0 ELSE 0.0 END) AS clip, avg(v / 32768.0::DOUBLE) AS dc FROM s GROUP BY 1),
f AS (SELECT *, list_filter([CASE WHEN db < -55 THEN 'signal_too_quiet' END, CASE WHEN clip > 0.02 THEN 'excessive_clipping' END], lambda x: x IS NOT NULL) AS l FROM q)
SELECT user_id, CASE WHEN len(l) > 0 THEN 'rejected_quality' WHEN sec < 2.5 THEN 'insufficient_speech' ELSE 'ready' END AS status,
  CASE WHEN len(l) > 0 THEN array_to_string(l, ',') WHEN sec < 2.5 THEN 'insufficient_speech' ELSE '' END AS flags,
  round_even(sec, 3) AS speech_seconds, round_even(db, 3) AS rms_dbfs, round_even(peak, 6) AS peak, round_even(clip, 6) AS clipped_fraction, round_even(dc, 6) AS dc_offset FROM f"""
)
def preparation_results(spark: S, sf_dir: str) -> DataFrame:
    gain = F.when(F.col("user_id") % 3 == 0, 0.4).when(F.col("user_id") % 3 == 1, 40.0).otherwise(900.0)
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", F.bround(F.col("value") * gain).cast("long").alias("v"))
    q = timeseries.quality(e.select("user_id", F.least(F.lit(32767), F.greatest(F.lit(-32768), F.col("v"))).alias("v")), ["user_id"], "v")
    return timeseries.prepared_results(q.withColumn("speech_seconds", F.col("n") / 4.0), ["user_id"])


_STRATA = "SELECT label, logit, unnest(['family', 'source']) AS field, unnest([CASE WHEN family = 'fam1' THEN 'not_applicable' ELSE family END, source || CASE WHEN label = 'spoof' OR source = 'src0' THEN 's' ELSE '' END]) AS value FROM o"


@query(
    f"""WITH {SCORED}, g AS ({_STRATA}),
m AS (SELECT field, value, count(*)::BIGINT AS n, count(*) FILTER (label = 'bonafide')::BIGINT AS n_bonafide, count(*) FILTER (label = 'spoof')::BIGINT AS n_spoof,
  count(*) FILTER (label = 'spoof' AND logit >= 0) AS tp, count(*) FILTER (label = 'bonafide' AND logit < 0) AS tn FROM g GROUP BY ALL),
t AS (SELECT field, value, logit AS t, count(*) FILTER (label = 'spoof') AS p, count(*) FILTER (label <> 'spoof') AS q FROM g GROUP BY ALL),
c AS (SELECT field, value, t, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(p) OVER w AS ap, sum(q) OVER w AS an FROM t WINDOW w AS (PARTITION BY field, value), d AS (PARTITION BY field, value ORDER BY t DESC)),
u AS (SELECT * FROM c UNION ALL SELECT DISTINCT field, value, 'infinity'::DOUBLE, 0, 0, ap, an FROM c), e AS (SELECT field, value, min_by((fp / an + (ap - tp) / ap) / 2, (abs(fp / an - (ap - tp) / ap), -t)) AS eer FROM u WHERE ap > 0 AND an > 0 GROUP BY ALL),
z AS (SELECT *, (tp + tn) / n AS acc, 1.959963984540054::DOUBLE AS z FROM m)
SELECT field, value, n, n_bonafide, n_spoof, round(acc, 9) AS accuracy,
  round(greatest(0, (acc + z * z / (2 * n) - z * sqrt(acc * (1 - acc) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 9) AS low, round(least(1, (acc + z * z / (2 * n) + z * sqrt(acc * (1 - acc) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 9) AS high,
  CASE WHEN n_bonafide > 0 AND n_spoof > 0 THEN round(tp / n_spoof, 9) END AS spoof_recall, CASE WHEN n_bonafide > 0 AND n_spoof > 0 THEN round(tn / n_bonafide, 9) END AS bonafide_recall,
  CASE WHEN n_bonafide > 0 AND n_spoof > 0 THEN round((tp / n_spoof + tn / n_bonafide) / 2, 9) END AS balanced_accuracy, round(eer, 9) AS eer FROM z LEFT JOIN e USING (field, value)"""
)
def full_strata(spark: S, sf_dir: str) -> DataFrame:
    o = scored_orders(spark, sf_dir)
    marked = F.concat("source", F.when((F.col("label") == "spoof") | (F.col("source") == "src0"), "s").otherwise(""))
    o = o.withColumn("family", F.when(F.col("family") == "fam1", "  ").otherwise(F.col("family"))).withColumn("source", marked)
    out = composed.full_strata(o, ["family", "source"], "logit")
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "low", "high", "spoof_recall", "bonafide_recall", "balanced_accuracy", "eer")})


@query(
    f"""WITH {SCORED}, k AS (SELECT label, language || '/' || source AS stratum, o_orderkey FROM o), c AS (SELECT label, stratum, count(*) AS n FROM k GROUP BY ALL),
b AS (SELECT *, (n - 2)::DOUBLE AS spare, least(150, sum(n) OVER w) AS total, (least(150, sum(n) OVER w) - 2 * count(*) OVER w)::DOUBLE AS rest, sum((n - 2)::DOUBLE) OVER w AS all_spare FROM c WINDOW w AS (PARTITION BY label)),
e AS (SELECT *, CASE WHEN all_spare > 0 THEN rest * spare / all_spare ELSE 0 END AS exact FROM b), q AS (SELECT *, 2 + least(spare, floor(exact)) AS q0 FROM e),
m AS (SELECT *, total - sum(q0) OVER (PARTITION BY label) AS missing, CASE WHEN q0 < n THEN 1 ELSE 0 END AS open FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY open DESC, exact - floor(exact) DESC, stratum) AS i FROM m),
t AS (SELECT label, stratum, q0 + CASE WHEN i <= missing AND open = 1 THEN 1 ELSE 0 END AS quota FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY label, stratum ORDER BY sha256('{SEED}:' || o_orderkey), o_orderkey) AS rank FROM k)
SELECT label, stratum, o_orderkey FROM h JOIN t USING (label, stratum) WHERE rank <= quota"""
)
def balanced_slice(spark: S, sf_dir: str) -> DataFrame:
    """A slice of 150 orders a label, over strata of language and source by largest remainder, then by hash."""
    o = scored_orders(spark, sf_dir).select("label", F.concat_ws("/", "language", "source").alias("stratum"), "o_orderkey")
    return sampling.balanced_slice(o, "label", "stratum", "o_orderkey", 150, 2, SEED)


@query(
    """WITH r AS (SELECT lang AS split, doc_id AS path FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT 'zz', doc_id FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'zz', -doc_id - 1 FROM documents WHERE doc_id % 13 = 0),
m AS (SELECT doc_id AS path FROM documents WHERE doc_id % 5 <> 2), d AS (SELECT DISTINCT split, path FROM r WHERE split IS NOT NULL)
SELECT x.split AS a, y.split AS b, count(*)::BIGINT AS n FROM d x JOIN d y ON x.path = y.path AND x.split < y.split GROUP BY ALL
UNION ALL SELECT 'missing', '', count(*)::BIGINT FROM m WHERE path NOT IN (SELECT path FROM d) HAVING count(*) > 0 UNION ALL SELECT 'foreign', '', count(DISTINCT path)::BIGINT FROM d WHERE path NOT IN (SELECT path FROM m) HAVING count(*) > 0"""
)
def path_set_audit(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    part = d.where("doc_id % 7 <> 3 AND lang IS NOT NULL").select(F.col("lang").alias("split"), F.col("doc_id").alias("path"))
    more = d.where("doc_id % 11 = 0").select(F.lit("zz").alias("split"), F.col("doc_id").alias("path")).unionByName(d.where("doc_id % 13 = 0").select(F.lit("zz").alias("split"), (-F.col("doc_id") - 1).alias("path")))
    return pairing.path_set_audit(part.unionByName(more), "split", "path", d.where("doc_id % 5 <> 2").select(F.col("doc_id").alias("path")))


@query(
    """WITH n AS (SELECT o_orderpriority AS route, count(*) AS n_tasks FROM orders GROUP BY 1), t AS (SELECT * FROM (VALUES ('1-URGENT', 300), ('2-HIGH', 0), ('none', 5)) v(route, target))
SELECT coalesce(n.route, t.route) AS route, coalesce(n_tasks, 0)::BIGINT AS n_tasks, coalesce(target, 0)::BIGINT AS target FROM n FULL JOIN t ON n.route = t.route WHERE coalesce(n_tasks, 0) <> coalesce(target, 0)"""
)
def route_targets(spark: S, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("route"), "o_orderkey")
    return composed.target_faults(tasks, "route", {"1-URGENT": 300, "2-HIGH": 0, "none": 5})


@query(
    """WITH l AS (SELECT doc_id, quality FROM labels),
r AS (SELECT d.doc_id, d.source, CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'fake' ELSE 'unknown' END AS label, CASE WHEN d.doc_id % 4 = 0 THEN sha256(trim(text, ' ')) ELSE ' ' END AS given, CASE WHEN d.doc_id % 3 = 0 THEN '  ' ELSE text END AS text
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id WHERE n_chars BETWEEN 20 AND 5000)
SELECT doc_id, CASE label WHEN 'real' THEN 'bonafide' ELSE 'spoof' END AS label, nullif(trim(given, ' '), '') IS NULL AND trim(coalesce(text, ''), ' ') = '' AS surrogate,
  coalesce(nullif(trim(given, ' '), ''), CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN sha256(trim(text, ' ')) END, sha256('record' || chr(0) || source || chr(0) || doc_id)) AS text_hash FROM r WHERE label <> 'unknown'"""
)
def eligible_records(spark: S, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "real").when(F.col("quality") == 0, "fake").otherwise("unknown")
    rows = d.select("doc_id", "source", "n_chars", label.alias("label"), F.when(F.col("doc_id") % 4 == 0, F.sha2(F.trim("text"), 256)).otherwise(" ").alias("given"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"))
    out = composed.eligible_records(rows, F.col("n_chars").between(20, 5000), {"real": "bonafide", "fake": "spoof"}, "label", F.col("text"), F.col("given"), ["record", F.col("source"), F.col("doc_id")])
    return out.select("doc_id", "label", "surrogate", "text_hash")


@query(
    f"""WITH {PRINTS}, d AS (SELECT *, 'd' || (identity % 97) AS digest FROM e), h AS (SELECT 'd' || (identity % 50) AS digest FROM e WHERE identity % 5 = 0), p AS (SELECT * FROM d WHERE identity % 5 <> 0), q AS (SELECT * FROM d WHERE identity % 5 = 0),
near AS (SELECT x.identity, count(*) FILTER (y.identity % 5 = 0) AS nh, count(*) FILTER (y.identity % 5 <> 0) AS np FROM p x JOIN d y ON x.identity <> y.identity AND x.digest <> y.digest
  WHERE bit_count(xor(x.f, y.f)) <= 7 AND greatest(x.s, y.s) - least(x.s, y.s) <= 0.15 * greatest(x.s, y.s) GROUP BY 1),
nh AS (SELECT digest, count(*) AS n FROM h GROUP BY 1), np AS (SELECT digest, count(*) - 1 AS n FROM p GROUP BY 1)
SELECT p.identity, CASE WHEN nh.n IS NOT NULL THEN 'historical_exact' WHEN p.identity <> min(p.identity) OVER (PARTITION BY p.digest) THEN 'pool_exact' WHEN coalesce(near.nh, 0) + coalesce(near.np, 0) > 0 THEN 'near_pending' ELSE 'eligible' END AS decision,
  coalesce(nh.n, 0)::BIGINT AS n_historical_exact, np.n::BIGINT AS n_pool_exact, coalesce(near.nh, 0)::BIGINT AS n_historical_near, coalesce(near.np, 0)::BIGINT AS n_pool_near
FROM p LEFT JOIN nh USING (digest) LEFT JOIN np ON np.digest = p.digest LEFT JOIN near ON near.identity = p.identity"""
)
def decision_inventory(spark: S, sf_dir: str) -> DataFrame:
    """Every candidate with its decision and its exact and near matches, historical and within the pool."""
    d = _prints(spark, sf_dir).withColumn("digest", F.concat(F.lit("d"), F.col("identity") % 97))
    pool, old = d.where("identity % 5 <> 0"), d.where("identity % 5 = 0")
    history = old.select(F.concat(F.lit("d"), F.col("identity") % 50).alias("digest"))
    by_history, by_pool = (perceptual.near_counts(pool, x, threshold=7) for x in (old, pool))
    n = by_history.unionByName(by_pool).groupBy("identity").agg(F.sum("n_near").alias("n_near"))
    made = dedupe.decision(pool, history.distinct(), n, key="identity", digest="digest", ready=F.lit(True), order=["identity"])
    out = dedupe.decision_inventory(made, pool, key="identity", digest="digest", history=history, near_history=by_history, near_pool=by_pool)
    return out.select("identity", "decision", "n_historical_exact", "n_pool_exact", "n_historical_near", "n_pool_near")


@query()
def decode_to_freeze(spark: S, sf_dir: str) -> DataFrame:
    """Every user's day from waveform to frozen selection, days of every tenth user being history (prints have no SQL: tested against plain Python)."""
    w = _waveforms(spark, sf_dir)
    loud = F.transform("samples", lambda v: F.when(F.col("user_id") % 13 == 3, v * 0).otherwise(v).cast("int"))
    name = F.concat_ws("/", "user_id", "day")
    w = w.select(name.alias("sample"), "user_id", (F.col("user_id") % 3).alias("route"), F.sha2(name, 256).alias("rank"), loud.alias("samples"), "segments", (F.col("n_events") * 1.25).alias("speech_seconds"))
    old = w.where("user_id % 10 = 0")
    history = composed.measured(old, ["speech_seconds"]).select("digest", "fingerprint", "speech_seconds")
    with arrow_rows(spark, composed.WAVES_AT_ONCE):
        history = stored(history, "history")
    out = composed.decoded_and_frozen(w.where("user_id % 10 <> 0"), history, key="sample", route="route", rank="rank", target=20, blocks=16)
    return out.select("sample", "route", "status", "flags", "digest", "fingerprint", "decision", "n_near", "position")
