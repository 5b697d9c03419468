from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def manifest(spark, *changes):
    from talweg import schema as S

    base = dict(
        sample_id="sample-1", relative_path="processed/ru/sample-1.wav", sha256="a" * 64, split="train", label="bonafide", language="ru", code_switch="false",
        parent_group_id="parent-1", source_name="consented", source_license="consent-v1", rights_basis="consent-001", speaker_pseudo_id="speaker-1",
        text_id="text-1", text_hash="text-hash-1", duration_s="3.0", original_sr="48000", generator_family="", generator_name="", generator_version="",
        voice_id="", clone_consent_id="", augmentation_chain="", augmentation_seed="", device="android", capture_route="local", codec="wav", created_at="2026-08-08T00:00:00Z",
    )
    data = [tuple({**base, **c}[n] for n in S.MANIFEST.names) for c in changes]
    return spark.createDataFrame(data, S.MANIFEST)


def test_row_rules_short_circuit_and_accumulate(spark):
    from talweg.operators import validation as V

    df = manifest(
        spark, {"sample_id": "ok"}, {"sample_id": "b", "text_id": " ", "sha256": "x"}, {"sample_id": "c", "sha256": "x", "relative_path": "../a"},
        {"sample_id": "d", "relative_path": "/abs"}, {"sample_id": "e", "split": "x", "duration_s": "-1", "original_sr": "1.5", "created_at": "yesterday"},
        {"sample_id": "f", "label": "spoof", "generator_family": "g"}, {"sample_id": "g", "voice_id": "v"}, {"sample_id": "h", "language": "other"},
    )
    got = {r["sample_id"]: r["i"] for r in df.select("sample_id", V.manifest_issues().alias("i")).collect()}
    assert got["ok"] == [] and got["b"] == ["text_id: blank"] and got["c"] == ["sha256: not a digest"]
    assert got["d"] == ["relative_path: not portable"]
    assert got["e"] == ["split: not allowed", "duration_s: not positive", "original_sr: not positive", "created_at: not ISO-8601"]
    assert got["f"] == ["spoof lacks generator_name,generator_version,voice_id"] and got["g"] == ["bonafide has voice_id"]
    assert got["h"] == ["language: other outside ood"]
    with pytest.raises(ValueError, match="rows"):
        V.require_empty(df, "rows")


def test_leakage_duplicates_and_contiguity(spark):
    from talweg.operators import validation as V

    df = manifest(spark, {"sample_id": "1"}, {"sample_id": "2", "split": "dev", "text_hash": "t2"}, {"sample_id": "3", "text_hash": ""})
    assert {(r["field"], r["splits"]) for r in V.cross_split_leakage(df).collect()} == {("parent_group_id", "dev,train"), ("speaker_pseudo_id", "dev,train")}
    assert [(r["field"], r["occurrence"]) for r in V.duplicate_occurrences(df, ["sha256", "sample_id"]).collect()] == [("sha256", 2), ("sha256", 3)]
    ranks = rows(spark, "g string, r int", ("a", 1), ("a", 2), ("b", 1), ("b", 3))
    assert {r["g"]: r["contiguous"] for r in V.contiguous_ranks(ranks, ["g"], "r").collect()} == {"a": True, "b": False}


def test_ledger_and_consents(spark):
    from talweg import schema as S
    from talweg.operators import validation as V

    good = dict(zip(S.LEDGER.names, ["s1", "commercial_clean", "Product_allowed ", "prohibited", "verified", "verified", "cc", "u", "a", "10", "2026-08-08", "B" * 64, "r", "verified", "n"], strict=True))
    bad = {**good, "source_id": "s2", "expected_size_bytes": "0", "sha256": ""}
    ledger = spark.createDataFrame([tuple(x[n] for n in S.LEDGER.names) for x in (good, bad)], S.LEDGER)
    got = {r["source_id"]: r["i"] for r in ledger.select("source_id", V.ledger_issues().alias("i")).collect()}
    assert got == {"s1": [], "s2": ["expected_size_bytes: not positive", "sha256: approved without digest"]}
    df = manifest(spark, {"source_name": "s1"}, {"source_name": "s1", "split": "ood"}, {"source_name": "zz"})
    found = {(r["rule"], r["value"]) for r in V.training_protocol_issues(df, ledger).collect()}
    assert found == {("source missing from the ledger", "zz"), ("split empty", "dev"), ("split empty", "test"), ("split lacks a label", "train")}
    consent = ["c1:x", "spk", "ru", "1", "true", "TRUE", "true", "active", "2026-01-01", ""]
    other = ["c2:x", "sqk", "ru", "1", "true", "no", "true", "active", "2026-01-01", "2027-01-01T10:00"]
    df = spark.createDataFrame([tuple(consent), tuple(other)], S.CONSENT)
    got = {r["consent_record_id"]: r["i"] for r in df.select("consent_record_id", V.consent_issues().alias("i")).collect()}
    assert got == {"c1:x": [], "c2:x": ["synthetic_derivatives_authorized: not boolean", "revoked_at: set on active"]}
    assert {r[0]: (r[1], r[2]) for r in V.eligible_speakers(df).collect()} == {"spk": (True, ""), "sqk": (False, "synthetic_derivatives_authorized")}


def test_training_protocol_scenarios(spark):
    from talweg import schema as S
    from talweg.operators import validation as V

    good = dict(zip(S.LEDGER.names, ["s1", "commercial_clean", "product_allowed", "product_allowed", "verified", "verified", "cc", "u", "a", "10", "", "b" * 64, "r", "verified", "n"], strict=True))
    changes = []
    for i, split in enumerate(S.SPLITS):
        changes += [{"split": split, "label": "bonafide"}, {"split": split, "label": "spoof", "generator_family": f"f{split == 'ood'}", "voice_id": f"v{i}"}]
    frame = manifest(spark, *[c | {"source_name": "s1", "sample_id": str(i)} for i, c in enumerate(changes)])

    def found(ledger, purpose, rows=frame):
        table = spark.createDataFrame([tuple(ledger[n] for n in S.LEDGER.names)], S.LEDGER)
        return {(r["rule"], r["value"]) for r in V.training_protocol_issues(rows, table, purpose).collect()}

    assert found(good, "product") == set() == found(good | {"train_dev_test_use": "research_only"}, "research")
    assert found(good | {"train_dev_test_use": "prohibited"}, "research") == {("use prohibited", "s1:train_dev_test_use")}
    weak = good | {"status": "owner_authorized_personal_research", "usage_scope": "x", "ood_evaluation_use": "research_only", "spoof_voice_group_provenance": "unknown"}
    assert found(weak, "product") == {("use not for products", "s1:ood_evaluation_use"), ("status not verified", "s1"), ("scope not commercial", "s1"), ("groups not verified", "s1:spoof")}
    assert found(good, "product", frame.where("split <> 'ood'")) == {("split empty", "ood"), ("no generator family in ood", "ood")}
    from pyspark.sql import functions as F

    one = frame.withColumn("generator_family", F.when(F.col("label") == "spoof", "f").otherwise("")).withColumn("voice_id", F.lit("v"))
    assert found(good, "product", one) == {("generator family in ood and elsewhere", "f"), ("voice in several splits", "v")}
    assert S.MANIFEST.names[14:16] == ["duration_s", "generator_family"] and set(S.MANDATORY) | set(S.OPTIONAL) == set(S.MANIFEST.names)


def test_anti_join_scenario(spark):
    from talweg.operators import overlap as O

    schema = "sample_id string, sha256 string, parent_group_id string, text_hash string"
    train = rows(spark, schema, ("t1", "s1", "p1", "x1"), ("t2", "s2", "p2", "x2"))
    dev = rows(spark, schema, ("a", "s9", "p9", "x9"), ("b", "s2", "p8", "x8"), ("c", "s7", "p7", "x8"), ("d", "s6", "p1", "x1"))
    out = O.anti_join_reasons(dev, train, ("sha256", "parent_group_id", "text_hash"), "sample_id")
    got = {r["sample_id"]: r["reasons"] for r in out.collect()}
    assert got == {"a": [], "b": ["sha256"], "c": ["paired_text_group"], "d": ["parent_group_id", "text_hash"]}
    assert [r[0] for r in O.survivors(out, "sample_id").collect()] == ["a"]
    assert {r[0]: r[1] for r in O.reason_histogram(out).collect()} == {"sha256": 1, "paired_text_group": 1, "parent_group_id": 1, "text_hash": 1}


def test_taint_is_one_hop(spark):
    from talweg.operators import overlap as O

    df = rows(spark, "id string, g string, s string", ("exposed", "g1", "s1"), ("same", "g1", "s2"), ("second", "g2", "s2"), ("free", "g3", "s3"))
    out = O.group_taint_exclusion(df, df.where("id = 'exposed'"), "id", ("g", "s"))
    assert {r["id"] for r in out.collect()} == {"second", "free"}


def water_fill(counts, total, low, high):
    got = {s: low for s in counts}
    while sum(got.values()) < total:
        for s in sorted(counts, key=lambda s: (-(counts[s]), s)):
            if sum(got.values()) < total and got[s] < min(high, counts[s]) and got[s] == min(v for k, v in got.items() if v < min(high, counts[k])):
                got[s] += 1
    return got


def test_quotas(spark):
    from talweg.operators import sampling as Q

    r = random.Random(4)
    data, want = [], {}
    for g in range(12):
        counts = {f"s{i}": r.randint(1, 12) for i in range(r.randint(1, 6))}
        total = r.randint(len(counts), sum(min(8, c) for c in counts.values()))
        data += [(f"g{g}", s, c, total) for s, c in counts.items()]
        want |= {(f"g{g}", s): q for s, q in water_fill(counts, total, 1, 8).items()}
    df = rows(spark, "g string, s string, n long, total int", *data)
    got = {(x["g"], x["s"]): x["quota"] for x in Q.bounded_quota(df, "g", "s", "n", F.col("total"), 1, 8).collect()}
    assert got == want
    assert Q.quota_faults(df, "g", "n", F.col("total"), 1, 8).count() == 0
    largest = Q.largest_remainder(rows(spark, "g string, s string, n long, total int", ("g", "a", 10, 12), ("g", "b", 5, 12), ("g", "c", 1, 12)), "g", "s", "n", F.col("total"), 1)
    assert {x["s"]: x["quota"] for x in largest.collect()} == {"a": 7, "b": 4, "c": 1}


def test_near_duplicates_and_cascade(spark):
    from talweg.operators import dedupe as D
    from talweg.operators import perceptual as P

    schema = "identity string, digest string, fingerprint string, speech_seconds double, ready boolean"
    a = rows(spark, schema, ("x", "dx", "0" * 64, 4.0, True), ("y", "dy", "f" * 64, 4.0, True), ("z", "dx", "0" * 64, 4.0, True), ("w", "dw", "1" * 64, 1.0, False))
    refs = rows(spark, schema, ("r1", "d1", "0" * 63 + "1", 4.1, True), ("r2", "d2", "0" * 63 + "1", 8.0, True))
    near = P.near_matches(a, refs)
    assert {(r["candidate"], r["reference"], r["distance"]) for r in near.collect()} == {("x", "r1", 1), ("z", "r1", 1)}
    counts = D.near_of_other_digests(near, a, key="identity", digest="digest")
    out = D.decision(a, rows(spark, "digest string", ("dy",)), counts, key="identity", digest="digest", ready=F.col("ready"), order=["identity"])
    assert {r["identity"]: r["decision"] for r in out.collect()} == {"x": "near_pending", "y": "historical_exact", "z": "pool_exact", "w": "not_ready"}


def test_segments_and_windows(spark):
    from talweg.operators import timeseries as TS

    on = {0, 1, 2, 4, 5, 12, 19}
    frames = rows(spark, "a string, i long, active boolean", *[("a", i, i in on) for i in range(20)])
    runs = TS.islands(frames, ["a"], "i", "active")
    spans = TS.segments(runs, ["a"], 480, F.lit(9700).cast("long"), F.lit(19))
    merged = TS.merged_segments(spans, ["a"], 480, 500)
    assert sorted((r["start"], r["end"]) for r in merged.collect()) == [(0, 2880), (9120, 9700)]
    win = TS.sliding_windows(rows(spark, "a string, start long, end long", ("a", 0, 250), ("a", 300, 350)), ["a"], 100, 60)
    assert sorted((r["start"], r["end"]) for r in win.collect()) == [(0, 100), (60, 160), (120, 220), (150, 250), (300, 350)]
    x = spark.range(1).select(F.array(*[F.lit(v).cast("short") for v in (1, 2, 3)]).alias("x"))
    assert x.select(TS.cropped(F.col("x"), 7)).first()[0] == [1, 2, 3, 1, 2, 3, 1] and x.select(TS.cropped(F.col("x"), 2, 1)).first()[0] == [2, 3]
    q = x.select(TS.array_quality(F.col("x")).alias("q")).first()["q"]
    assert abs(q["peak"] - 3 / 32768) < 1e-12 and q["clipped_fraction"] == 0


def test_metric_vectors(spark):
    from talweg.operators import metrics as M

    df = rows(spark, "k long, n long", (10, 10), (107, 110), (88, 100), (0, 0))
    got = [r["w"] for r in df.select(M.wilson(F.col("k"), F.col("n")).alias("w")).collect()]
    assert 0.69 < got[0]["low"] < 0.73 and got[0]["high"] == 1.0
    assert abs(got[1]["low"] - 0.922869) < 1e-6 and abs(got[1]["high"] - 0.990682) < 1e-6
    assert abs(got[2]["low"] - 0.8019) < 1e-4 and abs(got[2]["high"] - 0.9300) < 1e-4 and got[3] is None
    w = rows(spark, "g int, x double, w long", (1, 0.0, 64600), (1, 2.0, 32300))
    assert abs(M.weighted_mean(w, ["g"], "x", "w").first()[1] - 2 / 3) < 1e-12
    p = rows(spark, "g int, x double", *[(1, v) for v in (-3.0, -1.0, 0.5, 2.0, 4.0)])
    assert M.peak_mean(p, ["g"], "x").first()[1] == 3.0
    e = rows(spark, "g int, x double, y boolean", (1, 0.0, True), (1, 0.0, False), (1, 1.0, True), (1, -1.0, False))
    assert M.confusion(e, ["g"], "x", F.col("y")).first()["fp"] == 1
    assert M.eer(e, ["g"], "x", F.col("y")).first()[1] == 0.25
    c = rows(spark, "x double, y int", (8.0, 1), (8.0, 1), (8.0, 0), (-8.0, 0), (-8.0, 0), (-8.0, 1))
    t = M.temperature(c, "x", F.col("y"))
    assert abs(1 / (1 + 2.718281828459045 ** (-8 / t)) - 2 / 3) < 1e-6


@pytest.mark.parametrize("bound", [0, 200_000])
def test_components_and_splits(spark, monkeypatch, bound):
    from talweg.operators import components
    from talweg.operators import graph as G
    from talweg.operators.components import connected_components

    monkeypatch.setattr(components, "ONE_TASK", bound)

    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["node"]: x["component"] for x in connected_components(rows(spark, "a long, b long", *edges)).collect()}
    assert got == {x: find(x) for x in parent}
    df = rows(spark, "sample_id string, split string, g string, t string", ("1", None, "a", "x"), ("2", None, "b", "x"), ("3", None, "b", "y"), ("4", None, "c", ""), ("5", "ood", "a", "z"))
    out = {x["sample_id"]: (x["component"], x["split"]) for x in G.assigned_splits(df, "sample_id", ("g", "t"), "s").collect()}
    assert out["1"] == out["2"] == out["3"] and out["1"][0] == "g:a" and out["4"][0] == "g:c" and out["5"] == (None, "ood")
    assert [tuple(x) for x in G.ood_leaks(df.na.fill("train", ["split"]), ("g", "t")).collect()] == [("g", "a")]


def test_greedy_and_matching(spark):
    from talweg.operators import graph as G

    r = random.Random(6)
    data = [(f"{i:04d}", r.randrange(25), r.randrange(25)) for i in range(120)]
    r.shuffle(data)
    seen_a, seen_b, want = set(), set(), []
    for k, a, b in sorted(data):
        if a not in seen_a and b not in seen_b and len(want) < 12:
            want.append(k)
            seen_a.add(a)
            seen_b.add(b)
    out = G.greedy_distinct(rows(spark, "k string, a int, b int", *data), "k", "a", "b", 12)
    assert sorted(x["k"] for x in out.collect()) == want
    chain = [(f"{i:04d}", i // 2, (i + 1) // 2) for i in range(12)]  # a round a row where nothing is random
    out = G.greedy_distinct(rows(spark, "k string, a int, b int", *chain), "k", "a", "b", 3)
    assert sorted(x["k"] for x in out.collect()) == loop(chain, 3)


def loop(data: list, target: int) -> list:
    a, b, out = set(), set(), []
    for k, x, y in sorted(data):
        if x not in a and y not in b and len(out) < target:
            a.add(x)
            b.add(y)
            out.append(k)
    return out


def largest(edges: set) -> int:
    """Size of a maximum matching, by recursion over the lefts."""
    partner: dict = {}

    def found(x, seen: set) -> bool:
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                if b not in partner or found(partner[b], seen):
                    partner[b] = x
                    return True
        return False

    return sum(found(x, set()) for x in sorted({a for a, _ in edges}))


def test_matching_is_maximum(spark):
    from talweg.operators import graph as G

    r = random.Random(11)
    ladder = {(i, i) for i in range(6)} | {(i, i + 1) for i in range(5)}  # long augmenting paths
    graphs = [set(), ladder, {(r.randrange(30), r.randrange(25)) for _ in range(60)} | {(100 + i, 0) for i in range(5)}]
    for g in graphs:
        df = rows(spark, "l int, r int", *g, *list(g)[:3], (None, 1), (1, None)) if g else rows(spark, "l int, r int", (None, 1))
        for greedy in (0, 3) if g == ladder else (2,):
            pairs = {tuple(x) for x in G.matched(df, "l", "r", greedy).collect()}
            assert pairs <= g and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == largest(g)
        lefts, rights = G.vertex_cover(df, rows(spark, "l int, r int", *pairs), "l", "r")
        a, b = {x[0] for x in lefts.collect()}, {x[0] for x in rights.collect()}
        assert len(a) + len(b) == len(pairs) and all(x in a or y in b for x, y in g)


def test_journal_batch_and_stream(spark, tmp_path):
    from talweg.streaming import journal as J

    lines = [
        '{"candidate_id":"a","line":1,"event":"started"}', '{"candidate_id":"a","line":2,"event":"generated","output_sha256":"' + "a" * 64 + '"}',
        '{"candidate_id":"b","line":3,"event":"started"}', '{"candidate_id":"c","line":4,"event":"failed","error":"x"}',
        '{"candidate_id":"d","line":5,"event":"started"}', '{"candidate_id":"d","line":6,"event":"started","error":"y"}',
    ]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text("\n".join(lines))
    journal = J.read_journal(spark, f"{tmp_path}/j")
    want = {"a": "generated", "b": "started", "c": "invalid", "d": "invalid"}
    assert {r["candidate_id"]: r["state"] for r in J.replayed(journal).collect()} == want
    assert {r["line"] for r in J.order_faults(journal).collect()} == {4, 6}
    assert {r["line"]: r["i"] for r in journal.select("line", J.event_issues().alias("i")).where("size(i) > 0").collect()} == {6: ["error: not failed"]}
    tasks = rows(spark, "candidate_id string", ("a",), ("b",), ("b",), ("d",))
    assert {r[0]: r[1] for r in J.unmatched(journal, tasks).collect()} == {"b": 2, "c": 0}
    assert {r[0] for r in J.remaining(tasks, journal).collect()} == {"b", "d"}


def test_sources(spark, tmp_path):
    import io
    import wave

    from talweg import schema as S
    from talweg.sources import files as L
    from talweg.sources import tables as T

    (tmp_path / "m").mkdir()
    line = ",".join(["x"] * 26) + ',"a ""b"", c"'
    (tmp_path / "m" / "a.csv").write_text(",".join(S.MANIFEST.names) + "\n" + line + "\n")
    (tmp_path / "m" / "b.csv").write_text("other,columns\n1,2\n1,2,3\n")
    df = T.read_manifest(spark, f"{tmp_path}/m/a.csv")
    assert df.first()["created_at"] == 'a "b", c' and T.numbered(df).first()["row_number"] == 2
    assert [r["path"].rpartition("/")[2] for r in L.discovered(spark, f"{tmp_path}/m", S.MANIFEST.names).collect()] == ["a.csv"]
    assert [(r["record"], r["n_fields"]) for r in L.structural_faults(spark, f"{tmp_path}/m", pattern="b.csv").collect()] == [(3, 3)]
    with pytest.raises(ValueError, match="header"):
        T.read_ledger(spark, f"{tmp_path}/m/b.csv")
    (tmp_path / "t.tsv").write_text('a\t"b\n')
    schema = rows(spark, "x string, y string").schema
    assert tuple(T.read_tsv(spark, f"{tmp_path}/t.tsv", schema, header=False, quoted=False).first()) == ("a", '"b')
    wav = io.BytesIO()
    with wave.open(wav, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes(b"\x01\x00\x02\x00")
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "1.wav").write_bytes(wav.getvalue())
    (tmp_path / "arc" / "3.wav").write_bytes(b"nope")
    members = T.files(spark, f"{tmp_path}/arc").select(F.substring_index("path", "/", -1).alias("member"), "content")
    heard = {r["member"]: r["p"] for r in members.where("member LIKE '%wav'").select("member", T.pcm16_mono(F.col("content")).alias("p")).collect()}
    assert heard["1.wav"]["samples"] == [1, 2] and heard["3.wav"]["samples"] is None and heard["3.wav"]["error"]
    assert T.referenced_manifests('{"a":[{"manifest":"x"},{"b":{"manifest":"y"}},{"manifest":"x"}]}') == ["x", "y"]
    out = T.published(rows(spark, "a int", (2,), (1,)), f"{tmp_path}/pub", key="a")
    assert '"rows":2' in out
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        T.published(rows(spark, "a int", (2,)), f"{tmp_path}/pub")
    with pytest.raises(ValueError, match="pub2"):
        T.published(rows(spark, "a int", (2,)), f"{tmp_path}/pub2", faults=rows(spark, "a int", (1,)))


def test_text_functions(spark):
    from talweg.functions import keys, text

    df = rows(spark, "s string", ("  a  b \x1c c ",), ("ok-id_1",), ("bad id",))
    got = df.select(text.collapsed(F.col("s")).alias("c"), text.identifier(F.col("s")).alias("i"), text.portable_path_ok(F.col("s")).alias("p")).collect()
    assert got[0]["c"] == "a b c" and [r["i"]["status"] for r in got] == ["digested", "kept", "digested"]
    times = rows(spark, "s string", ("2026-08-08T00:00:00Z",), ("2026-13-08T00:00:00Z",), ("2026-08-08",))
    assert [r[0] for r in times.select(text.iso_timestamp_ok(F.col("s"))).collect()] == [True, False, False]
    import hashlib

    blob = rows(spark, "b binary", (bytearray(b"hello\n"),)).select(keys.git_blob_sha1(F.col("b"))).first()[0]
    assert blob == hashlib.sha1(b"blob 6\0hello\n").hexdigest()
    u = rows(spark, "v string", ("x",)).select(keys.unit_hash("s", F.col("v"))).first()[0]
    assert u == int(hashlib.sha256(b"s:x").hexdigest()[:16], 16) / 2**64


def test_review_gate_and_reconciliation(spark):
    from talweg.operators import pairing as P

    packet = rows(spark, "id int, sha string", *[(i, f"h{i}") for i in range(5)])
    reviews = rows(
        spark, "id int, reviewer string, sha string, q string", (0, "a", "h0", "yes"), (0, "b", "h0", "yes"), (1, "a", "h1", "yes"), (2, "a", "h2", "yes"), (2, "b", "h2", "no"),
        (3, "a", "zz", "yes"), (3, "b", "h3", "yes"), (9, "a", "h9", "yes"),
    )
    got = {r["id"]: r["state"] for r in P.review_gate(packet, reviews, "id", ("sha",), ("q",)).collect()}
    assert got == {0: "eligible", 1: "not_eligible", 2: "rejected", 3: "mismatch", 4: "not_eligible", 9: "foreign"}
    assert {tuple(r) for r in P.set_equality(rows(spark, "k int", (1,), (2,)), rows(spark, "k int", (2,), (3,)), "k").collect()} == {(1, "left"), (3, "right")}


def test_running_sums_equal_windows(spark):
    from talweg.operators import prefix

    r = random.Random(9)
    data = [(None if i % 50 == 0 else r.choice("aab"), r.randrange(40), r.randrange(9), i) for i in range(900)]
    df = rows(spark, "g string, x int, v int, i int", *data).repartition(5)
    got = {x["i"]: (x["s"], x["all"]) for x in prefix.running_sums(df, ["g"], [F.desc("x")], {"s": F.col("v")}, {"all": F.col("v")}).collect()}
    assert got == {i: (sum(v for h, y, v, _ in data if h == g and y >= x), sum(v for h, _, v, _ in data if h == g)) for g, x, _, i in data}
    got = {x["i"]: x["rank"] for x in prefix.numbered(df, ["g"], ["x", "i"]).collect()}
    for g in ("a", "b", None):
        mine = sorted((x, i) for h, x, _, i in data if h == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_manifests_and_ledgers_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from talweg import schema as S
    from talweg.sources import tables as T

    frame = manifest(spark, {"sample_id": "2", "label": "bonafide", "text_id": 'a "b", c'}, {"sample_id": "1", "label": "bonafide", "augmentation_chain": ""})
    digest = T.write_manifest(frame, f"{tmp_path}/m.csv")
    raw = (tmp_path / "m.csv").read_bytes()
    import hashlib

    assert hashlib.sha256(raw).hexdigest() == digest and raw.decode().splitlines()[0] == ",".join(S.MANIFEST.names)
    back = T.read_manifest(spark, f"{tmp_path}/m.csv")
    assert back.exceptAll(frame).count() == 0 and [r["sample_id"] for r in back.collect()] == ["1", "2"]
    with pytest.raises(FileExistsError):
        T.write_manifest(frame, f"{tmp_path}/m.csv")
    with pytest.raises(ValueError, match="not allowed"):
        T.write_manifest(frame.withColumn("split", F.lit("odd")), f"{tmp_path}/n.csv")
    lines = raw.decode().splitlines()
    (tmp_path / "bad.csv").write_text("\n".join([lines[0], lines[1], lines[1], lines[2].replace("train", "odd")]) + "\n")
    assert {(r["row_number"], r["issue"]) for r in T.manifest_report(spark, f"{tmp_path}/bad.csv").collect()} == {(3, "sample_id: repeated"), (4, "split: not allowed")}
    ledger = spark.createDataFrame([tuple([s] + ["x"] * 14) for s in ("b", "a", "c")], S.LEDGER)
    assert T.write_ledger_snapshot(ledger, ["b", "a", "b"], f"{tmp_path}/l.csv") == ["a", "b"]
    assert [r["source_id"] for r in T.read_ledger(spark, f"{tmp_path}/l.csv").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="missing"):
        T.write_ledger_snapshot(ledger, ["z"], f"{tmp_path}/z.csv")
    assert not [p.name for p in tmp_path.iterdir() if "stage" in p.name or p.name in ("n.csv", "z.csv")]
    assert T.write_once_json(spark, f"{tmp_path}/x.json", {"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    with pytest.raises(FileExistsError):
        T.write_once_json(spark, f"{tmp_path}/x.json", {})


def test_publication_is_all_or_nothing(spark, tmp_path, monkeypatch):
    from talweg.sources import tables as T

    a, b = rows(spark, "a int", (1,), (2,)), rows(spark, "b string", ("x",))
    T.published_together({f"{tmp_path}/a": a, f"{tmp_path}/b": b})
    assert spark.read.parquet(f"{tmp_path}/a/data").count() == 2 and (tmp_path / "b" / "_receipt").is_dir()
    wrong = a.select((a.a / (a.a - 1)).alias("a"))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with pytest.raises(Exception, match="(?i)zero"):
        T.published_together({f"{tmp_path}/c": b, f"{tmp_path}/d": wrong})
    real = T._file_system

    class Stuck:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *paths):
            return False

    def patched(spark, path):
        fs, hadoop = real(spark, path)
        return (Stuck(fs) if path == f"{tmp_path}/f" else fs), hadoop

    monkeypatch.setattr(T, "_file_system", patched)
    with pytest.raises(OSError, match="cannot publish"):
        T.published_together({f"{tmp_path}/e": b, f"{tmp_path}/f": a})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_scorers_must_answer_once(spark):
    from talweg.operators import composed as C

    df = rows(spark, "k int, x double", *[(i, float(i)) for i in range(10)])
    assert {r["k"]: r["logit"] for r in C.scored_once(df, "k", ["x"], lambda f: f["x"] * 2, batch=3).collect()} == {i: 2.0 * i for i in range(10)}
    for bad in (lambda f: f["x"].iloc[1:], lambda f: f["x"] / 0):
        with pytest.raises(Exception, match="logits"):
            C.scored_once(df, "k", ["x"], bad).collect()


def test_injected_preparers_and_detectors(spark):
    from talweg.operators import composed as C

    df = spark.createDataFrame([(1, [0, 5, 9, 0, 7]), (2, []), (3, None), (4, [13])], "k long, x array<int>")

    def preparer(x):
        if len(x) and x[0] == 13:
            raise ValueError("bad")
        return x * 2, "ready" if len(x) else "no_speech"

    got = {r["k"]: (r["samples"], r["status"]) for r in C.prepared(df, "k", "x", preparer).collect()}
    assert got == {1: ([0, 10, 18, 0, 14], "ready"), 2: ([], "no_speech"), 3: ([], "no_speech"), 4: (None, "error: ValueError")}
    loud = lambda x: [(i, i + 1) for i, v in enumerate(x) if v > 4 and v != 9] if len(x) > 1 else [(0, 5)] * len(x)
    spans = {r["k"]: ([tuple(s) for s in r["segments"]], r["fault"]) for r in C.detected(df, "k", "x", loud).collect()}
    assert spans == {1: ([(1, 2), (4, 5)], None), 2: ([], None), 3: ([], None), 4: ([(0, 5)], "segments")}


def test_slices_say_where_they_fall_short(spark):
    from talweg.operators import sampling as Q

    df = rows(spark, "l string, s string, k int", *[("a", f"s{i % 3}", i) for i in range(30)], *[("b", "t", i) for i in range(4)])
    chosen = Q.balanced_slice(df, "l", "s", "k", 10, 2, "seed")
    n = {(r["l"], r["s"]): r["n"] for r in chosen.groupBy("l", "s").agg(F.count("*").alias("n")).collect()}
    assert sum(v for (a, _), v in n.items() if a == "a") == 10 and min(n.values()) >= 3 and n["b", "t"] == 4
    assert {tuple(r) for r in Q.slice_faults(df, chosen, "l", "s", 10, 2).collect()} == {("b", "too few rows"), ("b", "not the limit")}


def test_final_inputs_fall_short_openly(spark):
    from talweg.operators import protocols as P

    df = rows(spark, "k string, g string, t string, l string", ("a", "g1", "бір 5", "kk"), ("b", "g1", "екі", "kk"), ("c", "g2", "бір 5", "kk"), ("d", "g3", "latin", "kk"), ("e", "g4", "три", "ru"), ("f", "g5", "x", "ru"))
    scopes = {"seen": rows(spark, "g string", ("g4",))}
    out = P.final_inputs(df, scopes, key="k", group="g", text="t", language="l", fields=["g"], seed="s", targets={"kk": 3, "ru": 1})
    got = out.collect()
    assert {r["k"] for r in got} in ({"a"}, {"b", "c"}) and all(r["l"] == "kk" for r in got) and sorted(r["position"] for r in got) == list(range(1, len(got) + 1))
    assert {(r["rule"], r["key"]) for r in P.final_input_shortages(out, "l", {"kk": 3, "ru": 1}).collect()} == {("shortage", "kk"), ("shortage", "ru")}
