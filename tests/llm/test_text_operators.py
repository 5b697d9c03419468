from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest


def texts(seed=3, n=60, words=400):
    """Unrelated texts, copies, near copies in chains, and a passage that several hold."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    out = [" ".join(r.choices(vocabulary, k=r.randint(1, words))) for _ in range(n)]
    for base in (3, 7):
        now = out[base].split() or ["a"]
        for _ in range(25):
            now = list(now)
            for _ in range(max(1, len(now) // 60)):
                now[r.randrange(len(now))] = r.choice(vocabulary)
            out.append(" ".join(now))
    out += out[5:8]
    passage = " ".join(r.choices(vocabulary, k=70))
    out += [" ".join(r.choices(vocabulary, k=100)) + " " + passage + " " + " ".join(r.choices(vocabulary, k=k)) for k in (5, 60, 200)]
    return out


def brute_components(rows):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    from talweg.llm import ngram_join

    monkeypatch.setattr(ngram_join, "DEAR", 4)
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_signatures_agree_for_every_similar_pair():
    """The pigeonhole: similar sets share a signature, whatever their sizes and classes."""
    from talweg.llm import ngram_join as J

    r = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 33, 60, 64, 127, 130, 500]:
        for _ in range(40):
            s = r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            drop, add = 0, 0
            for _ in range(r.integers(0, n + 1)):
                d, a = (drop + 1, add) if r.random() < 0.5 else (drop, add + 1)
                if 100 * (n - d) >= 80 * (n + a):
                    drop, add = d, a
            t = np.concatenate((s[drop:], r.integers(0, 2**63, add, dtype=np.int64).astype(np.uint64)))
            s, t = np.unique(s), np.unique(t)
            assert J.similar(s, t)
            assert set(J.signatures(s)[0].tolist()) & set(J.signatures(t)[0].tolist())
            assert 9 * J.least_difference(J.sketch(s), J.sketch(t)) <= len(s) + len(t)


def test_ngram_join_keeps_links_across_size_bands(spark, monkeypatch):
    """Hot groups with sizes on both sides of a border: the later of every similar pair probes where the other is."""
    import pyarrow as pa

    from talweg.llm import ngram_join as J
    from talweg.llm.words import word_blocks

    monkeypatch.setattr(J, "DEAR", 8)
    r = random.Random(17)
    rows = []
    for border in (32, 64, 128):
        base = [f"b{border}w{i}" for i in range(border + 4)]
        for k in range(120):
            now = base[: border + 4 - r.randint(1, border // 10)] if k % 2 else base + [f"x{border}k{k}e{i}" for i in range(r.randint(0, border // 10))]
            at = r.randrange(len(now))
            rows.append(" ".join([*now[:at], f"y{border}k{k}", *now[at + 1 :]]))
    r.shuffle(rows)
    sets = {J.node_id(s): s for s in (J.shingle_set(h) for _, h in word_blocks(pa.array(rows)))}
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    probing, held, popular = defaultdict(set), defaultdict(set), {}
    for x in J._Join(df, "doc_id", "text").buckets().collect():
        held[x["node"]].add(x["sig"])
        popular[x["node"]] = x["popular"]
        if x["probes"]:
            probing[x["node"]].add(x["sig"])
    order = sorted(popular, key=lambda n: (-popular[n], n))
    crossing = lost = 0
    for a, b in combinations(order, 2):
        if J.similar(sets[a], sets[b]):
            crossing += len(sets[a]).bit_length() != len(sets[b]).bit_length()
            lost += not probing[b] & held[a]
    assert crossing > 1000 and not lost
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_ngram_join_matches_brute_force_in_large_buckets(spark, monkeypatch):
    """Copies of one text at distances round the threshold, families among them, and texts that share a passage with it."""
    from talweg.llm import ngram_join as J

    monkeypatch.setattr(J, "LEADERS", 2)
    monkeypatch.setattr(J, "DEAR", 1_000_000)
    r = random.Random(23)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = r.choices(vocabulary, k=130)
    rows = [" ".join(base)]
    for k in range(110):
        now = list(base)
        for at in r.sample(range(130), r.randint(1, 6)):
            now[at] = r.choice(vocabulary)
        rows.append(" ".join(now))
        if k % 5 == 0:  # a family of its own
            for _ in range(3):
                near = list(now)
                near[r.randrange(130)] = r.choice(vocabulary)
                rows.append(" ".join(near))
    for k in range(60):
        rows.append(" ".join(r.choices(vocabulary, k=60) + base[20:90] + r.choices(vocabulary, k=r.randint(50, 70))))
        if k % 4 == 0:
            rows.append(rows[-1] + " " + r.choice(vocabulary))
    r.shuffle(rows)
    df = spark.createDataFrame([(str(i).zfill(4), t) for i, t in enumerate(rows)], "doc_id string, text string").repartition(3)
    got = {int(x["doc_id"]): (x["n_shingles"], int(x["component_id"])) for x in J.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) > 40


def test_passages_match_brute_force(spark):
    from talweg.llm import passages

    rows = texts(seed=9, n=40)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in passages.repeated_passages(df).collect()}
    held = defaultdict(set)
    words = [t.lower().split() for t in rows]
    for i, w in enumerate(words):
        for s in range(len(w) - 49):
            held[tuple(w[s : s + 50])].add(i)
    for i, w in enumerate(words):
        marked = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - 49):
            if len(held[tuple(w[s : s + 50])]) > 1:
                marked[s : s + 50] = True
        mine = np.zeros(len(w), dtype=bool)
        for a, b in got.get(i, []):
            mine[a:b] = True
        assert (marked == mine).all() and (i in got) == marked.any()


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_sorted_streams_keep_groups_across_batches(size):
    import pyarrow as pa

    from talweg.llm import ngram_join, passages

    r = random.Random(1)
    rows = sorted((r.randrange(12), r.randrange(3), r.randrange(2)) for _ in range(60))
    groups = defaultdict(set)
    for k, t, _ in rows:
        groups[k].add(t)
    want = sorted({x for x in rows if len(groups[x[0]]) > 1})

    def batches(names, kinds):
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], k) for j, k in enumerate(kinds)], names)

    long = pa.int64()
    out = [tuple(x.values()) for b in passages._neighbours(["key", "text", "place"], False)(batches(["key", "text", "place"], [long] * 3)) for x in b.to_pylist()]
    assert sorted(set(out)) == want  # a row may come again with the next batch
    out = [(x["sig"], x["node"]) for b in ngram_join._shared(batches(["sig", "node", "spare"], [long, long, pa.int32()])) for x in b.to_pylist()]
    assert sorted(out) == sorted({(k, t) for k, t, _ in want})


def test_decontamination_maps_to_the_original(spark, monkeypatch):
    from talweg.llm import decontam

    item = "What is the Capital, of-France and why? Tell me all of it now"
    text = "Préface… what IS the capital of france -- and why tell me all of it now!! what is the capital"
    df = spark.createDataFrame([(1, text), (2, "what is the capital"), (3, "x yes no y")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, "yes-no")], "item_id long, text string")
    got = {r["id"]: r for r in decontam.scan(df, items).collect()}
    (span,) = got[1]["spans"]
    assert text.encode()[span["start"] : span["end"]].decode() == "what IS the capital of france -- and why tell me all of it now"
    assert (got[1]["n_hit"], got[1]["items"]) == (14, ["10"]) and got[2]["n_hit"] == 0
    assert (got[3]["n_hit"], got[3]["items"]) == (2, ["11"])
    items = items.union(spark.createDataFrame([(None, "x yes"), (12, None)], items.schema))
    assert [len(g) for g in decontam._groups(items)] == [3] and [len(g) for g in decontam._groups(items, 10)] == [1, 1, 1]
    got = {r["id"]: r for r in decontam.scan(df, items).collect()}
    assert (got[3]["n_hit"], got[3]["n_items"], got[3]["items"]) == (3, 2, ["11", None])  # an item without an id hits as well
    monkeypatch.setattr(decontam, "_groups", lambda items, f=decontam._groups: f(items, 10))
    assert {r["id"]: r for r in decontam.scan(df, items).collect()} == got
    assert [r["doc_id"] for r in decontam.decontaminated(df, items).collect()] == [2]


def test_maximal_segments_match_definition():
    from talweg.llm.toxicity import maximal_segments

    def recursive(scores, base=0):
        if not scores:
            return []
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1], -x[2]))
        s, _, i, j = best
        if s <= 1e-9:
            return []
        return [*recursive(scores[:i], base), (base + i, base + j - 1, round(s, 6)), *recursive(scores[j:], base + j)]

    r = random.Random(2)
    for _ in range(60):
        items = [(i, float(r.choice([1, 2, 3, 5]) + r.random())) for i in range(30) if r.random() < 0.3]
        scores = [-0.7] * 30
        for i, s in items:
            scores[i] = s
        got = [(a, b, round(s, 6)) for a, b, s in maximal_segments(np.array(scores))]
        assert got == recursive(scores)


def test_toxic_log_odds_and_extreme_values():
    """Counts against a plain loop, lambda against its equation, and the expectation against chance."""
    import math

    from talweg.llm import toxicity as T

    toxic, clean, held = np.array([9.0, 1, 0, 30]), np.array([1.0, 200, 5, 0]), np.array([5, 20, 1, 1])
    got = T.log_odds(toxic, clean, held)
    n_t, n_c = 40, 206
    for i in range(4):
        a = (toxic[i] + clean[i]) * T.PRIOR / (n_t + n_c)
        t, c = toxic[i] + a, clean[i] + a
        odds = math.log(t / (n_t + T.PRIOR - t)) - math.log(c / (n_c + T.PRIOR - c))
        z = odds / math.sqrt(1 / t + 1 / c)
        assert abs(got[i] - (odds * z * z / (1 + z * z) if held[i] > 1 else 0)) < 1e-12
    r = np.random.default_rng(3)
    share, scores = np.array([0.9, 0.07, 0.03]), np.array([-0.5, 1.0, 2.0])
    rate = T._root(share, scores)
    assert abs((share * np.exp(rate * scores)).sum() - 1) < 1e-6
    best = np.array([max((s for _, _, s in T.maximal_segments(r.choice(scores, 400, p=share))), default=0.0) for _ in range(1500)])
    model = T.Lexicon({})
    model.rate = rate
    model.fit_chance(np.full(1500, 400), best)
    high = np.quantile(best, 0.95)
    assert 0.5 < (best >= high).mean() / (1 - math.exp(-math.exp(model.expected(400, high)))) < 2
    assert T.fresh(["a", "b", "a"] + ["c"] * 3 + [str(i) for i in range(60)] + ["a"]).tolist() == [True, True, False, True, False, False] + [True] * 61


def labelled(spark, seed=1, n=400):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tre") for b in ("ra", "ne", "su", "po") for c in ("n", "l", "sh", "")]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(20, 200))
        toxic = i % 4 == 0
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = r.choices(["vile", "nasty", "awful"], k=3)
        good = i % 3 > 0
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_hold_out(spark):
    from pyspark.sql import functions as F

    from talweg.llm import quality, toxicity

    docs, labels = labelled(spark)
    net = quality.fitted(docs, labels, allowed=~quality.held_out(F.col("doc_id")))
    out = quality.scored(docs, net).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    assert out.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.97
    model = toxicity.fitted(docs, labels, allowed=~toxicity.held_out(F.col("doc_id")))
    assert set(sorted(model.scores, key=model.scores.get)[-3:]) == {"vile", "nasty", "awful"} and len(model.scores) > 20
    out = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert out.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("toxic")).cast("double"))).first()[0] > 0.97


def test_toxic_words_of_a_small_language_enter_the_lexicon(spark):
    from talweg.llm import toxicity

    r = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        toxic, small = i % 6 == 0, i % 100 == 0 or i % 100 == 6
        words = r.choices([f"{'s' if small else 'b'}{k}" for k in range(80)], k=60)
        if toxic:
            words[20:20] = ["malo", "feo", "vil"] if small else ["vile", "nasty", "awful"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(docs, known)
    few = sum(y for (i, y), (_, t) in zip(labels, rows, strict=True) if "malo" in t)
    assert 4 <= few <= 20 and {"malo", "feo", "vil", "vile"} <= {w for w, s in model.scores.items() if s > 2}
    got = {x["doc_id"]: x["score"] for x in toxicity.scored(docs, model).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(y) for i, y in labels)


def test_network_matches_a_plain_loop_and_finite_differences():
    from talweg.llm import quality as Q

    net = Q.Net()
    net.trained = True
    r = np.random.default_rng(8)
    net.p["b"] = r.standard_normal(Q.FILTERS).astype(np.float32) * 0.1
    texts = [bytes(r.integers(1, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 255, 256, 257, 512, 513, 700, 1500)]

    def plain(t):
        e, w, b = (net.p[k].astype(np.float64) for k in "ewb")
        x = e[np.frombuffer(t.ljust(max(1, len(t)) + 2 * Q.WIDTH, b"\0"), dtype=np.uint8)]
        out = [x[at : at + Q.WIDTH].reshape(-1) @ w + b for at in range(0, max(1, len(t)), Q.STRIDE)]
        step = Q.CHUNK // 2 // Q.STRIDE
        cells = [np.max(out[at : at + step], axis=0) for at in range(0, len(out), step)]
        chunks = np.maximum([np.maximum(a, c) for a, c in zip(cells, cells[1:])] or cells, 0)
        feats = np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0)))
        return 1 / (1 + np.exp(-(feats @ net.p["v"] + net.p["c"][0])))

    assert np.allclose(net.scores(texts), [plain(t) for t in texts], atol=1e-5)
    y, weight = np.array([i % 2 for i in range(len(texts))]), np.ones(len(texts))
    grads = net._gradients(texts, y, weight)

    def loss():
        p = np.array([plain(t) for t in texts])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * float((net.p["v"].astype(np.float64) ** 2).sum())

    for k, at in [("e", (65, 3)), ("e", (200, 0)), ("w", (5, 2)), ("w", (40, 11)), ("b", (4,)), ("v", (3,)), ("v", (30,)), ("c", (0,))]:
        was, h = net.p[k][at], 1e-3
        net.p[k][at] = was + h
        up = loss()
        net.p[k][at] = was - h
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / (2 * h) - grads[k][at]) < 2e-4 + 0.05 * abs(grads[k][at]), (k, at)


def test_scores_do_not_depend_on_pieces(monkeypatch):
    from talweg.llm import quality

    net = quality.Net()
    net.trained = True
    text = bytes(random.Random(4).choices(range(32, 127), k=5000))
    whole = net.scores([text, b"", b"ab"])
    monkeypatch.setattr(quality, "PIECE", 1024)
    monkeypatch.setattr(quality, "BLOCK", 1500)
    assert np.allclose(whole, net.scores([text, b"", b"ab"]), atol=1e-5)
