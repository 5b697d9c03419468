"""The whole pipeline against plain Python, stage by stage."""

from __future__ import annotations

import hashlib
import math
import random
import re

from test_text_operators import brute_components, labelled, texts


def plain_mix(rows, seed):
    """(doc_id, source, n words) -> copies, by iterated resharing and a running sum."""
    size: dict = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full: dict = {}
    while True:
        rest = sum(size.values()) - sum(full.values())
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * size[s]]
        if not over:
            break
        full |= {s: 3 * size[s] for s in over}
    target = full | share

    def place(row):
        doc, _, n = row
        h = hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()
        bits = max(1, n.bit_length())
        return bits * 8 + (n >> max(bits - 3, 0)), h[:2], n, h, str(doc)

    out = {}
    for s in names:
        key = "t" if s is None else "s" + s
        total = int(hashlib.md5(f"{seed}/{key}".encode()).hexdigest()[:12], 16) / 2**48
        for doc, _, n in sorted((r for r in rows if r[1] == s), key=place):
            before, total = total, total + (target[s] / size[s] if size[s] else 0)
            out[doc] = math.floor(total + 1e-12) - math.floor(before + 1e-12)
    return out


def test_pipeline_matches_plain_python(spark, tmp_path):
    import corpus_pipeline
    from talweg.llm import mixing, pii, quality

    r = random.Random(8)
    train, labels = labelled(spark, n=120)
    rows = [(t["doc_id"], t["text"]) for t in train.collect()]
    rows += [(1000 + i, t) for i, t in enumerate(texts(seed=21, n=25, words=200))]
    item = "what is the tall tower that stands in the old part of that town by the sea"
    rows += [(2000, "we asked " + item + " and left"), (2001, "what is the tall tower that stands"), (2002, "mail joe.x@mail.org or 4111111111111111 today and not later than that")]
    docs = [(i, t, "en", None if i % 9 == 0 else f"s{i % 5}", len(t)) for i, t in rows]
    r.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = quality.fitted(df, labels, allowed=~quality.held_out(F.col("doc_id")))
    left = [d for d in docs if net.scores([d[1].encode()])[0] >= 0.3]
    assert 0 < len(left) < len(docs)
    left.sort()
    roots = brute_components([d[1] for d in left])
    left = [d for i, d in enumerate(left) if roots[i][1] == i]
    words = re.findall(r"[a-z0-9]+", item)
    windows = [" ".join(words[i : i + 10]) for i in range(len(words) - 9)]
    left = [d for d in left if not any(f" {w} " in f" {' '.join(re.findall(r'[a-z0-9]+', d[1].lower()))} " for w in windows)]
    kept = {d[0] for d in left}
    assert 2000 not in kept
    hidden = {x["doc_id"]: x["text"] for x in pii.pseudonymised(spark.createDataFrame(left, df.schema), key=pii.key_of(spark)).collect()}
    copies = plain_mix([(d[0], d[3], len(re.findall(r"[^\x20\x09-\x0D]+", d[1]))) for d in left], mixing.SEED)
    want = sorted((d[0], hidden[d[0]], k) for d in left for k in range(1, copies[d[0]] + 1))
    got = sorted((x["doc_id"], x["text"], x["copy"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
