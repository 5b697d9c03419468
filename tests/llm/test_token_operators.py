"""Alignment, token store and prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path

BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
BITS = ["Ü", "ж", ".", ",", "a.", "; ", "don't", "×", " ", " ", "　", "\u0085", "ſ ", "p\n", "\nq", "!?", "҃", "1,", "é.", "a", " ", "  ", "\n", "'s", "日", "1"]
BITS += ["<|endoftext|>", " b", "c ", "▁", "\x00", "\t", "!", "🙂", "é", "</s>", "<0x41>", " word", " word", " and", " Straße,"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("limit", [8_000_000, 200])
def test_units_give_the_ids_of_whole_texts(limit):
    from talweg.llm.tokens import ByteTokens, PieceTokens, Units, ragged, text_blocks

    texts = odd_texts(3000)
    for model, prefix, fine in ((ByteTokens(BYTES), b"", True), (ByteTokens(BYTES, literal=True), b" ", False), (PieceTokens(PIECES), b" ", False)):
        assert not model.whole
        got: dict[int, list] = defaultdict(list)
        for at, raw, ends in text_blocks(pa.array(texts), limit, prefix=prefix):
            u = Units(raw, ends, fine=fine)
            ids, begin = ragged(*model.encode(u.dictionary), u.codes)
            for k, i in enumerate(at):
                got[i] += ids[begin[u.first[k]] : begin[u.first[k + 1]]].tolist()
        if isinstance(model, PieceTokens):
            want = model.model.encode(texts)
        else:
            want = [e.ids for e in model.model.encode_batch([prefix.decode() + t for t in texts], add_special_tokens=False)]
        assert all(got[i] == w for i, w in enumerate(want) if texts[i])


def test_a_tokenizer_that_may_not_be_cut_sees_whole_texts():
    from talweg.llm.tokens import ByteTokens, Units, ragged, text_blocks

    model = ByteTokens(tokenizer_path("word_bpe_49k.json"))
    assert model.whole
    texts = odd_texts(200)
    for _, raw, ends in text_blocks(pa.array(texts), whole=True):
        u = Units(raw, ends, whole=True)
        ids, begin = ragged(*model.encode(u.dictionary), u.codes)
        want = [e.ids for e in model.model.encode_batch(texts, add_special_tokens=False)]
        assert [ids[begin[u.first[k]] : begin[u.first[k + 1]]].tolist() for k in range(len(texts))] == want


@pytest.mark.parametrize("most", [1, 20, 1 << 18])
def test_units_of_earlier_blocks_are_not_encoded_again(most):
    from talweg.llm.tokens import REMEMBER_BYTES, ByteTokens, Remembered, Units, ragged, text_blocks

    model = ByteTokens(BYTES)
    known, plain, asked = Remembered(model, most), model.encode, []

    def counted(units):
        asked.extend(units.to_pylist())
        return plain(units)

    model.encode = counted
    long = "x" * (REMEMBER_BYTES + 1)
    texts = [None, "", "", *odd_texts(500, 3), long]
    want = [e.ids for e in model.model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for again in range(3):
        for rows in ([None, ""], texts[:200], texts):
            asked.clear()
            for at, raw, ends in text_blocks(pa.array(rows, pa.string())):
                u = Units(raw, ends, fine=True)
                ids, begin = ragged(*known.encode(u.dictionary), u.codes)
                for k, i in enumerate(at):
                    assert ids[begin[u.first[k]] : begin[u.first[k + 1]]].tolist() == (want[texts.index(rows[i])] if rows[i] else [])
            assert len(known.younger) <= most and len(known.older) <= most
            assert all(len(w) <= REMEMBER_BYTES for w in known.younger)
        if most == 1 << 18 and again:
            assert asked and all(len(w) > REMEMBER_BYTES for w in asked)  # all else is remembered
    words = pa.array([b" one", b" two", b" three"], pa.large_binary())
    if most == 20:  # forgotten only after two generations without a use
        known.younger, known.older = {}, {}
        for n in range(100):
            asked.clear()
            known.encode(words)
            assert bool(asked) == (n == 0)
            known.encode(pa.array([f" w{n}".encode()], pa.large_binary()))


def test_a_tokenizer_that_sees_whole_texts_remembers_none():
    from talweg.llm.tokens import ByteTokens, Remembered

    known = Remembered(ByteTokens(tokenizer_path("word_bpe_49k.json")))
    units = pa.array([t.encode() for t in odd_texts(50)], pa.large_binary())
    got, want = known.encode(units), known.model.encode(units)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True)) and not known.younger


def test_bits():
    from talweg.llm.align import Bits

    r = random.Random(2)
    for size in (0, 1, 63, 64, 65, 500):
        some, other = ({i for i in range(size) if r.random() < 0.4} for _ in range(2))
        a, b = Bits.of(np.array(sorted(some), dtype=np.int64), size), Bits.of(np.array(sorted(other), dtype=np.int64), size)
        assert (a & b).select().tolist() == sorted(some & other)
        at = np.arange(size)
        assert a.rank(at).tolist() == [len({x for x in some if x <= i}) for i in range(size)]


def plain_alignment(texts: list) -> list[tuple]:
    from talweg.llm.tokens import ByteTokens, PieceTokens

    a, b = ByteTokens(BYTES, literal=True), PieceTokens(PIECES)
    counts, held = Counter(), []
    for text in texts:
        ids_a = a.model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.model.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a.bytes[i] for i in ids_a) != whole or b"".join(b.bytes[i] for i in ids_b) != whole:
            held.append(None)
            continue
        ends, at = {}, 0
        for k, i in enumerate(ids_a):
            at += len(a.bytes[i])
            ends[at] = k
        at, x, y, groups, links = 0, 0, 0, [], []
        for k, i in enumerate(ids_b):
            at += len(b.bytes[i])
            if at in ends:
                groups.append((ids_a[x : ends[at] + 1], ids_b[y : k + 1]))
                links.append((ids_a[ends[at]], i))
                x, y = ends[at] + 1, k + 1
        counts.update(links)
        held.append((len(ids_a), len(ids_b), groups, links))
    best: dict = defaultdict(int)
    for (_, i), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in h[2])
        out.append((h[0], h[1], len(h[2]), len(h[3]), sum(counts[p] == best[p[1]] for p in h[3]), sum(counts[p] for p in h[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_alignment_is_that_of_plain_python(spark, tmp_path):
    from talweg.llm import align

    long = " ".join(f"wort{i % 700} Straße {i % 13}" for i in range(3000))
    texts = [None, "", " ", "plain text", "plain text", "mark ▁ inside", "▁", "<|endoftext|> </s> <s>", long, *odd_texts(200, 5)]
    rows = [(None if i == 3 else i % 150, t, "x", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_a string, row_ int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[1:] for r in align.op11_align(spark, str(tmp_path)).collect())
    assert got == sorted(plain_alignment(texts))
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert align.op11_align(spark, f"{tmp_path}/none").count() == 0


def test_linked_ids_are_bounded_by_the_vocabularies():
    """Of two tokens that end together, one's bytes end the other's: what bounds the broadcast table."""
    from talweg.llm.align import aligned_batch
    from talweg.llm.tokens import ByteTokens, PieceTokens

    a, b = ByteTokens(BYTES, literal=True), PieceTokens(PIECES)
    seen = {int(p) for _, _, _, _, pairs, _ in aligned_batch(pa.array(odd_texts(300, 9)), a, b) for p in pairs}
    assert seen and all(a.bytes[p // b.size].endswith(b.bytes[p % b.size]) or b.bytes[p % b.size].endswith(a.bytes[p // b.size]) for p in seen)
    assert sum(map(len, a.bytes)) + sum(map(len, b.bytes)) < 600_000


# ---- token store -------------------------------------------------------------------------------------


def test_perfect_hash():
    from talweg.llm.token_store import Part, PerfectHash, hashes

    for n in (0, 1, 2, 77, 5000):
        pairs = hashes([f"k{i}" for i in range(n)], [0] * n)
        p = PerfectHash.of(pairs)
        assert sorted(p.slots(pairs).tolist()) == list(range(n)) == list(range(p.n))
        part = Part.frombytes(Part.of(pairs, np.arange(n) % 7, np.arange(n) * 3, np.arange(n) + 1).tobytes())
        held, slots = part.find(pairs)
        assert held.all() and slots["offset"].tolist() == [i * 3 for i in range(n)] and slots["n_tokens"].tolist() == [i + 1 for i in range(n)]
        foreign, none = part.find(hashes([f"other{i}" for i in range(500)], [0] * 500))
        assert not foreign.any() and not len(none)
        assert len(part.tobytes()) < 200 + n * 30
    with pytest.raises(ValueError, match="equal keys"):
        PerfectHash.of(np.zeros((2, 2), dtype=np.uint64))


def test_token_store_round_trip(spark, tmp_path):
    from talweg.llm import token_store as ts

    texts = [None, "", "b", "a", *odd_texts(300, 3), " ".join(["lang"] * 30_000)]
    keys = [None, None, 7, 7, *range(300), 7]
    data = [(k, t, "x") for k, t in zip(keys, texts, strict=True)] + [(500, "same", "x")] * 40 + [(-5, "first", "x"), (500, "other", "x")]
    docs = spark.createDataFrame(data, "id long, text string, key string").repartition(5)
    store = ts.indexed(ts.written(docs, f"file://{tmp_path}/store", BYTES, key="id"), part_keys=50)
    from talweg.llm.tokens import ByteTokens

    plain = ByteTokens(BYTES).model
    want = Counter((k, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for k, t, _ in data)
    rows = ts.payloads(store, ts.located(store, store.table("documents").select("key", "seen"))).collect()
    ids = {(r["key"], r["seen"]): np.frombuffer(r["ids"], dtype="<u4") for r in rows}
    assert Counter((k, tuple(v.tolist())) for (k, _), v in ids.items()) == want
    n = Counter(k for k, _, _ in data)
    assert {k: sorted(s for q, s in ids if q == k) for k in n} == {k: list(range(c)) for k, c in n.items()}
    in_order = sorted(rows, key=lambda r: r["start"])
    assert [r["key"] for r in in_order] == sorted((k for k, _, _ in data), key=lambda k: (k is not None, k))
    assert [r["start"] for r in in_order] == [sum(len(ids[q["key"], q["seen"]]) for q in in_order[:i]) for i in range(len(in_order))]
    # keyed access, also by keys that the store lacks
    reader = ts.Reader(store)
    assert all(np.array_equal(reader.get(k, s), v) for (k, s), v in list(ids.items())[:40])
    assert reader.get(123_456) is None and reader.get(500, 41) is None and reader.get(500, 40) is not None
    asked = spark.createDataFrame([(7, 0), (7, 3), (99_999, 0), (None, 1)], "key long, seen long")
    assert {(r["key"], r["seen"]) for r in ts.located(store, asked).collect()} == {(7, 0), (7, 3), (None, 1)} - ({(7, 3)} if n[7] < 4 else set())
    shards = store.table("shards_table").orderBy("shard").collect()
    assert sum(s["n_docs"] for s in shards) == len(data) and [s["start"] for s in shards] == [sum(t["n_ids"] for t in shards[:i]) for i in range(len(shards))]


def test_token_store_query(spark, tmp_path):
    from talweg.llm import token_store as ts
    from talweg.llm.tokens import ByteTokens

    texts = [None, "", *odd_texts(60, 8)]
    spark.createDataFrame([(i * 7 % 62, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain, start, want = ByteTokens(BYTES).model, 0, []
    for k, t in sorted((i * 7 % 62, t) for i, t in enumerate(texts)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, ts.op12_token_store(spark, str(tmp_path)).collect())) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert ts.op12_token_store(spark, f"{tmp_path}/none").count() == 0


# ---- prefix trie -------------------------------------------------------------------------------------


def plain_trie(conversations: dict[int, list[tuple[str, str]]]) -> dict:
    members: dict = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children: dict = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(own) - 1) * (len(p[-1][1]) if p else 0)
    out = {}
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(p))
        out[min(own), len(p)] = (min(members[p[:-1]]) if p else None, len(own), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def plain_rebuilt(rows: list[tuple]) -> dict:
    own: dict = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]  # the remainder has the sign of c, as in SQL
    return out


def test_trie_against_plain_python(spark):
    from talweg.llm import prefix_trie as pt

    r = random.Random(4)
    conversations = {}
    for c in range(260):
        if c % 5 == 0 and conversations:  # copies, prefixes and branches of others
            base = conversations[r.choice(list(conversations))]
            conversations[c * 3 + 1] = base[: r.randrange(len(base) + 1)] + [(r.choice("ua"), r.choice("xyz"))] * r.randrange(3)
        else:
            conversations[c * 3 + 1] = [(r.choice(["u", "a", ""]), r.choice(["", "é", "yy"])) for _ in range(r.choice([0, 1, 2, 4, 9, 20]))]
    long = [("u", f"turn {i % 3}") for i in range(700)]
    conversations |= {5000: long, 5001: long, 5002: long[:600], 5003: [*long[:513], ("a", "end")], 5004: long[:255], 5005: long[:256]}
    turns = spark.createDataFrame([(c, d, role or None, text) for c, v in conversations.items() for d, (role, text) in enumerate(v, 1)], "conv_id long, depth int, role string, text string")
    convs = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    rows = pt.trie(turns, convs).collect()
    got = {(x["conv_id"], x["depth"]): tuple(x)[2:] for x in rows}
    assert len(rows) == len(got) and got == plain_trie(conversations)


def test_bands_cover_every_depth(spark):
    from pyspark.sql import functions as F

    from talweg.llm.prefix_trie import _band, _last

    bands = {r["d"]: r["b"] for r in spark.range(1, 2000).select(F.col("id").alias("d"), _band(F.col("id")).alias("b")).collect()}
    for b in range(max(bands.values())):
        assert max(d for d, x in bands.items() if x == b) == _last(b) and sum(x == b for x in bands.values()) <= 256


@pytest.mark.parametrize("messy", [True, False])
def test_trie_query(spark, tmp_path, messy):
    from talweg.llm import prefix_trie as pt

    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([None, "", "a", "bb", "ccc 🙂"])) for c in [*range(90, 130), 200, 205, 399, 400, -50, -3, 0] for t in range(r.randrange(1, 9))]
    if messy:
        rows += [(None, 0, "user", "x"), (105, None, "user", "null turn"), (105, 2, "user", "tie"), (105, 2, "user", "tie"), (105, 2, "user", "tie a"), (200, None, None, None)]
    spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, depth string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(x["conv_id"], x["depth"]): tuple(x)[2:] for x in pt.op13_prefix_trie(spark, str(tmp_path)).collect()}
    assert got == plain_trie(plain_rebuilt(rows))


def test_trie_of_one_and_of_none(spark, tmp_path):
    from talweg.llm import prefix_trie as pt

    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert pt.op13_prefix_trie(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(7, 0, "u", "x")], schema).write.parquet(f"{tmp_path}/one/conversations.parquet")
    got = {(x["conv_id"], x["depth"]): tuple(x)[2:] for x in pt.op13_prefix_trie(spark, f"{tmp_path}/one").collect()}
    assert got == plain_trie(plain_rebuilt([(7, 0, "u", "x")]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_trie_query_is_its_sql(spark):
    import duckdb

    from talweg.llm import prefix_trie as pt

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    rel = con.sql(pt.ORACLE)
    df = pt.op13_prefix_trie(spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in df.collect()))) == sorted(map(str, rel.fetchall()))
