"""Token ids in binary shards with keyed access through a minimal perfect hash.

``written`` deals the documents by range of their key, so shard after shard holds ascending keys, and every
task streams its documents through the tokenizer into one file: a JSON line (padded to 64 bytes), then
the raw ids, little-endian, 2 bytes each where the vocabulary fits and 4 otherwise, an end id after each
document.  A document is known by its key and by how many rows of that key come before it.

``indexed`` deals the documents by hash to parts of about a million at most, and builds per part a minimal
perfect hash in levels: every key takes a place of a bit array by hash, keys alone at their place stay,
the others go to the next level.  The number of ones before a key's place is its slot; slots hold a
fingerprint (64 bits of the key's 128-bit hash) and where the ids lie.  A lookup reads a few bits and one
slot, and refuses keys that the store does not hold by their fingerprint.

Files are written under names of their own by each attempt of a task; only those that the manifest names
count, so lost executors and repeated or speculative attempts leave nothing that is read.  The folder may
be any that ``pyarrow.fs`` opens by its address and all executors share.

Defined results: null and empty texts are the end id alone; null keys come first and are a key of their
own; repeated keys and rows are kept, each under its own number (among equal keys by text); further
columns are not read; an empty table gives a store without shards.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.llm.tokens import Units, byte_tokens, ragged, remembered, text_blocks
from talweg.llm.words import mixed
from talweg.session import arrow_rows
from talweg.storage import folder

HEAD = 64
PART_KEYS = 1 << 20
GAMMA = 2.0
BLOCK = 4_000_000
READ_IDS = 1_000_000
ROWS = 1_000  # texts in an Arrow batch
SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8")])
STEP = np.uint64(0x9E3779B97F4A7C15)


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


def _create(address: str, name: str) -> tuple[object, str]:
    """Output stream of a new file of this attempt, and its address."""
    system, path = _opened(address)
    system.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    return system.open_output_stream(f"{path}/{own}"), f"{address}/{own}"


def _fresh(address: str) -> None:
    system, path = _opened(address)
    system.create_dir(path, recursive=True)


# ---- the minimal perfect hash ------------------------------------------------------------------------


def hashes(keys: list[str | None], seen: list[int]) -> np.ndarray:
    """128-bit hash (two columns of 64 bits) of each key with the number of its row."""
    digests = b"".join(hashlib.blake2b(f"{n}/{'' if k is None else 's' + k}".encode(), digest_size=16).digest() for k, n in zip(keys, seen, strict=True))
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 2)


class PerfectHash:
    """Slot of each of ``n`` keys, every slot once."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits, self.before, total = sizes, bits, [], 0
        for words in bits:
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.before.append(np.concatenate(([0], ones)) + total)
            total += int(ones[-1]) if len(ones) else 0
        self.n = total

    @staticmethod
    def _place(pairs: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(pairs[:, 0] ^ mixed(pairs[:, 1] + np.uint64(level) * STEP)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, pairs: np.ndarray) -> PerfectHash:
        sizes, bits, level = [], [], 0
        while len(pairs):
            if level == 64:
                raise ValueError("equal keys: a perfect hash needs distinct ones")
            size = (int(GAMMA * len(pairs)) // 64 + 1) * 64
            at = cls._place(pairs, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            pairs, level = pairs[~alone[at]], level + 1
        return cls(sizes, bits)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """-1 for keys that no level holds; another key's slot is possible for foreign keys."""
        out, left = np.full(len(pairs), -1, dtype=np.int64), np.arange(len(pairs))
        for level, (size, words, before) in enumerate(zip(self.sizes, self.bits, self.before, strict=True)):
            at = self._place(pairs[left], level, size)
            word, low = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> low) & np.uint64(1) == 1
            rank = before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            out[left[here]] = rank[here]
            left = left[~here]
        return out


class Part:
    """One part of the index: the hash and its slots."""

    def __init__(self, perfect: PerfectHash, slots: np.ndarray):
        self.perfect, self.slots = perfect, slots

    @classmethod
    def of(cls, pairs: np.ndarray, shard: np.ndarray, offset: np.ndarray, n_tokens: np.ndarray) -> Part:
        perfect = PerfectHash.of(pairs)
        slots, at = np.zeros(len(pairs), dtype=SLOT), perfect.slots(pairs)
        for name, values in (("fingerprint", pairs[:, 0]), ("shard", shard), ("offset", offset), ("n_tokens", n_tokens)):
            slots[name][at] = values
        return cls(perfect, slots)

    def tobytes(self) -> bytes:
        head = json.dumps({"sizes": self.perfect.sizes, "slots": len(self.slots)}).encode()
        return len(head).to_bytes(8, "little") + head + b"".join(b.tobytes() for b in self.perfect.bits) + self.slots.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> Part:
        at = 8 + int.from_bytes(raw[:8], "little")
        head, bits = json.loads(raw[8:at]), []
        for size in head["sizes"]:
            bits.append(np.frombuffer(raw, dtype=np.uint64, count=size // 64, offset=at))
            at += size // 8
        return cls(PerfectHash(head["sizes"], bits), np.frombuffer(raw, dtype=SLOT, count=head["slots"], offset=at))

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys the part holds, their slots)."""
        at = self.perfect.slots(pairs)
        if not len(self.slots):
            return np.zeros(len(pairs), dtype=bool), self.slots
        found = self.slots[np.maximum(at, 0)]
        held = (at >= 0) & (found["fingerprint"] == pairs[:, 0])
        return held, found[held]


def _read(address: str) -> bytes:
    system, path = _opened(address)
    with system.open_input_stream(path) as f:
        return f.read()


# ---- the store ---------------------------------------------------------------------------------------


class Store:
    """Tables of a written store: ``shards`` (one row a file), ``documents`` (one a document), ``parts`` (one an index file)."""

    def __init__(self, spark: SparkSession, address: str):
        self.spark, self.address = spark, address

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.address}/{name}")


def written(docs: DataFrame, address: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> Store:
    """Write the shards in ascending order of ``key`` below ``address`` and return the store, without its index."""
    spark = docs.sparkSession
    vocabulary = byte_tokens(tokenizer).size
    dtype = "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"
    shards_at = f"{address}/shards"
    _fresh(shards_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        shard, out, name, tokens, known = TaskContext.get().partitionId(), None, "", byte_tokens(tokenizer), remembered(tokenizer)
        offset, last, seen = 0, object(), 0
        end = np.array([end_id], dtype=dtype).tobytes()
        for batch in batches:
            texts, column = batch.column(1), batch.column(0).to_pylist()
            if out is None and len(texts):
                out, name = _create(shards_at, f"shard-{shard:07d}")
                out.write(json.dumps({"ids": dtype, "end": end_id, "shard": shard}).encode().ljust(HEAD - 1) + b"\n")
            sizes = np.zeros(len(texts), dtype=np.int64)
            open_text = 0  # its ids are being written; those before it are ended
            for at, block, ends in text_blocks(texts, BLOCK, tokens.whole):
                u = Units(block, ends, tokens.whole, fine=True)
                ids, begin = ragged(*known.encode(u.dictionary), u.codes)
                cut, raw = begin[u.first], ids.astype(dtype)
                for k, i in enumerate(at):
                    while open_text < i:
                        out.write(end)
                        open_text += 1
                    out.write(raw[cut[k] : cut[k + 1]].tobytes())
                    sizes[i] += int(cut[k + 1] - cut[k])
            for _ in range(open_text, len(texts)):
                out.write(end)
            sizes += 1
            numbers = []
            for k in column:
                last, seen = k, seen + 1 if k == last else 0
                numbers.append(seen)
            starts = offset + np.cumsum(sizes) - sizes
            offset += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array([shard] * len(texts), pa.int32()), pa.array([name] * len(texts)), pa.array(starts), pa.array(sizes)],
                names=["key", "seen", "shard", "file", "offset", "n_tokens"],
            )
        if out is not None:
            out.close()

    kind = docs.schema[key].dataType.simpleString()
    # rows of one key are dealt by their text, equal rows by where they stood: no key is one task
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("by_text"), F.monotonically_increasing_id().alias("by_place"))
    rows = rows.repartitionByRange("key", "by_text", "by_place").sortWithinPartitions("key", "by_text", "by_place").select("key", "text")
    one = rows.mapInArrow(run, f"key {kind}, seen bigint, shard int, file string, offset bigint, n_tokens bigint")
    with arrow_rows(spark, ROWS):
        one.write.parquet(f"{address}/streamed")
    one = spark.read.parquet(f"{address}/streamed")

    # one row a shard: where it begins among all ids
    shards = one.groupBy("shard", "file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{address}/shards_table")

    # a key that goes on in the next shard is numbered on: two keys a shard at most, its first and its last
    ends = one.groupBy("shard").agg(F.min_by("key", "offset").alias("first"), F.max_by("key", "offset").alias("last"))
    same = F.when(F.col("first").eqNullSafe(F.col("last")), F.array(F.struct(F.col("first").alias("key")))).otherwise(F.array(F.struct(F.col("first").alias("key")), F.struct(F.col("last").alias("key"))))
    edge = ends.select("shard", F.explode(same).alias("e")).select(F.col("shard").alias("edge_shard"), F.col("e.key").alias("edge_key"))
    at_edge = (F.col("shard") == F.col("edge_shard")) & F.col("key").eqNullSafe(F.col("edge_key"))
    counts = one.join(edge, at_edge).groupBy("edge_shard", "edge_key").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("edge_key").orderBy("edge_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("edge_shard", "edge_key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).where("base > 0")
    numbered = one.join(base, at_edge, "left").select("key", (F.col("seen") + F.coalesce("base", F.lit(0))).alias("seen"), "shard", "offset", "n_tokens")
    numbered.write.parquet(f"{address}/documents")
    return Store(spark, address)


def _with_part(keyed: DataFrame, parts: int) -> DataFrame:
    """Columns key_text, seen and others, with hash and part of the index."""
    names = keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = hashes(b.column(names.index("key_text")).to_pylist(), b.column(names.index("seen")).to_pylist())
            more = [pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64)), pa.array((pairs[:, 1] % np.uint64(parts)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "h1", "h2", "part"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields]
    return keyed.mapInArrow(run, ", ".join([*kinds, "h1 bigint", "h2 bigint", "part int"]))


def _pairs(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy().astype(np.int64).view(np.uint64) for n in ("h1", "h2")], axis=1)


def indexed(store: Store, part_keys: int = PART_KEYS) -> Store:
    """Write the index of a store; its parts are as many as shuffle partitions, and more where those were too large."""
    spark = store.spark
    documents = store.table("documents")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // part_keys))
    index_at = f"{store.address}/index"
    _fresh(index_at)

    def build(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        raw = Part.of(_pairs(table), *(table.column(n).to_numpy() for n in ("shard", "offset", "n_tokens"))).tobytes()
        out, name = _create(index_at, f"part-{part:07d}")
        with out:
            out.write(raw)
        return pa.table({"part": pa.array([part], pa.int32()), "index_file": [name], "n_keys": [table.num_rows], "n_parts": [parts]})

    keyed = _with_part(documents.select(F.col("key").cast("string").alias("key_text"), "seen", "shard", "offset", "n_tokens"), parts)
    keyed = keyed.select("part", "h1", "h2", "shard", "offset", "n_tokens")
    keyed.groupBy("part").applyInArrow(build, "part int, index_file string, n_keys bigint, n_parts bigint").write.parquet(f"{store.address}/parts")
    return store


def located(store: Store, keys: DataFrame) -> DataFrame:
    """Shard, offset and n_tokens of ``keys`` (columns key and seen) through the index; keys that the store lacks are left out."""
    parts = store.table("parts")
    n = parts.agg(F.max("n_parts")).first()[0] or 1
    kind = keys.schema["key"].dataType.simpleString()
    asked = _with_part(keys.select("key", "seen", F.col("key").cast("string").alias("key_text")), n).join(parts.select("part", "index_file"), "part")
    asked = asked.select("index_file", "key", "seen", "h1", "h2").repartition("index_file").sortWithinPartitions("index_file")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = None, None
        for b in batches:
            files, pairs = b.column(0), _pairs(b)
            changes = np.flatnonzero(np.array([True] + [x != y for x, y in zip(files[1:], files[:-1], strict=True)])) if b.num_rows else np.empty(0, dtype=np.int64)
            for s, e in zip(changes.tolist(), [*changes[1:].tolist(), b.num_rows], strict=True):
                if files[s].as_py() != name:
                    name = files[s].as_py()
                    part = Part.frombytes(_read(name))
                held, slots = part.find(pairs[s:e])
                rows = b.slice(s, e - s).filter(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1), rows.column(2), pa.array(slots["shard"].astype(np.int32)), pa.array(slots["offset"].astype(np.int64)), pa.array(slots["n_tokens"].astype(np.int64))],
                    names=["key", "seen", "shard", "offset", "n_tokens"],
                )

    return asked.mapInArrow(find, f"key {kind}, seen bigint, shard int, offset bigint, n_tokens bigint")


def payloads(store: Store, places: DataFrame) -> DataFrame:
    """Rows of ``located`` with ``start`` (ids of the store before them) and ``ids``: the raw ids as unsigned 32-bit little-endian bytes."""
    shards = store.table("shards_table").select("shard", "file", F.col("start").alias("shard_start"))
    asked = places.join(shards, "shard").select("key", "seen", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "offset", "file")
    asked = asked.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, dtype = None, None, None
        for b in batches:
            files, offsets, sizes, begin = b.column(5).to_pylist(), b.column(4).to_pylist(), b.column(3).to_pylist(), 0
            while begin < b.num_rows:  # few payloads at a time
                ids, end, held = [], begin, 0
                while end < b.num_rows and (not ids or held < READ_IDS):
                    if files[end] != name:
                        if f is not None:
                            f.close()
                        name = files[end]
                        system, path = _opened(name)
                        f = system.open_input_file(path)
                        dtype = np.dtype(json.loads(f.read_at(HEAD, 0))["ids"])
                    raw = f.read_at(sizes[end] * dtype.itemsize, HEAD + offsets[end] * dtype.itemsize)
                    ids.append(np.frombuffer(raw, dtype=dtype).astype("<u4").tobytes())
                    held, end = held + sizes[end], end + 1
                some = b.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(ids, pa.binary())], names=["key", "seen", "start", "n_tokens", "ids"])
                begin = end
        if f is not None:
            f.close()

    kind = places.schema["key"].dataType.simpleString()
    return asked.mapInArrow(read, f"key {kind}, seen bigint, start bigint, n_tokens bigint, ids binary")


class Reader:
    """Keyed access from one process: index parts and shard heads are opened on first use."""

    def __init__(self, store: Store):
        rows = store.table("parts").select("part", "index_file", "n_parts").collect()
        self.parts, self.n = {r.part: r.index_file for r in rows}, max((r.n_parts for r in rows), default=1)
        self.files = {r.shard: r.file for r in store.table("shards_table").select("shard", "file").collect()}
        self.open: dict[int, Part] = {}

    def get(self, key: object, seen: int = 0) -> np.ndarray | None:
        """Ids of the ``seen``-th row of ``key``, or None."""
        pair = hashes([None if key is None else str(key)], [seen])
        part = int(pair[0, 1] % np.uint64(self.n))
        if part not in self.parts:
            return None
        if part not in self.open:
            self.open[part] = Part.frombytes(_read(self.parts[part]))
        held, slot = self.open[part].find(pair)
        if not held[0]:
            return None
        system, path = _opened(self.files[int(slot["shard"][0])])
        with system.open_input_file(path) as f:
            dtype = np.dtype(json.loads(f.read_at(HEAD, 0))["ids"])
            raw = f.read_at(int(slot["n_tokens"][0]) * dtype.itemsize, HEAD + int(slot["offset"][0]) * dtype.itemsize)
        return np.frombuffer(raw, dtype=dtype)


def op12_token_store(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = indexed(written(docs, folder(spark, "token-store"), path("byte_bpe_50k.json")))
    places = located(store, store.table("documents").select("key", "seen"))
    out = payloads(store, places)
    return out.select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_token_store": op12_token_store}
ORACLES: dict[str, str] = {}
