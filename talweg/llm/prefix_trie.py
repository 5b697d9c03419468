"""Trie of the turns that conversations begin with, by partition refinement.

All conversations start in one class.  Round by round every class of two or more is split by the next
turns of its members; a member that comes to stand alone leaves the refinement and the rest of it
becomes a unary chain; what is left goes on.  A round takes a band of turns (1-3, 4-7, 8-15, ... and at
most 256), so the rounds are few, and within a band each turn splits in the same job.  A class is known
by the SHA-256 of its parent's with the digest of its turn; its members are never gathered, only counted.

Folding back needs no round for each depth: let a node's own part of a conversation be that from the
depth at which the conversation is the smallest member of its class.  Then what the nodes of a subtree
would hold once is the sum of the members' own parts, what they hold with all copies is the sum of the
members' texts, and each leaf is the end of exactly one own part; so saved tokens and leaves are sums over
the members of a node.

Defined results: rows without conv_id belong to no conversation; a null role or text is empty; turns with
equal numbers stand by role and text; conversations without turns are members of the root; an empty table
has no nodes; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators.digest import sequential_sha256
from talweg.operators.prefix import numbered
from talweg.storage import folder, stored

BAND = 256
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def _band(depth: Column) -> Column:
    """0 for depths 1-3, 1 for 4-7, ... 6 for 128-255, then one for each 256."""
    small = F.greatest(F.length(F.bin(depth)) - 2, F.lit(0))
    return F.when(depth < BAND, small).otherwise((depth / BAND).cast("int") + 6).cast("int")


def _last(band: int) -> int:
    """Last depth of a band."""
    return (4 << band) - 1 if band <= 6 else (band - 6) * BAND + BAND - 1


def _refined(active: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, before) for each turn of the band of each member of an active class."""
    item = "struct<depth:bigint,node:string,parent:string,before:bigint>"
    start = F.struct(F.col("node").alias("node"), F.col("before").alias("before"), F.lit(None).cast(f"array<{item}>").alias("items"))

    def step(acc: Column, t: Column) -> Column:
        node = F.sha2(F.concat(acc["node"], t["digest"]), 256)
        own = F.struct(t["depth"].alias("depth"), node.alias("node"), acc["node"].alias("parent"), acc["before"].alias("before"))
        items = F.concat(F.coalesce(acc["items"], F.array().cast(f"array<{item}>")), F.array(own))
        return F.struct(node.alias("node"), (acc["before"] + t["size"]).alias("before"), items.alias("items"))

    members = active.join(turns, "conv_id")
    items = F.aggregate("turns", start, step)["items"]
    return members.select("conv_id", F.explode(items).alias("i")).select("conv_id", "i.*")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of ``conversations`` (conv_id, each once), whose ``turns`` are conv_id, depth (1, 2, ...), role and text.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, as longs but for the last.
    """
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = stored(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), digest.alias("digest"), F.length(text).cast("long").alias("size")), "trie-turns")
    banded = rows.withColumn("band", _band(F.col("depth"))).groupBy("conv_id", "band")
    at = folder(spark, "trie-bands") + "/table"
    banded.agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "size"))).alias("turns")).write.partitionBy("band").parquet(at)
    bands = spark.read.schema("conv_id bigint, turns array<struct<depth:bigint,digest:string,size:bigint>>, band int").parquet(at)

    whole = rows.groupBy("conv_id").agg(F.max("depth").alias("length"), F.sum("size").alias("total"))
    whole = conversations.select("conv_id").join(whole, "conv_id", "left").fillna(0, ["length", "total"])
    whole = stored(whole, "trie-whole")
    root = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not root.n:
        return _nothing(spark)

    # split
    active = whole.where("length > 0").select("conv_id", F.lit("").alias("node"), F.lit(0).cast("long").alias("before"))
    band, splits, classes = 0, [], []
    while True:
        split = stored(_refined(active, bands.where(F.col("band") == band).drop("band")), f"trie-split-{band}")
        some = split.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("before").alias("before"))
        some = stored(some, f"trie-classes-{band}")
        splits.append(split)
        classes.append(some)
        going = some.where((F.col("depth") == _last(band)) & (F.col("n_convs") > 1)).select("node")
        if going.isEmpty():
            break
        ended = rows.where(F.col("depth") == _last(band)).select("conv_id", "size")
        active = split.where(F.col("depth") == _last(band)).join(going, "node", "left_semi").join(ended, "conv_id")
        active = active.select("conv_id", "node", (F.col("before") + F.col("size")).alias("before"))
        band += 1
    members, nodes = _union(splits), _union(classes)
    top = spark.createDataFrame([(0, "", root.conv_id, root.n, None, 0)], "depth bigint, node string, conv_id bigint, n_convs bigint, parent string, before bigint")

    # classes of two or more and the root; those that stand alone for the first time
    shared = stored(nodes.where("n_convs > 1").unionByName(top), "trie-shared")
    alone = nodes.where("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("depth"), F.min_by("parent", "depth").alias("parent"), F.min_by("before", "depth").alias("before"))
    alone = stored(alone, "trie-alone")
    heads = shared.select("conv_id", "depth", "parent", "before").unionByName(alone.select("conv_id", "depth", "parent", "before"))
    children = stored(heads.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node"), "trie-children")

    # fold back
    own = heads.groupBy("conv_id").agg(F.min_by("before", "depth").alias("own_before"))
    leaves = shared.join(children, "node", "left_anti").select("conv_id").unionByName(alone.select("conv_id")).withColumn("leaf", F.lit(1).cast("long"))
    folded = whole.join(own, "conv_id", "left").join(leaves, "conv_id", "left")
    folded = folded.select("conv_id", "length", "total", F.coalesce(F.col("total") - F.col("own_before"), F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    folded = stored(folded, "trie-folded")
    everyone = folded.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("node"))
    placed = stored(everyone.unionByName(members.select("conv_id", "depth", "node")).join(folded, "conv_id"), "trie-placed")
    sums = placed.groupBy("node").agg(F.sum("total").alias("total"), F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"))
    ends = placed.where("depth = length").join(shared.select("node"), "node", "left_semi")
    ends = sequential_sha256(ends, ["node"], ["conv_id"], F.col("conv_id").cast("string"), ",").select("node", F.col("sha256").alias("ends_sha256"))

    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    smallest = folded.select("conv_id", F.col("total").alias("first_total"), F.col("own").alias("first_own"))
    several = shared.join(sums, "node").join(children, "node", "left").join(ends, "node", "left").join(smallest, "conv_id").join(parents, "parent", "left")
    once = F.col("own") - F.col("first_own") + F.col("first_total") - F.col("before")
    several = several.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("total") - F.col("n_convs") * F.col("before") - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )

    first = alone.join(parents, "parent").select("conv_id", F.col("depth").alias("first_depth"), "parent_conv_id").join(whole.select("conv_id", "length"), "conv_id")
    last = F.col("depth") == F.col("length")
    chains = rows.select("conv_id", "depth").join(first, "conv_id").where("depth >= first_depth")
    chains = chains.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("first_depth"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return several.unionByName(chains)


def _nothing(spark) -> DataFrame:
    longs = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return spark.createDataFrame([], ", ".join([*[f"{c} bigint" for c in longs], "ends_sha256 string"]))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation begins as the first one of its hundred does.

    The first h turns come from conversation c - c % ``every``, with h = crc32(c) % ``heads``, the others
    are those of c after its own first h.  Remainders have the sign of c, as in SQL.
    """
    clean = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = stored(numbered(clean, ["conv_id"], ["turn", "role", "text"], "place").drop("turn"), "trie-numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    # at most heads - 1 turns of every hundredth conversation
    opening = placed.where((F.col("conv_id") % every == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    known = opening.groupBy("base").agg(F.max("place").alias("n_base"))
    conversations = placed.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", base.alias("base"), h.alias("h"))
    conversations = conversations.join(known, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).cast("long").alias("taken"))
    conversations = stored(conversations, "trie-conversations")
    before = conversations.where("taken > 0").join(opening, "base").where("place <= h").select("conv_id", F.col("place").cast("long").alias("depth"), "role", "text")
    after = placed.where(F.col("place") > h).join(conversations.select("conv_id", "h", "taken"), "conv_id")
    after = after.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).cast("long").alias("depth"), "role", "text")
    return before.unionByName(after), conversations.select("conv_id")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, conversations = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie(turns, conversations)


ORACLE = r"""
WITH c AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM c)),
n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
m AS MATERIALIZED (SELECT k.*, least(h, coalesce(n.n, 0)) AS taken FROM k LEFT JOIN n ON n.conv_id = k.base),
t AS MATERIALIZED (
  SELECT m.conv_id, c.place AS depth, role, text FROM m JOIN c ON c.conv_id = m.base AND c.place <= m.h
  UNION ALL SELECT m.conv_id, c.place - m.h + m.taken, role, text FROM m JOIN c ON c.conv_id = m.conv_id AND c.place > m.h),
p AS MATERIALIZED (
  SELECT conv_id, depth, length(text) AS size, max(depth) OVER (PARTITION BY conv_id) AS len,
         md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM t
  UNION ALL SELECT m.conv_id, 0, 0, coalesce((SELECT max(depth) FROM t WHERE t.conv_id = m.conv_id), 0), '' FROM m),
g AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
  FROM p GROUP BY node, depth),
up AS MATERIALIZED (SELECT g.node, a.node AS above, a.depth AS above_depth FROM g JOIN p a ON a.conv_id = g.conv_id AND a.depth <= g.depth),
kids AS (SELECT above AS node, count(*) AS n FROM up JOIN g USING (node) WHERE above_depth = g.depth - 1 GROUP BY above),
below AS (
  SELECT above AS node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((g.n_convs - 1) * g.size)::BIGINT AS saved_tokens
  FROM up JOIN g USING (node) LEFT JOIN kids ON kids.node = g.node GROUP BY above)
SELECT g.conv_id, g.depth::BIGINT AS depth, f.conv_id AS parent_conv_id, g.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       b.n_leaves, b.saved_tokens, g.ends_sha256
FROM g JOIN below b ON b.node = g.node LEFT JOIN kids ON kids.node = g.node
LEFT JOIN up ON up.node = g.node AND up.above_depth = g.depth - 1 LEFT JOIN g f ON f.node = up.above
"""
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": ORACLE}
