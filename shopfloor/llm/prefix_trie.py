"""Prefix trie of conversations in minimal-perfect-hash node tables.

1. Turns are numbered inside their conversation, and every prefix gets a
   128-bit digest: the exclusive or of the hashes of (place, turn) so far.
   Numbers and digests come from blocks of BLOCK turns and the blocks' totals,
   so one long conversation is spread over many tasks.
2. Distinct digests are enumerated by a grouping with partial aggregates. Equal
   digests must agree in depth, parent digest and the SHA-256 of the last turn;
   if any do not, all digests are made anew with the next seed.
3. A node belongs to its smallest member, and a conversation's own nodes are the
   last ones of its path, from a depth ``own`` on. What a node adds to sums over
   subtrees is so spread over its members' paths: n_convs * bytes is one
   ``bytes`` per member, the first member's share is left out from ``own`` on.
4. Paths are cut into bands of BAND turns and dealt over shards. A shard gives
   its distinct digests slots by a minimal perfect hash verified against the
   digests, scatters counts into flat arrays, and accumulates them from the
   deepest nodes up through the array of parent slots. What lies below a band is
   carried in at the band's last turn.
5. The shards' sums are added up per digest, so the members of one hot node may
   lie in any number of shards.

Defined cases: a null role or text counts as empty; rows that repeat a (conv_id,
turn) are kept in the order of role and text; rows with a null conv_id belong to
no conversation; negative ids round towards zero; other columns, whatever their
names, are not read; an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.llm import common
from shopfloor.llm.perfect_hash import NodeTable

BLOCK = 64
BAND = 256
SHARD_ROWS = 1 << 17
SEEDS = 4
GROUP = 5          # conversations c - c % GROUP and their followers share first turns
MOST_SHARED = 9    # h = crc32 % MOST_SHARED
NO_TURN = -(1 << 62)
ENDS_BYTES = 1 << 16
NOBODY = -(1 << 63)


def _before(df: DataFrame, total, name: str) -> DataFrame:
    """``df(conv_id, block, ...)`` with ``total`` over the conversation's earlier blocks."""
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(total.over(w), F.lit(0).cast("long")))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, block, inside, t1, t2, sha, n_bytes), ``inside`` counting
    from 1 in the block, and the blocks as (conv_id, block, n, before)."""
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), common.text_or_empty().alias("text"),
    ).where("conv_id is not null").withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(NO_TURN)))
    blocks = _before(c.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")), F.sum("n"), "before")
    w = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turn = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = c.withColumn("inside", F.row_number().over(w)).select(
        "conv_id", "block", "inside", F.xxhash64("role", "text").alias("t1"),
        F.xxhash64("text", F.lit(1), "role").alias("t2"), F.unhex(F.sha2(turn, 256)).alias("sha"),
        F.octet_length("text").cast("long").alias("n_bytes"))
    return turns, blocks


_TURN = ["t1", "t2", "sha", "n_bytes"]


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (conv_id, depth, len, turn), (conv_id, len)."""
    turns, blocks = numbered(conversations)
    lengths = blocks.groupBy("conv_id").agg(F.sum("n").alias("len"))
    rows = turns.join(blocks.join(lengths, "conv_id"), ["conv_id", "block"])
    return rows.select("conv_id", (F.col("before") + F.col("inside")).alias("depth"), "len", *_TURN), lengths


def with_shared_heads(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation c - c % GROUP,
    then its own turns after its first h. Same columns as ``plain``."""
    turns, blocks = numbered(conversations)
    own_length = blocks.groupBy("conv_id").agg(F.sum("n").alias("own"))
    heads = own_length.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
                              (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).alias("h"))
    base = own_length.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    shared = F.least(F.col("h"), F.coalesce(F.col("base_own"), F.lit(0)))
    heads = common.written(
        heads.join(base, "base", "left").withColumn("shared", shared)
        .withColumn("len", F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("conv_id", "base", "h", "shared", "len"), "trie-heads")
    placed = turns.join(blocks.join(heads, "conv_id"), ["conv_id", "block"]).withColumn(
        "pos", F.col("before") + F.col("inside"))
    kept = placed.where(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("depth"), "len", *_TURN)
    first = (placed.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < MOST_SHARED))
             .select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), *_TURN))
    given = (first.join(heads.select("conv_id", "base", "shared", "len"), "base")
             .where(F.col("depth") <= F.col("shared")).select("conv_id", "depth", "len", *_TURN))
    return kept.unionByName(given), heads.select("conv_id", "len")


def _paths(rows: DataFrame, lengths: DataFrame, seed: int) -> DataFrame:
    """Rows with the digests of the prefix (d1, d2) and its parent (p1, p2); roots too."""
    z1 = F.xxhash64(F.lit(2 * seed), "depth", "t1", "t2")
    z2 = F.xxhash64("t2", "depth", F.lit(2 * seed + 1), "t1")
    r = rows.withColumns({"block": F.expr(f"(depth - 1) div {BLOCK}"), "z1": z1, "z2": z2})
    totals = r.groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
    totals = _before(_before(totals, F.bit_xor("x1"), "b1"), F.bit_xor("x2"), "b2").drop("x1", "x2")
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    r = (r.withColumn("i1", F.bit_xor("z1").over(w)).withColumn("i2", F.bit_xor("z2").over(w))
         .join(totals, ["conv_id", "block"])
         .withColumn("d1", F.col("i1").bitwiseXOR(F.col("b1"))).withColumn("d2", F.col("i2").bitwiseXOR(F.col("b2"))))
    paths = r.select("conv_id", "depth", "len", "d1", "d2", F.col("d1").bitwiseXOR(F.col("z1")).alias("p1"),
                     F.col("d2").bitwiseXOR(F.col("z2")).alias("p2"), "sha", "n_bytes")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), "len", zero.alias("d1"), zero.alias("d2"),
                           F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
                           F.lit(None).cast("binary").alias("sha"), zero.alias("n_bytes"))
    return roots.unionByName(paths)


def _nodes(paths: DataFrame) -> DataFrame:
    same = F.struct("depth", "p1", "p2", "sha")
    return paths.groupBy("d1", "d2").agg(
        F.min("conv_id").alias("owner"), F.min(same).alias("lo"), F.max(same).alias("hi"),
        F.max(F.col("depth") < F.col("len")).alias("inner"))


def verified(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes), written; digests collide nowhere."""
    for seed in range(SEEDS):
        paths = common.written(_paths(rows, lengths, seed), "trie-paths")
        nodes = common.written(_nodes(paths), "trie-nodes")
        if nodes.where("not (lo <=> hi)").isEmpty():
            return paths, nodes.select("d1", "d2", "owner", F.col("lo.depth").alias("depth"),
                                       F.col("lo.p1").alias("p1"), F.col("lo.p2").alias("p2"), "inner")
    raise RuntimeError(f"prefix digests collide under {SEEDS} seeds")


def _bands(paths: DataFrame, nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per conversation and band: own (depth of its first own node), leaf (whether its
    last turn is an own leaf), above (owner of the parent of its first own node),
    below (what the deeper bands of its path add)."""
    chains = nodes.groupBy("owner").agg(
        F.min("depth").alias("own"), F.max(~F.col("inner")).alias("leaf"),
        F.min_by(F.struct("p1", "p2"), "depth").alias("top"))
    chains = chains.select(F.col("owner").alias("conv_id"), "own", "leaf", F.col("top.p1").alias("d1"),
                           F.col("top.p2").alias("d2"))
    above = nodes.select("d1", "d2", F.col("owner").alias("above"))
    chains = chains.join(above, ["d1", "d2"], "left").drop("d1", "d2")
    bands = (lengths.join(chains, "conv_id", "left")
             .withColumns({"own": F.coalesce("own", F.col("len") + 1), "leaf": F.coalesce("leaf", F.lit(False))})
             .withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"len div {BAND}")))))
    long = bands.where(F.col("len") >= BAND)
    added = (paths.where(F.col("len") >= BAND).withColumn("band", F.expr(f"depth div {BAND}"))
             .join(long.select("conv_id", "band", "own"), ["conv_id", "band"])
             .groupBy("conv_id", "band")
             .agg(F.sum(F.when(F.col("depth") < F.col("own"), F.col("n_bytes")).otherwise(0)).alias("x")))
    w = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    below = added.withColumn("below", F.sum("x").over(w)).drop("x")
    return (bands.drop("len").join(below, ["conv_id", "band"], "left")
            .withColumn("below", F.coalesce("below", F.lit(0).cast("long"))))


SHARD = ("d1 long, d2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long")


def _shard(conv, depth, d1, d2, p1, p2, adds, leaf, child, parent) -> pa.RecordBatch:
    """Sums per node of one shard's paths (numpy columns of its rows)."""
    o = np.lexsort((d2, d1))
    new = np.concatenate([[True], (d1[o][1:] != d1[o][:-1]) | (d2[o][1:] != d2[o][:-1])])
    table = NodeTable(d1[o][new], d2[o][new])
    n = len(table)
    slot = table.slots(d1, d2)
    at_depth, up = np.empty(n, np.int64), np.full(n, -1, np.int64)
    at_depth[slot] = depth
    inside = depth % BAND != 0  # a band's first node has its parent in another band
    up[slot[inside]] = table.slots(p1[inside], p2[inside])
    if (up[slot[inside]] < 0).any():
        raise ValueError("a path is not whole in its shard")
    first, above = np.full(n, np.iinfo(np.int64).max), np.full(n, NOBODY)
    np.minimum.at(first, slot, conv)
    np.maximum.at(above, slot, parent)
    members, children, leaves, saved = (np.zeros(n, np.int64) for _ in range(4))
    for total, x in ((members, 1), (children, child), (leaves, leaf), (saved, adds)):
        np.add.at(total, slot, x)
    deepest_first = np.argsort(-at_depth, kind="stable")
    for level in np.split(deepest_first, np.flatnonzero(np.diff(at_depth[deepest_first])) + 1):
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    known = above != NOBODY
    columns = [table.a, table.b, at_depth, first, (above, known), members, children, leaves, saved]
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], mask=~c[1]) if isinstance(c, tuple) else pa.array(c) for c in columns],
        [x.split()[0] for x in SHARD.split(", ")])


def _shards(batches):
    """Rows arrive ordered by conversation and band; a shard holds whole bands."""
    def numbers(b):
        return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        x = numbers(b)
        if size + x.shape[1] > SHARD_ROWS:
            # up to the last band that ends in these rows
            x = np.concatenate([*held, x], axis=1)
            band = x[1] // BAND
            cut = np.flatnonzero((x[0][1:] != x[0][:-1]) | (band[1:] != band[:-1]))
            if len(cut):
                z = int(cut[-1]) + 1
                yield _shard(*x[:, :z])
                x = x[:, z:]
            held, size = [], 0
        held.append(x)
        size += x.shape[1]
    if held:
        yield _shard(*np.concatenate(held, axis=1))


def _listed(batches):
    """Runs of conv_ids of one digest (rows arrive ordered), joined by commas."""
    names, run, at, first, size = ["d1", "d2", "first", "ids"], [], None, 0, 0
    out = []

    def done():
        out.append((*at, first, ",".join(run)))

    for b in batches:
        for a, d, c in zip(*(x.to_pylist() for x in b.columns)):
            if run and ((a, d) != at or size > ENDS_BYTES):
                done()
                run, size = [], 0
            if not run:
                at, first = (a, d), c
            run.append(str(c))
            size += len(run[-1]) + 1
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
                out = []
    if run:
        done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)


def _digested(batches):
    """SHA-256 of each digest's runs, streamed in order."""
    names, out, at, h = ["d1", "d2", "ends_sha256"], [], None, None
    for b in batches:
        for a, d, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
            if (a, d) != at:
                if h is not None:
                    out.append((*at, h.hexdigest()))
                at, h = (a, d), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
                out = []
    if h is not None:
        out.append((*at, h.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)


def _ends(paths: DataFrame) -> DataFrame:
    n = common.parts(paths.sparkSession)
    last = paths.where("depth = len").select("d1", "d2", "conv_id")
    runs = (last.repartitionByRange(n, "d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
            .mapInArrow(_listed, "d1 long, d2 long, first long, ids string"))
    return (runs.repartition(n, "d1", "d2").sortWithinPartitions("d1", "d2", "first")
            .mapInArrow(_digested, "d1 long, d2 long, ends_sha256 string"))


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the conversations given as ``plain`` gives them: d1, d2 (digest),
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    paths, nodes = verified(rows, lengths)
    flag = lambda c: c.cast("long")
    p = paths.withColumn("band", F.expr(f"depth div {BAND}")).join(
        _bands(paths, nodes, lengths), ["conv_id", "band"])
    last = (F.col("depth") == F.col("len")) | (F.col("depth") % BAND == BAND - 1)
    low = F.lit(NOBODY).cast("long")
    zero = F.lit(0).cast("long")
    p = p.select(
        "conv_id", "depth", "d1", "d2", F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"),
        (F.when(F.col("depth") < F.col("own"), F.col("n_bytes")).otherwise(zero)
         + F.when(last, F.col("below")).otherwise(zero)).alias("adds"),
        flag(last & F.col("leaf")).alias("leaf"),
        flag((F.col("depth") < F.col("len")) & (F.col("depth") + 1 >= F.col("own"))).alias("child"),
        F.when(F.col("depth") > F.col("own"), F.col("conv_id"))
        .when(F.col("depth") == F.col("own"), F.coalesce("above", low)).otherwise(low).alias("parent"),
        "band")
    shards = (p.repartition(common.parts(spark), "conv_id", "band").sortWithinPartitions("conv_id", "band", "depth")
              .drop("band").mapInArrow(_shards, SHARD))
    total = lambda c: F.sum(c).alias(c)
    merged = shards.groupBy("d1", "d2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return merged.join(_ends(paths), ["d1", "d2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*with_shared_heads(common.table(spark, sf_dir, "conversations"))).drop("d1", "d2")


# crc32 bit by bit; nodes are the digests of whole paths, subtrees the pairs of a
# path's nodes.
ORACLE = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
byte(c, s, k, v) AS (
  SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))) ELSE v END AS u
        FROM byte WHERE k < 8 * length(s))),
h AS (SELECT c, xor(v, 4294967295) % 9 AS h, c - c % 5 AS base FROM byte WHERE k = 8 * length(s)),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (
  SELECT h.c, 0 AS part, t.pos, role, text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h
  UNION ALL SELECT h.c, 1, t.pos, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, strlen(text) AS bytes,
        md5(strlen(role) || ':' || role || text) AS turn FROM b),
p AS (
  SELECT c, 0 AS depth, 0 AS bytes, 'root' AS node FROM h
  UNION ALL SELECT c, depth, bytes, md5(string_agg(turn, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth)) FROM r),
len AS (SELECT c, max(depth) AS len FROM p GROUP BY c),
n AS (SELECT node, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY node),
e AS (SELECT DISTINCT q.node, p.node AS parent FROM p JOIN p q ON p.c = q.c AND q.depth = p.depth + 1),
ch AS (SELECT parent AS node, count(*) AS n_children FROM e GROUP BY parent),
below AS (SELECT DISTINCT p.node AS top, q.node FROM p JOIN p q ON p.c = q.c AND q.depth >= p.depth),
s AS (
  SELECT top AS node, count(*) FILTER (WHERE ch.node IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM below JOIN n USING (node) LEFT JOIN ch USING (node) GROUP BY top),
f AS (SELECT node, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ends FROM p JOIN len ON p.c = len.c AND depth = len GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN ch USING (node) LEFT JOIN f USING (node) LEFT JOIN e USING (node) LEFT JOIN n up ON up.node = e.parent
"""
