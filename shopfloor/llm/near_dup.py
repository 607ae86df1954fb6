"""MinHash near-duplicates: an LSH forest of sorted signature orders.

1. A document is its set of distinct five-word shingles (64-bit hashes).
   Documents with equal sets fall into one class before anything is compared;
   a class is a node, named by the hash of its set.
2. A node has ``HASHES`` minhashes. Each of ``TREES`` orders sorts all nodes by
   their minhashes, every tree starting at another one. The longest common
   prefix of neighbours in an order is deepest between the most similar nodes.
   A region is the nodes of an order that share ``MIN_DEPTH`` minhashes. The
   pairs of a region of at most ``REACH`` + 1 nodes are candidates if they have
   ``MIN_AGREE`` equal minhashes of all. A region of more nodes, or one that a
   border of the sorted parts may cut, is a crowd.
3. Links are confirmed on full sets: first along two of the orders, whose rows
   carry the sets, among neighbours; then pair by pair for the candidates that
   still lie in different components; and for crowds that hold several
   components, all pairs of nodes of different components, see ``_crowds``.
   Pairs inside one component add nothing.
4. Components of the confirmed links; each keeps its smallest doc_id.

Sorting is by range, so a crowd of near copies spreads over tasks like any
other rows, and no group is gathered.

Defined cases: null text counts as empty; texts without words have an empty
set and link with nothing; fewer than five words make one shingle; equal sets
are linked; rows that repeat a doc_id are rows of the same id; a null doc_id
is ignored as a component's name unless all are null, and then one text of the
component is kept; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common
from shopfloor.llm.components import components
from shopfloor.llm.tokens import BLANK_SEPARATED, mix64, ngram_ids, scan

SHINGLE = 5
SIMILAR = 75          # percent
HASHES = 64
TREES = 16
LABEL = 8             # minhashes in a sort key
MIN_DEPTH = 3
REACH = 8
MIN_AGREE = 35        # of HASHES: 0.55, over 3.5 standard errors below 0.75
VERIFY_TREES = (0, 8)
SORT_ROWS = 1 << 15   # rows of an order compared at once
RANGE_ROWS = 1 << 14  # least rows of a range partition of an order
SET_ROWS = 1 << 8     # ... of an order whose rows carry their sets
BROADCAST_IDS = 1 << 21
BLOCK = 512           # nodes of a block of a crowd
COLUMNS = 1 << 12     # shingles of two blocks multiplied at once

_RNG = np.random.default_rng(75)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * 2 + 1
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


class Sets:
    """Distinct shingles of several texts: ``ids[ptr[i]:ptr[i + 1]]``, ascending."""

    def __init__(self, texts: list[bytes]):
        w = scan(texts, BLANK_SEPARATED)
        n = np.diff(w.ptr)
        grams = ngram_ids(w.ids, SHINGLE)
        doc = w.doc()
        at = np.flatnonzero(doc[:len(grams)] == doc[SHINGLE - 1:]) if len(grams) else np.zeros(0, np.int64)
        ids, owner = [grams[at]], [doc[at]]
        for k in range(1, SHINGLE):
            few = np.flatnonzero(n == k)
            if len(few):
                whole = ngram_ids(w.ids, k)
                ids.append(whole[w.ptr[few]])
                owner.append(few)
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.lexsort((ids, owner))
        ids, owner = ids[order], owner[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
        self.ids = ids[new]
        self.ptr = np.searchsorted(owner[new], np.arange(len(texts) + 1))
        self.size = np.diff(self.ptr)

    def nodes(self) -> np.ndarray:
        """A hash of each set."""
        h = mix64(self.ids)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        twice = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(0x5bd1e995)), dtype=np.uint64)])
        a, b = (c[self.ptr[1:]] - c[self.ptr[:-1]] for c in (total, twice))
        return mix64(mix64(a) + b * np.uint64(0x9E3779B97F4A7C15) + self.size.astype(np.uint64)).view(np.int64)

    def signatures(self) -> np.ndarray:
        """Minhashes (rows: texts); rows of empty sets are not meaningful."""
        out = np.zeros((len(self.size), HASHES), dtype=">u4")
        full = np.flatnonzero(self.size)
        if len(full):
            first = self.ptr[full]
            for k in range(HASHES):
                h = (self.ids * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)
                out[full, k] = np.minimum.reduceat(h.astype(np.uint32), first)
        return out


def _signature_rows(batches):
    for b in batches:
        texts = common.as_bytes(b.column(1))
        for lo, hi in common.chunks(texts):
            s = Sets(texts[lo:hi])
            sig = s.signatures()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(s.size.astype(np.int64)), pa.array(s.nodes()),
                 pa.array([r.tobytes() for r in sig], pa.binary()), b.column(2).slice(lo, hi - lo)],
                ["doc_id", "n_shingles", "node", "sig", "text_hash"])


def _label(sig: np.ndarray, tree: int) -> np.ndarray:
    """The tree's sort key: ``LABEL`` minhashes from its own place on, big-endian."""
    at = (tree * (HASHES // TREES) + np.arange(LABEL)) % HASHES
    return np.ascontiguousarray(sig[:, at])


def _tree_rows(batches):
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=">u4").reshape(-1, HASHES)
        low = [r.tobytes() for r in sig.astype(np.uint8)]
        for t in range(TREES):
            key = [bytes([t]) + r.tobytes() for r in _label(sig, t)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), b.column(0), pa.array(low, pa.binary())],
                                             ["key", "node", "low"])


def _runs(batches, columns: int):
    """The rows of a sorted partition in blocks that repeat the last ``REACH``
    rows of the block before; yields (rows as lists, number repeated)."""
    held: list[list] = [[] for _ in range(columns)]
    repeated = 0
    for b in batches:
        for h, c in zip(held, b.columns):
            h.extend(c.to_pylist())
        if len(held[0]) >= SORT_ROWS:
            yield held, repeated
            held = [h[-REACH:] for h in held]
            repeated = len(held[0])
    if len(held[0]) > repeated:
        yield held, repeated


def _neighbours(key: list[bytes], low: list[bytes], repeated: int):
    """Index pairs (i, j), i < j, and their equal minhashes, of the candidates."""
    depth = 1 + 4 * MIN_DEPTH
    k = np.frombuffer(b"".join(x[:depth] for x in key), np.uint8).reshape(-1, depth)
    s = np.frombuffer(b"".join(low), np.uint8).reshape(-1, HASHES)
    same = np.concatenate([[False], (k[1:] == k[:-1]).all(axis=1)])
    region = np.cumsum(~same)
    for d in range(1, REACH + 1):
        j = np.flatnonzero(region[d:] == region[:-d]) + d
        j = j[j >= repeated]
        if len(j):
            agree = (s[j] == s[j - d]).sum(axis=1)
            ok = agree >= MIN_AGREE
            yield j[ok] - d, j[ok], agree[ok]


class Forest:
    """Union-find over the rows of one partition."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _candidates(batches):
    """Of a part of an order: candidate pairs (a, b) of small regions, and the
    nodes (a, null) of crowds. A region at either end of a block of rows may go
    on elsewhere and counts as a crowd."""
    depth = 1 + 4 * MIN_DEPTH
    for (key, node, low), repeated in _runs(batches, 3):
        at = np.array(node, dtype=np.int64)
        k = np.frombuffer(b"".join(x[:depth] for x in key), np.uint8).reshape(-1, depth)
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
        size = np.diff(np.append(first, len(at)))
        crowd = size > REACH + 1
        crowd[[0, -1]] = True
        crowd = np.repeat(crowd, size)
        pairs = [np.stack(x)[:2] for x in _neighbours(key, low, repeated)]
        i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        i, j = i[~crowd[i]], j[~crowd[i]]
        x, y, c = at[i], at[j], np.flatnonzero(crowd)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.minimum(x, y), at[c]])),
             pa.concat_arrays([pa.array(np.maximum(x, y)), pa.nulls(len(c), pa.int64())]),
             pa.concat_arrays([pa.nulls(len(x), pa.binary()), pa.array([k[r].tobytes() for r in c], pa.binary())])],
            ["a", "b", "region"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets reach the similarity exactly."""
    if 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _set_rows(batches):
    for b in batches:
        texts = common.as_bytes(b.column(0))
        for lo, hi in common.chunks(texts):
            s = Sets(texts[lo:hi])
            sig = s.signatures()
            labels = [[bytes([t]) + r.tobytes() for r in _label(sig, t)] for t in VERIFY_TREES]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.nodes()), *(pa.array(x, pa.binary()) for x in labels),
                 pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary()),
                 pa.array([s.ids[p:q].tobytes() for p, q in zip(s.ptr[:-1], s.ptr[1:])], pa.binary())],
                ["node", *(f"key{t}" for t in VERIFY_TREES), "low", "shingles"])


def _confirm_neighbours(batches):
    """Confirmed links of a part of an order whose rows carry their sets, as
    links of each node to the smallest one it reaches within the part."""
    linked = Forest()
    for (key, node, low, shingles), repeated in _runs(batches, 4):
        sets = [np.frombuffer(x, np.uint64) for x in shingles]
        for i, j, _ in _neighbours(key, low, repeated):
            for x, y in zip(i.tolist(), j.tolist()):
                if linked.root(node[x]) != linked.root(node[y]) and similar(sets[x], sets[y]):
                    linked.join(node[x], node[y])
    links = [(x, r) for x in list(linked.up) if (r := linked.root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                      pa.array([r for _, r in links], pa.int64())], ["a", "b"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every one of ``b``."""
    x, y = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)

    def entries(ids, sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(shared, ids), max(len(shared) - 1, 0))
        ok = shared[col] == ids
        row, col = row[ok], col[ok]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    if len(shared):
        (ra, ca), (rb, cb) = entries(x, a), entries(y, b)
        for lo in range(0, len(shared), COLUMNS):
            sides = []
            for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
                p, q = np.searchsorted(c, [lo, lo + COLUMNS])
                m = np.zeros((n, min(COLUMNS, len(shared) - lo)), np.float32)
                m[r[p:q], c[p:q] - lo] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
    return out.astype(np.int64)  # exact: set sizes are far below 2**24


def _confirm_blocks(batches):
    """Rows (pair, side, root, shingles) in ascending order of pair, a pair of
    blocks (side 2: a block with itself), to links between the roots."""

    def links(side, root, shingles):
        side, root = np.array(side), np.array(root, dtype=np.int64)
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(a) or not len(b):
            return
        sets = [np.frombuffer(x, np.uint64) for x in shingles]
        size = np.array([len(x) for x in sets])
        both = _overlaps([sets[r] for r in a], [sets[r] for r in b])
        alike = 100 * both >= SIMILAR * (size[a][:, None] + size[b][None, :] - both)
        i, j = np.nonzero(alike & (root[a][:, None] != root[b][None, :]))
        linked = Forest()
        for x, y in np.unique(np.stack([root[a[i]], root[b[j]]], axis=1), axis=0).tolist():
            if linked.join(x, y):
                yield x, y

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                           pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    last, held = None, [[], [], []]
    for b in batches:
        for pair, *row in zip(*(c.to_pylist() for c in b.columns)):
            if pair != last:
                if held[0]:
                    yield batch(list(links(*held)))
                last, held = pair, [[], [], []]
            for h, x in zip(held, row):
                h.append(x)
    if held[0]:
        yield batch(list(links(*held)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _crowds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components of each crowd, all its pairs compared.

    ``members(region, node, root, n)``. A crowd's nodes are dealt into blocks of
    about ``BLOCK``: those of a component of a block or more by themselves, the
    others by size, whose classes are a factor 4/3 apart. A pair of blocks is
    compared in one task, unless both are of one component or their sizes
    exclude the similarity. Only the pairs of blocks grow with the square of a
    crowd, and no crowd is gathered.
    """
    parts = common.parts(members.sparkSession)
    own = common.written(members.groupBy("region", "root").agg(F.count(F.lit(1)).alias("c")), "crowd-roots")
    mixed = own.groupBy("region").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("region")
    mixed = common.written(mixed, "crowd-regions")
    big = common.written(own.where(F.col("c") >= BLOCK).select("region", "root", F.lit(True).alias("big"))
                         .join(_small(mixed), "region", "left_semi"), "crowd-large")
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3))).cast("long")
    m = (members.join(_small(mixed), "region", "left_semi").join(_small(big), ["region", "root"], "left")
         .withColumn("big", F.coalesce("big", F.lit(False))).withColumn("label", F.when(F.col("big"), F.col("root")).otherwise(level)))
    m = common.written(m, "crowd-members")
    cells = common.written(
        m.groupBy("region", "big", "label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"),
                                                F.min("n").alias("lo"), F.max("n").alias("hi")), "crowd-cells")
    m = (m.join(_small(cells.select("region", "big", "label", "blocks")), ["region", "big", "label"])
         .withColumn("block", F.pmod(F.xxhash64("node"), "blocks")))
    x, y = (cells.select("region", *(F.col(c).alias(f"{c}{k}") for c in ("big", "label", "blocks", "lo", "hi")))
            for k in (1, 2))
    same = (F.col("big1") == F.col("big2")) & (F.col("label1") == F.col("label2"))
    after = (F.col("big1") < F.col("big2")) | (F.col("big1") == F.col("big2")) & (F.col("label1") < F.col("label2"))
    fits = (100 * F.col("hi1") >= SIMILAR * F.col("lo2")) & (100 * F.col("hi2") >= SIMILAR * F.col("lo1"))
    blocks = (x.join(y, "region").where(fits & (after | same & ~F.col("big1")))
              .withColumn("block1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks1") - 1)))
              .withColumn("block2", F.explode(F.sequence(F.when(same, F.col("block1")).otherwise(F.lit(0).cast("long")),
                                                         F.col("blocks2") - 1)))
              .withColumn("alone", same & (F.col("block1") == F.col("block2")))
              .withColumn("pair", F.monotonically_increasing_id()))
    side = lambda k: F.struct(F.lit(k - 1).alias("side"), F.col(f"big{k}").alias("big"),
                              F.col(f"label{k}").alias("label"), F.col(f"block{k}").alias("block"))
    alone = F.struct(F.lit(2).alias("side"), F.col("big1").alias("big"), F.col("label1").alias("label"),
                     F.col("block1").alias("block"))
    tasks = (blocks.select("region", "pair",
                           F.explode(F.when(F.col("alone"), F.array(alone)).otherwise(F.array(side(1), side(2)))).alias("s"))
             .select("region", "pair", "s.*"))
    tasks = common.written(tasks, "crowd-pairs")  # the numbers of the pairs are fixed by the file
    dealt = m.join(tasks, ["region", "big", "label", "block"]).select("pair", "side", "node", "root")
    return (dealt.join(sets.select("node", "shingles"), "node").select("pair", "side", "root", "shingles")
            .repartition(parts, "pair").sortWithinPartitions("pair")
            .mapInArrow(common.lean(_confirm_blocks), "a long, b long"))


def _confirm_pairs(batches):
    for b in batches:
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
              for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])


def _ordered(df: DataFrame, key: str, rows: int, least: int) -> DataFrame:
    n = max(1, min(common.parts(df.sparkSession), rows // least))
    return df.repartitionByRange(n, key, "node").sortWithinPartitions(key, "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept, text_hash."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"),
                    common.text_hash(F.col("text")).alias("text_hash"))
    rows = common.written(d.mapInArrow(
        common.lean(_signature_rows), "doc_id long, n_shingles long, node long, sig binary, text_hash long"), "signatures")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("own"), F.first("sig").alias("sig"))
    nodes = nodes.select("node", F.col("own.doc_id").alias("rep"), F.col("own.text_hash").alias("text_hash"), "sig")
    n_nodes = rows.where("n_shingles > 0").select("node").distinct().count()
    trees = _ordered(nodes.select("node", "sig").mapInArrow(common.lean(_tree_rows), "key binary, node long, low binary"),
                     "key", n_nodes * TREES, RANGE_ROWS)
    found = common.written(trees.mapInArrow(common.lean(_candidates), "a long, b long, region binary").distinct(),
                           "candidates")
    pairs = found.where("region is null").select("a", "b")
    # An order's end alone in its region is no crowd.
    crowds = found.where("region is not null").select("region", F.col("a").alias("node"))
    several = crowds.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region")
    crowds = common.written(crowds.join(several, "region", "left_semi"), "crowds")

    # The sets of the nodes that have a candidate, from one document each.
    wanted = common.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowds.select("node"))
                            .distinct(), "wanted")
    ids = wanted.join(nodes.select("node", "rep", "text_hash"), "node").select(F.col("rep").alias("_id"), F.col("text_hash").alias("_hash"))
    n_wanted = wanted.count()
    if n_wanted <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    columns = "node long, " + ", ".join(f"key{t} binary" for t in VERIFY_TREES) + ", low binary, shingles binary"
    sets = (d.join(ids, d["doc_id"].eqNullSafe(ids["_id"]) & (d["text_hash"] == ids["_hash"]), "left_semi").select("text")
            .mapInArrow(common.lean(_set_rows), columns)
            .join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    sets = common.written(sets, "sets")
    links = None
    for t in VERIFY_TREES:
        found = (_ordered(sets.select("node", F.col(f"key{t}").alias("key"), "low", "shingles"), "key", n_wanted,
                         SET_ROWS)
                 .select("key", "node", "low", "shingles").mapInArrow(common.lean(_confirm_neighbours), "a long, b long"))
        links = found if links is None else links.unionByName(found)
    links = common.written(links, "links")
    first = common.written(components(links, "near"), "near-roots")

    def rooted(df: DataFrame, c: str) -> DataFrame:
        r = first.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        return df.join(r, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))

    apart = rooted(rooted(pairs, "a"), "b").where("ra <> rb")
    side = sets.select("node", "shingles")
    checked = (apart.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
               .select("ra", "rb", "sa", "sb").mapInArrow(common.lean(_confirm_pairs), "a long, b long"))
    sizes = sets.select("node", (F.length("shingles") / 8).cast("long").alias("n"))
    members = common.written(crowds.join(sizes, "node").join(first, "node", "left")
                             .select("region", "node", F.coalesce("root", "node").alias("root"), "n"), "members")
    second = components(checked.unionByName(_crowds(members, sets)), "near-rest")
    root = (first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            .select("node", F.coalesce("top", "root").alias("root"))
            .unionByName(second.join(first, "node", "left_anti").select("node", "root")))

    # Names per node, in a table of their own: the join of all rows is then one
    # of two exchanges, whose crowded partitions Spark can split.
    own = nodes.select("node", "rep").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    top = own.groupBy("root").agg(F.min("rep").alias("name"), F.min("node").alias("head"))
    names = common.written(own.join(top, "root").select("node", "name", "head"), "names")
    out = rows.select("doc_id", "n_shingles", "node", "text_hash").join(names, "node", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("name").isNotNull(), F.col("name")).otherwise(F.col("doc_id"))
    # of a component without any id one text stays
    first_text = F.col("name").isNotNull() | F.col("head").isNull() | (F.col("node") == F.col("head"))
    kept = F.col("doc_id").eqNullSafe(component) & ((F.col("n_shingles") == 0) | first_text)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that name their component."""
    return common.without_rows(docs, near_duplicates(docs).where(~F.col("kept")).select("doc_id", "text_hash"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("text_hash")
