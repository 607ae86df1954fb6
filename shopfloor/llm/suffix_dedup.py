"""Repeated passages by a suffix array over range-partitioned suffixes.

1. Sparse suffixes (see ``suffixes``): every window of 50 bytes belongs to the
   suffix at its anchor, about one byte in 18. Long texts are read in slices
   that overlap by a window, so that no array grows with a text.
2. A sample of the suffixes' leading tokens (16 bytes) is ordered by Spark, and
   every SAMPLE_PER_BUCKET-th is a splitter; splitters range-partition the
   suffixes into buckets of about BUCKET_BYTES of text, however large the input.
   Several buckets are one shuffle partition, read one bucket at a time.
3. Equal segments of one map chunk travel once, with the positions of their
   smallest document; the copies in other documents are decided on the spot. A
   passage of a third of all documents thus weighs one row per chunk.
4. A bucket orders its suffixes by multikey quicksort and finds the windows
   that a smaller document has too (``suffixes.earlier``).
5. A token that is two or more splitters long spans buckets. Its segments are
   dealt over them by their hash, and the windows that stay undecided inside a
   bucket are compared across the boundaries, by a window function over the
   window's bytes.
6. Removed intervals meet their texts by id, packed by home (a hash of the id).

Defined cases: a null text counts as empty; a null doc_id counts as the
smallest id; rows of one doc_id do not remove from each other, whether their
texts are equal or not; texts under 50 bytes lose nothing; other columns,
whatever their names, are not read; an empty table gives no rows. What is left of
a text may be cut inside a character, so it is binary.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.llm import common, suffixes
from shopfloor.llm.suffixes import WINDOW, Segments
from shopfloor.llm.tokens import mix64

BUCKET_BYTES = 4 << 20
SAMPLE_PER_BUCKET = 64
SAMPLED_DOCS = 32         # one document in so many is read for the sample
CHUNK_BYTES = 8 << 20     # text whose segments are packed together; equal ones once
NO_ID = -(1 << 63)

# home: where the texts of an id meet their removed intervals
PACKED = "bucket long, part binary, home long, blob binary"
DECIDED = "home long, blob binary, id long, tag long, spans binary, window binary"
HOMES = 4                 # homes per shuffle partition
HELD_SPANS = 1 << 18


def _slices(texts: list[bytes]):
    """(text index, offset, bytes): whole short texts, long ones in overlapping slices."""
    step = common.CHUNK_BYTES
    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        for lo in range(0, len(t) - WINDOW + 1, step):
            yield i, lo, t[lo:lo + step + WINDOW - 1]


def _kernel_chunks(texts: list[bytes]):
    """Segments of the texts, as (segments, text index, offset of the first window)."""
    held, size = [], 0

    def run():
        s, which, pos = suffixes.segments([x[2] for x in held])
        doc = np.array([x[0] for x in held], np.int64)
        base = np.array([x[1] for x in held], np.int64)
        return s, doc[which], base[which] + pos

    for x in _slices(texts):
        if held and size + len(x[2]) > common.CHUNK_BYTES:
            yield run()
            held, size = [], 0
        held.append(x)
        size += len(x[2])
    if held:
        yield run()


# --- splitters -------------------------------------------------------------

def splitters(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, sampled: int = SAMPLED_DOCS) -> np.ndarray:
    """Ascending tokens that cut the suffixes into buckets (repeats stay): one per
    ``bucket_bytes`` of text, from the suffixes of one document in ``sampled``."""
    # of the sampled documents' suffixes (one per 18 bytes), one in so many
    one_in = max(1, bucket_bytes // sampled // 18 // SAMPLE_PER_BUCKET)

    def sample(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for s, doc, pos in _kernel_chunks(b.column(1).to_pylist()):
                x = mix64(ids[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))
                t = s.tokens()[x % np.uint64(one_in) == 0]
                yield pa.RecordBatch.from_arrays([pa.array(_whole(t), pa.binary())], ["token"])

    def every(batches):
        seen = 0
        for b in batches:
            k = np.arange(seen, seen + b.num_rows)
            seen += b.num_rows
            yield b.filter(pa.array(k % SAMPLE_PER_BUCKET == SAMPLE_PER_BUCKET - 1))

    rows = docs.where(F.pmod(F.xxhash64("id"), F.lit(sampled)) == 0).select("id", "text")
    tokens = common.written(rows.mapInArrow(sample, "token binary"), "suffix-sample")
    picked = (tokens.repartitionByRange(common.parts(docs.sparkSession), "token").sortWithinPartitions("token")
              .mapInArrow(every, "token binary"))
    # 16 bytes per bucket of input
    found = sorted(bytes(r.token) for r in picked.collect())
    return np.array(found, dtype=f"S{suffixes.TOKEN}")


def _whole(tokens: np.ndarray) -> list[bytes]:
    return [t.ljust(suffixes.TOKEN, b"\0") for t in tokens.tolist()]


def deal(tokens: np.ndarray, salt: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, whether the token spans several buckets) of each suffix."""
    lo, hi = np.searchsorted(cuts, tokens, "left"), np.searchsorted(cuts, tokens, "right")
    spans = hi - lo >= 2
    spread = lo + 1 + (salt % np.maximum(hi - lo, 1).astype(np.uint64)).astype(np.int64)
    return np.where(spans, spread, hi), spans


# --- map side --------------------------------------------------------------

def _squeezed(arrays: tuple) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unsqueezed(part: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(part))


def merged_spans(ids, tags, start, stop):
    """Unions of the intervals of each (id, tag), ascending."""
    if not len(ids):
        return ids, tags, start, stop
    o = np.lexsort((tags, ids))
    ids, tags, start, stop = ids[o], tags[o], start[o], stop[o]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    owner = np.flatnonzero(new)
    g, a, z = suffixes.merged(np.cumsum(new) - 1, start, stop)
    return ids[owner][g], tags[owner][g], a, z


def _home(ids, tags, homes: int):
    return (ids ^ tags) % homes


def prime_from(n: int) -> int:
    """The first prime from ``n`` on: ids in steps (every 20th, say) still spread."""
    while any(n % k == 0 for k in range(2, int(n ** 0.5) + 1)) or n < 2:
        n += 1
    return n


def by_home(spans: list, homes: int):
    """Intervals (lists of id, tag, start, stop arrays) as rows (home, blob)."""
    ids, tags, a, z = merged_spans(*(np.concatenate([x[k] for x in spans]) for k in range(4)))
    home = _home(ids, tags, homes)
    o = np.argsort(home, kind="stable")
    for c in np.split(o, np.flatnonzero(np.diff(home[o])) + 1):
        if len(c):
            yield int(home[c[0]]), _squeezed((ids[c], tags[c], a[c], z[c]))


def pack(parts: list, cuts: np.ndarray, homes: int):
    """Rows of PACKED of one map chunk; parts: (segments, ids, tags, positions)."""
    s = Segments.concat([p[0] for p in parts])
    ids, tags, pos = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    o = np.lexsort((pos, tags, ids, s.hash))
    h = s.hash[o]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    rep = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    # equal hashes of unequal bytes: such a segment is a class of its own
    twin = rep != o
    differs = np.zeros(len(o), dtype=bool)
    differs[twin] = ~suffixes.same_bytes(s, o[twin], rep[twin])
    rep[differs] = o[differs]
    later = ids[o] > ids[rep]
    if later.any():
        i = o[later]
        for home, blob in by_home([(ids[i], tags[i], pos[i], pos[i] + s.size[i])], homes):
            yield home % (len(cuts) + 1), None, home, blob
    occ, rep = o[~later], rep[~later]
    back = np.argsort(rep, kind="stable")
    occ, rep = occ[back], rep[back]
    first = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]]))
    count = np.diff(np.append(first, len(rep)))
    which = rep[first]
    bucket, spans = deal(s.tokens()[which], s.hash[which], cuts)
    order = np.lexsort((pos[which], ids[which], bucket))
    for c in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        own = which[c]
        own_occ = occ[suffixes.flat(first[c], count[c])]
        yield int(bucket[c[0]]), _squeezed((
            s.bytes_of(own), s.size[own].astype(np.uint8), s.left[own].astype(np.uint8), spans[c],
            np.diff(ids[own], prepend=0), count[c].astype(np.uint32), tags[own_occ], pos[own_occ].astype(np.uint64))), None, None


def _map_side(cuts, homes):
    def run(batches):
        cut = cuts.value
        parts, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, doc, pos in _kernel_chunks(b.column(2).to_pylist()):
                parts.append((s, ids[doc], tags[doc], pos))
                size += len(s.buf)
                if size > CHUNK_BYTES:
                    yield from _batches(pack(parts, cut, homes), PACKED)
                    parts, size = [], 0
        if any(len(p[0]) for p in parts):
            yield from _batches(pack(parts, cut, homes), PACKED)
    return run


_TYPES = {"long": pa.int64(), "binary": pa.binary()}


def _batches(rows, schema: str, limit: int = 4 << 20):
    names = [c.split()[0] for c in schema.split(", ")]
    types = [_TYPES[c.split()[1]] for c in schema.split(", ")]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(v) for v in r if isinstance(v, bytes))
        if size > limit:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


# --- buckets ---------------------------------------------------------------

def decide(parts: list[bytes]):
    """One bucket: intervals (id, tag, start, stop arrays) that go, and the windows
    still to compare across boundaries as rows (id, tag, spans, window)."""
    got = [_unsqueezed(p) for p in parts]
    buf, size, left, wide, _, count, tag, pos = (np.concatenate([g[k] for g in got]) for k in range(8))
    ids = np.concatenate([np.cumsum(g[4]) for g in got])
    del got
    count, size, pos = count.astype(np.int64), size.astype(np.int64), pos.astype(np.int64)
    s = Segments(buf, suffixes.ends(size)[:-1], size, left.astype(np.int64), np.zeros(len(size), np.uint64))
    at = suffixes.ends(count)
    seg, off = suffixes.earlier(s, ids)
    gone = []
    if len(seg):
        new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(seg)) - 1
        run, lo, hi = seg[first], off[first], off[last] + WINDOW
        n = count[run]
        o = suffixes.flat(at[run], n)
        gone.append((np.repeat(ids[run], n), tag[o], pos[o] + np.repeat(lo, n), pos[o] + np.repeat(hi, n)))

    def undecided():
        for i in np.flatnonzero(wide).tolist():
            o = slice(at[i], at[i + 1])
            known = set(off[np.searchsorted(seg, i):np.searchsorted(seg, i, "right")].tolist())
            for j in range(int(size[i]) - WINDOW + 1):
                if j in known:
                    continue
                begin = int(s.start[i]) + j
                owner, tags, a, z = merged_spans(np.full(count[i], ids[i]), tag[o], pos[o] + j, pos[o] + j + WINDOW)
                for k in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(tags)) + 1):
                    yield (int(ids[i]), int(tags[k[0]]), np.stack([a[k], z[k]], axis=1).astype("<i8").tobytes(),
                           buf[begin:begin + WINDOW].tobytes())

    return gone, undecided()


def _bucket_side(homes):
    """Rows arrive ordered by bucket; one bucket is held at a time."""
    def run(batches):
        gone: list = []

        def flush():
            if gone:
                for home, blob in by_home(gone, homes):
                    yield home, blob, None, None, None, None
                gone.clear()

        def bucket(held):
            spans, rest = decide(held)
            gone.extend(spans)
            if sum(len(x[0]) for x in gone) > HELD_SPANS:
                yield from flush()
            for r in rest:
                yield None, None, *r

        def rows():
            held, at = [], None
            for b in batches:
                for number, part, home, blob in zip(*(c.to_pylist() for c in b.columns)):
                    if part is None:
                        yield home, blob, None, None, None, None
                        continue
                    if number != at and held:
                        yield from bucket(held)
                        held = []
                    at = number
                    held.append(part)
            if held:
                yield from bucket(held)
            yield from flush()

        yield from _batches(rows(), DECIDED)
    return run


def _rows_by_home(homes):
    """Rows (id, tag, spans) as rows (home, blob)."""
    def run(batches):
        def rows():
            for b in batches:
                spans = []
                for doc, tag, x in zip(*(c.to_pylist() for c in b.columns)):
                    p = np.frombuffer(x, "<i8").reshape(-1, 2)
                    spans.append((np.full(len(p), doc), np.full(len(p), tag), p[:, 0], p[:, 1]))
                if spans:
                    yield from by_home(spans, homes)
        yield from _batches(rows(), "home long, blob binary")
    return run


def removed(docs: DataFrame, homes: int, bucket_bytes: int = BUCKET_BYTES, sampled: int = SAMPLED_DOCS) -> DataFrame:
    """Removed intervals of ``docs(id, tag, text binary)`` as (home, blob), a blob
    being the arrays id, tag, start, stop of some documents of that home."""
    spark = docs.sparkSession
    cuts = spark.sparkContext.broadcast(splitters(docs, bucket_bytes, sampled))
    packed = docs.select("id", "tag", "text").mapInArrow(_map_side(cuts, homes), PACKED)
    decided = common.written(
        packed.repartition(common.parts(spark), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_bucket_side(homes), DECIDED), "suffix-spans")
    inside = decided.where("window is null").select("home", "blob")
    least = F.min("id").over(Window.partitionBy("window"))
    across = (decided.where("window is not null").withColumn("least", least)
              .where("id > least").select("id", "tag", "spans"))
    return inside.unionByName(across.mapInArrow(_rows_by_home(homes), "home long, blob binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, id, tag, text binary). Where ids repeat, the
    tag tells their texts apart."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    ids = docs.select(key.alias("id")).groupBy("id").count().where("count > 1")
    tag = F.lit(0).cast("long") if ids.isEmpty() else common.text_hash(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("id"), tag.alias("tag"),
                       common.text_or_empty().cast("binary").alias("text"))


CUT = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"]


def _cut(batches):
    """Rows arrive ordered by home, a home's blobs before its texts."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string()]
    at, blobs, known = None, [], {}

    def index():
        ids, tags, a, z = merged_spans(*(np.concatenate([x[k] for x in blobs]) for k in range(4)))
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
        keys = zip(ids[new].tolist(), tags[new].tolist())
        return {k: (a[lo:hi], z[lo:hi]) for k, lo, hi in zip(keys, new, np.append(new[1:], len(ids)))}

    for b in batches:
        held, size = [], 0
        for home, blob, doc_id, key, tag, text in zip(*(c.to_pylist() for c in b.columns)):
            if home != at:
                at, blobs, known = home, [], {}
            if text is None:
                blobs.append(_unsqueezed(blob))
                continue
            if blobs:
                known, blobs = index(), []
            runs, kept = [], text
            if (key, tag) in known:
                a, z = known[key, tag]
                runs = np.stack([a, z], axis=1).tolist()
                kept = b"".join(text[lo:hi] for lo, hi in zip([0, *z.tolist()], [*a.tolist(), len(text)]))
            held.append((doc_id, len(text), len(text) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()))
            size += len(kept)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], CUT)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], CUT)


def deduplicated(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, sampled: int = SAMPLED_DOCS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, spans
    (removed runs, [start, stop) each), kept (the other bytes), kept_sha256."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    homes = prime_from(HOMES * common.parts(spark))
    d = keyed(docs)
    null = F.lit(None)
    blobs = removed(d, homes, bucket_bytes, sampled).select(
        "home", "blob", *(null.cast("long").alias(c) for c in ("doc_id", "id", "tag")), null.cast("binary").alias("text"))
    texts = d.select(F.pmod(F.col("id").bitwiseXOR(F.col("tag")), F.lit(homes)).alias("home"),
                     null.cast("binary").alias("blob"), "doc_id", "id", "tag", "text")
    return (blobs.unionByName(texts).repartition(common.parts(spark), "home")
            .sortWithinPartitions("home", F.col("text").isNotNull())
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, "
                              "kept_sha256 string"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# Windows as hex text, taken from blocks of 4096 bytes that overlap by a window.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
blocks AS (
  SELECT doc_id, b * 4096 AS base, substr(x, b * 8192 + 1, 8192 + 98) AS y
  FROM (SELECT doc_id, x, unnest(range(0, n // 4096 + 1)) AS b FROM n)),
w AS (
  SELECT doc_id, base + k AS p, md5(substr(y, 2 * k + 1, 100)) AS s
  FROM (SELECT doc_id, base, y, unnest(range(0, least(4096, length(y) // 2 - 49))) AS k FROM blocks)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least_id FROM w),
c AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM m WHERE least_id < doc_id),
i AS (SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, run),
e AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM r),
k AS (
  SELECT e.doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS head
  FROM e JOIN n USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""
