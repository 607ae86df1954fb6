"""Fill-in-middle examples as piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable
buffers, its own text and the sentinels; no step copies text. Cutting splits
the one text descriptor at two code points, an arrangement permutes the
descriptors of prefix, middle, suffix and the three sentinels, and a digest or
the output string streams the descriptors in their order. An output is read
back the same way: its sentinels split it into descriptors, the inverse
permutation puts them in order, and the first three are the text.

The cuts, and whether a text is arranged at all, come from the sha256 of the
row's id, so they do not depend on other rows, partitions or retries.

Defined cases: a null text counts as empty, an empty text and one that holds a
sentinel stay plain; a null id hashes like an empty one (``1:``); rows that
repeat an id get the same hashes; a text is never cut or capped, whatever its
length; other columns, whatever their names, are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
# Places of the pieces: 0 prefix, 1 middle, 2 suffix, 3 <P>, 4 <S>, 5 <M>.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
ARRANGED_PERCENT = 90
SPM_PERCENT = 20
OUT_BYTES = 4 << 20  # output texts travel in batches of about this size


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, length) over immutable buffers."""

    buffers: tuple[bytes, ...]
    pieces: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, text: bytes) -> "PieceTable":
        return cls((text, SENTINELS), ((0, 0, len(text)),))

    def cut(self, piece: int, *at: int) -> "PieceTable":
        """Split one descriptor at ascending offsets inside it."""
        b, start, length = self.pieces[piece]
        ends = (0, *at, length)
        parts = tuple((b, start + lo, hi - lo) for lo, hi in zip(ends, ends[1:]))
        return PieceTable(self.buffers, self.pieces[:piece] + parts + self.pieces[piece + 1:])

    def with_sentinels(self) -> "PieceTable":
        n = len(PREFIX)
        return PieceTable(self.buffers, self.pieces + ((1, 0, n), (1, n, n), (1, 2 * n, n)))

    def permuted(self, order) -> "PieceTable":
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def spans(self):
        for b, start, length in self.pieces:
            yield memoryview(self.buffers[b])[start:start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for span in self.spans():
            h.update(span)
        return h.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.spans())


def code_points(text: bytes) -> np.ndarray | None:
    """Byte offsets of the code points and of the end; None for ASCII."""
    if text.isascii():
        return None
    u = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((u & 0xC0) != 0x80), len(u))


def arrange(text: bytes, h1: int, h2: int, h3: int, h4: int):
    """(piece table of the output, n, form, prefix_chars, middle_chars)."""
    at = code_points(text)
    n = len(text) if at is None else len(at) - 1
    table = PieceTable.of(text)
    if not text or h3 % 100 >= ARRANGED_PERCENT or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return table, n, "plain", None, None
    form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends = (a, z) if at is None else (int(at[a]), int(at[z]))
    table = table.cut(0, *ends).with_sentinels().permuted(ARRANGEMENTS[form])
    return table, n, form, a, z - a


def restore(output: bytes, form: str) -> PieceTable:
    """The text of an output as a piece table over the output."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    order = ARRANGEMENTS[form]
    cuts, at = [], 0
    for place in order:
        if place >= 3:
            n = len(PREFIX)
            at = output.index(SENTINELS[(place - 3) * n:(place - 2) * n], at)
            cuts += [at, at + n]
            at += n
    # the first sentinel begins the output, so the first cut is at 0
    table = table.cut(0, *cuts[1:])
    return table.permuted(np.argsort(order)[:3])


def _flush(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _batched(rows, names, types, size):
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total > OUT_BYTES or len(held) >= common.ARROW_ROWS:
            yield _flush(held, names, types)
            held, total = [], 0
    if held:
        yield _flush(held, names, types)


def arranged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n, form, prefix_chars,
    middle_chars, output, output_sha256."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches):
        def rows():
            for b in batches:
                for i, text, *hs in zip(*(c.to_pylist() for c in b.columns)):
                    table, n, form, p, m = arrange(text, *hs)
                    yield i, n, form, p, m, table.bytes(), table.sha256()
        yield from _batched(rows(), names, types, lambda r: len(r[5]))

    out = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().cast("binary").alias("text"), *h).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(examples: DataFrame) -> DataFrame:
    """The rows of ``arranged`` with ``text`` and ``restored_sha256``, taken from
    ``output`` and ``form`` alone."""
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    names = [*kept, "text", "restored_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches):
        def rows():
            for b in batches:
                for *own, output in zip(*(c.to_pylist() for c in b.columns)):
                    table = restore(output, own[2])
                    yield *own, table.bytes(), table.sha256()
        yield from _batched(rows(), names, types, lambda r: len(r[6]))

    out = examples.select(*kept, F.col("output").cast("binary")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
             "text binary, restored_sha256 string")
    return out.withColumn("text", F.col("text").cast("string"))


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(arranged(common.table(spark, sf_dir, "documents"))).drop("text")


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
    CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, z - a) AS mid, substr(text, z + 1) AS suf FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
