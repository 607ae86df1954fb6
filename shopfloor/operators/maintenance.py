"""Batch table maintenance (T1-T8).

The reference edits one row per HTTP request inside a transaction.  Here a
DataFrame of requested changes is applied to a table in one job and the new
table is returned (plus rejects / counts where the reference reports them).
Every step is a join, anti-join or union on the table keys; nothing is
collected to the driver. Requests that depend on each other (T5, a mixed log)
are decided as if they came one after the other.

Generated ids are deterministic (``md5`` of the natural key) instead of
random UUIDs, so a batch applied twice yields the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from shopfloor.session import written


def _present(df: DataFrame, name: str) -> Column:
    """JavaScript truthiness of a required field: NULL, '' and 0 are missing."""
    c = F.col(name)
    dt = df.schema[name].dataType
    if isinstance(dt, StringType):
        return c.isNotNull() & (c != "")
    if isinstance(dt, NumericType):
        return c.isNotNull() & (c != 0) & ~F.isnan(c.cast("double"))
    if isinstance(dt, BooleanType):
        return F.coalesce(c, F.lit(False))
    return c.isNotNull()


def valid_rows(df: DataFrame, required: Sequence[str]) -> Column:
    cond = F.lit(True)
    for r in required:
        cond = cond & _present(df, r)
    return F.coalesce(cond, F.lit(False))


def append_validated(table: DataFrame, candidates: DataFrame,
                     required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """T1: append candidates having every required field; return (table, rejects)."""
    ok = valid_rows(candidates, required)
    accepted = candidates.where(ok).select(*table.columns)
    return table.unionByName(accepted), candidates.where(~ok)


def last_per(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the largest ``order`` (the last request of a batch
    applied one at a time), as a partial ``max_by`` aggregate."""
    cols = rows.columns
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("__r"))
            .select(*[F.col("__r").getField(c).alias(c) for c in cols]))


def update_by_key(table: DataFrame, changes: DataFrame, key: Sequence[str] | str,
                  columns: Sequence[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """T2: overwrite ``columns`` of rows whose key matches a change (a NULL in
    the change overwrites too); return (table, changes matching no row).
    Change keys must be unique unless ``order`` names the request order, in
    which case the last change per key wins (sequential application)."""
    keys = [key] if isinstance(key, str) else list(key)
    if order is not None:
        changes = last_per(changes, keys, order)
    c = changes.select(*keys, *[F.col(x).alias(f"__new_{x}") for x in columns],
                       F.lit(True).alias("__hit"))
    j = table.join(c, on=keys, how="left")
    out = [F.when(F.col("__hit"), F.col(f"__new_{x}")).otherwise(F.col(x)).alias(x)
           if x in columns else F.col(x) for x in table.columns]
    unmatched = changes.join(table.select(*keys), on=keys, how="left_anti")
    return j.select(*out), unmatched


def delete_by_key(table: DataFrame, keys: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """T3: drop rows whose key is listed."""
    ks = [key] if isinstance(key, str) else list(key)
    return table.join(keys.select(*ks), on=ks, how="left_anti")


def first_per(rows: DataFrame, unique: Sequence[str], order: str) -> DataFrame:
    """One row per ``unique`` value: the smallest ``order`` (batch order).
    A partial aggregate, so a hot key does not land in one task whole."""
    cols = rows.columns
    return (rows.groupBy(*unique).agg(F.min_by(F.struct(*cols), F.col(order)).alias("__r"))
            .select(*[F.col("__r").getField(c).alias(c) for c in cols]))


def insert_if_absent(table: DataFrame, rows: DataFrame, unique: Sequence[str], order: str,
                     required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """T4: insert rows whose ``unique`` value is new to the table; within the
    batch the first request wins.  Returns (table, rejected requests)."""
    ok = valid_rows(rows, required)
    cand = rows.where(ok)
    first = first_per(cand, unique, order)
    new = first.join(table.select(*unique), on=list(unique), how="left_anti")
    rejected = rows.join(new.select(order), on=order, how="left_anti")
    return table.unionByName(new.select(*table.columns)), rejected


def _cut(df: DataFrame) -> DataFrame:
    """The state of a round is written, so later rounds repeat nothing of it."""
    return written(df, "requests")


def _other_holder(holders: DataFrame, requests: DataFrame, value: str, key: str, nxt: str) -> DataFrame:
    """Per request (``key``, ``value``): ``__other``, the latest ``nxt`` among the holders
    of its value with another key (null: nobody else holds it)."""
    latest = holders.groupBy(value, key).agg(F.max(nxt).alias(nxt))
    top = latest.groupBy(value).agg(F.max(F.struct(nxt, key)).alias("__top"))
    second = (latest.join(top, on=value).where(F.col(key) != F.col(f"__top.{key}"))
              .groupBy(value).agg(F.max(nxt).alias("__second")))
    both = top.join(second, on=value, how="left")
    mine = F.col(f"__top.{key}") == F.col(key)
    return (requests.join(both, on=value, how="left")
            .withColumn("__other", F.when(mine, F.col("__second")).otherwise(F.col(f"__top.{nxt}")))
            .drop("__top", "__second"))


def decide_in_order(table: DataFrame, changes: DataFrame, key: str, unique: Sequence[str], order: str) -> DataFrame:
    """The outcome of changing ``unique`` values one request after the other:
    ``changes`` whose key is stored, with ``accepted``.

    A request is accepted if, at its turn, no other row holds its value; the value its
    row held before is free from then on. Rounds decide all requests whose outcome no
    open request can change any more:

    * rejected, if another row holds the value and that row has no open request before
      this one (it still holds it at this one's turn);
    * accepted, if no other row holds the value and no earlier open request asks for
      it, and all earlier requests of the row are decided.

    The first open request is always decided, a value that thousands ask for is
    decided in one round per accepted change, and every step is an aggregate or a join
    on keys or values. ``order`` must be unique; a request with a null in ``unique``
    conflicts with nothing.
    """
    value = F.when(valid_value(unique), F.struct(*unique))
    stored = _cut(table.select(key, value.alias("__v")))
    todo = _cut(changes.join(table.select(key), on=key, how="left_semi")
                .select(F.col(order).alias("__no"), key, value.alias("__v")))
    done = None
    while not todo.isEmpty():
        first = todo.groupBy(key).agg(F.min("__no").alias("__next"))
        # a row without an open request holds its value for good
        held = (stored.where("__v is not null").join(first, on=key, how="left")
                .withColumn("__next", F.struct(F.col("__next").isNull().alias("forever"), F.col("__next").alias("no"))))
        asked = todo.groupBy("__v").agg(F.min("__no").alias("__first"))
        r = _other_holder(held, todo, "__v", key, "__next").join(asked, on="__v", how="left").join(first, on=key)
        free = F.col("__other").isNull()
        stays = ~free & (F.col("__other.forever") | (F.col("__other.no") > F.col("__no")))
        turn = (F.col("__no") == F.col("__next")) & (F.col("__v").isNull() | (F.col("__no") == F.col("__first")))
        verdict = F.when(stays, F.lit(False)).when(free & turn, F.lit(True))
        r = _cut(r.select("__no", key, "__v", verdict.alias("accepted")))
        decided = r.where("accepted is not null").select("__no", "accepted")
        done = _cut(decided if done is None else done.unionByName(decided))
        # at most one request of a row is accepted in a round: its first open one
        moved = r.where("accepted").select(key, F.col("__v").alias("__to"), F.lit(True).alias("__moved"))
        stored = _cut(stored.join(moved, on=key, how="left")
                      .select(key, F.when(F.col("__moved"), F.col("__to")).otherwise(F.col("__v")).alias("__v")))
        todo = _cut(r.where("accepted is null").drop("accepted"))
    if done is None:
        return changes.where("false").withColumn("accepted", F.lit(True))
    return changes.join(done.withColumnRenamed("__no", order), on=order).select(*changes.columns, "accepted")


def valid_value(unique: Sequence[str]) -> Column:
    """No part of the value is null (a null equals nothing)."""
    ok = F.lit(True)
    for u in unique:
        ok = ok & F.col(u).isNotNull()
    return ok


def update_if_unique(table: DataFrame, changes: DataFrame, key: str, unique: Sequence[str], columns: Sequence[str],
                     order: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """T5: update rows to new ``unique`` values, one request after the other (see
    ``decide_in_order``).  Returns (table, rejected, unmatched, accepted): every
    change is in exactly one of the last three; of several accepted changes of a row
    the last one is what the table holds."""
    outcome = decide_in_order(table, changes, key, unique, order)
    accepted = outcome.where("accepted").select(*changes.columns)
    rejected = outcome.where("not accepted").select(*changes.columns)
    unmatched = changes.join(table.select(key), on=key, how="left_anti").select(*changes.columns)
    updated, _ = update_by_key(table, accepted, key, columns, order=order)
    return updated, rejected, unmatched, accepted


LOG_BLOCK = 4096


def apply_log(table: DataFrame, log: DataFrame, key: str, order: str, op: str = "op") -> tuple[DataFrame, DataFrame]:
    """T1-T3 as they arrive: a log of inserts, updates and deletes applied in ``order``
    (whole numbers, unique).  Returns (table, rejected log rows).

    An insert of a stored key and an update or delete of a missing one are rejected. A
    row exists before a request if the last insert or delete before it was an insert
    -- whether or not that was accepted -- or, without one, if it was stored. So the
    log is a fold that is cut into blocks of LOG_BLOCK requests: the last insert or
    delete inside the block by a window over (key, block), of earlier blocks by a
    window over the blocks' last ones. A key with a third of the log is spread over
    its blocks. A row's contents are those of its last accepted insert or update: the
    log holds all columns of the table.
    """
    cols = [c for c in table.columns if c != key]
    rows = log.withColumn("__block", F.expr(f"`{order}` div {LOG_BLOCK}"))
    sets = F.when(F.col(op) != "update", F.col(op))
    blocks = rows.groupBy(key, "__block").agg(F.max_by(sets, F.when(sets.isNotNull(), F.col(order))).alias("__sets"))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    stored = table.select(key, F.lit(True).alias("__stored"))
    blocks = (blocks.withColumn("__carry", F.last("__sets", ignorenulls=True).over(earlier))
              .join(stored, on=key, how="left").drop("__sets"))
    inside = (Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = (rows.withColumn("__inside", F.last(sets, ignorenulls=True).over(inside))
            .join(blocks, on=[key, "__block"]))
    last = F.coalesce("__inside", "__carry")
    exists = F.when(last.isNotNull(), last == "insert").otherwise(F.coalesce("__stored", F.lit(False)))
    rows = rows.withColumn("__ok", F.when(F.col(op) == "insert", ~exists).otherwise(exists))
    rejected = rows.where(~F.col("__ok")).select(*log.columns)
    kept = F.col("__ok") & (F.col(op) != "delete")
    end = rows.groupBy(key).agg(
        F.max_by(sets, F.when(sets.isNotNull(), F.col(order))).alias("__last"),
        F.max_by(F.when(kept, F.struct(*cols)), F.when(kept, F.col(order))).alias("__row"))
    j = table.withColumn("__stored", F.lit(True)).join(end, on=key, how="full_outer")
    there = F.when(F.col("__last").isNotNull(), F.col("__last") == "insert").otherwise(F.coalesce("__stored", F.lit(False)))
    pick = [F.when(F.col("__row").isNotNull(), F.col("__row").getField(c)).otherwise(F.col(c)).alias(c) for c in cols]
    out = j.where(there).select(key, *pick).select(*table.columns)
    return out, rejected


def new_id(prefix: str, *parts: Column) -> Column:
    """Deterministic surrogate key: prefix + md5 of the natural key."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", *parts)))


def get_or_create_dim(dim: DataFrame, names: DataFrame, id_col: str, name_col: str,
                      prefix: str = "T") -> DataFrame:
    """T6: the dimension plus an entry for every requested name it lacks."""
    existing = dim.select(F.col(id_col).cast("string").alias(id_col), name_col)
    new = (names.select(name_col).where(F.col(name_col).isNotNull()).distinct()
           .join(existing.select(name_col), on=name_col, how="left_anti")
           .select(new_id(prefix, F.col(name_col)).alias(id_col), name_col))
    return existing.unionByName(new)


MACHINE_FIELDS = ("machine_id", "machine_name", "machine_plant", "machine_model", "machine_customer",
                  "machine_location", "machine_longitude", "machine_latitude", "machine_type_id")


def update_guarded(machines: DataFrame, parts: DataFrame, types: DataFrame, changes: DataFrame,
                   order: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """T7: update machines whose uid *and* owner match the change, resolving
    type names through T6; a given image is copied to all parts of each
    updated machine.  Of several requests for a machine the last one counts.
    Returns (machines, parts, types, rejected requests)."""
    ok = valid_rows(changes, ["machine_uid", "company_id"])
    m = machines.withColumn("machine_type_id", F.col("machine_type_id").cast("string"))
    guard = ["machine_uid", "company_id"]
    hits = changes.where(ok).join(m.select(*guard), on=guard, how="left_semi")
    rejected = (changes.where(~ok)
                .unionByName(changes.where(ok).join(m.select(*guard), on=guard, how="left_anti")))
    hits = last_per(hits.select(*changes.columns), guard, order)
    types2 = get_or_create_dim(types, changes.where(ok), "machine_type_id", "machine_type_name")
    resolved = hits.join(types2, on="machine_type_name", how="left")
    updated, _ = update_by_key(m, resolved, guard, MACHINE_FIELDS)
    images = (hits.where(F.col("machine_image").isNotNull())
              .select(F.col("machine_uid").alias("machine_id"),
                      F.col("machine_image").alias("machine_image_path")))
    parts2, _ = update_by_key(parts, images, "machine_id", ["machine_image_path"])
    return updated, parts2, types2, rejected


def add_machine(machines: DataFrame, parts: DataFrame, types: DataFrame,
                requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T1 for machines: the type is found or created, the machine gets a
    generated uid, and an image makes a part row.  Returns (machines, parts,
    types)."""
    new = requests.where(valid_rows(requests, ["machine_id", "machine_name", "company_id"]))
    types2 = get_or_create_dim(types, new, "machine_type_id", "machine_type_name")
    new = (new.join(types2, on="machine_type_name", how="left")
           .withColumn("machine_uid", new_id("M", F.col("company_id"), F.col("machine_id"))))
    m = machines.withColumn("machine_type_id", F.col("machine_type_id").cast("string"))
    images = new.where(F.col("machine_image").isNotNull() & (F.col("machine_image") != "")).select(
        new_id("P", F.col("machine_uid")).alias("machine_part_id"), F.col("machine_uid").alias("machine_id"),
        F.col("machine_image").alias("machine_image_path"))
    parts = parts.withColumn("machine_part_id", F.col("machine_part_id").cast("string"))
    return m.unionByName(new.select(*m.columns)), parts.unionByName(images.select(*parts.columns)), types2


def reconcile_set(table: DataFrame, desired: DataFrame, scope: DataFrame, group: str = "machine_id",
                  member: str = "operator_name", id_col: str = "operator_id",
                  prefix: str = "O") -> tuple[DataFrame, DataFrame]:
    """T8: make the members of each group in ``scope`` equal the desired list
    (an empty one if it has no rows): insert the missing ones, delete the
    extra ones, keep the rest.  Other groups are untouched.  Returns (table,
    per-group counts)."""
    scope = scope.select(group).distinct()
    want = desired.dropDuplicates([group, member]).join(scope, on=group, how="left_semi")
    current = table.join(scope, on=group, how="left_semi")
    to_add = (want.join(current.select(group, member), on=[group, member], how="left_anti")
              .select(new_id(prefix, F.col(group), F.col(member)).alias(id_col),
                      *[c for c in table.columns if c != id_col]))
    to_del = current.join(want.select(group, member), on=[group, member], how="left_anti")
    kept = table.join(to_del.select(id_col), on=id_col, how="left_anti")
    result = kept.unionByName(to_add.select(*table.columns))
    counts = (scope.join(to_add.groupBy(group).agg(F.count(F.lit(1)).alias("added")), on=group, how="left")
              .join(to_del.groupBy(group).agg(F.count(F.lit(1)).alias("deleted")), on=group, how="left")
              .select(group, F.coalesce(F.col("added"), F.lit(0)).alias("added"),
                      F.coalesce(F.col("deleted"), F.lit(0)).alias("deleted")))
    return result, counts
