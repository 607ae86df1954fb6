"""The telemetry base frame: one JSON parse, typed columns, key-existence flags.

``device_data(deviceuid, timestamp, data)`` stores each reading as a JSON
object whose keys may be missing.  The reference re-parses the text in every
CTE (``data->>'KEY'``, ``data::jsonb ? 'KEY'``); here the payload is parsed
once per row and query into a ``VARIANT`` (Spark's binary semi-structured encoding) and
every value is read from it by path.  A filter on a parsed value would be pushed
below that projection and parse again, so queries count and choose by
conditional aggregates instead.  A missing key is SQL NULL while a JSON
``null`` is a non-null variant, so key existence (``has_*``) stays exact and
separate from the value.

Metrics over arbitrary keys (alarm codes come from a table) use
``payload_map``: the whole object as ``map<string,string>``, cast from the
same variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopfloor.functions.timefmt import trunc_ntz
from shopfloor.params import DEFAULT, Params

# The payload keys the metrics read (spelling as sent by the
# machines, including the spaces).
MC_STATUS = "MC_STATUS"
ACT_SPEED = "Act Speed"
TARGET_SPEED = "Target Speed"
LINE_SPEED = "LINE_SPEED"
COLD_DIA = "ACT_COLD_DIA"
MONTH_PRODUCTION = "This Month Production"
BOBBIN_CHANGE = "P_DT_BOBIN_FORMER_CHANGE"

MAP_TYPE = "map<string,string>"

# Time bucket that splits device sequences (see plans.neighbors) and the
# bucketing key of the typed store together with the device.
SEQ_UNIT = DEFAULT.sequence_bucket


def _within(df: DataFrame, params: Params, ts: str) -> DataFrame:
    """Closed time range (``BETWEEN``; an open end does not filter) plus the
    optional device filter."""
    if params.start is not None:
        df = df.where(F.col(ts) >= F.to_timestamp_ntz(F.lit(params.start)))
    if params.end is not None:
        df = df.where(F.col(ts) <= F.to_timestamp_ntz(F.lit(params.end)))
    if params.device is not None:
        df = df.where(F.col("deviceuid") == F.lit(params.device))
    return df


def in_range(device_data: DataFrame, params: Params) -> DataFrame:
    """The request's raw readings.  The range is a predicate on the raw
    timestamp column, so it reaches the Parquet scan (and date-partition
    pruning when the table is partitioned)."""
    return _within(device_data, params, "timestamp")


def _path(key: str) -> str:
    """Variant path of a top-level key (bracket form: keys may hold spaces)."""
    if '"' in key:
        raise ValueError(f"unsupported payload key {key!r}")
    return '$["' + key + '"]'


def value(key: str) -> Column:
    """``data->>'key'``: the text value, NULL when missing or JSON null."""
    return F.variant_get(F.col("payload"), _path(key), "string")


def has(key: str) -> Column:
    """``data::jsonb ? 'key'`` (true for a JSON null value too)."""
    return F.variant_get(F.col("payload"), _path(key), "variant").isNotNull()


def parse(device_data: DataFrame) -> DataFrame:
    """Parse the payload once; the typed columns are derived lazily from it.

    Column pruning drops whatever a query does not reference, and the
    ``payload`` column is materialised by one projection so the JSON text is
    read once per row.
    """
    return device_data.select(
        F.col("deviceuid"),
        F.col("timestamp").alias("ts"),
        F.parse_json(F.col("data")).alias("payload"),
    )


def rejected(device_data: DataFrame) -> DataFrame:
    """Readings whose payload is not JSON; queries over raw telemetry fail on
    them, ``ingest`` keeps them apart from the store."""
    return device_data.where(F.col("data").isNotNull() & F.try_parse_json(F.col("data")).isNull())


def payload_map(device_data: DataFrame) -> DataFrame:
    """Whole payload as ``map<string,string>`` (JSON null -> NULL value)."""
    return parse(device_data).select("deviceuid", "ts", F.col("payload").cast(MAP_TYPE).alias("payload_map"))


def _flags_and_texts(parsed: DataFrame) -> DataFrame:
    """What a reading says, uncast: key-existence flags, text values, the map."""
    stored = "seq_bucket" in parsed.columns
    return parsed.select(
        "deviceuid", "ts",
        F.col("seq_bucket") if stored else trunc_ntz(SEQ_UNIT, F.col("ts")).alias("seq_bucket"),
        *[has(key).alias(name) for name, key in FLAGS.items()],
        *[value(key).alias(name) for name, key in TEXTS.items()],
        F.col("payload").cast(MAP_TYPE).alias("payload_map"),
    )


FLAGS = {"has_mc": MC_STATUS, "has_line_speed": LINE_SPEED, "has_diameter": COLD_DIA,
         "has_month_production": MONTH_PRODUCTION, "has_bobbin": BOBBIN_CHANGE}
TEXTS = {"mc_text": MC_STATUS, "act_speed_text": ACT_SPEED, "target_speed_text": TARGET_SPEED,
         "line_speed_text": LINE_SPEED, "diameter_text": COLD_DIA, "month_production_text": MONTH_PRODUCTION,
         "bobbin": BOBBIN_CHANGE}
NUMBERS = {"mc_status": "mc_text", "act_speed": "act_speed_text", "target_speed": "target_speed_text",
           "line_speed": "line_speed_text", "diameter": "diameter_text",
           "month_production": "month_production_text"}
STORED_COLUMNS = ("deviceuid", "ts", "seq_bucket", "payload")
TYPED_COLUMNS = ("deviceuid", "ts", "seq_bucket", *FLAGS, "mc_text", "bobbin", *NUMBERS, "payload_map")


def _numbers(df: DataFrame) -> DataFrame:
    """Casts happen here, in the query: a value that is not a number fails the
    queries that read its key and no others."""
    return df.withColumns({n: F.col(text).cast("double") for n, text in NUMBERS.items()})


def typed(parsed: DataFrame) -> DataFrame:
    """Typed view of the metric keys (only referenced columns survive pruning)."""
    return _numbers(_flags_and_texts(parsed)).select(*TYPED_COLUMNS)


# --------------------------------------------------------------------------
# Parse-once store
# --------------------------------------------------------------------------

def ingest(device_data: DataFrame, path: str, name: str, buckets: int, mode: str = "append") -> DataFrame:
    """Append a batch of readings to the store ``name`` at the shared ``path``
    and return the batch's rejected readings (payloads that are not JSON).

    Parquet partitioned by event month and bucketed by (device, sequence
    bucket), rows sorted by time inside each bucket file:

    * every window and minute-grain aggregate of the library is keyed by a
      superset of the bucket columns, so queries read the big side already
      co-located and never shuffle it; bucketing on the pair, not on the
      device alone, spreads a hot device over all buckets;
    * the payload is a VARIANT that Spark shreds into a Parquet column per key it
      finds in a file (keys that are rare or of mixed types stay in the residue), and
      a query's paths are pushed into the scan: ``availability`` reads the status
      alone, and keys that no query knew at ingest time still answer;
    * a time range prunes whole months by partition and row groups inside
      a month by the ``ts`` statistics (files are sorted by ``ts``).  Months,
      not days: with thousands of buckets, daily partitions would explode
      into millions of small files.

    Only the batch is shuffled.  All batches of a store need the same
    ``buckets`` (see ``bucket_count``).
    """
    good = device_data.where(F.col("data").isNull() | F.try_parse_json(F.col("data")).isNotNull())
    (parse(good).withColumn("seq_bucket", trunc_ntz(SEQ_UNIT, F.col("ts"))).select(*STORED_COLUMNS)
     .withColumn("event_month", F.trunc(F.col("ts"), "month"))
     .repartition(buckets, "deviceuid", "seq_bucket")
     .write.mode(mode).partitionBy("event_month")
     .bucketBy(buckets, "deviceuid", "seq_bucket").sortBy("ts")
     .option("path", path).saveAsTable(name))
    return rejected(device_data)


BYTES_PER_BUCKET = 256 * 1024 * 1024


def bucket_count(input_bytes: int, cores: int) -> int:
    """Buckets for a store of ``input_bytes``: about 256 MB each, at least one
    per core (every bucket is one scan task)."""
    return max(cores, -(-input_bytes // BYTES_PER_BUCKET))


def _store(tables) -> DataFrame | None:
    """The caller's store, read anew by every query, or None."""
    name = getattr(tables, "store", None)
    return tables.spark.table(name) if name else None


def typed_all(tables) -> DataFrame:
    """Typed telemetry over all time: the caller's store, or parsed in the plan."""
    st = _store(tables)
    return typed(parse(tables.device_data) if st is None else st)


def latest_ts(tables) -> Column:
    """Newest reading as a scalar subquery.  On the store the newest month is
    found first (a scan of the partition column), then ``max(ts)`` scans only
    that month (the partition filter is applied at run time); raw telemetry
    is read for its timestamps alone."""
    st = _store(tables)
    if st is None:
        return tables.device_data.select(F.max("timestamp")).scalar()
    month = st.select(F.max("event_month")).scalar()
    return st.where(F.col("event_month") == month).select(F.max("ts")).scalar()


def typed_since(tables, since: Column) -> DataFrame:
    """Typed telemetry with ``ts >= since``.  On the store the month
    partitions before ``since`` are skipped too (also when ``since`` is a
    scalar subquery: Spark evaluates such partition filters at run time)."""
    st = _store(tables)
    if st is None:
        return typed(parse(tables.device_data.where(F.col("timestamp") >= since)))
    return typed(st.where((F.col("event_month") >= F.trunc(since, "month")) & (F.col("ts") >= since)))


def bounds(tables, params: Params) -> tuple[Column, Column]:
    """Start and end of the request; where it gives none, the first and the
    newest reading of the whole fleet as scalar subqueries."""
    def of(text: str | None, member: str) -> Column:
        if text is not None:
            return F.to_timestamp_ntz(F.lit(text))
        st = _store(tables)
        rows, ts = (tables.device_data, "timestamp") if st is None else (st, "ts")
        both = rows.select(F.struct(F.min(ts).alias("first"), F.max(ts).alias("newest")).alias("both")).scalar()
        return both.getField(member)
    return of(params.start, "first"), of(params.end, "newest")


def typed_in_range(tables, params: Params) -> DataFrame:
    """Typed telemetry of the request range and device."""
    st = _store(tables)
    if st is None:
        return typed(parse(in_range(tables.device_data, params)))
    if params.start is not None:
        st = st.where(F.col("event_month") >= F.trunc(F.to_timestamp_ntz(F.lit(params.start)), "month"))
    if params.end is not None:
        st = st.where(F.col("event_month") <= F.trunc(F.to_timestamp_ntz(F.lit(params.end)), "month"))
    return typed(_within(st, params, "ts"))


def typed_in_days(tables, params: Params) -> DataFrame:
    """Typed telemetry of all days that the request range touches."""
    start = None if params.start is None else f"{params.start[:10]} 00:00:00"
    end = None if params.end is None else f"{params.end[:10]} 23:59:59.999999"
    return typed_in_range(tables, params.with_(start=start, end=end))
