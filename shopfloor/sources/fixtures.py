"""Mapping of the driver's parquet tables onto the telemetry data model.

The given tables hold no machine telemetry, so each model table is a
projection of a driver table (FIXTURES.md §2).  Every expression is plain
SQL that Spark and DuckDB evaluate identically, so the same text builds the
Spark sources here and the oracle's CTEs in ``shopfloor.oracle``.
No mapping caps rows: dimension tables grow with the driver tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Derived:
    """``SELECT <columns> FROM <source> [WHERE <where>]``."""

    source: str
    columns: tuple[tuple[str, str], ...]
    where: str | None = None
    group_by: str | None = None


@dataclass(frozen=True)
class Literal:
    """A small configuration table given as rows (all values SQL literals)."""

    columns: tuple[tuple[str, str], ...]  # (name, spark/duckdb type)
    rows: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class TableSpec:
    name: str
    parts: tuple = field(default_factory=tuple)  # Derived / Literal, unioned


_PAYLOAD = (
    "concat('{', "
    "case when event_id % 50 = 7 then '' else concat('\"MC_STATUS\":', "
    "case when event_type = 'error' then '0' else '1' end, ',') end, "
    "'\"Act Speed\":', case when event_type = 'signup' then '0' "
    "else cast(cast(value as decimal(10,2)) as string) end, "
    "',\"Target Speed\":100', "
    "case when event_id % 20 = 3 then '' else concat(',\"LINE_SPEED\":', "
    "cast(cast(value as decimal(10,2)) as string), ',\"ACT_COLD_DIA\":', "
    "cast(cast(3.10 + 0.80 * (event_id % 4) as decimal(6,2)) as string)) end, "
    "',\"This Month Production\":', cast(event_id * 10 as string), "
    "',\"P_DT_BOBIN_FORMER_CHANGE\":\"', "
    "case when event_type = 'purchase' then '1' else '0' end, '\"', "
    "case when event_id % 5 = 0 then '' else concat(',\"E_DT_6\":', "
    "case when event_id % 3 = 0 then '1' else '0' end) end, "
    "',\"M_DT_7\":', case when event_id % 7 < 2 then '1' else '0' end, '}')"
)

_S = "string"

# The configuration rows of FIXTURES.md §2 (literal tables).
_ALARM_ROWS = (
    ("'E_DT_6'", "'Emergency stop'"),
    ("'M_DT_7'", "'Motor trip'"),
    ("'P_DT_BOBIN_FORMER_CHANGE'", "'Bobbin change'"),
    ("'O_DT_9'", "'Never sent'"),
)
_SHIFT_ROWS = (
    ("'s1'", "'Morning'", "'06:00 AM'", "'02:00 PM'", "'Mon,Tue,Wed,Thu,Fri'", "'0'", "'1'"),
    ("'s2'", "'Evening'", "'02:00 PM'", "'10:00 PM'", "'Mon,Tue,Wed,Thu,Fri,Sat'", "'1'", "'1'"),
    ("'s3'", "'Night'", "'10:00 PM'", "'06:00 AM'", "'Mon,Wed'", "'2'", "'1'"),
)
_HOLIDAY_ROWS = (
    ("'h1'", "'Republic Day'", "'2024-01-26'", "NULL", "NULL", "'1'"),
    ("'h2'", "'Plant day'", "'2024-01-15T00:00:00.000Z'", "NULL", "NULL", "'1'"),
    ("'h3'", "'Other'", "'2024-01-10'", "NULL", "NULL", "'2'"),
)
_RULE_ROWS = (
    ("'n1'", "'High speed'", "'M1'", "'{\"key\":\"Act Speed\",\"op\":\">\",\"value\":90}'"),
    ("'n2'", "'Stopped'", "'M4'", "'{\"key\":\"MC_STATUS\",\"op\":\"=\",\"value\":0}'"),
)

SPECS: dict[str, TableSpec] = {
    "device_data": TableSpec("device_data", (Derived("events", (
        ("deviceuid", "cast(user_id as string)"),
        ("timestamp", "ts"),
        ("data", _PAYLOAD),
    )),)),
    "machine": TableSpec("machine", (Derived("customer", (
        ("machine_uid", "concat('M', cast(c_custkey as string))"),
        ("machine_id", "cast(c_custkey as string)"),
        ("machine_name", "c_name"),
        ("machine_plant", "c_mktsegment"),
        ("machine_model", "concat('X', cast(c_nationkey as string))"),
        ("machine_customer", "c_name"),
        ("machine_location", "concat('Site ', cast(c_nationkey as string))"),
        ("machine_longitude", "cast(c_nationkey as double)"),
        ("machine_latitude", "cast(c_custkey as double)"),
        ("machine_type_id", "cast(c_nationkey % 5 as int)"),
        ("company_id", "cast(c_custkey % 3 as string)"),
    )),)),
    "machine_type": TableSpec("machine_type", (Derived("region", (
        ("machine_type_id", "r_regionkey"),
        ("machine_type_name", "r_name"),
    )),)),
    "machine_parts": TableSpec("machine_parts", (Derived("part", (
        ("machine_part_id", "p_partkey"),
        ("machine_id", "concat('M', cast(p_partkey % 11 as string))"),
        ("machine_image_path", "concat('img/', p_brand, '.png')"),
    )),)),
    "operators": TableSpec("operators", (Derived("supplier", (
        ("operator_id", "concat('O', cast(s_suppkey as string))"),
        ("operator_name", "s_name"),
        ("machine_id", "concat('M', cast(s_suppkey % 12 as string))"),
        ("created_by", "cast(s_nationkey as string)"),
        ("company_id", "cast(s_suppkey % 3 as string)"),
    )),)),
    "user_info": TableSpec("user_info", (Derived("customer", (
        ("user_id", "cast(c_custkey as string)"),
        ("first_name", "c_name"),
        ("last_name", "c_mktsegment"),
        ("personal_email", "concat('user', cast(c_custkey as string), '@example.com')"),
        ("designation", "'Engineer'"),
        ("company_id", "cast(c_custkey % 4 as string)"),
        ("verified", "cast(c_custkey % 2 as int)"),
        ("block", "cast(0 as int)"),
    )),)),
    "company_info": TableSpec("company_info", (Derived("nation", (
        ("company_id", "cast(n_nationkey as string)"),
        ("company_name", "n_name"),
        ("company_email", "concat('info', cast(n_nationkey as string), '@example.com')"),
        ("contact_no", "concat('000', cast(n_nationkey as string))"),
        ("location", "concat('Region ', cast(n_regionkey as string))"),
    )),)),
    "alarms": TableSpec("alarms", (Literal(
        (("alarm_code", _S), ("alarm_description", _S)), _ALARM_ROWS),)),
    # The configured shifts of tenant 1 plus a four-hour shift per region, dealt
    # over the tenants that own machines.
    "shifts": TableSpec("shifts", (
        Literal((("shift_id", _S), ("shift_name", _S), ("start_time", _S), ("end_time", _S),
                 ("shift_days", _S), ("created_by", _S), ("company_id", _S)), _SHIFT_ROWS),
        Derived("region", (
            ("shift_id", "concat('r', cast(r_regionkey as string))"),
            ("shift_name", "concat('Line ', r_name)"),
            ("start_time", "case r_regionkey when 0 then '06:00 AM' when 1 then '08:00 AM' when 2 then '10:00 AM' "
                           "when 3 then '12:00 PM' else '02:00 PM' end"),
            ("end_time", "case r_regionkey when 0 then '10:00 AM' when 1 then '12:00 PM' when 2 then '02:00 PM' "
                         "when 3 then '04:00 PM' else '06:00 PM' end"),
            ("shift_days", "case when r_regionkey % 2 = 0 then 'Mon,Wed,Fri,Sun' else 'Tue,Thu,Sat' end"),
            ("created_by", "cast(r_regionkey as string)"),
            ("company_id", "cast(r_regionkey % 3 as string)"),
        )))),
    # The configured holidays plus, for the tenants that own machines, one per
    # nation (a day of January 2024), and for tenants 3-5 one per day with an
    # order (ids are unique per day and tenant), from the whole order table.
    "holidays": TableSpec("holidays", (
        Literal((("holiday_id", _S), ("holiday_name", _S), ("holiday_date", _S),
                 ("holiday_image", _S), ("created_by", _S), ("company_id", _S)),
                _HOLIDAY_ROWS),
        Derived("nation", (
            ("holiday_id", "concat('n', cast(n_nationkey as string))"),
            ("holiday_name", "n_name"),
            ("holiday_date", "cast(cast('2024-01-02' as date) + cast(n_nationkey as int) as string)"),
            ("holiday_image", "cast(NULL as string)"),
            ("created_by", "cast(n_regionkey as string)"),
            ("company_id", "cast(n_nationkey % 3 as string)"),
        )),
        Derived("orders", (
            ("holiday_id", "concat('o', cast(min(o_orderkey) as string))"),
            ("holiday_name", "min(o_orderpriority)"),
            ("holiday_date", "cast(cast(o_orderdate as date) as string)"),
            ("holiday_image", "cast(NULL as string)"),
            ("created_by", "cast(min(o_custkey) as string)"),
            ("company_id", "cast(3 + o_custkey % 3 as string)"),
        ), None, "cast(o_orderdate as date), o_custkey % 3"),
    )),
    # The configured rules plus one stored rule per machine.
    "notification_configuration": TableSpec("notification_configuration", (
        Literal((("config_id", _S), ("warning_name", _S), ("machine_id", _S),
                 ("parameters", _S)), _RULE_ROWS),
        Derived("customer", (
            ("config_id", "concat('nc', cast(c_custkey as string))"),
            ("warning_name", "'Slow line'"),
            ("machine_id", "concat('M', cast(c_custkey as string))"),
            ("parameters", "concat('{\"key\":\"LINE_SPEED\",\"op\":\"<\",\"value\":', "
                           "cast(c_nationkey as string), '}')"),
        )),
    )),
}


def _literal_sql(lit: Literal) -> str:
    values = ", ".join("(" + ", ".join(r) + ")" for r in lit.rows)
    names = ", ".join(n for n, _ in lit.columns)
    cols = ", ".join(f"cast({n} as {t}) as {n}" for n, t in lit.columns)
    return f"SELECT {cols} FROM (VALUES {values}) AS v({names})"


def _derived_sql(d: Derived) -> str:
    cols = ", ".join(f"{expr} AS {name}" for name, expr in d.columns)
    src = d.source.removeprefix("model:")
    where = f" WHERE {d.where}" if d.where else ""
    group = f" GROUP BY {d.group_by}" if d.group_by else ""
    return f"SELECT {cols} FROM {src}{where}{group}"


def _spec(name: str) -> TableSpec:
    return SPECS[name] if name in SPECS else CHANGES[name]


def table_sql(name: str) -> str:
    """SQL text of a model table / change set over the driver's table names
    (change sets over ``model:`` tables refer to those tables' CTE names)."""
    parts = []
    for p in _spec(name).parts:
        parts.append(_literal_sql(p) if isinstance(p, Literal) else _derived_sql(p))
    return " UNION ALL ".join(parts)


class Tables:
    """Lazily built model tables over one driver data directory.

    ``store`` names a telemetry store written by ``telemetry.ingest``; without
    one, queries parse the readings they need in their own plan.  ``rollup`` is
    the folder of a rollup of minutes (``sources.rollup``), from which the
    metrics over minutes are answered without reading telemetry.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: str | None = None, rollup: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.store = store
        self.rollup = rollup
        self._cache: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in SPECS and name not in CHANGES):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._build(_spec(name))
        return self._cache[name]

    def _build(self, spec: TableSpec) -> DataFrame:
        out = None
        for p in spec.parts:
            if isinstance(p, Literal):
                df = self.spark.sql(_literal_sql(p))
            else:
                if p.source.startswith("model:"):
                    src = getattr(self, p.source.removeprefix("model:"))
                else:
                    src = self.source(p.source)
                if p.where:
                    src = src.where(p.where)
                if p.group_by:
                    df = self.spark.sql(_derived_sql(replace(p, source="{src}", where=None)), src=src)
                else:
                    df = src.selectExpr(*[f"{expr} AS `{name}`" for name, expr in p.columns])
            out = df if out is None else out.unionByName(df)
        return out


# --------------------------------------------------------------------------
# Change sets for the batch maintenance operators (T1-T8), derived from the
# driver tables (or from model tables built on them) so they grow with the
# data.  ``source`` names a driver table or, when prefixed with ``model:``,
# a model table above.
# --------------------------------------------------------------------------

_REQUEST_COLUMNS = (
    ("request_id", "concat('R', cast(o_orderkey as string))"),
    ("request_subject", "o_orderpriority"),
    ("division", "case when o_orderstatus = 'P' then '' else o_orderstatus end"),
    ("product_family", "'Wire drawing'"),
    ("machine_brand", "case when o_totalprice > 450000 then cast(NULL as string) else 'X' end"),
    ("type_of_request", "case when o_totalprice > 200000 then 'Service' else 'Spare parts' end"),
    ("description", "case when o_orderpriority = '5-LOW' then cast(NULL as string) "
                    "else concat('Order ', cast(o_orderkey as string)) end"),
    ("created_by", "cast(o_custkey as string)"),
    ("machine_uid", "concat('M', cast(o_custkey as string))"),
    ("request_status", "cast(0 as int)"),
)

CHANGES: dict[str, TableSpec] = {
    # Support requests already stored (orders before 1995) and a new batch.
    "customer_support": TableSpec("customer_support", (
        Derived("orders", _REQUEST_COLUMNS, "o_orderdate < cast('1995-01-01' as timestamp)"),)),
    "support_requests": TableSpec("support_requests", (
        Derived("orders", _REQUEST_COLUMNS, "o_orderdate >= cast('1995-01-01' as timestamp)"),)),
    # Profile edits: one per building-segment customer, plus edits of users
    # that do not exist (reported as unmatched).
    "user_edits": TableSpec("user_edits", (
        Derived("customer", (
            ("request_no", "c_custkey"),
            ("user_id", "cast(c_custkey as string)"),
            ("first_name", "upper(c_name)"),
            ("last_name", "lower(c_mktsegment)"),
            ("designation", "case when c_acctbal > 5000 then 'Manager' else cast(NULL as string) end"),
        ), "c_mktsegment = 'BUILDING'"),
        Derived("supplier", (
            ("request_no", "-s_suppkey"),
            ("user_id", "concat('x', cast(s_suppkey as string))"),
            ("first_name", "s_name"),
            ("last_name", "'ghost'"),
            ("designation", "'Nobody'"),
        )),
    )),
    # Operators of suppliers in debt are removed.
    "operator_deletes": TableSpec("operator_deletes", (
        Derived("supplier", (("operator_id", "concat('O', cast(s_suppkey as string))"),),
                "s_acctbal < 0"),)),
    # A log of mixed requests on operators: a third of it on one operator.
    "operator_log": TableSpec("operator_log", (
        Derived("orders", (
            ("request_no", "o_orderkey"),
            ("op", "case when o_orderpriority = '1-URGENT' then 'insert' when o_orderpriority = '2-HIGH' then 'delete' "
                   "else 'update' end"),
            ("operator_id", "concat('O', cast(case when o_orderkey % 3 = 0 then 1 else o_custkey % 400 end as string))"),
            ("operator_name", "concat('Order ', cast(o_orderkey as string))"),
            ("machine_id", "concat('M', cast(o_custkey as string))"),
            ("created_by", "o_orderstatus"),
            ("company_id", "cast(o_custkey % 3 as string)"),
        )),)),
    # Holiday requests for tenants 3-5; some collide with stored holidays.
    "holiday_requests": TableSpec("holiday_requests", (
        Derived("orders", (
            ("request_no", "o_orderkey"),
            ("holiday_id", "concat('q', cast(o_orderkey as string))"),
            ("holiday_name", "'Requested'"),
            ("holiday_date", "cast(cast(o_orderdate as date) as string)"),
            ("holiday_image", "cast(NULL as string)"),
            ("created_by", "cast(o_custkey as string)"),
            ("company_id", "cast(3 + o_custkey % 3 as string)"),
        ), "o_orderpriority = '2-HIGH'"),)),
    # Every stored holiday of tenant 4 asks to move one day later (most of those
    # days are taken), then to a far day, then again to the next day, by now free.
    "holiday_moves": TableSpec("holiday_moves", (
        *(Derived("model:holidays", (
            ("request_no", f"concat('{wave}', holiday_date)"),
            ("holiday_id", "holiday_id"),
            ("holiday_name", f"concat(holiday_name, ' ({wave})')"),
            ("holiday_date", f"cast(cast(cast(holiday_date as date) + interval {days} day as date) as string)"),
            ("holiday_image", "cast(NULL as string)"),
            ("created_by", "created_by"),
            ("company_id", "company_id"),
        ), "company_id = '4'") for wave, days in (("y", 4000), ("z", 1))),
        Derived("model:holidays", (
            ("request_no", "holiday_date"),
            ("holiday_id", "holiday_id"),
            ("holiday_name", "concat(holiday_name, ' (moved)')"),
            ("holiday_date", "cast(cast(cast(holiday_date as date) + interval 1 day as date) as string)"),
            ("holiday_image", "cast(NULL as string)"),
            ("created_by", "created_by"),
            ("company_id", "company_id"),
        ), "company_id = '4'"),
        # ... and a holiday that does not exist is asked to move.
        Derived("nation", (
            ("request_no", "n_name"),
            ("holiday_id", "concat('none', cast(n_nationkey as string))"),
            ("holiday_name", "n_name"),
            ("holiday_date", "'2031-01-01'"),
            ("holiday_image", "cast(NULL as string)"),
            ("created_by", "'0'"),
            ("company_id", "'4'"),
        )))),
    # Machine type names requested by new or edited machines.
    "type_requests": TableSpec("type_requests", (
        Derived("part", (("machine_type_name", "p_type"),)),)),
    # Edits of automobile-segment machines; odd nations name the wrong owner
    # (the guard rejects them); an image, when given, cascades to the parts.
    "machine_updates": TableSpec("machine_updates", (
        Derived("customer", (
            ("request_no", "c_custkey"),
            ("machine_uid", "concat('M', cast(c_custkey as string))"),
            ("machine_id", "cast(c_custkey as string)"),
            ("machine_name", "lower(c_name)"),
            ("machine_plant", "'AUTOMOBILE'"),
            ("machine_model", "concat('Y', cast(c_nationkey as string))"),
            ("machine_customer", "c_name"),
            ("machine_location", "concat('Site ', cast(c_nationkey as string))"),
            ("machine_longitude", "cast(c_nationkey as double)"),
            ("machine_latitude", "cast(c_custkey as double)"),
            ("machine_type_name", "case when c_nationkey % 2 = 0 then 'ASIA' "
                                  "else concat('Type ', cast(c_nationkey as string)) end"),
            ("company_id", "cast((c_custkey + c_nationkey % 2) % 3 as string)"),
            ("machine_image", "case when c_acctbal > 0 then concat('img/upd/', cast(c_custkey as string), '.png') "
                              "else cast(NULL as string) end"),
        ), "c_mktsegment = 'AUTOMOBILE'"),)),
    # Machines whose operator list is replaced (one of them by an empty list).
    "operator_machines": TableSpec("operator_machines", (
        Derived("supplier", (("machine_id", "concat('M', cast(s_suppkey % 13 as string))"),),
        None, "s_suppkey % 13"),)),
    # Desired operator lists per machine: suppliers not in debt, plus one
    # trainee per nation.
    "operator_roster": TableSpec("operator_roster", (
        Derived("supplier", (
            ("machine_id", "concat('M', cast(s_suppkey % 12 as string))"),
            ("operator_name", "s_name"),
            ("created_by", "cast(s_nationkey as string)"),
            ("company_id", "cast(s_suppkey % 3 as string)"),
        ), "s_acctbal >= 0"),
        Derived("nation", (
            ("machine_id", "concat('M', cast(n_nationkey % 12 as string))"),
            ("operator_name", "concat('Trainee ', n_name)"),
            ("created_by", "'0'"),
            ("company_id", "cast(n_nationkey % 3 as string)"),
        )),
    )),
}
