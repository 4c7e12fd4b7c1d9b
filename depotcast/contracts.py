"""Declared schemas of the logical inputs and the checks made where data enters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING, _LONG, _INT, _DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


STOCK_SNAPSHOT = _schema(
    snapshot_ts=_TS, branch=_STRING, country=_STRING, status_type=_STRING, status_desc=_STRING,
    operational_flag=_STRING, product_rented=_STRING, product_class=_STRING, qty=_LONG,
)
BRANCH_REGISTER = _schema(
    branch=_STRING, country=_STRING, city=_STRING, region=_STRING, state=_STRING,
    third_party=_INT, population=_LONG,
)
MOVEMENT = _schema(moved_ts=_TS, branch=_STRING, unit_id=_LONG, prev_status=_INT)
UNIT_CURRENT = _schema(created_ts=_TS, branch=_STRING, unit_id=_LONG)
UNIT_HISTORY = _schema(snapshot_ts=_TS, branch=_STRING, unit_id=_LONG, status_id=_INT)
RESTRICTION = _schema(unit_id=_LONG, valid_from=_TS, valid_to=_TS, description=_STRING)
MAINTENANCE = _schema(branch=_STRING, finished_ts=_TS, job_id=_LONG, job_type=_STRING)
DAILY_INDICATOR = _schema(
    branch=_STRING, day=_DATE, mech_total=_DOUBLE, mech_present=_DOUBLE, mech_on_ramp=_DOUBLE,
)
SALE = _schema(paid_on=_TS, branch=_STRING, sale_id=_LONG, product=_STRING)

OPERATIONAL_COLUMNS = (
    "operational_total", "maintenance_total", "ready_total", "mech_total", "mech_present",
    "unavailable_general", "received_new",
)
STATIC_COLUMNS = ("country", "state", "city", "urban_tier", "pop_letter", "population")
SALES_COLUMNS = {"sales_new": "new", "sales_semi": "semi", "sales_used": "used"}
RENTED_COLUMNS = {
    "rented_new": "new", "rented_semi": "semi", "rented_used": "used", "rented_total": "total",
}


def placed_by(schema: T.StructType, sites: DataFrame | None) -> list[str]:
    """Columns of a fact table: with ``sites`` its rows name a site instead of a branch and its country."""
    if sites is None:
        return schema.names
    return ["site", *[c for c in schema.names if c not in ("branch", "country")]]


def require(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Fail with the names of the missing columns before any job starts."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s): {', '.join(missing)}")
    return df


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def conform(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Project ``df`` onto a contract; text that does not parse becomes NULL, not an error."""
    require(df, schema.names, what)
    have = {f.name: f.dataType for f in df.schema.fields}

    def shaped(field: T.StructField) -> Column:
        column = F.col(field.name)
        if have[field.name] == field.dataType:
            return column
        if _is_text(have[field.name]) and isinstance(field.dataType, T.DateType):
            return F.try_to_date(column).alias(field.name)
        return column.try_cast(field.dataType).alias(field.name)

    return df.select([shaped(f) for f in schema.fields])
