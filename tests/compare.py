"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

from depotcast.sources.supplied import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_large_string(kind):
        return "string"
    return str(kind)


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = list(zip(*columns)) if columns else []
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(got: pa.Table, want: pa.Table) -> list[str]:
    """What differs, exactly: columns, types, row count and values."""
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    found = [
        f"type of {n}: {got.schema.field(n).type} != {want.schema.field(n).type}"
        for n in sorted(got.column_names)
        if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)
    ]
    if got.num_rows != want.num_rows:
        return [*found, f"rows {got.num_rows} != {want.num_rows}"]
    for a, b in zip(_rows(got), _rows(want)):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            for x, y in zip(a, b)
        ):
            found.append(f"{a} != {b}")
            if len(found) > 4:
                break
    return found
