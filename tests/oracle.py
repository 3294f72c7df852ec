"""Compare a Spark query with its DuckDB SQL over the same tables."""

import math
from pathlib import Path

import duckdb


def plain(value):
    """A value without the types of either engine; doubles to nine digits."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(x) for x in value]
    if hasattr(value, "asDict"):
        return {k: plain(x) for k, x in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    return str(value)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(df, sql, sf_dir):
    names = sorted(df.columns)
    mine = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    result = duck(sf_dir).execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names, (sorted(columns), names)
    at = [columns.index(n) for n in names]
    other = sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
    assert len(mine) == len(other), (len(mine), len(other))
    wrong = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    assert not wrong, f"{len(wrong)} of {len(mine)} differ: {wrong[0]}"
    return len(mine)
