"""Side-by-side check of a registered Spark query against its DuckDB SQL twin,
the same way the driver does it: row count, column names and an
order-insensitive comparison of normalised values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from hirelake.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
                 "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_mismatches(sdf, con, sql):
    """Columns whose Spark type and DuckDB type differ."""
    duck_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    out = []
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        if SPARK_TO_DUCK.get(st, st.upper()) != duck_types.get(f.name):
            out.append((f.name, st, duck_types.get(f.name)))
    return out


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, verbose: bool = True) -> dict:
    from hirelake.plans.registry import ORACLE_SQL, QUERIES
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    sql = ORACLE_SQL.get(name)
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = duck(sf_dir)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS {sorted(scols)} vs {sorted(dcols)}"
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    types = type_mismatches(sdf, con, sql)
    if a == b and not types:
        res["status"] = "ok"
    elif a == b:
        res["status"] = f"TYPES {types}"
    else:
        res["status"] = "VALUES"
        if verbose:
            sa, sb = set(a), set(b)
            res["only_spark"] = [r for r in a if r not in sb][:3]
            res["only_duck"] = [r for r in b if r not in sa][:3]
            res["cols"] = sorted(scols)
    return res


def main(argv):
    from hirelake.plans.registry import QUERIES, load_all
    from hirelake.session import build_session
    load_all()
    sf = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")] or sorted(QUERIES)
    spark = build_session("local[8]", 8)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
