"""Runs queries of __spark_entry__ next to their SQL in DuckDB: python tests/oracle.py FOLDER [NAME...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    """A value in a form that both engines share."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def duck(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return c


def compare(df, sql, connection):
    """'' if the rows agree, else what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    order = sorted(names)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} and {order}"
    key = lambda row: tuple(str(x) for x in row)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in theirs), key=key)
    if a == b:
        return ""
    more, less = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows and {len(b)}; only Spark {more}; only SQL {less}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    connection = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, f in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name in oracles:
                said = compare(f(spark, folder), oracles[name], connection) or "same"
            else:
                said = f"{f(spark, folder).count()} rows, no SQL"
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{name}: {said[:900]} ({time.time() - began:.1f} s)", flush=True)
