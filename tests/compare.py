"""Run queries and their SQL side by side: python tests/compare.py FOLDER [QUERY...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings files symbols imports occurrences edges "
    "assets asset_refs chunk_vectors sources index_errors removals known_libraries mix_targets"
).split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(normal(v) for v in value.values())
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(v) for v in r) for r in df.select(*names).collect()), key=repr)


def oracle_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    return names, sorted((tuple(normal(v) for v in r) for r in rel.project(quoted).fetchall()), key=repr)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main(folder, names):
    import __spark_entry__ as e
    from cairn.session import build_session

    spark = build_session(
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(folder), e.queries(), e.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            cols, got = spark_rows(df)
            took = time.time() - t
            if name not in oracles:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            wanted_cols, wanted = oracle_rows(con, oracles[name])
            good = cols == wanted_cols and got == wanted
            print(f"{name}: {'same' if good else 'DIFFERENT'} {len(got)} {len(wanted)} rows, {took:.1f} s", flush=True)
            if not good:
                print("  ", cols, wanted_cols)
                a, b = set(got), set(wanted)
                print("  only Spark:", sorted(a - b, key=repr)[:5], "\n   only SQL:", sorted(b - a, key=repr)[:5])
        except Exception as err:
            print(f"{name}: ERROR {str(err)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
