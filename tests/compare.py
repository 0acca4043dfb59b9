"""Order-insensitive comparison of a query with its SQL counterpart."""

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=repr)
