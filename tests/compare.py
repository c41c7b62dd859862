"""Run a registered query and its checking SQL and compare the rows."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def checking_database(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [tuple((columns[i], row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(named, key=repr)


def spark_rows(frame):
    return as_rows(frame.columns, [tuple(r) for r in frame.collect()])


def database_rows(db, sql):
    result = db.sql(sql)
    return as_rows(result.columns, result.fetchall())
