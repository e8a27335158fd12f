"""Runs a registered query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def agree(spark, sf_dir, query, sql):
    got, expected = normal(query(spark, sf_dir).toPandas()), normal(connect(sf_dir).execute(sql).df())
    assert list(got.columns) == list(expected.columns)
    assert got.values.tolist() == expected.values.tolist()
