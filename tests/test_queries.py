"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from loomspark.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(f"{r[k]:.6g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    result = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_suppkey", "n_rows", "n_brands", "first_order"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_occurrences_equal_brute_force(spark):
    import datetime as dt

    want = []
    for event, ts in spark.read.parquet(f"{DIR}/events.parquet").select("event_id", "ts").collect():
        start, n, day = ts.date(), 0, ts.date()
        monday = start - dt.timedelta(days=start.weekday())
        while day <= dt.date(2024, 4, 14):
            if (day - monday).days // 7 % (1 + event % 2) == 0 and day.weekday() in (1, 3):
                n += 1
                if (event % 3 or n <= 6) and day >= dt.date(2024, 1, 15):
                    want.append((event, str(day)))
            day += dt.timedelta(days=1)
    got = [tuple(r) for r in catalogue.QUERIES["r1_all_occurrences"](spark, DIR).collect()]
    assert len({e for e, _ in got}) > 50 and sorted(got) == sorted(want)
