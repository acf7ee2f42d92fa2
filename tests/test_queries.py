"""Every query that has SQL gives the same rows as its SQL."""

import decimal
import math

import duckdb
import pytest

from foliospark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(columns).collect())
    found = duck.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def small(spark, tmp_path, name, **tables):
    """Sorted rows of a query and of its SQL over small tables, given as SQL; whole numbers and doubles print alike."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"CREATE TABLE {t} AS {sql}")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = con.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = [[plain(v) for v in r] for r in plans.QUERIES[name](spark, str(tmp_path)).select(columns).collect()]
    return sorted(map(str, got)), sorted(str([plain(v) for v in r]) for r in found.fetchall())


def test_token_breakdown_of_short_and_blank_texts(spark, tmp_path):
    """A prompt shorter than its glossary has no tokens of its own, and a text of line ends or tabs is no part of it."""
    texts = ["A.", "Re.", "", " ", chr(10) * 30, chr(9) * 9, chr(13) + chr(12), chr(11) * 20, chr(160) * 20, "ab" * 9 + chr(10)]
    rows = ", ".join(f"({i}, " + " || ".join(f"chr({ord(c)})" for c in t) + ")" if t else f"({i}, '')" for i, t in enumerate(texts))
    got, expected = small(spark, tmp_path, "a25_x32_token_breakdown", documents=f"SELECT * FROM (VALUES {rows}, (99, NULL)) t(doc_id, text)")
    assert got == expected


def test_block_kinds_of_long_texts_that_begin_with_a_mark(spark, tmp_path):
    """Every sixteenth element is plain text; of three, one gets words before its text and one behind."""
    texts = ["77 " + "ab " * 90, "77 ab", "†" + "ab " * 90, "* " + "ab " * 90, "1 " + chr(769) + "ab"]
    rows = ", ".join(f"({7 + 16 * (3 * i + k)}, '{t}')" for i, t in enumerate(texts) for k in range(3))
    documents = f"SELECT * FROM (VALUES {rows}) t(doc_id, text)"
    got, expected = small(spark, tmp_path, "x58_p48_p45_block_kinds", documents=documents, embeddings="SELECT unnest(range(300)) AS vec_id")
    assert got == expected and sum("footnote" in r for r in got) == 4
