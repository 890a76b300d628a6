"""Every registered query that has SQL gives the same rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from waymark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    asked = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
    assert plain(tuple(r) for r in found.select(*columns).collect()) == plain(asked)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_slugs_of_whole_texts(spark):
    import re
    import unicodedata

    def brute(text):
        bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", "-", bare.lower()).strip("-")[:150].rstrip("-")

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    found = sorted((r.doc_id, r.slug) for r in QUERIES["slug_whole"](spark, SF).collect())
    assert found == sorted((r.doc_id, brute(r.text)) for r in rows)
    assert len({r.lang for r in rows}) > 3 and any(len(s) == 150 for _, s in found) and any(not r.text.isascii() for r in rows)
