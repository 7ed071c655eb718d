"""Every query that SQL can express, against DuckDB on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, tables, name):
    ours = entry.queries()[name](spark, sf_dir)
    theirs = tables.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    kinds = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in ours.dtypes} == kinds
    at = [theirs.columns.index(c) for c in columns]
    want = Counter(tuple(plain(row[k]) for k in at) for row in theirs.fetchall())
    assert Counter(tuple(map(plain, row)) for row in ours.select(columns).collect()) == want


@pytest.mark.parametrize("name", ["html_blocks", "html_text", "parse_text", "parse_json", "hash_embedding", "llm_extract", "dedupe_candidates", "agentic_loop", "hybrid_with_model"])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_pages_cut_inside_a_reference_equal_sql(spark, tmp_path):
    """Headings and paragraphs that end in a reference without its semicolon, and what else may follow an ampersand."""
    from quarry.sources import parsers

    texts = ["AT&amp", "say &quot", "a & b", "a &amp; b &quot;c&quot;", "&amp;quot;", "x&am", "R&D &copy; &middot; &amp;amp", "&", "&#"]
    pages = [(n, f'<html><body><h1>{x}</h1><p>one <a href="/?a=1&b=2">{x}</a></p><h2>next</h2><li>{x}</li><script>a && b</script></body></html>') for n, x in enumerate(texts)]
    spark.createDataFrame(pages, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = db.sql(SQL["html_blocks"])
    ours = entry.queries()["html_blocks"](spark, str(tmp_path)).select(theirs.columns).collect()
    assert sorted(map(tuple, ours)) == sorted(theirs.fetchall()) and len(ours) == 2 * len(texts)
    assert [b[1]["section"] for b in parsers.html_blocks(b"<h1>AT&amp</h1><p>x</p>")] == ["AT&"]  # the parser itself


def test_html_text_is_what_shows(spark, sf_dir):
    """No markup, scripts or styles are left, and the words of every heading and paragraph are."""
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in entry.queries()["html_text"](spark, sf_dir).collect():
        html = pages[row["page_id"]]
        assert "<p>" not in row["text"] and "<script" not in row["text"]
        for inside in re.findall(r"<(?:p|h1)>([^<&]*)</(?:p|h1)>", html):
            assert inside.strip() in row["text"]


def test_texts_pass_through_the_parser(spark, sf_dir):
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["path"].removesuffix(".txt"): r["text"] for r in entry.queries()["parse_text"](spark, sf_dir).collect()}
    assert got == texts


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "place", "chunk_id", "doc_id", "score", "source"]
