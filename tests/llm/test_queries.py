import pathlib

import pytest

from kvlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


def test_pages_keep_their_articles(spark):
    """The generated pages hold their article between known tags; menus, adverts and footers stand outside."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op5_html_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in want if b) and r["n_chars"] == len(r["text"])
