"""Links of plain and odd pages by one worker a task, few rows at a time."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.operators import links
from webloom.plans import queries

PIECES = ['<a href="/x">', '<a href="c/d?b=1&a=2">t</a>', '<a href="mailto:x@y">', '<A HREF="/u">', "<a href=/v>", '<a href="https://o.example/p;q?x=%41#f">', '<img src="http://[bad">', "a < b", "<!-- <a href='/c'> -->", "<p>text", '<a href="//O.example/">', "<title>open", '<a href="/é?q=ü">', '<a href="">']


def evaluations(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_resolved_is_the_parsers(spark):
    rng = random.Random(7)
    pages = [(k, rng.choice(["https://h.example/a/b?q=1", "http://H.example", "/no"]), "".join(rng.choice(PIECES) for _ in range(rng.randrange(7)))) for k in range(1500)] + [(1500, "https://h/", None), (1501, None, '<a href="https://o/x"><a href="/y">'), (1502, None, '<A href="https://o/x"><a href="/y">')]
    want = {(k, n, raw, url) for k, base, page in pages for n, raw in enumerate(html.links_of(page)) if (url := urls.resolve(base or "", raw)) is not None}
    rows = links.resolved(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert rows.columns == ["page_id", "pos", "raw", "url"]
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["links_normalized", "links_allowed", "links_by_host"])
def test_one_worker_a_task(spark, tmp_path, name):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(batch)
    spark.range(3).select(F.col("id").alias("page_id"), F.lit("https://h.example/").alias("url"), F.lit('<a href="/x">').alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert evaluations(queries.QUERIES[name](spark, str(tmp_path))) == 1
    assert int(spark.conf.get(batch)) <= 1_000
