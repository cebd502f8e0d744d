"""`links_allowed` follows by its lists what only the parser and the exact rules read, with one worker a task."""

from webloom.plans import queries


def test_odd_pages(spark, tmp_path):
    page = '<A HREF="/u"><a href="https://cheap-pills.example.com/"><a href="mailto:x@y"><a href=https://B.Example.net/%41/><a href="https://o.example/">'
    rows = [(1, "https://example.com/a", page), (2, "https://o.example/a", page.replace("A HREF", "a href")), (3, "https://example.com/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.links_allowed(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 0, "https://example.com/u"), (1, 3, "https://b.example.net/%41"), (2, 3, "https://b.example.net/%41")]
