"""Lines of any length take part in exact matching, and paths of any depth in the tree."""
from caseloom.llm import line_dedup, queries, url_templates


def test_short_lines_and_lines_without_spaces(spark, docs, tmp_path):
    lines = ["Subscribe now", "All rights reserved", "\u65e5\u672c\u8a9e\u306e\u9577\u3044\u884c\u3067\u3059\u3002", "ok"]
    rows = [(i, "\n".join([*lines, f"own words number {'abcdef'[i] * 3} here", "", "***"])) for i in range(6)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.dropped for r in queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: "0,1,2,3" if i else "" for i in range(6)}


def test_branches_below_the_sixth_level(spark):
    urls = [f"http://h/a/b/c/d/e/f/{'xy'[i % 2]}/{i}" for i in range(80)]
    urls += ["http://h/a/b/c/d/e/f/z/p/q/r/7"]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(80)], "page_id long, bad int")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.template) for r in url_templates.judged(pages, [], labels, url_templates.Settings(purity=0.8)).collect()}
    assert all(got[i] == (("block", "/a/b/c/d/e/f/x/{num}$8") if i % 2 == 0 else ("allow", "/a/b/c/d/e/f/y/{num}$8")) for i in range(80))
    assert got[80] == ("allow", "/a/b/c/d/e/f/z/p/q/r/{num}$11")
