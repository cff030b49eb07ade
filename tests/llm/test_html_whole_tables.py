"""One layout for tables of any size and depth in the text of pages."""

import time

from portica.llm import html_render, queries


def texts(spark, folder, pages):
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").write.parquet(f"{folder}/pages.parquet")
    return {r["page_id"]: r for r in queries.op10_html_text(spark, str(folder)).collect()}


def test_columns_stay_whatever_the_size(spark, tmp_path):
    inner = "<table><tr><td>a<td>b<tr><td>long words here<td>c</table>"
    long = "<table><tr><td>" + "w" * 3000 + "<td>e<td>f" + "<tr><td>k<td><td>v" * 400 + "</table>"
    wide = "<table><tr>" + "<td>h" * 300 + "<tr><td colspan=300>wide<td>y" * 50 + "</table>"
    got = texts(spark, tmp_path, [inner, "<table><tr><td>" * 8 + inner, long, wide, None])
    assert got[0]["text"] == got[1]["text"] == "a               | b\nlong words here | c"
    rows = got[2]["text"].split("\n")
    assert len(rows) == 401 and all(r == "k" + " " * 2999 + " |   | v" for r in rows[1:])
    rows = got[3]["text"].split("\n")
    assert len(rows) == 51 and all([c.strip() for c in r.split(" | ")] == ["wide", *[""] * 299, "y"] for r in rows[1:])
    assert got[4]["text"] == "" and got[4]["n_lines"] == 0


def test_cells_of_nested_tables_keep_their_rows():
    text = html_render.render("<table><tr><td>x<td>" * 7 + "end", bounded=False)
    assert text == "x | " * 7 + "end"
    page = "<table><tr><td>x" * 4000
    began = time.perf_counter()
    assert html_render.render(page, bounded=False).split() == ["x"] * 4000 and time.perf_counter() - began < 5


def test_long_texts_go_in_several_batches(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"<p>{i}<p>{'x' * i}") for i in range(30)], "page_id bigint, html string").coalesce(1)
    want = {r["page_id"]: r["text"] for r in html_render.extract_text(pages).collect()}
    monkeypatch.setattr(html_render, "BATCH_CHARS", 20)
    assert {r["page_id"]: r["text"] for r in html_render.extract_text(pages).collect()} == want and len(want) == 30
