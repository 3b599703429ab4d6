"""Registered queries against their SQL twins on tables that the given small ones don't show."""

import duckdb
import pytest

from lodestar.plans import registry
from tests.test_queries import plain

DOCUMENTS, PAGES = "doc_id long, text string, lang string, source string, n_chars long", "page_id long, url string, html string"


def agree(spark, folder, name, **tables):
    """Write the tables (rows and schema each), run a query and its twin over them, and compare rows."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df, sql = registry.queries()[name](spark, str(folder)), con.execute(registry.oracles()[name])
    cols = [c[0] for c in sql.description]
    want = sorted((tuple(map(plain, r)) for r in sql.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want
    return want


def long_pages(spark, folder, name):
    """Pages shorter and longer than the prefix that an inspection reads, with and without an opening that tells HTML."""
    htmls = ["<html><p>x</p>", " \n<!DOCTYPE  html><p>" + "x" * 70000, "<HTML><p>" + "é" * 40000, "<p>" + "x" * 70000, "text " * 20000 + "<html>"]
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(htmls)]
    return agree(spark, folder, name, documents=([(1, "a text", "en", "web", 6)], DOCUMENTS), pages=(pages, PAGES))


def test_long_pages_are_html(spark, tmp_path):
    got = {r[0]: r[5] for r in long_pages(spark, tmp_path, "f10_inspect")}
    assert [got[1000000 + i] for i in range(5)] == ["html", "html", "html", "text", "text"]


def test_status_counts_with_long_pages(spark, tmp_path):
    assert (None, None, "html", 3.0) in [(*r[:3], float(r[3])) for r in long_pages(spark, tmp_path, "a1_status_counts")]


def test_catalog_totals_with_long_pages(spark, tmp_path):
    """Every page of the SQL's is to review; so these all open like HTML."""
    pages = [(i, f"http://x/{i}", "<html>" + "x" * n) for i, n in enumerate([10, 65530, 65531, 200000])]
    assert agree(spark, tmp_path, "a3_catalog_totals", documents=([(1, "a text", "en", "web", 6)], DOCUMENTS), pages=(pages, PAGES)) == [(5, 0, 4)]


def test_summary_with_long_pages(spark, tmp_path):
    assert long_pages(spark, tmp_path, "k2_summary") == [("ok:6", "text:6", "html:3,text:3")]


def empty_texts(spark, folder, name):
    """Empty texts beside others of their source, and in a source without others."""
    texts = [("a text", "web"), ("", "web"), ("b", "web"), ("", "bare"), ("c", "s1"), ("d", "s2"), ("e", "s3"), ("f", "s4")]
    docs = [(1 + i + i // 2, t, "en", s, len(t)) for i, (t, s) in enumerate(texts)]  # no multiple of 3: each has a shape
    events = [(1, '{"k": 1}'), (2, None), (3, "")]
    return agree(spark, folder, name, documents=(docs, DOCUMENTS), pages=([(1, "http://x/1", "<html>x")], PAGES), events=(events, "event_id long, props string"))


def test_status_counts_with_empty_texts(spark, tmp_path):
    assert ("ok", None, None, 9.0) in [(*r[:3], float(r[3])) for r in empty_texts(spark, tmp_path, "a1_status_counts")]


def test_inspections_of_empty_texts(spark, tmp_path):
    got = {r[0]: r for r in empty_texts(spark, tmp_path, "f10_inspect")}
    assert [got[i][4:7] for i in (2, 5)] == [(None, None, "whole_file")] * 2 and got[2][9] == "ok"


def test_formats_of_empty_texts(spark, tmp_path):
    got = dict(empty_texts(spark, tmp_path, "f8_classify_text"))
    assert [got[i] for i in (1, 2, 5, 2000001, 2000002, 2000003)] == ["text", None, None, "json", None, "text"]


def test_manifest_with_empty_texts(spark, tmp_path):
    assert {r[1] for r in empty_texts(spark, tmp_path, "k1_manifest")} == {"ok"}


def test_summary_with_empty_texts(spark, tmp_path):
    assert empty_texts(spark, tmp_path, "k2_summary") == [("ok:9", "text:9", "html:1,text:6")]


@pytest.mark.parametrize("name", ["p11_schema_catalog", "p13_shape_count", "k4_first_per_shape"])
def test_shapes_of_empty_texts(spark, tmp_path, name):
    """An empty text has no shape: of six shapes, the catalogue's page leaves the first two out."""
    assert len(empty_texts(spark, tmp_path, name)) == {"p11_schema_catalog": 4, "p13_shape_count": 6, "k4_first_per_shape": 6}[name]


def test_schema_groups_of_empty_texts(spark, tmp_path):
    assert {(None, "web", 1), (None, "bare", 1), ("text", "web", 2)} <= set(empty_texts(spark, tmp_path, "p12_schema_groups"))


def test_rules_on_empty_texts(spark, tmp_path):
    assert [(*r[:2], float(r[2])) for r in empty_texts(spark, tmp_path, "q1_q4_rules")] == [("coverage", "pass", 9.0), ("format", "pass", 9.0)]


def test_images_around_short_texts(spark, tmp_path):
    """Texts of 0 to 3 bytes, and none, in each of the five images."""
    docs = [(64 * kind + i + 1, t, "en", "web", len(t or "")) for kind in range(5) for i, t in enumerate(["", "A", "A.", "Re.", None])]
    got = dict(agree(spark, tmp_path, "f15_xor_image_key", documents=(docs, DOCUMENTS)))
    assert [k for k in got if got[k] is None] == [64 * 4 + i + 1 for i in range(5)]
