"""Text shaping, nested schemas, sources, sinks and streams on small inputs with edge cases."""

import io
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestar.functions import bounded as B
from lodestar.functions import content as C
from lodestar.operators import catalog as K
from lodestar.operators import delimited as D
from lodestar.operators import sampling as S
from lodestar.operators import shapes as N
from lodestar.sources import files as R
from lodestar.sources import sinks as W
from lodestar.streaming import arrivals as A


def contents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")


def test_delimiters(spark):
    df = contents(spark, "a;b\n1;2\n", "a,b;c\n1,2;3\n", "words only\nhere\n", "", None, "a\tb|c|d\n1\t2|3|4\n")
    got = [r[0] for r in df.orderBy("file_id").select(D.sniff_delimiter(F.col("content"))).collect()]
    assert got == [";", ",", None, None, None, "|"]


def test_rows_with_quotes_and_ragged_ends(spark):
    df = contents(spark, 'a,,a\r\n"x ""y""\nz",2\r\n1,2,3,4\r\n,,\r\n')
    rows = D.read_delimited(df).orderBy("row_no").collect()
    assert rows[0]["header"] == ["a", "column_2", "a_2"]
    assert [r["cells"] for r in rows] == [['x "y"\nz', "2"], ["1", "2", "3", "4"], ["", "", ""]]
    assert [r["ragged"] for r in rows] == [True, True, False]
    assert [r["extra_cells"] for r in rows] == [None, ["4"], None]
    assert rows[0]["record"] == {"a": 'x "y"\nz', "column_2": "2"}


def test_unfinished_row_goes(spark):
    df = contents(spark, 'a,b\n1,2\n3,"4', "a,b\n1,2\n3,4\n")
    got = D.read_delimited(df, F.lit(False)).groupBy("file_id").count().orderBy("file_id").collect()
    assert [r["count"] for r in got] == [1, 2]


def test_headers_stay_distinct(spark):
    df = spark.createDataFrame([(["a", "a_2", "a", "", "a"],), ([],)], "h array<string>")
    got = [r[0] for r in df.select(D.distinct_headers(F.col("h"))).collect()]
    assert got == [["a", "a_2", "a_3", "column_4", "a_4"], []]


def brute_paths(v, depth, path="$"):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(v)]
    yield path, kind
    if depth:
        for k, x in v.items() if isinstance(v, dict) else [(None, x) for x in v] if isinstance(v, list) else []:
            yield from brute_paths(x, depth - 1, f"{path}[]" if k is None else f"{path}.{k}")


def test_nested_paths_match_brute_force(spark):
    import collections
    import json

    docs = [{"a": [1, {"b": None}, [], [2.5, "x"]], "c": {}}, {"a": [], "c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}, [1, 2], "s", None, 3, {"a": True}]
    df = spark.createDataFrame([(json.dumps(x),) for x in docs] + [(None,), ("{bad",)], "t string").select(F.try_parse_json("t").alias("v"))
    want = collections.Counter(p for x in docs for p in brute_paths(x, 5))
    got = collections.Counter()
    for r in N.paths(df, "v").collect():
        got[(r["path"], r["type"])] += r["n"]
    assert got == want


def test_required_and_violations(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":2.5}',)], "t string").select(F.try_parse_json("t").alias("v"))
    schema = N.nested_schema(df, "v")
    rows = {r["path"]: (r["types"], r["required"]) for r in schema.collect()}
    assert rows == {"$": (["object"], False), "$.a": (["number"], True), "$.b": (["string"], False)}
    assert N.violations(df, "v", schema).count() == 0
    other = spark.createDataFrame([('{"a":"no","z":1}',), ('{"b":"x"}',)], "t string").select(F.try_parse_json("t").alias("v"))
    assert {tuple(r) for r in N.violations(other, "v", schema).collect()} == {("$.a", "type string", 1), ("$.z", "undeclared", 1), ("$.a", "missing", 1)}
    assert N.nested_schema(df.limit(0), "v").count() == 0


def test_decoding(spark):
    text = "naïve 中文"
    raws = [text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16"), text.encode("utf-32"), text.encode("gb18030"), b"a\0b", b"", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw binary")
    got = [tuple(r[0]) for r in df.orderBy("i").select(B.decode_text(F.col("raw"))).collect()]
    assert got[:5] == [(text, "utf-8"), (text, "utf-8-sig"), (text, "utf-16"), (text, "utf-32"), (text, "gb18030")]
    assert got[5] == (None, None) and got[6] == ("", "utf-8") and got[7] == (None, None)


def test_names_and_bounds(spark):
    assert B.normalized_names(["Ａ b!", "a b", "", "编号 1", "_x_"]) == ["a_b", "a_b_2", "column", "编号_1", "x"]
    df = spark.createDataFrame([("x" * 3000, [float("nan"), 1.0] * 150, bytearray(b"ab"))], "s string, a array<double>, b binary")
    row = B.safe_values(df).first()
    assert len(row["s"]) == 2048 and len(row["a"]) == 200 and row["a"][0] is None and tuple(row["b"]) == (2, "6162")


def test_wide_formats(spark):
    raws = [b"PK\x07\x08..", b"\x1f\x8b\0", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\0\0\0\x18ftypmp42", b"RIFF1234WAVE", b"", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw binary").orderBy("i")
    assert [r[0] for r in df.select(C.detect_format_wide(F.col("raw"))).collect()] == ["zip", "gzip", "ole", "iso_media", "wav", None, None]


def test_scan_and_archives(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("/root.txt", "abc")
    (tmp_path / "in" / "a.DAT").write_bytes(out.getvalue())
    (tmp_path / "in" / "sub" / "b.dat").write_bytes(b"no archive")
    (tmp_path / "in" / "c.txt").write_bytes(b"other")
    found = R.scan_files(spark, str(tmp_path / "in"))
    assert found.count() == 2
    rows = R.archive_members(found.select(F.length("path").alias("file_id"), "content")).collect()
    assert sorted((r["name"] or "", r["size"] or 0, r["unsafe"], r["error"] or "") for r in rows) == [("", 0, None, "corrupt"), ("/root.txt", 3, True, "")]


def test_name_maps(spark):
    df = contents(spark, '{"a":"b"}', '{"a":" "}', '{" ":"b"}', "[1]", None, '{"a":"' + "x" * 1001 + '"}')
    assert [r[0] for r in df.orderBy("file_id").select(R.load_name_map(F.col("content"))).collect()] == [{"a": "b"}, None, None, None, None, None]


def test_stream_registers_once(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(5).write.parquet(src)
    assert A.register(A.arrivals(spark, src), lambda d: d, dst).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    assert sorted(r[0] for r in A.register(A.arrivals(spark, src), lambda d: d, dst).collect()) == list(range(8))


def test_parts(spark):
    rows = [(1, 1, "a", 4, 4, 0), (1, 1, "a", 4, 4, 1), (1, 2, "b", 4, 4, 0), (1, 2, "c", 4, 4, 1), (1, 3, "d", 5, 4, 0), (1, 4, "e", None, 4, 0)]
    df = spark.createDataFrame(rows, "upload_id int, part int, sha256 string, bytes int, expected int, at int")
    assert A.distinct_parts(df).count() == 5
    got = {r["part"]: r["verdict"] for r in A.part_conflicts(df, "at").collect()}
    assert got == {1: "accepted", 2: "conflict", 3: "rejected", 4: "rejected"}


def test_snapshot(spark, tmp_path):
    docs = contents(spark, "x", "", "long " * 1000)
    cat = docs.select("file_id", F.octet_length("content").alias("file_size"), F.sha2("content", 256).alias("sha256"))
    path = f"file://{tmp_path}/snap"
    assert W.backup(cat, docs, path).where("verdict <> 'ok'").count() == 0
    with pytest.raises(AnalysisException):
        W.backup(cat, docs, path)
    W.restore(spark, path, f"file://{tmp_path}/back")
    assert spark.read.parquet(f"{tmp_path}/back/originals").count() == 3
    bad = f"file://{tmp_path}/bad"
    assert W.backup(cat.withColumn("sha256", F.lit("0")), docs, bad).where("verdict <> 'ok'").count() == 3
    with pytest.raises(AnalysisException):
        W.restore(spark, bad, f"file://{tmp_path}/never")


def test_written_tables(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.dat", "{}", "s"), (2, "b.dat", None, "s")], "file_id long, original_name string, content string, source string")
    seen = C.inspect(files)
    W.write_manifest(seen, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    s = W.summary(seen).first()
    assert [tuple(p) for p in s["statuses"]] == [("empty", 1), ("ok", 1)] and [p["file_id"] for p in s["review"]] == [2]
    W.write_by_category(files.join(seen.select("file_id", "category"), "file_id"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "category=text" / "source=s").is_dir()
    items = spark.createDataFrame([("b", 1), ("b", 2)], "batch_id string, file_id int")
    W.append_items(items, str(tmp_path / "i"), ["file_id"])
    W.append_items(items, str(tmp_path / "i"), ["file_id"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "i")).select("sequence", "file_id").collect()) == [(0, 1), (1, 2), (2, 1), (3, 2)]
    W.write_schema_per_shape(spark.createDataFrame([(2, "x"), (1, "x"), (3, None)], "file_id int, fingerprint string"), "file_id", str(tmp_path / "s"))
    assert [(r["fingerprint"], r["file_id"]) for r in spark.read.json(str(tmp_path / "s")).collect()] == [("x", 1)]


def test_incremental(spark):
    h = spark.createDataFrame([("a",), ("b",)], "sha256 string")
    done = spark.createDataFrame([("a", "p1")], "sha256 string, policy_key string")
    todo, after = K.incremental(h, done, "p1")
    assert [r[0] for r in todo.collect()] == ["b"] and after.count() == 2
    assert K.pending(h, after, "p1").count() == 0 and K.pending(h, after, "p2").count() == 2
    assert K.pending(h, K.reprocess(after, h.where("sha256 = 'a'")), "p1").count() == 1


def test_policy_keys_ignore_order(spark):
    one = spark.range(1).select(N.policy_key("1", {"a": 1, "b": 2}), N.policy_key("1", {"b": 2, "a": 1}), N.policy_key("2", {"a": 1, "b": 2})).first()
    assert one[0] == one[1] != one[2]


def test_kth_largest(spark):
    values = [(v * v % 997 - 300,) for v in range(500)] + [(None,), (10**12,), (-(10**12),)]
    df = spark.createDataFrame(values, "v long")
    ordered = sorted((v for (v,) in values if v is not None), reverse=True)
    for k in (1, 2, 17, 250, len(ordered)):
        assert S.kth_largest(df, "v", k, parts=5, small=3) == ordered[k - 1]
    assert S.kth_largest(df, "v", 0) is None and S.kth_largest(df, "v", 504) is None and S.kth_largest(df.limit(0), "v", 1) is None


def test_tabular_rule_reads_the_names_as_they_stand(spark):
    texts = {1: "a,a\n1,2\n3,4\n", 2: "a,b\n1,2\n", 3: "a,\n1,2\n", 4: "a,b\n1,2,3\n", 5: "1,2\n3,4\n"}
    rows = D.read_delimited(spark.createDataFrame(list(texts.items()), "file_id long, content string"))
    assert {r["file_id"]: r["result"] for r in D.tabular_rule(rows).collect()} == {1: "fail", 2: "pass", 3: "fail", 4: "fail", 5: "pass"}
    assert {r["file_id"]: r["warnings"] for r in D.quality_summary(rows).collect()} == {1: ["renamed_headers"], 2: [], 3: ["renamed_headers"], 4: ["ragged_rows"], 5: []}


def test_upload_of_short_parts_is_incomplete(spark):
    parts = [(1, 2000, 1, "e", 1024), (1, 2000, 2, "e", 976), (2, 2000, 1, "e", 1024), (2, 2000, 2, "e", 900), (3, 2000, 1, "e", 1024), (4, 2000, 1, "e", 1024), (4, 2000, 2, None, 976), (5, 0, 1, "e", 0)]
    df = spark.createDataFrame(parts, "upload_id long, size long, part long, etag string, bytes long")
    assert {r["upload_id"]: r["complete"] for r in K.upload_status(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_catalog_filter_takes_wildcards_literally(spark):
    rows = [("a_1.dat", "text", "x"), ("ab1.dat", "text", "x"), ("A_1 50%.dat", "html", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "original_name string, detected_type string, fingerprint string")
    names = lambda **k: sorted(r["original_name"] for r in K.catalog_filter(df, **k).collect())
    assert names(search="a_1") == ["A_1 50%.dat", "a_1.dat"] and names(search="50%.") == ["A_1 50%.dat"] and names(search="\\") == []
    assert names(kind="text", search="a") == ["a_1.dat", "ab1.dat"] and names(fingerprint="y") == ["A_1 50%.dat"]


def test_gate_looks_at_jobs(spark):
    items, verdicts = spark.createDataFrame([(1,)], "file_id long"), spark.createDataFrame([(1, "ok")], "file_id long, verdict string")
    ok = lambda *states: K.corpus_gate(items, verdicts, spark.createDataFrame([(s,) for s in states], "state string")).first()["ok"]
    assert ok("done") and not ok("done", "running") and not ok("failed") and K.corpus_gate(items, verdicts).first()["ok"]


def test_names_and_batches(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "file_id long, original_name string")
    names = spark.createDataFrame([("a", "y"), ("a", "x")], "original_name string, mapped string")
    assert sorted((r["file_id"], r["mapped"]) for r in K.apply_names(files, names).collect()) == [(1, "x"), (2, None), (3, None)]
    items = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "sequence long, batch_id string")
    known = spark.createDataFrame([("p",), ("p",), (None,)], "batch_id string")
    assert sorted((r["sequence"], r["accepted"]) for r in K.known_batches(items, known).collect()) == [(1, True), (2, False), (3, False)]


def test_schema_candidates(spark):
    import json

    df = spark.createDataFrame([(1, "2026-01-02", "n/a", None), (2, "2026-01-03", "7", None)], "`User Key` long, day string, `user-key` string, none string")
    got = {r["candidate"]: json.loads(r["schema"]) for r in N.schema_candidates(df).collect()}
    assert got["faithful"]["properties"]["User Key"] == {"type": "integer", "x-observed-types": {"integer": 2}}
    assert got["faithful"]["properties"]["none"]["type"] == "null"
    tidy = got["analytics"]["properties"]
    assert tidy["user_key"]["x-source-column"] == "User Key" and tidy["user_key_2"] == {"type": ["integer", "null"], "x-source-column": "user-key", "x-transform": "proposed; originals and sample values are unchanged"}
    assert tidy["day"]["format"] == "date" and "format" not in tidy["none"]
    assert got["semantic"]["x-field-roles"]["day"]["role"] == "time" and got["semantic"]["required"] == []
    assert all(s["properties"] == {} for s in (json.loads(r["schema"]) for r in N.schema_candidates(df.limit(0)).collect()))


def test_keys_that_look_like_paths(spark):
    rows = [('{"a.b": 1, "a": {"b": "x"}, "c[]": true, "q\\"": null}',)]
    v = spark.createDataFrame(rows, "t string").select(F.parse_json("t").alias("v"))
    schema = N.nested_schema(v, "v")
    got = {r["path"]: r["types"] for r in schema.collect()}
    assert got == {"$": ["object"], '$."a.b"': ["integer"], "$.a": ["object"], "$.a.b": ["string"], '$."c[]"': ["boolean"], '$."q\\""': ["null"]}
    assert {r["path"]: r["level"] for r in N.field_tree(schema).collect()}['$."a.b"'] == 1
    without = spark.createDataFrame([('{"a": {"b": "x"}, "c[]": true, "q\\"": null}',)], "t string").select(F.parse_json("t").alias("v"))
    assert [tuple(r) for r in N.violations(without, "v", schema).collect()] == [('$."a.b"', "missing", 1)]
