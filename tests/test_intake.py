"""Profiles, nested schemas, XML, byte windows and large delimited files, against parsers and loops."""

import hashlib
import json
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from lodestar.functions import bounded as B
from lodestar.functions import content as C
from lodestar.functions.values import analytical_type
from lodestar.operators import delimited as D
from lodestar.operators import profile as P
from lodestar.operators import records as J
from lodestar.operators import shapes as N
from lodestar.sources import files as R
from lodestar.sources import ranges as G


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "file_id long, content string")


# ---- profiles ------------------------------------------------------------------------------------------------------


def fingerprint(columns, family="tabular"):
    return hashlib.sha256(json.dumps({"family": family, "columns": columns}, sort_keys=True).encode()).hexdigest()


def test_fingerprint_of_native_types(spark):
    example = spark.createDataFrame([("2026-10-01T00:00", "s1", "20.5"), ("2026-10-02T00:00", "s2", "NA")], "recorded_at string, `sensor id` string, temperature string")
    assert P.schema_fingerprint(example).first()["fingerprint"] == "8329d9700ddac32344f851d34ccbb36da26b3b308d6c1421a78895ece1441f2e"
    df = spark.createDataFrame([("1", None, 1, float("nan"), [1], None), ("2", 2.5, 2, 1.0, [2], None)], "digits string, `a.b` double, `größe \"x\"` long, f double, l array<int>, n string")
    want = {"digits": "string", "a.b": ["null", "number"], 'größe "x"': "integer", "f": ["null", "number"], "l": "array", "n": "null"}
    assert P.schema_fingerprint(df).first()["fingerprint"] == fingerprint(want)
    assert P.schema_fingerprint(df.limit(1), "document").first()["fingerprint"] == fingerprint({"digits": "string", "a.b": "null", 'größe "x"': "integer", "f": "null", "l": "array", "n": "null"}, "document")
    assert P.schema_fingerprint(df.limit(0)).first()["fingerprint"] == fingerprint({})


def test_roles_by_normalised_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 7, "t"), (2, "b", "y", 7, "u")], "`Order ID` long, `User-Key` string, `a.b` string, kid long, `Full Text` string")
    got = {r["column"]: (r["role"], r["candidate_key"]) for r in P.column_profile(df, family="document").collect()}
    assert got == {"Order ID": ("identifier", True), "User-Key": ("identifier", True), "a.b": ("dimension", False), "kid": ("measure", False), "Full Text": ("text", False)}


def test_formats(spark):
    df = spark.createDataFrame([("2026-01-01", "2026-01-01", None, "2026-01-01"), ("n/a", "2026-01-01T10:00", "", "x")], "day string, mixed string, none string, some string")
    got = {r["column"]: (r["types"], r["format"]) for r in P.proposed_types(df).collect()}
    assert got == {"day": (["null", "string"], "date"), "mixed": (["string"], None), "none": (["null"], None), "some": (["string"], None)}


def test_profiles_add_up(spark):
    rows = [(f"c{i % 3}", i, str(i % 50) if i % 7 else "n/a", None if i % 5 else 1.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "sha256 string, k long, v string, `w.x` double")
    columns = ["k", "v", "w.x"]
    states = P.column_states(df, ["sha256"], columns)
    one, two = states.where("sha256 = 'c0'"), states.where("sha256 <> 'c0'")
    parts = {r["column"]: r.asDict() for r in P.profile_of_states(one.unionByName(two), columns).collect()}
    whole = {r["column"]: r.asDict() for r in P.column_profile(df, columns, approximate=True).collect()}
    exact = {r["column"]: r.asDict() for r in P.column_profile(df, columns).collect()}
    assert parts == whole
    for c, p in exact.items():
        n, m = p.pop("distinct_count"), whole[c].pop("distinct_count")
        assert abs(n - m) <= 0.05 * n and {k: v for k, v in p.items() if k != "candidate_key"} == {k: v for k, v in whole[c].items() if k != "candidate_key"}
    assert P.profile_of_states(states.limit(0), columns).count() == 0


# ---- nested schemas ------------------------------------------------------------------------------------------------


def infer(values, depth=0):
    if depth > 5:
        return {}
    kind = lambda v: "null" if v is None else {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(v)]
    types = sorted({kind(v) for v in values})
    if "number" in types and "integer" in types:
        types.remove("integer")
    out = {"type": types[0] if len(types) == 1 else types}
    objects, arrays = [v for v in values if isinstance(v, dict)], [v for v in values if isinstance(v, list)]
    if objects:
        keys = sorted({k for o in objects for k in o})
        out |= {"properties": {k: infer([o[k] for o in objects if k in o], depth + 1) for k in keys}, "additionalProperties": True}
        if needed := [k for k in keys if all(k in o for o in objects)]:
            out["required"] = needed
    if arrays:
        entries = [x for a in arrays for x in a]
        out["items"] = infer(entries, depth + 1) if entries else {}
    return out


def test_nested_document(spark):
    docs = [{"a": [1, {"b": None}, [], [2.5, "x"]], "c": {}, "": {"é.": 1}}, {"a": [], "c": {"d": {"e": {"f": {"g": {"h": {"i": 1}}}}}}, "": {"é.": "s"}}, [1, 2], "s", None, 3, {"a": True, 'q"': [[[]]]}]
    for some in (docs, docs[:2], [{}], [[]], ["x"]):
        df = spark.createDataFrame([(json.dumps(x),) for x in some] + [(None,)], "t string").select(F.try_parse_json("t").alias("v"))
        got = N.nested_document(df, "v").first()
        want = json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", **infer(some)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got["schema"] == want and got["fingerprint"] == hashlib.sha256(want.encode()).hexdigest()
    assert N.nested_document(df.limit(0), "v").count() == 0


def test_field_tree_goes_depth_first(spark):
    v = spark.createDataFrame([('{"a-b": 1, "a": {"x": 2}, "c": [{"k": 1}], "cB": 1, "": 0}',)], "t string").select(F.parse_json("t").alias("v"))
    tree = N.field_tree(N.nested_schema(v, "v")).collect()
    assert [(r["path"], r["level"]) for r in tree] == [("$", 0), ('$.""', 1), ("$.a", 1), ("$.a.x", 2), ("$.a-b", 1), ("$.c", 1), ("$.c[]", 2), ("$.c[].k", 3), ("$.cB", 1)]


# ---- content -------------------------------------------------------------------------------------------------------


class Pieces(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.found, self.hidden = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def test_html_text_agrees_with_a_parser(spark):
    pages = ['<p title="a > b">x</p> y', "a < b and c > d", "<p>1<br/>2</p>", "<a href='x>y' b=\"q\">t</a>", "<p don't>z'</p>q", "<!-- a > b -->k", "<script>if(a<b){}</script>m", "<?php echo 1 ?>n", "<!DOCTYPE html><html><body>hi <b>x</b>&#150;&apos;</body></html>"]
    got = {r["content"]: r["t"] for r in texts(spark, *pages).select("content", C.html_text(F.col("content")).alias("t")).collect()}
    assert got == {p: re.sub(r"[ \t\n\r\f]+", " ", " ".join(Pieces(p).found)[:2048]).strip() for p in pages}


def test_inspection_looks_at_the_prefix(spark):
    odd = "ok " * 40000 + "\x00\x01\x02" * 30000
    rows = [(1, "a", odd), (2, "b", "é" * 40000), (3, "c", None), (4, "d", "\x01" * 20), (5, "e", "<a/>"), (6, "f", "{" + " " * 70000 + "}"), (7, "g", "a" + "é" * 40000)]
    got = {r["file_id"]: r for r in C.inspect(spark.createDataFrame(rows, "file_id long, original_name string, content string")).collect()}
    assert [got[i]["detected_type"] for i in range(1, 8)] == ["text", "text", None, None, "xml", "text", "text"]
    assert [got[i]["printable_ratio"] for i in (1, 2, 4)] == [1.0, 0.0, 0.0] and got[1]["file_size"] == 210000 and got[3]["status"] == "empty"


def test_xml_is_told_by_a_parser(spark):
    kinds = {"<a/>": "xml", "<a><b></a>": "text", "<a/><b/>": "text", "<?xml version='1.0'?>\n<a>x</a>": "xml", "<!DOCTYPE a><a/>": "text", "<html><p>": "html", "{}": "json", "[1,": "text", "<a/> t": "text", "<a>&x;</a>": "text", " <a b=1/>": "text", "": "text"}
    got = {r["content"]: r["k"] for r in texts(spark, *kinds).select("content", C.classify_text(F.col("content")).alias("k")).collect()}
    assert got == kinds


def test_xml_records(spark):
    df = texts(spark, "<rows><row id='1'><id>2</id><n> x </n></row><row>leaf</row><other k=\"v\"/></rows>", "<a>just <b>001</b></a>", "<a>only text</a>", "<a><b></a>", None, "<a/>", "<a><x><y>1</y><y>2<z>deep</z></y></x></a>")
    got = [(r["file_id"], r["row_no"], r["record"]) for r in R.xml_records(df).orderBy("file_id", "row_no").collect()]
    assert got == [
        (0, 0, {"tag": "row", "id": "2", "n": "x"}), (0, 1, {"tag": "row", "text": "leaf"}), (0, 2, {"tag": "other", "k": "v", "text": ""}),
        (1, 0, {"tag": "b", "text": "001"}), (2, 0, {"text": "only text"}), (5, 0, {"text": ""}), (6, 0, {"tag": "x", "y": "2"}),
    ]


def test_names_in_compatibility_form(spark):
    names = ["Ａ b!", "a b", "", "编号 1", "_x_", "ﬁn", None]
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "f string, i int, n string")
    got = {r["i"]: r["proposed"] for r in B.distinct_normalized_names(df.where("n is not null"), ["f"], "n", "i").collect()}
    assert [got[i] for i in range(6)] == B.normalized_names(names[:6])
    assert {r["i"]: r["p"] for r in df.select("i", B.normalized_name(F.col("n")).alias("p")).collect()}[5] == "fin"


# ---- files ---------------------------------------------------------------------------------------------------------


def test_scan_rules(spark, tmp_path):
    top = tmp_path / "in"
    (top / "b").mkdir(parents=True)
    (top / "out").mkdir()
    for name in ("z.dat", "b/a.DAT", "c.txt", "out/r.dat"):
        (top / name).write_bytes(b"x")
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "l.dat").write_bytes(b"x")
    (top / "link").symlink_to(tmp_path / "far")
    found = [r["path"].split("/in/")[1] for r in R.scan_files(spark, str(top), output=str(top / "out")).select("path").collect()]
    assert found == ["b/a.DAT", "z.dat"]
    assert R.scan_files(spark, str(top / "c.txt")).count() == 1


def test_windows_of_large_files(spark, tmp_path):
    big = tmp_path / "big.dat"
    with big.open("wb") as f:
        f.write(b"head\n" * 10)
        f.seek(200_000_000)
        f.write(b"tail\n" * 10)
    (tmp_path / "small.dat").write_bytes(b"a\nb\n")
    (tmp_path / "none.dat").write_bytes(b"")
    files = R.scan_files(spark, str(tmp_path)).select("path", "length").unionByName(spark.createDataFrame([(f"file:{tmp_path}/none.dat", 0)], "path string, length long"))
    rows = {r["path"].rsplit("/", 1)[1] + str(r["window_no"]): r for r in G.read_windows(files).collect()}
    parts = [rows[f"big.dat{i}"] for i in range(3)]
    assert sum(len(p["data"]) for p in parts) <= 65536 + 4 and [p["offset"] % 4 for p in parts] == [0, 0, 0] and parts[0]["size"] == 200_000_050
    with big.open("rb") as f:
        for p in parts:
            f.seek(p["offset"])
            assert f.read(len(p["data"])) == bytes(p["data"])
    assert bytes(rows["small.dat0"]["data"]) == b"a\nb\n" and bytes(rows["none.dat0"]["data"]) == b"" and len(rows) == 5
    assert {len(r["data"]) for r in G.read_prefixes(files, 8).collect()} == {0, 4, 8}


def test_windows_show_drift_at_the_tail(spark, tmp_path):
    (tmp_path / "t.dat").write_bytes(b"id,value\n" + b"1,2\n" * 100000 + b"2,not_numeric\n" * 100)
    lines = G.window_lines(G.read_windows(R.scan_files(spark, str(tmp_path))))
    assert lines.select("windows").distinct().collect()[0][0] == 3
    later = lines.where("window_no > 0").select(F.explode("lines").alias("l")).distinct().collect()
    assert {r["l"] for r in later} == {"1,2", "2,not_numeric"}  # no cut line
    rows = G.sample_lines(lines, 200)
    assert rows.count() <= 200
    kinds = rows.select("window_no", analytical_type(F.get(F.split("line", ","), 1)).alias("t")).where("t <> 'null'").groupBy("window_no").agg(F.array_sort(F.collect_set("t")).alias("t"))
    got = {r["window_no"]: r["t"] for r in kinds.collect()}
    assert "integer" in got[0] and got[1] == ["integer"] and "string" in got[2]


def test_large_delimited_over_cuts(spark, tmp_path):
    import csv

    rows = [["id", "note", "n"]] + [[str(i), f'line {i}\nsecond ""{i}"" \r\n;third, {"x" * (i % 40)}' if i % 3 else "plain", str(i * 2)] for i in range(400)]
    text = "".join(f'{a},"{b}",{c}\r\n' if i else f"{a},{b},{c}\r\n" for i, (a, b, c) in enumerate(rows))
    (tmp_path / "a.csv").write_bytes((text + "\r\n").encode())
    (tmp_path / "b.csv").write_bytes(b'1;2;3\n4;5\n"6;\n7";8;9;10')
    want = list(csv.reader(text.splitlines(keepends=True)))
    conf = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = D.read_large_delimited(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    a = sorted((r for r in got if r["file"].endswith("a.csv")), key=lambda r: r["row_no"])
    assert [r["cells"] for r in a] == want[1:] and a[0]["header"] == ["id", "note", "n"] and not any(r["ragged"] for r in a)
    b = sorted((r for r in got if r["file"].endswith("b.csv")), key=lambda r: r["row_no"])
    assert [(r["cells"], r["ragged"], r["extra_cells"]) for r in b] == [(["1", "2", "3"], False, None), (["4", "5"], True, None), (["6;\n7", "8", "9", "10"], True, ["10"])]


def test_delimiter_by_agreement(spark):
    cases = {'"a;b;c",1\n"d;e;f",2\n': ",", "a;b,c\n1;2\n3;4\n": ";", "a|b\n": None, "x,y;z\n1,2;3\n": ",", "k\tv\n'a,b'\t1\n'c'\t2\n": "\t", "": None}
    got = {r["content"]: r["d"] for r in texts(spark, *cases).select("content", D.sniff_delimiter(F.col("content")).alias("d")).collect()}
    assert got == cases


def test_malformed_lines_are_counted(spark):
    df = texts(spark, '{"a":1}\n{"b":\n{"c":2}', "a,b\n1,2\n1,2\n")
    got = {r["file_id"]: (r["row_count"], r["duplicate_rows"], r["malformed_lines"], r["warnings"]) for r in D.quality_summary(D.read_delimited(df.where("file_id = 1")), J.read_jsonl(df)).collect()}
    assert got == {0: (2, 0, 1, ["malformed_lines"]), 1: (2, 1, 0, ["duplicate_rows"])}
