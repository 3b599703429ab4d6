"""Hand-made inputs with known results."""

from pyspark.sql import functions as F

from lodestar.functions import content as C
from lodestar.functions import values as V
from lodestar.operators import profile as P
from lodestar.operators import sampling as S


def test_analytical_type(spark):
    want = {"001": "string", "-0": "integer", "+5": "number", "1.": "number", ".5": "number", "1e-3": "number", " N/A ": "null", "TRUE": "boolean", "2026-02-30": "string", "2026-02-03": "date", "2026-02-03T10:11:12Z": "date-time", "2026-02-03 25:00": "string", "": "null", None: "null"}
    df = spark.createDataFrame([(k,) for k in want], "v string").select("v", V.analytical_type(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == want


def test_formats(spark):
    rows = [(b"\x89PNG\r\n\x1a\n..", "png"), (b"RIFF0000WEBP", "webp"), (b"0000ftyp0000", "mp4"), (b"\xff\xf3", "mp3"), (b"\x78\x9c", "zlib"), (b"PK\x05\x06", "zip"), (b"", None), (None, None), (b"\x00\xff\x00\x01", None)]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, n) for b, n in rows], "b binary, n string")
    assert all(r["n"] == r["f"] for r in df.select("n", C.detect_format(F.col("b"))["name"].alias("f")).collect())
    hidden = bytes(x ^ 0x5A for x in b"\x89PNG\r\n\x1a\n")
    assert spark.createDataFrame([(bytearray(hidden),)], "b binary").select(C.xor_image_key(F.col("b"))).first()[0] == 0x5A


def test_text_kinds(spark):
    rows = [('[{"a":1}]', "json"), ("{broken", "text"), (" <!DOCTYPE html><p>", "html"), ("<r><a/></r>", "xml"), ("<r>", "text"), ("", "text")]
    df = spark.createDataFrame(rows, "t string, k string")
    assert all(r["k"] == r["c"] for r in df.select("k", C.classify_text(F.col("t")).alias("c")).collect())


def test_names(spark):
    rows = [("../../outside.dat", "outside.dat"), ("C:\\secret\\windows.dat", "windows.dat"), ("<script>.dat", "<script>.dat"), ("", "unnamed"), (None, "unnamed")]
    df = spark.createDataFrame(rows, "n string, w string")
    assert all(r["w"] == r["d"] for r in df.select("w", V.display_name(F.col("n")).alias("d")).collect())


def test_greedy_quota(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([4, 2, 1, 4])] + [("b", 0, 9)], "o string, i long, s long")
    got = {(r["o"], r["i"]): r["accepted"] for r in S.greedy_quota(df, "o", "i", "s", 5).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("a", 3): False, ("b", 0): False}


def test_spread_rounds_half_to_even(spark):
    got = spark.range(1).select(S.spread(F.lit(6), 3).alias("a"), S.spread(F.lit(2), 3).alias("b"), S.spread(F.lit(5), 1).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == ([0, 2, 5], [0, 1], [2])


def test_fingerprint_ignores_rows(spark):
    one = spark.createDataFrame([(20,)], "temperature int")
    assert P.schema_fingerprint(one).first() == P.schema_fingerprint(one.union(one)).first()


def test_empty_profile(spark):
    assert P.column_profile(spark.createDataFrame([], "a int, b string")).count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "a string")
    got = P.column_profile(nulls).first()
    assert (got["role"], got["types"], got["null_count"]) == ("measure", "null", 2)


def test_images_under_a_key(spark):
    hide = lambda b, k=0x2B: bytes(x ^ k for x in b)
    rows = [(hide(b"\x89PNG\r\n\x1a\nrest"), 0x2B), (hide(b"GIF87a...."), 0x2B), (hide(b"RIFF0000WEBPVP8 "), 0x2B), (hide(b"RIFF0000WAVEfmt "), None), (hide(b"\xff\xd8\xff\xe0JFIF\xff\xd9"), 0x2B)]
    rows += [(hide(b"\xff\xd8\xff\xe0JFIF...."), None), (b"\x89PNG\r\n\x1a\nrest", None), (hide(b"\x89PNG"), None), (b"\xee\xc9\xee plain text", None), (b"", None), (None, None)]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, k) for b, k in rows], "b binary, k int")
    assert all(r["k"] == r["f"] for r in df.select("k", C.xor_image_key(F.col("b")).alias("f")).collect())


def test_html_text(spark):
    import html

    page = "<html><head><title>A &amp; B&#33;</title><style>p{}</style><script>var x = '<b>';</script></head><!-- no --><body><p>one&nbsp;&lt;tag&gt; &copy 2 &#x1F600; &bogus; &amp;quot;</p>two</body></html>"
    got = spark.createDataFrame([(page,), ("",), (None,), ("plain & simple &",)], "h string").select(C.html_title(F.col("h")).alias("title"), C.html_text(F.col("h")).alias("text")).collect()
    assert got[0]["title"] == "A & B!" and got[0]["text"] == "A & B! one\u00a0<tag> \u00a9 2 \U0001f600 &bogus; &quot; two"
    assert (got[1]["text"], got[2]["text"], got[3]["text"]) == ("", None, "plain & simple &")
    bits = ["&amp;", "&lt", "&#65;", "&#x42", "&eacute;", "&notit;", "&zz;", "& ", "x", "&#0;", "&copyx", "&apos;", "&lbrace;", "&#150;", "&#x96;", "&#1;", "&#xFFFE;", "&#99999999999;", "&#xD800;", "&#013;", "&#129;", "&NotEqualTilde;", "&#x;", "&#;", "&;"]
    texts = ["".join(bits[(i * 7 + k * k) % len(bits)] for k in range(6)) for i in range(120)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.unescape_html(F.col("t")).alias("u")).collect()
    assert all(r["u"] == html.unescape(r["t"]) for r in rows)


def test_drift_at_the_tail(spark):
    df = spark.range(100_100).select("id", F.when(F.col("id") < 100_000, "2").otherwise("not_numeric").alias("v"))
    got = S.drift(df, "id", V.analytical_type(F.col("v"))).first()
    assert (got["head"], got["middle"], got["tail"], got["drifted"]) == (["integer"], ["integer"], ["integer", "string"], True)
    same = S.drift(df.where("id < 1000"), "id", V.analytical_type(F.col("v"))).first()
    assert not same["drifted"] and same["tail"] == ["integer"]
    assert S.drift(df.limit(0), "id", F.col("v")).first()["drifted"] is False


def test_cursor(spark):
    got = S.cursor_page(spark.range(10), "id", 3, 4).collect()
    assert [(r["id"], r["truncated"], r["next_cursor"]) for r in got] == [(i, True, 7) for i in (4, 5, 6, 7)]
    assert [r["next_cursor"] for r in S.cursor_page(spark.range(10), "id", 7, 4).collect()] == [None, None]


def test_profile_shuffles_few_bytes(spark):
    """Short values and one number a value travel, no digests and no names; long values that differ stay different."""
    from hashlib import sha256

    def written():
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    df = spark.range(40000).selectExpr("id AS a_long_name_of_a_key", "id * 7.25D AS another_long_name", "string(id % 3 = 0) AS flag")
    start = written()
    got = {r["column"]: tuple(r)[1:] for r in P.column_profile(df).collect()}
    assert got == {"a_long_name_of_a_key": (40000, 0, 0.0, 40000, "integer", "identifier", True), "another_long_name": (40000, 0, 0.0, 40000, "number", "measure", False), "flag": (40000, 0, 0.0, 2, "boolean", "dimension", False)}
    assert 0 < written() - start < 40 * 80000
    long = ["x" * 31, "x" * 32, "x" * 33, "é" * 15, "é" * 16, sha256(b"x" * 32).hexdigest(), sha256(b"x" * 32).hexdigest()]
    assert P.column_profile(spark.createDataFrame([(v,) for v in long], "v string")).first()["distinct_count"] == 6
