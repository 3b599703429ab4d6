"""Records, rules, membership and progress on small inputs with edge cases."""

import json

from pyspark.sql import functions as F

from lodestar.operators import catalog as K
from lodestar.operators import records as R
from lodestar.operators import rules as Q
from lodestar.operators import sampling as S


def contents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")


def test_jsonl(spark):
    df = contents(spark, '{"a":1}\r\n\n{"b":\n{"c":[1]}\n7\n"x"\nnull\n[2]', '{"a":1}', 'x\n{"a":1}\n{"a":1}', "", None, "\n\n")
    got = R.read_jsonl(df).orderBy("file_id", "line_no").select("file_id", "line_no", F.to_json("record"), "malformed").collect()
    assert [tuple(r) for r in got] == [
        (0, 0, '{"a":1}', False), (0, 2, None, True), (0, 3, '{"c":[1]}', False), (0, 4, '{"value":7}', False),
        (0, 5, '{"value":"x"}', False), (0, 6, '{"value":null}', False), (0, 7, '{"value":[2]}', False),
    ]
    assert R.read_jsonl(df.limit(0)).count() == 0


def brute_envelope(text):
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return None
    if isinstance(v, dict):
        found = next((v[k] for k in ("records", "rows", "data", "events", "items") if isinstance(v.get(k), list)), [v])
    else:
        found = v if isinstance(v, list) else [v]
    return [x if isinstance(x, dict) else {"value": x} for x in found]


def test_json_envelope(spark):
    texts = ['[{"a":1},2,null,[3]]', '{"data":[{"a":1}],"records":"no list"}', '{"items":[1],"rows":[{"r":1}]}', '{"data":{"a":1}}', '{"other":[1]}', '"x"', "null", "[]", '{"records":[]}', "{}", '{"a":', "", None]
    got = contents(spark, *texts).orderBy("file_id").select(F.transform(R.json_envelope(F.col("content")), lambda x: F.to_json(x)).alias("r")).collect()
    assert [r["r"] and [json.loads(x) for x in r["r"]] for r in got] == [brute_envelope(t) for t in texts]


def test_flatten_records(spark):
    df = contents(spark, '{"b":{"c":1},"a":null}', "[1,2]", "3", "{}", None).withColumn("key_of", F.lit("k")).withColumn("v", F.try_parse_json("content")).drop("content")
    got = R.flatten_records(df, "v").collect()
    assert sorted((r["file_id"], r["key"], r["value"], r["key_of"]) for r in got) == [(0, "a", "null", "k"), (0, "b", '{"c":1}', "k")]


def test_windows_prefix_and_sources(spark):
    long = "é" * 5000
    df = contents(spark, long, "x" * 4, "x" * 5, "", None)
    got = R.text_windows(df, "content", 4).orderBy("file_id", "window_no").groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("window_no", "content")))["content"], "").alias("t"), F.count("*").alias("n")).orderBy("file_id").collect()
    assert [tuple(r) for r in got] == [(0, long, 1250), (1, "xxxx", 1), (2, "xxxxx", 2)]
    cut = [tuple(r["b"]) for r in df.orderBy("file_id").select(R.bounded_prefix(F.col("content"), 3).alias("b")).collect()]
    assert [(bytes(p) if p is not None else None, n) for p, n in cut] == [(b"\xc3\xa9\xc3", 10000), (b"xxx", 4), (b"xxx", 5), (b"", 0), (None, None)]
    one, two = (spark.createDataFrame([(k,) for k in ks], "k long") for ks in ([1, 1, 2], [2, 3, None]))
    assert {tuple(r) for r in R.merge_sources([one, two], "k").collect()} == {(1, 1), (2, 1), (3, 2), (None, 2)}


def test_rules_and_totals(spark):
    seen = spark.createDataFrame(
        [(1, "png", 5, "ok", "image", "signature"), (2, "text", 50, "ok", "text", "heuristic"), (3, None, 5, "unsupported", "unknown", "unknown"), (4, None, 0, "empty", "unknown", "unknown"), (5, "json", 5, "corrupt", "text", "heuristic"), (6, "text", None, "ok", "text", "heuristic")],
        "file_id long, detected_type string, file_size long, status string, category string, confidence string")
    assert {tuple(r) for r in Q.rule_table(seen, 10).where("file_id in (2, 3, 6)").collect()} == {(2, "format", "pass"), (2, "coverage", "unknown"), (3, "format", "unknown"), (3, "coverage", "pass"), (6, "format", "pass"), (6, "coverage", "unknown")}
    assert {tuple(r) for r in Q.rule_summary(Q.rule_table(seen, 10)).collect()} == {("format", "pass", 4), ("format", "unknown", 2), ("coverage", "pass", 4), ("coverage", "unknown", 2)}
    assert [r[1] for r in Q.extraction_status(seen, 10).orderBy("file_id").collect()] == ["complete", "partial", "unsupported", "insufficient_data", "failed", "partial"]
    assert tuple(Q.catalog_totals(seen).first()) == (6, 1, 2) and tuple(Q.catalog_totals(seen.limit(0)).first()) == (0, 0, 0)
    assert Q.status_counts(seen).where("category = 'text'").first()["n"] == 3
    assert [tuple(r) for r in Q.schema_groups(seen, ["detected_type", "category"], 2).collect()] == [(None, "unknown", 2), ("text", "text", 2)]


def test_scores_round_halves_up(spark):
    df = spark.createDataFrame([("a", 50.0), ("a", 50.01), ("b", 60.0), ("c", 10.0), ("c", None)], "k string, v double")
    assert {tuple(r) for r in Q.score_rollup(df, "k", "v", 60).collect()} == {("a", 2, 50.01, "needs_review"), ("b", 1, 60.0, "sampled"), ("c", 1, 10.0, "needs_review")}


def test_insert_limits_and_progress(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "b string, f long, note string")
    known, new = rows(("x", 1, "old"), (None, 2, "old")), rows(("x", 1, "new"), (None, 2, "new"), ("y", 1, "new"), ("y", 1, "new"), ("x", None, "new"))
    once = K.insert_if_absent(known, new, ["b", "f"])
    want = {("x", 1, "old"), (None, 2, "old"), ("y", 1, "new"), ("x", None, "new")}
    assert sorted(map(str, once.collect())) == sorted(map(str, K.insert_if_absent(once, new, ["b", "f"]).collect()))
    assert {tuple(r) for r in once.collect()} == want and once.count() == 4
    assert [r["rejection"] for r in S.item_limit(spark.createDataFrame([(5,), (6,), (None,)], "n long"), "n", 5).collect()] == [None, "too_large", None]
    parts = spark.createDataFrame([("u", 1500, 1, "e"), ("u", 1500, 2, None), ("v", 0, 1, None)], "upload_id string, size long, part long, etag string")
    assert {tuple(r) for r in K.transfer_progress(parts, ["upload_id"]).collect()} == {("u", 0.6827), ("v", 1.0)}
