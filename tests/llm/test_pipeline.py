"""The stages, each on what the one before it kept."""

import corpus_pipeline
from lodestar.llm import quality, simhash
from lodestar.llm.common import table

DIR = "/root/testdata/sf0.001"


def near_groups(docs):
    """Classes of the closure of all pairs with five-word Jaccard similarity of 0.8 or more, by brute force."""
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    group = {i: {i} for i in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and (x == y or len(x & y) >= 0.8 * len(x | y)) and group[a] is not group[b]:
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
    return {frozenset(g) for g in group.values()}


def test_near_copies_of_the_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = near_groups(docs)
    assert any(len(g) > 1 for g in want)
    got = {}
    for r in simhash.near_copies(docs).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert set(map(frozenset, got.values())) == want
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, DIR).collect()}
    assert kept == {min(g) for g in want}


def test_stages(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, DIR)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns and 0 < out.count()
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
        assert ids(out) <= ids(before)
        if name == "quality":
            assert ids(out) == ids(quality.resample(docs, table(spark, DIR, "labels")).where("selected"))
        if name == "simhash":
            assert ids(out) == {min(c) for c in near_groups(before)}
        before = out
    assert corpus_pipeline.run(spark, DIR).count() == before.count()


def test_empty(spark):
    empty = table(spark, DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0


def test_packing_reads_training_order(spark, monkeypatch):
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "packing":
            monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:i], (name, lambda s, docs, d: seen.append(docs) or docs)])
    corpus_pipeline.run(spark, DIR)
    assert "Sort [position" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five six seven "
    rows = [(None, "a " + text, "en", "s", 36), (None, "b " * 30, "en", "s", 60), (None, "b " * 30, "en", "s", 60)]
    rows += [(i, f"w{i} " * 40, "en", "s", 160) for i in (1, 2, 2, 3)]
    docs = spark.createDataFrame(rows, table(spark, DIR, "documents").schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    unlabelled = {"labels": labels}
    chosen = corpus_pipeline.quality.resample(docs, labels).where("selected").count()
    with_labels = corpus_pipeline.table
    corpus_pipeline.table = lambda s, d, name: unlabelled[name]
    try:
        assert corpus_pipeline.select_quality(spark, docs, DIR).count() == chosen == 7
    finally:
        corpus_pipeline.table = with_labels
    near = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.drop_near_copies(spark, docs, DIR).collect()]
    assert sorted(near, key=repr) == sorted([(None, "a"), (None, "b"), (1, "w"), (2, "w"), (2, "w"), (3, "w")], key=repr)
    mixed = corpus_pipeline.mix_sources(spark, docs, DIR)
    assert mixed.count() == 7  # one source: its target is its size, so each row is taken once
