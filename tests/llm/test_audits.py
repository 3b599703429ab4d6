"""Top-k search, Merkle manifest and filter audit against plain loops, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import filter_audit as A
from lodestar.llm import max_score as M
from lodestar.llm import merkle as K

# ---- op11 ----------------------------------------------------------------------------------------------------------


def brute_top(rows, k, scale=256):
    good = [(i, v) for i, v in enumerate(rows) if v[1] is not None and all(x is not None and math.isfinite(x) for x in v[1])]
    whole = [(i, r[0], [max(-(2**63), min(2**63 - 1, math.floor(scale * x))) for x in r[1]]) for i, r in good]
    out = []
    for i, q, a in whole:
        if q is not None and q % 50 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), c is None, c or 0) for j, c, b in whole if j != i and len(a) == len(b))
            out += [(q, n + 1, None if none else c, -s) for n, (s, none, c) in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_top_scores_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # ties: copies of a query
    rows += [(0, [0.5] * 8), (50, rows[3][1]), (None, rows[50][1]), (2000, None), (2050, [1.0, None, *[0.0] * 6]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8)]
    rows += [(3000, []), (3001, []), (3050, [1.5, -2.0]), (3051, [1e9, 3.0]), (3100, [1e18, 1e18, 2.0]), (3101, [-1e18, 7.0, 1.0]), (3102, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", i) for i, v in rows], "vec_id long, embedding array<double>, id string, row long")
    for options in ({}, {"shards": 3, "query_block": 2}, {"shards": 2, "shard_rows": 50}):
        got = M.top_scores(df, F.col("vec_id") % 50 == 0, **options)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(rows, 5)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "int", "bigint", "bigint"]
    assert M.top_scores(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert M.top_scores(df.where("vec_id = 0"), F.lit(True), k=9).count() == 2  # two rows of one id, each the other's


def test_non_essential_lists_are_left_out():
    """On sparse vectors only a small part of all pairs is still competitive, and the results are whole."""
    rng = np.random.default_rng(2)
    x = np.where(rng.random((4000, 32)) < 0.1, np.floor(rng.exponential(40, (4000, 32))), 0.0)
    queries = x[:40]
    scores = queries @ x.T
    floor = np.sort(scores, axis=1)[:, -5]
    i, j, s = M.competitive(queries, M.Postings(x), np.arange(4000), floor)
    assert (s == scores[i, j]).all() and set(zip(i, j)) == set(zip(*np.nonzero(scores >= floor[:, None])))
    bounds = np.sort(M.Postings(x).bounds(queries), axis=1)
    few = (np.cumsum(bounds, axis=1) < floor[:, None]).sum(axis=1)
    assert few.mean() > 16  # more than half of the terms are non-essential
    i, j, s = M.shard_top(queries, np.arange(40), x, np.arange(4000), np.arange(4000), 5)
    np.fill_diagonal(scores[:, :40], -1)
    assert [sorted(s[i == q].tolist()) for q in range(40)] == [sorted(np.sort(r)[-5:].tolist()) for r in scores]


# ---- op12 ----------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb_of(nodes, place, start):
    """Root, siblings and folded digest of one leaf, level by level."""
    siblings, folded = [], start
    while len(nodes) > 1:
        run = place // 3 * 3
        before, after = nodes[run:place], nodes[place + 1 : run + 3]
        siblings += [*before, *after]
        folded = h(*before, folded, *after)
        nodes, place = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], place // 3
    return nodes[0], siblings, folded


def brute_manifest(docs):
    by_source, out = {}, []
    for r in docs:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    subroots = [climb_of([leaf(r) for r in trees[s]], 0, "")[0] for s in sources]
    for at, s in enumerate(sources):
        leaves = [leaf(r) for r in trees[s]]
        for i, r in enumerate(trees[s]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            found = (*r[:4], r[4].replace("\n", "")) if hit else r
            subroot, low, folded = climb_of(leaves, i, leaf(found))
            root, high, folded = climb_of(subroots, at, folded)
            out.append((r[0], leaves[i], subroot, root, h(*low, *high), folded, folded == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", tree string")
    return sorted((tuple(r) for r in K.document_manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(1)
    sources = ["hot"] * 6 + ["é", "a", "", None, "lone"]
    docs = [(i, rng.choice(sources[:10]), rng.choice(["en", None]), rng.choice([0, 12, None]), rng.choice(["a\nb", "", None, "plain é", "x\n" * 50])) for i in range(900)]
    docs += [(5000, "lone", "en", 1, "one\n"), (None, "a", None, None, "no\nid"), (7, "a", "en", 3, "again"), (7, "a", "en", 3, "again")]
    rng.shuffle(docs)
    got = manifest(spark, docs)
    assert got == brute_manifest(docs) and {r[-1] for r in got} == {True, False}


def test_small_manifests(spark):
    for n in (1, 2, 3, 4, 10):
        docs = [(i, "s", "en", 1, "t\n") for i in range(n)]
        assert manifest(spark, docs) == brute_manifest(docs)
    assert K.document_manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_levels_meet_in_several_steps(spark):
    """Three levels a node row: 800 leaves take three steps, and the tree above more than one."""
    docs = [(i, "hot" if i % 4 else f"s{i % 160}", "en", 1, f"t\n{i}") for i in range(1000)]
    df = spark.createDataFrame(docs, DOCS)
    fields = lambda text: K.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = K.manifest(df, fields(F.col("text")), F.when(odd, fields(F.replace("text", F.lit("\n"), F.lit("")))), levels=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(docs)


# ---- op13 ----------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    fails, out = [], {}
    for i, (d, lang, text) in enumerate(docs):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        bad |= {"E"} if d is not None and any(e is not None and e < d and (t or "") == text for e, _, t in docs) else set()
        fails.append((lang or "", bad, any(x == d and q == 1 for x, q, _ in labels if d is not None), any(x == d and t == 1 for x, _, t in labels if d is not None)))
    for part in {f[0] for f in fails}:
        mine, shapley = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                gone = lambda bad: bool(bad & set(order[:step]))  # noqa: B023, E731
                removed = [x for x in mine if f in x[1] and not gone(x[1])]
                shapley[f] += len(removed)
                kept = sum(not gone(x[1]) and f not in x[1] for x in mine)
                out[part, order, step + 1] = [kept, len(removed), sum(f in x[1] and gone(x[1]) for x in mine), sum(x[1] == {f} for x in mine), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, lang string, text string, row int, part string")
    lab = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, lang string")
    return {(r[0], r[1], r[2]): list(r[3:]) for r in A.audit(df, lab).collect()}


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = [" ".join(word() for _ in range(250)), "a " * 300, "UPPER case # text", "", None, "\x0b\x0c \t", "x" * 5000, " ".join(f"W{i}" for i in range(210)), "lone &"]
    texts += [" ".join(f"w{i}" for i in range(199)), " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200))]
    docs = [(i, rng.choice(["en", "fr", "", None]), rng.choice(texts)) for i in range(150)]
    docs += [(200 + i, "hot", "copy") for i in range(100)] + [(7, "en", "copy"), (None, "en", "copy"), (None, None, None), (3, "fr", docs[3][2])]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 260, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    labels = [(d, int(q), int(t)) for d, q, t in labels]
    got = audit(spark, docs, labels)
    assert got == brute_audit(docs, labels) and len(got) == 600 * 4


def test_audit_without_failures_or_rows(spark):
    docs = [(i, "en", " ".join(f"w{i}x{j}" for j in range(220))) for i in range(3)]
    got = audit(spark, docs, [(1, 1, 0)])
    assert len(got) == 600 and all(v == [3, 0, 0, 0, 0, 0, 0] for v in got.values())
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert A.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_operators_keep_their_general_interface(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "q"), (2, [0.9, 0.1], "c"), (3, [0.0, 1.0], "c")], "id long, v array<double>, kind string")
    got = M.top_scores(df, F.col("kind") == "q", k=1, scale=10, id_col="id", vector_col="v").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 90)]
    nodes, roots = K.build(spark.createDataFrame([(0, i, h(str(i)), 5) for i in range(5)], "tree long, pos long, node string, n long"), fan=2, levels=1)
    assert roots.count() == 1 and json.loads(nodes.where("step = 0 and pos = 1").select(F.to_json(F.transform("path", lambda p: F.lower(F.hex(p["before"]))))).first()[0]) == [h("0")]
