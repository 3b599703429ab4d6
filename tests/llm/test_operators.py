"""The ten operators against brute force, and on nulls, empty tables, ties and clashing columns."""

import binascii
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import chat, common, embeddings, line_dedup, mixing, order_minhash, packing, quality, simhash, token_counts, toxicity
from lodestar.llm.common import connected_components
from lodestar.llm.tokens import open_vocabulary, vocabulary_path

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (5, "a b c d. " * 4000, "en", "s", 36000), (6, "  \n\n ", None, "t", 5)]
    return spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("x")).withColumn("_id", F.lit("y")).withColumn("component", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_vocabulary_matches_its_json_form():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    v = open_vocabulary(vocabulary_path())
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice([" ", "\n", "a", "é", "😀", "1", "'s", "\t", "  ", "!", "\x85", "<|endoftext|>", "<|", "|>"]) for _ in range(rng.randint(0, 25)))
        e = t.encode(text, add_special_tokens=False)
        assert v.encode(text).tolist() == e.ids
        assert v.token_starts(text).tolist() == [a for a, _ in e.offsets]
    assert v.encode("a<|endoftext|>b").tolist() == [64, 50256, 65]


def check_pieces(rows, texts):
    v = open_vocabulary(vocabulary_path())
    seqs, per = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        per.setdefault(r["doc_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in texts.items():
        ids = np.append(v.encode(text or ""), np.array([0], "<u4"))
        at = 0
        for r in sorted(per[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == binascii.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(seqs), sum(r["length"] for r in rows)


def test_packing(docs, spark):
    rows = packing.digest(packing.pack(docs)).collect()
    n, tokens = check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert n * 1024 < tokens * 1.02
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_odd(odd):
    rows = packing.digest(packing.pack(odd.dropDuplicates(["doc_id"]))).collect()
    check_pieces(rows, {1: None, 2: "", 3: "one", 4: "one", 5: "a b c d. " * 4000, 6: "  \n\n "})
    assert packing.pack(odd).count() == len(rows) + 1


def test_differencing_is_balanced():
    rng = random.Random(2)
    sizes = [rng.randint(1, 128) for _ in range(900)]
    dealt = packing.differencing(sizes, 60)
    assert sorted(i for w in dealt for i in w) == list(range(900))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert max(sums) - min(sums) <= 8
    assert all(sum([700, 700, 700][i] for i in w) <= 1024 for w in packing.pack_batch([700, 700, 700], 1024))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, odd, rule):
    v = open_vocabulary(vocabulary_path())
    for table in (docs, odd.dropDuplicates(["doc_id"])):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        got = {}
        for r in token_counts.count_tokens(table, rule=rule).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for i, text in texts.items():
            assert abs(sum(r["n_tokens"] for r in got[i]) - len(v.encode(text))) < 1e-5
            assert "".join(text[r["start_char"] : r["end_char"]] for r in sorted(got[i], key=lambda r: r["section"])) == text
            starts = v.token_starts(text).tolist()
            nexts = [next((s for s in starts[k:] if s > a), len(text)) for k, a in enumerate(starts[:400])]
            for r in got[i][:50]:
                low, high = r["start_char"], r["end_char"]
                if rule == "first":
                    assert r["n_tokens"] == sum(low <= s < high for s in starts)
                elif len(starts) <= 400:
                    last = [low <= max(b - 1, a) < high for a, b in zip(starts, nexts)]
                    if rule == "last":
                        assert r["n_tokens"] == sum(last)
                    else:
                        lines = lambda a, b: 1 + text.count("\n", a, max(b - 1, a))
                        assert abs(r["n_tokens"] - sum(1 / lines(a, b) for a, b in zip(starts, nexts) if a < high and max(b, a + 1) > low)) < 1e-6


def test_token_counts_fields(spark):
    df = spark.createDataFrame([(1, "head line", None, "body text")], "doc_id long, a string, b string, c string")
    got = token_counts.count_tokens(df, fields=("a", "b", "c")).collect()
    assert [r["section"] for r in got] == [0, 1, 2] and sum(r["n_tokens"] for r in got) == got[0]["doc_tokens"]


def cleaned(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        lines = [x for x in re.split(r"(?<=\n)|(?<=[.!?,;:] )", text) if x]
        bare = [x.replace("\n", " ").strip(" ") for x in lines]
        windows = [tuple(bare[k : k + 3]) for k in range(len(bare) - 2)] if len(bare) > 2 else [tuple(bare)] * bool(bare)
        gone = set()
        for k, w in enumerate(windows):
            if first.setdefault(w, (i, k)) != (i, k):
                gone |= set(range(k, min(k + 3, len(bare))))
        out[i] = "".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(docs, spark):
    planted = spark.createDataFrame([(10**6, "A b. C d. E f. New one. A b. C d. E f. ", "en", "s", 1), (10**6 + 1, "X y. A b. C d. E f. Z\ue000 z. ", "en", "s", 1), (10**6 + 2, "", "en", "s", 0)], DOCS)
    both = docs.unionByName(planted)
    want = cleaned([(r["doc_id"], r["text"]) for r in both.collect()])
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(both).collect()}
    assert got == want
    assert got[10**6 + 1] == "X y. Z\ue000 z. "


def test_line_dedup_finds_passages_inside_paragraphs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: "".join(word() + (rng.choice([". ", ", ", "; "]) if k % 9 == 8 else " ") for k in range(n))
    passage = prose(70)
    rows = [(i, prose(40).strip() + " " + passage.strip() + " " + prose(40)) for i in range(6)] + [(9, prose(90))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    middle = " ".join(passage.split()[20:50])
    assert middle in got[0] and not any(middle in got[i] for i in range(1, 6)) and got[9] == rows[6][1]


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 30000}" for i in range(60000))
    (r,) = line_dedup.line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["_n_lines"] == 60000 and r["_n_removed"] == 30000  # the window over the seam is new, but its lines belong to repeated ones, too


def test_line_dedup_odd(odd):
    done = line_dedup.line_dedup(odd)
    assert done.columns == odd.columns + ["_n_lines", "_n_removed"]
    got = {r["doc_id"]: r for r in done.collect()}
    assert got[1]["text"] is None and got[3]["text"] == "one" and got[4]["text"] == ""
    assert done.count() == 7 and line_dedup.line_dedup(odd.limit(0)).count() == 0


def union_find(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.split("[\x20\x09-\x0d]+", text) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_brute_force(spark, docs, odd):
    texts = spark.createDataFrame([(1, "A  b\x0bC d\x1ce\x85f\u00a0g h É é ÉÉ"), (2, "x\ty"), (3, "ß " * 70), (4, None)], "doc_id long, text string")
    for df in (docs.limit(100), odd, texts):
        want = [(r["doc_id"], f"{brute_fingerprint(r['text'] or ''):016x}") for r in df.collect()]
        got = simhash.fingerprints(df).select("doc_id", simhash.hexadecimal(F.col("fingerprint"))).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_simhash_links_by_brute_force(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)}
    for f in list(fps)[:20]:  # dense and chained neighbourhoods
        g = np.int64(f)
        for _ in range(12):
            g = g ^ np.int64(1 << int(rng.integers(0, 62)))
            fps.add(int(g))
    fps = sorted(fps)
    v = np.array(fps, np.int64).view(np.uint64)
    pairs = [(i, j) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= 2) + i + 1]
    want = union_find(range(len(v)), pairs)
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, node long")
    found = simhash.links(nodes).collect()
    assert sorted((min(r), max(r)) for r in map(tuple, found)) == sorted(pairs)
    got = dict.fromkeys(range(len(v))) | {r["node"]: r["component"] for r in connected_components(simhash.links(nodes)).collect()}
    assert {k: k if c is None else c for k, c in got.items()} == want


def test_near_copies_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "one two", "One  two"]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(30, 120)))]
        for edits in (0, 0, 1, 1, 2, 3, 4):  # scattered edits: similarities on both sides of 0.8
            w = list(base)
            for at in rng.integers(0, len(w), edits):
                w[at] = "edit"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert any(simhash.fingerprint(texts[i] or "") != simhash.fingerprint(texts[j] or "") for i, j in pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["node"]: r["component"] for r in simhash.near_copies(docs).collect()}
    assert got == union_find(range(len(texts)), pairs)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_exploded_tables_are_not_broadcast(docs, monkeypatch):
    """Spark sizes a table after an explode as before it; at the size where it then broadcasts, the driver holds every row."""
    plans, keep = [], common.keep

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(simhash, "keep", watched)
    monkeypatch.setattr(common, "keep", watched)
    nodes = simhash.fingerprints(docs).groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("node"))
    met = simhash.links(nodes)
    simhash.near_classes(docs)
    joined = [p.split("\n") for p in plans if "Generate" in p and "Join" in p]
    assert len(joined) == 2 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    for lines in joined:
        depth = [re.search(r"\w", x + "x").start() for x in lines]
        for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("Generate" in x for x in lines[i:below])


def test_simhash_odd(odd):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_classes(odd).collect()}
    by = {i: c for i, _, c in got}
    assert by[1] == by[2] == by[6] == 1 and by[3] == by[4] == 3
    assert simhash.simhash_classes(odd).count() == 7
    assert simhash.fingerprint("One  TWO\tthree") == simhash.fingerprint("one two three") != simhash.fingerprint("ÉÈ two three")


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 8))
    rows = [(i, (base[i % 40] + rng.normal(scale=0.12, size=8)).tolist(), int(i % 2)) for i in range(400)]
    rows += [(500 + i, rows[0][1], 0) for i in range(3)]
    rows += [(600, None, 0), (601, [0.0] * 8, 0), (602, [float("nan")] * 8, 0), (603, rows[0][1], None), (604, [1.0], 0), (605, [], 0), (606, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    ok = [r for r in rows if r[2] is not None and r[0] not in (600, 601, 602, 604, 605, 606)]
    pairs = []
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2]:
                x, y = np.array(ok[a][1]), np.array(ok[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    pairs.append((ok[a][0], ok[b][0]))
    want = union_find([r[0] for r in rows], pairs)
    for block in (16, 768):
        got = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=block, centre_rows=64).collect()}
        assert len(got) == len(rows)
        for i in want:
            assert (got[i]["n_links"], got[i]["component_id"]) == (sum(i in p for p in pairs), want[i])
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_order_minhash(docs, odd):
    got = {r["doc_id"]: r for r in order_minhash.edit_sensitivity(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    for k, (i, a) in enumerate(rows):
        b, h = rows[(k + 1) % len(rows)][1], len(a) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest()
    fps = {}
    for i, a in rows:
        assert fps.setdefault(a, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.05
    assert order_minhash.edit_sensitivity(odd).count() == 7 and order_minhash.edit_sensitivity(odd.limit(0)).count() == 0


def spark_hash(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(4, "little") if 0 <= v < 1 << 20 else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_sketch(text):
    h = [spark_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    grams = [spark_hash(*h[i : i + 5]) for i in range(len(h) - 4)] or ([spark_hash(*h)] if h else [])
    seen, bins = {}, {}
    for at, g in enumerate(grams):
        nth = seen[g] = seen.get(g, -1) + 1
        g = spark_hash(g, nth) if nth else spark_hash(g)
        bins.setdefault(g >> 58, []).append((g, at))
    out = []
    for b, members in sorted(bins.items()):
        chosen = sorted(sorted(members)[:2], key=lambda m: m[1])
        out.append(((b + 32) << 32) + (spark_hash(*[g for g, _ in chosen]) & 0xFFFFFFFF))
    return out


def test_order_minhash_by_brute_force(docs, spark):
    odd = spark.createDataFrame([(-(2**63), "x " * 300), (2**63 - 1, "nospace" * 200), (2**62, "a b\tc"), (None, "one two"), (2**40, ""), (2**40, None)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    sketches = [set(brute_sketch(t)) for _, t in rows]
    like = lambda a, b: len(a & b) / len({x >> 32 for x in a | b}) if a | b else 1.0
    want = []
    for k, (i, t) in enumerate(rows):
        n, half, after = (k + 1) % len(rows), len(t) // 2, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - half] + after[:half]
        want.append((i, hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:010x}" for x in brute_sketch(t)), like(sketches[k], set(brute_sketch(edited))), like(sketches[k], sketches[n])))
    got = [tuple(r) for r in order_minhash.edit_sensitivity(table).select("doc_id", "edited_sha256", "fingerprint", "near_edited", "near_next").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_order_minhash_ranges_follow_the_ids(spark):
    ids = [*range(3000), 2**40, -(2**50)]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    sizes = [r["count"] for r in order_minhash._ranges(df, "doc_id", 100).groupBy("_block").count().collect()]
    assert max(sizes) <= 400
    got = {r["doc_id"]: r["next_doc"] for r in order_minhash.followed(df, lambda d: d.withColumn("doc", F.col("doc_id")), rows_per_range=100).collect()}
    down = sorted(ids, reverse=True)
    assert got == dict(zip(down, [*down[1:], down[0]]))


def test_order_minhash_sees_order_and_repeats(spark):
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[150:] + words[:150])), (3, " ".join(words[:290])), (4, "a " * 500), (5, "a " * 480)], "doc_id long, text string")
    s = order_minhash.order_minhash(df).alias("a").crossJoin(order_minhash.order_minhash(df).alias("b")).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), order_minhash.likeness(F.col("a.sketch"), F.col("b.sketch")).alias("l"))
    near = {(r["x"], r["y"]): r["l"] for r in s.collect()}
    assert near[1, 1] == 1 and near[1, 3] > near[1, 2] > 0 and 0 < near[4, 5] < 1


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    unseen = F.pmod("doc_id", F.lit(2)) == 0
    got = quality.resample(docs, labels.where(~unseen)).join(labels.where(unseen), "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert np.mean([r["selected"] for r in good]) > 0.97 and np.mean([r["selected"] for r in bad]) < 0.05
    keys = sorted((r["gumbel_key"] for r in quality.resample(docs, labels, k=100).where("selected").collect()))
    assert len(keys) == 100 and keys[0] == sorted(r["gumbel_key"] for r in quality.resample(docs, labels).collect())[-100]


def brute_buckets(text):
    """A bucket's number for every n-gram, counted on its own."""
    w = text.split()
    fold = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
    shape = lambda x: "".join(c for k, c in enumerate(map(fold, x)) if k == 0 or fold(x[k - 1]) != c)
    a, s = [zlib.crc32(x.encode()) % 16384 for x in w], [zlib.crc32(shape(x).encode()) % 1024 for x in w]
    out = [*a, *[32768 + x for x in s]]
    for k in range(len(w) - 1):
        same = (a[k], s[k]) == (a[k + 1], s[k + 1])
        out += [16384 + (0 if same else (a[k] * 40503 + a[k + 1] * 2654435761) % 16383 + 1), 33792 + (s[k] * 31 + s[k + 1] * 1009) % 1024]
    return out


def test_quality_by_brute_force(docs, spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    texts, known = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    judge = {r["doc_id"]: r["j"] for r in labels.select("doc_id", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)) == 0).alias("j")).collect()}
    raw, target = np.zeros(34816), np.zeros(34816)
    for i, text in texts.items():
        for b in brute_buckets(text):
            raw[b] += 1
            target[b] += known.get(i) == 1 and not judge[i]
    ratio = np.zeros(34816)
    for low, high in ((0, 16384), (16384, 32768), (32768, 33792), (33792, 34816)):
        r, t = raw[low:high] * target[low:high].sum() / raw[low:high].sum(), target[low:high]
        ratio[low:high] = np.log((t + 1) / (t + 1).sum()) - np.log((r + 1) / (r + 1).sum())
    for scale in (1.0, 50.0):
        got = {r["doc_id"]: r for r in quality.resample(docs, labels, k=20, temperature=scale).collect()}
        for i, text in texts.items():
            assert abs(got[i]["log_ratio"] - ratio[brute_buckets(text)].sum()) < 1e-4
        noise = {i: r["gumbel_key"] - r["log_ratio"] / scale for i, r in got.items()}
        assert -4 < min(noise.values()) and abs(np.mean(list(noise.values())) - 0.5772) < 0.4
        best = sorted(got, key=lambda i: -got[i]["gumbel_key"])[:20]
        assert {i for i, r in got.items() if r["selected"]} == set(best)


def test_quality_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(odd, none).count() == 7
    assert quality.resample(odd, none, k=500).where("selected").count() == 7
    assert quality.resample(odd.limit(0), none, k=5).count() == 0
    assert quality.resample(odd.limit(0), none).count() == 0
    some = spark.createDataFrame([(3, 1, None), (5, 0, None), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.resample(odd, some).count() == 7


def test_toxicity(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(labels, "doc_id", "left_semi")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 1]) > 0.8
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 0]) < 0.05
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, none).where("predicted = 0 and score between 0 and 1").count() == 7


def test_toxicity_tolerates_gaps():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8)))
    text = lambda bad: " ".join([word() for _ in range(30)] + ["wretchpig"] * bad)
    m = toxicity.fit([(i % 2, text(i % 2)) for i in range(400)])
    plain, gapped, clean = m.scores(["so wretchpig it is", "so wre-tch.pig it is", "so it is " + text(0)])
    assert plain > 0.5 and gapped > 0.3 and clean < 0.3


def test_toxicity_kernel_by_brute_force():
    words = ["banana", "wretchpig", "aaaa", "xyz", "ab", "über", "b-an-a n.a"]

    def phi(w):
        c, out = toxicity.letters([w])[0], {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + 6)):
                    if c[i] and c[j] and c[k]:
                        out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + 0.7 ** (k - i - 1)
        return out

    dot = lambda a, b: sum(v * b.get(t, 0) for t, v in a.items())
    maps = [phi(w) for w in words]
    want = np.array([[dot(a, b) / np.sqrt((dot(a, a) + 1e-12) * (dot(b, b) + 1e-12)) for b in maps] for a in maps])
    c = toxicity.letters(words)
    marks = toxicity.features(c)
    assert np.allclose(toxicity.kernel(c, marks), want, atol=1e-6) and np.allclose(toxicity.project(c, marks[0]), want[:, 0], atol=1e-6)
    assert np.allclose(np.diag(want)[[0, 1, 2, 3, 5, 6]], 1, atol=1e-6)
    assert "idiot" in toxicity.units("an id io t") or "anidiot" in toxicity.units("an id io t")
    assert toxicity.units("x" * 100) and not toxicity.units("")


def test_chat_odd(spark):
    rows = [(None, None, None, None), (None, 1, "user", "b"), (7, None, "assistant", "late"), (7, None, "assistant", "late"), (8, 1, "assistant", "</s>long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ordinal", F.lit("x")).withColumn("segment", F.lit(2))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert (got[None]["n_turns"], got[7]["n_turns"], got[7]["loss_chars"], got[8]["loss_chars"]) == (2, 2, 8, 9 * 200_000)


def test_toxicity_empty(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd.limit(0), none).count() == 0


def test_chat(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "[ROLE ", "]", "\\", "<", "/s>", "a", " ", "\n", "<\\/s>", "[\\INST]", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys]\\", None, ""]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(9))])) for c in range(60) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    whole = {}
    for r in sorted(segments.collect(), key=lambda r: (r["conv_id"], r["ordinal"])):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
    for c in got:
        turns = [(r or "", t or "") for k, _, r, t in sorted(rows, key=lambda x: x[:2]) if k == c]
        assert [x[:2] for x in chat.parse(whole[c])] == turns
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["loss_sha256"], got[c]["loss_chars"], got[c]["formatted_chars"]) == (hashlib.sha256(said.encode()).hexdigest(), len(said), len(whole[c]))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_mixing(docs, odd, spark):
    got = mixing.mix(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - sum(r["size"] for r in got)) < 1e-3
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9
    assert mixing.mix(odd).count() == 7 and mixing.mix(odd.limit(0)).count() == 0
    at = mixing.positions(mixing.mix(docs)).collect()
    assert [r["position"] for r in at] == sorted(r["position"] for r in at) and len(at) == sum(r["copies"] for r in got)
    for s, tilt in ((0, 0.5), (2, 2.0)):  # half of the demand is met at the time the integral says
        own = [r for r in at if r["ord"] == s]
        early = sum(r["size"] for r in own if r["position"] <= 0.5) / sum(r["size"] for r in own)
        assert abs(early - (2 / (1 + tilt) * 0.5 + (tilt - 1) / (1 + tilt) * 0.25)) < 0.25
    assert mixing.curriculum(docs).columns == docs.columns


def test_mixing_query_in_training_order(docs, spark):
    from lodestar.llm import queries

    first, every = {}, {}
    for r in mixing.positions(mixing.mix(docs)).collect():
        first.setdefault(r["doc_id"], r["position"])
        every.setdefault(r["doc_id"], []).append(r["position"])
    got = [r["doc_id"] for r in queries.op10_mixing(spark, DIR).collect()]
    taken = [i for i in got if i in first]
    assert taken == got[: len(taken)] and len(got) == docs.count()
    assert [first[i] for i in taken] == sorted(first.values())
    listed = {r["doc_id"]: r["positions"] for r in mixing.training_order(mixing.mix(docs)).where("copies > 0").collect()}
    assert listed == every


def test_components(spark):
    hub = [(300, 200 + i) for i in range(90)] + [(i, 400) for i in (250, 260)]  # above the size of a hub
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)] + hub, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in [*range(200, 290), 300, 400]}


def test_toxicity_sigmoid_converges():
    rng = np.random.default_rng(3)
    for spread in (0.1, 3.0, 50.0):
        x = np.concatenate([rng.normal(-spread, 1, 800), rng.normal(spread, 1, 60)])
        goal = np.repeat([0.02, 0.98], [800, 60])
        a, b = toxicity._sigmoid(x, goal)
        gap = 1 / (1 + np.exp(-(a * x + b))) - goal
        assert a > 0 and abs(np.mean(gap * x)) < 1e-3 * spread + 1e-3 and abs(np.mean(gap)) < 1e-3
