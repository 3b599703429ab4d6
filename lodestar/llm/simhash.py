"""SimHash fingerprints and exact near-duplicate classes by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, connected_components, keep, own_exchange, shuffled, small

SEED = 42
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 2
#: Two linked fingerprints agree in all but RADIUS of these segments at least.
SEGMENTS = 8
WIDTH = 64 // SEGMENTS


def _references(n: int) -> list[int]:
    """Pseudo-random 64-bit reference fingerprints as signed longs, the same in every run."""
    return [int(np.uint64(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7)).astype(np.int64)) for i in range(n)]


#: Enough that a segment is told by its distances to them; more would only widen the table.
PIVOTS = _references(16)


#: Bits of a parity sketch, a power of two, and how many references its distances are measured to.
SKETCH, REFERENCES = 1024, 16


def fingerprint(text: str, words: int = 3, seed: int = SEED) -> int:
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long): a bit is 1 if set in over half of the hashes of all word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = np.fromiter((fingerprint(t.as_py() or "", words) for t in rb.column(1)), dtype=np.uint64, count=rb.num_rows)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def _segment(s: int) -> int:
    return int(np.uint64(((1 << WIDTH) - 1) << (s * WIDTH)).astype(np.int64))


def pivot_distances(fp: Column, segment: int) -> list[Column]:
    """Distances to the references within a segment. Their sum over segments is the distance to the reference."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_segment(segment)))) for p in PIVOTS]


def links(fps: DataFrame) -> DataFrame:
    """(fp, node), fingerprints distinct -> (a, b): the nodes of all pairs within RADIUS bits, each once.

    The distance table of a fingerprint holds, for each segment, its distances to all references. By the triangle
    inequality, two linked fingerprints differ by no more than RADIUS in any coordinate, and in all but two of the
    eight segments by nothing at all; these equal parts of the table are the join key. Pairs are discarded if any full
    coordinate differs by more than RADIUS, and survivors are verified.

    Members of a key differ in two bytes at most, so that no key has more than 65,536 of them, whatever the table's
    size; in groups of near copies almost all pairs that meet are links.
    """
    fp = F.col("fp")
    table = F.array(*[F.xxhash64(*pivot_distances(fp, s)) for s in range(SEGMENTS)])
    chosen = list(combinations(range(SEGMENTS), SEGMENTS - RADIUS))
    key = lambda i, c: F.xxhash64(F.lit(i), *[F.get("t", F.lit(s)) for s in c])
    keyed = fps.select("fp", "node", table.alias("t")).select("fp", "node", F.explode(F.array(*[key(i, c) for i, c in enumerate(chosen)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(own_exchange(F.col("key")).alias("k2"))
    shared, _ = keep(keyed.join(shuffled(sizes), F.col("key") == F.col("k2")).drop("k2"))
    x, y = shared.select("key", F.col("fp").alias("x"), F.col("node").alias("a")), shared.select("key", F.col("fp").alias("y"), F.col("node").alias("b"))
    whole = lambda c, p: F.bit_count(F.col(c).bitwiseXOR(F.lit(p)))
    near = F.greatest(*[F.abs(whole("x", p) - whole("y", p)) for p in PIVOTS]) <= RADIUS
    met = x.join(shuffled(y), (x["key"] == y["key"]) & (F.col("x") < F.col("y")) & near & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS))
    return met.select("a", "b").distinct()


def simhash_classes(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> (doc_id, fingerprint long, component_id): the smallest id reachable over links, itself included.

    Null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle make one
    shingle. Letters A-Z are lower-cased, nothing else. Equal fingerprints are one node, so copies cost one row each and
    no pair. Repeated ids give repeated rows. Further columns are ignored.
    """
    each, _ = keep(fingerprints(docs, words, id_col, text_col))
    nodes, _ = keep(each.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("node")))
    classes = connected_components(links(nodes))
    labelled = nodes.join(classes.select(F.col("node").alias("c_node"), "component"), F.col("node") == F.col("c_node"), "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return each.join(labelled, F.col("fingerprint") == own_exchange(F.col("fp"))).select("doc_id", "fingerprint", "component_id")


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, read as fingerprint() reads them."""
    w = text.encode().lower().split()
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)] * bool(w)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8").view(np.int64))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(node, text) -> (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for low in range(0, rb.num_rows, 256):
                part = rb.slice(low, 256)
                got = pa.array([shingles(t.as_py() or "", words) for t in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), got], names=["node", "set"])

    return rows.select("node", "text").mapInArrow(run, "node long, set array<long>")


def _tables(rows: DataFrame, words: int, similarity: float, common: list) -> DataFrame:
    """(node, text) -> (node, same, n, sketch, distances, prefix): what tells of a document's set of shingles whether another may be near.

    same is equal for equal sets, n the set's size. The sketch has SKETCH bits, each the parity of the shingles that hash to it, so two
    sketches never differ in more bits than the sets in shingles; distances are its Hamming distances to the references.
    Of two sets that reach the similarity, the prefixes meet: the first n - ceil(similarity n) + 1 shingles in one order
    for all texts, common ones last, then by hash. The order changes how many candidates there are, not which links.
    """
    hashes = np.array(sorted(h for h, _ in common), np.int64)
    counts = np.array([n for _, n in sorted(common)], np.int64)
    pivots = np.random.default_rng(SEED).integers(0, 256, (REFERENCES, SKETCH // 8), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            same, size, sketch, prefix = [], [], [], []
            for t in rb.column(1):
                got = shingles(t.as_py() or "", words)
                rank = np.zeros(len(got), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
                    rank = np.where(hashes[at] == got, counts[at], 0)
                first = len(got) - int(np.ceil(similarity * len(got) - 1e-9)) + 1
                same.append(xxhash.xxh3_128_digest(got.tobytes()))
                size.append(len(got))
                sketch.append(np.packbits(np.bincount(got & (SKETCH - 1), minlength=SKETCH) & 1))
                prefix.append(got[np.lexsort((got, rank))[:first]])
            bits = np.stack(sketch) if sketch else np.zeros((0, SKETCH // 8), np.uint8)
            far = np.bitwise_count(bits[:, None, :] ^ pivots).sum(axis=2, dtype=np.int32)
            columns = [rb.column(0), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(list(bits.view(np.int64)), pa.list_(pa.int64())), pa.array(list(far), pa.list_(pa.int32())), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "same", "n", "sketch", "distances", "prefix"])

    return rows.select("node", "text").mapInArrow(run, "node long, same binary, n long, sketch array<long>, distances array<int>, prefix array<long>")


def near_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, ids unique longs -> (node, component) of those linked with another: classes of the closure of all pairs whose sets of word shingles have at least this Jaccard similarity.

    Exact. The bits of SimHash bound no similarity of sets, and at 0.8 they would have to reach so far (10 of 64 bits on
    average) that no reference tells near from far. So candidates share a shingle of their prefixes, at places that
    leave room for the overlap; their pivot tables are those of parity sketches, for which the bound is exact: a pair goes
    if any coordinate, or the sketches themselves, differ by more than the sets may. Survivors are verified on whole sets,
    which only they need.

    Equal sets are one node. Of a shingle's documents, first all are compared with one of them, the leader; then those
    outside its class with all that are not in theirs. So many copies of each other cost one comparison each; documents
    without links that share a rare shingle of their prefixes are compared pair by pair, inside a join. Null and empty
    texts have equal sets.
    """
    scratch = Scratch()
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    part = rows.where(F.pmod(F.xxhash64("node"), F.lit(20)) == 0)
    often = _sets(part, words).select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    common = [tuple(r) for r in often.orderBy(F.col("n").desc(), "h").limit(50_000).collect()]  # for the order only
    each = scratch(_tables(rows, words, similarity, common))
    alike = each.groupBy("same").agg(F.min("node").alias("rep"), F.count("*").alias("m")).where("m > 1").select(F.col("same").alias("s2"), "rep")
    equal = scratch(each.select("node", "same").join(alike, F.col("same") == F.col("s2")).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))
    reps = each.join(small(equal).select(F.col("a").alias("r")), F.col("node") == F.col("r"), "left_anti")
    keyed = reps.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "key"))

    overlap = similarity / (1 + similarity)
    fits = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    room = lambda n, i, m, j: F.least(n - i, m - j) >= overlap * (n + m) - 1e-9  # noqa: E731  # the first shingle they share and all behind it
    may = lambda a, b: fits(F.col(f"n{a}"), F.col(f"n{b}")) & room(F.col(f"n{a}"), F.col(f"at{a}"), F.col(f"n{b}"), F.col(f"at{b}"))
    leads = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node"), "node", "n", "at")).alias("l")).where("m > 1")
    leads = leads.select(own_exchange(F.col("key")).alias("k2"), F.col("l.node").alias("lead"), F.col("l.n").alias("n0"), F.col("l.at").alias("at0"))
    met = scratch(keyed.join(shuffled(leads), F.col("key") == F.col("k2")).drop("k2"))

    def linked(pairs: DataFrame) -> DataFrame:
        own = lambda side, names: each.select(F.col("node").alias(f"node{side}"), *[F.col(c).alias(f"{c}{side}") for c in names])
        told = pairs.distinct().join(own(1, ["n", "sketch", "distances"]), F.col("a") == F.col("node1")).join(own(2, ["n", "sketch", "distances"]), F.col("b") == F.col("node2"))
        bound = (F.col("n1") + F.col("n2")) * (1 - similarity) / (1 + similarity) + 1e-9  # shingles that only one of the two holds
        apart = F.array_max(F.zip_with("distances1", "distances2", lambda x, y: F.abs(x - y))) <= bound
        bits = F.aggregate(F.zip_with("sketch1", "sketch2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) <= bound
        left = scratch(told.where(apart).where(bits).select("a", "b"))
        needed = scratch(left.select(F.explode(F.array("a", "b")).alias("k")).distinct())
        sets = scratch(_sets(rows.join(small(needed), F.col("node") == F.col("k"), "left_semi"), words))
        one, two = (sets.select(F.col("node").alias(f"node{i}"), F.col("set").alias(f"set{i}")) for i in (1, 2))
        both = F.size(F.array_intersect("set1", "set2"))
        done = left.join(one, F.col("a") == F.col("node1")).join(two, F.col("b") == F.col("node2"))
        return done.where(both / (F.size("set1") + F.size("set2") - both) >= similarity).select("a", "b")

    stars = scratch(linked(met.where("node <> lead").where(may("", "0")).select(F.col("lead").alias("a"), F.col("node").alias("b"))))
    at = scratch(connected_components(stars).select(F.col("node").alias("c_node"), "component"))
    at = small(at)
    where = lambda name, to: F.coalesce(F.col(name), F.col(to))
    told = met.join(at, F.col("node") == F.col("c_node"), "left").withColumn("c", where("component", "node")).drop("c_node", "component")
    told = told.join(at, F.col("lead") == F.col("c_node"), "left").withColumn("main", where("component", "lead")).select("key", "node", "n", "at", "c", "main")
    x, y = (told.select("key", *[F.col(v).alias(v + i) for v in ("node", "n", "at", "c", "main")]) for i in "12")
    apart = (F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("main1")) | (F.col("node1") < F.col("node2")))
    rest = x.where("c1 <> main1").join(shuffled(y), (x["key"] == y["key"]) & apart & may("1", "2"))
    more = linked(rest.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")))
    done, _ = keep(connected_components(equal.unionByName(stars).unionByName(more)))
    scratch.clear()
    return done


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) of every document: near_classes(), and those without a link each in a class of its own."""
    classes = near_classes(docs, words, similarity, id_col, text_col).withColumnRenamed("node", "c_node")
    rows = docs.select(F.col(id_col).cast("long").alias("node"))
    return rows.join(classes, F.col("node") == F.col("c_node"), "left").select("node", F.coalesce("component", "node").alias("component"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
