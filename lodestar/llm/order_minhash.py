"""Order MinHash: document fingerprints that follow the edit distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import keep, let, small

K, L, BINS = 5, 2, 64
LONGEST = 16
_BITS = 32


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of all k consecutive words; fewer words: one of them all; none: no k-mer. What has no blank for long counts as a word every LONGEST characters."""
    words = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{LONGEST}}}"), F.lit(0))

    def over(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).when(F.size(h) < k, F.array(F.xxhash64(h))).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def numbered(hashes: Column) -> Column:
    """Array of (g, at): the k-mers by text place `at`, hashed together with the number of the occurrence.

    Equal k-mers stand together once sorted, so an occurrence's number is its distance from the first of its run. Runs
    longer than one are few: only for them the run's start is searched, by halving.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def occurrence(s: Column) -> Column:
        def start(i: Column, h: Column) -> Column:
            low_high = F.struct(F.lit(0).alias("low"), i.alias("high"))
            halve = lambda b, _: let((b["low"] + b["high"]) / 2, lambda m: F.when(F.get(s, m.cast("int"))["h"] == h, F.struct(b["low"].alias("low"), m.cast("int").alias("high"))).otherwise(F.struct((m.cast("int") + 1).alias("low"), b["high"].alias("high"))))
            return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(i + 1.0)).cast("int")), low_high, lambda b, x: F.when(b["low"] < b["high"], halve(b, x)).otherwise(b))["high"]

        def number(x: Column, i: Column) -> Column:
            run = (i > 0) & (F.get(s, i - 1)["h"] == x["h"])
            return F.struct(F.when(run, F.xxhash64(x["h"], i - start(i, x["h"]))).otherwise(F.xxhash64(x["h"])).alias("g"), x["at"].alias("at"))

        return F.transform(s, number)

    return let(pairs, occurrence)


def sketch(text: Column, k: int = K, ell: int = L, bins: int = BINS) -> Column:
    """Array of longs, one per bin that has a k-mer: bin number above, hash of its tuple below 32 bits.

    The k-mers are dealt over the bins by the upper bits of their hash, which also orders them: each bin is one
    permutation's share. Of each bin the `ell` smallest are taken, put back in text order and hashed as a tuple; a text
    shorter than the bins need has bins with fewer or none. `bins` is a power of two.
    """
    shift = 64 - (bins.bit_length() - 1)
    of = lambda x: F.shiftright(x["g"], shift)

    def tuples(s: Column) -> Column:
        smallest = F.filter(s, lambda x, i: (i < ell) | (of(F.get(s, i - ell)) != of(x)))

        def join(t: Column) -> Column:
            def entry(x: Column, i: Column) -> Column:
                mates = [F.when(of(F.get(t, i + j)) == of(x), F.get(t, i + j)) for j in range(1, ell)]
                ordered = F.array_sort(F.filter(F.array(*[F.struct(m["at"].alias("at"), m["g"].alias("g")) for m in [x, *mates]]), lambda m: m["g"].isNotNull()))
                tail = F.xxhash64(F.transform(ordered, lambda m: m["g"])).bitwiseAND(F.lit((1 << _BITS) - 1))
                return F.when((i == 0) | (of(F.get(t, i - 1)) != of(x)), F.shiftleft(of(x) + bins // 2, _BITS) + tail)

            return F.filter(F.transform(t, entry), lambda y: y.isNotNull())

        return let(smallest, join)

    return let(F.array_sort(numbered(kmers(text, k))), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples over bins that either has; two texts without words are alike."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, _BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprint_string(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), _BITS // 4 + 2, "0")), ""))


def _ranges(docs: DataFrame, id_col: str, rows_per_range: int, rounds: int = 8) -> DataFrame:
    """docs with _block, an array that grows with the id: the place among ranges of equal width, and for ranges that hold over four times the rows meant, the place among ranges inside, and so on. Null ids: the lowest."""
    x = F.col(id_col).cast("double")  # grows with the id, and knows no overflow
    low, high, n = docs.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    if not n:
        return docs.withColumn("_block", F.array(F.lit(-1).cast("long")))
    many = -(-n // rows_per_range)
    place = lambda x, low, high, many: F.when(x.isNull(), -1).otherwise(F.least(F.floor((x - low) / ((high - low) / many + 1e-300)), many - 1)).cast("long")
    out = docs.withColumn("_block", F.array(place(x, F.lit(float(low)), F.lit(float(high)), F.lit(many))))
    for _ in range(rounds):
        full = out.groupBy("_block").agg(F.count("*").alias("_n"), F.min(x).alias("_low"), F.max(x).alias("_high")).where((F.col("_n") > 4 * rows_per_range) & (F.col("_low") < F.col("_high")))
        full, _ = keep(full.withColumnRenamed("_block", "_whole"))
        if full.isEmpty():
            break
        inside = place(x, F.col("_low"), F.col("_high"), F.ceil(F.col("_n") / rows_per_range))
        out = out.join(small(full), F.col("_block") == F.col("_whole"), "left").withColumn("_block", F.when(F.col("_n").isNotNull(), F.concat("_block", F.array(inside))).otherwise(F.col("_block"))).drop("_whole", "_n", "_low", "_high")
    return out


def _above(blocks: DataFrame) -> DataFrame:
    """(_block) -> (_own, _to): the next higher block, for the highest the lowest; by windows over a thousand block numbers and one over their groups."""
    grouped = blocks.withColumn("_group", F.floor(F.element_at("_block", 1) / 1024))
    inside = Window.partitionBy("_group").orderBy(F.col("_block").desc())
    across = Window.orderBy(F.col("_group").desc())
    first = grouped.groupBy("_group").agg(F.min("_block").alias("_least"))
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select(F.col("_group").alias("_g"), F.coalesce(F.lag("_least").over(across), F.min("_least").over(every)).alias("_next"))
    return grouped.withColumn("_to", F.lag("_block").over(inside)).join(first, F.col("_group") == F.col("_g")).select(F.col("_block").alias("_own"), F.coalesce("_to", "_next").alias("_to"))


def followed(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 500) -> DataFrame:
    """derive(docs) with next_<column> for every column but the id: those of the row with the next smaller id; after the smallest, of the largest.

    Ids are cut into ranges by their distribution; a window runs inside each range, and the top row of a range is also
    sent to the range above it. The top rows are found in the given table, before anything is derived or shuffled; only
    three numbers reach the driver. Ties are ordered by the text, whose rows stay in one range. Null ids come after all
    others.
    """
    rows = _ranges(docs, id_col, rows_per_range)
    best = F.struct(F.bitwise_not(F.col(id_col)), F.col(text_col))  # of the largest id, the least text
    tops = rows.groupBy("_block").agg(F.max(id_col).alias(id_col), F.min_by(text_col, best).alias(text_col))
    guests = tops.join(_above(rows.select("_block").distinct()), F.col("_block") == F.col("_own")).select(F.col("_to").alias("_block"), id_col, text_col)
    both = derive(rows).withColumn("_guest", F.lit(False)).unionByName(derive(guests).withColumn("_guest", F.lit(True)))
    w = Window.partitionBy("_block").orderBy("_guest", F.col(id_col).desc_nulls_last(), F.col(text_col))
    ahead = [F.lead(c).over(w).alias(f"next_{c}") for c in both.columns if c not in (id_col, "_block", "_guest")]
    return both.select("*", *ahead).where(~F.col("_guest")).drop("_block", "_guest")


def order_minhash(docs: DataFrame, k: int = K, ell: int = L, bins: int = BINS, text_col: str = "text") -> DataFrame:
    """Documents with their sketch. Null text has the sketch of an empty one, which is empty; equal texts have equal sketches. A column called sketch is replaced."""
    return docs.withColumn("sketch", sketch(F.coalesce(F.col(text_col), F.lit("")), k, ell, bins))


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints react: each text against its edited form, in which the last half is replaced by the start of the next document's text.

    Null texts are empty; two texts without words are alike. Rows with repeated ids are ordered by text, and stay.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = followed(given, order_minhash)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = each.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_string(F.col("sketch")).alias("fingerprint"), fingerprint_string(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
