"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import keep

#: Buckets for words and word pairs, and for their shapes.
WORDS, SHAPES = 1 << 14, 1 << 10
BUCKETS = 2 * WORDS + 2 * SHAPES
#: Labelled rows the target model is fitted on at most: those with the smallest hash of the id.
FIT_ROWS = 20_000
_CACHED = 400_000
_CLASSES = {**{c: "a" for c in range(97, 123)}, **{c: "A" for c in range(65, 91)}, **{c: "0" for c in range(48, 58)}}


class _Words(dict):
    """word -> its bucket and the bucket of its shape, in one number. Shapes fold letters, digits and runs."""

    def __missing__(self, word: str) -> int:
        folded = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word) if not word.isascii() else word.translate(_CLASSES)
        shape = "".join(c for i, c in enumerate(folded) if folded[i - 1 : i] != c)
        out = zlib.crc32(word.encode()) % WORDS * SHAPES + zlib.crc32(shape.encode()) % SHAPES
        if len(self) >= _CACHED:
            self.clear()
        self[word] = out
        return out


_words = _Words()


def ngrams(text: str) -> np.ndarray:
    """Buckets of the text's words, word pairs, shapes and shape pairs.

    Shapes carry what holds of words never seen (letters against digits and marks, letter case); a word that follows
    itself has one bucket whatever the word, since prose of any subject rarely repeats a word at once.
    """
    words = text.split()
    both = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    w, s = np.divmod(both, SHAPES)
    pair = (w[:-1] * 40503 + w[1:] * 2654435761) % (WORDS - 1) + 1
    pair[both[:-1] == both[1:]] = 0
    return np.concatenate([w, WORDS + pair, 2 * WORDS + s, 2 * WORDS + SHAPES + (s[:-1] * 31 + s[1:] * 1009) % SHAPES])


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "_target") -> DataFrame:
    """(bucket, n, n_target) over all documents, summed per partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for rb in batches:
            for text, target in zip(rb.column(0), rb.column(1).to_pylist()):
                got = np.bincount(ngrams(text.as_py() or ""), minlength=BUCKETS)
                total[0] += got
                if target:
                    total[1] += got
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "n", "n_target"])

    each = docs.select(F.col(text_col), F.col(label_col)).mapInArrow(run, "bucket long, n long, n_target long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: list, smoothing: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket; each family of n-grams is a distribution of its own."""
    table = np.zeros((2, BUCKETS))
    for bucket, n, t in counts:
        table[:, bucket] = n, t
    out = np.zeros(BUCKETS)
    for low, high in ((0, WORDS), (WORDS, 2 * WORDS), (2 * WORDS, 2 * WORDS + SHAPES), (2 * WORDS + SHAPES, BUCKETS)):
        raw, target = table[:, low:high]
        # raw counts are scaled to the target's sample, so that smoothing weighs the same in both
        scaled = raw * (target.sum() / max(raw.sum(), 1.0))
        out[low:high] = np.log((target + smoothing) / (target.sum() + smoothing * (high - low))) - np.log((scaled + smoothing) / (scaled.sum() + smoothing * (high - low)))
    return out


def score(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, log_ratio): the document's log importance weight, the sum over its n-grams; with `text_hash`, which tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [round(float(ratios[ngrams(t.as_py() or "")].sum()), 6) for t in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(got, pa.float64()), *rb.columns[2:]], names=["doc_id", "log_ratio", *rb.schema.names[2:]])

    told = [F.xxhash64(text_col).alias("text_hash")] if text_hash else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *told).mapInArrow(run, "doc_id long, log_ratio double" + ", text_hash long" * text_hash)


def kth_largest(keys: DataFrame, col: str, k: int) -> float | None:
    """Exact k-th largest value by repeated histograms: each pass keeps one of 1,000 ranges, so a few passes do at any size. None if there are fewer."""
    low, high, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    above = 0
    if n < k:
        return None
    while low < high and low + (step := (high - low) / 1000) > low:
        part = keys.where((F.col(col) >= low) & (F.col(col) <= high))
        bins = part.groupBy(F.least(F.floor((F.col(col) - low) / step), F.lit(999)).alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return low


def threshold(good: list[float], bad: list[float], cost: float = 5.0) -> float:
    """The cut with the least cost on labelled scores: a lost good document costs `cost`, a kept bad one 1; in the middle of the best gap."""
    if not bad or not good:
        return min(good, default=0.0) - 1.0
    marks = sorted([(s, 1) for s in good] + [(s, 0) for s in bad])
    best = best_cost = None
    lost, kept = 0, len(bad)
    for i, (s, is_good) in enumerate([(marks[0][0] - 2.0, None), *marks]):
        if is_good is not None:
            lost, kept = lost + is_good, kept - (1 - is_good)
        after = marks[i][0] if i < len(marks) else s + 2.0
        if after > s and (best_cost is None or lost * cost + kept < best_cost):
            best, best_cost = (s + after) / 2, lost * cost + kept
    return best


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 7, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """Documents -> (doc_id, log_ratio, gumbel_key, selected), with `text_hash` also the xxhash64 of the text.

    The raw model counts the hashed n-grams of all documents, the target model those of labelled documents of quality
    1. A document's log importance weight is the sum of its n-grams' log ratios. Gumbel top-k: its key adds Gumbel noise,
    drawn from the hash of its id, to the weight over the temperature, and the k largest keys are a sample without
    replacement in proportion to the weights. Sums over hundreds of n-grams lie far apart, so that at temperature 1 the
    noise only decides between near ties; a temperature of some tens to hundreds makes it felt.

    Of at most `fit_rows` labelled documents, three quarters (by a hash of the id) fit the target model. Without k, it
    is the number of documents whose weight passes the best cut between the other quarter's documents of quality 1 and
    0, which the model hasn't seen (all pass if either is missing).

    Null and empty texts have weight 0. Repeated rows get the same key and are selected together, ties at the k-th key
    likewise; if k is not less than the number of documents, all are selected. Labels that are null, or of documents
    not in docs, are ignored; repeated labels count once. The driver gets one number per bucket and one per labelled
    row of the sample, whatever the input's size.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fit = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    fit = fit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    judges = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(4)) == 0
    fit, _ = keep(fit.select(F.col("doc_id").alias("_id"), "quality", judges.alias("judges")))
    marked = docs.join(F.broadcast(fit), F.col("doc_id") == F.col("_id"), "left")  # at most fit_rows rows of three values
    counts = bucket_counts(marked.withColumn("_target", F.coalesce((F.col("quality") == 1) & ~F.col("judges"), F.lit(False)))).collect()
    scored, _ = keep(score(docs, log_ratios(counts), text_hash=text_hash))
    u = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("gumbel_key", F.round(F.col("log_ratio") / temperature - F.log(-F.log(u)), 6))
    if k is None:
        seen = scored.join(F.broadcast(fit.where("judges")), F.col("doc_id") == F.col("_id")).groupBy("quality", "log_ratio").agg(F.count("*").alias("n")).collect()
        cut = threshold([r[1] for r in seen if r[0] == 1 for _ in range(r[2])], [r[1] for r in seen if r[0] != 1 for _ in range(r[2])])
        k = scored.where(F.col("log_ratio") >= cut).count()
    if k <= 0:
        return keyed.withColumn("selected", F.lit(False))
    last = kth_largest(keyed, "gumbel_key", k)
    return keyed.withColumn("selected", F.lit(True) if last is None else F.col("gumbel_key") >= F.lit(last))
