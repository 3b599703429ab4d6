"""How filters of documents interact: what each removes in every order, alone, again, and of what is labelled."""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, keep

#: A content with more copies than HUB, and than one in HUBS rows, meets its rows by broadcast: at most HUBS such contents.
HUB, HUBS = 64, 50_000
FILTERS = "ABCDE"


def text_stats(docs: DataFrame) -> DataFrame:
    """Documents -> row, doc_id, part, content (SHA-256), A to D: whether the text fails by words, distinct words, capitals or signs. Null texts are empty.

    Words are maximal runs of what is none of the blanks; no text is cut.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " ", -1), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text"), words.alias("_words"))
    capitals = F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {
        "A": F.size("_words") < 200,
        "B": 100 * F.size(F.array_distinct("_words")) < 50 * F.size("_words"),
        "C": 100 * capitals > 3 * F.length("_text"),
        "D": F.regexp_like("_text", F.lit("[#$%&*|]")),
    }
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.sha2("_text", 256).alias("content"), *[f.alias(n) for n, f in fails.items()])


def later_copies(stats: DataFrame) -> DataFrame:
    """(row, doc_id, content) -> the rows whose content a smaller id has, too. Null ids neither are nor have later copies.

    Smallest ids are combined before the shuffle; contents with very many copies meet their rows by broadcast.
    """
    heavy = max(HUB, stats.count() // HUBS)
    first = stats.where("doc_id is not null").groupBy(F.col("content").alias("_c")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    hubs = F.broadcast(first.where(F.col("_n") > heavy).select(F.col("_c").alias("_h"), F.col("_first").alias("_least")))
    met = stats.select("row", "doc_id", "content").join(hubs, F.col("content") == F.col("_h"), "left")
    hot = met.where("doc_id > _least").select("row")
    rest = met.where("_h is null").join(first.where(F.col("_n") <= heavy), F.col("content") == F.col("_c")).where("doc_id > _first").select("row")
    return hot.unionByName(rest)


def failing_ids(stats: DataFrame, copies: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """One table of failing rows per filter, stored."""
    tables = {name: scratch(stats.where(name).select("row")) for name in FILTERS[:-1]}
    return tables | {FILTERS[-1]: scratch(copies)}


def split_by(rows: DataFrame, table: DataFrame, on: str, name: str) -> DataFrame:
    """rows with the letter appended to `holds` where the table has them: a left-semi join for those, a left-anti join for the rest."""
    inside = rows.join(table, on, "left_semi").withColumn("holds", F.concat("holds", F.lit(name)))
    return inside.unionByName(rows.join(table, on, "left_anti"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and labels (doc_id, quality, toxic) -> counts per part, filter_order and step, zeros included.

    part is the language (null: empty). Orders are all permutations of the filters, steps from 1. Per document: kept
    after this step, removed here, redundant (fails here, removed earlier), unique_fails (fails this filter only),
    good_lost and toxic_lost (removed here with quality or toxic 1; one of several labels is enough), shapley (what the
    filter removes, over all orders). Repeated ids are documents of their own; null ids have no label and are no
    copies. No documents: no rows. Further columns are ignored.

    Each filter's failing ids are a stored table. Left-semi and left-anti joins with these tables, one pair a filter,
    part the documents into classes that fail the same filters; classes are counted before anything is repeated by
    order. Then, for each of the 80 pairs of a prefix (a set) and the next filter, left-anti joins with the classes
    that the prefix fails give its survivors, left-semi joins with those that fail the filter give removals, and both
    give what was removed before. Orders share prefixes, so 600 steps cost 80.
    """
    spark, scratch = docs.sparkSession, Scratch()
    stats = scratch(text_stats(docs))
    fails = failing_ids(stats, later_copies(stats), scratch)
    rows = stats.select("row", "doc_id", "part", F.lit("").alias("holds"))
    for letter, flag in (("g", "quality"), ("t", "toxic")):
        rows = scratch(split_by(rows, scratch(labels.where(F.col(flag) == 1).select("doc_id").distinct()), "doc_id", letter))
    for name in FILTERS:
        rows = scratch(split_by(rows, fails[name], "row", name))
    good, toxic = F.contains("holds", F.lit("g")), F.contains("holds", F.lit("t"))
    failed = F.translate("holds", "gt", "").alias("class")
    classes = scratch(rows.groupBy("part", failed).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(toxic).alias("toxic")))
    done, _ = keep(_steps(classes))
    scratch.clear()
    return done


def _subsets(letters: str) -> list[str]:
    return ["".join(c) for n in range(len(letters) + 1) for c in itertools.combinations(letters, n)]


def _steps(classes: DataFrame) -> DataFrame:
    """(part, class, n, good, toxic) -> a row per part, order and step."""
    spark = classes.sparkSession
    table = lambda rows, columns: F.broadcast(spark.createDataFrame(rows, columns))  # noqa: E731  fixed size: functions of five letters
    sets = _subsets(FILTERS)
    failing = table([(c, f) for c in sets for f in c], "class string, filter string")
    met = table([(p, c) for p in sets for c in sets if set(p) & set(c)], "prefix string, class string")
    others = table([(c, f) for c in sets for f in FILTERS if set(c) - {f}], "class string, filter string")
    pairs = [(p, f) for p in sets for f in FILTERS if f not in p]
    tried = classes.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(f).alias("filter")) for p, f in pairs])).alias("_p")).select("*", "_p.*").drop("_p")
    survivors = tried.join(met, ["prefix", "class"], "left_anti")
    removed = survivors.join(failing, ["class", "filter"], "left_semi")
    kept = survivors.join(failing, ["class", "filter"], "left_anti")
    redundant = tried.join(failing, ["class", "filter"], "left_semi").join(met, ["prefix", "class"], "left_semi")
    unique = tried.join(failing, ["class", "filter"], "left_semi").join(others, ["class", "filter"], "left_anti")
    none: Column = F.lit(0).cast("long")

    def as_(df: DataFrame, **columns: str) -> DataFrame:
        names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
        return df.select("part", "prefix", "filter", *[(F.col(columns[n]) if n in columns else none).alias(n) for n in names])

    zeros = tried  # every pair of every part, also where no class survives
    parts = [as_(zeros), as_(kept, kept="n"), as_(removed, removed="n", good_lost="good", toxic_lost="toxic"), as_(redundant, redundant="n"), as_(unique, unique_fails="n")]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    counted = union.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")])
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    weight = table([(p, factorial(len(p)) * factorial(len(FILTERS) - 1 - len(p))) for p in sets if len(p) < len(FILTERS)], "prefix string, orders long")
    shapley = counted.join(weight, "prefix").groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = table([(o, i + 1, "".join(sorted(o[:i])), o[i]) for o in orders for i in range(len(o))], "filter_order string, step int, prefix string, filter string")
    out = counted.join(shapley, ["part", "filter"]).join(steps, ["prefix", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
