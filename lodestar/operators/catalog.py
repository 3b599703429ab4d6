"""Catalogue joins, integrity, schema groups and upload completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def join_analyses(files: DataFrame, analyses: DataFrame, policy: str) -> DataFrame:
    """Files with the cached analysis of their content; many files share one."""
    return files.join(analyses.where(F.col("policy_key") == policy), "sha256")


def pending(files: DataFrame, analyses: DataFrame, policy: str) -> DataFrame:
    """Files without an analysis under this policy; null hashes are pending."""
    return files.join(analyses.where(F.col("policy_key") == policy), "sha256", "left_anti")


def next_jobs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Work items (file_id, arrived) with the hash of their content, in order of arrival."""
    return jobs.join(files.select("file_id", "sha256"), "file_id").orderBy("arrived", "file_id")


def incremental(hashes: DataFrame, done: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(pending, analyses after the run) of distinct contents under a policy; a new policy makes all of them pending."""
    todo = pending(hashes, done, policy)
    return todo, done.unionByName(todo.select("sha256", F.lit(policy).alias("policy_key")))


def reprocess(done: DataFrame, hashes: DataFrame) -> DataFrame:
    """Analyses without those of the given contents, which are thereby pending again."""
    return done.join(hashes, "sha256", "left_anti")


def insert_if_absent(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """known with the rows of new whose keys it lacks, one per key; null is a key. A second run adds nothing."""
    seen = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return known.unionByName(new.dropDuplicates(keys).join(seen, same, "left_anti").select(*known.columns))


def catalog_filter(files: DataFrame, kind: str | None = None, fingerprint: str | None = None, search: str | None = None) -> DataFrame:
    """Files (original_name, detected_type, fingerprint) that are of a type, of a schema, and hold a text in their name, in any letter case; % and _ in it stand for themselves."""
    if kind is not None:
        files = files.where(F.col("detected_type") == kind)
    if fingerprint is not None:
        files = files.where(F.col("fingerprint") == fingerprint)
    if search:
        files = files.where(F.col("original_name").ilike("%" + "".join("\\" + c if c in "\\%_" else c for c in search) + "%"))
    return files


def known_batches(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items (batch_id) with accepted: whether the batch is known. Null batches are not."""
    seen = known.select(F.col("batch_id").alias("_b")).distinct().withColumn("_known", F.lit(True))
    return items.join(seen, F.col("batch_id") == F.col("_b"), "left").withColumn("accepted", F.coalesce("_known", F.lit(False))).drop("_b", "_known")


def apply_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files with the mapped name of (original_name, mapped), null where there is none; of several mappings of a name, the smallest counts."""
    once = names.groupBy(F.col("original_name").alias("_name")).agg(F.min("mapped").alias("mapped"))
    return files.join(once, F.col("original_name") == F.col("_name"), "left").drop("_name")


def corpus_gate(items: DataFrame, verdicts: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row: rejected items, files whose check isn't ok (a missing verdict included), unfinished and failed jobs (state; reader_error is a failure, any other state but done is unfinished), and ok if there are none of all."""
    rejected = items.agg(F.count_if(F.col("file_id").isNull()).alias("rejected"))
    bad = verdicts.agg(F.count_if(~F.col("verdict").eqNullSafe(F.lit("ok"))).alias("bad"))
    if jobs is None:
        return rejected.join(bad).withColumn("ok", (F.col("rejected") == 0) & (F.col("bad") == 0))  # one row each
    state = F.coalesce("state", F.lit(""))
    left = jobs.agg(F.count_if(~state.isin("done", "failed", "reader_error")).alias("unfinished"), F.count_if(state.isin("failed", "reader_error")).alias("failed"))
    none = (F.col("rejected") == 0) & (F.col("bad") == 0) & (F.col("unfinished") == 0) & (F.col("failed") == 0)
    return rejected.join(bad).join(left).withColumn("ok", none)


def reuse_by_content(files: DataFrame, analyse) -> DataFrame:
    """Analyse each distinct content once and hand the result back to every file that has it."""
    once = analyse(files.select("sha256", "content").dropDuplicates(["sha256"]))
    return files.drop("content").join(once, "sha256")


def batch_page(items: DataFrame, files: DataFrame) -> DataFrame:
    """Every batch item with its accepted file or its rejection."""
    return items.join(files.select("file_id", "original_name"), "file_id", "left").withColumn("state", F.when(F.col("file_id").isNotNull(), "accepted").otherwise("rejected"))


def batch_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("batch_id").agg(F.count("file_id").alias("succeeded"), (F.count("*") - F.count("file_id")).alias("failed"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version per key, the new rows winning ties; combined before the shuffle."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(version, "_new"))
    return both.groupBy(*keys).agg(latest.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def verify_integrity(catalogue: DataFrame, actual: DataFrame) -> DataFrame:
    """(file_id, file_size, sha256) against (file_id, content): ok, missing_original or hash_mismatch."""
    seen = actual.select(F.col("file_id").alias("_id"), F.octet_length("content").alias("_size"), F.sha2("content", 256).alias("_sha"))
    same = F.col("_size").eqNullSafe(F.col("file_size")) & F.col("_sha").eqNullSafe(F.col("sha256"))
    verdict = F.when(F.col("_id").isNull(), "missing_original").when(~same, "hash_mismatch").otherwise("ok")
    return catalogue.join(seen, F.col("file_id") == F.col("_id"), "left").select("file_id", verdict.alias("verdict"))


def acknowledged(etag: str = "etag") -> Column:
    """Whether a part has a tag that isn't blank."""
    return F.coalesce(F.trim(etag) != "", F.lit(False))


def upload_status(parts: DataFrame, chunk: int = 1024) -> DataFrame:
    """(upload_id, size, part, etag, bytes): complete if numbers run 1..n, every part has an etag that isn't blank and the parts' own bytes add up to the size. Of a part that arrived twice, the larger counts."""
    n = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("long")
    once = parts.groupBy("upload_id", "size", "part").agg(F.bool_or(acknowledged()).alias("_ok"), F.max("bytes").alias("_bytes"))
    got = once.groupBy("upload_id", "size").agg(F.count("*").alias("arrived"), F.max("part").alias("last"), F.count_if("_ok").alias("acknowledged"), F.sum(F.when(F.col("_ok"), F.col("_bytes")).otherwise(0)).alias("bytes"))
    whole = (F.col("arrived") == n) & (F.col("last") == n) & (F.col("acknowledged") == n) & (F.col("bytes") == F.col("size"))
    return got.select("upload_id", "size", n.alias("expected"), "arrived", "acknowledged", "bytes", whole.alias("complete"))


def missing_parts(parts: DataFrame, sessions: DataFrame, chunk: int = 1024) -> DataFrame:
    """(upload_id, part) still to be sent: expected without an acknowledged part."""
    n = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("long")
    expected = sessions.select("upload_id", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("part"))
    return expected.join(parts.where(acknowledged()).select("upload_id", "part"), ["upload_id", "part"], "left_anti")


def chunk_identity(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Parts (upload_id, part, sha256) and files (upload_id, path, size, modified, mapped_name, occurrence) -> upload_id, identity.

    SHA-256 of the JSON list of path, size, modification time, mapped name (null if none), occurrence and the chunks'
    hashes in their order; equal contents under another name, time or occurrence are others. A file without chunks has
    an empty list. Lists are bounded by a file's own chunks.
    """
    listed = parts.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("sha256", F.lit("")).alias("sha256")))).alias("_l"))
    out = files.join(listed, "upload_id", "left")
    text = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", ""), F.lit("null"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    hashes = F.coalesce(F.to_json(F.transform("_l", lambda p: p["sha256"])), F.lit("[]"))
    whole = F.concat(F.lit("["), F.concat_ws(",", text("path"), number("size"), number("modified"), text("mapped_name"), number("occurrence"), hashes), F.lit("]"))
    return out.select("upload_id", F.sha2(whole, 256).alias("identity"))


def transfer_progress(parts: DataFrame, by: list[str], chunk: int = 1024) -> DataFrame:
    """Acknowledged bytes over all bytes of the parts (size, part, etag), per group, to four places; nothing to send counts as done."""
    size = F.least(F.lit(chunk).cast("long"), F.col("size") - (F.col("part") - 1) * chunk)
    done, of = F.sum(F.when(acknowledged(), size).otherwise(0)), F.sum(size)
    return parts.groupBy(*by).agg(F.when(of == 0, F.lit(1.0)).otherwise(F.round(done / F.nullif(of, F.lit(0)), 4)).alias("progress"))
