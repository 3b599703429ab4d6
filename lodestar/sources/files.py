"""Files, archives, XML and JSON maps as tables."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.content import is_xml
from lodestar.functions.values import unsafe_member


def scan_files(spark: SparkSession, source: str, pattern: str = "*.[dD][aA][tT]", output: str | None = None) -> DataFrame:
    """Files below a folder whose name fits, or one file named directly, whatever its name: path, length, modificationTime, content, in order of path.

    Files below `output`, a folder of results inside the source, are left out, and symbolic links to folders are not
    followed. Dropping content reads no bytes.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not store.getFileStatus(path).isFile():
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(source)
    for inside in [*([store.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(output)).toString()] if output else []), *_linked(spark, source)]:
        found = found.where(~F.startswith(F.col("path"), F.lit(inside.rstrip("/") + "/")))
    return found.orderBy("path")


def _linked(spark: SparkSession, source: str) -> list[str]:
    """Symbolic links to folders below a local one; other stores have none."""
    if not spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        return []
    top = Path(source.removeprefix("file://"))
    return [f"file:{d / n}" for d, names, others in top.walk() for n in (*names, *others) if (d / n).is_symlink() and (d / n).is_dir()] if top.is_dir() else []


def archive_members(archives: DataFrame) -> DataFrame:
    """(file_id, content binary) of ZIP archives -> one row per member: file_id, name, size, compressed, encrypted, unsafe.

    Only the directory is read, nothing is unpacked. What is no archive gives one row with an error and no name.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for i, raw in zip(frame["file_id"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        rows += [(i, m.filename, m.file_size, m.compress_size, bool(m.flag_bits & 1), m.external_attr >> 16, None) for m in z.infolist()]
                except zipfile.BadZipFile:
                    rows.append((i, None, None, None, None, None, "corrupt"))
            yield pd.DataFrame(rows, columns=["file_id", "name", "size", "compressed", "encrypted", "mode", "error"])

    out = archives.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInPandas(run, "file_id long, name string, size long, compressed long, encrypted boolean, mode long, error string")
    return out.withColumn("unsafe", unsafe_member(F.col("name"), F.col("mode"), F.col("encrypted"))).drop("mode")


def xml_rows(files: DataFrame, row_tag: str, fields: str) -> DataFrame:
    """(file_id, content) of XML -> a row per child named row_tag of the root, typed by `fields` (attributes as _name).

    Texts that are no XML, and null ones, give no rows.
    """
    kind = f"{row_tag} array<struct<{fields}>>"
    parsed = F.from_xml("content", F.lit(kind), {"mode": "PERMISSIVE", "rowTag": "root"})
    return files.select("file_id", F.inline(parsed[row_tag]))


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def _children(texts: pd.Series) -> pd.Series:
    """Children of the root as maps; of a root without children, one map with all of its text."""

    def one(text: str | None):
        if text is None:
            return None
        root = ElementTree.fromstring(text)
        found = []
        for child in root:
            record = {"tag": child.tag, **child.attrib, **{node.tag: (node.text or "").strip() for node in child}}
            if not len(child):
                record["text"] = child.text or ""
            found.append(record)
        return found or [{"text": " ".join(root.itertext())[:2048]}]

    return texts.map(one)


def xml_records(files: DataFrame) -> DataFrame:
    """(file_id, content) of any XML -> file_id, row_no, record (map): a row per child of the root, in order; no schema is needed.

    A record has the child's tag, its attributes and the trimmed text of each of its own children by their tags, the last
    of a tag counting; a child without children has its text instead. A root without children is one record with its
    text, cut to 2,048 characters. What is no XML by Spark's parser, and null, gives no rows. Values stay texts: 001 is
    not 1, which is why this isn't Spark's own conversion to VARIANT.
    """
    told = files.select("file_id", F.when(is_xml(F.col("content")), F.regexp_replace("content", r"^\s+", "")).alias("content")).where("content is not null")
    return told.select("file_id", F.posexplode(_children("content")).alias("row_no", "record"))


def load_name_map(texts: Column) -> Column:
    """JSON texts -> map of names to non-blank names of at most 1,000 characters; null unless every pair is valid."""
    pairs = F.from_json(texts, "map<string,string>")
    valid = F.forall(F.map_entries(pairs), lambda e: (F.trim(e["key"]) != "") & e["value"].isNotNull() & (F.trim(e["value"]) != "") & (F.length(e["value"]) <= 1000))
    return F.when(valid, pairs)


def load_vocabulary(df: DataFrame, text: str, axes: list[str]) -> DataFrame:
    """A JSON vocabulary (axis -> code -> rule) as rows: axis, code, label, include, exclude, boundary."""
    rule = "map<string,struct<label:string,include:string,exclude:string,boundary:string>>"
    v = F.from_json(text, ", ".join(f"{a} {rule}" for a in axes))
    each = [df.select(F.lit(a).alias("axis"), F.explode(v[a]).alias("code", "rule")) for a in axes]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.select("axis", "code", "rule.*")


def vocabulary_search(vocabulary: DataFrame, axis: str, words: str) -> DataFrame:
    """Entries of an axis that hold the words, in any case, in their code or rule."""
    text = F.concat("code", F.to_json(F.struct("label", "include", "exclude", "boundary")))
    return vocabulary.where((F.col("axis") == axis) & F.contains(F.lower(text), F.lit(words.lower())))
