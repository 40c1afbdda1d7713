"""File trees as tables: manifest, packages, typed records from XML, translations, the corpus on disk.

Everything goes through Spark's readers and writers, so a tree may lie in any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a manifest keeps and leaves out, and the file that marks a package.
XML_EXTENSIONS = [".xml", ".call", ".character", ".weapon", ".projectile", ".carry_item", ".base_weapon", ".animation_base", ".base", ".base_carry_item"]
TEXT_EXTENSIONS = [".ai", ".resources", ".models", ".name", ".text_lines"]
EXTENSIONS = [*XML_EXTENSIONS, *TEXT_EXTENSIONS, ".as"]
EXCLUDED_DIRS = ["models", "maps"]
PACKAGE_MARKER = "package_config.xml"
# Document types by the root element of a record; call, faction and the like hold several records.
RECORD_TYPES = ["call", "character", "soldier", "weapon", "carry_item", "vehicle", "projectile"]


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, ext, mtime, length, content) of the kept files below root, without pruned folders. Content is read only if used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").split("://")[-1].removeprefix("file:") + "/")
    full = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", "")
    rel = F.substring(full, F.length(base) + 1, F.length(full))
    folders = F.slice(F.split(F.lower(rel), "/"), 1, F.size(F.split(rel, "/")) - 1)
    ext = F.regexp_extract(F.lower(rel), r"(\.[^./]*)$", 1)
    out = rows.select(rel.alias("path"), ext.alias("ext"), F.col("modificationTime").alias("mtime"), "length", "content", folders.alias("folders"))
    return out.where(F.col("ext").isin(EXTENSIONS) & ~F.arrays_overlap("folders", F.array(*map(F.lit, EXCLUDED_DIRS)))).drop("folders")


def discover_packages(manifest: DataFrame, root_name: str) -> DataFrame:
    """(name, display_name, dir): the root if it holds the marker, else the folders right below that do, else the root as it is."""
    parts = F.split("path", "/")
    marked = manifest.where(F.element_at(parts, -1) == PACKAGE_MARKER).withColumn("depth", F.size(parts)).where("depth <= 2")
    shown = F.nullif(F.trim(F.regexp_extract(F.decode("content", "UTF-8"), r"""<package\b[^>]*\bname\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))
    found = marked.select("depth", F.when(F.col("depth") == 1, "").otherwise(parts[0]).alias("dir"), shown.alias("shown"))
    top = found.where("depth = 1")
    pick = top if top.limit(1).count() else found
    if not pick.limit(1).count():
        return manifest.sparkSession.createDataFrame([(root_name, root_name, "")], "name string, display_name string, dir string")
    name = F.when(F.col("dir") == "", root_name).otherwise(F.col("dir"))
    return pick.select(name.alias("name"), F.coalesce("shown", name).alias("display_name"), "dir")


def assign_package(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """paths with the package whose folder is the longest prefix of the path; null if there is none.

    A path meets packages by its own folders, one row for each level, so the join is on a key.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = paths.select("path").distinct().select("path", F.posexplode(above).alias("depth", "dir")).join(packages.select("name", "dir"), "dir")
    return paths.join(hit.groupBy("path").agg(F.max_by("name", "depth").alias("package")), "path", "left")


def xml_records(files: DataFrame) -> DataFrame:
    """(path, pos, type, key, attrs): typed records of XML files, with the attributes of their elements as a map.

    files: path, content (text). The type is the record's element if it is known, else `generic`; key: key, name or
    filename attribute, else the file's name. Malformed files give no rows.
    """
    element = rf"(?s)<({'|'.join(RECORD_TYPES)})\b([^<>]*?)/?>"
    closed = F.col("content").rlike(r"(?s)>\s*$") & (F.col("content").rlike(r"(?s)</\s*[\w.-]+\s*>\s*$") | F.col("content").rlike(r"(?s)/>\s*$"))
    rows = files.where(closed).select("path", F.regexp_extract_all("content", F.lit(element), F.lit(0)).alias("e"))
    rows = rows.select("path", F.posexplode_outer("e").alias("pos", "e"))
    kind = F.coalesce(F.nullif(F.regexp_extract("e", element, 1), F.lit("")), F.lit("generic"))
    pairs = F.regexp_extract_all("e", F.lit(r"""([\w.:-]+)\s*=\s*["']([^"']*)["']"""), F.lit(0))
    attrs = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w.:-]+)", 1).alias("k"), F.regexp_extract(p, r"""["']([^"']*)["']$""", 1).alias("v")))))
    rows = rows.select("path", F.coalesce("pos", F.lit(0)).alias("pos"), kind.alias("type"), F.coalesce(attrs, F.create_map().cast("map<string,string>")).alias("attrs"))
    return rows.withColumn("key", F.coalesce(F.col("attrs")["key"], F.col("attrs")["name"], F.col("attrs")["filename"], F.element_at(F.split("path", "/"), -1)))


TRANSLATION_SCHEMA = "struct<include:array<struct<_file:string>>,text:array<struct<_key:string,_text:string>>>"


def translations(files: DataFrame) -> DataFrame:
    """(lang, key, text): texts of a language's files, included files first seen in place; the last of a key counts.

    files: lang, path, entry (whether the file is read by itself), content (XML of text and include elements).
    """
    from lattis.operators.corpus import expand_includes

    parsed = files.select("lang", "path", "entry", F.from_xml("content", TRANSLATION_SCHEMA).alias("x"))
    inc = F.transform(F.coalesce("x.include", F.array().cast("array<struct<_file:string>>")), lambda i: F.struct(i["_file"].alias("include"), F.lit(None).cast("struct<k:string,t:string>").alias("value")))
    own = F.transform(F.coalesce("x.text", F.array().cast("array<struct<_key:string,_text:string>>")), lambda t: F.struct(F.lit(None).cast("string").alias("include"), F.struct(t["_key"].alias("k"), t["_text"].alias("t")).alias("value")))
    rows = parsed.select(F.concat_ws("\t", "lang", "path").alias("path"), "entry", F.posexplode(F.concat(inc, own)).alias("ord", "r"))
    rows = rows.select("path", "entry", "ord", F.concat(F.split("path", "\t")[0], F.lit("\t"), F.col("r.include")).alias("include"), "r.value")
    flat = expand_includes(rows.drop("entry")).join(rows.where("entry").select(F.col("path").alias("root")).distinct(), "root", "left_semi")
    flat = flat.where("value.k is not null and value.t is not null").withColumn("lang", F.split("root", "\t")[0])
    return flat.groupBy("lang", F.col("value.k").alias("key")).agg(F.max_by("value.t", F.struct("root", "ord")).alias("text"))


def write_corpus(docs: DataFrame, path: str, version: int = 1) -> None:
    """One record for each document in a new folder below path, by package (mod); then a header that names it, added to path/headers.

    A header shows up whole when its write is committed, and readers take the newest: they see the corpus before or after a
    rebuild, never a half-written one.
    """
    folder = f"docs-{uuid.uuid4().hex}"
    docs.write.partitionBy("mod").parquet(f"{path}/{folder}")
    written = docs.sparkSession.read.parquet(f"{path}/{folder}")
    header = written.groupBy("mod").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("mod", "n"))).alias("packages"), F.sum("n").alias("documents"))
    header.select("*", F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.current_timestamp().alias("written")).coalesce(1).write.mode("append").json(f"{path}/headers")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, documents) of the newest written corpus."""
    header = spark.read.json(f"{path}/headers").orderBy(F.desc("written"), "folder").limit(1)
    return header, spark.read.parquet(f"{path}/{header.first()['folder']}")
