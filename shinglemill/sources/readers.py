"""Readers of the corpora's formats. All go through Spark's sources, so any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.functions import spans as S

ANNOTATED = (
    "doc_id string, text string, meta struct<countries:string,legal_branch:string,year:string>, "
    "annotations map<string,struct<entity_mentions:array<struct<start_offset:int,end_offset:int,entity_type:string,identifier_type:string,entity_id:string>>>>"
)
MASKED = ("DIRECT", "QUASI")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its scan has fewer tasks than there are cores, since expressions over texts cost far more than
    moving them. A table of more files or row groups is left as its scan is, so no large table is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def annotated_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON arrays of annotated documents, in the order of the files and of the documents in each: ``part`` and ``place``."""
    out = None
    for part, path in enumerate(paths):
        whole = spark.read.text(path, wholetext=True)
        docs = whole.select(F.posexplode(F.from_json("value", f"array<struct<{_fields(ANNOTATED)}>>")).alias("place", "d")).select(F.lit(part).alias("part"), "place", "d.*")
        out = docs if out is None else out.unionByName(docs)
    return out


def _fields(ddl: str) -> str:
    """DDL columns as struct fields."""
    depth, out, name = 0, [], True
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == " " and depth == 0 and name and out and out[-1] not in ", ":
            out.append(":")
            name = False
            continue
        if ch == "," and depth == 0:
            name = True
        out.append(ch)
    return "".join(out)


def gold_spans(docs: DataFrame, mode: str = "first", types: list[str] | None = None, identifiers: tuple = MASKED) -> DataFrame:
    """``docs`` with resolved ``spans`` of the first annotator by name, or of all (``union``)."""
    if mode not in ("first", "union"):
        raise ValueError(mode)
    entries = F.array_sort(F.transform(F.map_keys("annotations"), lambda k: k))
    used = F.slice(entries, 1, 1) if mode == "first" else entries

    def of(annotator):
        mentions = F.element_at(F.col("annotations"), annotator)["entity_mentions"]
        chosen = F.filter(mentions, lambda m: m["identifier_type"].isin(*identifiers) & (m["entity_type"].isin(*types) if types else F.lit(True)))
        return F.transform(chosen, lambda m: F.struct(m["start_offset"].alias("start"), m["end_offset"].alias("end"), m["entity_type"].alias("type"), F.substring(F.col("text"), m["start_offset"] + 1, m["end_offset"] - m["start_offset"]).alias("surface"), F.concat_ws("\u0001", annotator, m["entity_id"]).alias("ent")))

    return docs.withColumn("spans", S.resolve(F.flatten(F.transform(used, of))))


def paragraph_lists(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """Parquet whose texts are lists of paragraphs, joined by line ends."""
    return spark.read.parquet(path).withColumn(column, F.array_join(column, "\n"))


def json_lines(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """JSON lines, compressed or not; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def mail_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, body)`` of a tree of text files, one mail each, cut at ``@subject`` and trimmed."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.trim(F.regexp_replace(F.get(F.split("value", "@subject", 2), F.lit(0)), r"^\s+|\s+$", "")).alias("body"))


def category_members(spark: SparkSession, path: str) -> DataFrame:
    """``(place, pageid, title)`` of a saved category response."""
    schema = "query struct<categorymembers:array<struct<pageid:bigint,ns:bigint,title:string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    return whole.select(F.posexplode("r.query.categorymembers").alias("place", "m")).select("place", "m.pageid", "m.title")


REVISIONS = "pageid bigint, title string, response_sha256 string, response struct<query:struct<pages:array<struct<pageid:bigint,revisions:array<struct<revid:bigint,timestamp:string,slots:struct<main:struct<contentmodel:string,content:string>>>>>>>>"


def revision_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVISIONS).json(path)


def revisions(rows: DataFrame) -> DataFrame:
    """``(page, revid, ts, model, content)`` of saved responses."""
    page = rows.select(F.explode("response.query.pages").alias("p")).select(F.col("p.pageid").alias("page"), F.explode("p.revisions").alias("r"))
    return page.select("page", "r.revid", F.col("r.timestamp").alias("ts"), F.col("r.slots.main.contentmodel").alias("model"), F.col("r.slots.main.content").alias("content"))


def merge_retries(members: DataFrame, original: DataFrame, retries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a cohort in its order, and the members still missing. Pages that are unknown, repeated, or answered by another page
    raise."""
    rows = original.unionByName(retries, allowMissingColumns=True)
    unknown = rows.join(members, "pageid", "left_anti").count()
    repeated = rows.groupBy("pageid").count().filter("count > 1").count()
    pages = F.col("response.query.pages")
    other = rows.filter(F.coalesce((F.size(pages) != 1) | (F.get(pages, F.lit(0))["pageid"] != F.col("pageid")), F.lit(True))).count()
    if unknown or repeated or other:
        raise ValueError(f"pages unknown {unknown}, repeated {repeated}, answered by another {other}")
    return members.select("place", "pageid").join(rows, "pageid").orderBy("place"), members.join(rows, "pageid", "left_anti").orderBy("place")


def verify_manifest(spark: SparkSession, root: str, files: list[dict]) -> DataFrame:
    """``(file, problem)`` of files that are missing or differ in size or SHA-256 from ``{file, bytes, sha256}``; empty when all is well."""
    wanted = spark.createDataFrame([(f["file"], f["bytes"], f["sha256"]) for f in files], "file string, bytes long, sha256 string")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("hash"))
    problem = F.when(F.col("hash").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("hash") != F.col("sha256"), "content")
    return wanted.join(there, "file", "left").select("file", problem.alias("problem")).filter("problem is not null")
