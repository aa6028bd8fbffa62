"""Source files, countries, link counts: the lookups around a link list."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.scalars import country_of_name, normalize_country


def seed_mapping(sites: DataFrame) -> DataFrame:
    """`src_file, country` of the seed list; of several sites with one prefix the last in the order of url holds."""
    named = sites.where(F.col("file_prefix").isNotNull()).select(F.concat("file_prefix", F.lit("_links.txt")).alias("src_file"), normalize_country("country").alias("country"), "url")
    return named.groupBy("src_file").agg(F.max_by("country", F.coalesce("url", F.lit(""))).alias("country"))


def country_of_files(files: DataFrame, mapping: DataFrame, default: DataFrame) -> DataFrame:
    """`src_file, country`: from `mapping`, else from `default`; files of neither are left out (see `unmatched`)."""
    first = files.join(mapping.select("src_file", F.col("country").alias("a")), "src_file", "left")
    both = first.join(default.select("src_file", F.col("country").alias("b")), "src_file", "left")
    return both.select("src_file", F.coalesce("a", "b").alias("country")).where(F.col("country").isNotNull())


def docs_by_country(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """`country, docs`. Documents are counted by file before the lookup, so the lookup sees a row for each file."""
    files = docs.groupBy("src_file").agg(F.count("*").alias("n"))
    return files.join(mapping.select("src_file", "country"), "src_file").groupBy("country").agg(F.sum("n").alias("docs"))


def unmatched(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """`src_file, docs` of files that the mapping lacks."""
    return docs.groupBy("src_file").agg(F.count("*").alias("docs")).join(mapping, "src_file", "left_anti")


def link_counts(lines: DataFrame, text: str = "value") -> DataFrame:
    """`src_file, links`: how often `URL:` stands in each link file."""
    return lines.groupBy("src_file").agg(F.sum(F.regexp_count(text, F.lit("URL:"))).cast("bigint").alias("links"))


def link_summary(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """`no, country, src_file, links, total_files, total_links` of `link_counts`, numbered by file; files without a country go by their own name."""
    named = counts.join(mapping.groupBy("src_file").agg(F.min("country").alias("country")), "src_file", "left")
    every = W.partitionBy(F.lit(1))  # one row for each link file
    return named.select(
        F.row_number().over(every.orderBy("src_file")).alias("no"), F.coalesce("country", "src_file").alias("country"), "src_file", "links",
        F.count("*").over(every).alias("total_files"), F.sum("links").over(every).alias("total_links"),
    )


def mapping_summary(mapping: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: `country_mapping` (map), `statistics` (map of documents by country), `total_sources`. The maps are as small as the seed list."""
    entries = lambda df, k, v: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias("m")).withColumn("k", F.lit(1))
    a = entries(mapping, "src_file", "country").withColumnRenamed("m", "country_mapping")
    b = entries(docs_by_country(docs, mapping), "country", "docs").withColumnRenamed("m", "statistics")
    return a.join(b, "k").drop("k").withColumn("total_sources", F.size("country_mapping").cast("bigint"))


def prefix_country(names: DataFrame, name: str, mapping: DataFrame, compat: bool = False) -> DataFrame:
    """`name, country` by the first mapping key that the file name starts with; else by the parts of the name if `compat`, else null.

    The key ends in `_links.txt`, so the name is cut after it and looked up by equality; no name meets all keys.
    """
    cut = F.regexp_extract(F.col(name), r"^(.*?_links\.txt)", 1)
    joined = names.select(F.col(name).alias("name"), cut.alias("src_file")).join(mapping.select("src_file", "country"), "src_file", "left")
    other: Column = country_of_name("name") if compat else F.lit(None).cast("string")
    return joined.select("name", F.coalesce("country", other).alias("country"))


def first_urls(hits: DataFrame) -> DataFrame:
    """`url, src_file, line_no`: each address once, without its fragment, at its first place by file and line."""
    clean = hits.select(F.substring_index(F.trim(F.coalesce("url", F.lit(""))), "#", 1).alias("url"), "src_file", "line_no").where(F.col("url").rlike("^https?://"))
    return clean.groupBy("url").agg(F.min(F.struct("src_file", "line_no")).alias("at")).select("url", "at.src_file", "at.line_no")


