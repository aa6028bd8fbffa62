"""Lines repeated within one source: finding them, and rebuilding texts without them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import letters_key, source_of
from corpusloom.plans.shared import maybe_broadcast, settle

#: Source of articles without a src_file.
NO_SOURCE = ""


def line_hash(line: Column) -> Column:
    """Hash of a line's letters in lower case; null if it has none."""
    key = letters_key(line)
    return F.when(key != "", F.xxhash64(key))


def _base(articles: DataFrame) -> DataFrame:
    source = F.coalesce(source_of("src_file"), F.lit(NO_SOURCE))
    return articles.where(F.col("text") != "").select("article_id", source.alias("source"), F.split("text", "\n").alias("lines"))


def repeated_lines(articles: DataFrame, least: int = 5, percent: int = 10) -> DataFrame:
    """`source, line_hash, n_articles, of_articles`: lines in at least `least` articles of a source and `percent` % of those with text.

    Each article sends a line once, and counts combine before the shuffle, so neither a hot source nor a hot line gathers in a task.
    """
    base = _base(articles).select("source", F.array_distinct(F.transform("lines", line_hash)).alias("hashes"))
    total = base.groupBy("source").agg(F.count("*").alias("of_articles"))
    each = base.select("source", F.explode("hashes").alias("line_hash"))
    counts = each.where(F.col("line_hash").isNotNull()).groupBy("source", "line_hash").agg(F.count("*").alias("n_articles"))
    joined = counts.where(F.col("n_articles") >= least).join(total, "source")
    return joined.where(F.col("n_articles") * 100 >= F.col("of_articles") * percent).select("source", "line_hash", "n_articles", "of_articles")


def repeated_line_places(articles: DataFrame, least: int = 5, percent: int = 10) -> DataFrame:
    """`article_id, line_no` of each occurrence of a repeated line; lines count from 1, blank ones included.

    Null and empty texts give no row, lines without letters never count, a null src_file is a source of its own. Rows are taken
    as articles, so an article that stands in the table twice counts twice and gives its rows twice.
    """
    found = maybe_broadcast(settle(repeated_lines(articles, least, percent).select("source", "line_hash")))
    lines = _base(articles).select("article_id", "source", F.posexplode(F.transform("lines", line_hash)).alias("at", "line_hash"))
    hits = lines.where(F.col("line_hash").isNotNull()).join(found, ["source", "line_hash"])
    return hits.select("article_id", (F.col("at") + 1).alias("line_no"))


def without_repeated_lines(articles: DataFrame, least: int = 5, percent: int = 10) -> DataFrame:
    """`article_id, text` of every article, without the repeated lines of its source; texts without any, null and empty ones stay as they are.

    The lines of one source travel as one array: a line must be in `percent` % of the articles, so an array holds at most
    100 / percent times the lines of a mean article.
    """
    found = repeated_lines(articles, least, percent).groupBy("source").agg(F.collect_set("line_hash").alias("drop"))
    found = maybe_broadcast(settle(found), 20_000)
    source = F.coalesce(source_of("src_file"), F.lit(NO_SOURCE))
    joined = articles.select("article_id", "text", source.alias("source")).join(found, "source", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("drop", line_hash(x)), F.lit(False))), "\n")
    return joined.select("article_id", F.when(F.col("drop").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text"))
