"""Readers and writers of the text formats around a crawl: seed lists, link files, article files, logs, mappings."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scalars import clean_text, normalize_url, safe_name, sha16

#: A record of the crawl log.
CRAWL_RECORD = (
    "src_file string, src_line int, seed_url string, timestamp string, final_url string, via string, http_status int, content_type string, "
    "is_directory boolean, followed_from_directory boolean, title string, date string, text string, note string"
)
MAPPING = "country_mapping map<string,string>, statistics map<string,bigint>, total_sources bigint"


def _name(df_meta: str = "_metadata.file_name") -> Column:
    """The file's name; the metadata has it percent-encoded, and a plus sign is one."""
    return F.url_decode(F.regexp_replace(F.col(df_meta), r"\+", "%2B"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """`url, country, keyword, file_prefix` of a seed list; lines that are empty, begin with # or =, or have less than four fields are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").rlike("^[#=]"))
    parts = lines.select(F.transform(F.split("v", r"\|"), lambda x: F.trim(x)).alias("p")).where(F.size("p") >= 4)
    return parts.select(*[F.col("p")[i].alias(c) for i, c in enumerate(("url", "country", "keyword", "file_prefix"))])


def read_link_files(spark: SparkSession, path: str) -> DataFrame:
    """`src_file, line_no, value`: all lines of the link files below a folder, summaries left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True)
    named = files.select(_name().alias("src_file"), "value").where(F.col("src_file") != "summary_report.txt")
    return named.select("src_file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "value")).select("src_file", (F.col("at") + 1).alias("line_no"), "value")


def harvest_urls(lines: DataFrame) -> DataFrame:
    """`seed_url, src_file, src_line`: what follows `URL:`, or a line that is an address; without fragment, each at its first place."""
    v = F.trim("value")
    url = F.when(v.startswith("URL:"), F.trim(F.substring(v, 5, 1_000_000))).when(v.rlike("^https?://"), v)
    found = lines.select(normalize_url(url).alias("seed_url"), "src_file", "line_no").where(F.col("seed_url") != "")
    return found.groupBy("seed_url").agg(F.min(F.struct("src_file", "line_no")).alias("at")).select("seed_url", "at.src_file", F.col("at.line_no").alias("src_line"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """`file_name, country, header, text` of article files: the header ends with the line that begins with `note:`; without one all is text."""
    whole = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(_name().alias("file_name"), "value")
    head = F.regexp_extract("value", r"(?s)^(.*?(?:^|\n)\s*note:[^\n]*)(?:\n|$)", 1)
    body = F.when(head != "", F.substr("value", F.length(head) + 1)).otherwise(F.col("value"))
    pair = F.transform(F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    text = F.regexp_replace(body, r"^\s+|\s+$", "")
    out = whole.select("file_name", F.element_at(F.split("file_name", "_"), 1).alias("country"), F.map_from_entries(pair).alias("header"), text.alias("text"))
    return out.where(F.col("text") != "")


def read_articles_by_header(spark: SparkSession, path: str, header_lines: int = 8, least: int = 101) -> DataFrame:
    """`file_name, title, date, url, text`: the first eight lines are the header; texts are cleaned, short ones left out."""
    whole = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(_name().alias("file_name"), F.split("value", r"\r?\n").alias("l"))
    whole = whole.where(F.size("l") > header_lines)
    pair = F.transform(F.filter(F.slice("l", 1, header_lines), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    lines = F.filter(F.transform(F.slice(F.col("l"), header_lines + 1, F.size("l")), lambda x: F.trim(x)), lambda x: x != "")
    body = whole.select("file_name", F.map_from_entries(pair).alias("h"), clean_text(F.array_join(lines, "\n")).alias("text")).where(F.length("text") >= least)
    stem = F.regexp_replace("file_name", r"\.txt$", "")
    url = F.coalesce(F.nullif(F.col("h")["final_url"], F.lit("")), F.col("h")["seed_url"])
    return body.select("file_name", F.coalesce(F.col("h")["title"], stem).alias("title"), F.col("h")["date"].alias("date"), url.alias("url"), "text")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """`src_file, country` of a mapping file; no rows if it is missing or can't be read."""
    try:
        df = spark.read.schema(MAPPING).json(path, multiLine=True)
    except Exception:
        df = spark.createDataFrame([], MAPPING)
    return df.where(F.col("country_mapping").isNotNull()).select(F.explode("country_mapping").alias("src_file", "country"))


def read_binary(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """`path, content, text` of PDF and DOCX files; `extract` is a pandas UDF from bytes to text, else text is empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(pdf|docx)$"))
    return files.select("path", "content", (extract("content") if extract is not None else F.lit("")).alias("text"))


def qualified(records: DataFrame, least: int = 350) -> DataFrame:
    """Records that are no directory pages and have `least` characters of text, with the name their article file gets."""
    kept = records.where(~F.coalesce(F.col("is_directory"), F.lit(False)) & (F.length(F.trim(F.coalesce("text", F.lit("")))) >= least))
    title = F.coalesce(F.nullif(F.substring("title", 1, 80), F.lit("")), F.lit("no_title"))
    return kept.withColumn("file_name", F.concat(safe_name(F.concat_ws("_", "src_file", sha16("final_url"), title)), F.lit(".txt")))


def article_file(record_columns: tuple[str, ...] = ("seed_url", "final_url", "title", "date", "via", "http_status", "content_type", "note")) -> Column:
    """The text of an article file: header lines, an empty line, the body."""
    head = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in record_columns]
    return F.concat_ws("\n", *head, F.lit(""), F.coalesce("text", F.lit("")))


def link_file_lines(hits: DataFrame) -> DataFrame:
    """`src_file, n, block` of link files: numbered blocks of title, address, type with the date, and description where there is one."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("src_file").orderBy("line_no", "hit_id"))
    has = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    kind = F.concat(F.lit("   类型: "), "link_type", F.when(has("hit_date"), F.concat(F.lit(" | 日期: "), "hit_date")).otherwise(""))
    block = F.concat_ws("\n", F.concat(n.cast("string"), F.lit(". "), F.coalesce("title", F.lit(""))), F.concat(F.lit("   URL: "), "url"), kind, F.when(has("description"), F.concat(F.lit("   描述: "), "description")))
    return hits.select("src_file", n.alias("n"), block.alias("block"))


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_link_files(hits: DataFrame, path: str) -> None:
    """One folder of text for each source; sources that already have one are left alone."""
    link_file_lines(hits).select("src_file", F.col("block").alias("value")).write.mode("ignore").partitionBy("src_file").text(path)


def write_mapping(summary: DataFrame, path: str) -> None:
    """The one row of `mapping_summary` as a JSON object."""
    summary.coalesce(1).write.mode("overwrite").json(path)
