"""The queries of the training-data problems, and the SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import boilerplate, language, leaks, lines, neardup, residue, tokens, truncation
from corpusloom.plans.shared import settle
from corpusloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _language_lines(spark: SparkSession, folder: str, main_only: bool) -> DataFrame:
    articles, labels = table(spark, folder, "articles"), table(spark, folder, "article_labels")
    pages = residue.main_bodies(articles) if main_only else articles
    return language.label_lines(pages, language.train(articles, labels))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.label_faults(settle(_language_lines(spark, folder, True)), table(spark, folder, "article_labels"))


def p1_articles(spark: SparkSession, folder: str) -> DataFrame:
    return language.article_languages(_language_lines(spark, folder, False))


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    articles, labels = table(spark, folder, "articles"), table(spark, folder, "article_labels")
    return language.word_segments(language.label_lines(articles, language.train(articles, labels), spans=True))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "articles")
    furniture = residue.furniture_lines(articles)
    return boilerplate.furniture_places(residue.main_bodies(articles, furniture), furniture=furniture)


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_texts(table(spark, folder, "articles"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(residue.main_bodies(table(spark, folder, "articles")).select("article_id", "text"), n=3, similarity=0.5)


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.link_counts(residue.main_bodies(table(spark, folder, "articles")).select("article_id", "text"), n=3, similarity=0.5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_line_places(table(spark, folder, "articles"))


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, folder, "articles"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.judge_records(table(spark, folder, "articles")).where("is_residue").select("article_id")


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return residue.judge_records(table(spark, folder, "articles"))


def p7_article_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.article_tokens(table(spark, folder, "articles"), p1_articles(spark, folder))


def p7_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_totals(p7_article_tokens(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_report(spark, folder).select("doc_id", "item_id")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    judged = truncation.judge_endings(table(spark, folder, "documents"))
    return judged.where("reason is not null").select("doc_id")


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated_share(truncation.judge_endings(table(spark, folder, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_articles, p1_segments, p2_found, p2_texts, p3_found, p3_links, p4_found, p4_texts, p6_found, p6_records, p7_article_tokens, p7_token_totals,
        p8_ids, p9_found, p9_report, p10_found, p10_share,
    )
}

SQL: dict[str, str] = {}

_KEYS = r"""
WITH t AS (
  SELECT article_id, coalesce(lower(trim(src_file, ' ')), '') AS source, string_split(text, chr(10)) AS lines FROM articles WHERE text <> ''
), l AS (
  SELECT article_id, source, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM t
), k AS (
  SELECT article_id, source, line_no, line, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l
), n AS (SELECT source, count(*) AS total FROM t GROUP BY source), f AS (
  SELECT k.source, k.key FROM k JOIN n USING (source) WHERE key <> ''
  GROUP BY k.source, k.key, n.total HAVING count(DISTINCT article_id) >= 5 AND count(DISTINCT article_id) * 100 >= n.total * 10
)
"""
SQL["p4_found"] = _KEYS + "SELECT article_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (source, key)"
SQL["p4_texts"] = _KEYS + """
SELECT a.article_id, CASE WHEN a.text IS NULL OR a.text = '' THEN a.text ELSE coalesce(s.text, '') END AS text FROM articles a LEFT JOIN (
  SELECT article_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM k LEFT JOIN f USING (source, key) WHERE f.key IS NULL GROUP BY article_id
) s USING (article_id)"""

_GRAMS = r"[array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]"
_WORDS = r"regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
SQL["p9_found"] = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents)),
i AS (SELECT DISTINCT item_id, unnest({_GRAMS}) AS g FROM (
  SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS.format("question")} AS w FROM eval_items))
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"""

SQL["p9_report"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), d AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM w),
f AS (
  SELECT item_id, 'passage' AS kind, {_WORDS.format("passage")} AS w FROM eval_items UNION ALL SELECT item_id, 'question' AS kind, {_WORDS.format("question")} AS w FROM eval_items),
i AS (SELECT DISTINCT item_id, kind, unnest({_GRAMS}) AS g FROM f),
n AS (SELECT doc_id, item_id, count(*) FILTER (WHERE kind = 'passage') AS in_passage, count(*) FILTER (WHERE kind = 'question') AS in_question FROM d JOIN i USING (g) GROUP BY ALL),
a AS (SELECT item_id, array_to_string({_WORDS.format("answer")}, ' ') AS answer FROM eval_items)
SELECT doc_id, item_id, in_passage, in_question, answer <> '' AND contains(' ' || array_to_string(w.w, ' ') || ' ', ' ' || answer || ' ') AS answer_near
FROM n JOIN w USING (doc_id) JOIN a USING (item_id)"""
