"""Reports as tables: long rows of (group, section, rank, key, value), and the summary of a corpus."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import stats


def corpus_report(toks: DataFrame) -> DataFrame:
    """`group, method, docs, total_words, unique_words`."""
    size = stats.corpus_size(toks)
    return size.select("group", F.when(F.col("docs") >= 10, "lda").otherwise("statistical").alias("method"), "docs", "total_words", "unique_words")


def _section(df: DataFrame, name: str, rank: Column, key: Column, value: Column) -> DataFrame:
    return df.select("group", F.lit(name).alias("section"), rank.cast("int").alias("rank"), key.alias("key"), value.cast("string").alias("value"))


def statistics_report(docs: DataFrame, group: str, text: str = "text") -> DataFrame:
    """The sections of the statistical report; empty sections have no rows."""
    toks = stats.tokenized(docs, group, text)
    pair = F.concat_ws(" ", "w1", "w2")
    none = F.lit(None).cast("int")
    similarity, feeling = stats.mean_similarity(toks), stats.sentiment(toks)
    parts = [
        _section(stats.corpus_size(toks), "size", none, F.lit("total_words"), F.col("total_words")),
        _section(stats.top_terms(toks, 20), "terms", F.col("rank"), F.col("term"), F.col("cnt")),
        _section(stats.tfidf_keywords(toks), "keywords", F.col("rank"), F.col("term"), F.format_string("%.4f", "score")),
        _section(stats.top_ngrams(toks, 2, 20, least=1), "phrases", F.col("rank"), F.col("term"), F.col("cnt")),
        _section(stats.semantic_clusters(stats.pmi(toks)), "clusters", F.col("cluster_id") + 1, F.array_join("members", ", "), F.size("members")),
        _section(stats.top_pairs(toks, 15), "cooccurrence", F.col("rank"), pair, F.col("cnt")),
        _section(stats.top_ngrams(toks, 2, 15), "bigrams", F.col("rank"), F.col("term"), F.col("cnt")),
        _section(stats.top_ngrams(toks, 3, 10), "trigrams", F.col("rank"), F.col("term"), F.col("cnt")),
        _section(stats.capitalised_entities(docs, group, text), "entities", none, F.col("entity"), F.col("cnt")),
        _section(similarity, "similarity", none, F.lit("avg_similarity"), F.format_string("%.4f", "avg_similarity")),
        _section(similarity, "similarity", none, F.lit("matrix"), F.format_string("%dx%d", "n", "n")),
        _section(feeling, "sentiment", none, F.lit("positive"), F.col("positive_count")),
        _section(feeling, "sentiment", none, F.lit("negative"), F.col("negative_count")),
        _section(feeling, "sentiment", none, F.lit("ratio"), F.format_string("%.2f", "ratio")),
        _section(stats.sentiment_words(toks), "sentiment words", F.col("rank"), F.concat_ws(" ", "polarity", "term"), F.col("cnt")),
    ]
    return reduce(DataFrame.unionByName, parts)


def topic_report(topic_rows: DataFrame) -> DataFrame:
    """`topic_id, line`: the words of a topic with four decimals."""
    words = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.format_string("%.4f", "prob"), F.lit("*"), "word"))))
    return topic_rows.groupBy("topic_id").agg(F.array_join(F.transform(words, lambda x: x["col2"]), " + ").alias("line"))
