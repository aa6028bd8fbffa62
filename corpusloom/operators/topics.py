"""Topic models by group, with Spark ML, and their coherence."""

from collections.abc import Callable
from functools import reduce

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.shared import settle


def fit_topics(toks: DataFrame, k: int = 5, seed: int = 42, passes: int = 10, min_df: int = 2, max_df: float = 0.7, vocabulary: int = 100_000):
    """The vectoriser and the LDA model (online variational Bayes, learned document prior) of one group's documents; None if no term is left."""
    docs = settle(toks.select("doc_id", "tokens").where(F.size("tokens") > 0))
    n = docs.count()
    if n < min_df:
        return None
    vectors = CountVectorizer(inputCol="tokens", outputCol="features", minDF=min_df, maxDF=max(max_df, min_df / n), vocabSize=vocabulary).fit(docs)
    if not vectors.vocabulary:
        return None
    lda = LDA(k=k, seed=seed, maxIter=passes, optimizer="online", subsamplingRate=1.0, optimizeDocConcentration=True)
    return vectors, lda.fit(vectors.transform(docs))


def topic_words(toks: DataFrame, k: int = 5, words: int = 10, **how) -> DataFrame:
    """`topic_id, rank, word, prob`: the heaviest words of each topic."""
    spark = toks.sparkSession
    fitted = fit_topics(toks, k, **how)
    if fitted is None:
        return spark.createDataFrame([], "topic_id int, rank int, word string, prob double")
    vectors, model = fitted
    names = F.array(*[F.lit(w) for w in vectors.vocabulary]) if len(vectors.vocabulary) <= 1000 else None
    topics = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    if names is not None:
        word = F.element_at(names, F.col("t.termIndices") + 1)
        return topics.select(F.col("topic").alias("topic_id"), (F.col("rank") + 1).alias("rank"), word.alias("word"), F.round("t.termWeights", 4).alias("prob"))
    table = spark.createDataFrame(list(enumerate(vectors.vocabulary)), "i int, word string")
    joined = topics.join(table, F.col("t.termIndices") == F.col("i"))
    return joined.select(F.col("topic").alias("topic_id"), (F.col("rank") + 1).alias("rank"), "word", F.round("t.termWeights", 4).alias("prob"))


def coherence(toks: DataFrame, topics: DataFrame, window: int = 110) -> DataFrame:
    """`topic_id, c_v`: NPMI vectors of a topic's words over sliding boolean windows, and their mean cosine with the topic's sum vector.

    Only topic words are kept before windows are built; counts of words and pairs combine before the shuffle.
    """
    words = topics.select("topic_id", "word")
    vocabulary = [r["word"] for r in words.select("word").distinct().orderBy("word").collect()]
    if not vocabulary:
        return toks.sparkSession.createDataFrame([], "topic_id int, c_v double")
    known = F.array(*[F.lit(w) for w in vocabulary])
    last = F.greatest(F.size("tokens") - (window - 1), F.lit(1))
    wins = toks.where(F.size("tokens") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_sort(F.array_intersect(F.slice("tokens", i, window), known)))).alias("w"))
    wins = settle(wins.groupBy("w").agg(F.count("*").alias("n")))
    total = wins.agg(F.sum("n")).first()[0] or 1
    one = wins.select(F.explode("w").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("na"))
    pair = wins.select(F.explode("w").alias("a"), "w", "n").select("a", F.explode("w").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("nab"))
    w1, w2 = words.withColumnRenamed("word", "a"), words.withColumnRenamed("word", "b")
    grid = w1.join(w2, "topic_id").join(one, "a").join(one.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").join(pair, ["a", "b"], "left")
    p = F.coalesce("nab", F.lit(0)) / total + 1e-12
    npmi = grid.select("topic_id", "a", "b", (F.log(p / (F.col("na") / total * F.col("nb") / total)) / -F.log(p)).alias("v"))
    whole = npmi.groupBy("topic_id", "b").agg(F.sum("v").alias("s"))
    cos = npmi.join(whole, ["topic_id", "b"]).groupBy("topic_id", "a").agg((F.sum(F.col("v") * F.col("s")) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("s") * F.col("s"))))).alias("c"))
    return cos.groupBy("topic_id").agg(F.round(F.avg("c"), 4).alias("c_v"))


def by_group(toks: DataFrame, groups: list[str | None], rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`group` and the columns of `rows_of`, which gets the documents of each of the groups in turn."""
    parts = [rows_of(toks.where(F.col("group").eqNullSafe(F.lit(g)))).select(F.lit(g).cast("string").alias("group"), "*") for g in groups]
    return reduce(DataFrame.unionByName, parts)
