"""Term statistics of groups of documents. Every function takes a table with the columns `group, doc_id, tokens` (see `tokenized`)."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom import lexicons as lex
from corpusloom.functions.tokens import ascii_fold, tokenize_en


def tokenized(docs: DataFrame, group: str, text: str = "text", doc_id: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """`group, doc_id, tokens` of the documents with visible text; `tokens` may be any tokenizer's column."""
    kept = docs.where(F.trim(text) != "")
    return kept.select(F.col(group).alias("group"), F.col(doc_id).alias("doc_id"), (tokenize_en(text) if tokens is None else tokens).alias("tokens"))


def _top(df: DataFrame, key: str, k: int, by: str = "cnt") -> DataFrame:
    """The k greatest of each group; ties go to the smaller key. Spark keeps k rows of each group before it shuffles."""
    order = W.partitionBy("group").orderBy(F.desc(by), F.asc(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_counts(toks: DataFrame) -> DataFrame:
    return toks.select("group", F.explode("tokens").alias("term")).groupBy("group", "term").agg(F.count("*").alias("cnt"))


def top_terms(toks: DataFrame, k: int = 30) -> DataFrame:
    return _top(term_counts(toks), "term", k)


def corpus_size(toks: DataFrame) -> DataFrame:
    """`group, docs, total_words, unique_words`."""
    docs = toks.groupBy("group").agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).cast("bigint").alias("total_words"))
    unique = term_counts(toks).groupBy("group").agg(F.count("*").alias("unique_words"))
    return docs.join(unique, "group", "left").select("group", "docs", "total_words", F.coalesce("unique_words", F.lit(0).cast("bigint")).alias("unique_words"))


def ngram_counts(toks: DataFrame, n: int, block: int = 10_000) -> DataFrame:
    """`group, term, cnt` of n-grams over the group's token stream, the documents in the order of `doc_id`; n-grams run over the ends of documents.

    Only the first n-1 tokens of the following documents are needed. They come from windows over blocks of `block` ids, and from one
    window over the blocks, so no task sees all documents of a group.
    """
    head = lambda c: F.slice(c, 1, n - 1)
    full = toks.where(F.size("tokens") > 0).withColumn("block", F.floor(F.col("doc_id") / block))
    slim = full.select("group", "block", "doc_id", head("tokens").alias("head"))
    inner = W.partitionBy("group", "block").orderBy("doc_id")
    none = F.array().cast("array<string>")
    after = lambda c, w: head(F.concat(*[F.coalesce(F.lead(c, i).over(w), none) for i in range(1, n)]))
    slim = slim.withColumn("next", after("head", inner)).withColumn("first", F.row_number().over(inner) == 1)
    blocks = slim.where("first").select("group", "block", head(F.concat("head", "next")).alias("start"))
    blocks = blocks.withColumn("beyond", after("start", W.partitionBy("group").orderBy("block"))).drop("start")
    joined = full.join(slim.select("group", "block", "doc_id", "next"), ["group", "block", "doc_id"]).join(blocks, ["group", "block"])
    stream = F.concat("tokens", head(F.concat("next", "beyond")))
    grams = F.transform(F.sequence(F.lit(1), F.size("s") - (n - 1)), lambda i: F.array_join(F.slice("s", i, n), " "))
    out = joined.select("group", F.size("tokens").alias("own"), stream.alias("s")).where(F.size("s") >= n)
    return out.select("group", F.explode(grams).alias("term")).groupBy("group", "term").agg(F.count("*").alias("cnt"))


def top_ngrams(toks: DataFrame, n: int, k: int, least: int = 2) -> DataFrame:
    return _top(ngram_counts(toks, n).where(F.col("cnt") >= least), "term", k)


def cooccurrence(toks: DataFrame, window: int = 5) -> DataFrame:
    """`group, w1, w2, cnt`, w1 <= w2: pairs of words at most `window` places apart in one document; each pair of places counts twice."""
    rest = [F.when(F.size("tokens") > o, F.zip_with(F.slice("tokens", 1, F.size("tokens") - o), F.slice("tokens", 1 + o, F.size("tokens")), lambda a, b: F.struct(F.least(a, b).alias("w1"), F.greatest(a, b).alias("w2")))) for o in range(1, window + 1)]
    empty = F.slice(F.array(F.struct(F.lit("").alias("w1"), F.lit("").alias("w2"))), 1, 0)
    pairs = toks.select("group", F.explode(F.concat(*[F.coalesce(r, empty) for r in rest])).alias("p"))
    counts = pairs.groupBy("group", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg((F.count("*") * 2).alias("cnt"))
    return counts


def top_pairs(toks: DataFrame, k: int = 30) -> DataFrame:
    order = W.partitionBy("group").orderBy(F.desc("cnt"), "w1", "w2")
    return cooccurrence(toks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pmi(toks: DataFrame, k: int = 30) -> DataFrame:
    """`group, w1, w2, cnt, pmi` of the k most frequent pairs: log2((c/N) / ((f1/N)(f2/N))), N the words of the group."""
    top = top_pairs(toks, k)
    freq = term_counts(toks)
    total = freq.groupBy("group").agg(F.sum("cnt").alias("n"))
    one = freq.select("group", F.col("term").alias("w1"), F.col("cnt").alias("f1"))
    two = freq.select("group", F.col("term").alias("w2"), F.col("cnt").alias("f2"))
    joined = top.join(one, ["group", "w1"]).join(two, ["group", "w2"]).join(total, "group")
    value = F.log2((F.col("cnt") / F.col("n")) / ((F.col("f1") / F.col("n")) * (F.col("f2") / F.col("n"))))
    return joined.select("group", "w1", "w2", "cnt", F.round(value, 4).alias("pmi"))


def semantic_clusters(pairs: DataFrame, top_k: int = 5, starts: int = 20, sweep: int = 50, least: int = 3, most: int = 8) -> DataFrame:
    """`group, cluster_id, members` grown greedily from pairs with the highest `pmi`; a group has at most as many rows as `pmi` kept, so it fits a task.

    Only a pair of words that are in no cluster yet starts one; a cluster then takes every word that the first `sweep` pairs tie to it,
    words of earlier clusters too. Equal values are taken by (w1, w2)."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = list(pdf.sort_values(["pmi", "w1", "w2"], ascending=[False, True, True])[["w1", "w2"]].itertuples(index=False, name=None))
        taken: set[str] = set()
        rows = []
        for a, b in ranked[:starts]:
            if a in taken or b in taken:
                continue
            members = dict.fromkeys((a, b))
            for c, d in ranked[:sweep]:
                if c in members:
                    members[d] = None
                elif d in members:
                    members[c] = None
            if len(members) >= least and len(rows) < top_k:
                taken.update(members)
                rows.append((pdf["group"].iloc[0], len(rows), list(members)[:most]))
        return pd.DataFrame(rows, columns=["group", "cluster_id", "members"])

    return pairs.select("group", "w1", "w2", "pmi").groupBy("group").applyInPandas(grow, "group string, cluster_id int, members array<string>")


def _weights(toks: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """`group, doc_id, term, x, n`: unit vectors of tf * (ln((1+n)/(1+df)) + 1) over the vocabulary; n counts all documents of the group."""
    n = toks.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    tf = toks.select("group", "doc_id", F.explode("tokens").alias("term")).groupBy("group", "doc_id", "term").agg(F.count("*").alias("tf"))
    if vocabulary is not None:
        tf = tf.join(vocabulary.select("group", "term"), ["group", "term"])
    df = tf.groupBy("group", "term").agg(F.count("*").alias("df"))
    w = tf.join(df, ["group", "term"]).join(n, "group").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("group", "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, ["group", "doc_id"]).select("group", "doc_id", "term", (F.col("w") / F.col("norm")).alias("x"), "n")


def tfidf_keywords(toks: DataFrame, vocabulary: int = 50, k: int = 20) -> DataFrame:
    """`group, term, score`: mean TF-IDF over the group's documents, vectors limited to the `vocabulary` most frequent terms; groups of two documents or more."""
    mean = _weights(toks, top_terms(toks, vocabulary)).groupBy("group", "term").agg((F.sum("x") / F.first("n")).alias("score"))
    return _top(mean.withColumn("score", F.round("score", 6)), "term", k, "score").select("group", "term", F.round("score", 4).alias("score"), "rank")


def mean_similarity(toks: DataFrame) -> DataFrame:
    """`group, n, avg_similarity`: mean cosine of all pairs of documents, from the length of the sum of unit vectors: no pairs are built."""
    n = toks.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    per_term = _weights(toks, None).groupBy("group", "term").agg(F.sum("x").alias("s"))
    sums = per_term.groupBy("group").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    joined = n.join(sums, "group", "left")
    value = (F.coalesce("q", F.lit(0.0)) - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return joined.select("group", "n", F.round(value, 4).alias("avg_similarity"))


def capitalised_entities(docs: DataFrame, group: str, text: str = "text", least: int = 2, skip: list[str] = lex.NO_ENTITIES) -> DataFrame:
    """`group, entity, cnt`: runs of capitalised words, also over line breaks, that a group has at least twice."""
    found = F.regexp_extract_all(ascii_fold(text), F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0))
    each = docs.where(F.col(text).isNotNull()).select(F.col(group).alias("group"), F.explode(found).alias("entity")).where(~F.col("entity").isin(skip))
    return each.groupBy("group", "entity").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def sentiment(toks: DataFrame, positive: list[str] = lex.POSITIVE_EN, negative: list[str] = lex.NEGATIVE_EN) -> DataFrame:
    """`group, positive_count, negative_count, ratio`; the ratio is positive / (negative + 1). Groups without such words have zeros."""
    count = lambda words: F.coalesce(F.sum(F.size(F.filter("tokens", lambda w: w.isin(words)))), F.lit(0)).cast("bigint")
    both = toks.groupBy("group").agg(count(positive).alias("positive_count"), count(negative).alias("negative_count"))
    return both.withColumn("ratio", F.round(F.col("positive_count") / (F.col("negative_count") + 1), 4))


def sentiment_words(toks: DataFrame, positive: list[str] = lex.POSITIVE_EN, negative: list[str] = lex.NEGATIVE_EN, k: int = 10) -> DataFrame:
    """`group, polarity, term, cnt, rank`: the k most frequent words of either list."""
    words = [(w, "positive") for w in positive] + [(w, "negative") for w in negative]
    table = F.create_map(*[F.lit(x) for pair in words for x in pair])
    counts = term_counts(toks).withColumn("polarity", F.element_at(table, F.col("term"))).where(F.col("polarity").isNotNull())
    order = W.partitionBy("group", "polarity").orderBy(F.desc("cnt"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("group", "polarity", "term", "cnt", "rank")


def route_methods(toks: DataFrame, least_docs: int = 10) -> DataFrame:
    """`group, docs, method`: topic modelling from `least_docs` documents on, statistics below."""
    return toks.groupBy("group").agg(F.count("*").alias("docs")).withColumn("method", F.when(F.col("docs") >= least_docs, "lda").otherwise("statistical"))


def textrank(toks: DataFrame, window: int = 5, k: int = 15, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """`group, term, score, rank`: weighted PageRank over the co-occurrence graph, a fixed number of rounds."""
    pairs = cooccurrence(toks, window).where(F.col("w1") != F.col("w2"))
    edges = pairs.select("group", F.col("w1").alias("a"), F.col("w2").alias("b"), "cnt").unionByName(pairs.select("group", F.col("w2").alias("a"), F.col("w1").alias("b"), "cnt"))
    out = edges.groupBy("group", "a").agg(F.sum("cnt").alias("out"))
    from corpusloom.plans.shared import settle

    edges = settle(edges.join(out, ["group", "a"]).select("group", "a", "b", (F.col("cnt") / F.col("out")).alias("share")))
    score = edges.select("group", F.col("a").alias("term")).distinct().withColumn("score", F.lit(1.0))
    for r in range(rounds):
        sent = edges.join(score.withColumnRenamed("term", "a"), ["group", "a"]).groupBy("group", F.col("b").alias("term")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        score = sent.select("group", "term", (F.lit(1 - damping) + damping * F.col("got")).alias("score"))
        if r % 4 == 3:
            score = settle(score)
    return _top(score.withColumn("score", F.round("score", 4)), "term", k, "score")
