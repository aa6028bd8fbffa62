"""Encoding of texts and token budgets with a public byte-level BPE vocabulary."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import host_of, source_of
from corpusloom.llm.bpe import PIECES, Encoder, read_ranks


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary file that is installed with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process. The file is part of the cluster's image, as the libraries are."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path))
    return _ENCODERS[path]


def _pieces(batch: pa.RecordBatch) -> tuple[pa.ListArray, np.ndarray, list[str]]:
    """The list column, a code for each of its pieces, and the different pieces of the batch."""
    lists = batch.column(batch.schema.get_field_index("_pieces"))
    coded = lists.flatten().dictionary_encode()
    return lists, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _with_pieces(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    return df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECES), F.lit(0)).alias("_pieces"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Ids of each text, without special tokens: columns `id_col` and `ids` (array<int>).

    Two tiers: a minimal perfect hash resolves pieces that are whole vocabulary entries, a heap over linked bytes merges
    the others. Each different piece of a batch is resolved once. Null, empty and text of any length: one row each; null
    and empty give an empty list. Rows that share an id stay separate rows. Other columns are ignored. No shuffle.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            lists, codes, pieces = _pieces(batch)
            each = [enc.piece(p) for p in pieces]
            size = np.fromiter((len(x) for x in each), dtype=np.int64, count=len(each))
            flat = np.fromiter((i for x in each for i in x), dtype=np.int32, count=int(size.sum()))
            first = np.cumsum(size) - size
            n = size[codes]
            before = np.concatenate(([0], np.cumsum(n)))
            values = flat[np.repeat(first[codes] - before[:-1], n) + np.arange(before[-1])]
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return _with_pieces(df, text_col, [F.col(id_col)]).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns `keep`, `n_pieces` and `n_tokens` of each row: the surviving symbols of each different piece, weighted by
    how often the row has it. Null and empty texts count 0. No shuffle."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            lists, codes, pieces = _pieces(batch)
            size = np.fromiter((len(enc.piece(p)) for p in pieces), dtype=np.int64, count=len(pieces))
            before = np.concatenate(([0], np.cumsum(size[codes])))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(np.diff(offsets).astype(np.int64)), pa.array(np.diff(before[offsets]))],
                names=[*keep, "n_pieces", "n_tokens"],
            )

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return _with_pieces(df, text_col, [F.col(c) for c in keep]).mapInArrow(run, f"{kinds}, n_pieces bigint, n_tokens bigint")


def article_tokens(articles: DataFrame, languages: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`article_id, source, host, lang, n_tokens` for each article. `languages` gives `article_id, lang`, one row each;
    articles without one have null. Null source or host stays null."""
    base = articles.select("article_id", source_of("src_file").alias("source"), host_of("final_url").alias("host"), "text")
    counted = count_tokens(base, ["article_id", "source", "host"], "text", vocabulary).drop("n_pieces")
    lang = languages.select("article_id", "lang")
    return counted.join(lang, "article_id", "left").select("article_id", "source", "host", "lang", "n_tokens")


def token_totals(tokens: DataFrame) -> DataFrame:
    """Exact totals by source, language and host, and over all: `level, key, n_articles, n_tokens`. A null key is a slice of its own."""
    level = F.expr("case grouping_id() when 3 then 'source' when 5 then 'lang' when 6 then 'host' else 'all' end")
    small = tokens.groupBy("source", "lang", "host").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    return (
        small.groupingSets([["source"], ["lang"], ["host"], []], "source", "lang", "host")
        .agg(level.alias("level"), F.sum("n").alias("n_articles"), F.sum("t").alias("n_tokens"))
        .select("level", F.coalesce("source", "lang", "host").alias("key"), "n_articles", "n_tokens")
    )
