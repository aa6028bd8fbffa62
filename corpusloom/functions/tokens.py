"""Tokenizers and sentence splitting, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import lexicons as lex
from corpusloom.functions.text import SPACE

_C = lambda c: F.col(c) if isinstance(c, str) else c


def tokenize_en(text: Column | str, stopwords: list[str] = lex.STOPWORDS_EN, least: int = 3) -> Column:
    """Lower-case runs of letters, digits and underscores, of `least` characters at least, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_C(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def tokenize_zh(text: Column | str, stopwords: list[str] = lex.STOPWORDS_ZH) -> Column:
    """Overlapping pairs of Chinese characters, without stop words. A segmenter can be passed to the operators as their own `tokens` column."""
    pairs = F.regexp_extract_all(F.coalesce(_C(text), F.lit("")), F.lit(r"(?=([\x{4E00}-\x{9FA5}]{2}))"), F.lit(1))
    return F.filter(pairs, lambda w: ~F.array_contains(F.array(*[F.lit(x) for x in stopwords]), w))


def sentences(text: Column | str, least: int = 10) -> Column:
    """Parts between sentence ends, trimmed, of at least `least` characters. Decimals and abbreviations split as well."""
    parts = F.split(F.coalesce(_C(text), F.lit("")), r"[。！？.!?]")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+$", "")), lambda s: F.length(s) >= least)


def ascii_fold(text: Column | str) -> Column:
    """Letters and digits beyond ASCII become `_`, other signs beyond ASCII `.`, so that word boundaries mean the same in every engine."""
    t = F.regexp_replace(_C(text), r"[\p{Z}\x0B\x1C-\x1F\x{85}]", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}\x00-\x7F]", "."), r"[^\x00-\x7F]", "_")
