"""Texts that end before their author's end: length spikes of each source, and endings the corpus doesn't know as endings."""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.codes import mixed, slices
from corpusloom.plans.shared import settle

_CLOSERS = r"[\"'”’»)\]』」›*_]"
#: A text whose last line matches is whole: a sentence end, with closing marks.
_SENTENCE_END = rf"[.!?。！？।]{_CLOSERS}*$"
#: Marks that software puts where it cut.
_CUT_MARK = r"(?i)(?:\.\.\.+|…|\[\s*(?:\.{3}|…|\+\s*\d+\s*\w*)\s*\]|[\[(](?:more|continued|read more|cont\.?|suite|далее|подробнее|ещё|más|selengkapnya|još|更多|未完)[\])]|(?:read more|continue reading|читать далее|leer más|lire la suite|baca selengkapnya|阅读更多|阅读全文))\s*[»>→]*$"
#: Blank signs at the end of a text, in a text's columns and in Python.
_BLANK = " \t\n\x0b\f\r\u00a0\u3000\u200b\ufeff"
_EMPTY, _START, _COMMA, _END, _HAN, _WORDS = (mixed(np.arange(6, dtype=np.uint64) + np.uint64(77))[i] for i in range(6))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 no token, 1 part of a word, 2 Han, 3 line break, 4 sentence end, 5 comma; whether it is a digit; upper case; a random number."""
    top = 0x32400
    every = "".join(map(chr, range(top))).encode("utf-32-le", "surrogatepass").decode("utf-32-le", "surrogatepass")
    kind = np.zeros(top + 1, dtype=np.int8)
    for mark, pattern in ((1, r"[\p{L}\p{M}\p{N}]+"), (2, r"\p{Han}+"), (3, r"\n"), (4, r"[.!?。！？…]"), (5, r"[,;:，、；：]")):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = mark
    digit, upper = (np.array([*map(test, every), False], dtype=bool) for test in (str.isdigit, lambda c: c != c.lower()))
    return kind, digit, upper, mixed(np.arange(top + 1, dtype=np.uint64) ^ np.uint64(0xC0FFEE))


def _last_line(text: Column) -> Column:
    return F.substring_index(F.rtrim(text, F.lit(_BLANK)), "\n", -1)


def length_spikes(lengths: DataFrame, least: int = 5, times: float = 8.0, around: int = 40) -> DataFrame:
    """`source, unit, spike`: lengths (`source, unit, n`) that at least `least` texts of the source have, and `times` as many as
    the mean of the lengths up to `around` away. The histogram is a pre-aggregated count, one row for each length."""
    hist = lengths.groupBy("source", "unit", "n").agg(F.count("*").alias("texts"))
    near = W.partitionBy("source", "unit").orderBy("n").rangeBetween(-around, around)
    rest = (F.sum("texts").over(near) - F.col("texts")) / F.lit(2.0 * around)
    return (
        hist.withColumn("rest", rest)
        .where((F.col("texts") >= least) & (F.col("texts") >= F.lit(times) * F.greatest(F.col("rest"), F.lit(0.25))))
        .select("source", "unit", F.col("n").alias("spike"))
    )


def _coded(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Where each text's tokens begin (one entry more than texts), and by token the kind (0 line break, 1 sentence end, 2 comma, 3 word), mask,
    exact hash, and whether it is Han. The mask of words with capitals is the same for all, that of numbers too."""
    kinds, digits, uppers, numbers = _tables()
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    code = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(kinds) - 1)
    part = kinds[code]
    begin = part > 0
    begin[1:] &= (part[1:] != 1) | (part[:-1] != 1)
    ends = np.cumsum(sizes)
    cuts = ends[:-1][ends[:-1] < len(code)]
    begin[cuts] = part[cuts] > 0
    at = np.flatnonzero(part > 0)
    starts = np.flatnonzero(begin[at])
    none = np.zeros(0, dtype=np.uint64)
    if not len(at):
        return np.zeros(len(texts) + 1, dtype=np.int64), none.astype(np.int8), none, none, none.astype(bool)
    offsets = np.searchsorted(at[starts], np.concatenate(([0], ends)))
    length = np.diff(np.concatenate((starts, [len(at)])))
    chars, first = code[at], code[at[starts]]
    place = np.arange(len(at)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        exact = mixed(np.add.reduceat(numbers[chars] * (mixed(np.arange(int(length.max()), dtype=np.uint64)) | np.uint64(1))[place], starts))
    han = part[at[starts]] == 2
    kind = np.array([0, 3, 3, 0, 1, 2], dtype=np.int8)[part[at[starts]]]
    capital = np.logical_or.reduceat(uppers[chars], starts)
    mask = np.where(digits[first], _WORDS, np.where(capital, _WORDS ^ np.uint64(1), exact))
    return offsets, kind, mask, exact, han


def _keys(offsets, kind, mask, exact, han):
    """By token the key of its line up to it, of the last three words, and of the word itself."""
    n = len(kind)
    begin = np.zeros(n, dtype=bool)
    begin[offsets[:-1][offsets[:-1] < n]] = True
    begin[1:] |= kind[:-1] == 0
    first = np.flatnonzero(begin)
    start = first[np.cumsum(begin) - 1] if n else np.zeros(0, dtype=np.int64)
    place = np.arange(n) - start
    shape = np.where(kind == 2, _COMMA, np.where(kind == 1, _END, np.where(han, _HAN, mask)))
    word = np.where(kind == 3, mask, np.where(kind == 2, _COMMA, _END))
    with np.errstate(over="ignore"):
        sums = np.cumsum(shape * (mixed(np.arange(int(place.max()) + 1 if n else 0, dtype=np.uint64)) | np.uint64(1))[place]) if n else shape
        before = np.where(start > 0, sums[np.maximum(start - 1, 0)], np.uint64(0)) if n else sums
        so_far = mixed(sums - before + place.astype(np.uint64))
        one = np.where(begin, _EMPTY, np.roll(word, 1)) if n else word
        two = np.where(begin | np.roll(begin, 1), _START, np.roll(word, 2)) if n else word
        last3 = mixed(mixed(mixed(two) ^ one) ^ word) ^ np.uint64(3)
    return so_far.view(np.int64), last3.view(np.int64), mixed(exact ^ np.uint64(5)).view(np.int64)


def _count(wanted: np.ndarray | None):
    """Counts of keys: how often a line ends there (`ends`) and how often words go on in the line (`goes`); key 0 is for all words.
    With `wanted`, sorted, only keys among them are counted; a table of their lowest 22 bits turns most others away at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            quick = np.zeros(1 << 22, dtype=bool)
            quick[wanted.value & ((1 << 22) - 1)] = True

        def chosen(key: np.ndarray) -> np.ndarray:
            if wanted is None:
                return key
            key = key[quick[key & ((1 << 22) - 1)]]
            at = np.minimum(np.searchsorted(wanted.value, key), max(len(wanted.value) - 1, 0))
            return key[wanted.value[at] == key] if len(wanted.value) else key[:0]

        for batch in (piece for whole in batches for piece in slices(whole, 0, 3_000_000)):
            coded = _coded([t.rstrip(_BLANK) if t else "" for t in batch.column(0).to_pylist()])
            offsets, kind, _, _, han = coded
            if not len(kind):
                continue
            so_far, last3, own = _keys(*coded)
            last = np.zeros(len(kind), dtype=bool)
            last[offsets[1:][np.diff(offsets) > 0] - 1] = True
            after = np.where(last, 0, np.roll(kind, -1))
            word = kind == 3
            ends, goes = word & (after == 0), word & (after >= 2)
            closing = np.concatenate((chosen(so_far[ends]), chosen(last3[ends])))
            u, inv = np.unique(np.concatenate((closing, chosen(so_far[goes]), chosen(last3[goes]), chosen(own[word & ~last & ~han]))), return_inverse=True)
            e = np.bincount(inv[: len(closing)], minlength=len(u))
            m = np.bincount(inv[len(closing) :], minlength=len(u))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((u, [0]))), pa.array(np.concatenate((e, [int((last & word).sum())]))), pa.array(np.concatenate((m, [int(word.sum())])))], names=["key", "ends", "goes"]
            )

    return run


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in slices(whole, 1, 3_000_000)):
        coded = _coded(batch.column(1).to_pylist())
        offsets, kind, _, _, han = coded
        so_far, last3, own = _keys(*coded)
        full = np.flatnonzero(np.diff(offsets) > 0)
        b = offsets[1:][full] - 1
        marks = np.concatenate(([0], np.cumsum(kind == 1)))
        inner = marks[b] > marks[offsets[:-1][full]]  # a sentence that ended earlier in the line: no headline, list point or name holds one
        word, lower = kind[b] == 3, (kind[b] == 3) & ~han[b]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(full)), pa.array(so_far[b]), pa.array(last3[b], mask=~word), pa.array(own[b], mask=~lower), pa.array(inner)], names=["row", "line_key", "last_key", "word_key", "inner"]
        )


def judge_endings(documents: DataFrame, factor: float = 5.0, most_keys: int = 4_000_000) -> DataFrame:
    """One row for each document with visible text: `doc_id, source, at_spike, reason`; `reason` is null if the text is whole.

    Reasons: `character` (a broken character at the end), `mark` (a cut mark), `spike` (a length at which the source's texts pile
    up, in characters or bytes, without a sentence end), `open` (it stops at a comma, an opening mark or other open sign), `word`
    (its last word is no word of the corpus), `sentence` (the corpus goes on after such words).

    Ends with a sentence end, links, and lines without letters or in brackets are whole. Other ends, of texts without any sentence
    end too, are compared with all lines of all documents: a line of that shape, or the last three words (names and numbers masked), must end lines at least `factor`
    times as often as cuts at random would make it. Every text counts in full, lines of any length. What the doubtful ends ask for travels to all tasks
    while it is at most `most_keys` numbers (32 MB), so that nothing else is shuffled; beyond that all counts are, and joined.
    Null, empty and blank texts: no row. Documents that share an id are judged as rows of their own.
    """
    docs = documents.where(F.col("text").rlike(r"[^\s\x{A0}\x{3000}\x{200B}\x{FEFF}]"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    lengths = docs.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("n")))).alias("x"))
    spikes = length_spikes(lengths.select("source", "x.unit", "x.n"))
    spikes = settle(spikes.groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("spike"))).alias("chars"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("spike"))).alias("bytes")))
    line = F.regexp_replace(_last_line(F.col("text")), r"^[\s\x{A0}\x{3000}]+", "")
    tail = F.when(F.col("line").rlike("\\x{FFFD}$"), "character").when(F.col("line").rlike(_CUT_MARK), "mark")
    whole = (
        F.col("line").rlike(_SENTENCE_END)
        | ~F.col("line").rlike(r"\p{L}")
        | F.col("line").rlike(r"^[\[(].*[\])]$")
        | F.col("line").rlike(r"^(?:https?://|www\.)[^\s/]+\.[^\s/.]{2,}(?:/\S*)?$")
    )
    open_ = F.col("line").rlike(rf"[^\p{{L}}\p{{M}}\p{{N}}.!?。！？%°€$№\"'”’»)\]』」›*_]$")
    base = docs.select("row", "doc_id", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), line.alias("line"))
    base = base.withColumn("reason", tail).withColumn("done", F.col("reason").isNull() & whole)
    base = base.withColumn("reason", F.coalesce("reason", F.when(~F.col("done") & open_, "open")))
    base = settle(base.withColumn("line", F.when(F.col("reason").isNull() & ~F.col("done"), F.col("line"))))
    ends = settle(base.where(F.col("line").isNotNull()).select("row", "line").mapInArrow(_endings, "row bigint, line_key bigint, last_key bigint, word_key bigint, inner boolean"))
    asked = ends.select("row", "inner", F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.col(k).alias("key")) for k in ("line_key", "last_key", "word_key")])).alias("x"))
    asked = asked.select("row", "inner", "x.of", "x.key")
    keys = settle(asked.select("key").where(F.col("key").isNotNull()).distinct())
    wanted = None
    if keys.limit(most_keys + 1).count() <= most_keys:
        wanted = documents.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()))
    counts = documents.where(F.col("text") != "").select("text").mapInArrow(_count(wanted), "key bigint, ends bigint, goes bigint").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    totals = settle(counts if wanted is not None else counts.join(keys.unionByName(keys.sparkSession.range(1).select(F.col("id").alias("key"))), "key", "left_semi"))
    rate = totals.where(F.col("key") == 0).select((F.col("ends") / F.col("goes")).alias("rate"))
    asked = asked.join(totals, "key", "left")
    of = lambda k, c: F.coalesce(F.max(F.when(F.col("of") == k, F.col(c))), F.lit(0))
    seen = asked.groupBy("row").agg(F.first("inner").alias("inner"), *[of(k, c).alias(f"{k[:4]}_{c}") for k in ("line_key", "last_key") for c in ("ends", "goes")], F.max(F.when((F.col("of") == "word_key") & F.col("key").isNotNull(), F.coalesce("goes", F.lit(0)))).alias("word_seen"))
    h = rate.first()
    h = h["rate"] if h and h["rate"] is not None else 0.0
    known = lambda k: (F.col(f"{k}_ends") >= 2) & (F.col(f"{k}_ends") >= F.lit(factor * h) * (F.col(f"{k}_ends") + F.col(f"{k}_goes")))
    verdict = F.when(F.col("inner"), "sentence").when((F.col("word_seen") < 2) & ~known("line"), "word").when(~(known("line") | known("last")), "sentence")
    judged = base.join(seen.select("row", verdict.alias("verdict")), "row", "left").join(spikes, "source", "left")
    at_spike = F.coalesce(F.array_contains("chars", F.col("n_chars")), F.lit(False)) | F.coalesce(F.exists("bytes", lambda b: F.col("n_bytes").between(b - 3, b)), F.lit(False))
    judged = judged.withColumn("at_spike", at_spike)
    reason = F.coalesce(F.col("reason"), F.when(~F.col("done") & F.col("at_spike"), "spike"), F.col("verdict"))
    return judged.select("doc_id", "source", "at_spike", reason.alias("reason"))


def truncated_share(judged: DataFrame) -> DataFrame:
    """`source, n_documents, n_truncated, share, n_at_spike` of each source, from `judge_endings`."""
    cut = F.sum(F.col("reason").isNotNull().cast("int"))
    spike = F.sum((F.col("reason").isNotNull() & F.col("at_spike")).cast("int"))
    return judged.groupBy("source").agg(F.count("*").alias("n_documents"), cut.alias("n_truncated"), F.round(cut / F.count("*"), 6).alias("share"), spike.alias("n_at_spike"))
