"""Languages of documents and of the segments of mixed documents: script ranges, naive-Bayes word scores, Viterbi over words."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import WORD

LANGUAGES = ("en", "fr", "es", "ru", "zh", "id", "sr")
#: Languages a script leaves possible.
SCRIPTS = {"han": ("zh",), "cyrillic": ("ru", "sr"), "latin": ("en", "fr", "es", "id", "sr")}
#: Names and codes that labels use, by language.
NAMES = {
    "en": "en eng english anglais inglés английский 英语 英文 engleski inggris",
    "fr": "fr fra fre french français francais francés французский 法语 法文 francuski prancis",
    "es": "es spa spanish español espanol castellano espagnol испанский 西班牙语 španski spanyol",
    "ru": "ru rus russian русский russe ruso 俄语 俄文 ruski rusia",
    "zh": "zh zho chi cmn chinese 中文 汉语 普通话 chinois chino китайский kineski tionghoa mandarin",
    "id": "id ind in indonesian indonesia bahasa indonésien indonesio индонезийский 印尼语 indonezijski",
    "sr": "sr srp scc serbian srpski српски serbe serbio сербский 塞尔维亚语 serbia",
}
_WORD = regex.compile(r"\p{Han}|[\p{L}\p{N}--\p{Han}]+", regex.V1)
_HAN, _CYRILLIC, _LATIN = (regex.compile(rf"\p{{{s}}}") for s in ("Han", "Cyrillic", "Latin"))


def normal_label(label: Column) -> Column:
    """The language a label names, by code (with or without region or script) or name; null if it names none of the seven."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_][\p{L}\p{N}]+)*$", 1)
    table = F.create_map(*[F.lit(x) for lang, names in NAMES.items() for n in names.split() for x in (n, lang)])
    return F.element_at(table, key)


def latest_labels(labels: DataFrame) -> DataFrame:
    """`article_id, label`: the normalised label with the latest `labelled_at` of each article. Of labels with one time the
    greatest holds; a null time is the earliest. Repeated rows change nothing."""
    last = F.max(F.struct(F.col("labelled_at"), F.coalesce("lang_label", F.lit("")).alias("lang_label")))
    return labels.groupBy("article_id").agg(last.alias("last")).select("article_id", normal_label(F.col("last.lang_label")).alias("label"))


def _script(word: str) -> tuple[str, ...]:
    if _HAN.search(word):
        return SCRIPTS["han"]
    if _CYRILLIC.search(word):
        return SCRIPTS["cyrillic"]
    return SCRIPTS["latin"] if _LATIN.search(word) else LANGUAGES


@dataclass
class WordModel:
    """`scores`: log probability of a word in each language, against the mean of the languages its script allows."""

    scores: dict[str, np.ndarray]
    out: float = -6.0

    def rows(self, words: list[str]) -> np.ndarray:
        """A row of seven scores for each word. Unknown words only tell what their script rules out."""
        s = np.zeros((len(words), len(LANGUAGES)))
        for i, w in enumerate(words):
            known = self.scores.get(w)
            if known is not None:
                s[i] = known
            elif not w[0].isdigit():
                s[i] = [0.0 if lang in _script(w) else self.out for lang in LANGUAGES]
        return s


def fit(lines: list[tuple[str, str | None]], rounds: int = 6, trust: float = 0.6, clip: float = 4.0) -> WordModel:
    """Naive Bayes over words from lines with noisy labels, by expectation-maximisation.

    A line starts at its label with probability `trust` and spreads the rest over the languages its script allows; in each round
    it gets the model's posterior (with the shares of the languages as prior), so foreign lines in a document move to their own language.
    """
    same: dict[tuple[str, ...], list[str | None]] = {}
    for t, lang in lines:
        w = tuple(dict.fromkeys(w for w in _WORD.findall(t.lower()) if not w[0].isdigit()))
        if len(w) >= 3:
            same.setdefault(w, []).append(lang)
    rows = list(same.items())  # a line that repeats counts once, with the mean of its labels
    if not rows:
        return WordModel({})
    count: dict[str, int] = {}
    for w, _ in rows:
        for x in w:
            count[x] = count.get(x, 0) + 1
    kept = [w for w in sorted(count) if count[w] >= 2]
    vocab = {w: i for i, w in enumerate(kept)}
    k = len(LANGUAGES)
    allow_word = np.array([[lang in _script(w) for lang in LANGUAGES] for w in kept], dtype=bool).reshape(-1, k)
    at = np.array([i for i, (w, _) in enumerate(rows) for x in w if x in vocab], dtype=np.int64)
    what = np.array([vocab[x] for w, _ in rows for x in w if x in vocab], dtype=np.int64)
    votes = np.zeros((len(rows), k))
    np.add.at(votes, at, allow_word[what])
    allowed = votes >= votes.max(axis=1, keepdims=True) * 0.999
    p = allowed / allowed.sum(axis=1, keepdims=True)
    for i, (_, named) in enumerate(rows):
        p[i] *= 1 - trust
        for lang in named:
            if lang is not None and allowed[i, LANGUAGES.index(lang)]:
                p[i, LANGUAGES.index(lang)] += trust / len(named)
        p[i] /= p[i].sum()
    logs = np.zeros((len(kept), k))
    for _ in range(rounds):
        mass = np.zeros((len(kept), k))
        np.add.at(mass, what, p[at])
        logs = np.log((mass + 0.05) / (mass.sum(axis=0) + 0.05 * len(kept)))
        s = np.zeros((len(rows), k))
        np.add.at(s, at, logs[what])
        s = np.where(allowed, s + np.log(p.mean(axis=0) + 1e-9), -1e9)
        p = np.exp(np.clip((s - s.max(axis=1, keepdims=True)) * 0.7, -60, 0))
        p /= p.sum(axis=1, keepdims=True)
    mean = np.where(allow_word, logs, 0).sum(axis=1, keepdims=True) / np.maximum(1, allow_word.sum(axis=1, keepdims=True))
    scores = np.where(allow_word, np.clip(logs - mean, -clip, clip), WordModel.out)
    return WordModel({w: scores[i] for w, i in vocab.items()})


def train(articles: DataFrame, labels: DataFrame, most_lines: int = 30_000) -> WordModel:
    """Fits the word model on about `most_lines` lines, taken by a hash of article and place from about `most_lines` / 4 articles, labelled or not."""
    share = min(1.0, 3.0 * most_lines / 12 / max(1, articles.count()))
    chosen = articles.where((F.col("text") != "") & (F.xxhash64(F.lit("language"), "article_id").bitwiseAND(F.lit((1 << 62) - 1)) < int(share * (1 << 62))))
    rows = chosen.select("article_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.length("line") >= 12)
    rows = rows.join(latest_labels(labels), "article_id", "left").orderBy(F.xxhash64("article_id", "at")).limit(most_lines)
    return fit([(r["line"], r["label"]) for r in rows.select("line", "label").collect()])


def viterbi(scores: np.ndarray, codes: np.ndarray, sizes: np.ndarray, new_line: np.ndarray, in_line: float, at_line: float) -> np.ndarray:
    """The best language of each word of many documents at once: `scores` by different word, `codes` and `new_line` by word,
    `sizes` by document. Changing the language costs `in_line`, or `at_line` at the first word of a line."""
    n, k = len(codes), scores.shape[1]
    path = np.zeros(n, dtype=np.int8)
    if not n:
        return path
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    size, start = sizes[order], start[order]
    back = np.empty((n, k), dtype=np.int8)
    own = np.arange(k, dtype=np.int8)[None, :]
    v = np.zeros((len(sizes), k))
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = start[:live] + t
        now = v[:live]
        best = now.argmax(axis=1)
        other = now[np.arange(live), best] - np.where(new_line[at], at_line, in_line)
        change = other[:, None] > now
        back[at] = np.where(change, best[:, None].astype(np.int8), own)
        v[:live] = np.where(change, other[:, None], now) + scores[codes[at]]
    state = v.argmax(axis=1).astype(np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = start[:live] + t
        path[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return path


def label_lines(articles: DataFrame, model: WordModel, in_line: float = 8.0, at_line: float = 3.0, spans: bool = False) -> DataFrame:
    """One row for each line with words: `article_id, line_no, lang, confidence, n_words, weight, main`.

    Line 0 is the title, judged by its own words; lines of the text count from 1 and get the language most of their words have
    on the Viterbi path. `confidence` is the posterior of the language for the line's words. `weight` is the line's amount of
    text (letters; a Han character counts 2.5); `main` is the language with the most weight in the text, the same in all rows of an
    article. With `spans` there is one row for each run of words of one language on the path within a line instead (in titles too, each a path
    of its own), and `first_word, last_word` say which words of the line it holds, from 1. Null texts and titles are empty. Articles without words give no row.
    """
    shared = articles.sparkSession.sparkContext.broadcast(model)
    k = len(LANGUAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            own = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            doc = np.repeat(np.arange(len(lists)), np.diff(offsets))
            brk = np.array([w == "\n" for w in own], dtype=bool)[codes] if len(own) else np.zeros(0, dtype=bool)
            cum = np.concatenate(([0], np.cumsum(brk)))
            line = cum[:-1] - cum[offsets[:-1]][doc] if len(doc) else np.zeros(0, dtype=np.int64)
            keep = ~brk
            codes, doc, line = codes[keep], doc[keep], line[keep]
            if not len(codes):
                continue
            table = m.rows(own)
            amount = np.array([2.5 if _HAN.match(w) else float(len(w)) for w in own])
            new = np.concatenate(([True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])))
            text = line > 0
            path = np.zeros(len(codes), dtype=np.int64)
            path[text] = viterbi(table, codes[text], np.bincount(doc[text], minlength=len(lists)), new[text], in_line, at_line)
            cut = new
            if spans:
                path[~text] = viterbi(table, codes[~text], np.bincount(doc[~text], minlength=len(lists)), new[~text], in_line, at_line)
                cut = new | np.concatenate(([True], path[1:] != path[:-1]))
            place = np.arange(len(codes)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            unit = np.cumsum(cut) - 1
            n_units = int(unit[-1]) + 1
            first = np.flatnonzero(cut)
            total = np.zeros((n_units, k))
            for j in range(k):
                total[:, j] = np.bincount(unit, weights=table[codes, j], minlength=n_units)
            votes = np.bincount(unit * k + path, minlength=n_units * k).reshape(n_units, k)
            lang = np.where((line[first] > 0) | spans, votes.argmax(axis=1), total.argmax(axis=1))
            e = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -50, 0))
            conf = e[np.arange(n_units), lang] / e.sum(axis=1)
            weight = np.bincount(unit, weights=amount[codes], minlength=n_units)
            mass = np.bincount(doc[text] * k + path[text], weights=amount[codes[text]], minlength=len(lists) * k).reshape(-1, k)
            main = np.where(mass.max(axis=1) > 0, mass.argmax(axis=1), -1)
            names = np.array([*LANGUAGES, None], dtype=object)
            size = np.bincount(unit, minlength=n_units)
            where = [pa.array((place[first] + 1).astype(np.int32)), pa.array((place[first] + size).astype(np.int32))] if spans else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc[first])), pa.array(line[first].astype(np.int32)), pa.array(names[lang], pa.string()), pa.array(np.round(conf, 6)),
                    pa.array(size.astype(np.int32)), pa.array(weight), pa.array(names[main[doc[first]]], pa.string()), *where,
                ],
                names=["article_id", "line_no", "lang", "confidence", "n_words", "weight", "main", *(["first_word", "last_word"] if spans else [])],
            )

    title = F.translate(F.coalesce("title", F.lit("")), "\n\r", "  ")
    tokens = F.regexp_extract_all(F.lower(F.concat(title, F.lit("\n"), F.coalesce("text", F.lit("")))), F.lit(rf"{WORD}|\n"), F.lit(0))
    return articles.select("article_id", tokens.alias("w")).mapInArrow(run, "article_id bigint, line_no int, lang string, confidence double, n_words int, weight double, main string" + (", first_word int, last_word int" if spans else ""))


def article_languages(lines: DataFrame) -> DataFrame:
    """`article_id, lang, confidence` from `label_lines`: the main language; its confidence is the share of the text in it, each line
    counted by its own confidence. Articles whose text has no words: no row."""
    own = F.sum(F.when(F.col("lang") == F.col("main"), F.col("weight") * F.col("confidence")).otherwise(0.0))
    text = lines.where((F.col("line_no") > 0) & F.col("main").isNotNull())
    return text.groupBy("article_id").agg(F.first("main").alias("lang"), F.round(own / F.sum("weight"), 6).alias("confidence"))


def segments(lines: DataFrame) -> DataFrame:
    """`article_id, first_line, last_line, lang, confidence, n_words`: runs of lines of one language, the title as a run of its own.
    One article's lines are one window group; a line without words doesn't break a run."""
    by = W.partitionBy("article_id").orderBy("line_no")
    change = ((F.col("lang") != F.lag("lang").over(by)) | (F.lag("line_no").over(by) == 0)).cast("int")
    runs = lines.withColumn("run", F.sum(F.coalesce(change, F.lit(0))).over(by))
    return runs.groupBy("article_id", "run").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.first("lang").alias("lang"),
        F.round(F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight"), 6).alias("confidence"), F.sum("n_words").alias("n_words"),
    ).drop("run")


def word_segments(spans: DataFrame) -> DataFrame:
    """`article_id, first_line, first_word, last_line, last_word, lang, confidence, n_words` from `label_lines` with `spans`: runs of words of
    one language, which begin and end anywhere in a line; no run goes from the title into the text. One article's spans are one window group."""
    by = W.partitionBy("article_id").orderBy("line_no", "first_word")
    change = ((F.col("lang") != F.lag("lang").over(by)) | ((F.lag("line_no").over(by) == 0) & (F.col("line_no") > 0))).cast("int")
    runs = spans.withColumn("run", F.sum(F.coalesce(change, F.lit(0))).over(by))
    found = runs.groupBy("article_id", "run").agg(
        F.min(F.struct("line_no", "first_word")).alias("a"), F.max(F.struct("line_no", "last_word")).alias("b"), F.first("lang").alias("lang"),
        F.round(F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight"), 6).alias("confidence"), F.sum("n_words").alias("n_words"),
    )
    return found.select("article_id", F.col("a.line_no").alias("first_line"), "a.first_word", F.col("b.line_no").alias("last_line"), "b.last_word", "lang", "confidence", "n_words")


def label_faults(lines: DataFrame, labels: DataFrame, least_line: int = 15, least_title: int = 5) -> DataFrame:
    """`article_id, line_no, lang`: line 0 with the main language where the label is missing, names none of the languages or another
    than the main one; each line of at least `least_line` words in another language; line -1 for a title of at least `least_title` words in another."""
    main = article_languages(lines).join(latest_labels(labels), "article_id", "left")
    wrong = main.where(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("article_id", F.lit(0).alias("line_no"), "lang")
    other = F.col("lang") != F.col("main")
    text = lines.where(other & (F.col("line_no") > 0) & (F.col("n_words") >= least_line)).select("article_id", "line_no", "lang")
    title = lines.where(other & (F.col("line_no") == 0) & (F.col("n_words") >= least_title) & (F.col("confidence") >= 0.8)).select("article_id", F.lit(-1).alias("line_no"), "lang")
    return wrong.unionByName(text).unionByName(title)
