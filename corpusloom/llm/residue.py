"""Error messages, script demands, filler and unfilled templates in place of an article: positive-unlabelled naive Bayes over passages."""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import source_of
from corpusloom.llm.codes import line_hashes, mixed, slices, word_hashes
from corpusloom.llm.lines import NO_SOURCE
from corpusloom.plans.shared import maybe_broadcast, settle

#: Open slots whose syntax leaves no doubt, and those that might be an editor's brackets.
_SURE = r"\{\{[^{}]{1,60}\}\}|\$\{[^{}]{1,60}\}|<\?=?[^<>]{1,60}\?>|<%=?[^<>]{1,60}%>|(?<![\w%])%[\p{L}][\p{L}_. ]{1,30}%(?!\w)|(?<![{$])\{[\p{L}][\w. ]{0,40}\}|\[object Object\]|\[INSERT [^\[\]]{1,40}\]|(?<!\w)(?:undefined|NaN|null(?! and void))(?!\w)|#[\p{L}][\p{L}_. ]{1,40}#|@@[\p{L}][\w. ]{0,40}@@|<<[\p{L}][\w. ]{0,40}>>|\{%[^{}%]{1,60}%\}|&lt;[%?]=?[^&<>]{1,60}[%?]&gt;|(?<!\w)X{2}\.X{2}\.X{4}(?!\w)|_{4,}"
_DOUBT = r"\[[\p{L}][\w. ]{1,40}\]|(?<!\w)(?:None|YYYY|TBD|TBA|XX+)(?!\w)"
SURE, SLOT = regex.compile(_SURE), regex.compile(f"{_SURE}|{_DOUBT}")
#: Whether a text can hold slots at all, in Java's and in Python's notation.
_HINT = r"[{}<%#@\[&]|undefined|NaN|null|None|YYYY|XX|TB[AD]|____"
_MARK = re.compile(_HINT)
#: Filler that is known as such.
FILLER = re.compile(r"dolor sit amet|\blorem\b|\basdf\b|\bqwerty\b|(?<!\w)x{4,}(?!\w)", re.I)
_WORD = regex.compile(r"\p{Han}|[\p{L}\p{N}--\p{Han}]+", regex.V1)
_END = regex.compile(r"[.!?。！？…:：][\"'”’»)\]」』]*$")


def features(line: str) -> list[str]:
    """Words of a passage, Han characters in twos; digits count as one word, and a slot as the words in it."""
    slots = SLOT.findall(line)
    out = ["<slot>"] * len(slots) + [f"<slot {w}>" for s in slots for w in _WORD.findall(s.lower())]
    rest = SLOT.sub(" ", line) if slots else line
    words = ["0" if w[0].isdigit() else w for w in _WORD.findall(rest.lower())]
    return out + [w if len(w) > 1 or w < "⺀" else w + n for w, n in zip(words, [*words[1:], ""])]


@dataclass
class Model:
    """Log odds of each feature, for a passage that is residue against one that isn't. Words of one passage hang together, so
    more than `most` of them count as `most`."""

    odds: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    most: int = 8

    def slot(self, text: str) -> float:
        """Mean log odds of the words in a slot."""
        words = _WORD.findall(text.lower())
        return sum(self.odds.get(f"<slot {w}>", 0.0) for w in words) / len(words) if words else 0.0

    def score(self, line: str) -> float:
        seen = set(features(line))
        return self.prior + sum(self.odds.get(w, 0.0) for w in seen) * min(1.0, self.most / len(seen)) if seen else self.prior


def fit(trusted: list[str], unlabelled: list[str], rounds: int = 4, share: float = 0.02) -> Model:
    """Positive-unlabelled naive Bayes by expectation-maximisation: trusted passages stay positive, the others start at `share`
    and get their posterior in each round. Repeated passages count once, so that furniture doesn't outweigh."""
    trusted, own = list(dict.fromkeys(trusted)), set(trusted)
    unlabelled = [x for x in dict.fromkeys(unlabelled) if x not in own]
    if not trusted or not unlabelled:
        return Model()
    rows = [set(features(x)) for x in trusted + unlabelled]
    vocab = {w: i for i, w in enumerate(sorted(set().union(*rows)))}
    at = np.array([i for i, r in enumerate(rows) for w in r if w in vocab], dtype=np.int64)
    what = np.array([vocab[w] for r in rows for w in r if w in vocab], dtype=np.int64)
    size = np.bincount(at, minlength=len(rows))
    weight = np.minimum(1.0, Model.most / np.maximum(size, 1))
    prior = float(np.log(share / (1 - share)))
    p = np.full(len(rows), share)
    p[: len(trusted)] = 1.0
    for _ in range(rounds):
        yes = np.bincount(what, weights=p[at], minlength=len(vocab)) + 0.1
        no = np.bincount(what, weights=1 - p[at], minlength=len(vocab)) + 0.1
        odds = np.log(yes / (p.sum() + 0.2)) - np.log(no / ((1 - p).sum() + 0.2))
        odds = np.clip(odds, -6, 6)
        s = prior + weight * np.bincount(at, weights=odds[what], minlength=len(rows))
        p = 1 / (1 + np.exp(-s))
        p[: len(trusted)] = 1.0
    return Model({w: float(odds[i]) for w, i in vocab.items()}, prior)


def furniture_lines(articles: DataFrame, least: int = 5, percent: int = 3) -> DataFrame:
    """`source, line_hash, n_articles, of_articles`, settled: the lines that `least` different texts of a source and `percent` % of them
    have in common. Texts that hold the same lines count once, as the lines of an article that is stored often are no furniture.
    Lines agree if their letters do; each text sends a line once, and counts combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                h, bounds = line_hashes(batch.column(1).to_pylist())
                row = np.repeat(np.arange(len(batch)), np.diff(bounds))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                keep = (h > 0) & np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                h, row = h[keep], row[keep]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["source", "hashes"])

    base = articles.where(F.col("text") != "").select(F.coalesce(source_of("src_file"), F.lit(NO_SOURCE)).alias("source"), "text")
    texts = settle(base.mapInArrow(run, "source string, hashes array<bigint>").distinct())
    total = texts.groupBy("source").agg(F.count("*").alias("of_articles"))
    counts = texts.select("source", F.explode("hashes").alias("line_hash")).groupBy("source", "line_hash").agg(F.count("*").alias("n_articles"))
    joined = counts.where(F.col("n_articles") >= least).join(total, "source")
    return settle(joined.where(F.col("n_articles") * 100 >= F.col("of_articles") * percent).select("source", "line_hash", "n_articles", "of_articles"))


class _Marker:
    """Tells furniture lines from others. The pairs of source and line travel as one sorted array of 64-bit numbers while there are at most
    `most` (32 MB); beyond that each text brings the lines of its source along, by a join that deals every source to `salt` tasks."""

    def __init__(self, furniture: DataFrame, most: int = 4_000_000, salt: int = 32):
        self.found = furniture.select("source", "line_hash")
        self.salt, self.known = salt, None
        if furniture.limit(most + 1).count() <= most:
            keys = self.found.select(F.xxhash64("source").bitwiseXOR(F.col("line_hash")).alias("k")).toArrow().column("k").to_numpy().view(np.uint64)
            self.known = furniture.sparkSession.sparkContext.broadcast(np.unique(keys))

    def ready(self, articles: DataFrame) -> DataFrame:
        """`article_id, source, text, failed, drop` of articles with text that are no directory pages."""
        failed = (F.coalesce(F.col("http_status"), F.lit(0)) >= 400) | F.coalesce(F.lower("via").rlike("fail|none"), F.lit(False))
        base = articles.where((F.col("text") != "") & ~F.coalesce(F.col("is_directory"), F.lit(False))).select(
            "article_id", F.coalesce(source_of("src_file"), F.lit(NO_SOURCE)).alias("source"), "text", failed.alias("failed")
        )
        if self.known is not None:
            return base.withColumn("drop", F.lit(None).cast("array<bigint>"))
        lists = self.found.groupBy("source").agg(F.collect_list(F.xxhash64("source").bitwiseXOR(F.col("line_hash"))).alias("drop")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.salt - 1))))
        return base.withColumn("part", F.pmod(F.xxhash64("article_id"), F.lit(self.salt)).cast("int")).join(lists, ["source", "part"], "left").select("article_id", "source", "text", "failed", "drop")


def _marked(batch: pa.RecordBatch, known: np.ndarray | None) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Lines by text, the furniture mark of each line, and where each text's lines begin; columns 1, 2 and 4 are source, text, drop."""
    texts = batch.column(2).to_pylist()
    h, bounds = line_hashes(texts)
    codes = batch.column(1).dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(s, seed=42) for s in codes.dictionary.to_pylist()] or [0], dtype=np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    key = own[codes.indices.to_numpy(zero_copy_only=False)][row] ^ h
    if known is not None:
        at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        hit = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
    else:
        hit = np.zeros(len(key), dtype=bool)
        for i, drop in enumerate(batch.column(4).to_pylist()):
            if drop:
                hit[bounds[i] : bounds[i + 1]] = np.isin(key[bounds[i] : bounds[i + 1]], np.array(drop, dtype=np.int64).view(np.uint64))
    return [t.split("\n") for t in texts], hit & (h > 0), bounds


def train(articles: DataFrame, marker: _Marker, most_records: int = 20_000, short: int = 60, line: int = 30, most_lines: int = 200, longest: int = 5_000) -> Model:
    """Fits the model on about `most_records` records, taken by a hash of their id; of a record, on `most_lines` of its lines at even distances
    and on lines of at most `longest` characters, so that what reaches the driver is bounded in bytes too.

    Trusted are records of at most `short` words whose fetch failed or that hold known filler; records of at most `line` words
    whose own text, digits apart, stands in two sources or three records, as no article's does; and records with three sure slots.
    """
    total = max(1, articles.count())
    chosen = F.xxhash64(F.lit("residue"), "article_id").bitwiseAND(F.lit((1 << 62) - 1)) < int((1 << 62) * min(1.0, most_records / total))
    marks = marker.known
    names = ["source", "own", "n", "kind", "key", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if marks is None else marks.value
        for batch in (piece for whole in batches for piece in slices(whole, 2, 4_000_000)):
            lines, hit, bounds = _marked(batch, known)
            own = [[x for x, f in zip(ls, hit[b : b + len(ls)].tolist()) if not f and x.strip()] for ls, b in zip(lines, bounds.tolist())]
            text = ["\n".join(ls) for ls in own]
            n, key = np.diff(word_hashes(text)[1]), line_hashes([t.replace("\n", " ") for t in text])[0].view(np.int64)
            kind = [FILLER.search(t) is not None or bool(f) for t, f in zip(text, batch.column(3).to_pylist())]
            kept = mixed(np.array([xxhash.xxh64_intdigest(str(i)) for i in batch.column(0).to_pylist()], dtype=np.uint64)) % np.uint64(5) == 0
            at = [i for i, t in enumerate(text) if t and (n[i] <= short or kept[i] or _MARK.search(t))]
            few = [[x for x in own[i][:: 1 + (len(own[i]) - 1) // most_lines] if len(x) <= longest] for i in at]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), pa.array(few, pa.list_(pa.string())), pa.array(n[at]), pa.array([kind[i] for i in at], pa.bool_()), pa.array(key[at]), pa.array(kept[at])], names=names)

    rows = settle(marker.ready(articles.where(chosen)).mapInArrow(run, "source string, own array<string>, n bigint, kind boolean, key bigint, kept boolean"))
    brief = rows.where(F.col("n") <= line).groupBy("key").agg(F.count("*").alias("times"), F.min("source").alias("low"), F.max("source").alias("high"))
    shared = {r["key"] for r in brief.where((F.col("low") != F.col("high")) | (F.col("times") >= 3)).select("key").collect()}
    slotted, failed, other = [], [], []
    for r in rows.select("own", "n", "kind", "key", "kept").collect():
        sure = sum(len(SURE.findall(x)) for x in r["own"])
        if sure >= 3 and sure * 60 >= r["n"]:
            slotted.append(r["own"])
        elif r["n"] <= short and r["kind"] or r["n"] <= line and r["key"] in shared:
            failed.append(r["own"])
        elif r["kept"] and r["n"] > short and not sure:
            other.append(r["own"])
    trusted = [x for r in slotted for x in r if SURE.search(x)] + [x for r in failed for x in r]
    return fit(trusted, [x for r in other for x in r])


def main_bodies(articles: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """The articles that have a main body: text that is neither null nor empty, no directory page, no residue. All columns stay."""
    bad = maybe_broadcast(settle(judge_records(articles, furniture).where("is_residue").select("article_id")))
    return articles.where((F.col("text") != "") & ~F.coalesce(F.col("is_directory"), F.lit(False))).join(bad, "article_id", "left_anti")


def judge_records(articles: DataFrame, furniture: DataFrame | None = None, margin: float = 2.0) -> DataFrame:
    """`article_id, reason, is_residue` for each article with text that is no directory page; `reason` is `slots`, `no story` or null.

    Lines that a source repeats (`furniture_lines`) are set apart. A story passage is a line of at least five words that ends as a
    sentence, has no open slots, and that the model doesn't take for residue. A record is residue if it has no story passage, if more of
    its passages have open slots than are story, or if a quarter has, with two different slots. Reading stops at the first story passage where the text has no slots at all, as
    the verdict can't change. Where all lines of a text are set apart, as in near copies that a source repeats, these
    are judged: the record is no residue if more of them are story than residue. Null and empty texts, directory pages: no row. Every article is judged on its whole text.
    """
    marker = _Marker(furniture_lines(articles) if furniture is None else furniture)
    marks = marker.known
    shared = articles.sparkSession.sparkContext.broadcast(train(articles, marker))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, all_marks = shared.value, None if marks is None else marks.value
        known: dict[str, tuple[int, int]] = {}

        def judge(line: str, found: set[str]) -> tuple[int, int]:
            """Whether it is a story passage, and a slotted one."""
            end = _END.search(line) is not None
            slots = SLOT.findall(line) if _MARK.search(line) else []
            if not slots and not end:
                return 0, 0
            n = len(_WORD.findall(line))
            if slots:
                own = {x for x in slots if SURE.fullmatch(x) or m.slot(x) > 1.5}
                if own and (n >= 5 or m.score(line) > margin):
                    found.update(own)
                    return 0, 1
                return int(end and n >= 5), 0
            return int(n >= 5 and m.score(line) <= margin), 0

        for batch in (piece for whole in batches for piece in slices(whole, 2, 4_000_000)):
            reasons = []
            texts, hit, bounds = _marked(batch, all_marks)
            for lines_, b in zip(texts, bounds.tolist()):
                drop = hit[b : b + len(lines_)].tolist()
                lines = [x for x, f in zip(lines_, drop) if not f and x.strip()]
                story = slotted = 0
                found: set[str] = set()
                marked = any(map(_MARK.search, lines))
                for line in lines:
                    s = known.get(line)
                    if s is None:
                        s = judge(line, found)
                        if not s[1] and len(known) < 200_000 and len(line) < 200:
                            known[line] = s
                    story += s[0]
                    slotted += s[1]
                    if story and not marked:
                        break
                if not lines:
                    rest = [x for x in lines_ if x.strip()]
                    told = sum(judge(x, set())[0] for x in rest)
                    story = int(told > sum(m.score(x) > margin for x in rest))
                reasons.append("slots" if slotted > story or len(found) >= 2 and slotted * 4 >= story + slotted else None if story else "no story")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string()), pa.array([r is not None for r in reasons])], names=["article_id", "reason", "is_residue"])

    return marker.ready(articles).mapInArrow(run, "article_id bigint, reason string, is_residue boolean")
