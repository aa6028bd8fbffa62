"""Test items that leak into documents: BM25 index of the items, block-max WAND per passage, exact check of word runs."""

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words

_WORD = regex.compile(r"\p{Han}|[\p{L}\p{N}--\p{Han}]+", regex.V1)


class ItemIndex:
    """BM25 inverted index over the fields (passages and questions) of the test items, with block maxima.

    A field's threshold is the least score any `run` consecutive words of it can have, so a passage that holds such a run
    always reaches it: retrieval loses nothing. `k1` and `b` are BM25's; `block` is the number of postings under one maximum.
    """

    def __init__(self, items: list[tuple], run: int = 13, k1: float = 1.2, b: float = 0.75, block: int = 16):
        self.run, self.block = run, block
        self.fields: list[tuple[int, str, np.ndarray]] = []
        self.terms: dict[str, int] = {}
        self.answers = {i: _WORD.findall((a or "").lower()) for i, _, _, a in items}
        for item, passage, question, _ in items:
            for kind, text in (("passage", passage), ("question", question)):
                w = _WORD.findall((text or "").lower())
                if len(w) >= run:
                    self.fields.append((item, kind, np.array([self.terms.setdefault(x, len(self.terms)) for x in w], dtype=np.int64)))
        n = len(self.fields)
        mean = sum(len(f[2]) for f in self.fields) / max(1, n)
        post: dict[int, list[tuple[int, float]]] = defaultdict(list)
        df = np.zeros(len(self.terms))
        for _, _, t in self.fields:
            df[np.unique(t)] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.threshold = np.zeros(n)
        for f, (_, _, t) in enumerate(self.fields):
            u, tf = np.unique(t, return_counts=True)
            score = dict(zip(u.tolist(), (idf[u] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))).tolist()))
            for term, s in score.items():
                post[term].append((f, s))
            self.threshold[f] = min(sum(score[x] for x in set(t[i : i + run].tolist())) for i in range(len(t) - run + 1)) * (1 - 1e-9)
        self.least = float(self.threshold.min()) if n else math.inf
        self.post = {t: ([f for f, _ in p], [s for _, s in p]) for t, p in post.items()}
        self.most = {t: max(s) for t, (_, s) in self.post.items()}
        self.maxima = {t: [max(s[i : i + block]) for i in range(0, len(s), block)] for t, (_, s) in self.post.items()}
        self.runs: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for f, (_, _, t) in enumerate(self.fields):
            for i in range(len(t) - run + 1):
                if f not in self.runs[k := tuple(t[i : i + run].tolist())]:
                    self.runs[k].append(f)

    def retrieve(self, query: list[int]) -> list[int]:
        """Fields whose BM25 score for the query's words reaches their threshold (block-max WAND)."""
        cursors = [[0, t] for t in dict.fromkeys(query)]
        out = []
        while cursors:
            cursors.sort(key=lambda c: self.post[c[1]][0][c[0]])
            bound, pivot = 0.0, -1
            for i, (at, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= self.least:
                    pivot = i
                    break
            if pivot < 0:
                break
            field = self.post[cursors[pivot][1]][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and self.post[cursors[pivot + 1][1]][0][cursors[pivot + 1][0]] == field:
                pivot += 1
            block_bound, beyond = 0.0, len(self.fields)
            if pivot + 1 < len(cursors):
                beyond = self.post[cursors[pivot + 1][1]][0][cursors[pivot + 1][0]]
            for at, t in cursors[: pivot + 1]:
                ids, maxima = self.post[t][0], self.maxima[t]
                k = at // self.block
                while k < len(maxima) - 1 and ids[min(len(ids), (k + 1) * self.block) - 1] < field:
                    k += 1
                block_bound += maxima[k]
                beyond = min(beyond, ids[min(len(ids), (k + 1) * self.block) - 1] + 1)
            if block_bound >= self.threshold[field]:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    ids, scores = self.post[c[1]]
                    while c[0] < len(ids) and ids[c[0]] < field:
                        c[0] += 1
                    if c[0] < len(ids) and ids[c[0]] == field:
                        score += scores[c[0]]
                        c[0] += 1
                if score >= self.threshold[field]:
                    out.append(field)
            else:  # the bound holds up to the end of the first block: no field before it can reach its threshold, if none has a lower one
                to = beyond if beyond > field + 1 and block_bound < self.threshold[field:beyond].min() else field + 1
                for c in cursors[: pivot + 1]:
                    c[0] = bisect_left(self.post[c[1]][0], to, c[0])
            cursors = [c for c in cursors if c[0] < len(self.post[c[1]][0])]
        return out

    def leaks(self, passage: list[int]) -> dict[int, int]:
        """Retrieved fields that share a run of words with the passage, and how many such runs they share."""
        fields = set(self.retrieve(passage))
        found: dict[int, int] = defaultdict(int)
        if fields:
            for i in range(len(passage) - self.run + 1):
                for f in self.runs.get(tuple(passage[i : i + self.run]), ()):
                    if f in fields:
                        found[f] += 1
        return found


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 13, most_items: int = 200_000, most_bytes: int = 200_000_000) -> DataFrame:
    """`doc_id, item_id, in_passage, in_question, answer_near`: documents with at least `run` consecutive words of an item's passage or question.

    Query passages are the document's unbroken stretches of words that occur in some item, if they have `run` words at least:
    a shared run can't lie elsewhere. Each is answered by the BM25 index, then checked word by word. `in_passage` and
    `in_question` count the shared runs; `answer_near` says whether the answer's words stand in the document one after the other.

    The items travel to every task: their number is fixed by the test suites. More than `most_items`, or than `most_bytes` of text, are dealt by
    hash into as many parts as it takes, each searched in a pass over the documents of its own. Null and empty texts, items without `run` words: no row. Items that share a
    text are all reported. Documents that share an id keep their own rows. No shuffle.
    """
    chosen = items.select("item_id", "passage", "question", "answer")
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("passage", "question", "answer")), F.lit(0))
    total = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-total["n"] // most_items), -(-total["bytes"] // most_bytes))
    part = F.pmod(F.xxhash64("item_id", "passage", "question", "answer"), F.lit(parts))
    found = [_search(documents, [tuple(r) for r in chosen.where(part == k).collect()], run) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _search(documents: DataFrame, rows: list[tuple], run: int) -> DataFrame:
    """As `leaked_items`, for items that fit into every task."""
    shared = documents.sparkSession.sparkContext.broadcast(rows)
    made: dict = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = made.get(0) or made.setdefault(0, ItemIndex(shared.value, run))
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            own = coded.dictionary.to_pylist()
            term = np.fromiter((index.terms.get(w, -1) for w in own), dtype=np.int64, count=len(own))
            codes = coded.indices.to_numpy(zero_copy_only=False)
            words_ = term[codes] if len(own) else np.zeros(0, dtype=np.int64)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            doc_of = np.repeat(np.arange(len(lists)), np.diff(offsets))
            known = words_ >= 0
            cut = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (doc_of[1:] != doc_of[:-1])))) if len(words_) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.concatenate((cut, [len(words_)])))
            hits: dict[tuple[int, int], list[int]] = {}
            for start, n in zip(cut[known[cut] & (size >= run)].tolist() if len(cut) else [], size[known[cut] & (size >= run)].tolist() if len(cut) else []):
                for f, k in index.leaks(words_[start : start + n].tolist()).items():
                    item, kind, _ = index.fields[f]
                    hits.setdefault((int(doc_of[start]), item), [0, 0])[kind == "question"] += k
            ids = batch.column(0)
            out = sorted(hits)
            near = []
            for d, item in out:
                text = " ".join(own[c] for c in codes[offsets[d] : offsets[d + 1]].tolist())
                answer = " ".join(index.answers[item])
                near.append(bool(answer) and f" {answer} " in f" {text} ")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([d for d, _ in out], pa.int64())), pa.array([i for _, i in out], pa.int64()),
                 pa.array([hits[k][0] for k in out], pa.int64()), pa.array([hits[k][1] for k in out], pa.int64()), pa.array(near, pa.bool_())],
                names=["doc_id", "item_id", "in_passage", "in_question", "answer_near"],
            )

    return documents.select("doc_id", words("text").alias("w")).mapInArrow(
        work, "doc_id bigint, item_id bigint, in_passage bigint, in_question bigint, answer_near boolean"
    )
