"""Main bodies of pages: what a host's pages repeat, found by a suffix array over blocks of its pages, and what goes with it."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import host_of, source_of
from corpusloom.llm.codes import line_hashes, masked_words, mixed, slices
from corpusloom.llm.residue import furniture_lines
from corpusloom.plans.shared import maybe_broadcast, settle

_HAN = "\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_ENDS = frozenset(".!?。！？…")
_DATED = re.compile(r"\s*\(\s*\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\s*\)\s*$")
_NUMBERED = re.compile(r"^\s*\d{1,2}[.)]\s+\S|\(\s*\d{1,2}[./-]\d{1,2}[./-]\d{4}\s*\)\s*$")
#: A comment: a user's name with a number, a colon, then a few words or signs.
_COMMENT = re.compile(r"^\s*@?[\w.-]*[_\d][\w.-]*\s*:\s*\S")
#: Trail of a menu: at least one separator between short parts.
_TRAIL = re.compile(r"\s(?:[>»›→/|·•])\s|[｜|]")
#: Signs that lead to another page.
_ARROW = re.compile(r"^\s*(?:[→▸►»↗➤➔›⇒»#]|>{1,2}\s|\[[+→»]\])\s*\S")
_BULLET = re.compile(r"^\s*[•·▪*–—-]\s")
_HEAD = re.compile(r"^\W*([^:：]{1,40}?)\s*[:：]\s*\S")
_READING = re.compile(r"\d\s*°\s*[CFС]|\b(?:USD|EUR|RUB|CNY|RSD|IDR|GBP|JPY)\b[^\n]*\d|(?:[$€¥₽]\s*\d)")
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _ends(line: str) -> bool:
    """Whether a line ends as a sentence does; quotes and brackets may follow."""
    return line.rstrip().rstrip("\"'”’»)]』」")[-1:] in _ENDS


class SuffixRanks:
    """Suffix array by prefix doubling, kept by level: `levels[k][i]` is the rank of the 2**k tokens from i on, so that the array
    sorted by the last level is the suffix array (to a depth of `longest` tokens), and equal substrings have equal ranks."""

    def __init__(self, tokens: np.ndarray, longest: int):
        self.levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
        n = len(tokens)
        while (1 << len(self.levels)) <= longest:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            right = np.full(n, -1, dtype=np.int64)
            right[: n - half] = last[half:]
            self.levels.append(np.unique((last + 1) * np.int64(n + 2) + right + 1, return_inverse=True)[1].astype(np.int64))


def _limits(pages: int, least: int, percent: float) -> tuple[int, int]:
    """Of how many pages a line must be to count as repeated, and a line of six words or more."""
    return max(least, int(np.ceil(percent / 100 * pages))), max(least, int(np.ceil(percent / 200 * pages)))


def _pages_of(at: np.ndarray, page: np.ndarray, keys: int) -> np.ndarray:
    """On how many different pages each of the keys 0, 1, ... occurs."""
    pairs = np.sort(at.astype(np.int64) * (int(page.max(initial=0)) + 1) + page)
    new = np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)]
    return np.bincount(pairs[new] // (int(page.max(initial=0)) + 1), minlength=keys)


class BlockLines:
    """The lines of a block's pages as numbers that are the same in all blocks: `whole` of a line (0 without words), `part(cut)` without
    its last words, `head` of what comes before a colon, `windows` of the token substrings that touch a long line."""

    def __init__(self, pages: list[list[str]], window: int):
        self.lines, self.window = [x for lines in pages for x in lines], window
        self.word, self.size = masked_words(["\n".join(x) for x in pages])
        self.page = np.repeat(np.arange(len(pages)), [len(x) for x in pages])
        self.first = np.cumsum(self.size) - self.size
        place = np.arange(len(self.word)) - np.repeat(self.first, self.size)
        with np.errstate(over="ignore"):
            weight = mixed(np.arange(int(self.size.max(initial=0)), dtype=np.uint64)) | np.uint64(1)
            self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.word.view(np.uint64) * weight[place])))
        self.whole = self.part(0)
        head = [m[1] if (":" in x or "：" in x) and (m := _HEAD.match(x)) else "" for x in self.lines]
        self.head, self.head_size = numbers_of(head)
        # before each line a 0, after each page a negative number, so that no substring runs over the end of a page
        self.start = np.cumsum(self.size + 1) - self.size + self.page
        self.tok = np.zeros(len(self.word) + len(self.size) + len(pages), dtype=np.int64)
        self.tok[np.repeat(self.start - self.first, self.size) + np.arange(len(self.word))] = self.word
        self.tok[(self.start + self.size)[np.concatenate((self.page[1:] != self.page[:-1], [True]))]] = -1 - np.arange(len(pages))

    def part(self, cut: int) -> np.ndarray:
        n = np.maximum(self.size - cut, 0)
        with np.errstate(over="ignore"):
            return np.where(n > 0, mixed(self.sums[self.first + n] - self.sums[self.first]) | np.uint64(1), np.uint64(0)).view(np.int64)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the substrings begin that end on their page and touch a line of their length, and on which page."""
        stops, n = np.flatnonzero(self.tok < 0), len(self.tok) - self.window
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        long = np.zeros(len(self.tok) + 1, dtype=np.int64)
        at = self.size >= self.window
        np.add.at(long, np.maximum(self.start[at] - self.window + 1, 0), 1)
        np.add.at(long, self.start[at] + self.size[at], -1)
        of_page = np.searchsorted(stops, np.arange(n))
        at = np.flatnonzero((np.cumsum(long)[:n] > 0) & (stops[of_page] >= np.arange(n) + self.window))
        return at, of_page[at]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """A number for each substring of `window` (a power of two) tokens that begins at `at`."""
        with np.errstate(over="ignore"):
            x, half = mixed(self.tok.view(np.uint64)), 1
            while half < self.window:
                x = mixed(x[:-half] * _P[0] + x[half:] * _P[1]) if len(x) > half else x[:0]
                half *= 2
        return x[at].view(np.int64)

    def window_pages(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the substrings that `least` pages hold, and how many do: equal ranks in the suffix array are equal substrings."""
        at, page = self.places()
        if not len(at):
            return at, at
        rank = SuffixRanks(self.tok, self.window).levels[-1][at]
        count = _pages_of(rank, page, int(rank.max()) + 1)
        one = np.zeros(len(count), dtype=np.int64)
        one[rank] = at
        often = np.flatnonzero(count >= least)
        return self.windows(one[often]), count[often]

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Lines that lie to 85 % in the given substrings."""
        at, _ = self.places()
        if not len(at) or not len(windows):
            return np.zeros(len(self.size), dtype=bool)
        edge = np.zeros(len(self.tok) + self.window + 1, dtype=np.int64)
        at = at[np.isin(self.windows(at), windows)]
        edge[at] += 1
        edge[at + self.window] -= 1
        inside = np.concatenate(([0], np.cumsum(np.cumsum(edge)[: len(self.tok)] > 0)))
        return (self.size >= self.window) & (inside[self.start + self.size] - inside[self.start] >= 0.85 * self.size)

    def line_pages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each different line with words, the number of pages it is on, and its size."""
        at = np.flatnonzero(self.size > 0)
        keys, one, of = np.unique(self.whole[at], return_index=True, return_inverse=True)
        return keys, _pages_of(of, self.page[at], len(keys)), self.size[at][one]


def numbers_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text without line breaks as if it were a line of a block, and its words."""
    out, sizes = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    full = [i for i, x in enumerate(texts) if x]
    if not full:
        return out, sizes
    word, size = masked_words([texts[i] for i in full])
    first = np.cumsum(size) - size
    place = np.arange(len(word)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        weight = mixed(np.arange(int(size.max()), dtype=np.uint64)) | np.uint64(1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(word.view(np.uint64) * weight[place])))
        out[full] = np.where(size > 0, mixed(sums[first + size] - sums[first]) | np.uint64(1), np.uint64(0)).view(np.int64)
    sizes[full] = size
    return out, sizes


def neighbours(whole: np.ndarray, page: np.ndarray, open_: np.ndarray, at: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line of `at` the nearest open one of the three before it on its page, and of the three after it; else `alone` of the page."""
    sides = []
    for step in (-1, 1):
        out, free = alone[page[at]], np.ones(len(at), dtype=bool)
        for k in (1, 2, 3):
            to = np.clip(at + step * k, 0, len(whole) - 1)
            ok = free & (to == at + step * k) & (page[to] == page[at]) & open_[to]
            out = np.where(ok, whole[to], out)
            free &= ~ok
        sides.append(out)
    return sides[0], sides[1]


def trail_parts(line: str) -> list[str]:
    """The parts of a menu trail of four or more."""
    parts = _TRAIL.split(line)
    return parts if len(parts) >= 4 else []


@dataclass
class Known:
    """What all pages of a host repeat: on how many of its `pages` lines and heads are, repeated and moving lines, substrings, parts of menus."""

    pages: int
    repeated: np.ndarray
    lines: dict[int, int]
    moving: np.ndarray
    windows: np.ndarray
    heads: dict[int, int]
    menu: np.ndarray


def known_of_block(b: BlockLines, pages: int, least: int, percent: float) -> Known:
    """For a host of one block."""
    most, half = _limits(pages, least, percent)
    keys, count, size = b.line_pages()
    repeated = keys[count >= np.where(size >= 6, half, most)]
    flag = np.isin(b.whole, repeated)
    at = np.flatnonzero(np.isin(b.whole, keys[(size >= 6) & (count >= least) & (count < half)]))
    before, after = neighbours(b.whole, b.page, (b.size > 0) & ~flag, at, -1 - np.arange(pages))
    of, key = np.unique(b.whole[at], return_inverse=True)[::-1]
    sides = [np.bincount(np.unique(np.stack((of, x)), axis=1)[0], minlength=len(key)) if len(at) else np.zeros(0) for x in (before, after)]
    headed = np.flatnonzero((b.head != 0) & ~flag)
    heads, of = np.unique(b.head[headed], return_inverse=True)
    menu = [x for n in np.flatnonzero(flag & (b.size <= 40)).tolist() for x in trail_parts(b.lines[n])]
    return Known(
        pages, repeated, dict(zip(keys.tolist(), count.tolist())), key[np.minimum(*sides) >= least], b.window_pages(most)[0],
        dict(zip(heads.tolist(), _pages_of(of, b.page[headed], len(heads)).tolist())), numbers_of(list(set(menu)))[0],
    )


def page_furniture(
    pages: list[list[str]], titles: list[str], common: np.ndarray | None = None, least: int = 4, percent: float = 4.0, window: int = 16, known: Known | None = None, lists: list | None = None
) -> list[np.ndarray]:
    """For each page (a list of lines) an array: 0 blank, 1 own, 2 furniture. `common` says of each line of all pages whether
    many pages of several sources repeat it (see `common_phrases`). Lines of six words or more need half of `percent` only.
    With `known` the pages are some of a host's, and what is counted are all of them. `lists` then gets for each page of each repeated short
    line its place, its number, the length of the run of headlines after it, and how many of them would be furniture; these aren't marked."""
    kinds = [np.zeros(len(x), dtype=np.int8) for x in pages]
    if not pages:
        return kinds
    b = BlockLines(pages, window)
    known = known or known_of_block(b, len(pages), least, percent)
    size, whole, page, has = b.size, b.whole, b.page, b.size > 0
    where = [(p, i) for p, lines in enumerate(pages) for i in range(len(lines))]
    most = _limits(known.pages, least, percent)[0]
    again = has & np.isin(whole, known.repeated)
    # long lines in fewer pages: furniture if they stand between other lines each time, as a copied article's lines don't
    flag = again | has & np.isin(whole, known.moving)
    # all but the last word or two: furniture with a word added
    for cut in (1, 2):
        flag |= (size > cut) & (size <= 8 + cut) & np.isin(b.part(cut), known.repeated)
    # long substrings in many pages: a line that they cover is furniture
    flag |= b.covered(known.windows)
    # what comes before a colon: the name of a short repeated line, or in many pages with different words after it
    named = (b.head_size <= 4) & (b.head != 0) & np.isin(b.head, known.repeated)
    trails = {b.lines[n] for n in np.flatnonzero(flag & ~again & (size <= 40)).tolist()}
    menu = np.concatenate((known.menu, numbers_of([x for line in trails for x in trail_parts(line)])[0], whole[flag & (size <= 4)]))
    named |= (b.head != 0) & np.isin(b.head, menu)
    digits = np.concatenate(([0], np.cumsum(b.word == 1)))
    digits = digits[b.first + size] - digits[b.first]
    shapes = []
    firsts: list[tuple[int, str]] = []
    for n, (line, z, f) in enumerate(zip(b.lines, size.tolist(), flag.tolist())):
        end = not f and _ends(line)
        shapes.append(not f and z >= 4 and not (_ends(_DATED.sub("", line)) if line.endswith((")", ") ")) else end))
        if f or not z:
            if not z and line.strip():
                flag[n] = True  # signs only
            continue
        if z <= 14 and common is not None and common[n]:
            flag[n] = True
            continue
        if end:
            continue
        # a short line repeated less often that ends in a name of its own: a label with the site's name
        if 2 <= z <= 10 and (c := known.lines.get(int(whole[n]), 0)) >= least and c * 200 >= percent * 75 / 100 * known.pages and not line.isupper():
            parts = line.split()
            if len(parts) > 1 and (parts[-1][:1].isupper() or len(parts) == 2 and re.match(f"[{_HAN}]", parts[-1])):
                flag[n] = True
                continue
        if _COMMENT.match(line) and z <= 30:
            flag[n] = True
        elif _ARROW.match(line):
            flag[n] = True
        elif z <= 16 and _READING.search(line):
            flag[n] = True
        elif digits[n] * 2 > z:
            flag[n] = True
        elif _TRAIL.search(line):
            parts = _TRAIL.split(line)
            if "|" in line or "｜" in line or len(parts) >= 3:
                flag[n] = True
            else:
                firsts.append((n, parts[0]))
        elif b.head[n]:
            tail = re.split(r"[:：]\s*", line, maxsplit=1)[1]
            in_pages = known.heads.get(int(b.head[n]), 0)
            if _BULLET.match(line):
                flag[n] = named[n]
            elif named[n] or in_pages >= most and len(_WORD.findall(tail)) != 2:
                flag[n] = named[n] or len(_WORD.findall(tail)) >= 5 or bool(re.search(r"[,、，].*[,、，]", tail))
            elif in_pages >= 2 and (re.search(r"[,、，].*[,、，]", tail) or len(_WORD.findall(tail)) >= (9 if re.search(f"[{_HAN}]", tail) else 5)):
                flag[n] = True
    if firsts:
        first, words = numbers_of([x for _, x in firsts])
        flag[[n for (n, _), k in zip(firsts, (words > 0) & np.isin(first, menu)) if k]] = True
    # headings of lists: repeated lines after which several headlines stand in a row
    n_lines = len(where)
    run_after = [0] * (n_lines + 1)
    for n in range(n_lines - 2, -1, -1):
        run_after[n] = run_after[n + 1] + 1 if page[n + 1] == page[n] and not flag[n + 1] and shapes[n + 1] and has[n + 1] else 0
    own_titles = [tuple(_WORD.findall(t.lower())) for t in titles]
    by_line: dict[int, list[int]] = {}
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in pages]
    for n in np.flatnonzero(again & (size <= 6)).tolist():
        p, i = where[n]
        marks = 0
        while marks < run_after[n] and not (own_titles[p] and tuple(_WORD.findall(b.lines[n + 1 + marks].lower())) == own_titles[p]):
            marks += 1
        by_line.setdefault(int(whole[n]), []).append(run_after[n])
        found[p].append((i, int(whole[n]), run_after[n], marks))
    if lists is not None:
        lists.extend(found)
    else:
        heading = {k for k, runs in by_line.items() if np.mean([r >= 2 for r in runs]) >= 0.4}
        for p, places in enumerate(found):
            at = int(np.searchsorted(page, p))
            for i, k, _, marks in places:
                if k in heading:
                    flag[at + i + 1 : at + i + 1 + marks] = True
    for n in range(n_lines):
        if not flag[n] and shapes[n] and _NUMBERED.search(b.lines[n]):
            flag[n] = True
    for n, (p, i) in enumerate(where):
        kinds[p][i] = 2 if flag[n] else 1 if b.lines[n].strip() else 0
    return kinds


def common_phrases(furniture: DataFrame, percent: float = 5.0, least: int = 8, sources: int = 2) -> DataFrame:
    """`line_hash` of lines that `percent` % of the articles of a source, and `least` of them, repeat, in `sources` sources at least.
    `furniture` comes from `residue.furniture_lines`."""
    often = furniture.where((F.col("n_articles") >= least) & (F.col("n_articles") * 100 >= F.col("of_articles") * percent))
    return often.groupBy("line_hash").agg(F.count("*").alias("sources")).where(F.col("sources") >= sources).select("line_hash")


def _without_last_word(text: str) -> str:
    return "\n".join(x.rsplit(None, 1)[0] if len(x.split()) > 1 else x for x in text.split("\n"))


def _phrase_hashes(texts: list[str]) -> np.ndarray:
    """Of each line of the texts the hash of its letters, and of its letters without the last word."""
    return np.stack((line_hashes(texts)[0], line_hashes([_without_last_word(t) for t in texts])[0]), axis=1).view(np.int64)


def _copies(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages without those that repeat the text of another one of their host, and `article_id, rep` of the latter."""
    keyed = settle(pages.select("article_id", "host", F.xxhash64("text").alias("h"), F.md5("text").alias("m")))
    reps = keyed.groupBy("host", "h", "m").agg(F.min("article_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    spare = settle(keyed.join(reps, ["host", "h", "m"]).where("article_id <> rep").select("article_id", "rep"))
    return pages.join(maybe_broadcast(spare.select("article_id")), "article_id", "left_anti"), spare


_COUNTS = "host string, block bigint, kind string, key bigint, n bigint, size bigint, article_id bigint, lines array<bigint>, heads array<bigint>"


def _rows(host: str, block: int, parts: list[dict]) -> pd.DataFrame:
    """Rows of `_COUNTS` from parts with a `kind` and some of the columns; other numbers are 0, so that none becomes a float, and other lists null."""
    columns: dict[str, list[np.ndarray]] = {k: [] for k in ("kind", "key", "n", "size", "article_id", "lines", "heads")}
    for part in parts:
        n = len(next(x for k, x in part.items() if k != "kind"))
        for k, out in columns.items():
            lists = k in ("lines", "heads")
            column = np.empty(n, dtype=object if lists or k == "kind" else np.int64)
            if lists and k in part:
                for i, x in enumerate(part[k]):
                    column[i] = x
            else:
                column[:] = part.get(k, None if lists else 0)
            out.append(column)
    return pd.DataFrame({"host": host, "block": block} | {k: np.concatenate(x) for k, x in columns.items()})


def _count_block(pdf: pd.DataFrame, percent: float, window: int) -> pd.DataFrame:
    """What a block adds to the counts of its host: `line`, the pages of each line; `window`, those of each substring on two pages of the block (on one
    if that is `percent` % of them, so that what the host repeats is counted in one of its blocks at least); `menu`, the parts of trails that are repeated in the block; `page`, the numbers of a page's lines and heads."""
    b = BlockLines([t.split("\n") for t in pdf["text"]], window)
    keys, count, size = b.line_pages()
    out = [{"kind": "line", "key": keys, "n": count, "size": size}]
    keys_w, count_w = b.window_pages(2 if percent * len(pdf) > 100 else 1)
    out.append({"kind": "window", "key": keys_w, "n": count_w})
    # a line that a share of the host's pages repeats is on that share of the pages of one of its blocks at least
    often = keys[count * 100 >= np.where(size >= 6, percent / 2, percent) * len(pdf)]
    trails = [(n, x) for n in np.flatnonzero((b.size > 0) & (b.size <= 40) & np.isin(b.whole, often)).tolist() for x in trail_parts(b.lines[n])]
    if trails:
        parts = np.unique(np.stack((b.whole[[n for n, _ in trails]], numbers_of([x for _, x in trails])[0]), axis=1), axis=0)
        out.append({"kind": "menu", "key": parts[:, 0], "n": parts[:, 1]})
    cuts = np.flatnonzero(b.page[1:] != b.page[:-1]) + 1
    out.append({"kind": "page", "article_id": pdf["article_id"].to_numpy(), "lines": np.split(b.whole, cuts), "heads": np.split(b.head, cuts)})
    return _rows(pdf["host"].iloc[0], pdf["block"].iloc[0], out)


def _count_contexts(pages: pd.DataFrame, lines: pd.DataFrame, least: int) -> pd.DataFrame:
    """`head`: the pages of each head in lines that the host doesn't repeat; `before` and `after`: up to `least` different neighbours of each long
    line that may be moving, the least ones, so that there are `least` in all blocks together if and only if the host has as many."""
    if not len(pages):
        return _rows("", 0, [{"kind": "head", "key": []}])
    whole, heads = np.concatenate(pages["lines"].tolist()), np.concatenate(pages["heads"].tolist())
    page = np.repeat(np.arange(len(pages)), [len(x) for x in pages["lines"]])
    again = np.isin(whole, lines["key"][lines["kind"] == "repeated"])
    headed = np.flatnonzero((heads != 0) & ~again)
    keys, of = np.unique(heads[headed], return_inverse=True)
    out = [{"kind": "head", "key": keys, "n": _pages_of(of, page[headed], len(keys))}]
    at = np.flatnonzero(np.isin(whole, lines["key"][lines["kind"] == "long"]))
    for kind, beside in zip(("before", "after"), neighbours(whole, page, (whole != 0) & ~again, at, -1 - pages["article_id"].to_numpy())):
        pairs = pd.DataFrame({"key": whole[at], "n": beside}).drop_duplicates().sort_values(["key", "n"])
        pairs = pairs[pairs.groupby("key").cumcount() < least]
        out.append({"kind": kind, "key": pairs["key"].to_numpy(), "n": pairs["n"].to_numpy()})
    return _rows(pages["host"].iloc[0], pages["block"].iloc[0], out)


def _known_of_hosts(dealt: DataFrame, sizes: DataFrame, least: int, percent: float, window: int) -> DataFrame:
    """`host, block, kind, key, n`: for each block of a host of several blocks what all pages of the host repeat, as far as the block needs it."""
    many = sizes.where("blocks > 1").withColumn("most", F.greatest(F.lit(least), F.ceil(F.col("pages") * percent / 100))).withColumn("half", F.greatest(F.lit(least), F.ceil(F.col("pages") * percent / 200)))
    many = settle(many)
    hosts = maybe_broadcast(many)
    texts = dealt.join(maybe_broadcast(many.select("host")), "host", "left_semi").select("article_id", "host", "block", "text")

    counts = settle(texts.groupBy("host", "block").applyInPandas(lambda pdf: _count_block(pdf, percent, window), _COUNTS))
    lines = counts.where("kind = 'line'")
    totals = lines.groupBy("host", "key").agg(F.sum("n").alias("n"), F.first("size").alias("size")).where(F.col("n") >= least).join(hosts, "host")
    kind = F.when(F.col("n") >= F.when(F.col("size") >= 6, F.col("half")).otherwise(F.col("most")), "repeated").when(F.col("size") >= 6, "long").otherwise("line")
    totals = settle(totals.select("host", "key", "n", kind.alias("kind")))
    repeated, fewer = totals.where("kind = 'repeated'"), totals.where("kind <> 'repeated'")
    blocks = settle(counts.select("host", "block").distinct())
    on_blocks = maybe_broadcast(blocks)
    in_blocks = settle(
        repeated.join(on_blocks, "host").select("host", "block", "kind", "key", "n").unionByName(lines.select("host", "block", "key").join(fewer, ["host", "key"]).select("host", "block", "kind", "key", "n"))
    )

    pages = counts.where("kind = 'page'").select("host", "block", "article_id", "lines", "heads")
    asked = in_blocks.where("kind in ('repeated', 'long')").select("host", "block", "kind", "key")
    contexts = settle(
        pages.groupBy("host", "block").cogroup(asked.groupBy("host", "block")).applyInPandas(lambda x, y: _count_contexts(x, y, least), _COUNTS)
    )
    sides = contexts.where("kind in ('before', 'after')").groupBy("host", "key").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("before", "after")])
    moving = sides.where((F.col("before") >= least) & (F.col("after") >= least)).select("host", "key")
    heads = contexts.where("kind = 'head'")
    head_totals = heads.groupBy("host", "key").agg(F.sum("n").alias("n")).where("n > 1")

    # substrings on one page of a block aren't counted there; where they could make the difference all of them are
    seen = counts.where("kind = 'window'").groupBy("host", "key").agg(F.sum("n").alias("n"), F.count("*").alias("of")).join(hosts, "host").where("n + blocks - of >= most")
    seen = settle(seen.select("host", "key", "n", "most"))
    doubtful = settle(seen.where("n < most").select("host", "key"))
    windows = seen.where("n >= most").select("host", "key")
    if doubtful.limit(1).count():
        again = texts.join(maybe_broadcast(settle(doubtful.select("host").distinct())), "host", "left_semi")
        every = again.groupBy("host", "block").applyInPandas(lambda pdf: _window_rows(pdf, window), "host string, key bigint, n bigint")
        exact = every.join(maybe_broadcast(doubtful), ["host", "key"], "left_semi").groupBy("host", "key").agg(F.sum("n").alias("n"))
        windows = windows.unionByName(exact.join(hosts, "host").where("n >= most").select("host", "key"))
    menu = counts.where("kind = 'menu'").select("host", "key", "n").distinct().join(repeated.select("host", "key"), ["host", "key"], "left_semi").select("host", F.col("n").alias("key")).distinct()

    none, columns = F.lit(0).cast("bigint").alias("n"), ("host", "block", "kind", "key", "n")
    known = in_blocks
    for what, rows in (("window", windows), ("menu", menu)):
        known = known.unionByName(rows.join(on_blocks, "host").select("host", "block", F.lit(what).alias("kind"), "key", none).select(*columns))
    known = known.unionByName(in_blocks.where("kind = 'long'").join(moving, ["host", "key"], "left_semi").select("host", "block", F.lit("moving").alias("kind"), "key", none))
    known = known.unionByName(heads.select("host", "block", "key").join(head_totals, ["host", "key"]).select("host", "block", F.lit("head").alias("kind"), "key", "n"))
    return known.unionByName(blocks.join(hosts, "host").select("host", "block", F.lit("pages").alias("kind"), F.lit(0).cast("bigint").alias("key"), F.col("pages").alias("n")))


def _window_rows(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    keys, count = BlockLines([t.split("\n") for t in pdf["text"]], window).window_pages(1)
    return pd.DataFrame({"host": pdf["host"].iloc[0], "key": keys, "n": count})


def _known(rows: pd.DataFrame) -> Known | None:
    """What the rows of a block say; none for the only block of a host."""
    if not len(rows):
        return None
    kind, key, n = rows["kind"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy()
    of = {k: kind == k for k in ("repeated", "line", "long", "moving", "window", "head", "menu", "pages")}
    counted = of["repeated"] | of["line"] | of["long"]
    return Known(
        int(n[of["pages"]][0]), key[of["repeated"]], dict(zip(key[counted].tolist(), n[counted].tolist())), key[of["moving"]], key[of["window"]],
        dict(zip(key[of["head"]].tolist(), n[of["head"]].tolist())), key[of["menu"]],
    )


def judge_page_lines(
    articles: DataFrame, furniture: DataFrame | None = None, block: int = 400, least: int = 4, percent: float = 4.0, most_phrases: int = 1_000_000, window: int = 16
) -> DataFrame:
    """`article_id, kinds` for each article with text: by line 0 blank, 1 own, 2 furniture. Lines are those of `split(text, '\\n')`.

    The pages of a host (of `final_url`, else of `seed_url`, else the source) are dealt by a hash of their text into blocks of about
    `block` pages, so a host that holds a third of all pages is many blocks of the same size. In each block lines and, by a suffix array over
    the token streams (numbers masked), substrings are counted; the counts of a host's blocks are added up before anything is decided. What
    `percent` % of the host's pages and `least` pages at least repeat is furniture: whole lines, lines with a word or two added,
    and lines covered by long substrings. Then come lines that hang on these: long lines between changing ones, menu trails,
    labels with changing values, lists of headlines under a repeated heading, comments, readings and numbers. Pages of a host with the same text
    are judged once, under the title of the least id, and count as one. Short lines are also compared with lines that several sources
    repeat (`common_phrases`): these travel to all tasks while there are at most `most_phrases` (8 MB), else they are
    joined to the pages' lines by shuffle. Null and empty texts: no row. Every page is judged on its whole text; results don't depend on how pages are dealt,
    but for parts of trails in lines that aren't repeated whole, which are known in their block only.
    """
    spark = articles.sparkSession
    base = articles.where(F.col("text") != "").select(
        "article_id", F.coalesce(host_of("final_url"), host_of("seed_url"), source_of("src_file"), F.lit("")).alias("host"), F.coalesce("title", F.lit("")).alias("title"), "text"
    )
    pages, spare = _copies(base)
    sizes = settle(pages.groupBy("host").agg(F.count("*").alias("pages")).withColumn("blocks", F.ceil(F.col("pages") / F.lit(float(block)))))
    blocks = F.pmod(F.xxhash64("text"), F.col("blocks"))
    if sizes.limit(200_001).count() <= 200_000:
        dealt = pages.join(F.broadcast(sizes), "host").withColumn("block", blocks)
    else:  # sizes are joined to ids, not to texts, so that no host's texts gather
        numbers = pages.select("article_id", "host", F.xxhash64("text").alias("hash")).join(sizes, "host").select("article_id", F.pmod("hash", "blocks").alias("block"))
        dealt = pages.join(settle(numbers), "article_id")
    dealt = dealt.select("article_id", "host", "block", "title", "text")
    known = _known_of_hosts(dealt, sizes, least, percent, window)

    phrases = settle(common_phrases(furniture_lines(articles) if furniture is None else furniture))
    shared = None
    if phrases.limit(most_phrases + 1).count() <= most_phrases:
        shared = spark.sparkContext.broadcast(np.sort(phrases.toArrow().column("line_hash").to_numpy()))
        dealt = dealt.withColumn("hits", F.lit(None).cast("array<int>"))
    else:

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (piece for whole in batches for piece in slices(whole, 1, 4_000_000)):
                texts = batch.column(1).to_pylist()
                both = _phrase_hashes(texts)
                size = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
                row, at = np.repeat(np.arange(len(texts)), size), np.arange(len(both)) - np.repeat(np.cumsum(size) - size, size)
                ids = batch.column(0).take(pa.array(np.concatenate((row, row))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate((at, at)).astype(np.int32)), pa.array(both.T.reshape(-1))], names=["article_id", "at", "line_hash"])

        lines = pages.select("article_id", "text").mapInArrow(explode, "article_id bigint, at int, line_hash bigint").where("line_hash <> 0")
        hits = lines.join(phrases, "line_hash", "left_semi").groupBy("article_id").agg(F.collect_set("at").alias("hits"))
        dealt = dealt.join(hits, "article_id", "left")

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = ["article_id", "kinds", "host", "lists"]
        if not len(pdf):
            return pd.DataFrame(columns=names)
        texts = pdf["text"].tolist()
        if shared is not None:
            common = np.isin(_phrase_hashes(texts), shared.value).any(axis=1)
        else:
            common = np.concatenate([np.isin(np.arange(t.count("\n") + 1), [] if h is None else h) for t, h in zip(texts, pdf["hits"])])
        counts, lists = _known(known), []
        kinds = page_furniture([t.split("\n") for t in texts], pdf["title"].tolist(), common, least, percent, window, counts, None if counts is None else lists)
        flat = [None if counts is None else [x for place in lists[p] for x in place] for p in range(len(texts))]
        return pd.DataFrame(dict(zip(names, (pdf["article_id"], [k.tolist() for k in kinds], pdf["host"], flat))))

    texts = dealt.select("article_id", "host", "block", "title", "text", "hits")
    judged = settle(texts.groupBy("host", "block").cogroup(known.groupBy("host", "block")).applyInPandas(run, "article_id bigint, kinds array<tinyint>, host string, lists array<bigint>"))
    judged = _with_lists(judged)
    return judged.unionByName(spare.join(judged.withColumnRenamed("article_id", "rep"), "rep").select("article_id", "kinds"))


def _with_lists(judged: DataFrame) -> DataFrame:
    """Marks headlines under the lines after which, over all pages of the host, two or more stand in a row in 40 % of the cases. `lists` holds for
    each repeated short line its place, its number, the length of the row and how many lines of it to mark."""
    at = F.sequence(F.lit(0), F.size("lists") - 4, F.lit(4))
    places = judged.where(F.size("lists") > 0).select("article_id", "host", F.explode(F.transform(at, lambda i: F.struct(*[F.get("lists", i + k).alias(n) for k, n in enumerate(("at", "key", "run", "marks"))]))).alias("x"))
    places = places.select("article_id", "host", "x.*")
    heading = settle(places.groupBy("host", "key").agg(F.avg((F.col("run") >= 2).cast("int")).alias("share")).where("share >= 0.4").select("host", "key"))
    marks = places.where("marks > 0").join(maybe_broadcast(heading), ["host", "key"], "left_semi").groupBy("article_id").agg(F.collect_list(F.struct("at", "marks")).alias("spans"))
    marked = F.transform("kinds", lambda k, i: F.when(F.exists("spans", lambda x: (i > x["at"]) & (i <= x["at"] + x["marks"])), F.lit(2)).otherwise(k).cast("tinyint"))
    return settle(judged.join(marks, "article_id", "left").select("article_id", F.when(F.col("spans").isNull(), F.col("kinds")).otherwise(marked).alias("kinds")))


def furniture_places(articles: DataFrame, **how) -> DataFrame:
    """`article_id, line_no` of each non-blank line that isn't the article's own."""
    judged = judge_page_lines(articles, **how)
    return judged.select("article_id", F.posexplode("kinds").alias("at", "kind")).where("kind = 2").select("article_id", (F.col("at") + 1).alias("line_no"))


def main_texts(articles: DataFrame, **how) -> DataFrame:
    """`article_id, text`: the articles' texts without furniture; null and empty texts stay as they are."""
    judged = judge_page_lines(articles, **how)
    lines = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), F.col("kinds").alias("kind")), lambda x: x["kind"] != 2)
    joined = articles.select("article_id", "text").join(judged, "article_id", "left")
    return joined.select("article_id", F.when(F.col("kinds").isNull(), F.col("text")).otherwise(F.array_join(lines["line"], "\n")).alias("text"))
