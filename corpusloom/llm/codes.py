"""Words of many texts at once: code points as arrays, word hashes without a Python loop over words."""

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Letters and digits lie below this code point.
_TOP = 0x32400


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 no part of a word, 1 letter or digit, 2 Han; whether it is a letter; and a random number."""
    every = "".join(map(chr, range(_TOP))).encode("utf-32-le", "surrogatepass").decode("utf-32-le", "surrogatepass")
    kind = np.zeros(_TOP + 1, dtype=np.int8)
    for mark, pattern in ((1, r"[\p{L}\p{N}]+"), (2, r"\p{Han}+")):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = mark
    letter = np.zeros(_TOP + 1, dtype=bool)
    for m in regex.finditer(r"\p{L}+", every):
        letter[m.start() : m.end()] = True
    return kind, letter, mixed(np.arange(_TOP + 1, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number with its bits mixed (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of the texts in lower case, in order, and where each text's words begin (one entry more than texts).
    A word is a Han character or an unbroken run of other letters and digits; null has none."""
    kinds, _, numbers = _tables()
    low = [t.lower() if t else "" for t in texts]
    sizes = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.minimum(code, _TOP)
    kind = kinds[code]
    begin = kind > 0
    begin[1:] &= (kind[1:] == 2) | (kind[1:] != kind[:-1])
    ends = np.cumsum(sizes)
    cuts = ends[:-1][ends[:-1] < len(code)]
    begin[cuts] = kind[cuts] > 0  # no word runs from one text into the next
    at = np.flatnonzero(kind > 0)
    starts = np.flatnonzero(begin[at])
    bounds = np.searchsorted(at[starts], np.concatenate(([0], ends))) if len(at) else np.zeros(len(low) + 1, dtype=np.int64)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), bounds
    length = np.diff(np.concatenate((starts, [len(at)])))
    place = np.arange(len(at)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        weight = mixed(np.arange(int(length.max()), dtype=np.uint64)) | np.uint64(1)
        return mixed(np.add.reduceat(numbers[code[at]] * weight[place], starts)), bounds


def line_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each line's letters in lower case (0 for a line without letters), and where each text's lines begin (one entry
    more than texts). A null or empty text has one empty line."""
    _, letters, numbers = _tables()
    low = [t.lower() if t else "" for t in texts]
    bounds = np.concatenate(([0], np.cumsum(np.fromiter((t.count("\n") + 1 for t in low), dtype=np.int64, count=len(low)))))
    code = np.minimum(np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _TOP)
    breaks = np.flatnonzero(code == 10)
    at = np.flatnonzero(letters[code])
    out = np.zeros(int(bounds[-1]), dtype=np.uint64)
    if not len(at):
        return out, bounds
    starts = np.searchsorted(at, np.concatenate(([0], breaks + 1)))
    length = np.diff(np.concatenate((starts, [len(at)])))
    full = length > 0
    place = np.arange(len(at)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        weight = mixed(np.arange(int(length.max()), dtype=np.uint64)) | np.uint64(1)
        out[full] = mixed(np.add.reduceat(numbers[code[at]] * weight[place], starts[full])) | np.uint64(1)
    return out, bounds


@cache
def _digits() -> np.ndarray:
    return np.fromiter((chr(c).isdigit() for c in range(_TOP + 1)), dtype=bool, count=_TOP + 1)


def masked_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A positive number for each word of the texts, in lower case, the same for all words that begin with a digit, and the number of words of
    each line of all texts."""
    kinds, _, numbers = _tables()
    code = np.minimum(np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _TOP)
    breaks = np.flatnonzero(code == 10)
    kind = kinds[code]
    at = np.flatnonzero(kind > 0)
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(len(breaks) + 1, dtype=np.int64)
    begin = np.ones(len(at), dtype=bool)
    begin[1:] = (at[1:] != at[:-1] + 1) | (kind[at[1:]] == 2) | (kind[at[:-1]] == 2)
    starts = np.flatnonzero(begin)
    length = np.diff(np.concatenate((starts, [len(at)])))
    place = np.arange(len(at)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        word = mixed(np.add.reduceat(numbers[code[at]] * (mixed(np.arange(int(length.max()), dtype=np.uint64)) | np.uint64(1))[place], starts))
    number = (word >> np.uint64(2)).astype(np.int64) + 2
    first = at[starts]
    number[_digits()[code[first]]] = 1
    return number, np.diff(np.concatenate(([0], np.searchsorted(first, breaks), [len(first)])))


def slices(batch: pa.RecordBatch, column: int, most: int, rows: int = 4_000):
    """Cuts a batch into pieces of about `most` bytes of text and at most `rows` rows, so that memory depends on the longest text only."""
    texts = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(size)
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(at, to - at)
        at = to
