"""Pairs of texts with similar shingle sets: an exact join by prefixes of tokens and token combinations."""

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.llm.codes import mixed, slices, word_hashes
from corpusloom.plans.shared import maybe_broadcast, settle

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A token is a number of so many bits; its upper bits are its cell in the table of frequencies.
_TOKEN_BITS, _CELL_BITS, _CHUNK_BITS = 36, 23, 16
#: Classes a set is dealt into, and 64-bit words of the parity map of each.
_CLASSES, _MAP = 8, 4
_SIG_BITS = 23
_U = np.uint64


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    return x >> _U(n)


def _tokens(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the token of each different sequence of n words of a text, sorted by both."""
    word, bounds = word_hashes(texts)
    count = np.maximum(np.diff(bounds) - (n - 1), 0)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), count)
    if not len(row):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    start = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(len(row))
    s = np.zeros(len(row), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            s = (s ^ word[start + i]) * _A
            s ^= _shift(s, 29)
    key = np.sort(row << _U(_TOKEN_BITS) | _shift(s, 64 - _TOKEN_BITS))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return _shift(key, _TOKEN_BITS).astype(np.int64), key & _U((1 << _TOKEN_BITS) - 1)


def _rank(count: np.ndarray, rare: int) -> np.ndarray:
    """Frequency class of a count: 0 at most one text, 1 up to `rare` texts, then four classes for each doubling."""
    return np.where(count <= 1, 0, np.where(count <= rare, 1, 2 + np.floor(4 * np.log2(np.maximum(count, 1))))).astype(np.uint8)


def token_classes(texts: DataFrame, n: int, rare: int) -> tuple[np.ndarray, int]:
    """The frequency class of each of 2**23 cells of tokens, and the number of tokens of all texts.

    Tokens are counted by cell, so the table has 8 MB whatever the input. Tokens that share a cell get the class of their sum; any order of tokens
    gives the same pairs, only at other cost. Each task sends what it counted as packed chunks of 65,536 cells.
    """
    chunks, width = 1 << (_CELL_BITS - _CHUNK_BITS), 1 << _CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << _CELL_BITS, dtype=np.uint32)
        for batch in batches:
            for piece in slices(batch, 0, 2_000_000):
                token = _tokens(piece.column(0).to_pylist(), n)[1]
                u, k = np.unique(_shift(token, _TOKEN_BITS - _CELL_BITS).astype(np.int64), return_counts=True)
                cells[u] += k.astype(np.uint32)
        for c in range(chunks):
            part = cells[c * width : (c + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                big = at[part[at] > 65535]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint16), np.minimum(part[at], 65535).astype(np.uint16), big.astype(np.uint16), part[big]))],
                    names=["chunk", "at", "k", "big", "big_k"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                total = sums.setdefault(r["chunk"], np.zeros(width, dtype=np.int64))
                k = np.zeros(width, dtype=np.int64)
                k[np.frombuffer(r["at"], dtype=np.uint16)] = np.frombuffer(r["k"], dtype=np.uint16)
                k[np.frombuffer(r["big"], dtype=np.uint16)] = np.frombuffer(r["big_k"], dtype=np.uint32)
                total += k
        for c, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([_rank(total, rare).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["chunk", "ranks", "total"])

    counted = texts.mapInArrow(count, "chunk int, at binary, k binary, big binary, big_k binary")
    summed = counted.repartition(min(chunks, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "chunk").mapInArrow(add, "chunk int, ranks binary, total bigint")
    ranks, volume = np.zeros(1 << _CELL_BITS, dtype=np.uint8), 0
    for r in summed.collect():  # at most 128 rows of 64 KB
        ranks[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["ranks"], dtype=np.uint8)
        volume += r["total"]
    return ranks, volume


class _Rule:
    """The arithmetic of a Jaccard similarity of at least p/q, in whole numbers. Sets of a and b tokens share at least p (a + b) / (p + q)."""

    def __init__(self, similarity: float):
        t = Fraction(similarity).limit_denominator(1000)
        if not Fraction(1, 2) <= t <= 1:
            raise ValueError("similarity must lie between 0.5 and 1")
        self.p, self.q = t.numerator, t.denominator

    def groups(self, bucket: np.ndarray) -> np.ndarray:
        """Groups of common tokens: about t/2 of the tokens, always fewer than similar sets share."""
        return np.maximum(1, (np.int64(1) << bucket) * self.p // (2 * self.q))

    def need(self, z: np.ndarray, bucket: np.ndarray, role: int) -> np.ndarray:
        """Contributions a set of z tokens sends to partners of its own power of two and below, or (role 1) to those of the next."""
        missing = z * (self.q - self.p) // self.q if role == 0 else (self.q * z - self.p * (np.int64(1) << bucket)) // (self.p + self.q)
        return np.where(missing < 0, 0, missing + 1)

    def reach(self, z: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Greatest partner that a set of z tokens can have if its first shared signature has c contributions before it."""
        return (self.q * z - (self.p + self.q) * c) // self.p

    def fits(self, za: np.ndarray, zb: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (self.p + self.q) * c <= self.q * za - self.p * zb

    def near(self, differing: np.ndarray, za: np.ndarray, zb: np.ndarray) -> np.ndarray:
        """Whether sets may be similar that differ in at least so many tokens."""
        return (self.p + self.q) * differing <= (self.q - self.p) * (za + zb)


def _signatures(sub: np.ndarray, token: np.ndarray, rank: np.ndarray, hot: int, rule: _Rule) -> Iterator[tuple[np.ndarray, ...]]:
    """Yields blocks of signatures: key, place (a hash of the rarer token), sub-set, contributions before it, flags (1 small role, 2 for smaller partners only).

    `sub`, `rank` and `token` are sorted. Tokens are taken by frequency class. A rare token is a signature of its own; one that is in no other text is
    none, but counts. Common tokens are dealt by hash into groups, and each two of a group are a signature. A rare token contributes
    one, a common one if it isn't the first of its group. Two sets that miss at most t tokens of each other share a signature
    among the contributions 0..t of both, as each missing token takes away one contribution at most.
    """
    size = np.bincount(sub)
    first = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1])))
    each = np.diff(np.concatenate((first, [len(sub)])))
    z = size[sub]
    power = np.floor(np.log2(z)).astype(np.int64)
    common = rank > 1
    index = np.arange(len(sub))
    with np.errstate(over="ignore"):
        hashed = mixed(token)
        few = np.flatnonzero((z <= 2) & common)  # sets of one and two tokens may share one common token only
        yield hashed[few] * _B ^ _U(3), hashed[few], sub[few], np.zeros(len(few), dtype=np.int64), np.zeros(len(few), dtype=np.int64)
    for role in (0, 1):
        bucket = power + role
        groups = rule.groups(bucket)
        need = rule.need(z, bucket, role)
        group = np.where(common, _shift(hashed, 20) % groups.astype(np.uint64), 0).astype(np.int64) + common
        wide = int(group.max()) + 1
        bits = len(sub).bit_length()
        key = (sub * wide + group) << bits | index
        key.sort()
        by = key & ((1 << bits) - 1)
        key >>= bits
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        place = np.empty(len(sub), dtype=np.int64)
        place[by] = index - np.repeat(begin, np.diff(np.concatenate((begin, [len(sub)]))))
        adds = np.where(common, place >= 1, True)
        total = np.cumsum(adds) - adds
        ordinal = total - np.repeat(total[first], each)
        taken = ordinal < need
        if role == 0:
            at = np.flatnonzero(taken & (rank == 1))
            with np.errstate(over="ignore"):
                yield hashed[at] * _A, hashed[at], sub[at], ordinal[at], np.zeros(len(at), dtype=np.int64)
        keep = (taken & common)[by]
        p, k = by[keep], key[keep]
        for lag in range(1, len(p)):
            same = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(same):
                break
            a, b = p[same], p[same + lag]
            with np.errstate(over="ignore"):
                sig, at = mixed((hashed[a] * _A) ^ (hashed[b] * _B) ^ bucket[b].astype(np.uint64)), hashed[a] ^ _U(11)
            texts = np.where(rank[a] > 2, 2.0 ** ((np.minimum(rank[a], rank[b]).astype(np.float64) - 1) / 4), 1.0)
            parts = np.maximum(1, np.ceil(texts / hot)).astype(np.uint64)
            flags = np.full(len(a), role)
            if (parts > 1).any():  # a list that may be very long is dealt by sub-set; those that can be the smaller side go to every part
                with np.errstate(over="ignore"):
                    own = _shift(mixed(sub[b].astype(np.uint64) ^ hashed[a]), 33) % parts
                    for part in range(1, int(parts.max())):
                        extra = np.flatnonzero((parts > part) & ((rule.p + rule.q) * ordinal[b] <= (rule.q - rule.p) * z[b]))
                        to = (own[extra] + _U(part)) % parts[extra] + _U(1)
                        yield sig[extra] + to * _A, at[extra] + to * _B, sub[b[extra]], ordinal[b[extra]], np.full(len(extra), role | 2)
                    sig, at = np.where(parts > 1, sig + (own + _U(1)) * _A, sig), np.where(parts > 1, at + (own + _U(1)) * _B, at)
            yield sig, at, sub[b], ordinal[b], flags


def _parity(sub: np.ndarray, token: np.ndarray, n: int, words_: int) -> np.ndarray:
    """For each sub-set a map of 64 * `words_` bits: how many of its tokens hash to each, modulo 2. Maps differ in at most as many bits as the sets in tokens."""
    bits = 64 * words_
    at = (mixed(token ^ _U(0x5DEECE66D)) % _U(bits)).astype(np.int64)
    odd = (np.bincount(sub * bits + at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.uint64)


def _meetings(sig, doc, z, c, flag, maps, rule: _Rule, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sub-sets with a common signature that lies in the prefixes this pair of sizes needs, and whose parity maps allow a similarity."""
    if len(maps) < 1 << 21 and int(z.max()) < 1 << 20:
        order = np.argsort(sig.astype(np.uint64) << _U(41) | z.astype(np.uint64) << _U(21) | doc.astype(np.uint64))
    else:
        order = np.lexsort((doc, z, sig))
    sig, doc, z, c, flag = sig[order].astype(np.int64), doc[order], z[order].astype(np.int64), c[order].astype(np.int64), flag[order]
    many = np.concatenate(([False], sig[1:] == sig[:-1]))
    many = np.flatnonzero(many | np.concatenate((many[1:], [False])))
    if not len(many):
        return
    sig, doc, z, c, flag = sig[many], doc[many], z[many], c[many], flag[many]
    key = sig << 36 | z
    low = np.arange(len(sig)) + 1
    high = np.searchsorted(key, sig << 36 | np.maximum(rule.reach(z, c), 0), side="right")
    count = np.maximum(high - low, 0)
    cum = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < len(sig):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + most, side="right")) - 1)
        n = count[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(cum[at:to] - cum[at], n) + i + 1
        ok = rule.fits(z[j], z[i], c[j]) & rule.fits(z[i], z[j], c[i]) & (doc[i] != doc[j]) & ((flag[i] & flag[j] & 1) == 0)
        ok &= (flag[j] & 2 == 0) | ((z[i] == z[j]) & (flag[i] & 2 == 0))
        i, j = i[ok], j[ok]
        a, b = doc[i], doc[j]
        differing = np.zeros(len(a), dtype=np.int64)
        for w in range(maps.shape[1]):
            differing += np.bitwise_count(maps[a, w] ^ maps[b, w])
        ok = rule.near(differing, z[i], z[j])
        yield a[ok], b[ok]
        at = to


def similar_pairs(docs: DataFrame, doc_id: str = "article_id", text: str = "text", n: int = 5, similarity: float = 0.8, rare: int = 4, hot: int = 50_000, per_bucket: int = 1_500_000) -> DataFrame:
    """`a, b, overlap, size_a, size_b` (a < b): all pairs of different texts whose sets of n-word sequences have a Jaccard similarity of `similarity` (0.5 to 1) or more.

    1. Tokens (sequences) are counted by cell of a hash, which orders them from rare to frequent (`token_classes`).
    2. The tokens of a text are dealt by hash into 8 classes. If two texts are similar, then so are their parts in one class at least
       (a ratio of sums is at most the greatest of the ratios). In each class a text sends signatures (`_signatures`): single
       rare tokens, pairs of common ones, as many as a partner of the least size asks for. They are packed before the shuffle: four bytes each,
       and once for each text, class and bucket its id, sizes and a parity map of the class's tokens.
    3. In each bucket, texts meet if a signature lies in the prefix that their two sizes need. A pair is written only if the sizes and the parity maps
       allow a similarity, so texts that merely have a sentence in common are dropped before any pair is shuffled.
    4. Remaining pairs are compared by parity maps of the whole sets, then by the whole sets themselves (32-bit fingerprints of tokens).

    Nothing is capped or sampled, and no step can lose a similar pair; lists that may hold more than `hot` entries are split. A bucket holds about
    `per_bucket` signatures, whatever the input. Texts without n words have no pair. Input ids must be unique.
    """
    spark = docs.sparkSession
    rule = _Rule(similarity)
    base = docs.where(F.col(text) != "").select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t"))
    ranks, volume = token_classes(base.select("t"), n, rare)
    table = spark.sparkContext.broadcast(ranks)
    subs = 1 + int(volume * 1.5) // (_CLASSES * per_bucket)

    def dealt(texts: list[str], whole: bool = False) -> tuple[np.ndarray, ...]:
        """Sub-set, frequency class and token, in this order; sub-sets are numbered row * classes + class."""
        row, token = _tokens(texts, n)
        rank = table.value[_shift(token, _TOKEN_BITS - _CELL_BITS).astype(np.int64)]
        sub = row * _CLASSES + (mixed(token) % _U(_CLASSES)).astype(np.int64)
        key = np.sort(sub.astype(np.uint64) << _U(_TOKEN_BITS + 7) | rank.astype(np.uint64) << _U(_TOKEN_BITS) | token)
        return _shift(key, _TOKEN_BITS + 7).astype(np.int64), (_shift(key, _TOKEN_BITS) & _U(127)).astype(np.uint8), key & _U((1 << _TOKEN_BITS) - 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 3_000_000):
                ids = batch.column(0).to_numpy()
                sub, rank, token = dealt(batch.column(1).to_pylist())
                if not len(sub):
                    continue
                rows = len(ids) * _CLASSES
                size, maps = np.bincount(sub, minlength=rows), _parity(sub, token, rows, _MAP)
                z = size.reshape(len(ids), _CLASSES).sum(axis=1)
                sig, at, s, c, flag = (np.concatenate(x) for x in zip(*_signatures(sub, token, rank, hot, rule)))
                bucket = (s % _CLASSES) * subs + (_shift(at, 13) % _U(subs)).astype(np.int64)
                packed = (_shift(sig, 64 - _SIG_BITS) << _U(9) | flag.astype(np.uint64) << _U(7) | (c * 128 // (size[s] + 1)).astype(np.uint64)).astype(np.uint32)
                order = np.argsort(bucket * rows + s, kind="stable")
                bucket, s, packed = bucket[order], s[order], packed[order]
                new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (bucket[1:] != bucket[:-1]))))
                each = np.diff(np.concatenate((new, [len(s)])))
                head = s[new]
                cuts, hcuts = np.searchsorted(bucket, np.arange(_CLASSES * subs + 1)), np.searchsorted(bucket[new], np.arange(_CLASSES * subs + 1))
                cols = (ids[head // _CLASSES], z[head // _CLASSES].astype(np.int32), size[head].astype(np.int32), each.astype(np.int32), maps[head])
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    lo, hi = hcuts[b], hcuts[b + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x[lo:hi].tobytes()], pa.binary()) for x in cols), pa.array([packed[cuts[b] : cuts[b + 1]].tobytes()], pa.binary())], names=names)

    names = ["bucket", "id", "whole", "z", "each", "maps", "sigs"]

    def meet_bucket(rows: list[dict]) -> pa.RecordBatch | None:
        read = lambda c, dtype: np.concatenate([np.frombuffer(r[c], dtype=dtype) for r in rows])
        ids, whole, z, each, packed = read("id", np.int64), read("whole", np.int32).astype(np.int64), read("z", np.int32).astype(np.int64), read("each", np.int32), read("sigs", np.uint32)
        maps = read("maps", np.uint64).reshape(-1, _MAP)
        doc = np.repeat(np.arange(len(ids)), each)
        c = -(-((packed & np.uint32(127)).astype(np.int64) * (z[doc] + 1)) // 128)
        got = []
        for a, b in _meetings(packed >> np.uint32(9), doc, z[doc], c, (packed >> np.uint32(7)) & np.uint32(3), maps, rule):
            fit = (whole[a] * rule.q >= whole[b] * rule.p) & (whole[b] * rule.q >= whole[a] * rule.p) & (ids[a] != ids[b])
            got.append(np.unique(np.minimum(a[fit], b[fit]) * np.int64(len(ids)) + np.maximum(a[fit], b[fit])))
        if not got:
            return None
        u = np.unique(np.concatenate(got))
        a, b = ids[u // len(ids)], ids[u % len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # the rows of one bucket; buckets come one after the other
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    if (out := meet_bucket(held)) is not None:
                        yield out
                    held = []
                held.append(r)
        if held and (out := meet_bucket(held)) is not None:
            yield out

    signed = base.mapInArrow(sign, "bucket int, id binary, whole binary, z binary, each binary, maps binary, sigs binary")
    met = signed.repartition(_CLASSES * subs, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a bigint, b bigint")
    likely = settle(met.distinct())

    def whole_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A parity map with two to four bits for each token, so that it grows with the set."""
        for part in batches:
            for batch in slices(part, 1, 3_000_000):
                row, token = _tokens(batch.column(1).to_pylist(), n)
                hashed, cuts = mixed(token ^ _U(0x2545F491)), np.searchsorted(row, np.arange(len(batch) + 1))
                out = []
                for i in range(len(batch)):
                    bits = max(64, 1 << int(cuts[i + 1] - cuts[i]).bit_length() + 1)
                    out.append(np.packbits((np.bincount((hashed[cuts[i] : cuts[i + 1]] % _U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cuts).astype(np.int32)), pa.array(out, pa.binary())], names=["id", "z", "m"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            za, zb = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            least = np.empty(len(batch), dtype=np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                size = min(len(x), len(y))  # the greater map is folded, as bits are dealt modulo a power of two
                least[k] = np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) ^ np.bitwise_xor.reduce(y.reshape(-1, size), axis=0)).sum()
            keep = pa.array(rule.near(least, za, zb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    of = lambda df, side: df.select(*[F.col(c).alias(c if c == "id" else c + side) for c in df.columns]).withColumnRenamed("id", side)
    mapped = settle(base.mapInArrow(whole_maps, "id bigint, z int, m binary"))
    likely = likely.join(of(mapped, "a"), "a").join(of(mapped, "b"), "b").select("a", "b", "za", "zb", "ma", "mb")
    likely = settle(likely.mapInArrow(sift, "a bigint, b bigint"))
    asked = maybe_broadcast(settle(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for batch in slices(part, 1, 3_000_000):
                row, token = _tokens(batch.column(1).to_pylist(), n)
                small, cuts = _shift(mixed(token), 32).astype(np.uint32), np.searchsorted(row, np.arange(len(batch) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(small[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(batch))], pa.binary())], names=["id", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (batch.column(k).to_pylist() for k in (2, 3))
            out = []
            for x, y in zip(sa, sb):
                m = np.frombuffer(x + y, dtype=np.uint32).copy()
                m.sort()
                out.append((int((m[1:] == m[:-1]).sum()), len(x) // 4, len(y) // 4))
            o = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(o[:, i]) for i in range(3))], names=["a", "b", "overlap", "size_a", "size_b"])

    members = settle(base.join(asked, "id", "left_semi").mapInArrow(sets, "id bigint, s binary"))
    both = likely.join(of(members, "a"), "a").join(of(members, "b"), "b").select("a", "b", "sa", "sb")
    checked = both.mapInArrow(compare, "a bigint, b bigint, overlap bigint, size_a bigint, size_b bigint")
    return checked.where((F.col("overlap") > 0) & (F.col("overlap") * (rule.p + rule.q) >= rule.p * (F.col("size_a") + F.col("size_b"))))


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`id, rep, n` of texts that stand in the table more than once, as they are; rep is the least id with the text, n their number."""
    keyed = settle(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), F.md5(text).alias("m")))
    groups = keyed.groupBy("h", "m").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, ["h", "m"]).select("id", "rep", "n")


def _distinct_texts(docs: DataFrame, copies: DataFrame, doc_id: str) -> DataFrame:
    spare = maybe_broadcast(settle(copies.where("id <> rep").select(F.col("id").alias(doc_id))))
    return docs.join(spare, doc_id, "left_anti")


def near_duplicates(docs: DataFrame, doc_id: str = "article_id", text: str = "text", n: int = 5, similarity: float = 0.8, salt: int = 1_000) -> DataFrame:
    """`{doc_id}_a, {doc_id}_b` (a < b): all pairs with a similarity of `similarity` or more, copies included. Texts that are copies of each
    other are compared once, as one class, and the pairs of classes are given to their members at the end. A class of more than
    `salt` copies is dealt to several tasks."""
    docs = docs.where(F.col(text).isNotNull())
    copies = settle(_classes(docs, doc_id, text))
    pairs = similar_pairs(_distinct_texts(docs, copies, doc_id), doc_id, text, n, similarity).select("a", "b")
    of = lambda c: copies.select(F.col("rep").alias(c), F.col("id").alias(f"{c}_id"))
    wide = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_id", "a").alias("a"), F.coalesce("b_id", "b").alias("b"))
    full = docs.join(F.broadcast(copies.select("rep").distinct()) if copies.limit(200_001).count() <= 200_000 else copies.select("rep").distinct(), F.col(doc_id) == F.col("rep"), "left_semi")
    inside = copies.join(full.where(F.size(words(text)) >= n).select(F.col(doc_id).cast("bigint").alias("rep")), "rep", "left_semi")
    parts = F.ceil(F.col("n") / salt).cast("int")
    left = inside.select("rep", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    right = inside.select("rep", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    own = left.join(right, ["rep", "part"]).where("a < b").select("a", "b")
    both = wide.unionByName(own)
    return both.select(F.least("a", "b").alias(f"{doc_id}_a"), F.greatest("a", "b").alias(f"{doc_id}_b"))


def link_counts(docs: DataFrame, doc_id: str = "article_id", text: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """`{doc_id}, class_id, n_links`: each text's class of copies (the least id with that text) and with how many other classes it is
    similar. One row for each row with a non-null text, so groups of copies of any size stay as large as they are."""
    docs = docs.where(F.col(text).isNotNull())
    copies = settle(_classes(docs, doc_id, text))
    pairs = similar_pairs(_distinct_texts(docs, copies, doc_id), doc_id, text, n, similarity)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    ids = docs.select(F.col(doc_id).cast("bigint").alias("id")).join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id"))
    return ids.join(links, "class_id", "left").select(F.col("id").alias(doc_id), "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
