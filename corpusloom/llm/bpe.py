"""Byte-level BPE without a tokenizer library: perfect hash for whole pieces, heap over linked bytes for the rest."""

import base64
import heapq

import numpy as np
import xxhash

#: White space as Unicode defines it, so that Java splits as the published pattern does.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The published splitting pattern of the byte-level vocabularies, in Java's notation.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a base64 token and its rank on each line. The rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys on n slots, one seed per bucket of about two keys."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 2)
        self.seeds = np.zeros(self.buckets, dtype=np.int64)
        self.keys: list[bytes] = [b""] * n
        self.ids = np.full(n, -1, dtype=np.int64)
        h = [xxhash.xxh3_128_intdigest(k) for k in keys]
        rows: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate(h):
            rows[(x & 0xFFFFFFFFFFFFFFFF) % self.buckets].append(i)
        free = bytearray(b"\x01") * n
        spare = n - 1
        for b in sorted(range(self.buckets), key=lambda b: -len(rows[b])):
            row = rows[b]
            if len(row) == 1:  # any free slot will do: the seed names it
                while not free[spare]:
                    spare -= 1
                slots = [spare]
                self.seeds[b] = -1 - spare
            else:
                seed = 0
                while row:
                    slots = [self._slot(h[i] >> 64, seed) for i in row]
                    if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                        break
                    seed += 1
                else:
                    continue
                self.seeds[b] = seed
            for i, s in zip(row, slots):
                free[s] = 0
                self.keys[s], self.ids[s] = keys[i], ranks[keys[i]]

    def _slot(self, high: int, seed: int) -> int:
        return ((high ^ (seed * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 17) % self.n

    def get(self, key: bytes) -> int:
        """The id of a key, -1 if it isn't in the vocabulary."""
        x = xxhash.xxh3_128_intdigest(key)
        seed = int(self.seeds[(x & 0xFFFFFFFFFFFFFFFF) % self.buckets])
        s = -1 - seed if seed < 0 else self._slot(x >> 64, seed)
        return int(self.ids[s]) if self.keys[s] == key else -1


class Encoder:
    """Encodes pieces. `known` keeps at most `keep` results, so memory stays bounded on any corpus."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000):
        self.ranks, self.keep = ranks, keep
        self.table = PerfectHash(ranks)
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            raw = text.encode("utf-8", "replace")
            whole = self.table.get(raw)
            ids = [whole] if whole >= 0 else self.merge(raw)
            if len(self.known) >= self.keep:
                self.known.clear()
            if len(text) <= 256:
                self.known[text] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Ids of the symbols that survive: a linked list of byte runs, the lowest-ranked merge first, leftmost among equals."""
        n, get = len(raw), self.ranks.get
        end = list(range(1, n + 1))  # symbol i covers raw[i:end[i]]
        left = list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            alive[j] = 0
            end[i] = stop
            if stop < n:
                left[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := left[i]) >= 0 and (r := get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out
