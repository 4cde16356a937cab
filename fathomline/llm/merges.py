"""Exact BPE merging of many byte-level words at once, as numpy steps over words of equal length."""

from __future__ import annotations

import heapq

import numpy as np

_NONE = np.int32(2**31 - 1)
#: Words of more bytes are merged one by one.
LONG = 256


def byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ..."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


class MergeTable:
    """Merges the pair of lowest rank, leftmost first, until none is left; ``suffix`` marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "", dtype: str = "<u4"):
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int32)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(order), dtype=bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        self.ranks, self.keys, self.made = order[first].astype(np.int32), keys[order][first], made
        self.dtype = np.dtype(dtype)
        self._of: dict[int, int] | None = None  # ranks by pair, for long words

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The id bytes (``self.dtype``) of every word."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._long(w)
            else:
                groups.setdefault(len(w), []).append(i)
        for n, members in groups.items():
            step = max(1, (1 << 16) // max(n, 1))  # keeps the matrices in cache
            for at in range(0, len(members) if n else 0, step):
                self._group(words, members[at : at + step], n, out)
        return out

    def _long(self, word: bytes) -> bytes:
        """Ids of a long word by a heap of its pairs, in time that grows with its length (times its logarithm) only."""
        ids = self.inner[np.frombuffer(word, dtype=np.uint8)]
        ids[-1] = self.last[word[-1]]
        heap = [(r, i) for i, r in enumerate(self._rank(ids[:-1], ids[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        if self._of is None:
            self._of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank_of, made = self._of.get, self.made
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != r:  # an older pair stood here
                continue
            ids[i], ids[j], k = int(made[r]), -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank_of(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], dtype=self.dtype).tobytes()

    def _group(self, words: list[bytes], members: list[int], n: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([words[i] for i in members]), dtype=np.uint8).reshape(-1, n)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        who = np.array(members)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while len(who):
            n = ids.shape[1]
            rows = np.arange(len(who))
            at = rank.argmin(1) if n > 1 else np.zeros(len(who), dtype=np.int64)
            best = rank[rows, at] if n > 1 else np.full(len(who), _NONE)
            done = best == _NONE
            if done.any():
                flat, width = ids[done].astype(self.dtype).tobytes(), n * self.dtype.itemsize
                for k, i in enumerate(who[done]):
                    out[i] = flat[k * width : (k + 1) * width]
                go = ~done
                who, ids, rank, at, best = who[go], ids[go], rank[go], at[go], best[go]
                rows = np.arange(len(who))
            if not len(who):
                return
            cols = np.arange(n - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[rows, at] = self.made[best]
            cols = np.arange(n - 2)
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            for pair, ok in ((at - 1, at > 0), (at, at < n - 2)):
                r, p = rows[ok], pair[ok]
                rank[r, p] = self._rank(ids[r, p], ids[r, p + 1])
