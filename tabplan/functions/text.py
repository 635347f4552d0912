"""Text similarity: normalised indel similarity and token-set ratio, from 0 to 100."""

from __future__ import annotations

import numpy as np

#: So few comparisons are made one by one; so many characters of texts are kept for further ones.
FEW, KEPT_CELLS = 16, 8_000_000


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word's worth of a's characters at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hits = row & where.get(c, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def indel_distance(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * common_subsequence(a, b)


def token_set_ratio(a: str, b: str) -> float:
    """100 if one's tokens hold the other's; else the best of three comparisons of what is shared and what isn't."""
    return token_sets_ratio(frozenset(a.split()), frozenset(b.split()))


def token_sets_ratio(x: frozenset[str], y: frozenset[str]) -> float:
    """token_set_ratio of texts whose tokens are known."""
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (len(shared) == len(x) or len(shared) == len(y)):
        return 100.0
    only_x, only_y = (" ".join(sorted(t - shared)) if len(t) - len(shared) > 1 else next(iter(t - shared), "") for t in (x, y))
    base = sum(map(len, shared)) + max(0, len(shared) - 1)
    gap = 1 if base else 0
    with_x, with_y = base + gap + len(only_x), base + gap + len(only_y)
    alike = lambda distance, total: 100.0 * (1 - distance / total) if total else 100.0
    best = alike(indel_distance(only_x, only_y), with_x + with_y)
    if base:
        best = max(best, alike(gap + len(only_x), base + with_x), alike(gap + len(only_y), base + with_y))
    return best


class Residues:
    """Texts as columns of character codes, the longest first, to compare one text with all of them at once."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        self.codes = {c: i + 1 for i, c in enumerate(sorted(set().union(*texts)))}
        ordered = [texts[i] for i in self.order]
        #: how many texts have a character at each place
        self.reach = np.searchsorted(-self.lengths[self.order], -np.arange(self.lengths.max(initial=0)), "left")
        self.columns = [np.array([self.codes[t[j]] for t in ordered[:n]], np.int32) for j, n in enumerate(self.reach)]

    def common(self, a: str, picked: np.ndarray) -> np.ndarray:
        """common_subsequence of a and each of the picked texts (a mask), 0 for others; a's characters by words of 64 bits."""
        chosen = np.flatnonzero(picked[self.order])
        n, words = len(chosen), -(-len(a) // 64)
        where = np.zeros((words, len(self.codes) + 1), np.uint64)
        for i, c in enumerate(a):
            if c in self.codes:
                where[i // 64, self.codes[c]] |= np.uint64(1 << i % 64)
        full = [np.uint64((1 << min(64, len(a) - 64 * w)) - 1) for w in range(words)]
        rows = [np.full(n, f, np.uint64) for f in full]
        for column, reach in zip(self.columns, self.reach, strict=True):
            codes = column if n == len(picked) else column[chosen[: np.searchsorted(chosen, reach)]]
            carry = None
            for w in range(words):
                row = rows[w][: len(codes)]
                hits = where[w][codes] & row
                added = row + hits
                if words > 1:  # what a word's sum can't hold goes to the next
                    over = added < row
                    if carry is not None:
                        added += carry
                        over |= added < carry
                    carry = over.astype(np.uint64)
                rows[w][: len(codes)] = added | (row - hits)
        out = np.zeros(len(picked), np.int64)
        out[self.order[chosen]] = len(a) - sum((np.bitwise_count(r & f).astype(np.int64) for r, f in zip(rows, full, strict=True)), np.zeros(n, np.int64))
        return out


class TokenSets:
    """Sets of tokens that others are compared with; sets that share the same tokens with one are compared together."""

    def __init__(self, sets: list[frozenset[str]]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        holders: dict[str, list[int]] = {}
        if len(sets) > FEW:
            for i, s in enumerate(sets):
                for t in s:
                    holders.setdefault(t, []).append(i)
        self.holders = {t: np.array(h, np.int64) for t, h in holders.items()}
        self.residues: dict[frozenset[str], tuple[np.ndarray, Residues]] = {}
        self.cells = 0

    def ratios(self, x: frozenset[str]) -> np.ndarray:
        """token_sets_ratio of x and each set."""
        n, held = len(self.sets), [t for t in x if t in self.holders]
        if n <= FEW or len(held) > 62:
            return np.array([token_sets_ratio(x, s) for s in self.sets], np.float64)
        out, code = np.zeros(n), np.zeros(n, np.int64)
        for j, t in enumerate(held):
            code[self.holders[t]] |= 1 << j
        for c in np.unique(code) if held else (0,):
            at = np.flatnonzero(code == c)
            out[at] = self._ratios(x, frozenset(t for j, t in enumerate(held) if c >> j & 1), at)
        return out

    def _ratios(self, x: frozenset[str], shared: frozenset[str], at: np.ndarray) -> np.ndarray | list[float] | float:
        """token_sets_ratio of x and the sets at some places, which all share these tokens with it."""
        if not x:
            return 0.0
        if shared and len(shared) == len(x):
            return 100.0
        if shared in self.residues:
            members, texts = self.residues[shared]
        else:
            members = np.arange(len(self.sets))
            for t in shared:
                members = np.intersect1d(members, self.holders[t], assume_unique=True)
            if len(at) <= FEW or 4 * len(at) < len(members):
                return [token_sets_ratio(x, self.sets[i]) for i in at]
            texts = Residues([" ".join(sorted(self.sets[i] - shared)) for i in members])
            self.cells += int(texts.lengths.sum())
            if self.cells > KEPT_CELLS:
                self.residues, self.cells = {}, int(texts.lengths.sum())
            self.residues[shared] = members, texts
        picked = np.zeros(len(members), bool)
        picked[np.searchsorted(members, at)] = True
        only_x = " ".join(sorted(x - shared))
        only_y = texts.lengths[picked]
        base = sum(map(len, shared)) + max(0, len(shared) - 1)
        gap = 1 if base else 0
        with_x, with_y = base + gap + len(only_x), base + gap + only_y
        best = 100.0 * (1 - (len(only_x) + only_y - 2 * texts.common(only_x, picked)[picked]) / (with_x + with_y))
        if not base:
            return np.where(only_y == 0, 0.0, best)
        best = np.maximum(best, np.maximum(100.0 * (1 - (gap + len(only_x)) / (base + with_x)), 100.0 * (1 - (gap + only_y) / (base + with_y))))
        return np.where(only_y == 0, 100.0, best)
