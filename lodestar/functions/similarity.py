"""Pairwise string and vector similarity: built-in expressions where they exist, Arrow UDFs where they don't."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Common tokens over the smaller set; 0 if it is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def ratio_of(a: Column, b: Column) -> Column:
    """Smaller over larger; 1 for two zeros."""
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters if it is above 0.7."""
    s, prefix = jaro(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return s + 0.1 * prefix * (1 - s) if s > 0.7 else s


def damerau(a: str, b: str) -> int:
    """Edits with transpositions of neighbours that may be edited further."""
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    d = np.full((len(a) + 2, len(b) + 2), far)
    d[1:, 1], d[1, 1:] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, n = seen.get(b[j - 1], 0), last
            same = a[i - 1] == b[j - 1]
            if same:
                last = j
            d[i + 1, j + 1] = min(d[i, j] + (not same), d[i + 1, j] + 1, d[i, j + 1] + 1, d[k, n] + i - k - 1 + 1 + j - n - 1)
        seen[a[i - 1]] = i
    return int(d[-1, -1])


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points by place and word (0 after the end), and lengths."""
    size = np.array([len(w) for w in words], np.int64)
    return np.array(words, f"U{max(1, size.max())}").view(np.uint32).reshape(len(words), -1).T, size


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many characters both columns of code points begin with."""
    n = min(len(x), len(y))
    return np.logical_and.accumulate((x[:n] == y[:n]) & (x[:n] > 0), axis=0).sum(0)


def _paired(a: list[str], b: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of both, and which of them stand in a and in b."""
    at: dict[str, int] = {}
    i, j = (np.fromiter((at.setdefault(w, len(at)) for w in x), np.int64, len(x)) for x in (a, b))
    return list(at), i, j


def affixes_all(a: list[str], b: list[str]) -> pd.DataFrame:
    """How many characters each pair begins with and ends with in common. A character 0 is moved up to one that no text has."""
    words, i, j = _paired([w.replace("\0", "\U0010ffff") for w in a], [w.replace("\0", "\U0010ffff") for w in b])
    sides = (_characters(words or [""])[0], _characters([w[::-1] for w in words] or [""])[0])
    return pd.DataFrame({k: _alike(x[:, i], x[:, j]).astype(np.int32) for k, x in zip(("prefix", "suffix"), sides, strict=True)})


class _Bits:
    """Distinct words of up to 64 characters: their codes by place, and for each code the places that have it as bits. Code 0 stands after the end and has none."""

    def __init__(self, words: list[str]) -> None:
        points, self.size = _characters(words or [""])
        points = np.where(np.arange(len(points))[:, None] < self.size, points.astype(np.int64) + 1, 0)
        known = np.zeros(int(points.max(initial=0)) + 1, bool)
        known[points] = known[0] = True
        self.codes, self.n = (np.cumsum(known) - 1)[points], len(self.size)
        masks = np.zeros((int(known.sum()), self.n), np.uint64)
        for i, row in enumerate(self.codes):
            masks[row, np.arange(self.n)] |= np.uint64(1 << i)
        masks[0] = 0
        self.masks = masks.reshape(-1)
        self.full = np.array([(1 << int(n)) - 1 for n in self.size], np.uint64)

    def passes(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | int = 0, steps: int | None = None) -> Iterator[np.ndarray]:
        """The common subsequence of each word a with the characters of b from start on, after one of them, two, and so on."""
        row, last = self.full[a], len(self.codes) - 1
        for k in range(len(self.codes) if steps is None else steps):
            code = self.codes[k][b] if isinstance(start, int) else np.where(start + k <= last, self.codes[np.minimum(start + k, last), b], 0)
            hit = row & self.masks[code * self.n + a]
            row = (row + hit) | (row - hit)
            yield self.size[a] - np.bitwise_count(row & self.full[a])

    def lcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for out in self.passes(a, b, steps=int(self.size[b].max(initial=0))):
            pass
        return out


def _by_length(a: list[str], b: list[str], fast: Callable[[list[str], list[str]], np.ndarray], slow: Callable[[str, str], float]) -> np.ndarray:
    """fast over all pairs of words of up to 64 characters, slow over each other pair."""
    short = np.fromiter((len(x) <= 64 and len(y) <= 64 for x, y in zip(a, b, strict=True)), bool, len(a))
    if short.all():
        return fast(a, b)
    out, at = np.zeros(len(a)), np.flatnonzero(short)
    out[at] = fast([a[k] for k in at], [b[k] for k in at])
    for k in np.flatnonzero(~short):
        out[k] = slow(a[k], b[k])
    return out


def lcs_all(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of many pairs."""

    def fast(a: list[str], b: list[str]) -> np.ndarray:
        words, i, j = _paired(a, b)
        return _Bits(words).lcs(i, j)

    return _by_length(a, b, fast, lcs).astype(np.int64)


def partial_all(a: list[str], b: list[str]) -> np.ndarray:
    """``partial_ratio`` of many pairs."""

    def fast(a: list[str], b: list[str]) -> np.ndarray:
        words, i, j = _paired(a, b)
        forward, backward = _Bits(words), _Bits([w[::-1] for w in words])
        size = forward.size
        best = np.where((size[i] == 0) | (size[j] == 0), (i == j).astype(float), 0.0)
        swap = size[i] > size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        some = np.flatnonzero(size[i] > 0)
        # of equal lengths both ways round
        even = some[size[i[some]] == size[j[some]]]
        pair, x, y = (np.concatenate(z) for z in ((some, even), (i[some], j[even]), (j[some], i[even])))
        n = size[x]
        found = np.zeros(len(pair))
        for bits in (forward, backward):
            for k, m in enumerate(bits.passes(x, y, steps=max(0, int(n.max(initial=0)) - 1)), 1):
                np.maximum(found, np.where(k < n, 2 * m / (n + k), 0.0), out=found)
        np.maximum.at(best, pair, found)
        # each stretch of the shorter word's length, those of a length together
        order = np.argsort(n, kind="stable")
        for part in np.array_split(order, np.flatnonzero(np.diff(n[order])) + 1):
            if len(part):
                length, places = int(n[part[0]]), size[y[part]] - n[part] + 1
                p = np.repeat(part, places)
                k = np.arange(len(p)) - np.repeat(np.cumsum(places) - places, places)
                for m in forward.passes(x[p], y[p], k, length):
                    pass
                np.maximum.at(best, pair[p], 2 * m / (2 * length))
        return best

    return _by_length(a, b, fast, partial_ratio)


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs."""

    def fast(a: list[str], b: list[str]) -> np.ndarray:
        words, i, j = _paired(a, b)
        bits = _Bits(words)
        na, nb, one = bits.size[i], bits.size[j], np.uint64(1)
        reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
        hits, used = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        low = lambda k: np.where(k >= 64, ~np.uint64(0), (one << np.minimum(k, 63).astype(np.uint64)) - one)
        for k in range(int(na.max(initial=0))):
            window = low(np.maximum(k + reach + 1, 0)) & ~low(np.maximum(k - reach, 0))
            free = bits.masks[bits.codes[k][i] * bits.n + j] & window & ~used
            used |= free & (~free + one)
            hits |= (free != 0).astype(np.uint64) << np.uint64(k)
        m, moved = np.bitwise_count(hits).astype(np.int64), np.zeros(len(a), np.int64)
        x, y = hits, used
        for k in range(int(m.max(initial=0))):
            p, q = (np.minimum(np.bitwise_count((z & (~z + one)) - one), len(bits.codes) - 1).astype(np.int64) for z in (x, y))
            moved += (k < m) & (bits.codes[p, i] != bits.codes[q, j])
            x, y = x & (x - one), y & (y - one)
        moved //= 2
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(m > 0, (m / na + m / nb + (m - moved) / m) / 3, ((na == 0) | (nb == 0)) & (i == j))
        head = bits.codes[:4]
        prefix = np.logical_and.accumulate((head[:, i] == head[:, j]) & (head[:, i] > 0), axis=0).sum(0)
        return np.where(s > 0.7, s + 0.1 * prefix * (1 - s), s)

    return _by_length(a, b, fast, jaro_winkler)


def damerau_all(a: list[str], b: list[str]) -> np.ndarray:
    """``damerau`` of many pairs: what both begin or end with costs nothing, the rest row by row of the table, for all of them at once. Pairs of a length go together."""
    if a:
        words, i, j = _paired(a, b)
        cut = lambda ws: _alike(*(_characters(ws)[0][:, k] for k in (i, j))).tolist()
        heads = cut(words)
        tails = cut([w[::-1] for w in words])
        tails = [min(t, len(x) - h, len(y) - h) for x, y, h, t in zip(a, b, heads, tails, strict=True)]
        a, b = ([x[h : len(x) - t] for x, h, t in zip(z, heads, tails, strict=True)] for z in (a, b))
    out, order = np.zeros(len(a), np.int32), sorted(range(len(a)), key=lambda i: len(a[i]) + len(b[i]))
    start = 0
    while start < len(order):
        # about 1,500,000 cells at once
        end, cells = start, 0
        while end < len(order) and (end == start or cells < 1_500_000):
            cells += (len(a[order[end]]) + 2) * (len(b[order[end]]) + 2)
            end += 1
        at = order[start:end]
        out[at], start = _damerau([a[i] for i in at], [b[i] for i in at]), end
    return out


def _damerau(a: list[str], b: list[str]) -> np.ndarray:
    (x, na), (y, nb), m = _characters(a), _characters(b), len(a)
    wide, all_ = len(y) + 2, np.arange(m, dtype=np.int32)
    kind = np.int16 if len(x) + len(y) < 8000 else np.int32
    rows, columns = np.arange(-1, len(x) + 1, dtype=kind), np.arange(-1, len(y) + 1, dtype=kind)
    d = np.full((2, wide, m), len(x) + len(y), kind)
    d[0, 1:] = columns[1:, None]
    # the whole table is kept less its row and column, so that what lies between two transposed characters needs no more than a constant
    kept = np.empty((len(x) + 2, wide, m), kind)
    kept[0], kept[1, 0], kept[1, 1:] = len(x) + len(y), len(x) + len(y), 0
    flat, j = kept.reshape(-1), columns[2:, None]
    place = np.arange(1, len(y) + 1, dtype=np.int32)[:, None] * m
    seen = np.zeros((len(y), m), np.int32) + all_  # where the last row with the character of each column begins
    out, end = np.zeros(m, np.int32), nb + 1
    out[na == 0] = nb[na == 0]
    for i in range(1, len(x) + 1):
        above, row = d[(i - 1) % 2], d[i % 2]
        same = y == x[i - 1]
        last = place * same  # the last column before, with the character of this row
        for k in range(1, len(last)):
            np.maximum(last[k], last[k - 1], out=last[k])
        from_ = seen.copy()
        from_[1:] += last[:-1]
        best = flat.take(from_)
        best += rows[i] + (j - kind(2))
        np.minimum(best, above[1:-1] + ~same, out=best)
        np.minimum(best, above[2:] + kind(1), out=best)
        row[0], row[1] = len(x) + len(y), i
        for k in range(len(best)):
            np.minimum(best[k], row[k + 1] + kind(1), out=row[k + 2])
        np.subtract(row, columns[:, None] + rows[i + 1], out=kept[i + 1])
        np.copyto(seen, all_ + i * wide * m, where=same)
        at = na == i
        out[at] = row[end[at], all_[at]]
    return out


def _places(a: str) -> dict[str, int]:
    """For each character the places where a has it, as bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def _common(where: dict[str, int], n: int, b: str) -> int:
    row = full = (1 << n) - 1
    get = where.get
    for c in b:
        hit = row & get(c, 0)
        row = (row + hit | row - hit) & full
    return n - row.bit_count()


def _passes(a: str, b: str) -> list[int]:
    """``lcs`` of a with each beginning of b."""
    where, out = _places(a), []
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
        out.append(len(a) - row.bit_count())
    return out


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    return _common(_places(a), len(a), b)


def indel(a: str, b: str) -> float:
    """2 x common subsequence over both lengths; 1 for two empty strings."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ``indel`` of the shorter string against stretches of the other: of its length, and shorter ones at either end."""
    if not a or not b:
        return float(a == b)
    if len(a) == len(b):
        return max(_stretches(a, b), _stretches(b, a))
    return _stretches(*sorted((a, b), key=len))


def _stretches(a: str, b: str) -> float:
    """The best of a against stretches of b, which is at least as long. Those at an end come from one pass each, a value after each character."""
    n = len(a)
    begins, ends = _passes(a, b[: n - 1]), _passes(a[::-1], b[::-1][: n - 1])
    best = max((2 * m / (n + k) for found in (begins, ends) for k, m in enumerate(found, 1)), default=0.0)
    where = _places(a)
    return max(best, max(2 * _common(where, n, b[k : k + n]) for k in range(len(b) - n + 1)) / (2 * n))


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the common tokens alone and with the rest of each side."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    return max(indel(both, left), indel(both, right), indel(left, right)) if both else indel(left, right)


def partial_tokens(a: str, b: str) -> float:
    """1 for a common token, else the best partial ratio of sorted tokens, all or those of one side alone."""
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 1.0
    return max(partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))), partial_ratio(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain ratio and token ratios x 0.95; of lengths 1.5 apart or more, partial ratios x 0.9 (x 0.6 over 8) take their place. 0 for an empty string."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return max(indel(a, b), 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if apart <= 8 else 0.6
    return max(indel(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_tokens(a, b))


def metaphone(word: str) -> str:
    """A short consonant code of a Latin word: digraphs first, then letters by sound, vowels only in front, no repeats."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    for a, b in (("PH", "F"), ("SCH", "SK"), ("SH", "X"), ("CH", "X"), ("TH", "0"), ("CK", "K"), ("WH", "W"), ("KN", "N"), ("WR", "R"), ("GH", ""), ("DG", "J"), ("QU", "KW")):
        w = w.replace(a, b)
    sounds = str.maketrans({"B": "B", "C": "K", "D": "T", "G": "K", "Q": "K", "V": "F", "Z": "S", "H": "", "Y": "", "W": ""})
    out = ""
    for i, c in enumerate(w):
        s = "S" if c == "C" and w[i + 1 : i + 2] in ("E", "I", "Y") else ("" if i and c in "AEIOU" else c.translate(sounds) if c not in "AEIOU" else c)
        out += s if not out.endswith(s) or not s else ""
    return out


def ratios_all(a: list[str], b: list[str]) -> pd.DataFrame:
    """indel, token_sort, token_set, partial, weighted, lcs, metaphone_equal of many pairs, all of them at once. What each name has is found once."""
    words, i, j = _paired(a, b)
    size = np.array([len(w) for w in words] or [0])
    tokens = [w.split() for w in words]
    ordered, sets, codes = [" ".join(sorted(t)) for t in tokens], [frozenset(t) for t in tokens], np.array([metaphone(w) for w in words] or [""])
    n, m = size[i], size[j]

    def over(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(n + m > 0, 2 * common / np.maximum(1, n + m), 1.0)

    common = lcs_all(a, b)
    plain = over(common, n, m)
    x, y = [ordered[k] for k in i], [ordered[k] for k in j]
    length = lambda ws: np.fromiter(map(len, ws), np.int64, len(ws))
    by_sort = over(lcs_all(x, y), length(x), length(y))
    # token_set: what both have is in front of either side, so it is part of every longest common subsequence
    both = [sets[p] & sets[q] for p, q in zip(i, j, strict=True)]
    left, right = ([" ".join(sorted(sets[p] - c)) for p, c in zip(k, both, strict=True)] for k in (i, j))
    shared = np.array([sum(map(len, c)) + max(0, len(c) - 1) for c in both], np.int64)
    some = np.array([bool(c) for c in both], bool)
    nl, nr = length(left), length(right)
    gap_l, gap_r = some & (nl > 0), some & (nr > 0)
    whole_l, whole_r = shared + gap_l + nl, shared + gap_r + nr
    rest = over(shared + (gap_l & gap_r) + lcs_all(left, right), whole_l, whole_r)
    by_set = np.where(some, np.maximum(np.maximum(over(shared, shared, whole_l), over(shared, shared, whole_r)), rest), rest)
    part = partial_all(a, b)
    known = (n > 0) & (m > 0)
    apart = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    weight = np.maximum(np.maximum(plain, 0.95 * by_sort), 0.95 * by_set)
    far = np.flatnonzero(known & (apart >= 1.5))
    if len(far):
        alike = np.where(some[far], 1.0, 0.0)
        none = far[~some[far]]
        each = lambda z, k: [" ".join(sorted(sets[q])) for q in z[k]]
        alike[~some[far]] = np.maximum(partial_all([x[k] for k in none], [y[k] for k in none]), partial_all(each(i, none), each(j, none)))
        scale = np.where(apart[far] <= 8, 0.9, 0.6)
        weight[far] = np.maximum(np.maximum(plain[far], scale * part[far]), 0.95 * scale * alike)
    columns = {"indel": plain, "token_sort": by_sort, "token_set": by_set, "partial": part, "weighted": np.where(known, weight, 0.0), "lcs": common / np.maximum(1, np.maximum(n, m))}
    return pd.DataFrame(columns).assign(metaphone_equal=known & (codes[i] == codes[j]))


def batch_udf(f: Callable, kind: T.DataType) -> Callable[[Column, Column], Column]:
    """f over two lists of strings for each Arrow batch; null counts as ''."""

    def run(batches):
        for a, b in batches:
            found = f([x or "" for x in a], [y or "" for y in b])
            yield found if isinstance(found, pd.DataFrame) else pd.Series(found)

    result = pd.DataFrame if isinstance(kind, T.StructType) else pd.Series
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[result]}
    return F.pandas_udf(run, kind)


def arrow_udf(f: Callable, kind: T.DataType) -> Callable[[Column, Column], Column]:
    """f over two string columns in Arrow batches; null counts as ''."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run
