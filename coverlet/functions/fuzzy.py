"""String likeness after the public definitions of indel, partial and token-set ratios (0 to 100).

The longest common subsequence is found bit-parallel in Python integers (Hyyro, 2004), one step a character. The
weighted ratio follows the public description of its length rules; likeness with other libraries' results was not
measured here.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _common(_masks(a), (1 << len(a)) - 1, len(a), b)


def _common(masks: dict[str, int], full: int, n: int, b: str) -> int:
    free = full
    for c in b:
        hit = free & masks.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return n - free.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of its length of the longer one, or with a shorter stretch at an end."""
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(*sorted((a, b), key=len))


def _best_window(short: str, long: str) -> float:
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    masks, full, best = _masks(short), (1 << n) - 1, 0.0
    met = [0, *accumulate(c in masks for c in long)]
    for start in range(1 - n, len(long)):
        stop = min(start + n, len(long))
        start = max(0, start)
        # A common subsequence has no more letters than the window shares with the shorter text.
        if 200.0 * (met[stop] - met[start]) <= best * (n + stop - start):
            continue
        # A best window begins and ends with a letter of the shorter text, or is cut at an end of the longer one.
        if (stop == len(long) or long[stop - 1] in masks) and (start == 0 or stop - start == n or long[start] in masks):
            best = max(best, 200.0 * _common(masks, full, n, long[start:stop]) / (n + stop - start))
    return best


def _token_sets(a: str, b: str) -> tuple[str, str, str, bool]:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    return both, " ".join(sorted(x - y)), " ".join(sorted(y - x)), bool(x and y)


def token_set_ratio(a: str, b: str) -> float:
    both, only_a, only_b, real = _token_sets(a, b)
    if not real:
        return 0.0
    if both and not (only_a and only_b):
        return 100.0
    gap = 1 if both else 0
    whole_a, whole_b = len(both) + gap + len(only_a), len(both) + gap + len(only_b)
    # The sides differ in the rests only, so the common part adds itself to their common subsequence.
    best = 200.0 * (len(both) + gap + lcs_length(only_a, only_b)) / (whole_a + whole_b)
    if both:
        best = max(best, 200.0 * len(both) / (len(both) + whole_a), 200.0 * len(both) / (len(both) + whole_b))
    return best


class TokenSetRatio:
    """token_set_ratio of one text with many: its letters' places are found once.

    Common tokens become places that fit no letter, which leaves the rest's common subsequence as it is.
    """

    def __init__(self, a: str):
        self.words = sorted(set(a.split()))
        text = " ".join(self.words)
        self.masks, self.n, self.full = _masks(text), len(text), (1 << len(text)) - 1
        self.places, self.gaps, start = {}, {}, 0
        for w in self.words:
            # A token's place holds the space before it.
            self.gaps[w] = 1 << start - 1 if start else 0
            self.places[w] = ((1 << len(w)) - 1 << start) | self.gaps[w]
            start += len(w) + 1

    def __call__(self, b: str) -> float:
        y = set(b.split())
        if not (self.words and y):
            return 0.0
        both = self.places.keys() & y
        if both and (len(both) == len(self.words) or len(both) == len(y)):
            return 100.0
        kept = self.full - sum(map(self.places.__getitem__, both))
        if both:
            kept &= ~self.gaps[next(w for w in self.words if w not in both)]
        only_b = " ".join(sorted(y - both))
        gap, common = (1, sum(map(len, both)) + len(both) - 1) if both else (0, 0)
        free, full, get = self.full, self.full, self.masks.get
        for c in only_b:
            if hit := free & get(c, 0) & kept:
                free = ((free + hit) | (free - hit)) & full
        whole_a, whole_b = common + gap + kept.bit_count(), common + gap + len(only_b)
        best = 200.0 * (common + gap + self.n - free.bit_count()) / (whole_a + whole_b)
        if both:
            best = max(best, 200.0 * common / (common + whole_a), 200.0 * common / (common + whole_b))
        return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_token_ratio(a: str, b: str) -> float:
    """100 with a common token, else the partial ratio of the sorted tokens."""
    both, only_a, only_b, _ = _token_sets(a, b)
    return 100.0 if both else partial_ratio(only_a, only_b)


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    uneven = max(len(a), len(b)) / min(len(a), len(b))
    tokens = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if uneven < 1.5:
        return max(ratio(a, b), 0.95 * tokens)
    scale = 0.9 if uneven <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def _column(name: str):
    plain = globals()[name]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        score = lru_cache(1 << 14)(plain)
        return pd.Series([score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def partial_ratio_column(a, b):
    return _column("partial_ratio")(a, b)


def token_set_ratio_column(a, b):
    return _column("token_set_ratio")(a, b)
