"""Scores of one prediction against its reference: edit counts, LCS, F-score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDITS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("substitutions", "deletions", "insertions")])
#: Each count in a packed cell (distance, substitutions, deletions, insertions) is below it.
PACK = 1 << 15
#: Cells of an anti-diagonal of a group of pairs, about.
CELLS = 1 << 14
#: Kinds of packed cells of groups: type, bits of substitutions, longest strings.
LANES = ((np.uint16, 7, 126), (np.uint32, 15, 32_766))


def edit_counts_native(ref: Column, pred: Column) -> Column:
    """S, D and I of one shortest alignment, JVM-side; longer strings than 32,767 code points are an
    error (the Arrow form takes them, and is faster from some hundred on).

    A fold over the prediction keeps one row of packed cells. Ties are broken by distance alone:
    match or substitution first, then deletion (of a reference character), then insertion."""
    s, d, i = PACK**3 + PACK**2, PACK**3 + PACK, PACK**3 + 1
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    ref_chars, cost = chars(ref), lambda cell: F.shiftright(cell, 45)
    top = F.transform(F.sequence(F.lit(0), F.length(ref)), lambda k: k.cast("long") * d)

    def row(before: Column, c: Column) -> Column:
        first = F.array(F.element_at(before, 1) + i)
        cells = F.zip_with(F.zip_with(ref_chars, F.slice(before, F.lit(1), F.length(ref)), lambda r, diagonal: F.struct(r.alias("r"), diagonal.alias("g"))), F.slice(before, F.lit(2), F.length(ref)), lambda x, up: F.struct(x["r"].alias("r"), x["g"].alias("g"), up.alias("u")))

        def cell(done: Column, x: Column) -> Column:
            g = x["g"] + F.when(x["r"] == c, 0).otherwise(s)
            left, up = F.element_at(done, -1) + d, x["u"] + i
            best = F.when((cost(g) <= cost(left)) & (cost(g) <= cost(up)), g).when(cost(left) <= cost(up), left).otherwise(up)
            return F.concat(done, F.array(best))

        return F.aggregate(cells, first, cell)

    last = F.aggregate(chars(pred), top, row, lambda cells: F.element_at(cells, -1))
    last = F.when(F.greatest(F.length(ref), F.length(pred)) < PACK, last).otherwise(F.raise_error(F.lit("too long for edit_counts_native")).cast("long"))
    part = lambda k: F.shiftright(last, 15 * k).bitwiseAND(F.lit(PACK - 1)).cast("int")
    return F.struct(part(2).alias("substitutions"), part(1).alias("deletions"), part(0).alias("insertions"))


def align(ref: str, pred: str) -> tuple[int, int, int]:
    """S, D, I by anti-diagonals of the alignment table, each computed at once. A cell packs its
    distance, substitutions and deletions; insertions are what is left of the distance."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (ref, pred))
    n, m, back = len(a), len(b), b[::-1]
    one, sub, gone = 1 << 42, 1 << 21, 1
    before2 = before = np.zeros(n + 1, np.int64)
    for k in range(1, n + m + 1):
        now = np.zeros(n + 1, np.int64)
        lo, hi = max(1, k - m), min(n, k - 1)
        if lo <= hi:
            g = before2[lo - 1 : hi] + (a[lo - 1 : hi] != back[m - k + lo : m - k + hi + 1]) * (one + sub)
            left, up = before[lo - 1 : hi] + (one + gone), before[lo : hi + 1] + one
            g_cost, left_cost, up_cost = g >> 42, left >> 42, up >> 42
            rest = np.where(left_cost <= up_cost, left, up)
            now[lo : hi + 1] = np.where(g_cost <= np.minimum(left_cost, up_cost), g, rest)
        if k <= m:
            now[0] = k * one
        if k <= n:
            now[k] = k * (one + gone)
        before2, before = before, now
    last = int(before[n])
    distance, s, d = last >> 42, last >> 21 & 0x1FFFFF, last & 0x1FFFFF
    return s, d, distance - s - d


def like_lengths(refs: list[str], preds: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, a, back, n, m): pairs of about equal lengths together, in ascending order of n + m, as
    matrices of code points with a column for each pair. Predictions are turned round, so an
    anti-diagonal of all their tables is one slice of each matrix."""
    n, m = (np.array([*map(len, x)], np.int64) for x in (refs, preds))
    band = [np.log2(x + 6.0) * 2.5 // 1 for x in (n, m)]
    order = np.lexsort((n + m, *band))
    edges = np.flatnonzero(np.r_[True, np.any([b[order][1:] != b[order][:-1] for b in band], axis=0), True]) if len(order) else []
    for start, stop in zip(edges, edges[1:], strict=False):
        step = max(1, CELLS // (1 + int(np.minimum(n[order[start:stop]], m[order[start:stop]]).max())))
        for k in range(start, stop, step):
            rows = order[k : min(k + step, stop)]
            yield rows, code_points([refs[r] for r in rows], n[rows], False), code_points([preds[r] for r in rows], m[rows], True), n[rows], m[rows]


def code_points(strings: list[str], size: np.ndarray, turned: bool) -> np.ndarray:
    """A column of code points for each string, zeros where it is shorter than the longest."""
    out = np.zeros((int(size.max()), len(strings)), np.uint32)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[len(out) - 1 - at if turned else at, np.repeat(np.arange(len(strings)), size)] = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    return out


def alignments(a: np.ndarray, back: np.ndarray, n: np.ndarray, m: np.ndarray, kind: type, bits: int) -> np.ndarray:
    """S, D, I of all pairs of a group from like_lengths, as align has them. A cell packs its
    distance, two bits that rank the step (so that the least cell is the one align takes), and
    substitutions; lengths give the rest."""
    top, width, total = len(a), len(back), n + m
    one, sub, left, up = (kind(x) for x in (1 << bits + 2, (1 << bits + 2) + 1, (1 << bits + 2) + (1 << bits), (1 << bits + 2) + (2 << bits)))
    clean, last = kind(np.iinfo(kind).max ^ (3 << bits)), np.zeros(len(n), kind)
    before2, before, now = (np.zeros((top + 1, len(n)), kind) for _ in range(3))
    for k in range(1, top + width + 1):
        lo, hi = max(1, k - width), min(top, k - 1)
        if lo <= hi:
            g = np.multiply(a[lo - 1 : hi] != back[width - k + lo : width - k + hi + 1], sub, dtype=kind)
            g += before2[lo - 1 : hi]
            np.minimum(g, before[lo - 1 : hi] + left, out=g)
            np.minimum(g, before[lo : hi + 1] + up, out=g)
            np.bitwise_and(g, clean, out=now[lo : hi + 1])
        if k <= width:
            now[0] = kind(k) * one
        if k <= top:
            now[k] = kind(k) * one
        i, j = np.searchsorted(total, [k, k + 1])
        last[i:j] = now[n[i:j], np.arange(i, j)]
        before2, before, now = before, now, before2
    distance, s = (last >> kind(bits + 2)).astype(np.int64), (last & kind((1 << bits) - 1)).astype(np.int64)
    d = (distance - s - (m - n)) // 2
    return np.stack([s, d, distance - s - d], axis=1)


@F.pandas_udf(EDITS)
def edit_counts(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """S, D and I for strings of any length."""
    refs, preds = ([x or "" for x in c] for c in (ref, pred))
    out = np.zeros((len(refs), 3), np.int64)
    for rows, *group in like_lengths(refs, preds):
        longest = max(len(group[0]), len(group[1]))
        lane = next((x for x in LANES if longest <= x[2]), None)
        out[rows] = alignments(*group, *lane[:2]) if lane else [align(refs[k], preds[k]) for k in rows]
    return pd.DataFrame(out, columns=["substitutions", "deletions", "insertions"], dtype="int32")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of the table at a time."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([common_length(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def lcs_length_native(a: Column, b: Column) -> Column:
    """The same by nested folds, JVM-side; for short strings."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    left = chars(a)

    def row(before: Column, c: Column) -> Column:
        steps = F.zip_with(F.zip_with(left, before, lambda r, g: F.struct(r.alias("r"), g.alias("g"))), F.slice(before, F.lit(2), F.length(a)), lambda x, u: F.struct(x["r"].alias("r"), x["g"].alias("g"), u.alias("u")))
        steps = F.slice(steps, F.lit(1), F.length(a))
        return F.aggregate(steps, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.when(x["r"] == c, x["g"] + 1).otherwise(F.greatest(x["u"], F.element_at(done, -1))))))

    return F.aggregate(chars(b), F.array_repeat(F.lit(0), F.length(a) + 1), row, lambda cells: F.element_at(cells, -1))


def fscore(lcs: Column, ref: Column, pred: Column) -> Column:
    """2 LCS / (both lengths); 1 if both are empty."""
    total = F.length(ref) + F.length(pred)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs / total)


GRAMS = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("matches", "in_ref", "in_pred"))]))


def gram_stats(orders: int):
    """Column function: for each order the clipped matches and numbers of two strings' character
    n-grams. It needs nothing but the row, so no n-gram is ever shuffled."""

    def one(ref: str, pred: str) -> list[tuple[int, int, int, int]]:
        out = []
        for n in range(1, orders + 1):
            a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (ref, pred))
            out.append((n, (a & b).total(), a.total(), b.total()))
        return out

    @F.pandas_udf(GRAMS)
    def run(ref: pd.Series, pred: pd.Series) -> pd.Series:
        return pd.Series([one(r or "", p or "") for r, p in zip(ref, pred, strict=True)])

    return run
