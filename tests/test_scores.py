"""Scores against plain definitions, goldens and properties."""

import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from versefold.functions import scores
from versefold.functions.text import normalize_target
from versefold.operators import metrics
from versefold.plans import catalog

GOLDEN = [("生死由來罷問程，", "生死猶來罷問經，", None), ("天地人", "天大仁人", (1, 0, 1)), ("天地人", "天人", (0, 1, 0)), ("", "", (0, 0, 0)), ("", "ab", (0, 0, 2)), ("ab", "", (0, 2, 0))]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("ref,pred,want", GOLDEN)
def test_edit_goldens(ref, pred, want):
    if want:
        assert scores.align(ref, pred) == want


@settings(max_examples=150, deadline=None)
@given(st.text("abc天", max_size=14), st.text("abc天", max_size=14))
def test_properties(a, b):
    s, d, i = scores.align(a, b)
    assert s + d + i == plain_distance(a, b)
    assert i - d == len(b) - len(a)
    assert scores.common_length(a, b) == scores.common_length(b, a) == plain_lcs(a, b)


@pytest.mark.parametrize("longest,alphabet", [(14, "abc天"), (130, "abcd"), (400, "ab天😀")])
def test_edit_counts_together(longest, alphabet):
    """Pairs aligned together, of like and unlike lengths and with nulls, have what each has alone."""
    rng = random.Random(longest)
    refs, preds = ([*("".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(90)), *more] for more in (["a" * 126, "a" * 127, "", None, "ab"], ["b" * 126, "b" * 126, "xyz", "q", None]))
    got = scores.edit_counts.func(pd.Series(refs), pd.Series(preds)).values.tolist()
    assert got == [[*scores.align(r or "", p or "")] for r, p in zip(refs, preds, strict=True)]
    assert not len(scores.edit_counts.func(pd.Series([], dtype=str), pd.Series([], dtype=str)))


def test_edit_counts_groups(monkeypatch):
    """Strings of usual lengths aren't aligned one at a time."""
    monkeypatch.setattr(scores, "align", None)
    assert scores.edit_counts.func(pd.Series(["abc", "ab" * 300]), pd.Series(["adcd", "b" * 700])).sum().tolist() == [301, 0, 101]


def test_name_pairs_spread(spark, sf):
    """Pairs of a small table are dealt out to all cores."""
    pairs = catalog.name_pairs(lambda name: catalog.table(spark, sf, name))
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_native_equals_python(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abcd", k=rng.randint(0, 12))), "".join(rng.choices("abcd", k=rng.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "ref string, pred string")
    out = df.select("ref", "pred", scores.edit_counts_native(df.ref, df.pred).alias("e"), scores.lcs_length_native(df.ref, df.pred).alias("l"), scores.edit_counts(df.ref, df.pred).alias("p"), scores.lcs_length(df.ref, df.pred).alias("q")).collect()
    for r in out:
        assert tuple(r.e) == tuple(r.p) == scores.align(r.ref, r.pred)
        assert r.l == r.q == plain_lcs(r.ref, r.pred)


def test_fscore_and_normalisation(spark):
    df = spark.createDataFrame([("天地", "天地", 1.0), ("天地", "人和", 0.0), ("天地人", "天人", 0.8), ("", "", 1.0)], "ref string, pred string, want double")
    for r in metrics.details(df).collect():
        assert r.news_fscore == pytest.approx(r.want)
    one = spark.createDataFrame([(" 天 地，\n",)], "t string")
    assert one.select(normalize_target(one.t).alias("a"), normalize_target(one.t, True).alias("b")).first() == ("天地，", "天地")


#: Four lines with five substitutions in 32 characters, and the corpus scores of these strings.
LINES = [("生死由來罷問程，", "生死猶來罷問程，"), ("因緣時節自然成。", "人緣時節自然成。"), ("山雲也有出山勢，", "山雲野有出山世，"), ("澗水終無投澗聲。", "澗水終無頭澗聲。")]


def test_corpus_goldens(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(LINES)], "row_idx long, ref string, pred string")
    out = metrics.evaluation(df, "ref", "pred")
    assert out["cer"] == pytest.approx(0.15625, abs=1e-12)
    assert out["bleu"] == pytest.approx(56.26157050354308, abs=1e-9)
    assert out["chrf2"] == pytest.approx(46.483134920634924, abs=1e-9)
    assert out["bleu_no_punct"] == pytest.approx(52.67872684612434, abs=1e-9)
    assert out["chrf2_no_punct"] == pytest.approx(42.37103174603175, abs=1e-9)
    assert (out["substitutions"], out["deletions"], out["insertions"], out["exact_matches"]) == (5, 0, 0, 0)


def test_bleu_smoothing():
    assert metrics.bleu_of({}, 3, 0) == 0
    assert metrics.bleu_of({1: (0, 3)}, 3, 3) == 0
    assert metrics.bleu_of({1: (2, 2), 2: (1, 1)}, 2, 2) == pytest.approx(100)
    assert metrics.bleu_of({1: (2, 2), 2: (1, 1)}, 2, 2, effective=False) == 0
    assert metrics.bleu_of({1: (1, 2), 2: (0, 1)}, 2, 2) == pytest.approx(math.exp((math.log(50) + math.log(50)) / 2))


def test_no_rows(spark):
    df = spark.createDataFrame([], "row_idx long, ref string, pred string")
    assert metrics.totals(metrics.details(df)).first().samples == 0
    assert metrics.char_bleu(df) == 0
