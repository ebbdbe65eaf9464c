"""Corpus scores: edit totals and error rate, character BLEU and chrF."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versefold.functions.scores import edit_counts, edit_counts_native, fscore, gram_stats, lcs_length, lcs_length_native
from versefold.functions.text import SPACE, normalize_target


def details(pairs: DataFrame, ref: str = "ref", pred: str = "pred", native: bool = False) -> DataFrame:
    """Add exact_match, edit_distance, substitutions, deletions, insertions, news_fscore. The
    native form stays in the JVM and is for short strings."""
    r, p = F.col(ref), F.col(pred)
    edits = (edit_counts_native if native else edit_counts)(r, p)
    lcs = (lcs_length_native if native else lcs_length)(r, p)
    out = pairs.withColumns({"__e": edits, "__l": lcs})
    parts = {k: F.col(f"__e.{k}") for k in ("substitutions", "deletions", "insertions")}
    return out.withColumns({"exact_match": r == p, "edit_distance": parts["substitutions"] + parts["deletions"] + parts["insertions"], **parts, "news_fscore": fscore(F.col("__l"), r, p)}).drop("__e", "__l")


def totals(rows: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """One row of corpus scores from details: the error rate is all edits over all reference
    characters (0 without any), the F-score a mean of rows. Without rows: nulls, no error."""
    chars = F.sum(F.length(ref)).cast("long")
    cer = F.when(chars == 0, 0.0).otherwise(F.sum("edit_distance") / chars)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("samples"), F.count_if("exact_match").alias("exact_matches"), (F.count_if("exact_match") / F.nullif(n, F.lit(0))).alias("exact_accuracy"), cer.alias("cer"), (1 - cer).alias("char_accuracy"), F.avg("news_fscore").alias("news_fscore"), chars.alias("ref_chars"), F.sum(F.length(pred)).cast("long").alias("pred_chars"), *(F.sum(c).cast("long").alias(c) for c in ("substitutions", "deletions", "insertions")))


def gram_counts(pairs: DataFrame, orders: int, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """(n, matches, ref_total, pred_total, pred_counted) by order: clipped matches of character
    n-grams within rows; pred_counted leaves out rows whose reference has none of the order.
    Rows are counted by themselves; only sums by order are shuffled."""
    rows = pairs.select(F.inline(gram_stats(orders)(F.col(ref), F.col(pred)))).where("in_ref > 0 or in_pred > 0")
    return rows.groupBy("n").agg(F.sum("matches").alias("matches"), F.sum("in_ref").alias("ref_total"), F.sum("in_pred").alias("pred_total"), F.sum(F.when(F.col("in_ref") > 0, F.col("in_pred")).otherwise(0)).alias("pred_counted"))


def lengths(pairs: DataFrame, ref: str = "ref", pred: str = "pred") -> tuple[int, int]:
    row = pairs.agg(F.sum(F.length(ref)).alias("r"), F.sum(F.length(pred)).alias("p")).first()
    return row["r"] or 0, row["p"] or 0


def bleu_of(grams: dict[int, tuple[int, int]], ref_len: int, pred_len: int, effective: bool = True, orders: int = 4) -> float:
    """BLEU from {order: (matches, total)} with exponential smoothing; effective: the mean is over
    the orders that the predictions reach."""
    if pred_len == 0 or not any(m for m, _ in grams.values()):
        return 0.0
    brevity = 1.0 if pred_len >= ref_len else math.exp(1 - ref_len / pred_len)
    smooth, logs = 1.0, []
    for n in range(1, orders + 1):
        matches, total = grams.get(n, (0, 0))
        if total == 0:
            break
        if matches == 0:
            smooth *= 2
        logs.append(math.log(100 * matches / total if matches else 100 / (smooth * total)))
    if not effective and len(logs) < orders:
        return 0.0
    return brevity * math.exp(sum(logs) / len(logs))


def char_bleu(pairs: DataFrame, effective: bool = True, **names: str) -> float:
    rows = gram_counts(pairs, 4, **names).collect()  # four rows
    return bleu_of({r["n"]: (r["matches"], r["pred_total"]) for r in rows}, *lengths(pairs, **names), effective)


def training_bleu(pairs: DataFrame, ref: str = "ref", pred: str = "pred") -> float:
    """BLEU as training reports it: of raw strings cut into characters, which are words but for white
    space (they stand apart already, so the standard tokenizing changes nothing), over all four
    orders: 0 where predictions don't reach one."""
    rows = pairs.select(*(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "").alias(c) for c in (ref, pred)))
    return char_bleu(rows, False, ref=ref, pred=pred)


def chrf_row(grams: DataFrame) -> DataFrame:
    """chrF2 from gram_counts of orders 1 to 6: precision and recall are means over the orders
    that both sides have."""
    both = grams.where("pred_counted > 0 and ref_total > 0")
    p, r = F.avg(F.col("matches") / F.col("pred_counted")), F.avg(F.col("matches") / F.col("ref_total"))
    return both.agg(F.coalesce(F.when(p + r == 0, 0.0).otherwise(100 * 5 * p * r / (4 * p + r)), F.lit(0.0)).alias("chrf2"))


def evaluation(pairs: DataFrame, ref: str, pred: str) -> dict[str, float | int]:
    """All scores of raw strings, strictly and without punctuation (names end in _no_punct)."""
    out: dict[str, float | int] = {}
    for suffix, ignore in (("", False), ("_no_punct", True)):
        rows = pairs.select(normalize_target(F.col(ref), ignore).alias("ref"), normalize_target(F.col(pred), ignore).alias("pred"))
        row = totals(details(rows)).first().asDict()
        row["bleu"] = char_bleu(rows)
        row["chrf2"] = chrf_row(gram_counts(rows, 6)).first()[0]
        out |= {k + suffix: v for k, v in row.items()}
    return out
