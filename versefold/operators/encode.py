"""Encoded examples: truncate, shift, pad to the batch, masks, greedy decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versefold.operators.ordering import dense_numbers
from versefold.operators.vocab import FIRST, LAST, PAD

IGNORED = -100


def truncated(ids: Column, most: int, keep_last: bool = False) -> Column:
    """At most `most` ids; keep_last puts the last special back at the end of a cut row, as
    evaluation does and training does not."""
    cut = F.slice(ids, 1, most)
    if not keep_last:
        return cut
    return F.when(F.size(ids) > most, F.concat(F.slice(ids, 1, most - 1), F.array(F.lit(LAST)))).otherwise(ids)


def shifted(ids: Column) -> tuple[Column, Column]:
    """(decoder input, labels): all but the last id, all but the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def examples(rows: DataFrame, source: str, target: str, most_source: int = 128, most_target: int = 128) -> DataFrame:
    decoder, labels = shifted(truncated(F.col(target), most_target))
    return rows.withColumns({"input_ids": truncated(F.col(source), most_source), "decoder_input_ids": decoder, "labels": labels})


def batched(rows: DataFrame, order: str, size: int, out: str = "batch") -> DataFrame:
    """Batches of consecutive rows by a dense order from 0."""
    return rows.withColumn(out, F.floor(F.col(order) / size).cast("long"))


def shuffled(rows: DataFrame, key: str, size: int, seed: int = 42, out: str = "batch") -> DataFrame:
    """Batches of rows in a seeded order of their keys' hashes, as training takes them; the order's
    number is `place`. No task sees all rows."""
    ticket = F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)
    mixed = rows.withColumn("__ticket", ticket)
    placed = dense_numbers(mixed, F.substring("__ticket", 1, 3), [F.col("__ticket"), F.col(key)], "place")
    return batched(placed.withColumn("place", F.col("place") - 1).drop("__ticket"), "place", size, out)


def causal_mask(n: Column) -> Column:
    """Square of n rows: row i sees places up to i (1), later ones are hidden (0)."""
    places = F.sequence(F.lit(0), n - 1)
    square = F.transform(places, lambda i: F.transform(places, lambda j: (j <= i).cast("int")))
    return F.when(n > 0, square).otherwise(F.array().cast("array<array<int>>"))


def padded_to(ids: Column, width: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), (width - F.size(ids)).cast("int")))


def collated(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Pad every batch to its longest row: inputs and decoder inputs with PAD, labels with -100;
    the mask is by length. Rows of a batch stay rows, so batches of any size fit."""
    w = Window.partitionBy(batch)
    source, target = F.max(F.size("input_ids")).over(w), F.max(F.size("decoder_input_ids")).over(w)
    sized = rows.withColumns({"__s": source, "__t": target})
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), (F.col("__s") - F.size("input_ids")).cast("int")))
    return sized.withColumns({"attention_mask": mask, "input_ids": padded_to(F.col("input_ids"), F.col("__s"), PAD), "decoder_input_ids": padded_to(F.col("decoder_input_ids"), F.col("__t"), PAD), "labels": padded_to(F.col("labels"), F.col("__t"), IGNORED)}).drop("__s", "__t")


def inference_mask(ids: Column) -> Column:
    """1 where an id isn't PAD."""
    return F.transform(ids, lambda i: (i != PAD).cast("int"))


def argmax(values: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


#: A model: (input ids, mask, decoder ids), all padded, to scores of the next token for each row.
Step = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def greedy(step: Step, inputs: np.ndarray, most_new: int) -> np.ndarray:
    """Batched greedy decoding: the first largest score wins, finished rows get PAD, and the loop
    ends when all rows have finished."""
    out = np.full((len(inputs), 1), FIRST, np.int64)
    done = np.zeros(len(inputs), bool)
    for _ in range(most_new):
        token = step(inputs, (inputs != PAD).astype(np.int64), out).argmax(1)
        token[done] = PAD
        out = np.column_stack([out, token])
        done |= token == LAST
        if done.all():
            break
    return out


def predicted(rows: DataFrame, ids: str, make: Callable[[], Step], most_new: int = 127, batch_size: int = 16) -> DataFrame:
    """Add prediction_ids. `make` loads the model once in each Python worker's call; rows go
    through it in Arrow batches cut to batch_size."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = make()
        for part in parts:
            out: list[list[int]] = []
            for k in range(0, len(part), batch_size):
                some = [list(x) for x in part.iloc[k : k + batch_size]]
                width = max(map(len, some), default=0)
                inputs = np.array([x + [PAD] * (width - len(x)) for x in some], np.int64).reshape(len(some), width)
                out += greedy(step, inputs, most_new).tolist()
            yield pd.Series(out)

    return rows.withColumn("prediction_ids", run(F.col(ids)))


def token_losses(rows: DataFrame, logits: str, labels: str) -> DataFrame:
    """Add nll_sum and n_tokens of a row: cross-entropy of its labels (-100 left out) under its
    rows of scores."""
    pairs = F.filter(F.arrays_zip(F.col(logits).alias("z"), F.col(labels).alias("y")), lambda p: p["y"] != IGNORED)
    loss = lambda p: F.array_max(p["z"]) + F.ln(F.aggregate(F.transform(p["z"], lambda x: F.exp(x - F.array_max(p["z"]))), F.lit(0.0), lambda a, x: a + x)) - F.element_at(p["z"], p["y"] + 1)
    return rows.withColumns({"nll_sum": F.aggregate(F.transform(pairs, loss), F.lit(0.0), lambda a, x: a + x), "n_tokens": F.size(pairs)})


def perplexity(rows: DataFrame) -> DataFrame:
    """One row: nll = sum of losses / number of tokens (micro average) and its exponential, and
    the plain mean of the rows' own averages (macro)."""
    nll = F.sum("nll_sum") / F.nullif(F.sum("n_tokens"), F.lit(0))
    return rows.agg(nll.alias("nll"), F.exp(nll).alias("perplexity"), F.avg(F.col("nll_sum") / F.nullif(F.col("n_tokens"), F.lit(0))).alias("mean_loss"), F.sum("n_tokens").alias("n_tokens"))


def mean_batch_loss(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """One row: the mean over batches of each one's average loss, as training reports it; without a
    batch it is an error."""
    each = rows.groupBy(batch).agg((F.sum("nll_sum") / F.nullif(F.sum("n_tokens"), F.lit(0))).alias("loss"))
    n = F.count(F.lit(1))
    return each.agg(F.when(n > 0, F.avg("loss")).otherwise(F.raise_error(F.lit("no batches")).cast("double")).alias("mean_batch_loss"), n.alias("n_batches"))
