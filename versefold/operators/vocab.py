"""Vocabularies: frequency-ordered ids, coverage, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versefold.functions.text import detokenize_source, detokenize_target
from versefold.operators.ordering import dense_numbers
from versefold.session import stored

#: Ids of the special tokens.
PAD, UNK, FIRST, LAST = 0, 1, 2, 3
SOURCE_SPECIALS = ("<PAD>", "<UNK>", "<CLS>", "<SEP>")
TARGET_SPECIALS = ("<PAD>", "<UNK>", "<BOS>", "<EOS>")
#: Vocabularies up to so many tokens are sent to all executors; larger ones are joined by token.
BROADCAST_TOKENS = 500_000


def exploded(rows: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, pos, token), positions from 0."""
    return rows.select(key, F.posexplode(tokens).alias("pos", "token"))


def vocabulary(rows: DataFrame, tokens: Column, key: str = "row_idx", specials: tuple[str, ...] = SOURCE_SPECIALS) -> DataFrame:
    """(token, freq, id) of all tokens: ids after the specials by falling frequency, ties by first
    occurrence (key, then position). Tokens that are specials keep their special id.

    Key and position share a long (keys from 0 below 2^36, positions below 2^27; others are an
    error), so the counts are a hash aggregation with partial sums."""
    number = F.col(key).cast("long")
    fits = number.between(0, (1 << 36) - 1) & (F.col("pos") < 1 << 27)
    at = F.when(fits, F.shiftleft(number, 27) + F.col("pos")).otherwise(F.raise_error(F.lit("vocabulary: key or position out of range")).cast("long"))
    counts = exploded(rows, tokens, key).groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.min(at).alias("first"))
    plain = stored(counts.where(~F.col("token").isin(*specials)), "counts")
    block = F.struct((-F.col("freq")).alias("f"), F.shiftright("first", 27 + 12).alias("b"))
    return dense_numbers(plain, block, [F.col("first")], "rank").select("token", "freq", (F.col("rank") + len(specials) - 1).cast("int").alias("id"))


def with_specials(vocab: DataFrame, specials: tuple[str, ...] = SOURCE_SPECIALS) -> DataFrame:
    head = vocab.sparkSession.createDataFrame([(t, 0, i) for i, t in enumerate(specials)], "token string, freq long, id int")
    return head.unionByName(vocab)


def joined(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Left join on token; the vocabulary is broadcast only if it has been counted and is small."""
    few = vocab.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    return tokens.join(F.broadcast(vocab) if few else vocab, "token", "left")


def sizes(vocab: DataFrame, specials: tuple[str, ...] = SOURCE_SPECIALS) -> DataFrame:
    """One row: how many ids there are, specials included."""
    return vocab.agg((F.count(F.lit(1)) + len(specials)).alias("size"))


def histogram(rows: DataFrame, tokens: Column, vocab: DataFrame, key: str = "row_idx") -> DataFrame:
    """(token, n, known): counts of all tokens, and whether the vocabulary has them; the rows with
    known are the covered tokens, the others the missing ones."""
    counts = exploded(rows, tokens, key).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    some = joined(counts, vocab.select("token", F.lit(True).alias("known")))
    return some.select("token", "n", F.coalesce("known", F.lit(False)).alias("known"))


def coverage(rows: DataFrame, tokens: Column, vocab: DataFrame, key: str = "row_idx") -> DataFrame:
    """One row: tokens and distinct tokens, those in the vocabulary, those missing from it, and both
    percentages (0 of nothing)."""
    known = histogram(rows, tokens, vocab, key)
    hit = F.col("known")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = known.agg(total("n").alias("total_tokens"), total(F.when(hit, F.col("n"))).alias("covered_tokens"), total(F.when(~hit, F.col("n"))).alias("missing_tokens"), F.count(F.lit(1)).alias("total_unique"), total(hit.cast("long")).alias("covered_unique"))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b) * 100)
    return out.withColumns({"token_coverage": share("covered_tokens", "total_tokens"), "unique_coverage": share("covered_unique", "total_unique")})


def encoded(rows: DataFrame, tokens: Column, vocab: DataFrame, key: str = "row_idx", first: bool = True, last: bool = True) -> DataFrame:
    """(key, ids): unknown tokens as UNK, with the first and last special ids if asked for. Rows
    without tokens are kept."""
    each = joined(rows.select(key, F.posexplode_outer(tokens).alias("pos", "token")), vocab.select("token", "id"))
    pair = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id")))
    ids = F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["id"])
    out = each.groupBy(key).agg(ids.alias("ids"))
    parts = [F.array(F.lit(FIRST))] * first + [F.col("ids")] + [F.array(F.lit(LAST))] * last
    return out.select(key, F.concat(*parts).alias("ids"))


def decoded(rows: DataFrame, ids: Column, vocab: DataFrame, key: str = "row_idx", target: bool = False, skip: bool = True) -> DataFrame:
    """(key, text): padding, first and last ids are dropped wherever they stand, unknown ids are
    <UNK>; source text gets its spaces back."""
    kept = F.filter(ids, lambda i: ~i.isin(PAD, FIRST, LAST)) if skip else ids
    each = rows.select(key, F.posexplode_outer(kept).alias("pos", "id"))
    names = vocab.select("id", "token")
    few = vocab.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    named = each.join(F.broadcast(names) if few else names, "id", "left")
    pair = F.when(F.col("id").isNotNull(), F.struct("pos", F.coalesce("token", F.lit("<UNK>")).alias("t")))
    out = named.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["t"]).alias("t"))
    return out.select(key, (detokenize_target if target else detokenize_source)(F.col("t")).alias("text"))
