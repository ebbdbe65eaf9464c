"""SimHash document fingerprints and the search for those within a Hamming radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versefold.llm.common import block_of, cut_points, n_parts, stored, table

BITS, LANE, RADIUS = 64, 21, 3
#: 64 bits go into longs of three lanes; lane j of long i counts bit 22 j + i.
LONGS = 22
ONES = 1 | 1 << LANE | 1 << 2 * LANE


def votes(term: Column, weight: Column) -> list[Column]:
    """Sums of one group's term weights for each bit that is set in a term's hash, three bits
    to a long, and the sum of all weights. A lane holds 2^21 - 1; texts over 200,000 terms are
    summed in more groups (see simhash)."""
    h = F.xxhash64(term)
    lanes = []
    for i in range(LONGS):
        bits = [F.shiftleft(F.shiftrightunsigned(h, LONGS * j + i).bitwiseAND(F.lit(1).cast("long")), LANE * j) for j in range(3) if LONGS * j + i < BITS]
        lanes.append(F.sum((sum(bits[1:], bits[0])) * weight).alias(f"v{i}"))
    return [*lanes, F.sum(weight).alias("all")]


def decided(total: Column = None) -> Column:
    """The fingerprint from summed votes: a bit is 1 if more than half of the weight set it."""
    total = F.col("all") if total is None else total
    out = F.lit(0).cast("long")
    for k in range(BITS):
        j, i = divmod(k, LONGS)
        out = out.bitwiseOR(F.shiftleft(F.when(F.col(f"s{i}_{j}") * 2 > total, 1).otherwise(0).cast("long"), k))
    return out


def simhash(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp): 64-bit SimHash of each row's words, lower-cased; every occurrence of a word
    votes with a weight by its length (code points less 2, from 1 to 8), so that short function
    words count little. Keys tell rows apart. Equal texts give equal fingerprints; texts without
    words give 0. Words go through one partial aggregation per task; only 23 sums per row and
    group of 200,000 words are shuffled, none of the text."""
    words = F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")
    each = texts.select(*keys, F.posexplode_outer(words).alias("at", "term")).where("term is null or term <> '' or at = 0")
    weight = F.when(F.coalesce("term", F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(8), F.length("term") - 2))).cast("long")
    part = each.groupBy(*keys, F.floor(F.col("at") / 200_000).alias("g")).agg(*votes(F.coalesce("term", F.lit("")), weight))
    sums = [F.sum(F.shiftrightunsigned(f"v{i}", LANE * j).bitwiseAND(F.lit((1 << LANE) - 1))).alias(f"s{i}_{j}") for j in range(3) for i in range(LONGS) if LONGS * j + i < BITS]
    return part.groupBy(*keys).agg(*sums, F.sum("all").alias("all")).select(*keys, decided().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of bits that agree, 0 to 1."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def permuted_tables(fp: Column, blocks: int, radius: int) -> Column:
    """One (table, key) per choice of blocks - radius blocks: the chosen blocks moved to the
    front. Two fingerprints within the radius differ in at most `radius` blocks, so they agree
    on the key of at least one table."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    rows = []
    for n, kept in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(0).cast("long")
        for i in kept:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(block[i])
        rows.append(F.struct(F.lit(n).alias("table"), key.alias("key")))
    return F.explode(F.array(*rows))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (query_fp, fp, distance, n) with distance <= radius, from distinct fingerprints.

    queries: column fp. prints: fp and n (rows that have it). Key width grows with the number
    of fingerprints (16 bits up to a million, then 25, 32 and 38), so candidate lists stay
    short. Exact: no table or bucket is capped."""
    n = prints.count()
    blocks = radius + 1 + (n > 1 << 20) + (n > 1 << 26) + (n > 1 << 32)
    dealt = lambda df, *more: df.select("fp", *more, permuted_tables(F.col("fp"), blocks, radius).alias("t"))
    q = dealt(queries.select("fp").distinct()).select(F.col("fp").alias("query_fp"), "t")
    d = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    hits = q.join(dealt(prints, "n"), "t").where(d <= radius)
    return hits.select("query_fp", "fp", d.cast("int").alias("distance"), "n").distinct()


def with_next(rows: DataFrame, value: str, cuts: list[int]) -> DataFrame:
    """Add next_<value>: that of the next row by descending doc_id (ties by `tie`, null ids
    last), for the last row that of the first. Rows are cut into ranges of doc_id; a row at a
    cut also goes to the range above, and the largest to the lowest, as the one to look ahead
    to. So each value is shuffled once and no range is larger than its share."""
    kept, own = rows.columns, F.col("own")
    rows = rows.withColumn("own", block_of(F.col("doc_id"), cuts))
    pair = lambda b, k: F.struct(b.cast("int").alias("b"), F.lit(k).alias("k"))
    if cuts:
        at_cut = F.coalesce(F.try_element_at(F.lit(cuts), own + 1) == F.col("doc_id"), F.lit(False))
        ahead = F.when(at_cut & (own < len(cuts) - 1), F.array(pair(own + 1, 1))).when(at_cut, F.array(pair(F.lit(0), 2)))
    else:
        ahead = F.array(pair(F.lit(0), 2))
    dealt = rows.withColumn("p", F.explode(F.concat(F.array(pair(own, 0)), F.coalesce(ahead, F.array().cast("array<struct<b:int,k:int>>"))))).select(*kept, "p.b", "p.k")
    w = Window.partitionBy("b").orderBy("k", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.withColumns({f"next_{value}": F.lead(value).over(w), "row": F.row_number().over(w)}).where("k = 0").drop("k")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints and those of their edited texts. Also, for ids divisible by
    50, how many documents have a fingerprint within 3 bits (itself included).

    Null texts are empty. Rows that share an id, or have none, follow one another by text hash (null
    ids come last); repeated rows give a row each; a single row is its own next one; an empty table
    gives no rows. Very long texts vote in groups of 200,000 words. Extra columns aren't looked at."""
    source = table(spark, sf_dir, "documents")
    cuts = cut_points(source, "doc_id", n_parts(source, 1 << 20))
    docs = source.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = with_next(docs, "text", cuts)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    row_id = F.shiftleft(F.col("b").cast("long"), 36) + F.col("row") * 2
    version = lambda k, said: F.struct(F.lit(k).alias("edit"), F.coalesce(said, F.lit("")).alias("words"))
    two = F.array(version(0, F.col("text")), version(1, edited))
    both = rows.select("doc_id", "tie", row_id.alias("id"), n.cast("long").alias("n_chars"), F.inline(two))
    both = both.withColumns({"id": F.col("id") + F.col("edit"), "sha": F.when(F.col("edit") == 1, F.sha2(F.col("words").cast("binary"), 256))}).drop("edit")
    prints = simhash(both, ["id", "doc_id", "tie", "n_chars", "sha"], "words")
    own = F.col("sha").isNull()
    pair = prints.groupBy(F.shiftrightunsigned("id", 1).alias("id"), "doc_id", "tie", "n_chars").agg(F.max("sha").alias("edited_sha256"), F.max(F.when(own, F.col("fp"))).alias("fp"), F.max(F.when(~own, F.col("fp"))).alias("efp"))
    pair = stored(pair.drop("id"), "prints")
    ahead = with_next(pair, "fp", cuts)
    counted = pair.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    asks = pair.where(F.col("doc_id") % 50 == 0)
    near = within_radius(asks, counted).groupBy("query_fp").agg(F.sum("n").alias("n_within"))
    out = ahead.join(near, (ahead["fp"] == near["query_fp"]) & (ahead["doc_id"] % 50 == 0), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within")
