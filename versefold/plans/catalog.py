"""The registered queries, on the shared test tables, and their DuckDB SQL.

Documents stand in for the corpus (lang for the genre), user and assistant turns for references
and predictions, part names for short strings, pages for fetched pages, events for progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versefold import config
from versefold.functions import scores, text, urls
from versefold.operators import collect, encode, metrics, ordering, sets, split, vocab
from versefold.session import ship, spread, stored
from versefold.sources import pages as page_source
from versefold.sources import pairs as pair_source

SPACE = text.SPACE
quoted = lambda s: "'" + s.replace("'", "''") + "'"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(ship(spark), sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def norm_sql(column: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(coalesce({column}, '')), {quoted(SPACE + '+')}, ' ', 'g'), ' ')"


def tokens_sql(column: str) -> str:
    s = norm_sql(column)
    for marks in (text.ASCII_MARKS, text.CJK_MARKS):
        s = f"regexp_replace({s}, {quoted('(' + marks + ')')}, ' \\1 ', 'g')"
    return f"list_filter(regexp_split_to_array({s}, ' +'), lambda t: t <> '')"


def exploded_sql(name: str, key: str) -> str:
    return f"SELECT {key}, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM (SELECT {key}, {tokens_sql('text')} AS toks FROM {name})"


VOCAB_SQL = f"""
voc AS (SELECT token, count(*) AS freq, CAST(3 + row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 100000000 + pos)) AS INTEGER) AS id
        FROM ({exploded_sql("documents", "doc_id")}) WHERE token NOT IN ('<PAD>', '<UNK>', '<CLS>', '<SEP>') GROUP BY token)"""


def documents_vocabulary(t) -> DataFrame:
    return vocab.vocabulary(spread(t("documents").select("doc_id", "text")), text.tokenize_source(F.col("text")), "doc_id")


def stored_vocabulary(t) -> DataFrame:
    """Written once, as it is counted and then joined."""
    return stored(documents_vocabulary(t), "vocabulary")


# --- text, tokens, vocabulary -------------------------------------------------------------


@query(f"WITH {VOCAB_SQL} SELECT token, freq, id FROM voc")
def vocab_build(t) -> DataFrame:
    return documents_vocabulary(t)


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5 FROM documents")
def normalize_text(t) -> DataFrame:
    return spread(t("documents").select("doc_id", "text")).select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("norm_md5"))


@query(f"SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents)")
def tokenize_source(t) -> DataFrame:
    toks = text.tokenize_source(F.col("text"))
    return spread(t("documents").select("doc_id", "text")).select("doc_id", toks.alias("toks")).select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_distinct"))


@query(f"SELECT token, count(*) AS freq FROM (SELECT unnest(string_split(replace({norm_sql('text')}, ' ', ''), '')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def tokenize_target(t) -> DataFrame:
    return spread(t("documents").select("doc_id", "text")).select(F.explode(text.tokenize_target(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


@query(f"SELECT item_id, regexp_replace(regexp_replace(nfc_normalize(text), {quoted(SPACE)}, '', 'g'), {quoted(text.ALL_MARKS)}, '', 'g') AS plain FROM benchmark")
def normalize_target(t) -> DataFrame:
    return t("benchmark").select("item_id", text.normalize_target(F.col("text"), True).alias("plain"))


@query(f"""WITH {VOCAB_SQL}, n AS (SELECT token, count(*) AS n FROM ({exploded_sql("benchmark", "item_id")}) GROUP BY token)
SELECT CAST(sum(n) AS BIGINT) AS total_tokens, CAST(coalesce(sum(n) FILTER (v.token IS NOT NULL), 0) AS BIGINT) AS covered_tokens, CAST(coalesce(sum(n) FILTER (v.token IS NULL), 0) AS BIGINT) AS missing_tokens, count(*) AS total_unique, count(v.token) AS covered_unique,
 round(coalesce(sum(n) FILTER (v.token IS NOT NULL), 0) / sum(n) * 100, 6) AS token_coverage, round(count(v.token) / count(*) * 100, 6) AS unique_coverage FROM n LEFT JOIN voc v ON n.token = v.token""")
def vocab_coverage(t) -> DataFrame:
    out = vocab.coverage(t("benchmark"), text.tokenize_source(F.col("text")), stored_vocabulary(t), "item_id")
    return out.withColumns({c: F.round(c, 6) for c in ("token_coverage", "unique_coverage")})


@query(f"WITH {VOCAB_SQL}, n AS (SELECT token, count(*) AS n FROM ({exploded_sql('benchmark', 'item_id')}) GROUP BY token) SELECT n.token, n, v.token IS NOT NULL AS known FROM n LEFT JOIN voc v ON n.token = v.token")
def coverage_histogram(t) -> DataFrame:
    """Counts of all tokens, covered and missing ones."""
    return vocab.histogram(t("benchmark"), text.tokenize_source(F.col("text")), stored_vocabulary(t), "item_id")


TARGET_SQL = f"""tk AS (SELECT doc_id, list_filter(string_split(replace({norm_sql('text')}, ' ', ''), ''), lambda x: x <> '') AS toks FROM documents),
tv AS (SELECT token, CAST(3 + row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 100000000 + pos)) AS INTEGER) AS id FROM (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM tk) GROUP BY token),
bt AS (SELECT item_id, list_filter(string_split(replace({norm_sql('text')}, ' ', ''), ''), lambda x: x <> '') AS toks FROM benchmark),
te AS (SELECT item_id, list(coalesce(id, 1) ORDER BY pos) AS ids, string_agg(CASE WHEN id IS NULL THEN '<UNK>' ELSE e.token END, '' ORDER BY pos) AS said FROM (SELECT item_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM bt) e LEFT JOIN tv ON e.token = tv.token GROUP BY item_id)"""


def target_vocabulary(t) -> DataFrame:
    docs = spread(t("documents").select("doc_id", "text"))
    return stored(vocab.vocabulary(docs, text.tokenize_target(F.col("text")), "doc_id", vocab.TARGET_SPECIALS), "target")


@query(f"WITH {TARGET_SQL} SELECT item_id, array_to_string(ids, ',') AS plain, '2,' || array_to_string(ids, ',') AS started, array_to_string(ids, ',') || ',3' AS ended FROM te")
def encode_target(t) -> DataFrame:
    """Target ids, with the first and last special id each asked for on its own."""
    known, rows = target_vocabulary(t), t("benchmark")
    one = lambda name, first, last: vocab.encoded(rows, text.tokenize_target(F.col("text")), known, "item_id", first, last).select("item_id", listed("ids").alias(name))
    return one("plain", False, False).join(one("started", True, False), "item_id").join(one("ended", False, True), "item_id")


@query(f"WITH {TARGET_SQL} SELECT item_id, said AS text FROM te")
def decode_target(t) -> DataFrame:
    known = target_vocabulary(t)
    ids = vocab.encoded(t("benchmark"), text.tokenize_target(F.col("text")), known, "item_id")
    return vocab.decoded(ids, F.col("ids"), known, "item_id", target=True)


@query(f"WITH {VOCAB_SQL}, {TARGET_SQL} SELECT (SELECT count(*) + 4 FROM voc) AS source, (SELECT count(*) + 4 FROM tv) AS target")
def vocabulary_sizes(t) -> DataFrame:
    source, target = vocab.sizes(stored_vocabulary(t)), vocab.sizes(target_vocabulary(t), vocab.TARGET_SPECIALS)
    return source.select(F.col("size").alias("source")).join(target.select(F.col("size").alias("target")))


ENCODED_SQL = f"""{VOCAB_SQL}, enc AS (SELECT item_id, list_concat([2], list_concat(list(coalesce(v.id, 1) ORDER BY pos), [3])) AS ids FROM ({exploded_sql("benchmark", "item_id")}) e LEFT JOIN voc v ON e.token = v.token GROUP BY item_id)"""


def encoded_benchmark(t, known: DataFrame | None = None) -> DataFrame:
    return vocab.encoded(t("benchmark"), text.tokenize_source(F.col("text")), stored_vocabulary(t) if known is None else known, "item_id")


def listed(ids: str | Column) -> Column:
    return F.array_join(F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"), ",")


@query(f"WITH {ENCODED_SQL} SELECT item_id, array_to_string(ids, ',') AS ids FROM enc")
def encode_ids(t) -> DataFrame:
    return encoded_benchmark(t).select("item_id", listed("ids").alias("ids"))


@query(f"""WITH {VOCAB_SQL}, e AS (SELECT item_id, string_agg(CASE WHEN v.id IS NULL THEN '<UNK>' ELSE e.token END, ' ' ORDER BY pos) AS s FROM ({exploded_sql("benchmark", "item_id")}) e LEFT JOIN voc v ON e.token = v.token GROUP BY item_id)
SELECT item_id, regexp_replace(regexp_replace(regexp_replace(s, {quoted(SPACE + "+([,.!?;:])")}, '\\1', 'g'), {quoted(SPACE + "+([。！？；：，、）】」』])")}, '\\1', 'g'), {quoted("([（【「『])" + SPACE + "+")}, '\\1', 'g') AS text FROM e""")
def decode_ids(t) -> DataFrame:
    known = stored_vocabulary(t)
    return vocab.decoded(encoded_benchmark(t, known), F.col("ids"), known, "item_id")


@query(f"""WITH {ENCODED_SQL}, cut AS (SELECT item_id, item_id // 16 AS batch, ids[1:48] AS src, ids[1:40] AS tgt FROM enc),
s AS (SELECT *, tgt[1:len(tgt) - 1] AS dec, tgt[2:len(tgt)] AS lab FROM cut),
w AS (SELECT *, max(len(src)) OVER (PARTITION BY batch) AS ws, max(len(dec)) OVER (PARTITION BY batch) AS wt FROM s)
SELECT item_id, batch, array_to_string(list_resize(src, ws, 0), ',') AS input_ids, array_to_string(list_resize(list_transform(src, lambda x: 1), ws, 0), ',') AS attention_mask,
 array_to_string(list_resize(dec, wt, 0), ',') AS decoder_input_ids, array_to_string(list_resize(lab, wt, -100), ',') AS labels FROM w""")
def truncate_shift_pad(t) -> DataFrame:
    rows = encode.batched(encode.examples(encoded_benchmark(t), "ids", "ids", 48, 40), "item_id", 16)
    names = ("input_ids", "attention_mask", "decoder_input_ids", "labels")
    return encode.collated(rows).select("item_id", "batch", *(listed(c).alias(c) for c in names))


@query(f"WITH {ENCODED_SQL} SELECT item_id, CASE WHEN len(ids) > 24 THEN array_to_string(list_concat(ids[1:23], [3]), ',') ELSE array_to_string(ids, ',') END AS ids FROM enc")
def evaluation_truncate(t) -> DataFrame:
    return encoded_benchmark(t).select("item_id", listed(encode.truncated(F.col("ids"), 24, True)).alias("ids"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS token FROM embeddings")
def argmax_token(t) -> DataFrame:
    return t("embeddings").select("vec_id", encode.argmax(F.col("embedding")).alias("token"))


def echo_model():
    """A deterministic stand-in for a model: it repeats its input after the first id."""
    import numpy as np

    def step(inputs, mask, out):
        k = out.shape[1]
        want = inputs[:, k] if k < inputs.shape[1] else np.full(len(inputs), vocab.LAST)
        want = np.where(want == vocab.PAD, vocab.LAST, want)
        scores_ = np.zeros((len(want), int(want.max(initial=0)) + 1))
        scores_[np.arange(len(want)), want] = 1
        return scores_

    return step


@query(f"WITH {ENCODED_SQL} SELECT item_id, array_to_string(ids[1:128], ',') AS ids FROM enc")
def greedy_decode(t) -> DataFrame:
    """Up to 127 new ids of a model that echoes: each text's own, padding cut off."""
    trimmed = F.filter("prediction_ids", lambda i: i != vocab.PAD)
    return encode.predicted(encoded_benchmark(t), "ids", echo_model).select("item_id", listed(trimmed).alias("ids"))


@query("""WITH z AS (SELECT vec_id, label + 1 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
r AS (SELECT vec_id, ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[y] AS nll FROM z)
SELECT round(avg(nll), 6) AS nll, round(exp(avg(nll)), 6) AS perplexity, round(avg(nll), 6) AS mean_loss, count(*) AS n_tokens FROM r""")
def nll_perplexity(t) -> DataFrame:
    rows = t("embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("z"), F.array("label").alias("y"))
    out = encode.perplexity(encode.token_losses(rows, "z", "y"))
    return out.withColumns({c: F.round(c, 6) for c in ("nll", "perplexity", "mean_loss")})


@query("""WITH z AS (SELECT vec_id, vec_id // 16 AS batch, label + 1 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
r AS (SELECT batch, avg(ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[y]) AS loss FROM z GROUP BY batch) SELECT round(avg(loss), 6) AS mean_batch_loss, count(*) AS n_batches FROM r""")
def batch_loss(t) -> DataFrame:
    """Mean over batches of each one's loss."""
    rows = t("embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("z"), F.array("label").alias("y"))
    out = encode.mean_batch_loss(encode.batched(encode.token_losses(rows, "z", "y"), "vec_id", 16))
    return out.withColumn("mean_batch_loss", F.round("mean_batch_loss", 6))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42' || chr(0) || doc_id), doc_id) - 1 AS place FROM documents) SELECT doc_id, place, place // 16 AS batch FROM o")
def shuffled_batches(t) -> DataFrame:
    return encode.shuffled(t("documents").select("doc_id"), "doc_id", 16)


@query("SELECT n_nationkey, array_to_string(list_transform(generate_series(1, length(n_name)), lambda i: repeat('1', i::INT) || repeat('0', (length(n_name) - i)::INT)), ',') AS mask, repeat('1', length(n_name)::INT) || repeat('0', 3) AS padding FROM nation")
def attention_masks(t) -> DataFrame:
    """Causal masks, and masks of padded ids."""
    causal = F.array_join(F.transform(encode.causal_mask(F.length("n_name")), lambda row: F.array_join(row.cast("array<string>"), "")), ",")
    ids = F.concat(F.array_repeat(F.lit(7), F.length("n_name")), F.array_repeat(F.lit(vocab.PAD), 3))
    return t("nation").select("n_nationkey", causal.alias("mask"), F.array_join(encode.inference_mask(ids).cast("array<string>"), "").alias("padding"))


# --- splits, order, sets -------------------------------------------------------------------


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n, i, n * r AS q, r FROM n, (VALUES (0, 0.8::DOUBLE), (1, 0.1::DOUBLE), (2, 0.1::DOUBLE)) v(i, r)),
s AS (SELECT *, floor(q)::BIGINT AS f, n - sum(floor(q)::BIGINT) OVER (PARTITION BY lang) AS rest, row_number() OVER (PARTITION BY lang ORDER BY q - floor(q) DESC, r DESC, i) AS k FROM q)
SELECT lang, n AS n_rows, CAST(max(CASE WHEN i = 0 THEN f + (k <= rest)::INT END) AS BIGINT) AS train, CAST(max(CASE WHEN i = 1 THEN f + (k <= rest)::INT END) AS BIGINT) AS test, CAST(max(CASE WHEN i = 2 THEN f + (k <= rest)::INT END) AS BIGINT) AS val FROM s GROUP BY lang, n""")
def split_sizes(t) -> DataFrame:
    n = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("s", split.sizes(F.col("n_rows")))
    return n.select("lang", "n_rows", *(F.col("s")[i].alias(name) for i, name in enumerate(config.SPLITS)))


SPLIT_SQL = """n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n, i, n * r AS q, r FROM n, (VALUES (0, 0.8::DOUBLE), (1, 0.1::DOUBLE), (2, 0.1::DOUBLE)) v(i, r)),
s AS (SELECT *, floor(q)::BIGINT AS f, n - sum(floor(q)::BIGINT) OVER (PARTITION BY lang) AS rest, row_number() OVER (PARTITION BY lang ORDER BY q - floor(q) DESC, r DESC, i) AS k FROM q),
z AS (SELECT lang, max(CASE WHEN i = 0 THEN f + (k <= rest)::INT END) AS tr, max(CASE WHEN i = 1 THEN f + (k <= rest)::INT END) AS te FROM s GROUP BY lang),
o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42' || chr(0) || lang || chr(0) || doc_id), doc_id) AS rank FROM documents),
sp AS (SELECT doc_id, o.lang, rank, CASE WHEN rank <= tr THEN 'train' WHEN rank <= tr + te THEN 'test' ELSE 'val' END AS split FROM o JOIN z ON o.lang = z.lang)"""


@query(f"WITH {SPLIT_SQL} SELECT doc_id, lang, rank, split FROM sp")
def stratified_split(t) -> DataFrame:
    return split.split(t("documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"WITH {SPLIT_SQL} SELECT lang, split, count(*) AS n_rows FROM sp GROUP BY ROLLUP (lang, split)")
def split_counts(t) -> DataFrame:
    return split.split_counts(stratified_split(t), "lang")


@query(f"WITH {SPLIT_SQL} SELECT doc_id, split, sha256(CASE split WHEN 'train' THEN '42' WHEN 'test' THEN '43' ELSE '44' END || chr(0) || doc_id) AS mix_key FROM sp")
def final_order(t) -> DataFrame:
    return split.final_order(stratified_split(t), "doc_id").select("doc_id", "split", "mix_key")


@query("SELECT lang, CAST(('0x' || sha256('42' || chr(0) || lang)[1:16])::UBIGINT AS VARCHAR) AS seed FROM documents GROUP BY lang")
def stratum_seeds(t) -> DataFrame:
    return t("documents").select("lang").distinct().select("lang", split.stratum_seed(F.col("lang")).cast("string").alias("seed"))


@query("SELECT url, sha256('42' || chr(0) || url) AS ticket FROM pages ORDER BY ticket, url LIMIT 100")
def nested_sample(t) -> DataFrame:
    return ordering.sampled(t("pages").select("url"), "url", 100)


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_seen_dedupe(t) -> DataFrame:
    return ordering.first_seen(t("documents"), "text", "doc_id").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "doc_id")


@query("SELECT 'benchmark' AS part, item_id AS row_idx, length(text) AS n_chars FROM benchmark UNION ALL SELECT 'documents', doc_id, length(text) FROM documents")
def union_merge(t) -> DataFrame:
    one = lambda name, key: t(name).select(F.lit(name).alias("part"), F.col(key).alias("row_idx"), F.length("text").cast("long").alias("n_chars"))
    return one("benchmark", "item_id").unionByName(one("documents", "doc_id"))


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(t) -> DataFrame:
    """Customers without a large order."""
    large = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey"))
    return sets.difference(t("customer").select(F.col("c_custkey").alias("custkey")), large, "custkey")


@query("SELECT count(*) = 0 AS is_subset, count(*) AS n_missing FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def subset_check(t) -> DataFrame:
    gone = sets.difference(t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")), "k")
    n = F.count(F.lit(1))
    return gone.agg((n == 0).alias("is_subset"), n.alias("n_missing"))


@query("""WITH u AS (SELECT 0 AS part, c_custkey AS pos, c_nationkey AS k FROM customer UNION ALL SELECT 1, s_suppkey, s_nationkey FROM supplier)
SELECT k, min(part * 1000000000 + pos) AS first_at FROM u GROUP BY k""")
def ordered_union(t) -> DataFrame:
    parts = [t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("at")), t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("at"))]
    return sets.ordered_union(parts, "k", "at").select("k", (F.col("at.part") * 1000000000 + F.col("at.at")).cast("long").alias("first_at"))


@query(f"""WITH r AS (SELECT regexp_replace(coalesce(p_name, ''), '^{SPACE}+|{SPACE}+$', '', 'g') AS a, CASE WHEN p_size % 7 = 0 THEN '' ELSE coalesce(p_type, '') END AS b FROM part)
SELECT CASE WHEN a = '' AND b = '' THEN 'blank' WHEN a = '' OR b = '' THEN 'half' ELSE 'full' END AS rule, count(*) AS n_rows FROM r GROUP BY 1""")
def blank_policy(t) -> DataFrame:
    return pair_source.violations(t("part").select(F.col("p_name").alias("vi"), F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("cn")))


# --- scores ---------------------------------------------------------------------------------


def dealt_out(pairs: DataFrame) -> DataFrame:
    """Quadratic work on few bytes: rows dealt out by number, so that they aren't gathered in one task."""
    return pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)


def name_pairs(t) -> DataFrame:
    """Each part's name and the name 97 parts on, the first after the last."""
    p, n = t("part").select("p_partkey", F.col("p_name").alias("ref")), t("part").count()
    pairs = p.join(p.select(F.pmod(F.col("p_partkey") - 97, F.lit(n)).alias("at"), F.col("ref").alias("pred")), F.col("p_partkey") == F.col("at")).drop("at").withColumnRenamed("p_partkey", "row_idx")
    return dealt_out(pairs)


NAMES_SQL = "np AS (SELECT a.p_partkey AS row_idx, a.p_name AS ref, b.p_name AS pred, string_split(a.p_name, '') AS r, string_split(b.p_name, '') AS p FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 97) % (SELECT count(*) FROM part))"
#: Packed cells as in edit_counts_native: distance, then S, D, I, three digits each.
EDIT_SQL = """ed AS (SELECT *, list_reduce(p, lambda row, c: list_reduce(list_transform(generate_series(1, len(r)), lambda j: [row[j] + CASE WHEN r[j] = c THEN 0 ELSE 1001000000 END, row[j + 1] + 1000000001]),
 lambda done, x: list_append(done, CASE WHEN x[1] // 1000000000 <= (done[len(done)] + 1000001000) // 1000000000 AND x[1] // 1000000000 <= x[2] // 1000000000 THEN x[1]
  WHEN (done[len(done)] + 1000001000) // 1000000000 <= x[2] // 1000000000 THEN done[len(done)] + 1000001000 ELSE x[2] END), [row[1] + 1000000001]),
 list_transform(generate_series(0, len(r)), lambda j: j * 1000001000)) AS cells FROM np),
ec AS (SELECT *, cells[len(cells)] AS c FROM ed)"""
LCS_SQL = """lc AS (SELECT *, list_reduce(p, lambda row, c: list_reduce(generate_series(1, len(r)), lambda done, j: list_append(done, CASE WHEN r[j] = c THEN row[j] + 1 ELSE greatest(row[j + 1], done[len(done)]) END), [0::BIGINT]),
 list_transform(generate_series(0, len(r)), lambda j: 0::BIGINT)) AS cells FROM np)"""


@query(f"WITH {NAMES_SQL}, {EDIT_SQL} SELECT row_idx, CAST(c // 1000000000 AS INTEGER) AS edit_distance, CAST(c // 1000000 % 1000 AS INTEGER) AS substitutions, CAST(c // 1000 % 1000 AS INTEGER) AS deletions, CAST(c % 1000 AS INTEGER) AS insertions FROM ec")
def edit_counts(t) -> DataFrame:
    known = F.col("ref").isNotNull() & F.col("pred").isNotNull()
    return metrics.details(name_pairs(t)).select("row_idx", *(F.when(known, F.col(c)).alias(c) for c in ("edit_distance", "substitutions", "deletions", "insertions")))


@query(f"WITH {NAMES_SQL}, {LCS_SQL} SELECT row_idx, CAST(cells[len(cells)] AS INTEGER) AS lcs, round(2.0 * cells[len(cells)] / (len(r) + len(p)), 6) AS news_fscore FROM lc")
def lcs_fscore(t) -> DataFrame:
    known = F.col("ref").isNotNull() & F.col("pred").isNotNull()
    rows = name_pairs(t).withColumn("lcs", F.when(known, scores.lcs_length(F.col("ref"), F.col("pred"))))
    return rows.select("row_idx", "lcs", F.round(scores.fscore(F.col("lcs"), F.col("ref"), F.col("pred")), 6).alias("news_fscore"))


@query("""WITH p AS (SELECT n_nationkey AS k, 1000 + 20 * n_nationkey AS r, 1100 + 7 * n_nationkey AS q FROM nation) SELECT k AS row_idx, CAST(greatest(r, q) AS INTEGER) AS edit_distance, CAST(least(r, q) AS INTEGER) AS substitutions, CAST(greatest(r - q, 0) AS INTEGER) AS deletions, CAST(greatest(q - r, 0) AS INTEGER) AS insertions FROM p""")
def long_edit_counts(t) -> DataFrame:
    """Edits of strings of over 1,000 code points that share none."""
    k = F.col("n_nationkey").cast("int")
    pairs = t("nation").select(k.alias("row_idx"), F.expr("repeat('a', 1000 + 20 * n_nationkey)").alias("ref"), F.expr("repeat('天', 1100 + 7 * n_nationkey)").alias("pred"))
    return metrics.details(pairs).select("row_idx", "edit_distance", "substitutions", "deletions", "insertions")


@query(f"""WITH {NAMES_SQL}, {EDIT_SQL}, {LCS_SQL}, fs AS (SELECT round(avg(2.0 * cells[len(cells)] / (len(r) + len(p))), 6) AS news_fscore FROM lc) SELECT any_value(news_fscore) AS news_fscore, count(*) AS samples, count(*) FILTER (ref = pred) AS exact_matches, round(sum(c // 1000000000) / sum(length(ref)), 6) AS cer, round(1 - sum(c // 1000000000) / sum(length(ref)), 6) AS char_accuracy,
 CAST(sum(length(ref)) AS BIGINT) AS ref_chars, CAST(sum(length(pred)) AS BIGINT) AS pred_chars, CAST(sum(c // 1000000 % 1000) AS BIGINT) AS substitutions, CAST(sum(c // 1000 % 1000) AS BIGINT) AS deletions, CAST(sum(c % 1000) AS BIGINT) AS insertions FROM ec, fs""")
def corpus_metrics(t) -> DataFrame:
    out = metrics.totals(metrics.details(name_pairs(t)))
    return out.select("samples", "exact_matches", F.round("news_fscore", 6).alias("news_fscore"), F.round("cer", 6).alias("cer"), F.round("char_accuracy", 6).alias("char_accuracy"), "ref_chars", "pred_chars", "substitutions", "deletions", "insertions")


def turn_pairs(t) -> DataFrame:
    """User turns and the assistant turns that follow them, whole, without white space."""
    return raw_turns(t).select("row_idx", text.normalize_target(F.col("ref")).alias("ref"), text.normalize_target(F.col("pred")).alias("pred"))


def raw_turns(t) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"), F.col("text").alias("ref"), F.col("next_text").alias("pred"))


@query()
def turn_scores(t) -> DataFrame:
    return metrics.details(dealt_out(turn_pairs(t))).select("row_idx", "exact_match", "edit_distance", "substitutions", "deletions", "insertions", F.round("news_fscore", 6).alias("news_fscore"))


def plain_sql(column: str) -> str:
    return f"regexp_replace(nfc_normalize(coalesce({column}, '')), {quoted(SPACE)}, '', 'g')"


GRAMS_SQL = f"""w AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
tp AS (SELECT conv_id * 1000 + turn AS k, {plain_sql("text")} AS r, {plain_sql("nt")} AS p FROM w WHERE role = 'user' AND nr = 'assistant'),
g AS (SELECT k, n, 1 AS side, unnest(list_transform(generate_series(1, length(r) - n + 1), lambda i: substring(r, i, n))) AS gram FROM tp, generate_series(1, 6) x(n) UNION ALL
      SELECT k, n, 0, unnest(list_transform(generate_series(1, length(p) - n + 1), lambda i: substring(p, i, n))) FROM tp, generate_series(1, 6) x(n)),
c AS (SELECT k, n, gram, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 0) AS b FROM g GROUP BY ALL),
rw AS (SELECT k, n, sum(least(a, b)) AS m, sum(a) AS a, sum(b) AS b FROM c GROUP BY k, n),
gm AS (SELECT n, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(a) AS BIGINT) AS ref_total, CAST(sum(b) AS BIGINT) AS pred_total, CAST(sum(CASE WHEN a > 0 THEN b ELSE 0 END) AS BIGINT) AS pred_counted FROM rw GROUP BY n)"""


@query(f"WITH {GRAMS_SQL} SELECT CAST(n AS INTEGER) AS n, matches, ref_total, pred_total, pred_counted FROM gm")
def ngram_matches(t) -> DataFrame:
    return metrics.gram_counts(turn_pairs(t), 6)


@query(f"""WITH {GRAMS_SQL}, l AS (SELECT sum(length(r)) AS r, sum(length(p)) AS p FROM tp)
SELECT round(any_value(CASE WHEN l.p >= l.r THEN 1.0 ELSE exp(1 - l.r / l.p) END) * exp(avg(ln(100.0 * matches / pred_total))), 6) AS bleu FROM gm, l WHERE n <= 4""")
def char_bleu(t) -> DataFrame:
    pairs = stored(turn_pairs(t), "turns")
    return pairs.sparkSession.createDataFrame([(round(metrics.char_bleu(pairs), 6),)], "bleu double")


@query(f"""WITH {GRAMS_SQL.replace('nfc_normalize(coalesce(text, ' + quoted('') + '))', "coalesce(text, '')").replace('nfc_normalize(coalesce(nt, ' + quoted('') + '))', "coalesce(nt, '')")}, l AS (SELECT sum(length(r)) AS r, sum(length(p)) AS p FROM tp)
SELECT round(any_value(CASE WHEN l.p >= l.r THEN 1.0 ELSE exp(1 - l.r / l.p) END) * exp(avg(ln(100.0 * matches / pred_total))), 6) AS bleu FROM gm, l WHERE n <= 4""")
def training_bleu(t) -> DataFrame:
    """BLEU of raw turns, as training reports it."""
    pairs = stored(raw_turns(t), "turns")
    return pairs.sparkSession.createDataFrame([(round(metrics.training_bleu(pairs), 6),)], "bleu double")


@query(f"WITH {GRAMS_SQL}, pr AS (SELECT avg(matches / pred_counted) AS p, avg(matches / ref_total) AS r FROM gm WHERE pred_counted > 0 AND ref_total > 0) SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf2 FROM pr")
def chrf2(t) -> DataFrame:
    return metrics.chrf_row(metrics.gram_counts(turn_pairs(t), 6)).select(F.round("chrf2", 6).alias("chrf2"))


# --- pages, URLs, names ----------------------------------------------------------------------

URL_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg"


@query(f"SELECT page_id, host, seg[1] AS first_segment, seg[-1] AS last_segment FROM (SELECT page_id, {URL_SQL} FROM pages)")
def url_parts(t) -> DataFrame:
    seg = urls.segments(F.col("url"))
    return t("pages").select("page_id", urls.host(F.col("url")).alias("host"), F.try_element_at(seg, F.lit(1)).alias("first_segment"), F.try_element_at(seg, F.lit(-1)).alias("last_segment"))


@query(f"SELECT page_id, coalesce(seg[1] IN ('fr', 'de'), false) AS removed FROM (SELECT page_id, {URL_SQL} FROM pages)")
def url_author_filter(t) -> DataFrame:
    p = t("pages").withColumns({"author": F.try_element_at(urls.segments(F.col("url")), F.lit(1))})
    known = p.sparkSession.createDataFrame([("fr",), ("de",)], "name string")
    hit = p.join(known, p["author"] == known["name"], "left")
    return hit.select("page_id", F.coalesce(sets.should_remove(F.col("url"), F.col("name").isNotNull(), "all"), F.lit(False)).alias("removed"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM a GROUP BY page_id""")
def page_links(t) -> DataFrame:
    found = page_source.links(F.col("html"))
    return t("pages").select("page_id", F.transform(found, lambda x: x["href"]).alias("u")).where(F.size("u") > 0).select("page_id", F.size("u").cast("long").alias("n_links"), F.size(F.array_distinct("u")).cast("long").alias("n_distinct"))


@query("SELECT page_id, contains(html, 'class=\"g-recaptcha\"') AND NOT contains(html, 'list-item-header') AS challenge FROM pages")
def access_challenge(t) -> DataFrame:
    return t("pages").select("page_id", text.is_access_challenge(F.col("html")).alias("challenge"))


SLUG_SQL = "regexp_replace(lower(strip_accents(p_name || ' ' || p_brand)), '[^a-z0-9]+', '', 'g')"


def titled(t) -> DataFrame:
    return t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("title"))


@query(f"SELECT p_partkey, {SLUG_SQL} AS stem FROM part")
def slug(t) -> DataFrame:
    return titled(t).select("p_partkey", text.filename_stem(F.col("title")).alias("stem"))


@query(f"WITH s AS (SELECT p_partkey, {SLUG_SQL} AS stem FROM part) SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY p_partkey) = 1 THEN stem ELSE stem || '-' || p_partkey END AS name FROM s")
def slug_collision(t) -> DataFrame:
    rows = titled(t).select("p_partkey", text.filename_stem(F.col("title")).alias("stem"), F.col("p_partkey").cast("string").alias("uid"))
    return ordering.stem_names(rows, "stem", "uid", "p_partkey", text.stem_with_uid).select("p_partkey", "name")


@query(f"""WITH w AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: {norm_sql("x")}), lambda x: x <> '') AS a, list_filter(list_transform(string_split(nt, chr(10)), lambda x: {norm_sql("x")}), lambda x: x <> '') AS b FROM w WHERE role = 'user' AND nr = 'assistant')
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, md5(a[i] || '|' || b[i]) AS pair_md5 FROM p, generate_series(1, 10000) x(i) WHERE len(a) = len(b) AND len(a) > 0 AND i <= len(a)""")
def zip_lines(t) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("nr"), F.lead("text").over(w).alias("nt")).where("role = 'user' and nr = 'assistant'")
    rows = rows.select("conv_id", "turn", text.text_lines(F.col("text")).alias("a"), text.text_lines(F.col("nt")).alias("b")).where("size(a) = size(b) and size(a) > 0")
    return rows.select("conv_id", "turn", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x")).select("conv_id", "turn", "pos", F.md5(F.concat("x.a", F.lit("|"), "x.b").cast("binary")).alias("pair_md5"))


# --- collecting -----------------------------------------------------------------------------

COUNTS_SQL = "n AS (SELECT c_nationkey AS country, c_mktsegment AS age, count(*) AS results FROM customer GROUP BY ALL), nn AS (SELECT country, CAST(sum(results) AS BIGINT) AS results FROM n GROUP BY country)"


def market(t) -> DataFrame:
    return t("customer").groupBy(F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("age")).agg(F.count(F.lit(1)).alias("results"))


@query(f"WITH {COUNTS_SQL} SELECT country, results, CASE WHEN results <= 100 THEN 'all-pages' WHEN results < 200 THEN 'two-windows' WHEN country % 2 = 0 THEN 'by-age' ELSE 'unresolved' END AS strategy, least(results, 200) AS reachable FROM nn")
def discovery_plan(t) -> DataFrame:
    n = t("customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.count(F.lit(1)).alias("results"))
    return collect.plan(n, F.col("country") % 2 == 0)


@query(f"WITH {COUNTS_SQL} SELECT country, age, results, CASE WHEN country = 3 THEN 'skip' WHEN country = 4 THEN 'unresolved' WHEN results <= 100 THEN 'all-pages' WHEN results < 200 THEN 'two-windows' ELSE 'by-author' END AS strategy, CASE WHEN results <= 100 THEN 'all-pages' ELSE 'date-asc-desc-windows' END AS shallow FROM n")
def age_plan(t) -> DataFrame:
    configured = F.when(F.col("country") == 3, 0).when(F.col("country") == 4, F.col("results") + 1)
    return market(t).select("country", "age", "results", collect.age_strategy(F.col("results"), configured).alias("strategy"), collect.shallow_strategy(F.col("results")).alias("shallow"))


@query(f"WITH {COUNTS_SQL} SELECT CAST(sum(results) AS BIGINT) AS configured_results, CAST(sum(least(results, 200)) AS BIGINT) AS window_capacity FROM nn")
def configured_totals(t) -> DataFrame:
    return collect.totals(t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("results")))


@query(f"WITH {COUNTS_SQL} SELECT country, age, 'country=' || country || '&age=' || age AS key, 'https://poems.example/search-poem.php?PoemType=7&ViewType=2&Country=' || country || '&Age%5B%5D=' || age || '&Page=2' AS url FROM n")
def url_builders(t) -> DataFrame:
    country, none = F.col("country").cast("string"), F.lit(None).cast("string")
    search = F.lit(config.GENRES["that-ngon-bat-cu"].search_url)
    return market(t).select("country", "age", urls.partition_key(country, F.col("age"), none).alias("key"), urls.partition_url(search, country, F.col("age"), F.lit(2)).alias("url"))


@query(f"WITH {COUNTS_SQL}, p AS (SELECT country, age, greatest(1, least((results + 9) // 10, 10)) AS pages FROM n) SELECT country, age, CAST(page AS INTEGER) AS page FROM p, generate_series(1, 10) x(page) WHERE page <= pages")
def page_requests(t) -> DataFrame:
    rows = market(t).withColumn("pages", F.ceil(F.col("results") / 10).cast("int"))
    return collect.page_requests(rows, "pages", True).select("country", "age", "page")


@query(f"WITH {COUNTS_SQL}, k AS (SELECT DISTINCT 'country=' || country AS key FROM n UNION SELECT 'country=' || country || '&age=' || age FROM n) SELECT key FROM k WHERE key NOT IN ('country=2') AND NOT starts_with(key, 'country=2&age=')")
def reopened_keys(t) -> DataFrame:
    none = F.lit(None).cast("string")
    m = market(t).withColumn("c", F.col("country").cast("string"))
    keys = m.select(urls.partition_key(F.col("c"), none, none).alias("key")).unionByName(m.select(urls.partition_key(F.col("c"), F.col("age"), none).alias("key"))).distinct()
    return collect.reopened(keys, ["2"])


@query("""WITH f AS (SELECT event_id, event_type AS country, user_id AS url, min(event_id) OVER (PARTITION BY user_id) AS first FROM events)
SELECT 'country=' || country || '&age=1' AS partition, count(DISTINCT url) AS collected_urls, count(*) FILTER (event_id = first) AS new_unique_urls FROM f GROUP BY country""")
def partition_stats(t) -> DataFrame:
    return collect.partition_stats(t("events").select(F.col("event_type").alias("country"), F.lit("1").alias("age"), F.col("user_id").alias("url"), F.col("event_id").alias("seq")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS first_event_id FROM events GROUP BY user_id")
def progress_latest(t) -> DataFrame:
    return ordering.last_write(t("events"), "user_id", "event_id", ["event_type", "value"])


STATUS_SQL = "p AS (SELECT user_id AS url, arg_max(event_type, event_id) AS e, arg_max(value, event_id) AS v FROM events GROUP BY user_id), st AS (SELECT url, CASE e WHEN 'click' THEN 'written' WHEN 'purchase' THEN 'existing' WHEN 'error' THEN 'skipped' ELSE 'open' END AS status, CAST(floor(v) AS BIGINT) AS sentence_pairs FROM p)"


def progress_state(t) -> DataFrame:
    last = progress_latest(t)
    e = F.col("event_type")
    status = F.when(e == "click", "written").when(e == "purchase", "existing").when(e == "error", "skipped").otherwise("open")
    return last.select(F.col("user_id").alias("url"), status.alias("status"), F.lit("x.csv").alias("output"), F.floor("value").alias("sentence_pairs"), F.lit(None).cast("string").alias("error"))


@query(f"WITH {STATUS_SQL} SELECT c_custkey AS url FROM customer WHERE c_custkey NOT IN (SELECT url FROM st WHERE status IN ('written', 'existing', 'skipped'))")
def resume_filter(t) -> DataFrame:
    return collect.to_fetch(t("customer").select(F.col("c_custkey").alias("url")), progress_state(t), trust=True)


@query(f"WITH {STATUS_SQL} SELECT count(*) AS discovered_poems, count(*) FILTER (status IN ('written', 'existing')) AS written_csv_files, CAST(coalesce(sum(sentence_pairs) FILTER (status IN ('written', 'existing')), 0) AS BIGINT) AS sentence_pairs, count(*) FILTER (status = 'skipped') AS skipped_poems FROM st")
def crawl_report(t) -> DataFrame:
    return collect.report(progress_state(t))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS INTEGER) AS results FROM orders")
def parse_result_count(t) -> DataFrame:
    page = F.concat(F.lit("tổng số 3 trang ("), F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", "."), F.lit(" bài thơ)"))
    return t("orders").select("o_orderkey", text.result_count(page).alias("results"))


def queries() -> dict:
    import versefold.plans.site  # noqa: F401 (registers its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
