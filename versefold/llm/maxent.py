"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

p(word | context) = p(class | context) p(word | class, context). The class softmax sums weights of
hashed features: the word before (bigram), the two before (trigram), the words two and three back
(skips), and the last three classes. The words of a class are the leaves of a binary tree, split at
half their smoothed counts; each step is a logistic choice by the hashed bigram, trigram and skip
features, from the counts' ratio as its start. Rare steps (RICH, OFTEN) go by the ratio alone. Classes are clusters of the documents that a word is commonest in, cut into bands of frequency; all words
beyond the lexicon share one class, and so does the unknown word; as contexts they go by their hashes. Training: exact counts of all
training documents set the start, then each training document gives its gradient once, in
rounds of synchronous distributed updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.llm.common import n_parts, stored, table
from versefold.llm.textscan import Words, mixed, words_of

FOLDS, SMOOTH = 10, 0.1
#: Words with ids of their own at most (the commonest); all others are scored by exact counts too,
#: through a join.
LEXICON = 1 << 19
#: As contexts those others have so many ids, by their keys' hashes.
TAILS = 1 << 16
CLUSTERS, BANDS, VECTOR = 6, (0.5, 0.8), 256
CLASSES = CLUSTERS * (len(BANDS) + 1) + 1
TAIL = CLASSES - 1
BUCKETS, KINDS = 1 << 14, 4
ROWS = KINDS * BUCKETS + CLASSES**3
#: Weights of (feature, tree node); the features' numbers; a node with weights is passed by a word of
#: training 100 times at least and once in 2^13 tokens; the step of its weights in a round.
TREE, TREE_FEATURES, RICH, OFTEN, TREE_STEP = 1 << 19, (0, 1, 3), 100, 1 << 13, 0.6
ROUNDS, STEP, START, PRIOR = 2, 0.35, 0.45, 20.0
SEED_DOCS, FLUSH, CHUNK, SLICE, BLOCKS, PREFIX = 2000, 1 << 22, 1 << 16, 1 << 20, 64, 21
U = np.uint64
#: Word keys are the upper 61 bits of word hashes; the end of a text has this one.
END, KEY = U(8), U((1 << 64) - 8)


def train_fold():
    """Documents to learn from: crc32 of the id as text mod 10 is not 0 (a null id: empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS != 0


SUMS = "block int, n int, at binary, data binary"


def totals(rows: DataFrame, blocks: int, size: int) -> np.ndarray:
    """Sum of tables of `size` numbers that came in blocks. Tasks add up what they are sent as it
    comes, so memory is that of the blocks, however many tasks sent some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n, at, x in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "at", "data")), strict=True):
                one, table_ = np.frombuffer(x, np.float32), sums.setdefault(b, np.zeros(n))
                if at is None:
                    table_ += one
                else:
                    table_[np.frombuffer(at, np.int32)] += one
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    got = {r["block"]: r["data"] for r in rows.repartition("block").mapInArrow(run, "block int, data binary").collect()}
    parts = np.array_split(np.empty(size, np.int8), blocks)
    return np.concatenate([np.frombuffer(got[b]) if b in got else np.zeros(len(q)) for b, q in enumerate(parts)])


def blocked(total: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A table cut into blocks, each with all its numbers or, where most are 0, the others and where
    they are."""
    rows = []
    for b, part in enumerate(np.array_split(total.ravel(), blocks)):
        at = np.flatnonzero(part).astype(np.int32)
        few = 3 * len(at) < len(part)
        if len(at):
            rows.append((b, len(part), at.tobytes() if few else None, (part[at] if few else part).astype(np.float32).tobytes()))
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["block", "n", "at", "data"])


def doc_vectors(w: Words) -> np.ndarray:
    """Per text: unit vector of square roots of hashed word counts."""
    n = len(w.of) - 1
    c = np.sqrt(np.bincount(w.text() * VECTOR + (w.hash >> U(56)).astype(np.int64) % VECTOR, minlength=n * VECTOR).reshape(n, VECTOR))
    return (c / np.maximum(np.sqrt((c * c).sum(1)), 1e-9)[:, None]).astype(np.float32)


def clustered(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(centres, words per cluster) of spherical k-means: a start from a few documents' vectors
    (the first by a hash), then rounds over those of all documents."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words_of(batch.column("text")):
                v = np.round(doc_vectors(w) * 255).astype(np.uint8)
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(w.of).astype(np.int64)), pa.array([x.tobytes() for x in v], pa.binary())], names=["doc_id", "n", "v"])

    made = stored(docs.mapInArrow(vectors, "doc_id long, n long, v binary"), "vectors")
    few = made.where("n > 0").orderBy(F.xxhash64("doc_id", "v")).limit(SEED_DOCS).select("v").collect()
    if not few:
        return np.eye(CLUSTERS, VECTOR, dtype=np.float32), np.ones(CLUSTERS)
    x = np.stack([np.frombuffer(r[0], np.uint8) for r in few]).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    picked = [0]
    while len(picked) < CLUSTERS:
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    centres = x[picked]
    for _ in range(8):
        of = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[of == k].sum(0) + 1e-3 * centres[k] for k in range(CLUSTERS)]))
    sizes = np.ones(CLUSTERS)
    for _ in range(2):

        def assign(batches: Iterator[pa.RecordBatch], at=centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((CLUSTERS, VECTOR + 1))
            for batch in batches:
                v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.uint8).reshape(-1, VECTOR).astype(np.float32)
                of = (v @ at.T).argmax(1)
                for k in range(CLUSTERS):
                    total[k, :VECTOR] += v[of == k].sum(0)
                    total[k, VECTOR] += batch.column("n").to_numpy()[of == k].sum()
            yield blocked(total, 1)

        got = totals(made.mapInArrow(assign, SUMS), 1, CLUSTERS * (VECTOR + 1)).reshape(CLUSTERS, VECTOR + 1)
        centres, sizes = unit((got[:, :VECTOR] + 1e-3 * centres).astype(np.float32)), got[:, VECTOR] + 1
    return centres, sizes


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]).astype(np.float32)


PACKED = "bucket int, kind int, keys binary, a binary, b binary"


def packed(bucket: np.ndarray, kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    """Arrays cut by bucket, a row for each."""
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(bucket)] if len(bucket) else []
    spans = list(zip(edge, edge[1:], strict=False))
    return pa.record_batch([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array([kind] * len(spans), pa.int32()), *(pa.array([c[i:j].tobytes() for i, j in spans], pa.binary()) for c in cols)], names=["bucket", "kind", "keys", "a", "b"])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(keys) >> U(33)) % U(buckets)).astype(np.int64)


def word_counts(docs: DataFrame, centres: np.ndarray, sizes: np.ndarray, buckets: int) -> DataFrame:
    """Exact counts of all words of docs: a row a bucket with keys, counts and clusters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return packed(bucket_of(k & KEY, buckets), 0, k, c.astype(np.uint32), np.zeros(len(k), np.uint8))

        for batch in batches:
            for i, j, w in words_of(batch.column("text")):
                of = (doc_vectors(w) @ centres.T).argmax(1).astype(np.uint64)
                held += [w.hash & KEY | np.repeat(of, np.diff(w.of)), END | of]
                n += len(w.hash) + j - i
                if n > FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def merge(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        k = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(t.column("a").to_pylist()), np.uint32).astype(np.int64)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        k, c = k[first], np.add.reduceat(c, first)
        word, cluster = k & KEY, (k & ~KEY).astype(np.int64)
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        total = np.add.reduceat(c, start)
        lift = c / sizes[np.minimum(cluster, CLUSTERS - 1)]
        best = np.lexsort((-lift, np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(k)]))))[start]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "kind": pa.array([0], pa.int32()), "keys": [word[start].tobytes()], "a": [total.astype(np.int64).tobytes()], "b": [cluster[best].astype(np.uint8).tobytes()]})

    return stored(docs.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(merge, PACKED), "counts")


class Lexicon:
    """The commonest words: sorted keys, counts, classes, and scores within their class."""

    def __init__(self, counts: DataFrame):
        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, 4096))
            for batch in batches:
                for x in batch.column("a").to_pylist():
                    c = np.frombuffer(x, np.int64)
                    level = np.minimum(64 * np.log2(c), 4095).astype(np.int64)
                    out[0] += np.bincount(level, minlength=4096)
                    out[1] += np.bincount(level, c, minlength=4096)
            yield pa.record_batch([pa.array(np.arange(4096, dtype=np.int32)), *(pa.array(x.astype(np.int64)) for x in out)], names=["level", "words", "tokens"])

        n_of, c_of = np.zeros(4096), np.zeros(4096)
        for r in counts.mapInArrow(tally, "level int, words long, tokens long").where("words > 0").groupBy("level").sum("words", "tokens").collect():
            n_of[r[0]], c_of[r[0]] = r[1], r[2]
        self.v, self.n = int(n_of.sum()), int(c_of.sum())
        above = np.cumsum(n_of[::-1])[::-1]
        least = int(np.argmax(above <= LEXICON))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, c, g in zip(*(batch.column(x).to_pylist() for x in ("keys", "a", "b")), strict=True):
                    k, c, g = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(g, np.uint8)
                    on = np.minimum(64 * np.log2(c), 4095).astype(np.int64) >= least
                    yield pa.record_batch([pa.array([x[on].tobytes()], pa.binary()) for x in (k, c, g)], names=["k", "c", "g"])

        rows = counts.mapInArrow(pick, "k binary, c binary, g binary").collect()
        k, c, g = (np.concatenate([np.frombuffer(r[x], t) for r in rows] or [np.zeros(0, t)]) for x, t in (("k", np.uint64), ("c", np.int64), ("g", np.uint8)))
        order = np.argsort(k)
        self.keys, self.count, g = k[order], c[order], g[order].astype(np.int64)
        self.first = np.searchsorted(self.keys >> U(64 - PREFIX), np.arange((1 << PREFIX) + 1)).astype(np.int32)
        klass = np.zeros(len(self.keys), np.uint8)
        for cluster in range(CLUSTERS):
            own = np.flatnonzero(g == cluster)
            own = own[np.argsort(-self.count[own], kind="stable")]
            share = (np.cumsum(self.count[own]) - self.count[own]) / max(self.count[own].sum(), 1)
            klass[own] = cluster * (len(BANDS) + 1) + np.searchsorted(BANDS, share, "right")
        self.klass = klass
        mass, words = np.bincount(klass, self.count, minlength=CLASSES), np.bincount(klass, minlength=CLASSES)
        mass[TAIL], words[TAIL] = self.n - self.count.sum(), self.v - len(self.keys) + 1
        self.below = mass + SMOOTH * words
        self.prior = np.where(words > 0, (mass + 1) / (mass.sum() + CLASSES), 1e-12)
        self.base_below = self.n + SMOOTH * (self.v + 1)
        self.within = np.log10((self.count + SMOOTH) / self.below[klass]) if len(klass) else np.zeros(0)
        self.base = np.log10((self.count + SMOOTH) / self.base_below) if len(klass) else np.zeros(0)
        self.grow()
        #: By id; the ids after the words are those of any other word, from tail_id on, and one for
        #: before the text.
        self.tail_id, self.start_id = len(self.keys), len(self.keys) + TAILS
        self.class_of = np.concatenate([klass, np.full(TAILS + 1, TAIL)]).astype(np.int64)
        h = mixed(np.concatenate([self.keys, np.arange(2, TAILS + 3, dtype=np.uint64) * U(8)]))
        self.slots = [((h >> U(7 + 14 * i)) % U(BUCKETS)).astype(np.uint16) for i in range(3)]

    def grow(self) -> None:
        """The classes' trees. By node: up (parent, -1 at a class's top), right (whether it is its
        parent's right child) and odds (log of right to left counts); by word: leaf, on_right and
        rest, the log10 of its share below its leaf node. Tail and start have no node."""
        n = len(self.keys)
        size = n + TAILS + 1
        self.leaf, self.on_right, self.rest = np.full(size, -1, np.int32), np.zeros(size, bool), np.zeros(size)
        if not n:
            self.up, self.right, self.odds = np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.float32)
            return
        order = np.lexsort((-self.count, self.klass))
        mass, klass = self.count[order] + SMOOTH, self.klass[order].astype(np.int64)
        upto = np.concatenate([[0.0], np.cumsum(mass)])
        top = np.searchsorted(klass, np.arange(CLASSES + 1))
        whole = np.maximum(upto[top[1:]] - upto[top[:-1]], SMOOTH)[klass]
        middle = (upto[:-1] + mass / 2 - upto[top[:-1]][klass]) / whole
        code = (middle * 2.0**52).astype(np.int64)
        apart = (code[1:] ^ code[:-1]).tolist()
        cross = (klass[1:] != klass[:-1]).tolist()
        up = np.full(max(n - 1, 0), -1, np.int64)
        low, high = up.copy(), np.full(len(up), n, np.int64)
        stack: list[int] = []
        for i, (x, new) in enumerate(zip(apart, cross, strict=True)):
            if new:
                high[stack] = i
                stack = []
                low[i] = high[i] = i
                continue
            last = -1
            while stack and apart[stack[-1]] < x:
                last = stack.pop()
                high[last] = i
                if stack and apart[stack[-1]] < x:
                    up[last] = stack[-1]
                else:
                    up[last] = i
            low[i] = stack[-1] if stack else -1
            if stack:
                up[i] = stack[-1]
            stack.append(i)
        gap = np.flatnonzero(~np.array(cross, bool))
        first = np.maximum(np.where(low < 0, 0, low + 1), top[:-1][klass[:-1]])
        end = np.minimum(high + 1, top[1:][klass[:-1]])
        left, right = np.ones(len(up)), np.ones(len(up))
        left[gap], right[gap] = upto[gap + 1] - upto[first[gap]], upto[end[gap]] - upto[gap + 1]
        rich = np.zeros(len(up), bool)
        rich[gap] = left[gap] + right[gap] >= max(RICH, self.n / OFTEN)
        self.up, self.right = up.astype(np.int32), up < np.arange(len(up))
        self.odds = np.log(right / left).astype(np.float32)
        inf = 1 << 62
        key = np.concatenate([[inf], np.where(cross, inf, apart), [inf]]).astype(np.int64)
        node = np.where(key[:-1] < key[1:], np.arange(n) - 1, np.arange(n))
        node[(key[:-1] == inf) & (key[1:] == inf)] = -1
        under, on_right = mass.copy(), node < np.arange(n)
        while len(at := np.flatnonzero((node >= 0) & ~np.append(rich, True)[node])):
            under[at] = left[node[at]] + right[node[at]]
            on_right[at], node[at] = self.right[node[at]], self.up[node[at]]
        under = np.where(node < 0, whole, under)
        self.leaf[order], self.on_right[order], self.rest[order] = node, on_right, np.log10(mass / under)

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Word ids; from tail_id on for words that aren't in the lexicon."""
        p = (keys >> U(64 - PREFIX)).astype(np.int64)
        at, end = self.first[p].astype(np.int64), self.first[p + 1]
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        other = np.flatnonzero(out < 0)
        out[other] = self.tail_id + (mixed(keys[other]) >> U(40)).astype(np.int64) % TAILS
        return out


ENCODED = "uid long, doc_id long, learn boolean, ids binary, unknown binary"


def encoded(docs: DataFrame, lexicon) -> DataFrame:
    """(uid, doc_id, learn, ids, unknown) of each document (doc_id, text, learn): the ids of its words
    with the end, and the keys of those that aren't in the lexicon. Later passes read these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, uid = lexicon.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for i, j, w in words_of(batch.column("text")):
                n = j - i
                at = np.arange(len(w.hash)) + np.repeat(np.arange(n), np.diff(w.of))
                keys = np.full(len(w.hash) + n, END, np.uint64)
                keys[at] = w.hash & KEY
                bounds = w.of + np.arange(n + 1)
                ids = lex.ids(keys)
                new = np.flatnonzero(ids >= lex.tail_id)
                of = np.searchsorted(new, bounds)
                cols = [batch.column(c).slice(i, n) for c in ("doc_id", "learn")]
                yield pa.record_batch([pa.array(np.arange(uid, uid + n)), *cols, cut(ids.astype(np.int32), bounds), cut(keys[new], of)], names=[x.split()[0] for x in ENCODED.split(", ")])
                uid += n

    return stored(docs.mapInArrow(run, ENCODED), "ids")


def cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An array's bytes as a binary value for each part."""
    raw, at = values.tobytes(), (bounds * values.itemsize).tolist()
    return pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())


def rejoined(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values and bounds that cut() had."""
    parts = column.to_pylist()
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(parts), dtype), np.concatenate([[0], np.cumsum(size)])


class Sequence:
    """Word ids of texts with their ends (flat, with bounds), and features of each position's
    context."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, lexicon: Lexicon):
        self.size = np.diff(bounds)
        self.all = np.full(len(ids) + 3 * len(self.size), lexicon.start_id, np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(ids)) + 3 * (self.doc + 1)
        self.all[self.at] = ids
        self.ids, self.lexicon = self.all[self.at], lexicon

    def features(self, a: int, b: int) -> list[np.ndarray]:
        """Rows of the weights for positions a to b."""
        at, lex = self.at[a:b], self.lexicon
        one, two, three = (self.all[at - k] for k in (1, 2, 3))
        x, y, z = lex.slots[0][one].astype(np.int64), lex.slots[1][two].astype(np.int64), lex.slots[2][three].astype(np.int64)
        pair = (x * 40503 + lex.slots[0][two].astype(np.int64) * 30011 >> 3) % BUCKETS
        last = (lex.class_of[one] * CLASSES + lex.class_of[two]) * CLASSES + lex.class_of[three]
        return [x, BUCKETS + y, 2 * BUCKETS + z, 3 * BUCKETS + pair, KINDS * BUCKETS + last]


def steps(s: Sequence, a: int, b: int, features: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Steps up the trees from the words of positions a to b: (positions less a, nodes, whether the
    word is on the right, weights' numbers by feature)."""
    lex = s.lexicon
    node, on_right = lex.leaf[s.ids[a:b]], lex.on_right[s.ids[a:b]]
    at = np.flatnonzero(node >= 0)
    node, on_right = node[at], on_right[at]
    mixes = [(features[f].astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15) for f in TREE_FEATURES]
    while len(at):
        turn = node.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)
        slots = [(((m[at] ^ turn) * U(0xD6E8FEB86659FD93)) >> U(45)).astype(np.int64) for m in mixes]
        yield at, node, on_right, slots
        on_right, node = lex.right[node], lex.up[node]
        more = node >= 0
        at, node, on_right = at[more], node[more], on_right[more]


class Model:
    """Weights of the class softmax and of the steps in the classes' trees."""

    def __init__(self, lexicon: Lexicon):
        self.bias = np.log(lexicon.prior).astype(np.float32)
        self.w = np.zeros((ROWS, CLASSES), np.float32)
        self.tree = np.zeros(TREE, np.float32)

    def right_odds(self, node: np.ndarray, slots: list[np.ndarray], lexicon: Lexicon) -> np.ndarray:
        z = lexicon.odds[node]
        for k in slots:
            z += self.tree[k]
        return z

    def log_within(self, s: Sequence, a: int, b: int, features: list[np.ndarray]) -> np.ndarray:
        """Log (base e) shares of words a to b within their classes, less `rest`."""
        out = np.zeros(b - a)
        for at, node, on_right, slots in steps(s, a, b, features):
            z = self.right_odds(node, slots, s.lexicon)
            out[at] -= np.log1p(np.exp(np.where(on_right, -z, z)))
        return out

    def add_tree(self, s: Sequence, a: int, b: int, features: list[np.ndarray], g: np.ndarray, spread: np.ndarray) -> None:
        """Add the gradient of the trees' weights, and its spread."""
        for _, node, on_right, slots in steps(s, a, b, features):
            q = 1 / (1 + np.exp(-self.right_odds(node, slots, s.lexicon)))
            off, wide = (on_right - q).astype(np.float64), (q * (1 - q)).astype(np.float64)
            for k in slots:
                np.add.at(g, k, off)
                np.add.at(spread, k, wide)

    def log_shares(self, features: list[np.ndarray]) -> np.ndarray:
        z = self.w[features[0]]
        for f in features[1:]:
            z += self.w[f]
        z += self.bias
        # Weights are bounded log ratios of counts and clipped steps, so no exponential overflows.
        z -= np.log(np.exp(z) @ np.ones((CLASSES, 1), np.float32))
        return z

    def started(self, seen: np.ndarray) -> Model:
        """Weights from counts of (feature, class): tempered log ratios to the classes' shares."""
        p = np.exp(self.bias.astype(np.float64))
        seen = seen.reshape(ROWS, CLASSES)
        n = seen.sum(1, keepdims=True)
        self.w = (START * (np.log((seen + PRIOR * p) / (n + PRIOR)) - np.log(p))).astype(np.float32)
        self.spread = np.maximum(n * p * (1 - p), 0).astype(np.float32)
        return self

    def stepped(self, total: np.ndarray) -> Model:
        gradient, g, spread = np.split(total, [ROWS * CLASSES, ROWS * CLASSES + TREE])
        gradient = gradient.reshape(CLASSES, ROWS).T
        self.tree += np.clip(TREE_STEP * g / (spread + PRIOR / 4), -2, 2).astype(np.float32)
        self.w += np.clip(STEP * gradient / (self.spread / ROUNDS + PRIOR / 4), -1, 1).astype(np.float32)
        return self


def chunks(s: Sequence) -> Iterator[tuple[int, int]]:
    return ((a, min(a + CHUNK, len(s.at))) for a in range(0, len(s.at), CHUNK))


def over(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[tuple[pa.RecordBatch, Sequence]]:
    """(rows, their sequence) of runs of encoded documents of about SLICE ids."""
    for batch in batches:
        size = pc.binary_length(batch.column("ids")).to_numpy() // 4
        upto, i = np.cumsum(size), 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + SLICE, "right")))
            some = batch.slice(i, j - i)
            yield some, Sequence(*rejoined(some.column("ids"), np.int32), lexicon)
            i = j


def pass_over(ids: DataFrame, lexicon, size: int, add: Callable[[Sequence, np.ndarray], None]) -> np.ndarray:
    """Sum over all encoded documents of what add() adds to a table of `size` numbers. Each task
    hands on a table, so tasks read 16 MB of ids or more, unless cores would be idle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64)
        for _, s in over(batches, lexicon.value):
            add(s, total)
        if total.any():
            yield blocked(total, BLOCKS)

    few = ids.coalesce(n_parts(ids, 16 << 20, least=ids.sparkSession.sparkContext.defaultParallelism))
    return totals(few.select("ids").mapInArrow(run, SUMS), BLOCKS, size)


def train(ids: DataFrame, lex) -> Model:
    """The model of all encoded documents that are learnt from: counts, then a gradient update in
    each round from the documents that are its turn. lex: the broadcast lexicon."""
    context, learn, lexicon = ids.sparkSession.sparkContext, ids.where("learn"), lex.value

    def count(s: Sequence, total: np.ndarray) -> None:
        own = s.lexicon.class_of[s.ids]
        for a, b in chunks(s):
            for f in s.features(a, b):
                low = int(f.min()) * CLASSES
                got = np.bincount(f * CLASSES + own[a:b] - low)
                total[low : low + len(got)] += got

    model = Model(lexicon).started(pass_over(learn, lex, ROWS * CLASSES, count))
    for k in range(ROUNDS):
        now = context.broadcast(model)

        def gradient(s: Sequence, total: np.ndarray, now=now) -> None:
            own, out = s.lexicon.class_of[s.ids], total[: ROWS * CLASSES].reshape(CLASSES, ROWS)
            for a, b in chunks(s):
                features = s.features(a, b)
                now.value.add_tree(s, a, b, features, *np.split(total[ROWS * CLASSES :], 2))
                off = -np.exp(now.value.log_shares(features))
                off[np.arange(b - a), own[a:b]] += 1
                each = np.ascontiguousarray(off.T, np.float64)
                for f in features:
                    low = int(f.min())
                    f = f - low
                    for k in range(CLASSES):
                        got = np.bincount(f, each[k])
                        out[k, low : low + len(got)] += got

        turn = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k)
        model = model.stepped(pass_over(turn, lex, ROWS * CLASSES + 2 * TREE, gradient))
    return model


def scored(ids: DataFrame, lex, model: Model, counts: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each encoded row. Words that aren't in the
    lexicon meet their exact counts in buckets of words, once for each document that has them."""
    net, lexicon = ids.sparkSession.sparkContext.broadcast(model), lex.value
    schema = f"uid long, doc_id long, n_tokens long, n_known long, base double, score double, {PACKED}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = lex.value, net.value
        base = np.concatenate([lexicon.base, np.zeros(TAILS + 1)])
        for rows, s in over(batches, lexicon):
            n = rows.num_rows
            score, own = lexicon.rest[s.ids], lexicon.class_of[s.ids]
            for a, b in chunks(s):
                features = s.features(a, b)
                z = model.log_shares(features)[np.arange(b - a), own[a:b]]
                score[a:b] += (z + model.log_within(s, a, b, features)) / np.log(10)
            known = np.bincount(s.doc, s.ids < lexicon.tail_id, minlength=n).astype(np.int64)
            sums = [np.bincount(s.doc, x, minlength=n) for x in (base[s.ids], score)]
            left, none = [rows.column("uid"), rows.column("doc_id"), *map(pa.array, (s.size.astype(np.int64), known, *sums))], pa.nulls(n)
            yield pa.record_batch([*left, none.cast(pa.int32()), none.cast(pa.int32()), *[none.cast(pa.binary())] * 3], names=names)
            keys, of = rejoined(rows.column("unknown"), np.uint64)
            if len(keys):
                uid = np.repeat(rows.column("uid").to_numpy(), np.diff(of))
                order = np.lexsort((keys, uid))
                keys, uid = keys[order], uid[order]
                first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (uid[1:] != uid[:-1])])
                times = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
                p = packed(bucket_of(keys[first], buckets), 1, keys[first], uid[first], times)
                m = pa.nulls(p.num_rows)
                yield pa.record_batch([*[m.cast(pa.int64())] * 4, *[m.cast(pa.float64())] * 2, *p.columns], names=names)

    out = stored(ids.mapInArrow(run, schema), "scored")
    below, base_below = float(lexicon.below[TAIL]), float(lexicon.base_below)

    def look_up(_: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_pylist()
        get = lambda c, k, dtype: np.frombuffer(b"".join(x for x, y in zip(t.column(c).to_pylist(), kind, strict=True) if y == k), dtype)
        words, count, asked, row, times = get("keys", 0, np.uint64), get("a", 0, np.int64), get("keys", 1, np.uint64), get("a", 1, np.int64), get("b", 1, np.uint32)
        c = np.zeros(len(asked))
        if len(words):
            at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
            c = np.where(words[at] == asked, count[at], 0)
        order = np.argsort(row, kind="stable")
        c, row, times = c[order], row[order], times[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x, first) if len(row) else np.zeros(0)
        return pa.table({"uid": pa.array(row[first], pa.int64()), "n_known": pa.array(add((c > 0) * times.astype(np.int64)).astype(np.int64)), "base": pa.array(add(times * np.log10((c + SMOOTH) / base_below)), pa.float64()), "score": pa.array(add(times * np.log10((c + SMOOTH) / below)), pa.float64())})

    asks = out.where("kind = 1").select("bucket", "kind", "keys", "a", "b").unionByName(counts)
    more = asks.groupBy("bucket").applyInArrow(look_up, "uid long, n_known long, base double, score double")
    rows = out.where("kind is null").select("uid", "doc_id", "n_tokens", "n_known", "base", "score")
    both = rows.unionByName(more, allowMissingColumns=True)
    return both.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("uid")


def score_documents(docs: DataFrame) -> tuple[DataFrame, int]:
    """Learn from the training fold of docs (doc_id, text) and score all rows; also the number of
    training tokens.

    Null texts count as empty: just the end. Repeated rows count and score each. Very long texts are
    scored whole, in chunks. Without training documents every token has the unknown word's whole
    share, log10 1 = 0; an empty table gives no rows. Extra columns aren't looked at."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("learn", train_fold())
    learn = docs.where("learn")
    buckets = n_parts(docs, 12 << 20, least=24)
    counts = word_counts(learn, *clustered(learn), buckets)
    lexicon = Lexicon(counts)
    lex = docs.sparkSession.sparkContext.broadcast(lexicon)
    ids = encoded(docs, lex)
    return scored(ids, lex, train(ids, lex), counts, buckets), lexicon.n


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' base and model scores."""
    out, n = score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~train_fold()).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
