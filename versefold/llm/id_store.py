"""Token ids in a content-addressed store: rolling-hash chunks, recipes, Merkle manifests.

Folder layout: coded/kind=1/ (name, ids: every distinct chunk once, named by the BLAKE2b-128 of its
bytes), recipes/ (block, doc_id, start, n_tokens, digests, root: in ascending doc_id order within and
across blocks; a root is that of the hash tree over the digests), manifest/ (block, number of
documents and tokens, root of the hash tree over its documents) and corpus/ (one row: width of an id,
number of documents and tokens, root of the hash tree over the blocks)."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versefold.llm.common import block_of, cut_points, joined, n_parts, shared_dir, stored, table, with_offsets
from versefold.llm.textscan import Words, text_slices

END_ID, WINDOW, LEAST, MASK, MOST = 1, 16, 64, 255, 2048
DIGEST = 16
#: Words that a Python worker remembers (about 100 bytes each), in a table of 2^SLOT_BITS slots.
CACHE_WORDS, SLOT_BITS = 1_000_000, 21
U = np.uint64
#: The normalizing steps and the pattern of vocabularies whose texts may be cut up.
APART = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
_coders: dict[str, Coder] = {}


class Coder:
    """Ids of texts by the tokenizers library, with a memory of the ids of words.

    Exact: a vocabulary whose file says so (see cuts_apart) drops white space and case and never
    merges over the border of ASCII letters and punctuation (apostrophes aside), so a text's ids are
    those of the runs between, one after another. With any other, texts are encoded whole. Each run is encoded by the library, once while it
    is remembered (by a 64-bit hash; the memory is emptied when full). Texts that hold a special
    token's name, where case does count, are encoded by the library as a whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = cuts_apart(self.tokenizer)
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or rb"(?!)", re.I)
        self.clear()

    def clear(self) -> None:
        self.used, self.known = 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.names = np.zeros(1 << SLOT_BITS, np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each known word, -1 for others: open addressing, all words at once."""
        out = np.full(len(h), -1, np.int64)
        slot, left = (h >> U(64 - SLOT_BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            at = self.slots[slot]
            hit = (at >= 0) & (self.names[slot] == h[left])
            out[left[hit]] = at[hit]
            more = (at >= 0) & ~hit
            left, slot = left[more], (slot[more] + 1) & (1 << SLOT_BITS) - 1
        return out

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(ids) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        new = slice(self.known, self.known + len(ids))
        self.length[new], self.start[new] = lengths, self.used + np.cumsum(lengths) - lengths
        numbers, slot = np.arange(new.start, new.stop), (h >> U(64 - SLOT_BITS)).astype(np.int64)
        while len(numbers):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = np.zeros(len(slot), bool)
            placed[free[one]] = True
            self.slots[slot[placed]], self.names[slot[placed]] = numbers[placed], h[placed]
            numbers, h, slot = numbers[~placed], h[~placed], (slot[~placed] + 1) & (1 << SLOT_BITS) - 1
        self.used, self.known = self.used + total, self.known + len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts that stand in data."""
        if not self.apart:
            return self.whole(data, offsets)
        w = Words(data, offsets, apart=True)
        at = self.find(w.hash)
        new = np.flatnonzero(at < 0)
        if len(new):
            h, first = np.unique(w.hash[new], return_index=True)
            if self.known + len(h) > CACHE_WORDS and self.known:
                self.clear()
                return self.encode(data, offsets)
            if len(h) > CACHE_WORDS:  # a text of very many different words: by the library alone
                return self.whole(data, offsets)
            raw, first = data.tobytes(), new[first]
            self.learn(h, [raw[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)])
            at[new] = self.find(w.hash[new])
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        where = np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], length)
        ids, bounds = self.flat[where], ends[w.of]
        if self.special.search(data):
            ids, bounds = self.with_special(data, offsets, ids, bounds)
        return ids, bounds

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        parts = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(parts)), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def with_special(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, parts = data.tobytes(), []
        for a, b, i, j in zip(offsets.tolist(), offsets[1:].tolist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
            text = raw[a:b]
            parts.append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32) if self.special.search(text) else ids[i:j])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def cuts_apart(tokenizer) -> bool:
    """Whether this is a vocabulary that knows no white space, case or words across the border of
    ASCII letters and punctuation: told by its file's normalizer, splitting pattern and model."""
    made = json.loads(tokenizer.to_str())
    normalizer, splitter, model = (made.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    split = (splitter.get("pretokenizers") or [{}])[0]
    steps = [x.get("type") for x in normalizer.get("normalizers") or []]
    told = steps, (split.get("pattern") or {}).get("Regex")
    return told == APART and (split.get("behavior"), split.get("invert")) == ("Removed", True) and model.get("type") == "BPE" and not model.get("dropout")


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def cuts_of(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 16 ids has its mask's bits clear."""
    h = _GEAR[ids & 0xFFFF] ^ (ids.astype(np.uint64) >> U(16))
    width = 1
    while width < WINDOW:
        shifted = h.copy()
        shifted[width:] += h[:-width] << U(width)
        h, width = shifted, 2 * width
    return np.flatnonzero(((h >> U(20)) & U(MASK)) == 0) + 1


def hashed(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=DIGEST).digest()


class Tree:
    """A binary hash tree over leaves that come one by one; an odd node moves up as it is. It holds
    one hash for each level."""

    def __init__(self):
        self.n, self.left = 0, []

    def add(self, leaf: bytes) -> None:
        node, k = hashed(b"\0", leaf), self.n
        while k & 1:
            node, k = hashed(b"\1", self.left.pop(), node), k >> 1
        self.left.append(node)
        self.n += 1

    def root(self) -> bytes:
        """All zeros without leaves."""
        out = self.left[-1] if self.left else bytes(DIGEST)
        for node in self.left[-2::-1]:
            out = hashed(b"\1", node, out)
        return out


def merkle(leaves: Iterable[bytes]) -> bytes:
    tree = Tree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


ENCODED = "kind int, name binary, doc_id long, block int, n_tokens long, digests binary, root binary, ids binary"


def encode_docs(path: str, kind: str):
    """(doc_id, block, text) to recipe rows (kind 0) and the task's distinct chunks (kind 1)."""
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        seen: set[bytes] = set()
        code = coder(path)
        for batch in batches:
            doc_ids, blocks = batch.column("doc_id").to_pylist(), batch.column("block").to_pylist()
            for i, j, data, offsets in text_slices(batch.column("text"), 1 << 20):
                ids, bounds = code.encode(data, offsets)
                ids = np.insert(ids, bounds[1:], END_ID)
                bounds = bounds + np.arange(len(bounds))
                at, all_cuts = bounds.tolist(), cuts_of(ids)
                near = np.searchsorted(all_cuts, bounds).tolist()
                stream = ids.astype(kind).tobytes()
                width = np.dtype(kind).itemsize
                rows: list[tuple] = []
                for d in range(j - i):
                    lo, hi, digests = at[d], at[d + 1], []
                    for c in [*all_cuts[near[d] : near[d + 1]].tolist(), hi]:
                        while c - lo >= LEAST or c == hi:
                            to = min(c, lo + MOST)
                            body = stream[lo * width : to * width]
                            name = hashlib.blake2b(body, digest_size=DIGEST).digest()
                            digests.append(name)
                            if name not in seen:
                                seen.add(name)
                                rows.append((1, name, None, None, None, None, None, body))
                            lo = to
                            if lo == c:
                                break
                    number += 1
                    rows.append((0, b"recipe" + task.to_bytes(6, "big") + number.to_bytes(6, "big"), doc_ids[i + d], blocks[i + d], at[d + 1] - at[d], b"".join(digests), merkle(digests), None))
                if len(seen) > 1_000_000:
                    seen.clear()
                types = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode all texts (null: empty, so only the end id) and write the store to a new folder. Any
    vocabulary file of the library will do; ids take two bytes if all fit.

    One shuffle brings equal chunks together, at most one of each from a task, so a text that a
    third of the rows share is no hot key. Rows that share a doc_id keep a recipe each, ordered
    by root; very long texts are one recipe of many chunks. An empty table gives empty folders.
    Extra columns aren't looked at."""
    kind = "<u2" if coder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    cuts = cut_points(docs, "doc_id", n_parts(docs, 16 << 20))
    rows = docs.select("doc_id", block_of(F.col("doc_id"), cuts).alias("block"), "text")
    coded = rows.mapInArrow(encode_docs(tokenizer, kind), ENCODED)
    once = coded.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("name"))).where("r = 1").drop("r")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/coded")
    spark = docs.sparkSession
    recipes = spark.read.schema(ENCODED).parquet(f"{path}/coded").where("kind = 0").select("doc_id", "block", "n_tokens", "digests", "root")
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    w = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = with_offsets(recipes, [], "block", F.col("n_tokens"), "before").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    placed = placed.select("block", "doc_id", "start", "n_tokens", "digests", "root")
    placed.repartition("block").sortWithinPartitions("block", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    block_roots(read_recipes(spark, path)).where("fault is null").drop("fault").write.parquet(f"{path}/manifest")
    corpus_root(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), kind).write.parquet(f"{path}/corpus")


MANIFEST = "block int, documents long, n_tokens long, root binary"


def block_roots(recipes: DataFrame) -> DataFrame:
    """(block, documents, n_tokens, root, fault) of each block, from its recipes in order: hash trees
    over documents' ids, places and roots. A recipe whose root isn't that of its digests, or which
    doesn't start where the one before ends, makes a row with a fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tree, tokens, end, rows = None, Tree(), 0, None, []
        for batch in batches:
            for b, doc, start, n, digests, root in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "start", "n_tokens", "digests", "root")), strict=True):
                if b != block:
                    if block is not None:
                        rows.append((block, tree.n, tokens, tree.root(), None))
                    block, tree, tokens, end = b, Tree(), 0, start
                if start != end or merkle(digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)) != root:
                    rows.append((b, None, None, None, f"recipe of document {doc} at {start}"))
                tree.add(b"%d %d %d " % (-1 if doc is None else doc, start, n) + root)
                tokens, end = tokens + n, start + n
        if block is not None:
            rows.append((block, tree.n, tokens, tree.root(), None))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["block", "documents", "n_tokens", "root", "fault"])

    return recipes.repartition("block").sortWithinPartitions("block", "start").mapInArrow(run, f"{MANIFEST}, fault string")


def corpus_root(manifest: DataFrame, kind: str) -> DataFrame:
    """One row: kind, documents, n_tokens, root of the blocks' hash tree. There are as many blocks as
    cut points at most (MOST_CUTS and one), so the driver may hold them."""
    blocks = manifest.orderBy("block").collect()
    leaf = lambda r: b"%d %d " % (r.documents, r.n_tokens) + bytes(r.root)
    row = (kind, sum(r.documents for r in blocks), sum(r.n_tokens for r in blocks), bytearray(merkle(map(leaf, blocks))))
    return manifest.sparkSession.createDataFrame([row], CORPUS)


CORPUS = "kind string, documents long, n_tokens long, root binary"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("block int, doc_id long, start long, n_tokens long, digests binary, root binary").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENCODED).parquet(f"{path}/coded").where("kind = 1").select("name", "ids")


def id_kind(spark: SparkSession, path: str) -> str:
    return spark.read.schema(CORPUS).parquet(f"{path}/corpus").first()["kind"]


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(block, fault) of all that differs from the manifests (none, if all is well): recipes whose
    root isn't that of their digests or which leave a gap, blocks whose root or numbers aren't the
    manifest's, and the corpus (no block) where its root isn't that of the manifest. Chunks are held
    against their names where they are read, by checksums and read_ids."""
    found = stored(block_roots(read_recipes(spark, path)), "roots")
    want = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    facts = lambda df, name: df.select("block", F.struct("documents", "n_tokens", "root").alias(name))
    both = facts(want, "want").join(facts(found.where("fault is null"), "found"), "block", "full")
    blocks = both.where("not (want <=> found)").select("block", F.lit("block").alias("fault"))
    corpus = spark.read.schema(CORPUS).parquet(f"{path}/corpus")
    whole = corpus.exceptAll(corpus_root(want, id_kind(spark, path))).select(F.lit(None).cast("int").alias("block"), F.lit("corpus").alias("fault"))
    return found.where("fault is not null").select("block", "fault").unionByName(blocks).unionByName(whole)


_TABLES: list[np.ndarray] = []


def shift_tables(bit: int) -> np.ndarray:
    """crc32 of a message moved 2^bit bytes on, as four tables by byte of the crc."""
    while len(_TABLES) <= bit:
        if not _TABLES:
            one = np.array([zlib.crc32(b"\0", x) ^ zlib.crc32(b"\0", 0) for x in (1 << np.arange(32)).tolist()], np.uint32)
        else:
            one = apply_tables(apply_tables((1 << np.arange(32)).astype(np.uint32), _TABLES[-1]), _TABLES[-1])
        t = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for k in range(8):
                t[byte] ^= np.where(np.arange(256) >> k & 1, one[8 * byte + k], 0).astype(np.uint32)
        _TABLES.append(t)
    return _TABLES[bit]


def apply_tables(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]


def moved_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part with this crc32 adds (by xor) to that of the whole, `after` bytes before its
    end: the law by which zlib combines checksums."""
    x, bit = crc.astype(np.uint32), 0
    while int(after.max(initial=0)) >> bit:
        on = (after >> bit & 1).astype(bool)
        x[on] = apply_tables(x[on], shift_tables(bit))
        bit += 1
    return x


def check_chunks(kind: str):
    """(name, ids) to (name, n, crc of the ids as 32-bit integers); a body that doesn't have its
    name fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, crc = batch.column("name").to_pylist(), [], []
            for name, body in zip(names, batch.column("ids").to_pylist(), strict=True):
                if hashlib.blake2b(body, digest_size=DIGEST).digest() != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(body, kind)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["name", "n", "crc"])

    return run


def add_moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = batch.column("crc").to_numpy(), batch.column("after").to_numpy()
        yield pa.record_batch([batch.column("root"), batch.column("n"), pa.array(moved_crc(crc, 4 * after).astype(np.int64))], names=["root", "n", "part"])


def referred(recipes: DataFrame, chunks: DataFrame, *keep: str) -> DataFrame:
    """Rows of the recipes' chunks (keep, at, and the chunks' columns); a chunk that isn't there
    fails the job."""
    size = F.lit(DIGEST)
    part = F.transform(F.sequence(F.lit(0), (F.length("digests") / size - 1).cast("int")), lambda i: F.substr(F.col("digests"), i * size + 1, size))
    refs = recipes.select(*keep, F.posexplode(part).alias("at", "name")).join(chunks.withColumn("there", F.lit(True)), "name", "left")
    fault = F.raise_error(F.concat(F.lit("no chunk "), F.hex("name")))
    return refs.withColumn("at", F.when(F.col("there"), F.col("at")).otherwise(fault.cast("int"))).drop("there")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: every chunk is read and verified
    once; a document's checksum is put together from its chunks', equal recipes once."""
    recipes = read_recipes(spark, path)
    chunks = read_chunks(spark, path).mapInArrow(check_chunks(id_kind(spark, path)), "name binary, n long, crc long")
    distinct = recipes.groupBy("root").agg(F.min("digests").alias("digests"))
    sized = stored(referred(distinct, chunks, "root").select("root", "at", "n", "crc"), "refs")
    behind = Window.partitionBy("root").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    after = sized.select("root", "n", "crc", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("after"))
    whole = after.mapInArrow(add_moved, "root binary, n long, part long").groupBy("root").agg(F.sum("n").alias("n_tokens"), F.expr("bit_xor(part)").alias("ids_crc32"))
    return joined(recipes.select("doc_id", "start", "root"), whole, "root", DIGEST).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's id stream put together again."""
    kind = id_kind(spark, path)
    refs = referred(read_recipes(spark, path), read_chunks(spark, path), "doc_id", "start")
    whole = refs.groupBy("doc_id", "start").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p), kind).astype(np.int32) for p in b.column("parts").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.mapInArrow(run, "doc_id long, start long, ids array<int>")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids into a store in the shared folder, which is verified, and their checksums
    from it."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/id-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    if faults := verify(spark, path).limit(5).collect():
        raise ValueError(f"the store differs from its manifests: {faults}")
    return checksums(spark, path)
