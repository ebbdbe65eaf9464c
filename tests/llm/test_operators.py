"""The ten operators against brute force on small fixtures, with nulls, empties, ties, repeats,
empty tables and extra columns."""

import hashlib
import html.parser
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versefold.llm import chat, decontamination, fingerprints, id_store, jaccard, maxent, mixing, quality, sharding, textscan, wrappers
from versefold.llm.common import block_of, cut_points, stored, table
from versefold.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = []
ODD = [
    (1, "The cat sat on the mat and the dog ran", "en", "a", 38),
    (1, "The cat sat on the mat and the dog ran", "en", "a", 38),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "nobody has an id here at all, no", "en", None, 10),
    (4, " \t\n ", "en", "b", 4),
    (5, "word", "en", "b", 4),
    (6, "é́ü 天地 <|endoftext|> it's “x”…. A.b!C,d 12", "fr", "a", 30),
    (7, "a " * 30_000, "en", "a", 60_000),
    (1, "another text under the same id as the first", "en", "b", 43),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators also use
        for c in ("size", "key", "tie", "sig", "block", "row", "score", "target"):
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def on_disk(spark, tmp_path, rows, name="documents"):
    """A folder of tables as queries take it."""
    frame(spark, rows).coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# --- helpers


def test_words():
    for t in [r[1] or "" for r in ODD]:
        raw = np.frombuffer(t.encode(), np.uint8)
        w = textscan.Words(raw, np.array([0, len(raw)]))
        want = t.encode().lower().split()
        assert [raw[a:b].tobytes().lower() for a, b in zip(w.start, w.end)] == want
        assert len(set(w.hash.tolist())) == len(set(want))


def test_blocks(spark):
    df = spark.createDataFrame([(i,) for i in [*range(0, 100, 3), None, 5, 5]], "doc_id long")
    cuts = cut_points(df, "doc_id", 7)
    assert cuts[-1] == 99 and set(cuts) <= set(range(0, 100, 3)) | {5}
    for r in df.select("doc_id", block_of(F.col("doc_id"), cuts).alias("b")).collect():
        assert r.b == (0 if r.doc_id is None else sum(c < r.doc_id for c in cuts))
    assert cut_points(df.limit(0), "doc_id", 3) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 fingerprints


def test_fingerprints(spark, sf, texts):
    got = {r.doc_id: r for r in fingerprints.op1(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    assert set(got) == set(order)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        bits = bin(int(got[i].fingerprint, 16) ^ int(got[order[(k + 1) % len(order)]].fingerprint, 16)).count("1")
        assert got[i].near_next == pytest.approx(1 - bits / 64)
        assert got[i].near_edited == pytest.approx(1 - bin(int(got[i].fingerprint, 16) ^ int(got[i].edited_fingerprint, 16)).count("1") / 64)
    by_text = {}
    for i, r in got.items():
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
    for i, r in got.items():
        near = sum(bin(int(r.fingerprint, 16) ^ int(q.fingerprint, 16)).count("1") <= 3 for q in got.values())
        assert r.n_within == (near if i % 50 == 0 else None)


def plain_simhash(text):
    """64 signed votes by loops, with the hash that Spark's xxhash64 is."""
    votes, total = [0] * 64, 0
    for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
        if w:
            h, weight = xxhash.xxh64_intdigest(w.encode(), seed=42), max(1, min(8, len(w) - 2))
            total += weight
            for k in range(64):
                votes[k] += weight * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > total)


def test_fingerprint_values(spark, sf, texts, tmp_path):
    """Fingerprints of texts and edited texts are those of the plain form, also on odd rows."""
    order = sorted(texts, reverse=True)
    for r in fingerprints.op1(spark, sf).collect():
        t, nxt = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(t) // 2
        assert int(r.fingerprint, 16) == plain_simhash(t)
        assert int(r.edited_fingerprint, 16) == plain_simhash(t[: len(t) - half] + nxt[:half])
    got = Counter((r.doc_id, r.n_chars, int(r.fingerprint, 16)) for r in fingerprints.op1(spark, on_disk(spark, tmp_path, ODD)).collect())
    assert got == Counter((r[0], len(r[1] or ""), plain_simhash(r[1] or "")) for r in ODD)


def test_fingerprint_search(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    every = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    df = spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")
    got = {(r.query_fp, r.fp) for r in fingerprints.within_radius(df, df).collect()}
    assert got == {(a, b) for a, b in itertools.product(signed, signed) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}


@pytest.mark.parametrize("rows", [ODD, EMPTY, ODD[:1]])
def test_fingerprints_odd(spark, tmp_path, rows):
    got = fingerprints.op1(spark, on_disk(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


# --- 2 chat


def test_chat(spark, sf):
    got = {r.conv_id: r for r in chat.op2(spark, sf).collect()}
    said = "\\### Assistant: </turn> ok"
    turns = {-7: [("user", said), ("assistant", said)]}
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for c, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss))


ROUND = ["", "#", "##", "####", "\\", "\\\\#\\#", "</turn>", "</turn></turn>\n", "<\\/turn>", "### User: x</turn>\n### =a: ", "a\nb: c", "天  "]


def test_chat_round_trip(spark):
    rows = [(1, i, role, t) for i, (t, role) in enumerate(itertools.product(ROUND, ("user", "Assistant", "a: b", "", "=x", None)))] + [(2, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("size", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2] or "", r[3]) for r in rows[:-1]]
    assert out[1].formatted.count("</turn>") == len(rows) - 1
    assert [(t.role, t.text) for t in out[2].turns] == [("user", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    shapes = [
        ("conv_id long, messages array<struct<role:string,content:string>>", [(1, [("user", "q"), ("assistant", "a")])]),
        ("conv_id long, conversations array<struct<`from`:string,value:string>>", [(1, [("human", "q"), ("gpt", "a")])]),
        ("conv_id long, instruction string, input string, output string", [(1, "q", "", "a")]),
        ("conv_id long, prompt string, response string, extra int", [(1, "q", "a", 3)]),
        ("conv_id long, question string, answer string", [(1, "q", "a")]),
    ]
    for schema, rows in shapes:
        r = chat.format_chats(spark.createDataFrame(rows, schema)).first()
        assert [(t.role, t.text) for t in r.turns] == want, schema
    both = "conv_id long, messages array<struct<role:string,content:string>>, instruction string, input string, output string, question string, answer string"
    mixed = [(1, [("user", "q"), ("assistant", "a")], *[None] * 5), (2, None, "q", "", "a", None, None), (3, None, None, None, None, "q", "a"), (4, None, "q", None, "a", None, None), (5, *[None] * 6), (3, None, None, None, None, "q", "a")]
    got = Counter((r.conv_id, tuple((t.role, t.text) for t in r.turns)) for r in chat.format_chats(spark.createDataFrame(mixed, both)).collect())
    assert got == Counter([(i, tuple(want) if i != 5 else ()) for i, *_ in mixed])
    none = spark.createDataFrame([(1, None)], shapes[0][0])
    assert chat.format_chats(none).first().turns == []
    with pytest.raises(ValueError, match="no chat layout"):
        chat.format_chats(spark.createDataFrame([(1,)], "x long"))


# --- 3 decontamination


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    pick = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(pick(rng.randint(16, 50)))) for i in range(12)] + [(90, None), (91, "not in any of them")]
    rows, want = [], set()
    for d in range(60):
        t = pick(rng.randint(0, 300))
        if d % 3 == 0:
            item = items[d % 12][1].split()
            for k in range(5, len(item), 10):  # one in ten differs
                item[k] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = item
            want.add((d, d % 12))
        rows.append((d, " ".join(t), "en", "a", 1))
    rows += [(100, None, None, None, None), (101, "", "", "", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(frame(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = decontamination.clean(frame(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert kept.columns == frame(spark, rows).columns
    assert decontamination.contaminated(frame(spark, EMPTY), bench).count() == 0
    assert decontamination.contaminated(frame(spark, ODD), bench.limit(0)).count() == 0


def test_decontamination_blocks(spark, sf, monkeypatch):
    whole = sorted(map(tuple, decontamination.op3(spark, sf).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, decontamination.op3(spark, sf).collect())) == whole and whole


def plain_overlap(text, item):
    """Whether the longest spans with 80 % equal tokens of all diagonals, of 8 equal ones or enough,
    cover 13 tokens or 80 % of the item; short items stand there word for word."""
    if len(item) < 8:
        return bool(item) and any(text[k : k + len(item)] == item for k in range(len(text)))
    need, of_item, of_text = min(13, -(-len(item) * 4 // 5)), set(), set()
    for d in range(-len(item) + 1, len(text)):
        at = range(max(0, -d), min(len(item), len(text) - d))
        sums = [0, *itertools.accumulate(text[k + d] == item[k] for k in at)]
        spans = [(j - i, -i) for i, j in itertools.combinations(range(len(sums)), 2) if 5 * (sums[j] - sums[i]) >= 4 * (j - i)]
        n, i = max(spans, default=(0, 0))
        if sums[n - i] - sums[-i] >= min(8, need):
            on = [k for k in at[-i : n - i] if text[k + d] == item[k]]
            of_item.update(on)
            of_text.update(k + d for k in on)
    return min(len(of_item), len(of_text)) >= need


def test_decontamination_substitutions(spark):
    """10, 15 and 20 % of an item's tokens changed at random, and every fifth."""
    rng = random.Random(7)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate([8, 9, 10, 13, 15, 16, 17, 20, 30, 45, 59])]
    rows, want, d = [], set(), 0
    for share, (k, item), _ in itertools.product((10, 15, 20, 25, 0), enumerate(items), range(12)):
        off = rng.sample(range(len(item)), len(item) * share // 100) if share else range(rng.randrange(5), len(item), 5)
        t = [f"o{rng.random()}" if j in off else x for j, x in enumerate(item)]
        t = [f"o{rng.random()}" for _ in range(rng.randint(0, 9))] + t + ["end"] * rng.randint(0, 9)
        rows.append((d, " ".join(t), "en", "a", 1))
        if plain_overlap(t, item):
            want.add((d, k))
        d += 1
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontamination.contaminated(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(5 * r.n_matched >= 4 * (r.last_token - r.first_token) for r in got)


@pytest.mark.parametrize("longest", [12, 40])
def test_decontamination_plain(spark, longest, monkeypatch):
    """Few different tokens, short items and long repeats against the plain matcher."""
    rng = random.Random(longest)
    monkeypatch.setattr(decontamination, "PAIRS", 500)
    items = [[rng.choice("abc") for _ in range(rng.randint(1, longest))] for _ in range(25)] + [["a"] * 30, ["a", "b"] * 9]
    rows = []
    for d in range(50):
        t = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(t))
        t[at:at] = rng.choice([[], ["a"] * 150, ["a", "b"] * 80, ["a", "b", "c"] * 60, rng.choice(items)])
        rows.append((rng.choice([d, None]), " ".join(t), "en", "a", d))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    some = frame(spark, rows)
    want = Counter((i, k) for i, t, *_ in rows for k, x in enumerate(items) if plain_overlap(t.split(), x))
    assert Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(some, bench).collect()) == want
    kept = Counter((r.doc_id, r.text) for r in decontamination.clean(some, bench).collect())
    assert kept == Counter((i, t) for i, t, *_ in rows if not any(len(x) >= 5 and plain_overlap(t.split(), x) for x in items))


def test_decontamination_of_one_token_over_and_over(spark):
    raw = np.frombuffer(b"a " * 30_000, np.uint8)
    w = textscan.Words(raw, np.array([0, len(raw)]))
    start = time.monotonic()
    found = decontamination.overlaps([7], w, decontamination.Index([(1, "a " * 200)]))
    assert found == [(0, 7, 1, 200, 200, 0, 30_000)] and time.monotonic() - start < 3


def test_decontamination_masks_miss_nothing():
    """The most matches of a sequence without a hit, by its last bits, stay below 80 %."""
    bits = max(map(len, decontamination.MASKS)) - 1
    state, best = np.arange(1 << bits), np.where(np.arange(1 << bits) == 0, 0, -1000)
    for n in range(1, 200):
        now = np.full(1 << bits, -1000)
        for bit in (0, 1):
            full = state << 1 | bit
            hit = np.any([full & int(m, 2) == int(m, 2) for m in decontamination.MASKS], axis=0)
            np.maximum.at(now, full & (1 << bits) - 1, np.where(hit, -1000, best + bit))
        best = now
        assert n < 8 or 5 * best.max() < 4 * n


# --- 4 language model


def plain_base(rows):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*low(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        toks = [*low(t), None]
        yield i, held(i), len(toks), sum(counts[x] > 0 for x in toks), n, sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks)


@pytest.mark.parametrize("head", [1 << 19, 300])
def test_maxent(spark, sf, texts, monkeypatch, head):
    monkeypatch.setattr(maxent, "LEXICON", head)
    got = {r.doc_id: r for r in maxent.op4(spark, sf).collect()}
    gain = []
    for i, held, n, known, total, base in plain_base(list(texts.items())):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if held:
            gain.append(r.score - r.base_score)
    assert sum(gain) > 0


def trained(learn, change=None):
    lex = maxent.Lexicon(maxent.word_counts(learn, *maxent.clustered(learn), 8))
    if change:
        change(lex)
    sent = learn.sparkSession.sparkContext.broadcast(lex)
    return lex, maxent.train(maxent.encoded(learn.withColumn("learn", F.lit(True)), sent), sent)


def sequence(text, lex):
    keys = [np.uint64(textscan.word_hash(x)) & maxent.KEY for x in text.split()] + [maxent.END]
    return maxent.Sequence(lex.ids(np.array(keys, np.uint64)), np.array([0, len(keys)]), lex)


def test_maxent_is_a_distribution(spark, docs):
    """Shares of all known words and the unknown one add up to one after any context."""
    learn = docs.where(maxent.train_fold()).select("doc_id", "text")
    lex, model = trained(learn)
    for text in ("", "the of and", "zz der die und"):
        s = sequence(text, lex)
        share = np.exp(model.log_shares(s.features(len(s.at) - 1, len(s.at)))[0].astype(np.float64))
        total = sum(share[k] * (10 ** lex.within[lex.klass == k]).sum() for k in range(maxent.CLASSES - 1))
        tail = (lex.n - lex.count.sum() + 0.1 * (lex.v - len(lex.keys) + 1)) / lex.below[maxent.TAIL]
        empty = sum(share[k] for k in range(maxent.CLASSES - 1) if not (lex.klass == k).any())
        assert total + share[maxent.TAIL] * tail + empty == pytest.approx(1, abs=1e-3)


def test_maxent_words_within_class(spark):
    """A context prefers one word over another of its class and count; all of a class add up to 1."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["red fox", "blue hen"]) for _ in range(40)), "en", "a", 1) for i in range(200)]

    def one_class(lex):
        lex.klass[:] = lex.class_of[: len(lex.keys)] = 0
        lex.below[0] = (lex.count + maxent.SMOOTH).sum()
        lex.grow()

    lex, model = trained(frame(spark, rows).select("doc_id", "text"), one_class)
    s = sequence("red fox blue hen red", lex)
    fox, hen, k = s.ids[1], s.ids[3], 5
    share = np.zeros(len(lex.keys))
    for word in range(len(share)):
        s.ids[k] = word
        share[word] = np.exp(model.log_within(s, k, k + 1, s.features(k, k + 1))[0]) * 10 ** lex.rest[word]
    assert share.sum() == pytest.approx(1, abs=1e-5) and share[fox] > 3 * share[hen]


def plain_model(s, lex, rounds, turn):
    """Class weights of one sequence of texts by loops: counts, then a gradient from each round's
    texts; turn: the round of each text."""
    C, R = maxent.CLASSES, maxent.ROWS
    p, seen = lex.prior / lex.prior.sum() * lex.prior.sum(), np.zeros((R, C))
    feats = np.stack(s.features(0, len(s.at)), 1)
    own = lex.class_of[s.ids]
    for f, c in zip(feats, own):
        seen[f, c] += 1
    n = seen.sum(1, keepdims=True)
    w = maxent.START * (np.log((seen + maxent.PRIOR * p) / (n + maxent.PRIOR)) - np.log(p))
    spread = n * p * (1 - p)
    for r in range(rounds):
        g = np.zeros((R, C))
        for f, c, d in zip(feats, own, s.doc):
            if turn[d] == r:
                z = np.log(p) + w[f].sum(0)
                e = np.exp(z - z.max())
                g[f] -= e / e.sum()
                g[f, c] += 1
        w = w + np.clip(maxent.STEP * g / (spread / rounds + maxent.PRIOR / 4), -1, 1)
    return w


def test_maxent_against_plain_model(spark):
    """The distributed training's class weights are those of plain loops over one machine."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))), "en", "a", 1) for i in range(60)]
    df = frame(spark, rows).select("doc_id", "text").repartition(5)
    lex, model = trained(df)
    turn = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(maxent.ROUNDS))).collect()}
    parts = [sequence(t, lex).ids for _, t, *_ in rows]
    s = maxent.Sequence(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), lex)
    want = plain_model(s, lex, maxent.ROUNDS, [turn[i] for i, *_ in rows])
    assert np.abs(model.w - want).max() < 1e-3 and np.abs(want).max() > 0.1


def test_maxent_contexts_beyond_the_lexicon(spark, monkeypatch):
    """Words without an id of their own still tell as contexts which word comes next."""
    monkeypatch.setattr(maxent, "LEXICON", 3)
    rng = random.Random(11)
    after = {f"rare{k}": ("left", "right")[k % 2] for k in range(60)}
    rows = []
    for i in range(200):
        some = rng.choices(sorted(after), k=30)
        rows.append((i, " ".join(f"{x} {after[x]}" for x in some), "en", "a", 1))

    def one_class(lex):
        lex.klass[:] = lex.class_of[: len(lex.keys)] = 0
        lex.below[0] = (lex.count + maxent.SMOOTH).sum()
        lex.grow()

    lex, model = trained(frame(spark, rows).select("doc_id", "text"), one_class)
    assert len(lex.keys) == 3
    for x, word in after.items():
        share = {}
        for y in ("left", "right"):
            s = sequence(f"{x} {y}", lex)
            assert s.ids[0] >= lex.tail_id and s.ids[1] < lex.tail_id
            share[y] = model.log_within(s, 1, 2, s.features(1, 2))[0] + np.log(10) * lex.rest[s.ids[1]]
        assert share[word] > share[{"left": "right", "right": "left"}[word]] + 0.5


def test_maxent_scores_are_the_models(spark):
    """Scores of the query are the sums of the model's own log shares, unknown words included."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)) + [f"only{i}"] * (i % 3)), "en", "a", 1) for i in range(80)]
    rows += [(rows[5][0], *rows[5][1:]), (None, None, None, None, None)]
    df = frame(spark, rows)
    got = {(r.doc_id, r.n_tokens): r.score for r in maxent.score_documents(df)[0].collect()}
    lex, model = trained(df.select("doc_id", "text").where(maxent.train_fold()))
    for i, t, *_ in rows:
        s = sequence(t or "", lex)
        features = s.features(0, len(s.at))
        of = model.log_shares(features)[np.arange(len(s.at)), lex.class_of[s.ids]] + model.log_within(s, 0, len(s.at), features)
        rest = np.where(s.ids >= lex.tail_id, np.log10(maxent.SMOOTH / lex.below[maxent.TAIL]), lex.rest[s.ids])
        assert got[i, len(s.at)] == pytest.approx((of / np.log(10) + rest).sum(), rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("rows", [ODD, EMPTY, ODD[2:4]])
def test_maxent_odd(spark, rows):
    out, n = maxent.score_documents(frame(spark, rows))
    want = sorted(((i is None, i or 0), k, kn, round(b, 6)) for i, _, k, kn, _, b in plain_base([r[:2] for r in rows]))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out.collect())
    assert got == want


# --- 5 sharding


def test_sharding(spark, sf, texts):
    got = sharding.op5(spark, sf).collect()
    again = {r.doc_id: r for r in sharding.op5(spark, sf).collect()}
    counts = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(24))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None) and again[r.doc_id] == r


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 100, 1009])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    if n > 50:
        assert got != sorted(got)


def test_sharding_odd(spark):
    for rows in (ODD, EMPTY):
        some = frame(spark, rows).withColumns({"shard": F.lit("x"), "slot": F.lit("y")})
        out = sharding.sharded_documents(some).collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter(r[:2] for r in rows)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        counts = [len(slots.get(k, [])) for k in range(sharding.SHARDS)]
        assert max(counts) - min(counts) <= 1


# --- 6 wrappers

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>Head &amp; <em>more</em></h1><p>One<br>two &lt;b&gt; {x}<p><b>Three
 four<script>var t="</p>";</script> five.<ul><li>i<li>j</ul><aside>Side</aside><form><input>Name</form><div class="comments"><p>First!</p></div></article><footer>&copy; X</footer></body></html>"""
TEXT = "Head & more\nOne two <b> {x}\nThree four five.\ni\nj"


def test_wrappers(spark):
    rows = [(i, f"http://H.example:80/{i}", PAGE.replace("{x}", f"v{i}")) for i in range(12)]
    rows += [(50, None, None), (51, "http://h.example/e", ""), (52, "x", "<p>plain"), (53, "http://h.example/t", PAGE.replace("{x}", "v")[:-60]), (3, rows[3][1], rows[3][2]), (None, "http://h.example/q", "<article><p>deep" + "<div>" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = wrappers.extracted(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 12:
            assert r.text == TEXT.replace("{x}", f"v{r.page_id}")
    by = {r.page_id: r.text for r in got}
    assert by[50] == by[51] == "" and by[52] == "plain" and by[53] == TEXT.replace("{x}", "v") and by[None] == "deep"
    assert wrappers.extracted(df.limit(0)).count() == 0


def test_wrapper_shape():
    w = wrappers.infer(["<body><ul><li>a<li>b</ul><p>x</body>", "<body><p>y</body>"])
    (body,) = w["k"]
    ul, p = body["k"]
    assert (ul["m"], ul["k"][0]["m"], p["m"], p["k"][0]["c"]) == ("?", "+", "1", None)


def test_wrappers_joined(spark, sf, monkeypatch):
    whole = sorted(map(tuple, wrappers.op6(spark, sf).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, wrappers.op6(spark, sf).collect())) == whole
    for _, _, text, n in whole:
        assert n == len(text) and "<p>" not in text and "&amp;" not in text


def host_of_two_layouts(spark):
    """150 pages, ordered by the hash of page_id: the first 8 share an article line that differs on
    the others; twelve late ones have another layout with a line of the site's in it."""
    ids = [r.id for r in spark.range(150).orderBy(F.xxhash64("id")).collect()]
    rows, want = [], {}
    for k, i in enumerate(ids):
        line = "The same line." if k < 8 else f"Line {i}."
        want[i] = f"{line}\nText {i}."
        page = f"<body><article><div>{line}</div><p>Text {i}.</p></article></body>"
        if k >= 30 and k % 10 == 0:
            page = f"<body><main><div>Our site since 1999</div><p>Text {i}.</p></main></body>"
            want[i] = f"Text {i}."
        rows.append((i, "http://h.example/x", page))
    return spark.createDataFrame(rows, "page_id long, url string, html string"), want


def test_wrappers_of_all_pages(spark):
    df, want = host_of_two_layouts(spark)
    assert {r.page_id: r.text for r in wrappers.extracted(df).collect()} == want


def test_wrappers_merged_as_a_tree(spark, monkeypatch):
    df, want = host_of_two_layouts(spark)
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    for parts in (1, 13):
        assert {r.page_id: r.text for r in wrappers.extracted(df.repartition(parts)).collect()} == want


def test_wrapper_counts_bounded():
    """Odd pages don't hide the site's texts, and class words of single pages don't pile up."""
    page = lambda i: f"<article><div>Share this</div><p>Text {i}.</p><div class='{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'x' * (i // 100)}z'>Own {i}</div></article>"
    pages = [page(i) for i in range(400)] + ["", "<article><div>Share that</div><p>Text.</p></article>"]
    whole = wrappers.infer(pages)
    assert len(whole["k"][0]["k"]) <= wrappers.PARTS and len(whole["k"][0]["k"][0]["k"][0]["v"]) <= wrappers.CONSTANTS
    labels = wrappers.labelled(whole)
    assert [wrappers.extract(pages[i], labels) for i in (7, 399, 400, 401)] == ["Text 7.\nOwn 7", "Text 399.\nOwn 399", "", "Share that\nText."]


def test_wrappers_keep_the_article(spark):
    """Class words that only mention something set apart, recurring paragraphs, formulas."""
    say = lambda i: f"<p>Same words.</p><p>Own {i}.</p>"
    shapes = [
        lambda i: f"<body class='has-sidebar'><article class='no-sidebar'>{say(i)}</article></body>",
        lambda i: f"<article>{say(i)}<div class='promo-code-guide'>Guide {i}</div></article>",
        lambda i: f"<article>{say(i)}<math><mi>x</mi></math><object>Drawing</object></article>",
        lambda i: f"<main class='page-content with-comments'>{say(i)}<div class='post-comments'>Hi</div><div class='ad-slot-2'>Buy</div><p class='cookie-notice'>ok</p></main>",
    ]
    tails = ["", "\nGuide {}", "\nx\nDrawing", ""]
    rows = [(100 * k + i, f"http://h{k}.example/", shape(i)) for k, shape in enumerate(shapes) for i in range(20)]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, _, _ in rows:
        assert got[page] == f"Same words.\nOwn {page % 100}." + tails[page // 100].format(page % 100), page


def test_wrappers_deep_and_wide(spark):
    """5,000 elements inside one another, also around and in the article, and thousands in turn."""
    deep = lambda n: "".join(f"<div>t{k} " for k in range(n))
    wide = "".join(f"<h2>H{k}</h2><p>P{k}</p><ul><li>L</ul>" for k in range(3000))
    pages = [
        (1, "<body>" + deep(5000) + "</div>" * 5000 + "</body>", "\n".join(f"t{k}" for k in range(5000))),
        (2, "<body><nav>no</nav>" + "<div>" * 5000 + "<article><p>In</p><nav>no</nav>" + "<div>" * 300 + "x<aside>no</aside>y" + "</div>" * 300 + "z</article>out", "In\nx\ny\nz"),
        (3, f"<article>{wide}</article>", "\n".join(f"H{k}\nP{k}\nL" for k in range(3000))),
        (4, "<article>" + "</b></x></div>" * 5000 + "a</article>", "a"),
    ]
    rows = [(i + 10 * k, f"http://h{i}.example/", page) for i, page, _ in pages for k in range(3)]
    start = time.monotonic()
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, want in pages:
        assert got[i] == got[i + 20] == want, (i, got[i][:200])
    assert time.monotonic() - start < 60


def test_wrapper_groups():
    """Siblings that come in turn are one repeated group, and align with other numbers of them."""
    one = lambda n: "<body>" + "".join(f"<h2>a{k}</h2><p>b{k}</p>" for k in range(n)) + "<ul></ul></body>"
    body = wrappers.infer([one(3), one(40), one(2)])["k"][0]["k"]
    assert [(x["s"], x["m"], x.get("g")) for x in body] == [("h2", "+", 2), ("p", "+", 2), ("ul", "1", None)]


class Plain(html.parser.HTMLParser):
    """The article's blocks of well-formed pages, without any wrapper."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = False, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in wrappers.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.skip -= tag in ("script", "style")
        if tag not in wrappers.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_wrappers_of_the_table(spark):
    """All pages of the table against a plain parser."""
    sf_dir = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in wrappers.op6(spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert got[r.page_id] == "\n".join(t for b in plain.blocks if (t := " ".join(b.split()))), r.page_id


# --- 7 mixing


def plain_targets(sizes):
    """Shares by repeated capping."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weight.items() if s not in capped}
        rest = total - sum(capped.values())
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing(spark, sf, texts, docs):
    got = mixing.op7(spark, sf).collect()
    again = {r.doc_id: r.taken for r in mixing.op7(spark, sf).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    sums = Counter()
    for i, s in source.items():
        sums[s] += size[i]
    want = plain_targets(dict(sums))
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size and again[r.doc_id] == r.taken
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(texts)
    assert sum(abs(taken[s] - want[s]) < 0.05 * want[s] + 5 for s in want) >= 0.8 * len(want)


def sizes_of(spark, rows, machine=None):
    return mixing.measured(mixing.numbered(frame(spark, rows)), machine or quality.Machine())


def plain_mix(rows):
    """Rows (row, doc_id, source, size, tie, weight, u): how often each is taken, by the letter."""
    times = {}
    sums = {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + r.size
    target = plain_targets(sums) if sum(sums.values()) else {s: 0 for s in sums}
    for s in sums:
        own = sorted((r for r in rows if r.source == s), key=lambda r: (-math.log(r.u) / r.weight, r.doc_id is not None, r.doc_id, r.tie, r.size, r.row))
        epochs = int(target[s] / sums[s] + 1e-9) if sums[s] else 0
        budget, upto, drawn = target[s] - epochs * sums[s], 0, set()
        for r in own:
            upto += r.size
            if upto <= budget:
                drawn.add(r.row)
        for _ in range(2):
            gap = budget - sum(r.size for r in own if r.row in drawn)
            near = [r for r in own if r.row not in drawn and r.size and abs(gap - r.size) < abs(gap)]
            if near:
                drawn.add(min(near, key=lambda r: (abs(gap - r.size), r.doc_id is not None, r.doc_id, r.tie, r.row)).row)
        times |= {r.row: epochs + (r.row in drawn) for r in own}
    return times


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_draw(spark, sf, docs, seed):
    """Weights, order of the draw and closing picks against the plain form, with repeated rows."""
    rng = random.Random(seed)
    machine = quality.train(docs, table(spark, sf, "labels"))
    rows = [(rng.choice([k, k, None]), "w " * rng.randint(0, 30) + rng.choice(["", "and more", "%%% ###"]), "en", rng.choice("aaaaabbbc") if k % 9 else None, k) for k in range(150)]
    rows += [(7, "x " * 100, "en", s, 1) for s in "ab" for _ in range(40)]
    made = sizes_of(spark, rows, machine)
    u = (F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", "tie"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    plain = plain_mix(made.withColumn("u", u).collect())
    assert {r.row: r.times for r in mixing.mix(made).collect()} == plain and len(plain) == len(rows)
    assert len({r.weight for r in made.collect()}) > 20


def test_mixing_repeated_rows(spark):
    """Equal rows are drawn one by one, so the source's taken words come near its target."""
    rows = [(1, "w " * 100, "en", "a", 1)] * 40 + [(k, "w " * 100, "en", "b", 1) for k in range(60)]
    got = mixing.mix(sizes_of(spark, rows)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 100
    out = mixing.mixed_documents(frame(spark, rows), quality.Machine())
    assert Counter(r.source for r in out.collect()) == {s: n // 100 for s, n in taken.items()}


def test_mixing_caps(spark):
    rows = [(i, "w " * 10, "en", s, 1) for i, s in enumerate("a" * 2 + "b" * 50 + "c" * 40)] + [(900, "x", "en", None, 1), (901, None, "en", "d", None)]
    got = mixing.mix(sizes_of(spark, rows)).collect()
    want = plain_targets({"a": 20, "b": 500, "c": 400, None: 1, "d": 0})
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    assert sum(r.taken for r in got if r.source == "a") == 60
    for rows in (ODD, EMPTY):
        some = frame(spark, rows).withColumn("times", F.lit("x"))
        out = mixing.mixed_documents(some, quality.Machine())
        assert out.columns == some.columns
        plan = mixing.mix(sizes_of(spark, rows)).collect()
        assert len(plan) == len(rows) and out.count() == sum(r.times for r in plan)


# --- 8 Jaccard join


def plain_sets(texts):
    out = []
    for t in texts:
        q = (t or "").encode().lower().split()
        out.append(frozenset(tuple(q[k : k + 5]) for k in range(len(q) - 4)) if len(q) >= 5 else frozenset([tuple(q)]) if q else frozenset())
    return out


def plain_groups(rows):
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def near_copies(seed, families, size, edits):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"f{f}w{rng.randint(0, 400)}" for _ in range(rng.randint(12, 90))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [f"n{rng.random()}"], [t[k], f"n{rng.random()}"]])
            if rng.random() < 0.2:
                t = t[: int(len(t) * rng.uniform(0.6, 1))]
            out.append(" ".join(t))
    rng.shuffle(out)
    return [(i, t, "en", "a", 1) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,families,size,edits,small,direct", [(1, 12, 12, 4, 48, False), (2, 3, 60, 6, 8, True), (3, 2, 90, 5, 4, True)])
def test_jaccard(spark, monkeypatch, seed, families, size, edits, small, direct):
    """Also with lists counted as large early, so that pivots and differences do the work."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    if direct:
        monkeypatch.setattr(jaccard, "LONG_FROM", 3)
        links = jaccard.all_links
        monkeypatch.setattr(jaccard, "all_links", lambda *a: links(*a[:-1], 0))
    rows = near_copies(seed, families, size, edits)
    got = Counter(map(tuple, jaccard.groups(frame(spark, rows)).collect()))
    assert got == plain_groups([r[:2] for r in rows])


def test_jaccard_sf(spark, sf, texts):
    got = Counter(map(tuple, jaccard.op8(spark, sf).collect()))
    assert got == plain_groups(list(texts.items()))


def plain_links(rows):
    """(doc_id, shingles, smallest doc_id with the same set, other sets that link)."""
    sets = plain_sets([t for _, t in rows])
    distinct = {s for s in sets if s}
    links = {s: sum(s != o and 100 * len(s & o) >= 80 * len(s | o) for o in distinct) for s in distinct}
    least = {s: min((i for (i, _), o in zip(rows, sets, strict=True) if o == s and i is not None), default=None) for s in distinct}
    return Counter((i, len(s), least.get(s, i), links.get(s, 0)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("partners", [256, 7])
def test_jaccard_links(spark, monkeypatch, partners):
    """All links are counted, also when a group is dealt into several blocks."""
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    rows = near_copies(5, 4, 30, 5)
    rows += [(1000 + i, rows[i][1], "en", "a", 1) for i in range(9)] + ODD
    got = Counter(map(tuple, jaccard.link_counts(frame(spark, rows)).collect()))
    assert got == plain_links([r[:2] for r in rows])


def test_jaccard_blocks(spark, monkeypatch):
    """Lists that no longer shrink are compared in blocks, and lose no link."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "PARTNERS", 16)
    links, blocks, used = jaccard.all_links, jaccard.in_blocks, []
    monkeypatch.setattr(jaccard, "all_links", lambda *a: links(*a[:-1], 0))
    monkeypatch.setattr(jaccard, "LEVELS", 0)
    monkeypatch.setattr(jaccard, "in_blocks", lambda *a: used.append(1) or blocks(*a))
    rows = near_copies(6, 3, 40, 5)
    assert Counter(map(tuple, jaccard.groups(frame(spark, rows)).collect())) == plain_groups([r[:2] for r in rows]) and used


def sets_sent(monkeypatch):
    """How many sets each comparison sends to others, in turn."""
    counts, put = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, label: (out := put(df, label), counts.append(out.count()) if label == "sent" else None)[0])
    return counts


@pytest.mark.parametrize("direct", [False, True])
def test_jaccard_sends_by_family(spark, monkeypatch, direct):
    """Near copies that meet in very many lists are sent once for each two blocks, not once a pair
    or list, also where no round of pivots comes before."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    if direct:
        links = jaccard.all_links
        monkeypatch.setattr(jaccard, "LEVELS", 0)
        monkeypatch.setattr(jaccard, "all_links", lambda *a: links(*a[:-1], 0))
    rows = near_copies(12, 2, 140, 6)
    counts = sets_sent(monkeypatch)
    assert Counter(map(tuple, jaccard.groups(frame(spark, rows)).collect())) == plain_groups([r[:2] for r in rows])
    assert max(counts) <= 2 * len(rows)


@pytest.mark.parametrize("block,several", [(1 << 21, False), (400, True)])
def test_jaccard_large_blocks(spark, monkeypatch, block, several):
    """Blocks are as large as their shingles allow, so a family of many short sets is sent few
    times; sets in different blocks find their links too."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "PARTNERS", 8)
    monkeypatch.setattr(jaccard, "BLOCK", block, raising=False)
    monkeypatch.setattr(jaccard, "LEVELS", 0)
    links = jaccard.all_links
    monkeypatch.setattr(jaccard, "all_links", lambda *a: links(*a[:-1], 0))
    rows = near_copies(13, 2, 140, 6)
    counts = sets_sent(monkeypatch)
    assert Counter(map(tuple, jaccard.groups(frame(spark, rows)).collect())) == plain_groups([r[:2] for r in rows])
    assert (counts[-1] > len(rows)) == several and counts[-1] <= 8 * len(rows)


def test_jaccard_sends_near_misses_once(spark, monkeypatch):
    """Sets that share many shingles without a link are sent a few times each, not once a pair, and
    a link among them that no nearest pair shows is found."""
    monkeypatch.setattr(jaccard, "LONG_FROM", 1000)
    rng, rows = random.Random(14), near_copies(14, 3, 12, 3)
    for f in range(3):
        base = [f"m{f}w{k}" for k in range(120)]
        for _ in range(40):
            t = list(base)
            for k in rng.sample(range(120), rng.choice([1, 3, 6, 6, 6])):
                t[k] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(t), "en", "a", 1))
    counts = sets_sent(monkeypatch)
    assert Counter(map(tuple, jaccard.groups(frame(spark, rows)).collect())) == plain_groups([r[:2] for r in rows])
    assert max(counts) <= 3 * len(rows)


def test_one_each_sends_near_misses_once(spark, monkeypatch):
    """As the pipeline's stage near_duplicates calls it: all near misses stay, each sent a few times."""
    monkeypatch.setattr(jaccard, "LONG_FROM", 1000)
    rng, rows = random.Random(15), []
    for _ in range(40):
        t = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), 7):
            t[k] = f"n{rng.random()}"
        rows.append((len(rows), " ".join(t), "en", "a", 1))
    counts = sets_sent(monkeypatch)
    kept = {r.doc_id for r in jaccard.one_each(frame(spark, rows)).collect()}
    assert kept == {least for _, _, least in plain_groups([r[:2] for r in rows])} and max(counts) <= 3 * len(rows)


def test_bitmaps():
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 1 << 48, rng.integers(1, 9000), dtype=np.uint64)) for _ in range(6)]
    docs += [np.r_[docs[0][:-3], docs[1][:2]], docs[0]]
    maps = jaccard.bitmaps(docs)
    for x, y in itertools.combinations(range(len(docs)), 2):
        assert np.bitwise_count(maps[x] ^ maps[y]).sum() <= len(np.setxor1d(docs[x], docs[y]))
    assert (maps[0] == maps[-1]).all()


def test_pairs_in_bounded_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    size = rng.integers(2, 9, 60)
    first = np.cumsum(size) - size
    s = np.concatenate([np.sort(rng.choice(30, k, replace=False)) for k in size]).astype(np.uint64)
    n, weight = 10 + (s % 3).astype(np.int64), rng.integers(1, 4, 60)
    whole = [x.tolist() for x in jaccard.pairs_of(s, n, first, size, weight)]
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 20)
    assert [x.tolist() for x in jaccard.pairs_of(s, n, first, size, weight)] == whole


@pytest.mark.parametrize("rows", [ODD, EMPTY])
def test_jaccard_odd(spark, rows):
    got = Counter(map(tuple, jaccard.groups(frame(spark, rows)).collect()))
    want = plain_groups([r[:2] for r in rows])
    assert got == want
    kept = jaccard.one_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts == Counter({r[:2]: 1 for r in rows})  # none of them is near another but the repeated row


def test_one_each_by_row(spark):
    """Shared, repeated and null ids: a text stays once, whatever the ids of its copies."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (9, None), (9, None), (7, b)]
    kept = jaccard.one_each(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (7, b), (None, c), (9, None), (9, None)])


def test_t_occurrence():
    rng = np.random.default_rng(4)
    for _ in range(40):
        query = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        docs = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(12)]
        need = rng.integers(1, 25, len(docs))
        both = np.array([len(np.intersect1d(query, d)) for d in docs])
        assert (jaccard.t_occurrence(query, docs, need) == np.where(both >= need, both, 0)).all()


# --- 9 quality


def test_quality(spark, sf, docs):
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = {r.doc_id: r for r in quality.op9(spark, sf).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_machine_is_exact():
    m = quality.Machine()
    rng = np.random.default_rng(0)
    m.w[:] = rng.normal(size=len(m.w))
    m.b[0] = 0.3
    idx, val = rng.choice(quality.WIDTH, 9, replace=False), rng.normal(size=9).astype(np.float32)
    pairs = sum(float(m.v[a] @ m.v[b]) * x * y for (a, x), (b, y) in itertools.combinations(zip(idx, val), 2))
    raw = m.raw(np.array([0, 9]), idx, val)[0][0]
    assert raw == pytest.approx(0.3 + float(m.w[idx] @ val) + pairs, abs=1e-4)


def test_accepted_by_row(spark, sf, docs):
    """One row decides for itself alone, whatever ids it shares."""
    machine = quality.train(docs, table(spark, sf, "labels"))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()
    score = {r.doc_id: r.score for r in quality.scores(docs, machine).collect()}
    same = [((None, 1, 2)[k % 3], *r[1:]) for k, r in enumerate(rows)]
    kept = quality.accepted(frame(spark, same), machine)
    want = Counter(x[:2] for x, r in zip(same, rows) if score[r.doc_id] >= 0.5)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want and 0 < sum(want.values()) < 60
    for rows in (ODD, EMPTY):
        some = frame(spark, rows)
        out = quality.accepted(some, machine, 0.0)
        assert out.columns == some.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, some.collect()))


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (ODD, EMPTY):
        df = frame(spark, rows)
        for known in (labels, labels.limit(0)):
            out = quality.scores(df, quality.train(df, known)).collect()
            assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert quality.accepted(df, quality.train(df, labels)).columns == df.columns


# --- 10 id store


def plain_ids(rows):
    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        yield i, start, ids
        start += len(ids)


def test_id_store(spark, sf, texts):
    got = {r.doc_id: tuple(r) for r in id_store.op10(spark, sf).collect()}
    want = {i: (i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in plain_ids(sorted(texts.items()))}
    assert got == want


def test_id_store_odd(spark, tmp_path):
    rng = random.Random(5)
    marks = ["'s", "'", "it's.", "don't!", "<|endoftext|>", "<|EndOfText|>", "≮", "a≮", "é.", "…..", "x y", "İ", "12.5", "##a'b", "\x1c", "ß-ß"]
    rows = ODD + [(100 + k, "".join(rng.choices(marks + [" ", "\n", "word", "Big"], k=60)), "en", "a", 1) for k in range(30)]
    rows.append((200, " ".join(rng.choices(["alpha", "beta", "gamma"], k=9000)), "en", "a", 1))
    rows.append((201, rows[-1][1] + " end", "en", "a", 1))
    path = str(tmp_path / "store")
    id_store.write_store(frame(spark, rows), path, public_tokenizers.path("word_bpe_49k.json"))
    assert id_store.verify(spark, path).count() == 0
    back = id_store.read_ids(spark, path).collect()
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in id_store.checksums(spark, path).collect()}
    assert len(back) == len(rows)
    want = Counter((i, tuple(ids)) for i, _, ids in plain_ids([r[:2] for r in rows]))
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == want
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at and sums[(r.doc_id, r.start)] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    names = [r.name for r in id_store.read_chunks(spark, path).collect()]
    assert len(names) == len(set(names))
    id_store.write_store(frame(spark, EMPTY), str(tmp_path / "none"), public_tokenizers.path("word_bpe_49k.json"))
    assert id_store.checksums(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_id_store_of_any_vocabulary(spark, tmp_path, name):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(["Hello  World it's", " lead", "tail \n", "", None, "<|endoftext|>x", "é́ 天地 A.b!C"])]
    path, tokenizer = str(tmp_path / "store"), Tokenizer.from_file(public_tokenizers.path(name))
    id_store.write_store(frame(spark, rows), path, public_tokenizers.path(name))
    got = {r.doc_id: r.ids for r in id_store.read_ids(spark, path).collect()}
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    assert id_store.cuts_apart(tokenizer) == (name[0] == "w")


def test_id_store_finds_damage(spark, tmp_path):
    rows = [(i, " ".join(f"w{i % 7}x{k}" for k in range(200)), "en", "a", 1) for i in range(40)]
    path = str(tmp_path / "store")
    id_store.write_store(frame(spark, rows), path, public_tokenizers.path("word_bpe_49k.json"))
    assert id_store.verify(spark, path).count() == 0
    corpus = spark.read.parquet(path + "/corpus").first()
    assert (corpus.documents, corpus.n_tokens) == (40, sum(len(r.ids) for r in id_store.read_ids(spark, path).collect()))

    def changed(part, how):
        old = spark.createDataFrame(spark.read.parquet(f"{path}/{part}").collect(), spark.read.parquet(f"{path}/{part}").schema)
        how(old).write.mode("overwrite").parquet(f"{path}/{part}")
        found = {(r.fault or "").split()[0] for r in id_store.verify(spark, path).collect()}
        old.write.mode("overwrite").parquet(f"{path}/{part}")
        assert id_store.verify(spark, path).count() == 0
        return found

    one = F.col("doc_id") == 11
    swapped = F.expr("concat(substr(digests, 17), substr(digests, 1, 16))")
    assert changed("recipes", lambda d: d.withColumn("digests", F.when(one, swapped).otherwise(F.col("digests")))) == {"recipe"}
    assert changed("recipes", lambda d: d.where(~one)) >= {"block"}
    assert changed("manifest", lambda d: d.where("block <> 0")) >= {"block", "corpus"}
    assert changed("corpus", lambda d: d.withColumn("n_tokens", F.col("n_tokens") + 1)) == {"corpus"}
    coded = spark.read.parquet(path + "/coded/kind=1")
    kept = spark.createDataFrame(coded.collect()[1:], coded.schema)
    kept.write.mode("overwrite").parquet(path + "/coded/kind=1")
    with pytest.raises(Exception, match="no chunk"):
        id_store.checksums(spark, path).collect()


def test_hash_tree():
    """Leaves one by one give the root of the tree level by level."""
    for n in range(1, 40):
        level = [id_store.hashed(b"\0", b"%d" % k) for k in range(n)]
        while len(level) > 1:
            level = [id_store.hashed(b"\1", *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert id_store.merkle(b"%d" % k for k in range(n)) == level[0]


def test_crc_law():
    rng = np.random.default_rng(6)
    parts = [rng.bytes(n) for n in (0, 1, 3, 4096, 70_000)]
    after = np.cumsum([0, *map(len, parts[::-1])])[:-1][::-1]
    got = np.bitwise_xor.reduce(id_store.moved_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), after))
    assert got == zlib.crc32(b"".join(parts))
