"""Readers, vocabulary, encoding, splits, ordering, sets, collection, pages, sinks, streaming."""

import hashlib
import http.server
import json
import os
import random
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from versefold.config import SITE
from versefold.functions import scores, text, urls
from versefold.operators import collect, encode, ordering, sets, split, vocab
from versefold.sources import pages, pairs, sinks, state
from versefold.streaming import pages as stream


def write(path, body, encoding="utf-8"):
    path.write_text(body, encoding=encoding, newline="")
    return str(path)


# --- readers


def test_policies(spark, tmp_path):
    good = write(tmp_path / "a.csv", "vi,ch\n　một ,一\n,\nhai,\"二, 三\"\n")
    rows = pairs.read_pairs(spark, [good]).orderBy("row_idx").collect()
    assert [(r.vi, r.cn) for r in rows] == [("một", "一"), ("hai", "二, 三")]
    with pytest.raises(pairs.PairFileError, match="blank"):
        pairs.read_pairs(spark, [good], "merge")
    half = write(tmp_path / "b.csv", "vi,cn\na,b\nc,\n")
    with pytest.raises(pairs.PairFileError, match="b.csv:3: half"):
        pairs.read_pairs(spark, [half])
    assert pairs.read_pairs(spark, [half], "lenient").count() == 1
    wide = write(tmp_path / "c.csv", "vi,cn\na,b,c\n")
    with pytest.raises(pairs.PairFileError, match="width"):
        pairs.read_pairs(spark, [wide])
    with pytest.raises(pairs.PairFileError, match="expected CSV header"):
        pairs.read_pairs(spark, [write(tmp_path / "d.csv", "source,target\na,b\n")])
    bom = write(tmp_path / "e.csv", "vi,cn\na,b\n", "utf-8-sig")
    assert pairs.read_pairs(spark, [bom]).count() == 1
    with pytest.raises(pairs.PairFileError):
        pairs.read_pairs(spark, [bom], "merge")
    assert pairs.read_pairs(spark, [good, bom, wide.replace("c.csv", "e.csv")], limit=2).count() == 2
    assert [os.path.basename(p) for p in pairs.list_files(spark, str(tmp_path), "a.csv")] == ["b.csv", "c.csv", "d.csv", "e.csv"]
    with pytest.raises(FileNotFoundError):
        pairs.list_files(spark, str(tmp_path / "none"))


def test_typed_and_parallel(spark, tmp_path):
    assert pairs.read_typed(spark, write(tmp_path / "t.csv", "vi,cn\na,b\nNA,c\nd,\n")).count() == 1
    left, right = write(tmp_path / "l.txt", "a\nb\n"), write(tmp_path / "r.txt", "x\ny\n")
    assert [(r.line_no, r.left, r.right) for r in pairs.read_parallel_text(spark, left, right).orderBy("line_no").collect()] == [(0, "a", "x"), (1, "b", "y")]


def test_state(spark, tmp_path):
    doc = {"schema_version": "url-partitions-v4", "source": "s", "urls": ["a", "b", "a"], "completed_partitions": ["country=2"], "complete": False}
    path = write(tmp_path / "c.json", json.dumps(doc))
    assert [r.url for r in state.checkpoint_urls(state.checkpoint(spark, path, "s")).orderBy("url_idx").collect()] == ["a", "b"]
    assert state.checkpoint(spark, path, "other") is None
    assert state.checkpoint(spark, str(tmp_path / "no.json"), "s") is None
    with pytest.raises(state.StateError):
        state.checkpoint(spark, path, "other", fatal=True)
    items = {"schema_version": "p1", "source": "s", "items": {"u": {"status": "written", "output": "", "sentence_pairs": 3}}}
    row = state.progress(spark, write(tmp_path / "p.json", json.dumps(items)), "s", "p1").first()
    assert (row.url, row.status, row.output, row.sentence_pairs) == ("u", "written", None, 3)
    assert state.progress(spark, str(tmp_path / "no.json"), "s", "p1").count() == 0


# --- text, vocabulary, encoding


def test_tokens(spark):
    df = spark.createDataFrame([("Phiên phiên　bạch cưu",), ("a,b\\c。d【e】",), (None,), ("  ",)], "t string")
    out = [r[0] for r in df.select(text.tokenize_source(F.col("t"))).collect()]
    assert out == [["Phiên", "phiên", "bạch", "cưu"], ["a", ",", "b\\c", "。", "d【e】"], [], []]
    assert df.select(text.tokenize_target(F.col("t"))).collect()[1][0] == list("a,b\\c。d【e】")
    decomposed = spark.createDataFrame([("é  x",)], "t string")
    assert decomposed.select(text.normalize_text(F.col("t"))).first()[0] == "é x"


def test_vocabulary(spark):
    rows = spark.createDataFrame([(0, "b a b"), (1, "c a d <PAD>")], "row_idx long, t string")
    toks = F.split("t", " ")
    v = vocab.vocabulary(rows, toks)
    assert {r.token: r.id for r in v.collect()} == {"b": 4, "a": 5, "c": 6, "d": 7}
    new = spark.createDataFrame([(0, "a zz"), (1, "")], "row_idx long, t string")
    enc = vocab.encoded(new, text.tokenize_source(F.col("t")), v)
    assert {r.row_idx: r.ids for r in enc.collect()} == {0: [2, 5, 1, 3], 1: [2, 3]}
    dec = vocab.decoded(spark.createDataFrame([(0, [2, 5, 4, 0, 3, 99])], "row_idx long, ids array<int>"), F.col("ids"), v)
    assert dec.first().text == "a b <UNK>"
    c = vocab.coverage(new, text.tokenize_source(F.col("t")), v).first()
    assert (c.total_tokens, c.covered_tokens, c.token_coverage) == (2, 1, 50.0)
    assert vocab.coverage(new.limit(0), toks, v).first().unique_coverage == 0


def test_detokenize(spark):
    df = spark.createDataFrame([(["a", ",", "b", "。", "（", "c", "）"],)], "t array<string>")
    assert df.select(text.detokenize_source(F.col("t"))).first()[0] == "a, b。 （c）"


def test_padding_and_greedy(spark):
    rows = spark.createDataFrame([(0, [2, 5, 6, 3], [2, 7, 3]), (1, [2, 3], [2, 8, 9, 3])], "i long, s array<int>, t array<int>")
    out = {r.i: r for r in encode.collated(encode.batched(encode.examples(rows, "s", "t", 3, 3), "i", 2)).collect()}
    assert out[0].input_ids == [2, 5, 6] and out[1].input_ids == [2, 3, 0] and out[1].attention_mask == [1, 1, 0]
    assert out[0].decoder_input_ids == [2, 7] and out[0].labels == [7, 3]
    cut = rows.select(encode.truncated(F.col("s"), 3, True)).first()[0]
    assert cut == [2, 5, 3]

    def step(inputs, mask, out):
        scores = np.zeros((len(inputs), 10))
        scores[:, 7] = 1
        scores[inputs[:, 0] == 5, 3] = 2
        return scores

    assert encode.greedy(step, np.array([[5], [6]]), 3).tolist() == [[2, 3, 0, 0], [2, 7, 7, 7]]
    assert encode.greedy(step, np.array([[5]]), 3).tolist() == [[2, 3]]


# --- splits, order, sets


@pytest.mark.parametrize("n,want", [(10, [8, 1, 1]), (3, [1, 1, 1]), (20, [16, 2, 2]), (4, [2, 1, 1])])
def test_sizes(spark, n, want):
    assert spark.range(1).select(split.sizes(F.lit(n).cast("long"))).first()[0] == want


def test_size_errors(spark):
    with pytest.raises(Exception, match="at least 3 rows"):
        spark.range(2).groupBy().agg(F.count("*").alias("n")).select(split.sizes(F.col("n"))).collect()
    with pytest.raises(ValueError, match="sum to 1.0"):
        split.checked_ratios((0.8, 0.2, 0.1))
    with pytest.raises(ValueError, match="finite"):
        split.checked_ratios((float("nan"), 0.5, 0.5))


def test_split_partition(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(100, 120)], "g string, i long")
    one = {(r.g, r.i): r.split for r in split.split(rows, "g", "i").collect()}
    assert len(one) == 30 and sorted(one.values()).count("train") == 24
    more = rows.unionByName(spark.createDataFrame([("c", i) for i in range(5)], "g string, i long"))
    assert {k: v for k, v in ((((r.g, r.i)), r.split) for r in split.split(more, "g", "i").collect()) if k[0] != "c"} == one
    exact = split.exact_split(rows, "g", "i").collect()
    want = list(range(10))
    random.Random(split.exact_seed(42, "a")).shuffle(want)
    assert [r.i for r in sorted((r for r in exact if r.g == "a"), key=lambda r: r.rank)] == want


def test_stratum_seed(spark):
    got = spark.range(1).select(split.stratum_seed(F.lit("cau-doi.csv"))).first()[0]
    assert int(got) == split.exact_seed(42, "cau-doi.csv") == 12882616800314690287


def test_ordering(spark):
    urls_ = spark.createDataFrame([(f"u{i}",) for i in range(20)], "url string")
    small, large = ([r.url for r in ordering.sampled(urls_, "url", n).collect()] for n in (5, 10))
    assert large[:5] == small and small != [f"u{i}" for i in range(5)]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, seq int, v string")
    assert {r.k: (r.v, r.first_seq) for r in ordering.last_write(log, "k", "seq", ["v"]).collect()} == {"a": ("y", 1), "b": (None, 2)}
    assert ordering.prefix(log, ["seq"], 0).count() == 3 and ordering.prefix(log, ["seq"], 1).first().k == "a"


def test_sitemap(spark, tmp_path):
    u = lambda x: f"<loc>{SITE}/{x}</loc>\n"
    path = write(tmp_path / "m.xml", u("An-B%E1%BA%A3o/t/poem-x1") + u("An-B%E1%BA%A3o/author-z") + u("C+D/poem-x2") + "<loc>https://else.example/An-B%E1%BA%A3o/poem-1</loc>\n<x/>\r\n")
    authors = spark.createDataFrame([("An-Bảo",)], "author string")
    for scope, n in (("poem", 1), ("all", 2)):
        lines = sets.sitemap(sinks.read_lines(spark, path), authors, scope)
        assert sinks.rewrite_lines(lines, path, dry_run=True) == n
    before = open(path, newline="").read()
    sinks.rewrite_lines(sets.sitemap(sinks.read_lines(spark, path), authors, "poem"), path)
    assert open(path, newline="").read() == before.split("\n", 1)[1]
    assert spark.range(1).select(urls.normalize_author(F.lit(f"{SITE}/C+D/poem-1"))).first()[0] == "C+D"


# --- collection and pages


def test_plans(spark):
    df = spark.createDataFrame([(n,) for n in (3, 100, 101, 199, 200)], "results long")
    assert [r.s for r in df.select(collect.country_strategy(F.col("results"), F.lit(True)).alias("s")).collect()] == ["all-pages", "all-pages", "two-windows", "two-windows", "by-age"]
    keys = spark.createDataFrame([(k,) for k in ("country=2", "country=2&age=5", "country=29", "recovery-country-asc", "country=3&age=1&author_uid=x")], "key string")
    assert {r.key for r in collect.reopened(keys, ["2"]).collect()} == {"country=29", "country=3&age=1&author_uid=x"}
    assert {r.key for r in collect.migrated(keys).collect()} == {"country=29"}
    items = spark.createDataFrame([("country=29",), ("country=3",)], "partition string")
    assert [r.partition for r in collect.reopened_problems(items, ["2"]).collect()] == ["country=3"]
    assert [r.country for r in collect.countries_of(keys, ["10"]).collect()] == ["2", "10", "29"]
    w = collect.window_requests(spark.createDataFrame([(f"{SITE}/s?Country=2&Age%5B%5D=53",)], "url string")).orderBy("window").collect()
    assert w[0].window_url.endswith("&Sort=Date") and w[1].window_url.endswith("&Sort=Date&SortOrder=desc")


def test_resume(spark):
    urls_ = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    done = spark.createDataFrame([("a", "written", "a.csv", 2, None), ("b", "skipped", None, None, "bad"), ("c", "existing", "c.csv", None, None)], "url string, status string, output string, sentence_pairs long, error string")
    files = spark.createDataFrame([("a.csv",)], "path string")
    left = lambda **k: {r.url for r in collect.to_fetch(urls_, done, **k).collect()}
    assert left(files=files) == {"c", "d"} and left(trust=True) == {"d"} and left(trust=True, retry=True) == {"b", "d"} and left(overwrite=True) == set("abcd")
    r = collect.report(done, 4).first()
    assert (r.discovered_poems, r.written_csv_files, r.sentence_pairs, r.skipped_poems) == (4, 2, 2, 1)


POEM = '<div class="poem-content"><div class="poem-view-separated"><h4><span class="han-chinese">隱</span></h4><p class="han-chinese">天<sup>1</sup>地<br>人 和</p><h4>Ẩn <span>kỳ</span></h4><p>Thiên địa<br/>nhân &amp; hoà</p></div></div><h4>Dịch</h4><p>x</p>'


def test_poems(spark):
    df = spark.createDataFrame([(f"{SITE}/a/poem-X_1", POEM), (f"{SITE}/a/poem-2", "<p>"), (f"{SITE}/a/poem-3", POEM.replace("<br>", "")), (None, None)], "url string, html string")
    got = {r.url: r for r in pages.poems(df).collect()}
    one = got[f"{SITE}/a/poem-X_1"]
    assert (one.uid, one.title_vi, one.title_cn, one.lines_vi, one.lines_cn, one.error) == ("X_1", "Ẩn kỳ", "隱", ["Thiên địa", "nhân & hoà"], ["天地", "人 和"], None)
    assert got[f"{SITE}/a/poem-2"].error and got[f"{SITE}/a/poem-3"].error == "lines don't match" and got[None].error
    assert pages.pair_rows(pages.poems(df)).count() == 2


def test_result_pages(spark):
    page = '<h4 class="list-item-header"><a href="/a/poem-1">A</a></h4><h4 class="list-item-header"> <a href="/b/author-9">Nguyễn <i>Du</i> - 阮攸</a></h4><h4 class="list-item-header"><a href="/a/poem-1">A</a></h4><select name="Page"><option value="2"><option value="x"></select><a href="?q=1&amp;Page=12">l</a><select name="Country"><option value="3"><option value=""></select> tổng số 3 trang (1.057 bài thơ)'
    df = spark.createDataFrame([(page,), ("",)], "html string")
    h = F.col("html")
    r = df.select(pages.poem_links(h).alias("p"), pages.author_entries(h).alias("a"), pages.total_pages(h).alias("n"), pages.options(h, "Country").alias("c"), text.result_count(h).alias("k")).collect()
    assert r[0].p == [f"{SITE}/a/poem-1"] and r[0].a == {f"{SITE}/b/author-9": "Nguyễn Du"} and (r[0].n, r[0].c, r[0].k) == (12, ["3"], 1057)
    assert r[1].p == [] and (r[1].n, r[1].k) == (1, None)
    group = '<h4 class="poem-group-title"><a href="/g/1">S</a></h4><div class="poem-group-list"><a href="/x/poem-a">1</a><a href="/x/poem-b">2</a></div>'
    s, p = spark.createDataFrame([(group,)], "html string").select(*pages.group_links(h)).first()
    assert s == [f"{SITE}/g/1"] and p == [f"{SITE}/x/poem-a", f"{SITE}/x/poem-b"]


def test_stems(spark):
    df = spark.createDataFrame([("Ẩn kỳ lôi 1", "u"), ("Đường", "u"), ("隱", "u"), ("Bạch vân " * 100, "test_UID-123")], "t string, u string")
    got = [r[0] for r in df.select(text.filename_stem(F.col("t"), F.col("u"))).collect()]
    assert got[:3] == ["ankyloi1", "duong", None]
    assert len(got[3]) <= 180 and got[3].endswith("-test_UID-123")


def test_fetch_retries():
    waits, calls = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError
        return "page"

    none = pages.Pace(0, 0, 0)
    assert pages.patient(get, none, sleep=waits.append)("u") == "page" and waits == [1, 2]
    with pytest.raises(pages.FetchError):
        pages.patient(lambda u: "robot?", none, is_challenge=lambda p: True, sleep=waits.append)("u")
    waits.clear()
    seen = iter(["robot?", "robot?", "page"])
    pace = pages.Pace(0, 0, 0, challenge_retries=2, challenge_pause=(7, 7))
    assert pages.patient(lambda u: next(seen), pace, lambda p: p == "robot?", waits.append)("u") == "page" and waits == [7, 7]
    waits.clear()
    now = iter([0, 1, 1, 10, 10, 10.5, 10.5, 20, 20])
    paced = pages.patient(lambda u: u, pages.Pace(5, 0, 3, (400, 400)), sleep=waits.append, clock=lambda: next(now))
    assert [paced(u) for u in "abcd"] == list("abcd") and waits == [4, 400, 4.5]
    with pytest.raises(pages.FetchError, match="doesn't allow"):
        pages.check_allowed(lambda u: "User-agent: *\nDisallow: /search", f"{SITE}/search-poem.php")
    pages.check_allowed(lambda u: "", f"{SITE}/search-poem.php")


def test_cookies(tmp_path):
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Set-Cookie", "seen=1; Max-Age=1000")
            self.end_headers()
            self.wfile.write((self.headers.get("Cookie") or "new").encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, jar = f"http://127.0.0.1:{server.server_port}/", str(tmp_path / "state" / "jar")
    try:
        get = pages.browser(jar)
        assert (get(url), get(url), pages.browser(jar)(url), pages.browser()(url)) == ("new", "seen=1", "seen=1", "new")
    finally:
        server.shutdown()
    open(jar, "w").write("no cookies")
    with pytest.raises(pages.FetchError, match="cookie file"):
        pages.browser(jar)


def test_links_are_joined(spark):
    links = ["x", "/x", "./x", "../x", "/a/../b", "/a/./b/", "/a/b/..", "?q=1", "#f", "", "x?q#f", "//h/p", "http://o/p/../q", "mailto:a@b", "/../../x/.", "a/b/../../c", " /x "]
    got = spark.createDataFrame([(x,) for x in links], "h string").select(urls.absolute(F.col("h"))).collect()
    assert [r[0] for r in got] == [x if ":" in x else urllib.parse.urljoin(SITE, x.strip()) for x in links]


def test_long_edits(spark):
    df = spark.createDataFrame([("a" * 1500, "b" * 1500)], "ref string, pred string")
    assert tuple(df.select(scores.edit_counts(F.col("ref"), F.col("pred")).alias("e")).first().e) == (1500, 0, 0)
    short = spark.createDataFrame([("a" * 90, "b" * 60)], "ref string, pred string")
    assert tuple(short.select(scores.edit_counts_native(F.col("ref"), F.col("pred")).alias("e")).first().e) == (60, 30, 0)


def test_batches_and_masks(spark):
    rows = spark.range(100).withColumn("nll_sum", F.col("id").cast("double")).withColumn("n_tokens", F.lit(2))
    got = encode.shuffled(rows, "id", 16).orderBy("place").collect()
    assert [r.place for r in got] == list(range(100)) and [r.batch for r in got] == [k // 16 for k in range(100)]
    assert [r.id for r in got] == sorted(range(100), key=lambda i: hashlib.sha256(f"42\0{i}".encode()).hexdigest())
    assert encode.mean_batch_loss(encode.batched(rows, "id", 30)).first().mean_batch_loss == pytest.approx(sum(sum(range(a, min(a + 30, 100))) / 2 / len(range(a, min(a + 30, 100))) for a in range(0, 100, 30)) / 4)
    with pytest.raises(Exception, match="no batches"):
        encode.mean_batch_loss(encode.batched(rows.limit(0), "id", 30)).collect()
    masks = spark.range(3).select(encode.causal_mask(F.col("id").cast("int")).alias("m")).collect()
    assert [r.m for r in masks] == [[], [[1]], [[1, 0], [1, 1]]]
    assert [r.id for r in ordering.crossings(spark.range(16, 101, 16).unionByName(spark.range(100, 101)), "id", 100, 16, 40).collect()] == [48, 80, 100]


def test_taken_stems(spark):
    df = spark.createDataFrame([("a", "u1", 0), ("a", "u2", 1), ("b", "u3", 2)], "stem string, uid string, at int")
    taken = spark.createDataFrame([("b",)], "stem string")
    got = {r.uid: r.name for r in ordering.stem_names(df, "stem", "uid", "at", text.stem_with_uid, taken).collect()}
    assert got == {"u1": "a", "u2": "a-u2", "u3": "b-u3"}
    assert not pages.allowed("User-agent: *\nDisallow: /x", f"{SITE}/x/1") and pages.allowed("", f"{SITE}/x")
    assert [pages.retry_wait(k) for k in range(5)] == [1, 2, 4, 8, 8]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b,", True), (0, 'a"', None)], "i int, t string, f boolean")
    path = str(tmp_path / "o.csv")
    assert sinks.export_csv(df, path, ["i"]) == 2
    assert open(path).read() == 'i,t,f\n0,"a""",\n1,"b,",True\n'

    def broken():
        yield "x"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.write_whole(path, broken())
    assert open(path).read().startswith("i,t,f") and os.listdir(tmp_path) == ["o.csv"]
    v = spark.createDataFrame([("b", 2, 4)], "token string, freq long, id int")
    sinks.export_vocabulary(v, str(tmp_path / "v.json"))
    assert json.load(open(tmp_path / "v.json")) == {"<PAD>": 0, "<UNK>": 1, "<CLS>": 2, "<SEP>": 3, "b": 4}
    assert {r.token: r.id for r in state.vocabulary_json(spark, str(tmp_path / "v.json")).collect()}["b"] == 4
    poems = spark.createDataFrame([("p", 1, "c", "d"), ("p", 0, "a", "b")], "name string, pos int, vi string, cn string")
    sinks.write_poems(poems, str(tmp_path / "poems"))
    with pytest.raises(FileExistsError, match="p exists"):
        sinks.write_poems(poems, str(tmp_path / "poems"))
    other = poems.withColumn("name", F.lit("q r"))
    sinks.write_poems(other, str(tmp_path / "poems"))
    sinks.write_poems(poems.where("pos = 0"), str(tmp_path / "poems"), True)
    assert {r.name for r in sinks.existing_poems(spark, str(tmp_path / "poems")).collect()} == {"p", "q r"}
    back = spark.read.csv(str(tmp_path / "poems"), header=True)
    assert {(r.name, r.vi) for r in back.collect()} == {("p", "a"), ("q r", "a"), ("q r", "c")}
    assert sinks.existing_poems(spark, str(tmp_path / "none")).count() == 0
    for said in ("a\nb\n", "a\n\nb", ""):
        (tmp_path / "l.txt").write_text(said)
        lines = sinks.read_lines(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()
        assert "".join(r.value for r in lines) == said


def test_stream(spark, tmp_path):
    inbox, at, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    df = spark.createDataFrame([(f"{SITE}/a/poem-1", POEM), (f"{SITE}/a/poem-2", "")], "url string, html string")
    df.coalesce(1).write.parquet(inbox)
    stream.follow(spark, inbox, at, mark).awaitTermination()
    df.limit(1).withColumn("url", F.lit(f"{SITE}/a/poem-2")).coalesce(1).write.mode("append").parquet(inbox)
    stream.follow(spark, inbox, at, mark).awaitTermination()
    assert {r.url[-1]: (r.status, r.sentence_pairs) for r in stream.latest(spark, at).collect()} == {"1": ("written", 2), "2": ("written", 2)}
