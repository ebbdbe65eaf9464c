"""The commands end to end on small files."""

import json

import pytest

from versefold import cli
from versefold.sources import pages


def test_merge_split_vocabulary(spark, tmp_path):
    for name, n in (("genre-b", 20), ("genre-a", 10)):
        (tmp_path / f"{name}.csv").write_text("vi,cn\n" + "".join(f"{name[-1]}-vi-{i},{name[-1]}-cn-{i}\n" for i in range(n)))
    out = tmp_path / "out"
    a = cli.parser().parse_args(["split", "--input-dir", str(tmp_path), "--output-dir", str(out)])
    assert a.run(spark, a) == {"clean": 30, "train": 24, "test": 3, "val": 3}
    clean = (out / "poem.clean.csv").read_text().splitlines()
    assert clean[1] == "a-vi-0,a-cn-0" and clean[-1] == "b-vi-19,b-cn-19"
    parts = [x for n in ("train", "test", "val") for x in (out / f"poem.{n}.csv").read_text().splitlines()[1:]]
    assert sorted(parts) == sorted(clean[1:]) and parts[:24] != sorted(parts[:24])
    a = cli.parser().parse_args(["merge", "--input-dir", str(tmp_path), "--output", str(tmp_path / "all.csv")])
    assert a.run(spark, a) == {"files": 2, "rows": 30}
    assert a.run(spark, a) == {"files": 2, "rows": 30}
    a = cli.parser().parse_args(["vocabulary", "--train", str(out / "poem.train.csv"), "--output-dir", str(out)])
    a.run(spark, a)
    assert json.load(open(out / "vocab_vi.json"))["-"] == 4


def test_score_and_sitemap(spark, tmp_path):
    (tmp_path / "p.csv").write_text('vi,cn_ref,cn_pred\nx,天地人,天大仁人\n"a,b",天地,天地\n')
    a = cli.parser().parse_args(["score", "--predictions", str(tmp_path / "p.csv")])
    got = a.run(spark, a)
    assert (got["substitutions"], got["insertions"], got["exact_matches"], got["samples"]) == (1, 1, 1, 2)
    a.output_dir = str(tmp_path / "scores")
    assert a.run(spark, a)["cer"] == got["cer"]
    lines = (tmp_path / "scores" / "predictions.csv").read_text().splitlines()
    assert lines[0] == "vi,cn_ref,cn_pred,exact_match,edit_distance,substitutions,deletions,insertions,news_fscore"
    assert lines[2] == '"a,b",天地,天地,True,0,0,0,0,1.0' and lines[1].startswith("x,天地人,天大仁人,False,2,1,0,1,")
    saved = (tmp_path / "scores" / "metrics.json").read_text()
    assert saved.endswith("}\n") and json.loads(saved)["bleu_no_punct"] == got["bleu_no_punct"]
    (tmp_path / "s.xml").write_text("<loc>https://poems.example/A/poem-1</loc>\n<loc>https://poems.example/B/poem-2</loc>\n")
    a = cli.parser().parse_args(["filter-sitemap", "--xml-dir", str(tmp_path), "--author", "A"])
    assert a.run(spark, a) == {"s.xml": 1, "files": 1, "lines": 2, "removed": 1} and "/B/" in (tmp_path / "s.xml").read_text()


POEM = '<div class="poem-content"><div class="poem-view-separated"><p class="han-chinese">天<br>地</p><h4>Tựa</h4><p>một<br>hai</p></div></div>'


def parsed(*argv):
    return cli.checked(cli.parser(), [str(x) for x in argv])


def fetch_from(monkeypatch, page_of):
    """Pages without a network; returns the list of URLs that were asked for."""
    asked = []

    def get(urls, make):
        rows = []
        for r in urls.select("url").collect():
            asked.append(r.url)
            page = page_of(r.url)
            rows.append((r.url, page, None if page is not None else "stopped here"))
            if page is None:
                break
        return urls.sparkSession.createDataFrame(rows, "url string, html string, stopped string")

    monkeypatch.setattr(pages, "outcomes", get)
    monkeypatch.setattr(cli.discover, "fetched", lambda urls, make: get(urls, make).select("url", "html"))
    return asked


def test_checkpoint(spark, tmp_path, monkeypatch):
    urls = [f"https://poems.example/a/poem-{i}" for i in (1, 2)]
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": "url-partitions-v4", "source": "s", "urls": urls}))
    fetch_from(monkeypatch, lambda url: POEM)
    a = parsed("checkpoint", "--url-checkpoint", tmp_path / "c.json", "--source", "s", "--output-dir", tmp_path / "o", "--batch", 5)
    got = a.run(spark, a)
    assert (got["discovered_poems"], got["written_csv_files"], got["sentence_pairs"]) == (2, 2, 4)
    assert {p.name for p in (tmp_path / "o" / "poems").glob("name=*")} == {"name=tua", "name=tua-2"}
    a = parsed("plan", "--genre", "that-ngon-bat-cu")
    assert a.run(spark, a) == {"configured_results": 4575, "window_capacity": 1057}


def test_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    """A page that can't be had stops the run after all before it is saved; the next run asks only
    for what is left, and poems that were written stay."""
    urls = [f"https://poems.example/a/poem-{i}" for i in (1, 2, 3, 4)]
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": "url-partitions-v4", "source": "s", "urls": urls}))
    a = parsed("checkpoint", "--url-checkpoint", tmp_path / "c.json", "--source", "s", "--output-dir", tmp_path / "o")
    asked = fetch_from(monkeypatch, lambda url: None if url.endswith("3") else "no poem" if url.endswith("2") else POEM)
    with pytest.raises(pages.FetchError, match="stopped here"):
        a.run(spark, a)
    items = json.load(open(tmp_path / "o" / "progress.json"))["items"]
    assert {u[-1]: x["status"] for u, x in items.items()} == {"1": "written", "2": "skipped"} and len(asked) == 3
    report = json.load(open(tmp_path / "o" / "report.json"))
    assert [x["url"][-1] for x in report["skipped"]] == ["2"] and report["schema_version"] == "poem-report-v1" and report["discovered_poems"] == 4
    asked = fetch_from(monkeypatch, lambda url: POEM)
    got = a.run(spark, a)
    assert [u[-1] for u in asked] == ["3", "4"] and (got["written_csv_files"], got["skipped_poems"]) == (3, 1)
    assert {p.name for p in (tmp_path / "o" / "poems").glob("name=*")} == {"name=tua", "name=tua-3", "name=tua-4"}
    a.overwrite, asked = True, fetch_from(monkeypatch, lambda url: POEM)
    assert a.run(spark, a)["written_csv_files"] == 4 and len(asked) == 4
    assert {x["output"] for x in json.load(open(tmp_path / "o" / "progress.json"))["items"].values()} == {"tua", "tua-2", "tua-3", "tua-4"}


def test_crawl(spark, tmp_path, monkeypatch):
    listing = '<h4 class="list-item-header"><a href="/a/poem-1">A</a></h4><h4 class="list-item-header"><a href="/a/poem-2">B</a></h4>'
    monkeypatch.setattr(pages, "browser", lambda *x: lambda url: "")
    fetch_from(monkeypatch, lambda url: POEM if "/poem-" in url else listing)
    a = parsed("crawl", "--genre", "that-ngon-bat-cu", "--output-dir", tmp_path, "--limit", 2, "--batch", 9)
    got = a.run(spark, a)
    assert (got["discovered_poems"], got["written_csv_files"]) == (2, 2)
    assert pages.challenged('<div class="g-recaptcha">') and not pages.challenged('<div class="g-recaptcha"> list-item-header')
    monkeypatch.setattr(pages, "browser", lambda *x: lambda url: "User-agent: *\nDisallow: /")
    with pytest.raises(pages.FetchError, match="robots"):
        a.run(spark, a)


def test_discovery_goes_on(spark, tmp_path, monkeypatch):
    """A stopped discovery is saved; the next one asks only for open partitions, and a complete
    checkpoint is taken as it is."""
    from versefold.config import Genre
    from versefold.operators.discover import DiscoveryError

    genre = Genre("g", 7, ("2",), "shallow", {"2": {"52": 1, "53": 1}})
    path, of = str(tmp_path / "u.json"), lambda url: f'<h4 class="list-item-header"><a href="/a/poem-{url[-2:]}">A</a></h4>'
    (tmp_path / "u.json").write_text(json.dumps({"schema_version": "url-partitions-v4", "source": "g", "age_partition_counts": genre.ages, "completed_partitions": ["country=2&age=52"], "unresolved_partitions": [], "expected_total": 2, "country_ids": ["2"], "complete": False, "urls": ["https://poems.example/a/poem-52"]}))
    asked = fetch_from(monkeypatch, of)
    assert {r.url[-2:] for r in cli.discovered(spark, genre, None, path).collect()} == {"52", "53"}
    assert len(asked) == 1 and "Age%5B%5D=53" in asked[0]
    doc = json.load(open(path))
    assert doc["complete"] and doc["completed_partitions"] == ["country=2&age=52", "country=2&age=53"] and doc["partition_stats"]["country=2&age=53"] == {"collected_urls": 1, "new_unique_urls": 1}
    asked = fetch_from(monkeypatch, of)
    assert cli.discovered(spark, genre, None, path).count() == 2 and not asked
    changed = Genre("g", 7, ("2",), "shallow", {"2": {"52": 1, "53": 1, "54": 1}})
    assert cli.discovered(spark, changed, None, path).count() == 3 and len(asked) == 3
    full = Genre("h", 1, ("9",))
    (tmp_path / "h.json").write_text(json.dumps({"schema_version": "url-partitions-v4", "source": "h", "completed_partitions": [], "unresolved_partitions": [], "expected_total": 0, "complete": False, "urls": []}))
    with pytest.raises(DiscoveryError, match="no number"):
        cli.discovered(spark, full, None, str(tmp_path / "h.json"))


def test_bounds(capsys):
    base = ["crawl", "--genre", "phu", "--output-dir", "o"]
    for bad in (["--delay", "-1"], ["--timeout", "0"], ["--batch", "0"], ["--limit", "-3"], ["--pause-min", "9", "--pause-max", "8"], ["--challenge-pause-min", "2"], ["--retries", "x"]):
        with pytest.raises(SystemExit):
            parsed(*base, *bad)
    with pytest.raises(SystemExit):
        parsed("crawl", "--genre", "kinh-thi", "--output-dir", "o")
    assert parsed(*base).delay == 5.0


def test_author_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# people\n\nA%20B\nhttps://poems.example/C/poem-1\n")
    assert {r.author for r in cli.given_authors(spark, ["D/x"], [str(tmp_path / "a.txt")]).collect()} == {"A B", "C", "D"}
    (tmp_path / "b.txt").write_text("A\n\n/\n")
    with pytest.raises(ValueError, match="b.txt:3: an author"):
        cli.given_authors(spark, [], [str(tmp_path / "b.txt")])
    with pytest.raises(ValueError, match="at least one"):
        cli.given_authors(spark, [], [])
