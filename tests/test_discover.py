"""Discovery against a small made-up site that shows ten pages of ten results at most."""

import re
from urllib.parse import parse_qs, urlsplit

import pytest

from versefold.config import SITE, Genre
from versefold.operators.discover import Discovery, DiscoveryError, group_tree, limited
from versefold.sources import state


def site():
    """(poem, country, age, author): country 9 small, 8 by two windows, 2 by periods and authors."""
    rows = [(f"n{i}", "9", None, "z") for i in range(23)] + [(f"e{i}", "8", None, "z") for i in range(150)]
    rows += [(f"t{i}", "2", "52", "z") for i in range(30)] + [(f"w{i}", "2", "53", "z") for i in range(120)]
    rows += [(f"a{i}", "2", "54", f"u{i % 5}") for i in range(260)] + [(f"x{i}", None, None, "z") for i in range(4)]
    return rows


def fetcher():
    rows = site()

    def fetch(url):
        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        page = int(q.get("Page", 1))
        if "search-author" in url:
            own = sorted({a for _, c, g, a in rows if c == q["Country"] and g == q["Age[]"]})
            said = f"tổng số 1 trang ({len(own)} tác giả)"
            items = [f'<h4 class="list-item-header"><a href="/x/author-{a}">{a} - b</a></h4>' for a in own]
            return said + "".join(items)
        own = [r for r in rows if ("Country" not in q or r[1] == q["Country"]) and ("Age[]" not in q or r[2] == q["Age[]"]) and ("IAuthor" not in q or r[3] == q["IAuthor"])]
        if q.get("Sort") == "Country":
            own.sort(key=lambda r: r[1] or "")
        if q.get("SortOrder") == "desc":
            own = own[::-1]
        last = min(10, -(-len(own) // 10)) or 1
        links = "".join(f'<a href="?q=1&amp;Page={k}">{k}</a>' for k in range(1, last + 1))
        head = f"tổng số {last} trang ({len(own)} bài thơ)" + '<select name="Country"><option value="9"><option value="8"><option value="2"></select>'
        return head + links + "".join(f'<h4 class="list-item-header"><a href="/p/poem-{r[0]}">p</a></h4>' for r in own[(page - 1) * 10 : page * 10])

    return fetch


def test_country_age(spark, tmp_path):
    d = Discovery(spark, Genre("g", 1), fetcher)
    got = {r.url.rsplit("-", 1)[1] for r in d.country_age().collect()}
    assert got == {r[0] for r in site()}
    assert d.is_complete() and d.problems().count() == 0
    path = str(tmp_path / "c.json")
    assert d.save(path, "g")
    doc = state.checkpoint(spark, path, "g")
    assert doc.first().complete and state.checkpoint_urls(doc).count() == len(site())
    assert {"country=8", "country=9", "country=2&age=52", "country=2&age=53", "country=2&age=54&author_uid=u0", "recovery-country-asc"} <= set(doc.first().completed_partitions)


def test_settings(spark):
    with pytest.raises(DiscoveryError, match="no countries"):
        Discovery(spark, Genre("g", 1, ("7",)), fetcher).country_age()
    wrong = Discovery(spark, Genre("g", 1, ("2",), "country-age", {"2": {"52": 31, "53": 120, "54": 260}}), fetcher)
    wrong.country_age()
    assert [r.partition for r in wrong.problems().collect()] == ["country=2&age=52"] and not wrong.is_complete()


def test_shallow(spark):
    asked = []

    def make():
        fetch = fetcher()
        return lambda url: fetch(url)

    d = Discovery(spark, Genre("g", 7, ("2",), "shallow", {"2": {"52": 30, "53": 120}}), make)
    assert d.shallow().count() == 150 and d.expected == 150
    with pytest.raises(DiscoveryError, match="configured"):
        d.shallow(["3"])
    assert asked == []


def test_limit_and_groups(spark):
    assert [r.url[-2:] for r in limited(spark, Genre("g", 1), fetcher, 3).collect()] == ["n0", "n1", "n2"]

    def make():
        pages = {f"{SITE}/g": '<h4 class="poem-group-title"><a href="/s1">S</a></h4>', f"{SITE}/s1": '<div class="poem-group-list"><a href="/x/poem-a">1</a><a href="/x/poem-b">2</a></div>'}
        return pages.__getitem__

    assert [re.sub(".*-", "", r.url) for r in group_tree(spark, f"{SITE}/g", make).orderBy("at").collect()] == ["a", "b"]
