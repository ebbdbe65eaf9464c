"""Pages: a paced fetching source with retries, and extraction of poems and links."""

from __future__ import annotations

import http.cookiejar
import os
import random
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versefold.config import CAPTCHA, CHALLENGE, DELAY, JITTER, ORDINARY_MARKS, PAUSE, PAUSE_EVERY, RETRIED, SITE
from versefold.functions.text import SPACE, text_lines
from versefold.functions.urls import absolute, author_uid, page_numbers, poem_uid, unescape_html

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


AGENT = "Mozilla/5.0"


class FetchError(RuntimeError):
    """A page that can't be had: the run stops, its state is kept."""


def retry_wait(attempt: int) -> int:
    """Seconds before a retry: 1, 2, 4, then 8."""
    return min(2**attempt, 8)


def http_get(url: str, opener=None, timeout: float = 30) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with (opener or urllib.request.build_opener()).open(request, timeout=timeout) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "strict")


def browser(cookie_file: str | None = None, timeout: float = 30) -> Callable[[str], str]:
    """A get function that keeps cookies, in a file if told: read at the start (a damaged one is an
    error), saved after each answer. Only the one task that fetches uses it."""
    jar = http.cookiejar.LWPCookieJar(cookie_file)
    if cookie_file and os.path.exists(cookie_file):
        try:
            jar.load(ignore_discard=True, ignore_expires=True)
        except (OSError, ValueError) as e:
            raise FetchError(f"{cookie_file}: not a cookie file: {e}") from e
    opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(jar))

    def get(url: str) -> str:
        page = http_get(url, opener, timeout)
        if cookie_file:
            os.makedirs(os.path.dirname(os.path.abspath(cookie_file)), exist_ok=True)
            jar.save(ignore_discard=True, ignore_expires=True)
        return page

    return get


@dataclass(frozen=True)
class Pace:
    """Seconds between requests and their jitter, a long pause every so many, retries, and what to do
    when the site asks for proof of a human."""

    delay: float = DELAY
    jitter: float = JITTER
    pause_every: int = PAUSE_EVERY
    pause: tuple[float, float] = PAUSE
    retries: int = 4
    challenge_retries: int = 0
    challenge_pause: tuple[float, float] = (0.0, 0.0)


def patient(get: Callable[[str], str], pace: Pace = Pace(), is_challenge: Callable[[str], bool] = lambda page: False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, done: int = 0) -> Callable[[str], str]:  # noqa: B008
    """A fetch function: every request, retries too, waits for its turn (done: requests before it).
    Busy answers, network and decoding errors are tried again; a page that asks for proof of a human
    isn't, but after a pause of its own; what is left is a FetchError."""
    last = clock() if done else None

    def asked(url: str) -> str:
        nonlocal done, last
        if pace.pause_every and done and done % pace.pause_every == 0:
            sleep(random.uniform(*pace.pause))
        if last is not None and (rest := pace.delay + random.uniform(0, pace.jitter) - (clock() - last)) > 0:
            sleep(rest)
        done, last = done + 1, clock()
        return get(url)

    def tried(url: str) -> str:
        for attempt in range(pace.retries + 1):
            try:
                return asked(url)
            except (urllib.error.URLError, TimeoutError, UnicodeDecodeError) as e:
                final = isinstance(e, urllib.error.HTTPError) and e.code not in RETRIED
                if final or attempt == pace.retries:
                    raise FetchError(f"{url}: {e}") from e
            sleep(retry_wait(attempt))
        raise AssertionError

    def fetch(url: str) -> str:
        for _ in range(pace.challenge_retries):
            if not is_challenge(page := tried(url)):
                return page
            sleep(random.uniform(*pace.challenge_pause))
        if is_challenge(page := tried(url)):
            raise FetchError(f"{url}: access challenge")
        return page

    return fetch


def challenged(page: str) -> bool:
    """text.is_access_challenge for a page just fetched."""
    return CHALLENGE in page or CAPTCHA in page and not any(m in page for m in ORDINARY_MARKS)


def allowed(robots_txt: str, url: str, agent: str = "*") -> bool:
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(robots_txt.splitlines())
    return parser.can_fetch(agent, url)


def check_allowed(fetch: Callable[[str], str], url: str, site: str = SITE) -> None:
    """Before anything else is fetched: whether the site's robots.txt lets us."""
    if not allowed(fetch(f"{site}/robots.txt"), url, AGENT):
        raise FetchError(f"robots.txt doesn't allow {url}")


def fetched(urls: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(url, html) of urls; `make` builds the fetch function in the one task that does the
    fetching, so that pacing holds for the whole run."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()
        for part in parts:
            yield pd.DataFrame({"url": part["url"], "html": [fetch(u) for u in part["url"]]})

    return urls.select("url").coalesce(1).mapInPandas(run, "url string, html string")


def outcomes(urls: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(url, html, stopped): like fetched, but the first page that can't be had is the last row, with
    the reason, so all before it are kept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()
        for part in parts:
            for url in part["url"]:
                try:
                    yield pd.DataFrame({"url": [url], "html": [fetch(url)], "stopped": [None]})
                except FetchError as e:
                    yield pd.DataFrame({"url": [url], "html": [None], "stopped": [str(e)]})
                    return

    return urls.select("url").coalesce(1).mapInPandas(run, "url string, html string, stopped string")


class Element:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Element | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def has(self, tag: str, klass: str | None = None) -> bool:
        return self.tag == tag and (klass is None or klass in self.attrs.get("class", "").split())

    def below(self) -> Iterator[Element]:
        for k in self.kids:
            if isinstance(k, Element):
                yield k
                yield from k.below()

    def find(self, tag: str, klass: str | None = None) -> Element | None:
        return next((e for e in self.below() if e.has(tag, klass)), None)

    def text(self) -> str:
        """All text: footnote marks left out, breaks as new lines."""
        if self.tag == "sup":
            return ""
        if self.tag == "br":
            return "\n"
        return "".join(k.text() if isinstance(k, Element) else k for k in self.kids)


class Tree(HTMLParser):
    """Elements as they are written: end tags close the nearest open element of their name."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        one = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.kids.append(one)
        if tag not in VOID:
            self.now = one

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.now.kids.append(Element(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag: str) -> None:
        at = self.now
        while at.up is not None and at.tag != tag:
            at = at.up
        if at.up is not None:
            self.now = at.up

    def handle_data(self, data: str) -> None:
        self.now.kids.append(data)


def poem_parts(page: str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """(title_vi, title_cn, vi, cn, error): raw texts of a poem page's original and reading."""
    root = Tree(page or "").root
    outer = root.find("div", "poem-content")
    part = outer.find("div", "poem-view-separated") if outer else None
    if part is None:
        return None, None, None, None, "no original and reading"
    kids = [k for k in part.kids if isinstance(k, Element)]
    heads = [k for k in kids if k.tag == "h4"]
    in_han = lambda h: next((e for e in h.below() if "han-chinese" in e.attrs.get("class", "").split()), None)
    head = next((h for h in heads if in_han(h) is None), None)
    han = part.find("p", "han-chinese")
    if han is None or head is None:
        return None, None, None, None, "no pair of texts"
    body = next((k for k in kids[kids.index(head) + 1 :] if k.tag == "p"), None)
    if body is None or body is han:
        return None, None, None, None, "no reading"
    title = next((x for h in heads if (x := in_han(h)) is not None), None)
    return head.text(), title.text() if title else None, body.text(), han.text(), None


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("title_vi", "title_cn", "vi", "cn", "error")]))
def _poem(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([poem_parts(p) for p in pages], columns=["title_vi", "title_cn", "vi", "cn", "error"])


def poems(pages: DataFrame, need_title_cn: bool = False) -> DataFrame:
    """(uid, url, title_vi, title_cn, lines_vi, lines_cn, error): one row a page; error says why a
    page has no poem."""
    rows = pages.select("url", _poem("html").alias("p"))
    title, han = text_lines(F.col("p.title_vi")), text_lines(F.col("p.title_cn"))
    rows = rows.select("url", poem_uid(F.col("url")).alias("uid"), title.alias("t"), han.alias("tc"), text_lines(F.col("p.vi")).alias("lines_vi"), text_lines(F.col("p.cn")).alias("lines_cn"), "p.error")
    error = F.coalesce("error", F.when(F.size("t") != 1, "bad title"), F.when((F.size("tc") != 1) & F.lit(need_title_cn), "bad Han title"), F.when((F.size("lines_cn") == 0) | (F.size("lines_cn") != F.size("lines_vi")), "lines don't match"), F.when(F.col("uid").isNull(), "no uid in url"))
    return rows.select("uid", "url", F.try_element_at("t", F.lit(1)).alias("title_vi"), F.try_element_at("tc", F.lit(1)).alias("title_cn"), "lines_vi", "lines_cn", error.alias("error"))


def pair_rows(poem: DataFrame) -> DataFrame:
    """(uid, pos, vi, cn): lines of good poems by position."""
    zipped = F.arrays_zip(F.col("lines_vi").alias("vi"), F.col("lines_cn").alias("cn"))
    return poem.where("error is null").select("uid", F.posexplode(zipped).alias("pos", "x")).select("uid", "pos", "x.vi", "x.cn")


def links(html: Column, before: str = "") -> Column:
    """Array of (href, text) of anchors, optionally only right after a start tag like
    `<h4 class="...">`."""
    found = F.regexp_extract_all(html, F.lit(f"(?is){before}<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(0))
    href = lambda a: absolute(unescape_html(F.regexp_extract(a, "(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']", 1)))
    text = lambda a: F.trim(F.regexp_replace(unescape_html(F.regexp_replace(F.regexp_extract(a, "(?is)<a\\b[^>]*>(.*?)</a>$", 1), "<[^>]*>", " ")), f"{SPACE}+", " "))
    return F.transform(found, lambda a: F.struct(href(a).alias("href"), text(a).alias("text")))


HEADER = r"<h4\b[^>]*\blist-item-header\b[^>]*>\s*"


def poem_links(html: Column) -> Column:
    """Poem URLs of a result page, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(links(html, HEADER), lambda x: x["href"]), lambda u: poem_uid(u).isNotNull()))


def group_links(html: Column) -> tuple[Column, Column]:
    """(sections, poems) of a group page, distinct, in order."""
    sections = F.array_distinct(F.transform(links(html, r"<h4\b[^>]*\bpoem-group-title\b[^>]*>\s*"), lambda x: x["href"]))
    whole = F.regexp_extract(html, r'(?is)<div\b[^>]*\bpoem-group-list\b.*', 0)
    return sections, F.array_distinct(F.filter(F.transform(links(whole), lambda x: x["href"]), lambda u: poem_uid(u).isNotNull()))


def author_entries(html: Column) -> Column:
    """Map of author URL to the name before " - "; the last mention counts."""
    found = F.filter(links(html, HEADER), lambda x: author_uid(x["href"]).isNotNull())
    pairs = F.transform(found, lambda x: F.struct(x["href"].alias("key"), F.trim(F.split_part(x["text"], F.lit(" - "), F.lit(1))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(F.transform(pairs, lambda q: q["key"]), i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda k: k == p["key"]))
    return F.map_from_entries(last)


def options(html: Column, name: str) -> Column:
    """Digit values of a select's options."""
    inside = F.regexp_extract(html, rf"(?is)<select\b[^>]*\bname\s*=\s*[\"']{name}[\"'][^>]*>(.*?)</select>", 1)
    return F.regexp_extract_all(inside, F.lit(r"(?i)<option\b[^>]*\bvalue\s*=\s*[\"'](\d+)[\"']"), F.lit(1))


def total_pages(html: Column) -> Column:
    """The largest page number in the page select or in links, at least 1."""
    hrefs = F.transform(links(html), lambda x: x["href"])
    every = F.concat(F.transform(options(html, "Page"), lambda x: x.cast("int")), page_numbers(hrefs))
    return F.coalesce(F.array_max(every), F.lit(1))
