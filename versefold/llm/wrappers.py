"""Page extraction by union-free wrappers inferred for each host.

A wrapper is a tree of block elements whose children form a regular expression without unions:
a child is needed, optional or repeated, and holds text slots. It is made by aligning the pages
of a host one after another: children that both have are merged, what only one has becomes
optional, runs of equal siblings become a repeated group, texts that differ become slots. All
pages of a host take part: tasks align theirs, and partial wrappers are merged as a tree."""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versefold.llm.common import stored, table

#: Share of the pages with the article's root on which a text is the same, so that it is the site's.
SAME = 0.9
#: Constants counted for a text; where there are more, all counts are lowered by the next one's, so
#: one on 90 % of pages is short by at most a hundredth of them.
CONSTANTS = 8
#: Children of an element that a wrapper holds, the commonest. Beyond it (class words that differ
#: from page to page) rare ones are judged by their signature, as elements not in the wrapper are.
PARTS = 256
#: Partial wrappers that are merged at once, and hosts that a task holds before it hands them on.
FAN_IN, HELD = 64, 500
BROADCAST_BYTES = 16 << 20
#: Elements inside one another that a page's tree holds; any that tell what a part is (set apart, or
#: the article) go on to twice as many. Deeper ones only end a block: their texts stay, in order.
DEEP = 60
#: Periods of repeated groups of siblings, and length from which a constant is held by its hash.
GROUPS, LONG_TEXT = (1, 2, 3, 4), 200
#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template iframe svg textarea title canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
AROUND = frozenset("nav footer aside form button select menu dialog head script style noscript template iframe fieldset input".split())
#: Words of class, id and role that mark what isn't the article, and words that say
#: nothing of it beside them.
AROUND_WORDS = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu sidebar aside breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert gdpr popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget toolbar pagination pager login search form complementary contentinfo topbar".split())
BESIDE_WORDS = frozenset("article bar block body bottom box button buttons container content entry global group icons inner items left links list main outer page panel post posts primary right secondary section site slot text thread top unit widgets wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section center address details".split())
MAIN_WORDS = ("articlebody", "main", "article", "post", "entry", "story", "content", "body", "text")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*\Z", re.S)
_MARK = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>?", re.I) for t in RAW}


class Node:
    """A block element of a page: its signature and its children, texts among them."""

    __slots__ = ("tag", "sign", "kids")

    def __init__(self, tag: str, sign: str):
        self.tag, self.sign, self.kids = tag, sign, []


def signature(tag: str, attributes: str) -> str:
    """The tag and the words of class, id, role and itemprop, each as its parts joined by "-"."""
    words = sorted({w for m in _MARK.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split() if (w := "-".join(_PART.findall(x)))}) if attributes else []
    return ".".join([tag, *words])


def tree(page: str) -> Node:
    """Block elements and texts of a page. Inline elements are transparent, a line break is
    white space, raw elements and comments are left out; open paragraphs and list items end
    where HTML lets them; end tags without a start are ignored. Elements deeper than DEEP only end
    a block (a node without a sign)."""
    root = Node("", "")
    stack, at = [("", root, 0)], 0
    opened: Counter[str] = Counter()

    def text(said: str) -> None:
        kids = stack[-1][1].kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += said
        elif said.strip():
            kids.append(said)

    def left(k: int) -> None:
        if stack[k][1] is stack[k - 1][1]:
            stack[k][1].kids.append(Node("", ""))
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end = bool(m[1] or m[4])
        if tag in INLINE:
            continue
        if tag == "br" or tag in VOID:
            text(" ")
            continue
        if end:
            if opened[tag] > 0:
                left(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            left(len(stack) - 1)
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == tag:
            left(len(stack) - 1)
        node, depth = Node(tag, signature(tag, m[3] or "")), stack[-1][2] + 1
        if depth > 2 * DEEP or depth > DEEP and main_rank(node.sign) == 99 and not is_around(node.sign, True):
            node, depth = stack[-1][1], depth - 1
            node.kids.append(Node("", ""))
        else:
            stack[-1][1].kids.append(node)
        stack.append((tag, node, depth))
        opened[tag] += 1
    if at < len(page):
        text(page[at:])
    return root


def constant(said: str) -> str:
    """A text as wrappers hold it: itself, or its hash where it is long."""
    return said if len(said) < LONG_TEXT else hashlib.blake2b(said.encode("utf-8", "replace"), digest_size=16).hexdigest()


def new_part(node: Node | str) -> dict:
    """A wrapper part: s signature, m multiplicity (1, ? or +), p pages that have it, o times it
    occurs, k children, g the period of a repeated group that it is in; for text c the constant or
    null for a slot, n its whole length, v counts of its constants."""
    if isinstance(node, str):
        said = constant(" ".join(html.unescape(node).split()))
        return {"s": "#", "m": "1", "p": 1, "o": 1, "c": said, "n": len(node), "v": {said: 1}}
    return {"s": node.sign, "m": "1", "p": 1, "o": 1, "k": folded([new_part(k) for k in node.kids if isinstance(k, str) or k.sign])}


def folded(parts: list[dict]) -> list[dict]:
    """Repeated groups of siblings, of one to four elements in turn, become one group of repeated
    parts."""
    out: list[dict] = []
    for p in parts:
        out.append(p)
        for g in GROUPS:
            tail = out[-2 * g :]
            if len(tail) == 2 * g and all(a["s"] == b["s"] for a, b in zip(tail, tail[g:], strict=False)) and any(a["s"] != "#" for a in tail):
                out[-2 * g :] = [merged(a, b, True) | {"m": "+", "g": g} for a, b in zip(tail, tail[g:], strict=False)]
                break
    return out[:PARTS] if len(out) > PARTS and all(x["p"] == 1 for x in out) else out


def merged(a: dict, b: dict, siblings: bool = False) -> dict:
    """Both parts as one: of different pages, or siblings."""
    m = "+" if "+" in (a["m"], b["m"]) else "?" if "?" in (a["m"], b["m"]) else "1"
    out = {"s": a["s"], "m": m, "p": max(a["p"], b["p"]) if siblings else a["p"] + b["p"], "o": a["o"] + b["o"]}
    if "g" in a or "g" in b:
        out["g"] = max(a.get("g", 0), b.get("g", 0))
    if a["s"] == "#":
        return out | {"c": a["c"] if a["c"] == b["c"] else None, "n": a["n"] + b["n"], "v": counted(a["v"], b["v"])}
    return out | {"k": aligned(a["k"], b["k"], siblings)}


def counted(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    out = dict(a)
    for x, n in b.items():
        out[x] = out.get(x, 0) + n
    if len(out) > CONSTANTS:
        less = sorted(out.values(), reverse=True)[CONSTANTS]
        out = {x: n - less for x, n in out.items() if n > less}
    return out


def aligned(a: list[dict], b: list[dict], siblings: bool = False) -> list[dict]:
    """Align two child sequences by their longest common one; the rest is optional."""
    if [x["s"] for x in a] == [x["s"] for x in b]:
        return [merged(x, y, siblings) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i]["s"] == b[j]["s"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["s"] == b[j]["s"]:
            out.append(merged(a[i], b[j], siblings))
            i, j = i + 1, j + 1
        else:
            left = j >= len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]
            one = a[i] if left else b[j]
            i, j = (i + 1, j) if left else (i, j + 1)
            out.append(one | {"m": "?"} if one["m"] == "1" else one)
    out = folded(out)
    if len(out) > PARTS:
        least = sorted((x["p"] for x in out), reverse=True)[PARTS - 1]
        spare = PARTS - sum(x["p"] > least for x in out)
        kept = []
        for x in out:
            if x["p"] > least or x["p"] == least and spare > 0:
                spare -= x["p"] == least
                kept.append(x)
        out = kept
    return out


@functools.lru_cache(1 << 16)
def is_around(sign: str, inside_main: bool) -> bool:
    """Whether an element of this signature is set apart from the article: by its tag, or by a whole
    word of its class ("ad", "cookie-notice", "post-comments", not "has-sidebar" or
    "promo-code-guide")."""
    tag, *words = sign.split(".")
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in AROUND or tag == "header" and not inside_main:
        return True
    told = [{p for p in w.split("-") if p not in BESIDE_WORDS} for w in words]
    return any(t and t <= AROUND_WORDS or t == {"header"} and not inside_main for t in told)


@functools.lru_cache(1 << 16)
def main_rank(sign: str) -> int:
    """Lower is likelier to be the article: its element, then main, then words of its class."""
    tag, *words = sign.split(".")
    if tag == "article":
        return 0
    parts = {p for w in words for p in w.split("-")}
    if {"articlebody", "article-body"} & {*words}:
        return 1
    if tag == "main" or "main" in parts:
        return 2
    return min((3 + MAIN_WORDS.index(p) for p in parts if p in MAIN_WORDS), default=99)


def mass(part: dict) -> int:
    """Length of a part's slots on all pages: text that differs from page to page."""
    return (part["n"] if part["c"] is None else 0) if part["s"] == "#" else sum(map(mass, part["k"]))


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages."""
    return functools.reduce(merged, (new_part(tree(page)) for page in pages))


def varies(part: dict) -> bool:
    return part["c"] is None if part["s"] == "#" else any(map(varies, part["k"]))


def labelled(whole: dict) -> dict:
    """What extraction needs of a wrapper, by signature: k children, r the slots' text that an element
    which may be the article's root has on all pages, x the site's own texts (the same on nearly all
    pages with their root, and on three at least, while others differ). In a root that its name
    marks as the article only text right in a container (div and the like) can be the site's: paragraphs,
    items, cells and formulas stay, however often they recur."""

    def walk(part: dict, root: dict, rank: int, outer: bool) -> dict:
        out: dict = {}
        changes: bool | None = None
        tag = part["s"].split(".")[0]
        for kid in part["k"]:
            if kid["s"] == "#":
                if part["o"] > part["p"] / SAME or tag in HEADINGS or rank < 99 and tag not in CONTAINERS:
                    continue
                same = [x for x, n in kid["v"].items() if x and n >= max(3, SAME * root["p"])]
                if same:
                    changes = varies(root) if changes is None else changes
                if same and changes:
                    out["x"] = sorted({*out.get("x", []), *same})
            elif not is_around(kid["s"], True):
                free, own = outer and not is_around(kid["s"], False), main_rank(kid["s"])
                better = free and own < rank
                below = walk(kid, kid if better else root, own if better else rank, free)
                if free and own < 99:
                    below["r"] = mass(kid)
                at = out.setdefault("k", {})
                at[kid["s"]] = joined(at[kid["s"]], below) if kid["s"] in at else below
        return out

    return walk(whole, whole, 99, True)


def joined(a: dict, b: dict) -> dict:
    """Labels of two parts with the same signature."""
    out = a | b
    if "r" in a and "r" in b:
        out["r"] = a["r"] + b["r"]
    if "x" in a and "x" in b:
        out["x"] = sorted({*a["x"], *b["x"]})
    if "k" in a and "k" in b:
        out["k"] = a["k"] | {s: joined(a["k"][s], k) if s in a["k"] else k for s, k in b["k"].items()}
    return out


def own_mass(node: Node) -> int:
    return sum(len(k) if isinstance(k, str) else own_mass(k) for k in node.kids)


def article(root: Node, labels: dict) -> tuple[str, ...]:
    """Signatures from the page's top to its article's root: of the elements that may be it, one of
    the best name, then that with most text on all pages of the host, then on this one; a page
    without any is taken whole."""
    best: tuple | None = None
    stack: list[tuple[Node, dict, tuple[str, ...]]] = [(root, labels, ())]
    while stack:
        node, known, path = stack.pop()
        for kid in node.kids:
            if isinstance(kid, str) or is_around(kid.sign, False):
                continue
            label, at, rank = known.get("k", {}).get(kid.sign, {}), (*path, kid.sign), main_rank(kid.sign)
            if rank < 99 and (best is None or rank <= best[0]):
                found = (rank, -label.get("r", 0), 0 if label.get("r") else -own_mass(kid), at)
                best = found if best is None else min(best, found)
            stack.append((kid, label, at))
    if best is not None:
        return best[3]
    return next(((k.sign,) for k in root.kids if not isinstance(k, str) and k.tag in ("html", "body")), ())


def extract(page: str, labels: dict) -> str:
    """The article's text by the host's labels: its blocks, in order. Elements that the wrapper
    doesn't have are judged by their signature; a page whose article's root is empty, by its own
    structure alone."""
    root = tree(page)
    blocks: list[str] = []

    def walk(node: Node, known: dict, depth: int, path: tuple[str, ...]) -> None:
        """depth: how many steps of the path lead here, -1 off it; past its end is inside."""
        inside = depth == len(path)
        run: list[str] = []

        def flush() -> None:
            said = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if said and inside:
                blocks.append(said)

        for kid in node.kids:
            if isinstance(kid, str):
                if "x" not in known or constant(" ".join(html.unescape(kid).split())) not in known["x"]:
                    run.append(kid)
                continue
            flush()
            if not is_around(kid.sign, inside):
                on = inside or 0 <= depth < len(path) and path[depth] == kid.sign
                walk(kid, known.get("k", {}).get(kid.sign, {}), depth + (not inside) if on else -1, path)
        flush()

    walk(root, labels, 0, article(root, labels))
    if not blocks and page.strip():
        walk(root, {}, 0, article(root, {}))
    return "\n".join(blocks)


def host_of(url) -> F.Column:
    """Scheme, user, port and path cut off, lower-cased; empty for null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


PARTIAL = "host string, task int, number int, wrapper string"


def align_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to a partial wrapper of each host."""
    task, number = TaskContext.get().partitionId(), 0
    held: dict[str, dict] = {}

    def handed_on() -> pa.RecordBatch:
        n = len(held)
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array([task] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "task", "number", "wrapper"])

    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            part = new_part(tree(page))
            held[host] = merged(held[host], part) if host in held else part
            if len(held) > HELD:
                yield handed_on()
                held.clear()
                number += 1
    if held:
        yield handed_on()


def merge_partials(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("task", "number", "wrapper")), strict=True), key=lambda r: r[:2])
    whole = functools.reduce(merged, (json.loads(r[2]) for r in rows))
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "task": pa.array([rows[0][0]], pa.int32()), "number": pa.array([rows[0][1]], pa.int32()), "wrapper": [json.dumps(whole)]})


def label_host(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    whole = merge_partials(key, t).column("wrapper")[0].as_py()
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": [json.dumps(labelled(json.loads(whole)))]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, labels as JSON) from all pages. Each task aligns its pages of a host; partial wrappers
    are merged FAN_IN at a time, so no host's pages meet anywhere, however many it has."""
    made = stored(pages.select("host", "html").mapInArrow(align_pages, PARTIAL), "partials")
    most = made.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > FAN_IN:
        salts = -(-most // FAN_IN)
        salt = F.pmod(F.xxhash64("task", "number"), F.lit(salts))
        made = stored(made.groupBy("host", salt.alias("salt")).applyInArrow(merge_partials, PARTIAL), "partials")
        most = min(salts, made.groupBy("host").count().agg(F.max("count")).first()[0] or 0)
    return made.groupBy("host").applyInArrow(label_host, "host string, wrapper string")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page. Null and empty pages give an empty text; null urls are
    a host of their own; equal rows give equal texts; an empty table gives no rows. Very long or
    deep pages are read whole (see DEEP). Extra columns aren't looked at.

    Wrappers are broadcast only if their measured size is small; else they are joined by host."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    made = stored(wrappers(pages), "wrappers")
    size = made.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in made.collect()})
        given, of = pages.withColumn("wrapper", F.lit(None).cast("string")), lambda host, _: known.value[host]
    else:
        given, of = pages.join(made, "host", "left"), lambda _, wrapper: wrapper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, host, own in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                if host not in parsed:
                    if len(parsed) > 2000:
                        parsed.clear()
                    parsed[host] = json.loads(of(host, own))
                texts.append(extract(page, parsed[host]))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return given.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, "page_id long, url string, text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' main texts."""
    out = extracted(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
