"""Page analysis: classify a web page as results, index or other, and cut results into posts.

A page is parsed once, in a Python worker, and everything about it is decided there; one row a page
comes back and no tree is ever shuffled. The parser is the standard library's: paragraphs, list items,
table rows and cells close implicitly when a sibling opens.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions import urls as U
from quaestor.functions.dates import contains_strict_date, find_dates, macrumors_date, superuser_date

# Text lengths of a post, links of a list, parts of URLs and of class names.
MIN_TEXT, MAX_TEXT = 150, 5000
BLOCK_LINKS, INDEX_LINKS = 8, 9
URL_BLACKLIST = ("/blog/",)
PAGINATION = ("pagination", "pagenav", "pager", "page-numbers", "next-button", "nav-buttons", "gotopage", "pagenumber", "paging")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript", "template"}
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BARRIER = {"table", "ul", "ol", "div", "body", "article", "section", "select", "dl", "blockquote"}


class Node:
    """An element; its children are elements and strings in document order."""

    __slots__ = ("tag", "attrs", "parent", "children", "_text", "_links")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self._text: str | None = None
        self._links: int | None = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """This element and those inside, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.elements()))

    def text(self) -> str:
        """Visible text with white space collapsed."""
        if self._text is None:
            self._text = " ".join(self.raw().split())
        return self._text

    def raw(self) -> str:
        """Text as it is written."""
        parts: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                parts.append(item)
            else:
                todo.extend(reversed(item.children))
        return "".join(parts)

    def own(self) -> str | None:
        """The first piece of text that stands directly in this element."""
        return next((c for c in self.children if isinstance(c, str)), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def select(self, path: str) -> Iterator[Node]:
        """Elements below this one on a path of steps, in document order.

        A step is .class, #id or a tag; '>' before it asks for a child, otherwise any depth will do, and tag:n is
        the n-th child of that tag.
        """
        steps, child = [], False
        for word in path.split():
            if word == ">":
                child = True
            else:
                steps.append((word, child))
                child = False
        found = [self]
        for step, child in steps:
            below = (n for top in found for n in (top.elements() if child else (x for x in top.walk() if x is not top)))
            found = list({id(n): n for n in below if n._is(step)}.values())
        order = {id(n): k for k, n in enumerate(self.walk())} if len(steps) > 1 and len(found) > 1 else {}
        return iter(sorted(found, key=lambda n: order.get(id(n), 0)))

    def _is(self, step: str) -> bool:
        if step[0] == ".":
            return step[1:] in self.classes()
        if step[0] == "#":
            return self.attrs.get("id") == step[1:]
        tag, _, place = step.partition(":")
        if self.tag != tag:
            return False
        return not place or self.parent is not None and [c for c in self.parent.elements() if c.tag == tag].index(self) == int(place) - 1

    def markup(self, skip: Node | None = None) -> str:
        """Attributes and text in document order, without tags whose name begins with 'a'."""
        parts: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item is not skip:
                shown = "" if item.tag.startswith("a") else " ".join(f'{k}="{v}"' for k, v in item.attrs.items())
                parts.append(f"<{shown}>")
                todo.append("<>")
                todo.extend(reversed(item.children))
        return "".join(parts)

    def links(self) -> int:
        """Number of <a href> inside."""
        if self._links is None:
            self._links = sum(1 for n in self.walk() if n.tag == "a" and "href" in n.attrs)
        return self._links


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.hidden: str | None = None

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in _HIDDEN:
            self.hidden = tag
            return
        closes, node = _SELF_CLOSING.get(tag), self.at
        while closes and node.parent and node.tag not in _BARRIER - closes:
            if node.tag in closes:
                self.at = node.parent
                break
            node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        if not self.hidden:
            self.at.children.append(data)


def parse_body(html: str | None) -> Node | None:
    """The body of a page without scripts and styles; None if it has no content."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    body = next((n for n in builder.root.walk() if n.tag == "body"), builder.root)
    return body if body.children else None


def visible_text(html: str | None) -> str:
    body = parse_body(html)
    return body.text() if body else ""


class Page:
    """The decisions about one page; answers are remembered by element."""

    def __init__(self, url: str, html: str | None):
        self.url, self.site = url or "", _netloc(url or "")
        self.body = parse_body(html)
        self.valid: dict[int, bool] = {}
        self.reason = ""

    def user(self, block: Node) -> tuple[Node, str, str, str] | None:
        """The element that names a post's author: element, its class, link and name.

        Its class contains 'user' or 'author', and it holds a link with text, without a date, to the page's own site.
        """
        names = list(dict.fromkeys(c for n in block.walk() for c in n.classes() if "user" in c or "author" in c))
        for name in names:
            for node in block.walk():
                if name not in node.classes():
                    continue
                for a in node.walk():
                    if a.tag == "a" and a.attrs.get("href") and _netloc(a.attrs["href"]) in (self.site, "") and a.text() and not contains_strict_date(a.markup()):
                        return node, names[-1], a.attrs["href"], a.text()
        return None

    def is_post(self, block: Node) -> bool:
        """Text, an author and a date; the cheap tests come first."""
        if id(block) not in self.valid:
            ok = len(block.text()) > MIN_TEXT and self.user(block) is not None
            self.valid[id(block)] = ok and contains_strict_date(block.markup().replace("Z", ""))
        return self.valid[id(block)]

    def container(self, block: Node) -> Node | None:
        """First element, breadth first through valid ones, with two valid children that aren't forms."""
        todo = deque([block])
        while todo:
            node = todo.popleft()
            posts = [c for c in node.elements() if self.is_post(c)]
            if sum(not _is_form(c) for c in posts) >= 2:
                return node
            todo.extend(c for c in posts if c.tag != "footer" and c.attrs.get("type") != "text/javascript")
        self.reason = "no lowest_valid_container"
        return None

    def smallest(self, block: Node) -> Node:
        """Goes down to the first valid child as long as there is one."""
        while True:
            inner = next((c for c in block.elements() if self.is_post(c)), None)
            if inner is None:
                return block
            block = inner

    def link_lists(self, block: Node, length: int) -> list[list[Node]]:
        """Link lists: elements with more than length children that hold links, and their wanted links."""
        out = []
        for node in block.walk():
            if any(up.tag == "footer" for up in _up(node)):
                continue
            if sum(c.links() > 0 for c in node.elements()) > length:
                leaves = [n for n in node.walk() if n.tag == "a" and "href" in n.attrs and not any(c.links() for c in n.elements())]
                wanted = list({n.attrs["href"]: n for n in leaves if self.wanted(n.attrs["href"])}.values())
                if wanted:
                    out.append(wanted)
        return out

    def wanted(self, href: str) -> bool:
        own = _netloc(href)
        return bool(href) and not any(b in href for b in U.LINK_BLACKLIST) and (own in self.site or self.site in own)

    def posts(self) -> list[Node]:
        """Blocks of the page's posts; empty if it isn't a results page, with the reason."""
        if self.body is None:
            self.reason = "no body"
            return []
        if any(b in self.url for b in URL_BLACKLIST):
            self.reason = "url blacklisted"
            return []
        container = self.container(self.body)
        if container is None:
            return []
        blocks = [c for c in container.elements() if self.is_post(c)]
        if len(blocks) == 2:
            # The answers may stand in a block of their own.
            inner = self.container(blocks[1])
            self.reason = ""
            if inner is not None:
                blocks = blocks[:1] + [c for c in inner.elements() if self.is_post(c)]
        blocks = [self.smallest(b) for b in blocks]
        blocks = [b for b in blocks if MIN_TEXT < len(b.text()) < MAX_TEXT and not any(len(x) > BLOCK_LINKS for x in self.link_lists(b, BLOCK_LINKS))]
        if len(blocks) < 2:
            self.reason = "not enough valid posts found"
            return []
        return blocks

    def post(self, block: Node) -> dict:
        """Author, link, date and body of a post. The date is the first outside the body."""
        _, css, link, name = self.user(block)
        body, todo = None, deque([block])
        while todo and body is None:
            for child in todo.popleft().elements():
                if len(child.text()) > MIN_TEXT:
                    if not any(css in n.classes() for n in child.walk()):
                        body = child
                        break
                    todo.append(child)
        dates = find_dates(block.markup(skip=body))
        return {"date": dates[0][0] if dates else None, "author": name, "author_link": link, "body": (body or block).text()}

    def pagination(self) -> list[str] | None:
        """Links of the first element with a pagination class, or of its nearest ancestor with links; None if there is none."""
        for node in self.body.walk() if self.body else ():
            if any(p in c.lower() for c in node.classes() for p in PAGINATION):
                for up in list(_up(node))[:20]:
                    found = [n.attrs["href"] for n in up.walk() if n.tag == "a" and n.attrs.get("href") and not any(b in n.attrs["href"] for b in ("/user/", "/member/"))]
                    if found:
                        return found
                return None
        return None

    def index(self) -> list[str]:
        """Links of the first link list that holds a question; empty if the page isn't an index page."""
        if self.body is None or self.pagination() is None:
            return []
        for links in self.link_lists(self.body, INDEX_LINKS):
            if any(_is_question(a) for a in links):
                return [a.attrs["href"] for a in links]
        return []


def _netloc(url: str) -> str:
    try:
        return urlparse(url).netloc
    except ValueError:
        return ""


def _up(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _is_form(block: Node) -> bool:
    return any(n.tag == "input" and (n.attrs.get("type", "").lower() in ("password", "username") or "search" in n.attrs.get("placeholder", "").lower()) for n in block.walk())


def _is_question(a: Node) -> bool:
    try:
        way = urlparse(a.attrs["href"]).path
    except ValueError:
        way = ""
    text = a.text()
    return "?" in text or any(w + "_" in way or w + "-" in way or w + " " in text for w in U.QUESTION_WORDS)


# Which links of a site a crawl follows, and the classes of the page regions that it takes them from.
@dataclass(frozen=True)
class Guide:
    """URL guiding: a link counts if some allow pattern occurs in it and no deny pattern, and it stands in a region (anywhere if none is named)."""

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()

    def follows(self, link: str) -> bool:
        return (not self.allow or any(re.search(a, link) for a in self.allow)) and not any(re.search(d, link) for d in self.deny)


_NEVER = ("login", "password", "misc", "members", "register", "contact")
GUIDES = {
    "dynamics": Guide(("/t/", "/p/", "/f/"), (*_NEVER, "/tags/"), ("post-name", "pager")),
    "macrumors": Guide(("threads", "forum"), (*_NEVER, "members"), ("listBlock", "PageNav")),
    "reddit": Guide(("/r/iphonehelp/",), (*_NEVER, "/user/", "/login"), ("entry", "nav-buttons")),
    "spiceworks": Guide(("/topic/", "/windows"), (*_NEVER, "/people/", "/pages", "service-providers"), ("topics", "sui-pagination")),
    "eset": Guide(("/topic/", "/forum"), (*_NEVER, "/login", "/profile"), ("ipsDataItem_main", "ipsPagination")),
    "superuser": Guide(
        ("superuser.com/search", "superuser.com/questions/"),
        ("superuser.com/questions/ask", "submit", "answertab", "/users/", "superuser.com/help", "superuser.com/tags", "superuser.com/tour", "superuser.com/users"),
        ("result-link", "pager", "question-hyperlink"),
    ),
}


# Where two sites keep the parts of a question.
@dataclass(frozen=True)
class Site:
    """Rules of one site: marks of its URLs, and paths (as Node.select() reads them) to the parts of a thread."""

    domain: str
    results: str
    index: tuple[str, ...]
    title: str
    question: str
    answers: str
    tags: str
    author: str
    date: str
    date_attrs: tuple[str, ...] = ()  # attributes that hold the date, in order of preference; the text if there are none
    votes: str = ""
    views: str = ""
    original: str = ""
    squeezed: bool = False  # texts lose tabs, line breaks and fixed spaces, and empty answers don't count
    first_answer: int = 0  # which of the answers path's elements is the first answer
    product_in_tags: bool = False


SITES = {
    "superuser": Site(
        "superuser.com", "superuser.com/questions/", ("superuser.com/search", "superuser.com/questions/tagged"),
        "#question-header > h1 > a", ".postcell .post-text", ".answercell .post-text", ".post-tag", ".owner .user-details > a", ".owner .user-action-time .relativetime",
        votes=".vote-count-post", views="#qinfo .label-key > b", original=".question-originals-of-duplicate > ul > li > a",
    ),
    "macrumors": Site(
        "macrumors.com", "threads", ("forums.macrumors.com/forums",),
        "#content > div > div > div:2 > div > div:1 > div > h1", ".messageText", ".messageText", "#content > div > div > div:1 > nav > fieldset > span > span:3 > a > span",
        ".username", ".messageDetails .DateTime", ("data-datestring", "title"), squeezed=True, first_answer=1, product_in_tags=True,
    ),
}


def site_thread(site: Site, url: str, html: str | None, product: str | None = None) -> list[tuple]:
    """Rows of one results page, one for each answer, as SITE_ROWS has them; none if the page has no answer or isn't about the product."""
    body = parse_body(html)
    if body is None or any(m in url for m in site.index) or site.results not in url:
        return []
    squeeze = lambda t: re.sub("[\t\n\u00a0]", "", t) if site.squeezed else t
    texts = lambda path: [n.own() for n in body.select(path)] if path else []
    first = lambda found: next((t for t in found if t is not None), None)
    asked = next(body.select(site.question), None)
    answers = [squeeze(n.raw()) for n in body.select(site.answers)][site.first_answer :]
    answers = [a for a in answers if a] if site.squeezed else answers
    tags = sorted({(t.lower() if site.squeezed else t) for t in texts(site.tags) if t})
    if asked is None or not answers or site.product_in_tags and product is not None and product.lower() not in tags:
        return []
    dates = list(body.select(site.date))
    date = next((v for a in site.date_attrs for n in dates[:1] if (v := n.attrs.get(a))), None) if site.date_attrs else first(n.own() for n in dates)
    votes = [_whole(t) for t in texts(site.votes)]
    views = texts(site.views)
    name = first(texts(site.author))
    original = next((n.attrs["href"] for n in body.select(site.original) if n.attrs.get("href")), None) if site.original else None
    question = (
        first(texts(site.title)), squeeze(asked.raw()), tags, votes[0] if votes else None, _whole(views[1].split(" ")[0]) if len(views) > 1 and views[1] else None,
        f"{site.domain}_{name}", name, date, f"https://{site.domain}{original}" if original else None,
    )
    return [(site.domain, *question, k, text, votes[k + 1] if k + 1 < len(votes) else None) for k, text in enumerate(answers)]


def _whole(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


SITE_ROWS = (
    "domain string, question_title string, question_body string, question_tags array<string>, question_upvotes int, question_view_count int, author_id string, author_name string,"
    " date string, question_original_url string, answer_number int, answer_body string, answer_upvotes int"
)


def site_answers(pages: DataFrame, product: str | None = None) -> DataFrame:
    """Questions and answers of the sites that have rules (SITES), a row for each answer: page_id, source_url, the columns of SITE_ROWS with question_date for date.

    pages: page_id, url, html. A page belongs to the first site whose results mark its URL has; index pages and pages
    of other sites have no rows, nor have null pages. A date that its site's format doesn't fit is null.
    """

    columns = ["page_id", "source_url", *T.StructType.fromDDL(SITE_ROWS).names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, html in frame.itertuples(index=False):
                site = next((s for s in SITES.values() if s.domain in (url or "") and s.results in url), None)
                rows += [(page_id, url, *row) for row in site_thread(site, url, html, product)] if site else []
            yield pd.DataFrame(rows, columns=columns)

    rows = pages.select("page_id", "url", "html").mapInPandas(run, f"page_id bigint, source_url string, {SITE_ROWS}")
    date = F.when(F.col("domain") == SITES["superuser"].domain, superuser_date(F.col("date"))).otherwise(macrumors_date(F.col("date")))
    return rows.withColumn("question_date", date).drop("date")


def site_route(url: Column) -> Column:
    """Class of a page of a site with rules by its URL: index, results or other."""
    marks = lambda found: reduce(Column.__or__, [F.contains(url, F.lit(m)) for m in found])
    of = lambda s, found: F.contains(url, F.lit(s.domain)) & marks(found)
    index = reduce(Column.__or__, [of(s, s.index) for s in SITES.values()])
    results = reduce(Column.__or__, [of(s, (s.results,)) for s in SITES.values()])
    return F.when(index, "index").when(results, "results").otherwise("other")


def guided_links(pages: DataFrame, guide: Guide) -> DataFrame:
    """Links that a guided crawl follows from each page, absolute, each once: page_id, link.

    pages: page_id, url, html. Only links inside an element with a region's class count; null pages have none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, html in frame.itertuples(index=False):
                body = parse_body(html)
                tops = [] if body is None else [body] if not guide.regions else [n for n in body.walk() if set(n.classes()) & set(guide.regions)]
                rows += [(page_id, url, n.attrs["href"]) for top in tops for n in top.walk() if n.tag == "a" and n.attrs.get("href")]
            yield pd.DataFrame(rows, columns=["page_id", "url", "link"])

    found = pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, link string")
    found = found.select("page_id", U.absolute(F.col("link"), F.col("url")).alias("link")).distinct()
    allow = reduce(Column.__or__, [F.col("link").rlike(a) for a in guide.allow], F.lit(not guide.allow))
    deny = reduce(Column.__or__, [F.col("link").rlike(d) for d in guide.deny], F.lit(False))
    return found.where(allow & ~deny)


def frontier(analysed: DataFrame, pages: DataFrame, visited: DataFrame, budget: int | None = None) -> DataFrame:
    """The next URLs of a crawl: result and pagination links of pertinent index pages, absolute, that weren't visited: link.

    analysed: as analyse() gives it; visited: url. budget is the number of pages that the crawl may still fetch: the first links in
    their own order are kept.
    """
    both = F.explode(F.concat("result_links", "pagination_links")).alias("link")
    found = analysed.where((F.col("class") == "index") & F.col("is_pertinent")).select("page_id", both).join(pages.select("page_id", "url"), "page_id")
    links = found.select(U.absolute(F.col("link"), F.col("url")).alias("link")).distinct()
    fresh = links.join(visited.select(F.col("url").alias("link")), "link", "left_anti")
    return fresh if budget is None else fresh.orderBy("link").limit(budget)


POSTS = "array<struct<date:timestamp_ntz,author:string,author_link:string,body:string>>"
ANALYSIS = f"page_id bigint, class string, reason string, is_pertinent boolean, posts {POSTS}, result_links array<string>, pagination_links array<string>"


def analyse(pages: DataFrame, product: str | None = None) -> DataFrame:
    """One row a page: class (captcha, results, index, other), reason, is_pertinent, posts, result and pagination links.

    pages has page_id, url, html. With a product, a page is pertinent if a post (or a link of an
    index) mentions one of its words. Null html has no body.
    """
    words = [w.lower() for w in (product or "").split(" ") if w]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, url, html in frame.itertuples(index=False):
                page = Page(url, html)
                posts = [page.post(b) for b in page.posts()]
                links = page.index()
                kind = "captcha" if "captcha" in page.url else "results" if posts else "index" if links else "other"
                said = [p["body"] for p in posts] or links
                pertinent = not words or any(w in t.lower() for t in said for w in words)
                rows.append((page_id, kind, page.reason, pertinent, posts, links, page.pagination() or []))
            yield pd.DataFrame(rows, columns=["page_id", "class", "reason", "is_pertinent", "posts", "result_links", "pagination_links"])

    return pages.select("page_id", "url", "html").mapInPandas(run, ANALYSIS)


def question_answers(analysed: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each answer: the first post of a results page is the question, the others answer it."""
    results = analysed.where((F.col("class") == "results") & F.col("is_pertinent")).select("page_id", "posts")
    site = pages.select("page_id", "url", F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit("")).alias("source_domain"))
    wide = results.join(site, "page_id").select(
        "page_id", F.col("url").alias("source_url"), "source_domain", F.col("posts")[0].alias("q"), F.posexplode(F.slice("posts", 2, F.size("posts"))).alias("pos", "a")
    )
    author = lambda p: F.concat_ws("_", "source_domain", f"{p}.author")
    return wide.select(
        "page_id", "source_url", "source_domain", (F.col("pos") + 1).alias("answer_number"),
        F.struct(F.col("q.body").alias("question_body"), F.col("q.date").alias("question_date"), author("q").alias("author_id"), F.col("q.author").alias("author_name")).alias("question"),
        F.struct(F.col("a.body").alias("answer_body"), F.col("a.date").alias("answer_date"), author("a").alias("author_id"), F.col("a.author").alias("author_name")).alias("answer"),
    )


@F.pandas_udf(T.StringType())
def visible_text_column(html: pd.Series) -> pd.Series:
    return html.map(visible_text)


def route(url: Column, is_results: Column, is_index: Column | None = None) -> Column:
    """Class of a page: captcha by its URL, else what the classifiers say."""
    out = F.when(F.contains(url, F.lit("captcha")), "captcha")
    if is_index is not None:
        out = out.when(is_index, "index")
    return out.when(is_results, "results").otherwise("other")


def link_table(pages: DataFrame) -> DataFrame:
    """All links of all pages in order: page_id, url, pos, link."""
    return pages.select("page_id", "url", F.posexplode(U.links(F.col("html"))).alias("pos", "link"))


def serp_results(links: DataFrame, mark: str, next_mark: str, cached: str = "webcache") -> DataFrame:
    """Result links of a search page: those with mark that aren't cached copies and whose next link has next_mark."""
    order = Window.partitionBy("page_id").orderBy("pos")
    ahead = links.withColumn("next_link", F.lead("link").over(order))
    kept = ahead.where(F.contains("link", F.lit(mark)) & ~F.contains("link", F.lit(cached)) & F.contains("next_link", F.lit(next_mark)))
    return kept.withColumn("target", F.substring_index(F.regexp_replace("link", "^" + re.escape(mark), ""), "&sa", 1))


def valid_sites(classified: DataFrame) -> DataFrame:
    """Sites with an index and a results page: host, is_valid, and how many pages of each class."""
    sums = [F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("results", "index", "captcha", "other")]
    return classified.groupBy("host").agg(*sums).withColumn("is_valid", (F.col("n_results") > 0) & (F.col("n_index") > 0))


def crawl_statistics(log: DataFrame) -> DataFrame:
    """Pages of each class, their share of all, and pages a second over the crawl. log: class, ts."""
    total = log.agg(F.count(F.lit(1)).alias("total"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    counts = log.groupBy("class").agg(F.count(F.lit(1)).alias("n_pages"))
    wide = counts.crossJoin(F.broadcast(total))  # one row
    return wide.select("class", "n_pages", F.round(F.try_divide("n_pages", "total"), 6).alias("ratio"), F.round(F.try_divide("n_pages", "seconds"), 6).alias("pages_per_second"))
