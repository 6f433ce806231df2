"""URLs and links as columns. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Parts of links that never lead to content, and those of member pages.
LINK_BLACKLIST = ("javascript:", "mailto", "/member/", "/members", "/user/", "/users/")
#: Words that make a link a question, followed by '-', '_' or a space.
QUESTION_WORDS = ("how", "when", "where", "what", "who", "problem", "issue", "help")


def host(url: Column) -> Column:
    """Host of a URL, '' where it has none."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def short_file_name(url: Column) -> Column:
    """A file name made of a URL: no scheme, dots and slashes as underscores, 100 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[./]", "_")
    return F.substring(plain, 1, 100)


def links(html: Column) -> Column:
    """Targets of all <a href> in a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*?href="([^"]*)"'), F.lit(1))


def css_classes(html: Column) -> Column:
    """All class attributes of a page, joined by spaces."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r'class="([^"\r\n]*)"'), F.lit(1)), " ")


def same_site(link: Column, page: Column) -> Column:
    """A link without a host, or with one that contains or is contained in the page's."""
    a, b = host(link), host(page)
    return F.contains(a, b) | F.contains(b, a)


def wanted_link(link: Column, page: Column) -> Column:
    """Links that a crawl follows: not empty, not on the blacklist, on the same site."""
    ok = (link != "") & same_site(link, page)
    for part in LINK_BLACKLIST:
        ok = ok & ~F.contains(link, F.lit(part))
    return ok


def question_link(link: Column) -> Column:
    """The link's path has a question word followed by '-' or '_'."""
    return path(link).rlike("(" + "|".join(QUESTION_WORDS) + ")[_-]")


def allowed(url: Column, allow: str, deny: str) -> Column:
    """URL guiding: the allow pattern occurs and the deny pattern doesn't."""
    return url.rlike(allow) & ~url.rlike(deny)


def absolute(link: Column, page: Column) -> Column:
    """A link with scheme and host: relative ones count from the root of the page's site, not from its folder.

    Steps up at the front of a link go no further than the root. Links with a scheme of their own (mailto:,
    javascript:, too) stay as they are, and so do all links of a page without scheme or host.
    """
    scheme, site = F.try_parse_url(page, F.lit("PROTOCOL")), F.try_parse_url(page, F.lit("AUTHORITY"))
    base = F.concat(scheme, F.lit("://"), site)
    inner = F.regexp_replace(link, r"^/?(\.\.?/)+", "")
    whole = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^([?#]|$)"), F.concat(base, link))
        .when(F.startswith(inner, F.lit("/")), F.concat(base, inner))
        .otherwise(F.concat(base, F.lit("/"), inner))
    )
    return F.coalesce(whole, link)


def request_id(url: Column) -> Column:
    """First five hex digits of a URL's SHA-1, by which logs name a request."""
    return F.substring(F.sha1(url), 1, 5)
