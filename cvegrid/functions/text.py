"""Text expressions; all but the page scan stay in the JVM."""

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..schemas import CHARS_PER_TOKEN, ECOSYSTEM_ALIASES, MAX_TEXT_BYTES

# Elements whose content is not article text.
DROPPED_ELEMENTS = ["script", "style", "nav", "header", "footer", "noscript", "iframe"]


def fixed(col: Column, digits: int) -> Column:
    """Fixed-point text without thousands separators, half-even on the exact value."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))


def estimate_tokens(col: Column) -> Column:
    return F.floor(F.length(col) / CHARS_PER_TOKEN).cast("int")


def shorten(col: Column, width: int) -> Column:
    return F.when(F.length(col) > width, F.concat(F.left(col, F.lit(width)), F.lit("..."))).otherwise(col)


def domain_of(url: Column) -> Column:
    """Host part of a web address, NULL for anything else."""
    return F.nullif(F.regexp_extract(url, r"https?://([^/]+)", 1), F.lit(""))


def canonical_ecosystem(col: Column) -> Column:
    """Canonical ecosystem name; unknown names stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in ECOSYSTEM_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(col))), col)


def content_type(url: Column) -> Column:
    """Kind of page behind a reference address."""
    host = F.regexp_replace(F.lower(F.coalesce(domain_of(url), F.lit(""))), r"^.*@|:\d*$", "")
    path = F.lower(url)

    def on(name: str) -> Column:
        """Whether the page is on that host or one below it."""
        return (host == name) | host.endswith("." + name)

    return (
        F.when(on("exploit-db.com") & path.contains("/exploits/"), "poc_readme")
        .when(on("github.com") & path.contains("/advisories/"), "github_advisory")
        .when(on("github.com") & path.contains("/security/"), "github_advisory")
        .when(host.rlike(r"^(.*\.)?blog\.") | path.rlike(r"://[^/]+/(.*/)?blog/"), "blog_post")
        .otherwise("vendor_advisory")
    )


def crawl_priority(url: Column) -> Column:
    """1 = crawl first. Vendor pages, advisory pages, blogs, exploit pages."""
    kind = content_type(url)
    return (
        F.when(kind == "vendor_advisory", 1)
        .when(kind == "github_advisory", 2)
        .when(kind == "blog_post", 3)
        .otherwise(4)
    )


def collapse_space(col: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def cap_utf8(col: Column, max_bytes: int) -> Column:
    """At most ``max_bytes`` of UTF-8, without a broken last character."""
    raw = F.substring(F.encode(col, "UTF-8"), 1, max_bytes)
    cut = F.rtrim(F.make_valid_utf8(raw.cast("string")), F.lit("�"))
    return F.when(F.octet_length(col) > max_bytes, cut).otherwise(col)


#: Elements without content or end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _PageText(HTMLParser):
    """One scan over a page: text outside dropped elements. Elements that are left open end with the one around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.counts: Counter = Counter()
        self.dropped, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)
            self.counts[tag] += 1
            self.dropped += tag in _DROPPED

    def handle_endtag(self, tag):
        if self.counts[tag]:
            closed = None
            while closed != tag:
                closed = self.open.pop()
                self.counts[closed] -= 1
                self.dropped -= closed in _DROPPED

    def handle_startendtag(self, tag, attrs):
        """A self-closed element holds nothing."""

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)


_DROPPED = frozenset([*DROPPED_ELEMENTS, "head"])


@F.pandas_udf(T.StringType())
def _page_text(pages: pd.Series) -> pd.Series:
    out = []
    for page in pages:
        parser = _PageText()
        parser.feed(page)
        parser.close()
        out.append("".join(parser.parts))
    return pd.Series(out, dtype=object)


def html_text(html: Column, max_bytes: int | None = MAX_TEXT_BYTES) -> Column:
    """Readable text of a page: head and page furniture removed, character references decoded, blanks collapsed.

    A fragment without body yields its own text. Text nodes of neighbouring
    elements join without a separator. Empty input gives ''. What the crawl
    stores has a limit; without ``max_bytes`` the text is whole.
    """
    text = collapse_space(_page_text(F.coalesce(html, F.lit(""))))
    return text if max_bytes is None else cap_utf8(text, max_bytes)
