"""Links, anchors and images of pages, and items of media feeds."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.operators.dispatch import RULES

MEDIA_NAMESPACE = "http://search.yahoo.com/mrss/"


class _Refs(HTMLParser):
    """Alternate links, anchors and images in document order: (section, href, name)."""

    def __init__(self, mime: set[str]):
        super().__init__(convert_charrefs=True)
        self.mime, self.out, self.anchor, self.text, self.base = mime, [], None, [], None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}  # the first of a name counts
        if tag == "link" and a.get("href") and "alternate" in a.get("rel", "").split(" ") and a.get("type", "").lower() in self.mime:
            self.out.append(("link", a["href"], a.get("title", "")))
        elif tag == "a":
            self._close()
            if "href" in a:
                self.anchor, self.text = a["href"], []
        elif tag == "area" and "href" in a:
            self.out.append(("anchor", a["href"], ""))
        elif tag == "base" and self.base is None:
            self.base = a.get("href")
        elif tag == "img" and a.get("src") and self.anchor is None:
            self.out.append(("image", a["src"], a.get("title") or a.get("alt", "")))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == "a":
            self._close()

    def handle_data(self, data):
        if self.anchor is not None:
            self.text.append(data)

    def _close(self):
        if self.anchor is not None:
            self.out.append(("anchor", self.anchor, " ".join("".join(self.text).split())))
        self.anchor = None

    def close(self):
        super().close()
        self._close()


def _parsed(html: str, base: str) -> tuple[list[tuple[str, str, str]], str]:
    """What _Refs finds, white space around references and line breaks in them apart, and the URL that they are relative to."""
    clean = lambda x: x.strip(" \t\n\r\f").translate({9: None, 10: None, 13: None})
    parser = _Refs({m for kinds in RULES.values() for m in kinds.get("mime", "").split()})
    parser.feed(html or "")
    parser.close()
    return [(section, clean(href), name) for section, href, name in parser.out], _resolved(clean(parser.base or ""), base or "")


def _resolved(href: str, base: str) -> str:
    """A reference as a browser resolves it; one that is no URL stays as it is."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _without_fragment(href: str) -> str:
    return href.rpartition("#")[0] if "#" in href else href


def page_anchors(html: str, base: str) -> list[tuple[int, str]]:
    """(pos, href) of a page's anchors: without fragments and empty ones, the first of each target, then only http and https; pos counts all anchors."""
    found, base = _parsed(html, base)
    first: dict[str, int] = {}
    for pos, href in enumerate(href for section, href, _ in found if section == "anchor"):
        if bare := _without_fragment(href):
            first.setdefault(_resolved(bare, base), pos)
    return [(pos, href) for href, pos in first.items() if href.lower().startswith(("http://", "https://"))]


def anchors(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, pos, href) of the anchors of any markup, as page_anchors() gives them, each target once per key."""
    kind = pages.schema[key].dataType.simpleString()

    def work(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, *r) for k, u, h in zip(frame.iloc[:, 0], frame.iloc[:, 1], frame.iloc[:, 2], strict=True) for r in page_anchors(h, u)]
            yield pd.DataFrame(rows, columns=[key, "pos", "href"])

    found = pages.select(key, url, html).mapInPandas(work, f"{key} {kind}, pos long, href string")
    return found.groupBy(key, "href").agg(F.min("pos").alias("pos")).select(key, "pos", "href")


def page_refs(html: str, base: str) -> list[tuple[str, int, str, str]]:
    """(section, pos, href, name): links, then anchors, then images; each target once in its section, anchors and images only with http or https.

    An image inside an anchor isn't listed.
    """
    found, base = _parsed(html, base)
    out, seen = [], set()
    for section in ("link", "anchor", "image"):
        pos = 0
        for kind, href, name in found:
            if kind != section:
                continue
            if section == "anchor":
                href = _without_fragment(href)
                if not href:
                    continue
            href = _resolved(href, base)
            if (section, href) in seen:
                continue
            seen.add((section, href))
            if section == "link" or href.lower().startswith(("http://", "https://")):
                out.append((section, pos, href, name))
                pos += 1
    return out


def refs(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, section, pos, href, name) of any markup, by a parser: whether an image is inside an anchor is beyond regular expressions."""
    kind = pages.schema[key].dataType.simpleString()

    def work(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, *r) for k, u, h in zip(frame.iloc[:, 0], frame.iloc[:, 1], frame.iloc[:, 2], strict=True) for r in page_refs(h, u)]
            yield pd.DataFrame(rows, columns=[key, "section", "pos", "href", "name"])

    return pages.select(key, url, html).mapInPandas(work, f"{key} {kind}, section string, pos long, href string, name string")


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, pos, title, url) of media feeds: the root is rss, declares the media namespace, under whatever prefix, and has one channel; others give nothing."""
    schema = "channel array<struct<item: array<struct<title: string, `media:content`: struct<_url: string>>>>>"
    declared = rf"""(?s)^\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<rss\s(?:[^>]*\s)?xmlns:([\w.-]+)\s*=\s*["']{re.escape(MEDIA_NAMESPACE)}["']"""
    prefix = F.regexp_extract(F.col(xml), declared, 1)
    plain = F.regexp_replace(F.col(xml), F.concat(F.lit(r"(</?)\Q"), prefix, F.lit(r"\E:")), F.lit("$1media:"))
    parsed = feeds.filter(prefix != "").select(key, F.from_xml(plain, schema, {"mode": "PERMISSIVE"}).alias("rss")).filter(F.size("rss.channel") == 1)
    items = parsed.select(key, F.posexplode(F.expr("rss.channel[0].item")).alias("pos", "item"))
    return items.select(key, F.col("pos").cast("long").alias("pos"), F.col("item.title").alias("title"), F.col("item.`media:content`._url").alias("url"))
