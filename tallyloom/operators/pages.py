"""Visible text and metadata of captured pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.arrow import parts

# Tags without visible text, the pattern of paths that lead to no offer, and short or long lines that are no content.
DROPPED = frozenset("script style noscript svg canvas iframe nav footer".split())
NO_OFFER = r"cart|checkout|account|login|sign-?in|sign-?up|register|logout|wishlist|search|help|support|contact|about|faq|returns?|shipping|privacy|terms|sitemap|legal|accessibility|careers?|press|blog|stores?|locations?|store-?finder|find-a-store"
NOISE = ("accept cookies", "cookie policy", "privacy policy", "terms of use", "skip to main content")
LEGAL = r"redeemable|transferable|prohibited|liability|pursuant|void\b|indemnif|arbitration|sublicense|warranties|governing\s+law|jurisdiction|severab"
_NO_OFFER = re.compile(f"/?(?:{NO_OFFER})(?:/|$|\\?)", re.IGNORECASE)
_LEGAL = re.compile(rf"\b(?:{LEGAL})\b", re.IGNORECASE)
_BLOCK = frozenset("p div li ul ol br h1 h2 h3 h4 h5 h6 tr td th section article main aside form table blockquote title".split())


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.link, self.label = [], [], None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.hidden.append(tag)
        elif tag in _BLOCK:
            self.parts.append("\n")
        elif tag == "img" and not self.hidden and len((a.get("alt") or "").strip()) > 5:
            self.parts.append(f" {a['alt'].strip()} ")
        elif tag == "a":
            self.link, self.label = a.get("href") or "", len(self.parts)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif tag in _BLOCK:
            self.parts.append("\n")
        elif tag == "a" and self.link is not None:
            label = " ".join("".join(self.parts[self.label :]).split())
            link = self.link.strip()
            if not self.hidden and len(link) > 1 and link.startswith("/") and not link.startswith("//") and len(label) > 4 and not _NO_OFFER.match(link) and "#" not in link.split("?")[0]:
                self.parts.append(f" [deal_url:{link}]")
            self.link = None

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    """The lines of a page that are read: without noise, legal text and lines that came before."""
    p = _Visible()
    p.feed(html or "")
    p.close()
    seen, out = set(), []
    for line in "".join(p.parts).split("\n"):
        line = re.sub(r"\s+", " ", line).strip()
        low = line.lower()
        if not line or line in seen or (len(line) < 120 and any(x in low for x in NOISE)) or (len(line) > 400 and _LEGAL.search(line)):
            continue
        seen.add(line)
        out.append(line)
    return "\n".join(out)


def clean_visible_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages, without the html, with their visible text."""
    rest = [c for c in pages.columns if c != html_col]

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, whole.column(html_col))):
            texts = pa.array([visible_text(x.as_py()) for x in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], [*rest, "text"])

    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType())])
    return pages.select(*rest, F.coalesce(F.col(html_col), F.lit("")).alias(html_col)).mapInArrow(run, schema)


def extract_page_meta(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with page_title and the first social image that is an absolute URL."""
    meta = r'(?is)<meta[^>]+(?:property|name)="(?:og:image|twitter:image|twitter:image:src)"[^>]+content="(http[^"]+)"'
    title = F.trim(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.withColumns({"page_title": F.nullif(title, F.lit("")), "image_url": F.nullif(F.regexp_extract(html_col, meta, 1), F.lit(""))})
