"""RSS and Atom feeds, html to text, links and feed discovery."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "feed_pos int, title string, url string, published string, html string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def entries(raw: str | None) -> list[dict]:
    """Items of an RSS or Atom document; a document that is no XML has none."""
    try:
        root = ET.fromstring((raw or "").strip())
    except ET.ParseError:
        return []
    out = []
    for i, item in enumerate(e for e in root.iter() if _local(e.tag) in ("item", "entry")):
        fields: dict[str, str] = {}
        for child in item:
            name = _local(child.tag)
            value = child.get("href") if name == "link" and child.get("href") else "".join(child.itertext())
            if value and value.strip():
                fields.setdefault(name, value.strip())
        body = fields.get("encoded") or fields.get("content") or fields.get("description") or fields.get("summary") or ""
        published = fields.get("pubdate") or fields.get("published") or fields.get("updated") or fields.get("created") or fields.get("date") or ""
        if fields.get("title") or body:
            out.append({"feed_pos": i, "title": fields.get("title", ""), "url": fields.get("link", ""), "published": published, "html": body})
    return out


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skipped -= tag in ("script", "style") and self.skipped > 0

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def text_of(html: str | None) -> str:
    """Text of a piece of html, white space collapsed."""
    reader = _Text()
    reader.feed(html or "")
    reader.close()
    return " ".join(" ".join(reader.parts).split())


def html_to_text(html: Column) -> Column:
    """Text of html by a parser, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(text_of)

    return run(html)


def html_to_text_native(html: Column) -> Column:
    """The crude form inside the JVM: tags become spaces, the common references are decoded."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def longest(*texts: Column) -> Column:
    """The longest of several extractions, the first on ties."""
    best = texts[0]
    for t in texts[1:]:
        best = F.when(F.length(F.coalesce(t, F.lit(""))) > F.length(F.coalesce(best, F.lit(""))), t).otherwise(best)
    return best


_ASIDE = r"(?is)<(head|nav|header|footer|aside|form|script|style|noscript)\b.*?</\1\s*>"


def main_text(html: Column) -> Column:
    """The longest of three readings: paragraphs alone, the page without its furniture, and, if both are empty, all of it."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), _ASIDE, " ")
    paragraphs = html_to_text_native(F.array_join(F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), 1), " "))
    whole = html_to_text_native(bare)
    return F.coalesce(F.nullif(longest(paragraphs, whole), F.lit("")), html_to_text_native(html))


def parse(feeds: DataFrame, most: int = 50) -> DataFrame:
    """(source, feed_pos, title, url, published, raw_text) of the first ``most`` entries. feeds: (source, raw)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"source": s, **{k: v for k, v in e.items() if k != "html"}, "raw_text": text_of(e["html"])} for s, raw in zip(part["source"], part["raw"], strict=True) for e in entries(raw)[:most]]
            yield pd.DataFrame(rows, columns=["source", "feed_pos", "title", "url", "published", "raw_text"])

    return feeds.select("source", "raw").mapInPandas(run, "source string, feed_pos int, title string, url string, published string, raw_text string")


def links(pages: DataFrame, extension: str = "pdf") -> DataFrame:
    """(url, position, link) of links with an extension, made absolute, first of each kept. pages: (url, html)."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+\." + extension + r"(?:\?[^\"']*)?)[\"']"), 1)
    root, folder = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.regexp_extract("url", r"^([a-z]+://[^/]+(?:/.*/|/)?)", 1)
    absolute = F.transform(hrefs, lambda h: F.when(h.rlike("^[a-z]+://"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), h)))
    return pages.select("url", F.posexplode(F.array_distinct(absolute)).alias("position", "link"))


def is_feed(raw: Column) -> Column:
    """The answer of an address is a feed with entries: by its root element and a first item."""
    return F.coalesce(raw.rlike(r"(?is)^\s*(?:<\?xml[^>]*>\s*|<!--.*?-->\s*)*<(?:[\w-]+:)?(?:rss|feed|rdf)\b") & raw.rlike(r"(?i)<(?:[\w-]+:)?(?:item|entry)\b"), F.lit(False))


def health(feeds: DataFrame, answers: DataFrame) -> DataFrame:
    """(source, url, alive, entries): whether each feed that is read still answers with one. feeds: (source, url); answers: (url, raw)."""
    known = answers.groupBy("url").agg(F.max("raw").alias("raw"))
    counted = F.size(F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(r"(?i)(<(?:[\w-]+:)?(?:item|entry)\b)"), 1))
    return feeds.join(known, "url", "left").select("source", "url", is_feed(F.col("raw")).alias("alive"), counted.alias("entries")).orderBy("alive", "source", "url")


def discover(seeds: DataFrame, templates: DataFrame, alive: DataFrame) -> DataFrame:
    """(seed, url): for each homepage the first template by rank whose address is alive.

    seeds: (seed, home) and, if templates name ``{topic}``, a topic; templates:
    (rank, template) with ``{home}``, a short fixed list; alive: (url) that
    answered with a feed (see :func:`is_feed`).
    """
    kinds = templates.agg(F.array_sort(F.collect_list(F.struct("rank", "template"))).alias("t")).scalar()
    topic = F.coalesce(F.col("topic"), F.lit("")) if "topic" in seeds.columns else F.lit("")
    tried = seeds.select("seed", "home", topic.alias("topic"), F.explode(kinds).alias("t")).select("seed", F.col("t.rank").alias("rank"), F.replace(F.replace("t.template", F.lit("{home}"), F.regexp_replace("home", "/+$", "")), F.lit("{topic}"), F.col("topic")).alias("url"))
    return tried.join(alive.select("url").distinct(), "url", "left_semi").groupBy("seed").agg(F.min_by("url", "rank").alias("url"))
