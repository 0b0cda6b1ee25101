"""Posts and links out of forum pages, with the standard library's HTML parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of what holds a post, what is left out of it, and what links to a thread.
BODY, LEFT_OUT, TITLE = "bbWrapper", ("bbCodeBlock--quote", "bbCodeSpoiler"), "structItem-title"
SHORTEST = 50


class _Reader(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set[str]]] = []
        self.text: list[str] = []
        self.time: str | None = None
        self.links: list[tuple[str, str]] = []
        self.done = False
        self.href: str | None = None
        self.title: list[str] = []

    def _inside(self, *classes: str) -> bool:
        return any(c in own for _, own in self.stack for c in classes)

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "time" and self.time is None:
            self.time = values.get("datetime")
        if tag == "br" and self._inside(BODY) and not self.done:
            self.text.append("\n")
        if tag == "a" and self._inside(TITLE):
            self.href, self.title = values.get("href"), []
        if tag not in self.VOID:
            self.stack.append((tag, set((values.get("class") or "").split())))

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.links.append((self.href, "".join(self.title).strip()))
            self.href = None
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            name, own = self.stack.pop()
            if BODY in own and not self._inside(BODY):
                self.done = True
            if name == tag:
                break

    def handle_data(self, data):
        if self.href is not None:
            self.title.append(data)
        if self._inside(BODY) and not self.done and not self._inside(*LEFT_OUT):
            self.text.append(data)


def _read(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader


def first_posts(pages: DataFrame, url: str = "url", html: str = "html", shortest: int = SHORTEST) -> DataFrame:
    """post_id (digits at the end of the address), text of the first post without quotes and spoilers, its time.

    Null pages and posts under shortest characters are left out.
    """

    @F.pandas_udf("text string, posted string")
    def read(values: pd.Series) -> pd.DataFrame:
        found = [_read(v) if v is not None else None for v in values]
        return pd.DataFrame({"text": [None if r is None else "".join(r.text).strip() for r in found], "posted": [None if r is None else r.time for r in found]})

    rows = pages.select(F.col(url).alias("url"), read(F.col(html)).alias("_p")).select("url", "_p.*")
    return rows.filter(F.length("text") >= shortest).select(F.regexp_extract("url", r"\.(\d+)/?$", 1).alias("post_id"), "url", "text", F.try_to_timestamp("posted").alias("posted"))


def links(pages: DataFrame, base: str, html: str = "html", part: str | None = None) -> DataFrame:
    """url, title of the threads that listing pages name; part: only addresses that hold it."""

    @F.pandas_udf("array<struct<href:string,title:string>>")
    def read(values: pd.Series) -> pd.Series:
        return pd.Series([[{"href": h, "title": t} for h, t in _read(v).links] if v is not None else [] for v in values])

    rows = pages.select(F.explode(read(F.col(html))).alias("_l")).select("_l.*")
    full = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    rows = rows.select(full.alias("url"), "title").filter(F.col("url").isNotNull())
    return rows.filter(F.contains("url", F.lit(part))) if part else rows


def has_next(html: Column) -> Column:
    return F.coalesce(html.rlike(r"pageNav-jump--next"), F.lit(False))
