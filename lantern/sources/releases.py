"""Scraped links and the choice of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.text import normal_name


def links(html: Column, pattern: str = r'href="([^"]*subs/[^"]*\.html)"', most: int = 40) -> Column:
    """Distinct links in page order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), 1, most)


def english_file(html: Column) -> Column:
    return F.regexp_extract(html, r'href="([^"]*-en\.srt)"', 1)


def release_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"([^/]*)$", 1), r"(-en)?\.srt$", "")


def ranked(hits: DataFrame, release: str, title: str, year: int | None = None, season: int | None = None, episode: int | None = None) -> DataFrame:
    """hits with a positive `score`: title, year, episode, resolution and kind of release; spam and other episodes lose."""
    name = normal_name(F.col(release))
    phrase = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in title.lower()).split())
    words = [w for w in phrase.split() if len(w) > 2]
    all_words = F.lit(bool(words))
    for w in words:
        all_words = all_words & F.contains(name, F.lit(w))
    if len(words) <= 1:
        all_words = all_words & (F.element_at(F.split(name, " "), 1) == phrase)
    score = F.when(F.lit(bool(phrase)) & F.contains(name, F.lit(phrase)), 8).when(all_words, 3)
    one = lambda test, points: F.when(test, points).otherwise(0)
    if year:
        score = score + one(F.col(release).rlike(rf"\b{year}\b"), 2)
    keep = F.lit(True)
    if season is not None:
        marked = name.rlike(rf"\bs0?{season}\s?e0?{episode}\b")
        others = F.regexp_extract_all(name, F.lit(r"\bs0*(\d+)e0*(\d+)\b"), F.lit(0))
        own = F.exists(others, lambda x: x.rlike(rf"^s0*{season}e0*{episode}$"))
        keep = (marked | name.rlike(rf"\b{season}x0?{episode}\b")) & ((F.size(others) == 0) | own)
        score = score + one(marked, 4) + one(name.rlike(r"\b(1080|720|2160)p\b"), 1)
    web = name.rlike(r"\bweb[\s.|-]*(dl|rip)\b") | F.contains(name, F.lit("dsnp")) | F.contains(name, F.lit("bluray")) | F.contains(name, F.lit("web"))
    score = score + one(web, 1) - one(F.contains(name, F.lit("-hi")) | F.contains(name, F.lit(".hi.")), 1) - one(F.contains(name, F.lit("www.")) | F.contains(name, F.lit("http")), 2)
    return hits.where(keep).withColumn("score", score).where("score > 0")


def best(hits: DataFrame, group: str, release: str, id_col: str) -> DataFrame:
    """One hit of each group: not machine-made, not for the hard of hearing, from the preferred source, with the longest name."""
    order = F.struct(F.col("ai"), F.col("hearing_impaired"), ~F.col("preferred"), -F.length(release), F.col(id_col))
    return hits.groupBy(group).agg(F.min_by(id_col, order).alias(id_col))


def query_variants(title: Column, year: Column, season: Column, episode: Column) -> Column:
    film = F.array_distinct(F.filter(F.array(F.concat_ws(" ", title, year.cast("string")), title), lambda x: x.isNotNull()))
    series = F.array(F.format_string("%s S%02dE%02d", title, season, episode), F.format_string("%s %dx%02d", title, season, episode), title)
    return F.when(season.isNull(), film).otherwise(series)
