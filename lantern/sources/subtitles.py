"""Subtitle files: decoding, parsing and validation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUES = "path string, cue int, start_s double, end_s double, text string"
_TIME = re.compile(r"(\d{1,3}):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*-->\s*(\d{1,3}):(\d{1,2}):(\d{1,2})[,.](\d{1,3})[^\n]*")


def decode(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else Windows-1252 with replacement."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data.decode(name, "replace").lstrip("﻿")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def parse(text: str) -> list[tuple[int, float, float, str]]:
    """(ordinal from 1, start, end, text) of each cue; lines of a cue are joined by spaces.

    Where a cue's text runs into another time line, empty lines in a row count as one, and the file is read again.
    """
    text = text.lstrip("﻿").replace("\r\n", "\n")
    found = _cues_of(text)
    if any("-->" in c[3] for c in found) or (not found and "-->" in text):
        found = _cues_of(re.sub(r"\n{3,}", "\n\n", text))
    return found


def _cues_of(text: str) -> list[tuple[int, float, float, str]]:
    found = list(_TIME.finditer(text))
    out = []
    for n, m in enumerate(found, 1):
        stop = found[n].start() if n < len(found) else len(text)
        body = text[m.end() : stop].rstrip()
        if n < len(found):
            body = re.sub(r"\n\s*\d+\s*$", "", "\n" + body).strip("\n")  # the next cue's number
        h = [int(x) for x in m.groups()]
        millis = [int(m.group(k).ljust(3, "0")) for k in (4, 8)]
        start, end = (h[k] * 3600 + h[k + 1] * 60 + h[k + 2] + millis[k // 4] / 1000 for k in (0, 4))
        out.append((n, start, end, " ".join(x.strip() for x in body.split("\n") if x.strip())))
    return out


def _cues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(p, *c) for p, data in zip(frame["path"], frame["content"], strict=True) for c in parse(decode(bytes(data)))]
        yield pd.DataFrame(rows, columns=["path", "cue", "start_s", "end_s", "text"])


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all subtitle files under a path, by Spark's binary file source."""
    return cues_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").option("recursiveFileLookup", "true").load(path))


def cues_of(files: DataFrame) -> DataFrame:
    """(path, cue, start_s, end_s, text) of files (path, content), content being bytes."""
    return files.select("path", "content").mapInPandas(_cues, CUES)


def is_usable(text: str, least_cues: int = 150, least_bytes: int = 2000) -> bool:
    """usable() for one text."""
    return text.count("-->") >= least_cues and len(text.encode("utf-8", "replace")) >= least_bytes and "<html" not in text[:400].lower()


def usable(files: DataFrame, text_col: str = "text", least_cues: int = 150, least_bytes: int = 2000) -> DataFrame:
    """Files with enough cues and bytes that aren't HTML pages."""
    from lantern.functions.text import looks_like_html

    text = F.col(text_col)
    return files.where((F.regexp_count(text, F.lit("-->")) >= least_cues) & (F.octet_length(text) >= least_bytes) & ~looks_like_html(text))
