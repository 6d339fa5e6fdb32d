"""Ordered pattern frames over passages: every match of every frame, folded by precedence.

A match that partly overlaps a claimed span, or lies strictly inside one, is skipped; one that
contains claimed spans supersedes them. Matches come frame by frame, left to right; the reading is
the first that survives, in frame order. All of it is Catalyst expressions: matches and their
starts from regexp_extract_all and split, the fold from aggregate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import u16len

# Delimiters, openers and closers of the reporting frames, with the frames in their order.
_PUNCT = "，。；：︰﹕「」？！、"
_ENT, _ENT_NOT_YUE = f"([^{_PUNCT}]{{1,10}})", f"([^{_PUNCT}曰]{{1,10}})"
_ENT_NOT_V, _ENT_NOT_V_YUN = f"([^{_PUNCT}謂問告語]{{1,10}})", f"([^{_PUNCT}謂問告語云]{{1,10}})"
_COLON, _OPEN, _CLOSE, _SPEECH = "[：︰﹕]", "[「『\"“]", "[」』\"”]", "([^」』\"”]{1,300})"
FRAMES = [
    ("wei-quote", f"{_ENT}謂{_ENT_NOT_YUE}曰{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "recipient", "theme"]),
    ("wen-quote", f"{_ENT}問{_ENT_NOT_YUE}曰{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "recipient", "theme"]),
    ("gao-quote", f"{_ENT}告{_ENT_NOT_YUE}曰{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "recipient", "theme"]),
    ("yu-quote", f"{_ENT}語{_ENT_NOT_YUE}曰{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "recipient", "theme"]),
    ("wen-plain", f"{_ENT_NOT_V}問曰{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "theme"]),
    ("gao-plain", f"{_ENT_NOT_V}告曰{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "theme"]),
    ("yue-quote", f"{_ENT_NOT_V}曰{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "theme"]),
    ("yun-quote", f"{_ENT_NOT_V_YUN}云{_COLON}{_OPEN}{_SPEECH}{_CLOSE}", ["agent", "theme"]),
    ("naming", f"(?:謂之|名曰|號曰|是為|一曰|亦曰){_OPEN}?([^{_PUNCT}『』\"“”]{{1,20}}){_CLOSE}?", ["theme"]),
]
MAX_UNITS = 2048
ROLES = ["agent", "recipient", "theme"]


def frame_arrays(text: Column, k: int, pattern: str, roles: list[str]) -> dict[str, Column]:
    """What a frame's matches are made of, as columns of their own, so that each pattern runs over a text once for each."""
    rx = F.lit(pattern)
    out = {f"_w{k}": F.regexp_extract_all(text, rx, 0), f"_b{k}": F.split(text, pattern, -1)}
    return out | {f"_s{k}_{role}": F.regexp_extract_all(text, rx, j + 1) for j, role in enumerate(roles)}


def frame_matches(k: int, name: str, roles: list[str]) -> Column:
    """Array of (frame, construction, start, end, agent, recipient, theme) of one frame's matches; offsets count characters from 0.

    A match starts after the text between matches and the matches before it: running sums.
    """
    whole, between = F.col(f"_w{k}"), F.col(f"_b{k}")
    sums = F.aggregate(
        F.arrays_zip(F.transform(between, F.length).alias("b"), F.transform(whole, F.length).alias("w")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.struct((s["at"] + x["b"] + F.coalesce(x["w"], F.lit(0))).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["b"])).alias("starts")),
    )["starts"]
    parts = F.arrays_zip(sums.alias("start"), whole.alias("w"), *[F.col(f"_s{k}_{r}").alias(r) for r in roles])
    value = lambda m: [(m[r] if r in roles else F.lit(None).cast("string")).alias(r) for r in ROLES]
    return F.transform(F.filter(parts, lambda m: m["w"].isNotNull()), lambda m: F.struct(F.lit(k).alias("frame"), F.lit(name).alias("construction"), m["start"].alias("start"), (m["start"] + F.length(m["w"])).alias("end"), *value(m)))


_KIND = "array<struct<frame:int,construction:string,start:int,end:int,agent:string,recipient:string,theme:string>>"


def folded(matches: Column) -> Column:
    """The matches that survive the fold, in the order in which they were claimed."""

    def step(found: Column, m: Column) -> Column:
        inside = lambda c: (c["start"] >= m["start"]) & (c["end"] <= m["end"])
        clash = F.exists(found, lambda c: (m["start"] < c["end"]) & (c["start"] < m["end"]) & ~inside(c))
        return F.when(clash, found).otherwise(F.concat(F.filter(found, lambda c: ~inside(c)), F.array(m)))

    return F.aggregate(matches, F.array().cast(_KIND), step)


def read_frames(passages: DataFrame, text: str = "text", frames: list = FRAMES, max_units: int = MAX_UNITS) -> DataFrame:
    """passages with status, construction, agent, recipient, theme, start, end, additional.

    Texts that are null, empty or over max_units UTF-16 units, or without a match, are Unknown.
    """
    t = F.when((F.length(text) > 0) & (u16len(F.col(text)) <= max_units), F.col(text))
    arrays: dict[str, Column] = {}
    for k, (_, rx, roles) in enumerate(frames):
        arrays |= frame_arrays(t, k, rx, roles)
    parts = [F.coalesce(frame_matches(k, name, roles), F.array().cast(_KIND)) for k, (name, _, roles) in enumerate(frames)]
    out = passages.withColumns(arrays).withColumn("_matches", F.concat(*parts)).withColumn("_found", folded(F.col("_matches"))).drop(*arrays)
    first = F.get("_found", F.lit(0))
    out = out.withColumn("status", F.when(F.size("_found") > 0, "Readable").otherwise("Unknown"))
    for c in ("construction", *ROLES, "start", "end"):
        out = out.withColumn(c, first[c])
    return out.withColumn("additional", F.greatest(F.size("_found") - 1, F.lit(0))).drop("_matches", "_found")
