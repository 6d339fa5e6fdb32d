"""Markers of citation, the quotations that follow them, and which labels a reading may carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bracketed marker, the bare one (not after a letter or bracket), and what may follow either.
STRICT = "《\\s*(詩|書|易|禮|春秋|論語|孝經|爾雅|周禮|儀禮|左傳|國語)\\s*》\\s*(?:曰|云|稱|之言)"
BARE = "(?<![》\\u4e00-\\u9fff])(詩|書|易|禮)\\s*(?:曰|云)(?![》「])"
QUOTED = "^\\s*[：:]?\\s*[「『]([^」』]{2,300})[」』]"
SENTENCE = "^\\s*[：:]?\\s*([^。！？]{2,120})[。！？]"
# What carries no weight in a quotation.
MARKS = "[\\s，。；：、！？「」『』（）()《》〈〉·—…\"']"
# Particles that an agent may not begin or end with, and words that no label may hold.
PREFIXES = ["且", "復", "亦", "又", "乃", "遂", "蓋", "故", "而", "則", "皆", "盡", "共", "竊", "嘗", "數", "相", "於是", "因", "既", "始", "方", "將", "欲", "敢", "請", "可", "不", "傳", "使", "若", "夫", "今", "昔", "初", "後", "其", "之", "以", "為", "所", "與", "野"]
SUFFIXES = ["且", "復", "亦", "又", "乃", "遂", "蓋", "故", "而", "則", "皆", "盡", "共", "竊", "嘗", "數", "相", "有", "以", "傳", "歸"]
VERBS = "[曰謂問告語於于乎]"
LONGEST_LABEL = 5


def quotation(rest: Column) -> Column:
    """What is quoted at the start of rest: a bracketed run, else the sentence up to its end; null if neither."""
    return F.when(rest.rlike(QUOTED), F.regexp_extract(rest, QUOTED, 1)).when(rest.rlike(SENTENCE), F.regexp_extract(rest, SENTENCE, 1))


def citations(passages: DataFrame, text: str, key: list[str], marker: str = STRICT) -> DataFrame:
    """A row for each marker in a passage: key, place (from 0), name, quote, norm (null without a quote).

    The text is cut at markers, so what follows the k-th marker is the rest of the cuts after it.
    """
    names = F.regexp_extract_all(text, F.lit(marker), 1)
    whole = F.regexp_extract_all(text, F.lit(marker), 0)
    cuts = F.split(text, marker, -1)
    rows = passages.select(*key, cuts.alias("_cuts"), whole.alias("_whole"), F.posexplode(names).alias("place", "name"))
    # markers that come later belong to what follows, as in the text
    later = F.transform(F.sequence(F.col("place") + 1, F.size("_cuts") - 1), lambda k: F.concat(F.get("_cuts", k), F.coalesce(F.get("_whole", k), F.lit(""))))
    rows = rows.withColumn("quote", quotation(F.array_join(later, "")))
    return rows.select(*key, "place", "name", "quote", F.regexp_replace("quote", MARKS, "").alias("norm"))


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def inadmissible(role: Column, value: Column) -> Column:
    """Why a value may not fill a role, the first reason that holds; null if it may: too long, particles, verbs, prepositions."""
    agent = (
        F.when(value.rlike("^" + _any(PREFIXES)), "agent begins with a particle or adverb").when(value.rlike(_any(SUFFIXES) + "$"), "agent ends with a particle or adverb")
        .when(value.rlike(VERBS), "agent contains a reporting verb or preposition")
    )
    recipient = (
        F.when(value.rlike("^[於于乎]"), "recipient carries the preposition").when(value.rlike(VERBS), "recipient contains a reporting verb")
        .when(value.rlike("者$"), "recipient ends in 者").when(value.startswith("有"), "recipient begins with 有")
    )
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").when(F.length(value) > LONGEST_LABEL, "too long").when(role == "agent", agent).when(role == "recipient", recipient)


def valid_label(construction: Column, roles: dict[str, list[str]], **given: Column) -> Column:
    """Whether a label has exactly the roles of its construction: a role is null if and only if the construction lacks it. Unknown constructions are invalid."""
    out = F.lit(False)
    for name, has in roles.items():
        fits = F.lit(True)
        for role, value in given.items():
            fits = fits & (value.isNotNull() if role in has else value.isNull())
        out = F.when(construction == name, fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def of_provenance(records: DataFrame, classes: list[str], column: str = "provenance") -> DataFrame:
    """Records of the given provenance classes; unknown and null ones are in none."""
    return records.where(F.col(column).isin(classes))


def exact_keys(raw: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others; false for what is no object."""
    return F.coalesce(F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def within_bytes(text: Column, most: int = 64 * 1024) -> Column:
    """Whether a request's UTF-8 form has at most so many bytes."""
    return F.coalesce(F.octet_length(F.encode(text, "UTF-8")) <= most, F.lit(False))
