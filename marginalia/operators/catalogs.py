"""Catalogs read from texts: 64 words of six lines, and 81 heads of nine places. What does not fit has an issue and is never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import u16len
from .audits import rendered

# Line labels, the eight trigrams from the lowest line up, and the marks of the main text.
LINE = r"(?m)^(初[六九]|[六九][二三四五]|上[六九]|用[六九])[：，]"
TRIGRAMS = {"乾": "111", "兌": "110", "離": "101", "震": "100", "巽": "011", "坎": "010", "艮": "001", "坤": "000"}
MAIN = "易經："
# Regions, labels of the nine places, and the marks that part a place's text from its commentary.
REGIONS = ["一方", "二方", "三方"]
PLACE = r"(?m)^(初一|次[二三四五六七八九]|上九)[：:。，、]"
MARK = "[測側]曰[：:。，、]"
USUAL_MARK = "測曰："
FIRST_GLYPH = 0x1D306


def _trimmed(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def _spans(text: Column, rx: str) -> Column:
    """(label, text, start, stop) of what follows each label of rx up to the next, without outer white space; places in UTF-16 units. The first has no label."""
    pieces, whole = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), 0)
    rows = F.arrays_zip(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(rx), 1)).alias("label"), F.concat(F.array(F.lit("")), whole).alias("mark"), pieces.alias("piece"))
    span = "array<struct<label:string,text:string,start:int,stop:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(s: Column, r: Column) -> Column:
        at = s["at"] + u16len(r["mark"])
        body = _trimmed(r["piece"])
        first = at + u16len(F.regexp_extract(r["piece"], r"^(\s*)", 1))
        one = F.struct(r["label"].alias("label"), body.alias("text"), first.cast("int").alias("start"), (first + u16len(body)).cast("int").alias("stop"))
        return F.struct((at + u16len(r["piece"])).cast("int").alias("at"), F.concat(s["out"], F.array(one)).cast(span).alias("out"))

    return F.aggregate(rows, start, step, lambda s: s["out"])


def change_catalog(passages: DataFrame) -> DataFrame:
    """Per section of passages (section, ordinal, text): bits from the lowest line up, statement, lines, extra, and issue, null if all fits: one main text, six lines in order, the trigrams that another passage names, uses only where they belong."""
    is_main = F.startswith("text", F.lit(MAIN))
    named = F.regexp_extract("text", "([乾兌離震巽坎艮坤])下([乾兌離震巽坎艮坤])上", 0)
    of = passages.groupBy("section", "ordinal").agg(F.count_if(is_main).alias("mains"), F.max(F.when(is_main, F.col("text"))).alias("main"), F.max(F.when(named != "", named)).alias("named"))
    rows = of.withColumn("spans", _spans(F.coalesce("main", F.lit("")), LINE))
    use = lambda s: F.startswith(s["label"], F.lit("用"))
    rows = rows.withColumn("lines", F.filter("spans", lambda s: (s["label"] != "") & ~use(s))).withColumn("extra", F.filter("spans", use))
    rows = rows.withColumn("bits", F.array_join(F.transform("lines", lambda s: F.when(F.contains(s["label"], F.lit("九")), "1").otherwise("0")), ""))
    place = lambda s: F.when(F.startswith(s["label"], F.lit("初")), 1).when(F.startswith(s["label"], F.lit("上")), 6).otherwise(F.instr(F.lit("二三四五"), F.substr(s["label"], F.lit(2), F.lit(1))) + 1)
    bits_of = F.create_map(*[F.lit(x) for pair in TRIGRAMS.items() for x in pair])
    wanted = F.concat(bits_of[F.substr("named", F.lit(1), F.lit(1))], bits_of[F.substr("named", F.lit(3), F.lit(1))])
    uses = F.when(F.col("ordinal") == 1, "用九").when(F.col("ordinal") == 2, "用六").otherwise("")
    issue = (
        F.when(F.col("mains") != 1, "main text")
        .when(F.size("lines") != 6, "line count")
        .when(~F.coalesce(F.col("bits") == wanted, F.lit(False)), "trigrams")
        .when(F.transform("lines", place) != F.array(*[F.lit(k) for k in range(1, 7)]), "line order")
        .when(F.array_join(F.transform("extra", lambda s: s["label"]), "") != uses, "extra use")
        .when(F.exists("spans", lambda s: _trimmed(F.replace(s["text"], F.lit(MAIN), F.lit(""))) == ""), "empty span")
    )
    statement = _trimmed(F.substr(F.get("spans", F.lit(0))["text"], F.lit(len(MAIN) + 1)))
    return rows.select("section", "ordinal", "bits", statement.alias("statement"), "lines", "extra", issue.alias("issue"))


def headed_blocks(texts: DataFrame) -> DataFrame:
    """Blocks under headings of two and three signs: source, place, level, title, region (the last title of two signs), block."""
    rx = r"(?m)^(={2,3})([^=\n]+)\1\r?$"
    raw = F.substring_index("raw", "{{footer}}", 1)
    zipped = F.arrays_zip(F.regexp_extract_all(raw, F.lit(rx), 1).alias("level"), F.regexp_extract_all(raw, F.lit(rx), 2).alias("title"), F.slice(F.split(raw, rx, -1), 2, 1 << 30).alias("block"))
    rows = texts.select("source", F.posexplode(zipped).alias("place", "b")).select("source", "place", F.length("b.level").alias("level"), "b.title", "b.block")
    upto = Window.partitionBy("source").orderBy("place")  # a text's headings
    return rows.withColumn("region", F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(upto))


def ternary_heads(texts: DataFrame) -> DataFrame:
    """Per head: source, ordinal, name, region, glyph, statement, spans of its places, and issue: the glyph and the region follow the order of heads, and the nine places theirs."""
    heads = headed_blocks(texts).where((F.col("level") == 3) & F.col("region").isin(REGIONS))
    heads = heads.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("place")))
    rows = heads.withColumn("glyph", F.regexp_extract("block", r"[\x{1D306}-\x{1D356}]", 0)).withColumn("spans", _spans(F.col("block"), PLACE))
    rows = rows.withColumn("zans", F.slice("spans", 2, 1 << 20))
    nth = F.when(F.col("glyph") != "", F.conv(F.hex(F.encode("glyph", "UTF-32")), 16, 10).cast("int") - FIRST_GLYPH + 1)
    order = F.transform("zans", lambda s: F.instr(F.lit("一二三四五六七八九"), F.substr(s["label"], F.lit(2))))
    region = F.array_position(F.array(*map(F.lit, REGIONS)), F.col("region")) - 1
    issue = (
        F.when(~F.coalesce(nth == F.col("ordinal"), F.lit(False)) | (F.floor((F.col("ordinal") - 1) / 27) != region), "order, glyph or region")
        .when(F.size("zans") != 9, "place count")
        .when(order != F.array(*[F.lit(k) for k in range(1, 10)]), "place order")
    )
    return rows.select("source", "ordinal", F.col("title").alias("name"), "region", "glyph", rendered(F.get("spans", F.lit(0))["text"]).alias("statement"), "zans", issue.alias("issue"))


def ternary_places(heads: DataFrame) -> DataFrame:
    """Per place of a head: label, passage, segmentation, marker, statement, commentary, and kinds of anomaly; without a mark nothing is parted, with several the place is ambiguous. Unknown markup makes texts null."""
    rows = heads.select("source", "ordinal", "name", F.posexplode("zans").alias("zan", "z")).withColumn("zan", F.col("zan") + 1)
    text = F.col("z.text")
    rows = rows.withColumn("marks", F.regexp_extract_all(text, F.lit(MARK), 0)).withColumn("parts", F.split(text, MARK, -1))
    n, marker = F.size("marks"), F.get("marks", F.lit(0))
    parted = lambda k: F.when(n == 1, rendered(_trimmed(F.get("parts", F.lit(k)))))
    kinds = F.array_compact(F.array(F.when(n == 0, "unresolved-missing-marker"), F.when(n > 1, "ambiguous-boundary"), F.when((n == 1) & (marker != USUAL_MARK), "marker-variant"), F.when(F.col("z.label") == "次九", "label-variant")))
    segmentation = F.when(n == 0, "unresolved-missing-marker").when(n == 1, "explicit-marker").otherwise("ambiguous-boundary")
    return rows.select("source", "ordinal", "name", "zan", F.col("z.label").alias("label"), rendered(text).alias("passage"), segmentation.alias("segmentation"), F.when(n == 1, marker).alias("marker"), parted(0).alias("statement"), parted(1).alias("commentary"), kinds.alias("anomalies"))
