"""Inscription analysis: fields of a text, forward and reverse scores, and the optimizer's trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, let

# Stems, branches, markers of tone, and the preset weights and thresholds.
_STEMS, _BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
TONE = [["王在"], ["令"], ["成事"], ["用乍"], ["万年", "萬年"], ["永宝用", "永寶用"], ["卜"], ["贞", "貞"]]
PRESETS = {"seed": (0.45, 0.35, 0.2, 0.58, 0.78), "oracle": (0.55, 0.25, 0.2, 0.6, 0.82), "strict": (0.5, 0.3, 0.2, 0.75, 0.9)}


def normalized(t: Column) -> Column:
    t = F.regexp_replace(F.coalesce(t, F.lit("")), "\\s+", "")
    return F.regexp_replace(F.regexp_replace(t, "[「『]", "“"), "[」』]", "”")


def _part(t: Column, rx: str, k: int = 1) -> Column:
    found = F.regexp_extract(t, rx, k)
    return F.when(found != "", found)


def analyzed(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the fields of an inscription and the array of signals."""
    t = F.col("normalized")
    date = f"[隹惟唯]([^，。；]+?)年([^，。；]+?)月([{_STEMS}][{_BRANCHES}])"
    plain = F.regexp_replace(_part(t, "令(.+?)(?:休又成事|成事)"), "^[，。]+|[，。]+$", "")
    rewards = F.filter(F.split(F.coalesce(_part(t, "(?:休又)?成事，(.+?)，用乍彝"), F.lit("")), "[、，]"), lambda x: x != "")
    out = rows.withColumn("normalized", normalized(F.col(text))).select(
        "*",
        F.concat(_part(t, date, 1), F.lit("年")).alias("year"),
        F.concat(_part(t, date, 2), F.lit("月")).alias("month"),
        _part(t, date, 3).alias("day"),
        _part(t, "(王)在").alias("actor"),
        _part(t, "王在([^，。；]+)").alias("location"),
        F.coalesce(_part(t, "令“(.+?)”"), plain).alias("command"),
        F.when(t.contains("成事"), "成事").alias("event_status"),
        rewards.alias("rewards"),
        F.when(t.contains("用乍彝"), "用乍彝").alias("purpose"),
        _part(t, "颂其(.+?)(?:。|$)").alias("blessing"),
        F.regexp_count(t, F.lit("三")).alias("threes"),
    )
    named = {"time": F.col("year").isNotNull(), "location": F.col("location").isNotNull(), "command": F.col("command").isNotNull() & (F.col("command") != ""), "completion": F.col("event_status").isNotNull(), "rewards": F.size("rewards") > 0, "artifact": F.col("purpose").isNotNull(), "blessing": F.col("blessing").isNotNull()}
    return out.withColumn("signals", F.array_compact(F.array(*[F.when(c, k) for k, c in named.items()])))


def _third(*conditions: Column) -> Column:
    return sum((F.when(c, 1.0).otherwise(0.0) for c in conditions[1:]), F.when(conditions[0], 1.0).otherwise(0.0)) / 3


def scored(analysis: DataFrame, preset: str = "seed") -> DataFrame:
    """analysis with the three channels, the tone, the convergence score and its band."""
    three, structure, style, working, strong = PRESETS[preset]
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    out = analysis.select(
        "*",
        _third(there("year"), there("location"), there("actor")).alias("observation"),
        _third(there("command"), there("event_status"), F.size("rewards") > 0).alias("action"),
        _third(there("purpose"), there("blessing"), F.col("threes") > 0).alias("memory"),
        (sum((F.when(F.col("normalized").rlike("|".join(g)), 1.0).otherwise(0.0) for g in TONE[1:]), F.when(F.col("normalized").rlike("|".join(TONE[0])), 1.0).otherwise(0.0)) / len(TONE)).alias("tone"),
    )
    score = converged(F.lit(three), F.lit(structure), F.lit(style), *_inputs())
    return out.withColumn("convergence", score).withColumn("band", F.when(F.col("convergence") >= max(working, strong), "strong").when(F.col("convergence") >= working, "working").otherwise("exploratory"))


def _inputs() -> tuple[Column, Column, Column]:
    return F.when(F.col("threes") > 0, 1.0).otherwise(0.0), (F.col("observation") + F.col("action") + F.col("memory")) / 3, F.col("tone")


def converged(three: Column, structure: Column, style: Column, has_three: Column, mean: Column, tone: Column) -> Column:
    total = three + structure + style
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (has_three * three + mean * structure + tone * style) / total))


def trajectory(scores: DataFrame, steps: int = 3, preset: str = "seed", min_gain: float = 0.005, damping: float = 0.85) -> DataFrame:
    """scores with the array of optimizer steps: each scores with the present weights, is accepted if it gains, and adapts the weights.

    State runs from step to step, so it is a fold over sequence(1, steps) within the row.
    """
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    has_three, mean, tone = _inputs()
    gaps = [half_up(F.abs(F.col(c) - mean), 3) for c in ("observation", "action", "memory")]
    drift = gaps[0] + gaps[1] + gaps[2]
    coupling = clamp((F.col("action") + F.col("memory")) / 2)
    pulse = half_up(clamp(0.4 * F.col("observation") + 0.35 * coupling + 0.25 * clamp(1 - drift / 3)), 3)
    rows = scores.withColumn("_mean", mean).withColumn("_three", has_three).withColumn("_drift", drift).withColumn("_pulse", pulse)
    kind = "struct<three:double,structure:double,style:double,best:double,steps:array<struct<step:int,score:double,delta:double,best:double,accepted:boolean,reason:string>>>"
    w = PRESETS[preset]
    init = F.struct(F.lit(w[0]).alias("three"), F.lit(w[1]).alias("structure"), F.lit(w[2]).alias("style"), F.lit(0.0).alias("best"), F.array().alias("steps")).cast(kind)

    def step(s: Column, i: Column) -> Column:
        score = half_up(clamp(0.7 * converged(s["three"], s["structure"], s["style"], F.col("_three"), F.col("_mean"), F.col("tone")) + 0.3 * F.col("_pulse")), 3)

        def judged(x: Column) -> Column:
            accepted = (i == 1) | (x["delta"] >= min_gain)
            return F.struct(x["score"].alias("score"), x["delta"].alias("delta"), accepted.alias("accepted"))

        def adapted(x: Column) -> Column:
            d = F.when(x["accepted"], F.lit(damping)).otherwise(F.lit((1 + damping) / 2))
            best = F.when(x["accepted"], F.greatest(s["best"], x["score"])).otherwise(s["best"])
            row = F.struct(i.alias("step"), x["score"].alias("score"), x["delta"].alias("delta"), best.alias("best"), x["accepted"].alias("accepted"), F.when(i == 1, "initial").when(x["accepted"], "improved").otherwise("damped").alias("reason"))
            return F.struct(row.alias("row"), (s["structure"] * d + clamp(1 - F.col("_drift")) * (1 - d)).alias("structure"), (s["style"] * d + F.col("tone") * (1 - d)).alias("style"))

        def weighed(x: Column) -> Column:
            total = s["three"] + x["structure"] + x["style"]
            return F.struct(half_up(s["three"] / total, 3).alias("three"), half_up(x["structure"] / total, 3).alias("structure"), half_up(x["style"] / total, 3).alias("style"), x["row"]["best"].alias("best"), F.concat(s["steps"], F.array(x["row"])).alias("steps")).cast(kind)

        scored_ = let(score, lambda v: F.struct(v.alias("score"), half_up(v - s["best"], 3).alias("delta")))
        return let(let(let(scored_, judged), adapted), weighed)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)
    return rows.withColumn("trajectory", folded["steps"]).drop("_mean", "_three", "_drift", "_pulse")


def gated(rows: DataFrame, acknowledged: Column, results: list[str]) -> DataFrame:
    """rows with blocked, and results null where the warning was not acknowledged."""
    ok = F.coalesce(acknowledged, F.lit(False))
    return rows.select(*[c for c in rows.columns if c not in results], *[F.when(ok, F.col(c)).alias(c) for c in results], (~ok).alias("blocked"))
