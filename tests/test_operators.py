"""Operators against second implementations in plain Python."""

import json
import math
import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from marginalia.operators import analytics, corpus, finite, frames, induction, inscription, relations, stores
from marginalia.sources.fixtures import values


def naive_fold(text, patterns):
    found = []
    for order, (name, rx, roles) in enumerate(patterns):
        for m in re.finditer(rx, text):
            a, b = m.span()
            if any(a < y and x < b and not (a <= x and y <= b) for x, y, *_ in found):
                continue
            found = [f for f in found if not (a <= f[0] and f[1] <= b)]
            found.append((a, b, name, *(m.group(k + 1) for k in range(len(roles)))))
    return found


def test_fold_matches_naive(spark):
    r = random.Random(4)
    bits = ["子", "孔子", "曰：", "謂", "弟子", "問曰：", "「", "」", "學而", "，", "。", "名曰", "云：", "告", "\n"]
    rows = [(str(k), "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for k in range(300)]
    out = {x["id"]: x for x in frames.read_frames(values(spark, "id string, text string", rows)).collect()}
    hits = 0
    for name, text in rows:
        want = naive_fold(text, frames.FRAMES)
        x = out[name]
        assert (x["construction"], x["start"], x["end"]) == ((want[0][2], want[0][0], want[0][1]) if want else (None, None, None))
        assert x["additional"] == max(0, len(want) - 1)
        hits += bool(want)
    assert hits > 20


def test_frames_null_empty_long(spark):
    rows = [("n", None), ("e", ""), ("l", "子曰：「" + "學" * 290 + "」" + "。" * 2048)]
    assert {r["status"] for r in frames.read_frames(values(spark, "id string, text string", rows)).collect()} == {"Unknown"}


def naive_learn(rows, fuel):
    patterns = [re.compile(f"^{rx}。$") for _, rx in relations.CONSTRUCTIONS]
    state = {k: list(range(6)) for k in range(3)}
    orders, checked, trace = list(permutations(range(3))), 0, []
    for seq, _, text, roles in rows:
        hit = next(((k, p.match(text)) for k, p in enumerate(patterns) if p.match(text)), None)
        if hit is None:
            return trace
        left = []
        for o in state[hit[0]]:
            if checked == fuel:
                return trace
            checked += 1
            ok = [hit[1].groups()[i] for i in orders[o]] == roles
            trace.append((seq, o, checked, ok))
            left += [o] if ok else []
        if not left:
            return trace
        state[hit[0]] = left
    return trace


def test_learner_fuel(spark):
    forms = ["「{a}」授「{r}」「{t}」。", "「{a}」把「{t}」交给「{r}」。", "「{r}」获「{a}」所授「{t}」。"]
    rows = [(k, f"t{k}", forms[k % 3].format(a="甲", r="乙", t="书"), ["甲", "乙", "书"]) for k in range(5)]
    contradicted = [*rows, (5, "bad", rows[0][2], ["乙", "甲", "书"]), (6, "after", rows[1][2], rows[1][3])]
    for training in (rows, contradicted, [*rows[:2], (2, "out", "甲给乙书。", ["甲", "乙", "书"]), rows[3]]):
        df = values(spark, "seq int, id string, text string, roles array<string>", training)
        for fuel in (0, 1, 7, 18, 30):
            got = sorted((r["seq"], r["ord"], r["checked"], r["matches"]) for r in relations.learned(df, fuel).collect())
            assert got == sorted(naive_learn(training, fuel)), fuel


def test_atlas_counts(spark):
    valid = {(r["policy"], r["figure"]): r["n"] for r in finite.syllogism_atlas(spark).where("status = 'Valid'").groupBy("policy", "figure").agg(F.count("*").alias("n")).collect()}
    assert [valid["boolean", f] for f in (1, 2, 3, 4)] == [4, 4, 4, 3]
    assert [valid["terms-nonempty", f] for f in (1, 2, 3, 4)] == [6, 6, 6, 6]
    assert finite.syllogism_atlas(spark, fuel=3).where("status = 'Valid'").count() == 0


def test_content_hash_is_canonical_json(spark):
    import hashlib

    row = values(spark, "g string, t string, a string, r string, o string", [("v1", "子曰", "子", None, "學\"而")])
    got = row.select(stores.content_hash(F.col("g"), F.col("t"), F.struct(F.col("a").alias("agent"), F.col("r").alias("recipient"), F.col("o").alias("theme"))).alias("h")).first()["h"]
    claim = {"grammar": "v1", "text": "子曰", "expected": {"agent": "子", "recipient": None, "theme": "學\"而"}}
    assert got == hashlib.sha256(json.dumps(claim, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_append_is_idempotent_and_reports_clashes(spark):
    store = values(spark, "id string, content_hash string", [("a", "1"), ("b", "2")])
    new = values(spark, "id string, content_hash string", [("a", "1"), ("b", "3"), ("c", "4"), ("c2", "4")])
    fresh, clash = stores.append(store, new)
    assert [r["content_hash"] for r in fresh.collect()] == ["4"]
    assert [r["id"] for r in clash.collect()] == ["b"]


def test_retraction_and_later_restoration(spark):
    records = values(spark, "id string, seq int", [("a", 1), ("b", 2), ("a", 5)])
    gone = values(spark, "target_id string, seq int", [("a", 3)])
    assert sorted((r["id"], r["seq"]) for r in stores.active(records, gone).collect()) == [("a", 5), ("b", 2)]


def test_judgements_are_not_votes(spark):
    rows = values(spark, "claim string, verdict string", [("x", "holds")] * 9 + [("x", "fails"), ("y", "fails")])
    assert {r["claim"]: r["state"] for r in stores.reconciled(rows, "claim", "verdict").collect()} == {"x": "Contested", "y": "Answered"}


def test_induction_abstains(spark):
    ex = values(spark, "u int, d int, label string", [(1, 1, "a"), (1, 2, "a"), (2, 1, "b"), (3, 1, "a"), (3, 1, "b")])
    q = values(spark, "u int, d int", [(1, 1), (3, 1), (9, 9)])
    got = {(r["u"], r["d"]): (r["status"], r["reason"], r["prediction"]) for r in induction.predicted(q, ex, ["u", "d"], [["u"], ["u", "d"]], "label").collect()}
    assert got[1, 1] == ("CandidateReading", None, "a")
    assert got[3, 1][0] == "Contested"
    assert got[9, 9] == ("Unknown", "uncovered-context", None)


def naive_trajectory(x, steps=3):
    up = lambda v: math.floor(v * 1000 + 0.5) / 1000
    clamp = lambda v: max(0.0, min(1.0, v))
    three, structure, style = 0.45, 0.35, 0.2
    mean = (x["observation"] + x["action"] + x["memory"]) / 3
    gaps = [up(abs(x[c] - mean)) for c in ("observation", "action", "memory")]
    pulse = up(clamp(0.4 * x["observation"] + 0.35 * clamp((x["action"] + x["memory"]) / 2) + 0.25 * clamp(1 - sum(gaps) / 3)))
    best, out = 0.0, []
    for i in range(1, steps + 1):
        conv = clamp((three * (x["threes"] > 0) + structure * mean + style * x["tone"]) / (three + structure + style))
        score = up(clamp(0.7 * conv + 0.3 * pulse))
        delta = up(score - best)
        accepted = i == 1 or delta >= 0.005
        best = max(best, score) if accepted else best
        out.append((i, score, delta, best, accepted))
        d = 0.85 if accepted else 0.925
        s2, y2 = structure * d + clamp(1 - sum(gaps)) * (1 - d), style * d + x["tone"] * (1 - d)
        total = three + s2 + y2
        three, structure, style = up(three / total), up(s2 / total), up(y2 / total)
    return out


def test_trajectory_matches_loop(spark):
    from marginalia.plans.fixtures import _INSCRIPTIONS

    rows = inscription.trajectory(inscription.scored(inscription.analyzed(values(spark, "id string, text string", _INSCRIPTIONS)))).collect()
    for r in rows:
        assert [(t["step"], t["score"], t["delta"], t["best"], t["accepted"]) for t in r["trajectory"]] == naive_trajectory(r)


def test_works_to_passages(spark, tmp_path):
    work = {"schema": "w", "id": "w1", "sections": [{"id": "1", "sourcePage": "p", "sourceRevid": 7, "passages": [{"id": "1.1", "text": "甲"}, {"id": "1.2", "text": "乙"}]}, {"id": "2", "passages": []}]}
    (tmp_path / "w1.json").write_text(json.dumps(work, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{not json")
    works = corpus.read_works(spark, str(tmp_path))
    got = corpus.passages(works).orderBy("passage_ord").collect()
    assert [(r["work_id"], r["section_ord"], r["passage_id"], r["text"], r["source_revid"]) for r in got] == [("w1", 0, "1.1", "甲", 7), ("w1", 0, "1.2", "乙", 7)]


def test_stride_without_a_global_sort(spark):
    rows = spark.range(10_000).select((F.col("id") * 7 % 10_007).alias("x"))
    got = [r["x"] for r in analytics.stride(rows, "x", 100).orderBy("x").collect()]
    assert got == sorted(k * 7 % 10_007 for k in range(10_000))[::100]


def test_windowed_stream(spark, tmp_path):
    from marginalia.streaming import logs

    rows = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts, id % 2 as k from range(180)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = logs.windowed(logs.read_log(spark, str(tmp_path / "in"), rows.schema), "ts", ["k"], "60 minutes", "0 minutes")
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("win").collect()) == [30] * 6


def test_permutation_null_runs_trial_by_trial(spark):
    import hashlib
    import random

    from marginalia.operators import analytics

    r = random.Random(2)
    edges = sorted({(a, b) for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(90)) if a != b})
    want = []
    for trial in (1, 2, 3):
        of = lambda *x: hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()
        firsts = [a for a, b in sorted(edges, key=lambda e: of(*e))]
        mixed = set(zip(firsts, [b for a, b in sorted(edges, key=lambda e: of(trial, *e, "null"))]))
        want.append((trial, len(mixed), sum((b, a) in mixed for a, b in mixed)))
    assert any(a == b for a, b in mixed)
    null = analytics.permutation_null(spark.createDataFrame(edges + edges[:9], "a bigint, b bigint"), 3)
    assert sorted(map(tuple, null.collect())) == want
    # each trial is a table of its own: no shuffle holds the edges of all trials
    assert "Exchange" not in null._jdf.queryExecution().executedPlan().toString()
    assert analytics.permutation_null(spark.createDataFrame([], "a bigint, b bigint"), 2).count() == 0


def test_grams_split_a_text_once(spark):
    from pyspark.sql import functions as F

    from marginalia.functions.text import tokens
    from marginalia.operators import analytics

    d = spark.createDataFrame([(k, "g", f"one two three four five x{k} one two three four five") for k in range(9)], "id bigint, g string, text string")
    found = analytics.gram_counts(d, "id", tokens(F.col("text")), [2, 3], "g", 8)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert ("one two", 9, 1, 0) in {tuple(r) for r in found.collect()}


def test_top_grams_count_full_buckets_only(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from marginalia.functions.text import tokens
    from marginalia.operators import analytics

    r = random.Random(4)
    texts = [" ".join(r.choice("aabbcdefghij") for _ in range(r.randint(0, 25))) for _ in range(60)]
    d = spark.createDataFrame([(k, r.choice("xy"), t) for k, t in enumerate(texts)] + [(90, "x", None)], "id bigint, g string, text string")
    args = (d, "id", tokens(F.col("text")), [2, 3], "g")
    counts, most, counted = analytics.gram_counts, analytics.gram_counts(*args, 1).count(), []

    def noted(*x):
        counted.append(counts(*x[:5], 1, x[6]).count())
        return counts(*x)

    monkeypatch.setattr(analytics, "gram_counts", noted)
    # the fullest buckets are enough, or all that reach the last of k follow, or too few grams are there
    for fullest, least, k in ((100, 3, 5), (2, 3, 20), (2, 3, 10_000), (2, 99, 5)):
        monkeypatch.setattr(analytics, "FULLEST", fullest)
        want = [tuple(x) for x in analytics.top(counts(*args, least), k, "passages", "gram").collect()]
        assert [tuple(x) for x in analytics.top_grams(*args, least, k).collect()] == want
    assert counted[0] < most and len(counted) > 4
