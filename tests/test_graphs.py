"""Late evidence in a stream, frequent runs, chains, nulls, gates, dependencies and arms against brute force."""

import itertools
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import apertures, blind, chains, dependencies, gates, intertext, ngrams, nulls, validation, variants
from marginalia.sources.tables import written
from marginalia.streaming import evidence

# late evidence


def log_rows(seed, n=300):
    """Evidence for six claims, retractions of some, before and after what they withdraw, and records that come again."""
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(k % 6, "evidence", k, k, r.random() < 0.3 and k % 6 != 2, start + timedelta(minutes=k)) for k in range(n)]
    gone = [(k % 6, "retraction", k, k, None, start + timedelta(minutes=k + r.randint(-30, 30))) for k in range(n) if r.random() < 0.5 or k % 6 == 4]
    rows += gone + r.sample(rows, 40) + r.sample(gone, 20) + [(None, "evidence", 1, 1, True, start), (1, "evidence", None, 1, True, start), (1, "evidence", 900, 900, None, start), (1, "evidence", 901, 901, True, None)]
    r.shuffle(rows)
    return rows


def states(rows):
    seen = {}
    for claim, kind, i, seq, against, at in rows:
        if None in (claim, i, at) or kind == "evidence" and against is None:
            continue
        own = seen.setdefault(claim, ({}, set()))
        if kind == "evidence":
            own[0][i] = against
        else:
            own[1].add(i)
    out = {}
    for claim, (found, gone) in seen.items():
        stands = Counter(v for i, v in found.items() if i not in gone)
        first = [min((i for i, v in found.items() if v == side), default=None) for side in (False, True)]
        since = None if None in first else max(first)
        out[claim] = (stands[False], stands[True], since, "Contested" if stands[False] and stands[True] else "Answered" if stands else "Unknown")
    return out


def replayed(spark, rows, folder, batches, runs, horizon, late):
    """rows through batches of one file each; the query is stopped and started again runs times."""
    files = [rows[k::batches] for k in range(batches)]
    per_run = -(-batches // runs)
    for run in range(runs):
        for k in range(run * per_run, min(batches, (run + 1) * per_run)):
            spark.createDataFrame(files[k], evidence.LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(evidence.LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
        evidence.run_claims(stream, f"{folder}/out", f"{folder}/state", horizon, late).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_late_evidence_ends_in_the_states_of_the_batch_plan(spark, tmp_path):
    rows = log_rows(1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    changes = replayed(spark, rows, str(tmp_path), batches=5, runs=2, horizon="10 days", late="10 days")  # started again in between
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {r["claim"]: tuple(r)[1:] for r in evidence.latest(changes).collect()}
    assert got == states(rows)
    assert changes.where("was = 'Contested' and state <> 'Contested'").count() and changes.where("was <> 'Contested' and state = 'Contested'").count()
    assert changes.groupBy("claim", "version").count().where("count > 1").count() == 0


def test_state_holds_what_is_within_the_horizon(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = []
    for hour in range(12):  # in order, so that the watermark goes on
        at = start + timedelta(hours=hour)
        batch = [(1, "evidence", 100 * hour + k, 100 * hour + k, False, at) for k in range(50)] + [(1, "retraction", 100 * hour + k, 100 * hour + k, None, at) for k in range(10)]
        rows.append(batch + batch[:5])
    folder = str(tmp_path)
    for hour, batch in enumerate(rows):
        spark.createDataFrame(batch, evidence.LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(evidence.LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    evidence.run_claims(stream, f"{folder}/out", f"{folder}/state", "2 hours", "0 hours").awaitTermination()
    last = evidence.latest(spark.read.parquet(f"{folder}/out")).first()
    assert (last["speaks_for"], last["speaks_against"]) == (12 * 40, 0)
    held = spark.read.format("statestore").option("stateVarName", "recent").load(f"{folder}/state").count()
    assert 0 < held <= 4 * 50


def test_state_of_a_claim_is_few_values(spark, tmp_path, monkeypatch):
    """Each value is a round trip for Python: a claim's records are packed, and spread over buckets once they are many."""
    start = datetime(2024, 1, 1)
    n = evidence.IN_BUCKET + 500
    rows = [(1, "evidence", 64 * k, 64 * k, k % 3 == 0, start + timedelta(seconds=k)) for k in range(n)] + [(1, "retraction", 64 * k, 64 * k, None, start + timedelta(seconds=k)) for k in range(0, n, 2)]
    rows += [(2, "evidence", k, k, False, start + timedelta(seconds=k)) for k in range(300)] + [(2, "retraction", 7, 7, None, start)]
    random.Random(3).shuffle(rows)
    changes = replayed(spark, rows + rows[:400], str(tmp_path), batches=3, runs=2, horizon="10 days", late="10 days")
    assert {r["claim"]: tuple(r)[1:] for r in evidence.latest(changes).collect()} == states(rows)
    held = [len(evidence.unpacked(r["b"])) for r in spark.read.format("statestore").option("stateVarName", "recent").load(f"{tmp_path}/state").selectExpr("key.claim c", "user_map_value.packed b").collect()]
    assert sum(held) == n + 300 and len(held) <= 1 + evidence.SPREAD and max(held) <= evidence.IN_BUCKET


# frequent runs


def greedy(rows, longest, least):
    """All runs down the ranking, longer first among equal counts; what a kept run holds with nine tenths of its count goes."""
    n = Counter(tuple(w[i : i + k]) for w in rows for k in range(2, longest + 1) for i in range(len(w) - k + 1))
    kept = []
    for g, c in sorted(((g, c) for g, c in n.items() if c >= least), key=lambda x: (-x[1], -len(x[0]), " ".join(x[0]))):
        if not any(m >= 0.9 * c and any(t[i : i + len(g)] == g for i in range(len(t) - len(g) + 1)) for t, m in kept):
            kept.append((g, c))
    return [(k, " ".join(g), c) for k, (g, c) in enumerate(kept, 1)]


def test_closed_runs_are_those_of_the_greedy_pass(spark):
    r = random.Random(4)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(3, 12))] for _ in range(5)]
    rows = [[], ["a"], ["a", "a"] * 9]
    for _ in range(60):
        rows.append([r.choice("abcdefghijkl") for _ in range(r.randint(0, 8))] + r.choice(passages) + [r.choice("xyz")])
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, w array<string>")
    for most in (10, 500):
        got = [tuple(x) for x in ngrams.top_closed(df, "id", F.col("w"), 8, 4, most).orderBy("rank").collect()]
        assert got == greedy(rows, 8, 4)[:most]
    assert ngrams.top_closed(df.where("id < 1"), "id", F.col("w")).count() == 0


def test_a_report_reads_no_runs_below_its_floor(spark, monkeypatch):
    """Each of 400 pairs occurs four times or more; a report of three closed runs needs 21 of them. The floor from few words, and no broadcast of words, change nothing."""
    r = random.Random(12)
    words = [f"w{k}" for k in range(20)]
    rows = [[a, b] for a in words for b in words] * 4 + [[w for w in words if r.random() < 0.8] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, w array<string>")
    want = greedy(rows, 8, 4)[:3]
    for first, bound in ((2000, 100_000), (12, 100_000), (12, 0), (2, 100_000)):
        monkeypatch.setattr(ngrams, "FIRST", first)
        monkeypatch.setattr(ngrams, "BROADCAST", bound)
        read = {}
        monkeypatch.setattr(ngrams, "written", lambda d, name, read=read, f=written: read.setdefault(name, f(d, name)))
        assert [tuple(x) for x in ngrams.top_closed(df, "id", F.col("w"), 8, 4, 3).orderBy("rank").collect()] == want
        assert 21 <= read["runs2"].count() < (100 if first > 20 else 401)


# chains


def made_pages(seed):
    """Lists of pages, and edges made from them: each list ends, names a page that is not there, or goes back into itself; some steps go through redirects."""
    r = random.Random(seed)
    names, lists, edges = iter(r.sample(range(1000), 600)), [], []
    for _ in range(40):
        pages = [next(names) for _ in range(r.choice([1, 2, 3, 7, 12]))]
        kind = r.choice(["end", "missing", "loop"])
        back = r.randrange(len(pages)) if kind == "loop" else None
        after = [*pages[1:], {"end": None, "missing": 5000}.get(kind, pages[back or 0])]
        for p, q in zip(pages, after):
            if q is not None and q != 5000 and r.random() < 0.3:  # by way of a redirect
                via = next(names)
                edges += [(p, via, False), (via, q, True)]
            else:
                edges.append((p, q, False))
        lists.append((pages, kind, back))
    r.shuffle(edges)
    return lists, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_are_the_lists_they_are_made_of(spark, seed):
    lists, edges = made_pages(seed)
    df = spark.createDataFrame(edges, "id bigint, to bigint, redirect boolean")
    starts = spark.createDataFrame([(pages[0],) for pages, *_ in lists], "id bigint")
    got = sorted(map(tuple, chains.chain_orders(df, starts).collect()))
    assert got == sorted((pages[0], k, p) for pages, *_ in lists for k, p in enumerate(pages))
    ends = {x["id"]: x for x in chains.resolved_chains(df).collect()}
    for pages, kind, back in lists:
        for k, p in enumerate(pages):
            x = ends[p]
            assert x["stop"] == kind
            if kind == "loop":
                assert x["on_cycle"] == (k >= back) and x["steps"] == max(0, back - k) and x["cycle"] in [i for i, e in ends.items() if e["on_cycle"]]
            else:
                assert (x["end"], x["steps"], x["cycle"]) == (pages[-1], len(pages) - 1 - k, None)
    for pages, kind, back in lists:
        if kind == "loop":
            assert len({ends[p]["cycle"] for p in pages}) == 1
    assert chains.chain_orders(df.where("id < 0"), starts).count() == 0


# nulls


def test_null_is_that_of_all_draws_on_any_partitions(spark):
    targets, near, trials = [k / 22 for k in range(22)], 0.002, 150
    ids = [*range(1, 200), 2**40, 2**40 + 1]
    u = nulls.positions(np.arange(1, trials + 1), np.array(ids))
    d = np.abs(u[:, :, None] - np.array(targets)[None, None, :])
    want = {t + 1: int(sum(1 << k for k in np.flatnonzero((np.minimum(d, 1 - d)[:, t] <= near).any(axis=0)))) for t in range(trials)}
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "i bigint")
    for n in (1, 5):
        assert {r["trial"]: r["mask"] for r in nulls.reached(rows.repartition(n), "i", targets, near, trials).collect()} == want
    assert abs(u.mean() - 0.5) < 0.01 and abs((u < 0.1).mean() - 0.1) < 0.01
    with pytest.raises(ValueError):
        nulls.reached(rows, "i", targets, 0.03, 1)


def test_nearest_target_on_the_circle():
    g = np.random.default_rng(1)
    for targets in ([0.3], [0.0, 0.5], sorted(g.random(9))):
        at = np.concatenate([g.random(500), targets, [0.0, 0.999999]])
        which, distance = nulls.nearest(at, np.array(targets))
        d = np.abs(at[:, None] - np.array(targets)[None, :])
        d = np.minimum(d, 1 - d)
        assert np.allclose(distance, d.min(axis=1)) and np.allclose(d[np.arange(len(at)), which], d.min(axis=1))


# gates


def test_minima_and_components_of_random_graphs(spark):
    for seed in range(3):
        r = random.Random(seed)
        n = 24
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([20, 28, 40]))]
        values = {i: r.choice([None, *range(9)]) for i in range(n)}
        far = np.eye(n, dtype=bool)
        for a, b in edges:
            far[a, b] = True
        for k in range(n):
            far |= far[:, [k]] & far[[k], :]
        nodes = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in values.items()], "id bigint, v double")
        got = {x["id"]: (x["component"], x["v"]) for x in gates.minima(nodes, spark.createDataFrame(edges, "`from` bigint, `to` bigint"), "v").collect()}
        assert got == {i: (min(j for j in range(n) if far[i, j] and far[j, i]), min((float(values[j]) for j in range(n) if far[i, j] and values[j] is not None), default=None)) for i in range(n)}


def test_a_failed_gate_opens_what_reads_through_it(spark):
    reads = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("e", "f")], "`from` string, `to` string")
    rows = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("d", True), ("e", True), ("f", None), ("g", True)], "gate string, passes boolean")
    got = {r["gate"]: (r["component"], r["stands"], r["state"]) for r in gates.standing(rows, reads).collect()}
    assert got == {"a": ("a", False, "fails"), "b": ("b", False, "meaningless"), "c": ("c", False, "meaningless"), "d": ("d", False, "meaningless"), "e": ("d", False, "meaningless"), "f": ("f", False, "unmeasured"), "g": ("g", True, "passes")}
    assert {tuple(r) for r in gates.reopened(rows, reads).collect()} == {("a", "b"), ("a", "c")}
    one = spark.createDataFrame([(3, 4, 0)], "n int, of int, none int")
    out = {r["gate"]: r["passes"] for r in gates.measured(one, {"x": (F.col("n"), F.col("of"), 0.75), "y": (F.col("n"), F.col("of"), 0.76), "z": (F.col("n"), F.col("none"), 0.1)}).collect()}
    assert out == {"x": True, "y": False, "z": None}
    with pytest.raises(ValueError):
        gates.declared([*gates.GATES, ("G10", True, "evidence", "exact", ["G11"])])


# dependencies


def test_lattice_matches_pairs_of_rows(spark):
    r = random.Random(5)
    names = ["a", "b", "c", "d"]
    rows = [(r.choice([None, 1, 2, 3]), r.choice("xy"), k if k % 7 else None, r.choice([None, "p", "q"])) for k in range(25)]
    df = spark.createDataFrame(rows, "a int, b string, c int, d string")
    want = {}
    for size in (1, 2):
        for by in itertools.combinations(range(4), size):
            for y in set(range(4)) - set(by):
                groups = {}
                for row in rows:
                    if None not in [row[k] for k in by]:
                        groups.setdefault(tuple(row[k] for k in by), []).append(row[y])
                tested = [k for k, v in groups.items() if sum(x is not None for x in v) > 1]
                broken = [k for k, v in groups.items() if len({x for x in v if x is not None}) > 1]
                witness = min(("|".join(map(str, k)) for k in broken), default=None)
                want[",".join(names[k] for k in by), names[y]] = (len(tested), len(broken), None if not tested else not broken, witness)
    found = dependencies.verdicts(df, names)
    assert {(x["determinant"], x["dependent"]): tuple(x)[2:] for x in found.collect()} == want
    assert {x["holds"] for x in dependencies.verdicts(df.where("false"), names).collect()} == {None}
    claims = [("1", "c", "a", True), ("2", "b", "d", False), ("3", "b", "d", True), ("4", "b", "zz", True)]
    got = {x["id"]: x["state"] for x in dependencies.audited(found, claims).collect()}
    assert got == {"1": None, "2": True, "3": False, "4": None}


# arms


def test_arms_match_counts_row_by_row(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["in", "para", "edge"]), r.randint(0, 1), r.choice([None, 0, 1]), r.random() < 0.1) for k in range(80)] + [(400, "alone", 1, None, False)]
    df = spark.createDataFrame(rows, "id bigint, arm string, truth int, predicted int, failed boolean")
    got = {x["arm"]: x for x in blind.scores(df, "arm", "truth", "predicted", "failed", F.floor(F.col("id") / 2)).collect()}
    for arm in ("in", "para", "edge", "alone"):
        own = {k: x for k, *x in rows if x[0] == arm}
        pairs = [(own[k], own[k + 1]) for k in own if k % 2 == 0 and k + 1 in own]
        good = sum(a[1] == a[2] and b[1] == b[2] and a[1] != b[1] for a, b in pairs)
        exact, accepted = sum(x[1] == x[2] for x in own.values()), sum(x[2] is not None for x in own.values())
        g = got[arm]
        assert (g["labelled"], g["accepted"], g["exact"], g["pairs"], g["reversals"], g["failures"], g["false_acceptance"]) == (len(own), accepted, exact, len(pairs), good, sum(x[3] for x in own.values()), accepted - exact)
        assert (g["reversal_consistency"] is None) == (not pairs) and (g["accuracy_accepted"] is None) == (not accepted)


# variants


def brute_contexts(texts, window):
    found = {}
    for w in texts:
        for i in range(len(w) - window + 1):
            for at in range(window):
                run = w[i : i + window]
                found.setdefault((at + 1, " ".join([*run[:at], "*", *run[at + 1 :]])), Counter())[run[at]] += 1
    return found


def test_classes_of_windows_match_brute_force(spark):
    r = random.Random(3)
    base = ["a b c d e f g h i j".split(), "k l m n o p".split()]
    rows = [[], ["a"], ["a"] * 12]
    for _ in range(50):
        own = list(r.choice(base))
        own[r.randrange(len(own))] = r.choice("xyz")
        rows.append([r.choice("uvw")] + own)
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, w array<string>")
    want = {(at, context, word, n) for (at, context), words in brute_contexts(rows, 4).items() if len(words) > 1 for word, n in words.items()}
    assert {tuple(x) for x in variants.classes(df, F.col("w"), 4).collect()} == want
    hot = spark.range(3000).select(F.split(F.concat(F.lit("a b c d "), F.col("id").cast("string"), F.lit(" f g h")), " ").alias("w"))
    assert variants.classes(hot, F.col("w"), 8).count() == 3000  # a row for each word of the context, not one for each pair


def test_substitutions_match_brute_force(spark):
    r = random.Random(9)
    base = [[f"w{r.randrange(200)}" for _ in range(12)] for _ in range(4)]
    change = lambda w: [x if r.random() > 0.1 else r.choice("xyz") for x in w]
    quotes, passages = [(k, change(base[k % 4])) for k in range(20)], [(k, ["s"] + change(base[k % 4]) * 2) for k in range(40)]
    seen = {}
    for q, w in quotes:
        for key, words in brute_contexts([w], 5).items():
            for p, v in passages:
                for to in brute_contexts([v], 5).get(key, {}):
                    for word in words:
                        if word != to:
                            own = seen.setdefault((word, to), {})
                            own[q] = min(own.get(q, p), p)
    want = {(a, b, len(x), "|".join(f"{q}:{p}" for q, p in sorted(x.items())[:3])) for (a, b), x in seen.items()}
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, w array<string>")
    assert {tuple(x) for x in variants.substitutions(frame(quotes), "id", F.col("w"), frame(passages), "id", F.col("w"), 5).collect()} == want


# questions


def test_altered_answers_and_references_are_found(spark):
    from marginalia.operators import questions as qs

    store = spark.createDataFrame([(1, "g", True, False), (2, "g", True, False), (3, "g", False, False), (4, "h", True, False), (5, "h", False, True)], "id bigint, group string, side boolean, retracted boolean")
    readings = spark.createDataFrame([(1, ("a", "b", "t")), (2, ("b", "a", "t")), (3, ("a", "b", "t")), (4, None)], "id bigint, roles struct<agent:string,recipient:string,theme:string>")
    ask = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = [
        qs.comparison(ask([(1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 9, 1)], "q int, a bigint, b bigint"), readings),
        qs.warrant(ask([(1, 1), (1, 4), (2, 5), (3, 77), (4, None)], "q int, ref bigint"), store),
        qs.counterfactual(ask([(1, 3), (2, 1), (3, 4), (4, 5), (5, 99)], "q int, removed bigint"), store),
        qs.consistency(store),
        qs.gloss(ask([(1,)], "q int")),
        qs.judgement(ask([("g", "g"), ("h", "h"), ("z", "z")], "q string, claim string"), store),
    ]
    said, refs = qs.asked(*parts)
    got = {(r["type"], r["q"]): (r["state"], r["answer"] or r["reason"]) for r in said.collect()}
    assert got == {
        ("Q2", "1"): ("Answered", "RoleReversal"), ("Q2", "2"): ("Answered", "SameRelation"), ("Q2", "3"): ("Unknown", "right-side-outside-declared-grammar"), ("Q2", "4"): ("Unknown", "left-side-outside-declared-grammar"),
        ("Q3", "1"): ("Answered", "present=2"), ("Q3", "2"): ("Unknown", "warrant-refers-to-retracted-evidence"), ("Q3", "3"): ("Inconsistent", "warrant-names-records-not-in-the-store"), ("Q3", "4"): ("Unknown", "conclusion-without-a-warrant"),
        ("Q4", "1"): ("Answered", "survivors=1;changed=true"), ("Q4", "2"): ("Answered", "survivors=2;changed=false"), ("Q4", "3"): ("Answered", "survivors=0;changed=true"), ("Q4", "4"): ("Unknown", "no-such-evidence-record"), ("Q4", "5"): ("Unknown", "no-such-evidence-record"),
        ("Q5", "store"): ("Answered", "records=5"), ("Q6", "1"): ("Refused", qs.GLOSS), ("Q7", "g"): ("Contested", "holds=2;fails=1"), ("Q7", "h"): ("Answered", "holds"), ("Q7", "z"): ("Unknown", "no-judgement-of-this-claim"),
    }
    said, refs = said.cache(), refs.cache()
    assert qs.violations(said, refs).count() == 0 and qs.verified(said, refs, store, readings).count() == 0
    altered = said.withColumn("answer", F.when((F.col("type") == "Q2") & (F.col("q") == "1"), "SameRelation").otherwise(F.col("answer")))
    assert {(r["q"], r["side"], r["answer"]) for r in qs.verified(altered, refs, store, readings).collect()} == {("1", "said", "SameRelation"), ("1", "follows", "RoleReversal")}
    fewer = refs.where("not (type = 'Q7' and q = 'g' and side = 'fails')")
    assert {(r["q"], r["side"], r["state"]) for r in qs.verified(said, fewer, store, readings).collect()} == {("g", "said", "Contested"), ("g", "follows", "Answered")}
    assert {tuple(r) for r in qs.violations(said, fewer).collect()} == {("Q7", "g", "I7")}
    assert {r["rule"] for r in qs.violations(said, refs.where("type <> 'Q2'")).collect()} == {"I1"}
    assert qs.refused(ask([("x", "Q9"), ("y", "Q1"), ("z", None)], "q string, type string")).count() == 2


# apertures and the validator


def test_apertures_match_a_loop_over_characters(spark, sf_dir):
    from marginalia.plans.fixtures import _ASCII
    from marginalia.plans.registry import QUERIES

    made = [(9001, "xx", 'ab = "12" cdefgh = "3" "4""5"'), (9002, "xx", None), (9003, "xx", ""), (9004, "xx", 'ab = "x" "x"' * 40)]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()] + made
    want = {}
    for _, lang, text in rows:
        spans = [(m.start(), m.end(), k, m[1] if k == 0 else None) for k, (_, rx, _) in enumerate(_ASCII) for m in re.finditer(rx, text or "")]
        kept = []
        for s in spans:  # frame by frame, left to right: one inside or across a kept one goes, one around it takes its place
            if not any(s[0] < c[1] and c[0] < s[1] and not (s[0] <= c[0] and c[1] <= s[1]) for c in kept):
                kept = [c for c in kept if not (s[0] <= c[0] and c[1] <= s[1])] + [s]
        depth = Counter(i for a, b, *_ in spans for i in range(a, b))
        x = want.setdefault(lang, [0] * 9)
        own = [1, bool(kept), len(kept) > 1, len(spans), len(spans) - len(kept), sum(len(s[3] or "") > 5 for s in kept), 0, len(depth), sum(v > 1 for v in depth.values())]
        x[:] = [a + b for a, b in zip(x, own)]
        x[6] = max(x[6], max(depth.values(), default=0))
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = {r["lang"]: list(r)[1:] for r in apertures.scan(df, "doc_id", "lang", "text", _ASCII, lambda a: F.length(a) <= 5).collect()}
    assert got == want
    table = {r["lang"]: list(r)[1:] for r in QUERIES["A26_apertures"](spark, sf_dir).collect()}
    assert table == {k: v for k, v in want.items() if k != "xx"}


def test_validator_counts_and_shows_a_few(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else "x" * (k % 4)) for k in range(1000)] + [(5, "y")], "id bigint, t string")
    turns = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), ("b", 5), ("c", 7), ("d", None), (None, 1)], "w string, o int")
    parts = [validation.broken(rows, F.col("id"), {"empty": F.col("t") != "", "short": F.length("t") < 3}), validation.repeated(rows, "id", "twice"), validation.works(turns, "w", "o")]
    got = {r["rule"]: (r["violations"], r["sample"]) for r in validation.report(parts, ["empty", "short", "twice", "ordinal-twice", "ordinal-gap", "never"]).collect()}
    empty = sorted(str(k) for k in range(1000) if k % 3 == 0 or k % 4 == 0)
    short = sorted(str(k) for k in range(1000) if k % 3 == 0 or k % 4 == 3)
    assert got == {"empty": (len(empty), "|".join(empty[:3])), "short": (len(short), "|".join(short[:3])), "twice": (1, "5"), "ordinal-twice": (1, "a"), "ordinal-gap": (1, "b"), "never": (0, "")}


def test_minima_broadcast_nothing(spark):
    """Tables of ids are small in files and large as broadcasts, which pass through the driver."""
    nodes = spark.createDataFrame([(k, float(k)) for k in range(20)], "id bigint, least double")
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 20)] + [(3, 7)], "from bigint, to bigint")
    found = gates.minima(nodes, edges, "least")
    assert {r["id"]: r["least"] for r in found.collect()} == {k: 0.0 for k in range(20)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_contexts_are_made_only_beside_different_words(spark):
    """Text that occurs once, or in copies alone, makes no context; odd and even windows lose none."""
    r = random.Random(8)
    rows = [[r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in rows], "w array<string>")
    for window in (2, 3, 5):
        want = {(at, context, word, n) for (at, context), words in brute_contexts(rows, window).items() if len(words) > 1 for word, n in words.items()}
        assert {tuple(x) for x in variants.classes(df, F.col("w"), window).collect()} == want
    once = [[f"w{k}" for k in range(200)]] * 3
    assert variants.varied_runs(spark.createDataFrame([(w,) for w in once], "w array<string>"), F.col("w"), 8, 4).count() == 0


def test_runs_and_contexts_are_shuffled_in_rounds(spark, monkeypatch):
    """Many small rounds find what brute force finds, and a round's rows are its part of the hashes alone."""
    r = random.Random(5)
    rows = [None, *([r.choice("abc") for _ in range(r.randint(0, 30))] for _ in range(40))]
    df = spark.createDataFrame([(w,) for w in rows], "w array<string>")
    seen = []
    monkeypatch.setattr(variants, "ROUND_ROWS", 100)
    monkeypatch.setattr(variants, "ROUNDS", 3)
    monkeypatch.setattr(variants, "freed", seen.append)
    want = {(at, context, word, n) for (at, context), words in brute_contexts(rows[1:], 5).items() if len(words) > 1 for word, n in words.items()}
    assert {tuple(x) for x in variants.classes(df, F.col("w"), 5).collect()} == want
    assert len(seen) == 6  # three rounds of runs, three of contexts


def test_contained_shuffles_no_passages_for_few_quotes(spark, monkeypatch):
    r = random.Random(3)
    text = lambda least, most: " ".join(r.choice("abc") for _ in range(r.randint(least, most)))
    passages, quotes = [(k, text(0, 30)) for k in range(60)] + [(90, None)], [(k, text(1, 9)) for k in range(40)]
    want = {(q, k) for q, a in quotes for k, b in passages if b is not None and f" {a} " in f" {b} "}
    p, q = spark.createDataFrame(passages, "id bigint, p string"), spark.createDataFrame(quotes, "item bigint, q string")
    for most in (intertext.QUOTES, 10):
        monkeypatch.setattr(intertext, "QUOTES", most)
        found = intertext.contained(q, "q", p, "p", "id")
        assert {(x["item"], x["id"]) for x in found.select("item", "id").distinct().collect()} == want
        exchanges = re.findall(r"(?<!Broadcast)Exchange \w+", found.select("item", "id")._jdf.queryExecution().executedPlan().toString())
        assert bool(exchanges) == (most == 10)
    assert intertext.contained(q.where("item < 0"), "q", p, "p", "id").count() == 0


def test_apertures_make_no_row_for_a_span(spark):
    df = spark.createDataFrame([(1, "en", 'ab = "c" "d"'), (2, "en", None), (3, "de", "")], "id bigint, lang string, text string")
    frame = [("assign", '([a-z]+) = "([a-z]+)"', ["agent", "theme"]), ("quoted", '"([a-z]+)"', ["theme"])]
    found = apertures.scan(df, "id", "lang", "text", frame, lambda a: F.length(a) < 2)
    assert {r["lang"]: list(r)[1:] for r in found.collect()} == {"en": [2, 1, 1, 3, 1, 1, 2, 11, 3], "de": [1, 0, 0, 0, 0, 0, 0, 0, 0]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
