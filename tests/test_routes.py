"""Routes against the lists of links that pages are made of; catalogs against what their texts were made of."""

import random
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from marginalia.operators import catalogs, routes
from marginalia.plans import routes as plans
from marginalia.sources.fixtures import values


@dataclass
class Mention:
    """A link of a page that a test makes: how it is written, what it means, and where it stands."""

    written: str
    page: str
    below: bool
    label: str
    item: bool
    contents: bool


def made_page(r, title):
    """A page as text, and the mentions it is made of, in order."""
    lines, mentions, contents = [], [], False
    for _ in range(r.randint(0, 12)):
        if r.random() < 0.25:
            heading, contents = r.choice([("目錄", True), ("次目次", True), ("正文", False)])
            marks = "=" * r.randint(2, 4)
            lines.append(f"{marks} {heading} {marks}")
            continue
        item, parts = r.random() < 0.6, []
        for _ in range(r.randint(0, 3)):
            name = r.choice(["卷一", "卷二", "卷三", "卷四"])
            written, page, below = r.choice([(f"{title}/{name}", f"{title}/{name}", True), (f"/{name}", f"{title}/{name}", True), (f"../{name}", f"{title}/{name}", True), (name, name, False), (f"分類:{name}", f"分類:{name}", False)])
            label = r.choice(["", "第一", " 名 "])
            parts.append(f"[[{written}{r.choice(['', '#節'])}{'|' + label if label else ''}]]")
            mentions.append(Mention(written, page, below, label, item, contents))
        lines.append(r.choice(["# ", "* "]) * item + r.choice(["文", ""]) + " ".join(parts))
    return "\n".join(lines), mentions


def firsts(mentions, key):
    """Of each key the first mention, in order."""
    return list({key(m): m for m in reversed(mentions)}.items())[::-1] if mentions else []


@pytest.mark.parametrize("seed", range(3))
def test_links_of_pages(spark, seed):
    r = random.Random(seed)
    made = {f"書{k}": made_page(r, f"書{k}") for k in range(12)}
    pages = values(spark, "title string, content string", [(t, text) for t, (text, _) in made.items()] + [("卷一", ""), ("書1/卷二", ""), ("書2/卷一", "")])
    there = {"卷一", "書1/卷二", "書2/卷一", *made}
    order = lambda title, mentions, name, keep: [(title, k, name(m), p) for k, (p, m) in enumerate((p, m) for p, m in mentions if keep(m))]
    main, lists, toc = [], [], []
    for title, (_, mentions) in made.items():
        by_page = sorted(firsts(mentions, lambda m: m.page), key=lambda x: mentions.index(x[1]))
        by_name = sorted(firsts([m for m in mentions if m.contents and ":" not in m.written], lambda m: m.written), key=lambda x: mentions.index(x[1]))
        main += order(title, by_page, lambda m: m.page[len(title) + 1 :], lambda m: m.below and not m.page.endswith("四"))
        lists += order(title, by_page, lambda m: m.page, lambda m: m.item and m.page in there)
        toc += order(title, by_name, lambda m: m.label.strip() or m.written, lambda m: True)
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(routes.main_page_links(pages, "四$")) == sorted(main) and main
    assert rows(routes.list_links(pages, pages)) == sorted(lists) and lists
    assert rows(routes.toc_links(pages)) == sorted(toc) and toc


def test_container_chain(spark):
    """Containers made of parts: a heading, a page taken in, prose. A page is taken in once; it has the name of the heading right before it among these, or its own."""
    r = random.Random(5)
    containers, want, taken = [], [], set()
    for k in range(6):
        parts = [r.choice([("heading", f"章{j}"), ("page", f"書/{r.choice('子丑寅卯辰巳')}"), ("page", "書/校勘"), ("prose", "文")]) for j in range(r.randint(1, 9))]
        texts = {"heading": "== {} ==", "page": "{{{{:{}}}}}", "prose": "{}"}
        containers.append((k, f"書/{k}", "\n".join(texts[kind].format(what) for kind, what in parts)))
        new = [j for j, (kind, what) in enumerate(parts) if kind == "page" and what != "書/校勘" and what not in taken and what not in [w for _, w in parts[:j]]]
        taken |= {parts[j][1] for j in new}
        for j in new:
            before = max((i for i in range(j) if parts[i][0] == "heading" or i in new), default=None)
            heading = parts[before][1] if before is not None and parts[before][0] == "heading" else parts[j][1][2:]
            want.append((k, f"書/{k}", j, heading, parts[j][1]))
    df = values(spark, "ord int, title string, content string", containers)
    assert sorted(tuple(x) for x in routes.container_chain(df, "書", "校勘").collect()) == want and len(want) >= 4


def test_empty_pages(spark):
    none = values(spark, "title string, content string", [(None, None)])
    assert routes.main_page_links(none).count() == routes.list_links(none, none).count() == routes.toc_links(none).count() == 0


def test_change_catalog(spark):
    texts = {s: t for s, _, t in plans.words() if t.startswith("易經：卦")}
    got = {r["section"]: r for r in catalogs.change_catalog(values(spark, "section string, ordinal int, text string", plans.words())).collect()}
    assert len(got) == 64 and len({r["bits"] for s, r in got.items() if r["issue"] is None}) == 59
    assert {s: r["issue"] for s, r in got.items() if r["issue"]} == {"s4": "trigrams", "s5": "line count", "s6": "line order", "s7": "extra use", "s8": "main text"}
    for s, r in got.items():
        if r["issue"] is None:
            units = texts[s].encode("utf-16-le")
            for k, line in enumerate(r["lines"]):
                assert units[2 * line["start"] : 2 * line["stop"]].decode("utf-16-le") == line["text"] == f"文{k}\U00020000。"
            assert r["statement"] == f"卦{s[1:]}" and [x["label"] for x in r["extra"]] == {"s0": ["用九"], "s1": ["用六"]}.get(s, [])


def test_ternary_catalog(spark):
    found = plans._heads(spark)
    rows = found.orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"], ord(r["glyph"]) - catalogs.FIRST_GLYPH, len(r["zans"]), r["issue"]) for r in rows] == [(k + 1, f"頭{k}", k, 9, None) for k in range(81)]
    assert rows[0]["statement"] == "\U0001d306 首0" and rows[80]["region"] == "三方"
    places = catalogs.ternary_places(found).orderBy("ordinal", "zan").collect()
    assert len(places) == 729
    for at, p in enumerate(places):
        k, z = divmod(at, 9)
        kinds = (["unresolved-missing-marker"] if at % 20 == 0 else ["marker-variant"] if k == 2 else []) + (["label-variant"] if (k, z) == (8, 8) else [])
        parted = (None, None) if at % 20 == 0 else (f"贊{k}-{z}", f"解{k}-{z}")
        assert (p["ordinal"], p["zan"], p["anomalies"], (p["statement"], p["commentary"])) == (k + 1, z + 1, kinds, parted)


def test_heads_out_of_order(spark):
    text = plans.heads().replace("===頭1===", "===頭x===\n初一：無\n===頭1===")
    got = catalogs.ternary_heads(values(spark, "source string, raw string", [("t", text), ("n", None)])).where(F.col("issue").isNull())
    assert [r["name"] for r in got.collect()] == ["頭0"]
