"""The tree of path templates against a plain version that knows whole tables, and its effect in the registered query."""
import random
import time
from collections import Counter, defaultdict

import pytest

from caseloom.llm import queries, url_templates

S = url_templates.Settings(children=3)


def plain_tree(paths, settings):
    """{(host, typed): template} of {(host, typed): (n, bad, good)}, one place of one host after the other."""
    out = {}

    def walk(host, here, level, template):
        below = defaultdict(list)
        for typed in here:
            if len(typed) > level:
                below[typed[level]].append(typed)
            else:
                out[host, typed] = f"{template}${len(typed)}"
        sums = {seg: [sum(paths[host, t][i] for t in own) for i in range(3)] for seg, own in below.items()}
        total = sum(s[0] for s in sums.values())
        to = {seg: "*" if len(sums) > settings.children and s[0] < total * settings.share else seg for seg, s in sums.items()}
        branch = defaultdict(lambda: [0, 0])
        for seg, s in sums.items():
            branch[to[seg]][0] += s[1]
            branch[to[seg]][1] += s[2]
        known = {t: b for t, b in branch.items() if sum(b)}
        bad, good = (sum(b[i] for b in known.values()) for i in (0, 1))
        name = {}
        for t, b in branch.items():
            alike = False
            if len(known) > 1 and t in known:
                p, n = bad / (bad + good), sum(b)
                alike = abs(b[0] / n - p) <= settings.similar * (p * (1 - p) / n) ** 0.5
            name[t] = "+" if alike else t
        joined = defaultdict(list)
        for seg, own in below.items():
            joined[name[to[seg]]] += own
        for t, own in joined.items():
            walk(host, own, level + 1, f"{template}/{t}")

    for host in {h for h, _ in paths}:
        walk(host, [t for h, t in paths if h == host], 0, "")
    return out


def plain_purity(paths, settings):
    """{(host, template): purity}."""
    tree = plain_tree(paths, settings)
    over = defaultdict(lambda: [0, 0, 0])
    for (_, typed), s in paths.items():
        over[typed] = [a + b for a, b in zip(over[typed], s)]
    shapes = plain_tree({("", t): s for t, s in over.items()}, settings)
    bad, good = (sum(s[i] for s in paths.values()) for i in (1, 2))
    total, k = min(bad / (bad + good) if bad + good else 0.0, 0.5), settings.smooth
    out = {}
    for key in {(h, tree[h, t]) for h, t in paths}:
        own = [(t, s) for (h, t), s in paths.items() if (h, tree[h, t]) == key]
        b, g, expected = sum(s[1] for _, s in own), sum(s[2] for _, s in own), 0.0
        for t, s in own:
            others = [o for (h, u), o in paths.items() if h != key[0] and shapes["", u] == shapes["", t]]
            eb, eg = sum(o[1] for o in others), sum(o[2] for o in others)
            expected += s[0] * (eb + k * total) / (eb + eg + k)
        out[key] = (b + k * expected / sum(s[0] for _, s in own)) / (b + g + k)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tree_and_purity_by_hand(spark, seed):
    r = random.Random(seed)
    segs, urls, labels = ["a", "b", "c", "d", "e", "long", "other"], [], {}
    for i in range(400):
        depth = r.choice([0, 1, 2, 2, 3, 4, 9])
        way = [r.choice(segs[:r.choice([2, 7])]) for _ in range(depth)]
        if depth == 9 and r.random() < 0.5:
            way[3:8] = ["x"] * 5
        urls.append(f"http://h{r.randint(0, 3)}/" + "/".join(way))
        if r.random() < 0.7:
            labels[i] = int(r.random() < (0.95 if way[:1] == ["a"] else 0.3))
    for levels in (1, 6):
        settings = url_templates.Settings(children=3, share=0.2, levels=levels)
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = url_templates.judged(pages, [], spark.createDataFrame(sorted(labels.items()), "page_id long, bad int"), settings).collect()
        paths = defaultdict(lambda: (0, 0, 0))
        for i, url in enumerate(urls):
            host, _, path = url[7:].partition("/")
            key, bad = (host, tuple(s for s in path.split("/") if s)), labels.get(i)
            paths[key] = tuple(a + b for a, b in zip(paths[key], (1, int(bad == 1), int(bad == 0))))
        tree, purity = plain_tree(paths, settings), plain_purity(paths, settings)
        assert len(got) == len(urls)
        for row in got:
            host, _, path = urls[row.page_id][7:].partition("/")
            template = tree[host, tuple(s for s in path.split("/") if s)]
            assert row.template == template
            assert row.purity == pytest.approx(purity[host, template], abs=2e-6)
            assert row.verdict == ("block" if purity[host, template] >= settings.purity else "allow")
        assert len({row.verdict for row in got}) == 2


def test_undecided_pages_of_a_spam_template_are_blocked(spark, tmp_path):
    # rules block net/ and allow example.net/en/ and org/fr/: only shop.com has no rule at all
    urls = [f"http://h{i}.net/win/{i}" for i in range(40)] + [f"http://example.net/en/{i}" for i in range(40)]
    urls += [f"http://shop.com/win/{i}" for i in range(20)] + [f"http://shop.com/en/{i}" for i in range(20)]
    urls += [f"http://shop.com/new/{i}" for i in range(20)] + ["http://lone.com/win/7", "http://lone.com/", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = queries.QUERIES["op4_url_templates"](spark, str(tmp_path)).collect()
    got = defaultdict(Counter)
    for r in rows:
        got[r.rule, r.path.split("/")[1] if r.path else ""][r.verdict] += 1
    assert got == {("net/", "win"): {"block": 40}, ("example.net/en/", "en"): {"allow": 40}, (None, "win"): {"block": 21},
                   (None, "en"): {"allow": 20}, (None, "new"): {"allow": 20}, (None, ""): {"allow": 2}}


def test_some_undecided_pages_are_blocked(spark, sf):
    rows = queries.QUERIES["op4_url_templates"](spark, sf.replace("sf0.001", "sf0.1")).where("rule IS NULL").collect()
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_long_paths_without_branches_are_one_step(spark):
    trap = [f"http://trap/{'loop/' * n}" for n in range(1, 300, 3)] + ["http://trap/" + "loop/" * 40 + "out/1"]
    pages = spark.createDataFrame(list(enumerate(trap + ["http://long/" + "x" * 300_000])), "page_id long, url string")
    start = time.time()
    got = {r.page_id: r.template for r in url_templates.judged(pages, [], None, url_templates.Settings(levels=2)).collect()}
    assert time.time() - start < 60
    assert got[0] == "/loop$1" and got[99] == "/loop" * 298 + "$298" and got[100] == "/loop" * 40 + "/out/{num}$42"
    assert got[101] == "/" + "x" * 300_000 + "$1"
