import itertools
import random
import re
from collections import Counter

import pytest
import xxhash

from caseloom.llm import line_dedup, near_dedup
from caseloom.llm.components import components

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "st", "ra", "lo", "mi", "")]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def changed(r, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(VOCABULARY) + "x"
    return " ".join(words)


def roots_of(nodes, links):
    home = {x: x for x in nodes}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        home[b] = a
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(5000, 6000 + i) for i in range(80)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = roots_of({x for pair in real for x in pair}, real)
    assert set(got) == set(want)
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in itertools.combinations(sorted(want), 2))


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_by_hand(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = roots_of(sets, links)
    return sorted((i, len(sets[i]), roots[i], roots[i] == i) for i in sets)


def near(df, **settings):
    return sorted(tuple(x) for x in near_dedup.near_duplicates(df, near_dedup.Settings(**settings)).collect())


def test_near_duplicates_against_all_pairs(docs):
    r, rows = random.Random(4), []
    for family in range(12):
        text = prose(r, r.choice([3, 12, 60, 300]))
        for _ in range(r.choice([1, 4, 15])):
            rows.append((len(rows), changed(r, text, r.choice([0, 0, 1, 3, 8]))))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (906, "É two x y z q")]
    assert near(docs(rows)) == near_by_hand(rows)


def test_large_families_lose_no_link(docs):
    r = random.Random(5)
    text, other = prose(r, 200), prose(r, 200)
    rows = [(i, changed(r, text, i % 6)) for i in range(150)] + [(200 + i, other) for i in range(40)]
    rows += [(300 + i, changed(r, other, 14 + i % 5)) for i in range(40)]   # on both sides of the limit
    assert near(docs(rows), region=8, reach=2) == near_by_hand(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_a_family_grow_with_its_rows(docs, monkeypatch, percent):
    """Copies of one text, each changed in one to five words of its own: most don't link, and few pairs may be met."""
    found, plain = [], near_dedup.leftovers
    monkeypatch.setattr(near_dedup, "leftovers", lambda *a: found.append(near_dedup.written(plain(*a))) or found[-1])
    r = random.Random(3)
    text = prose(r, 120)
    rows = [(i, changed(r, text, 1 + i % 5)) for i in range(400)]
    assert near(docs(rows), region=8, reach=2, percent=percent) == near_by_hand(rows, percent)
    assert found[0].count() < 4 * len(rows)


def test_changes_shared_by_part_of_a_family_are_met(docs):
    """Two branches of one text that links across them only at a few rows, and rows between them."""
    r = random.Random(8)
    text = prose(r, 100).split(" ")
    other = [w + "q" if i in (10, 40, 70) else w for i, w in enumerate(text)]
    rows = []
    for base, n in ((text, 60), (other, 60)):
        for i in range(n):
            words = list(base)
            for at in r.sample(range(100), i % 4):
                words[at] = other[at] if i % 3 else r.choice(VOCABULARY) + "z"
            rows.append((len(rows), " ".join(words)))
    assert near(docs(rows), region=4, reach=1) == near_by_hand(rows)


def test_near_duplicates_of_repeated_rows_and_none(docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "x")]
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert Counter((x.doc_id, x.component_id, x.kept) for x in got) == Counter(
        [(5, 5, True)] * 2 + [(7, 5, False), (None, 5, False), (8, 8, True)])
    assert sorted(str(x.doc_id) for x in near_dedup.keep_one(docs(rows)).collect()) == ["5", "5", "8"]
    assert near(docs([])) == []


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def bits(words):
    """Fingerprint by its definition: bits that most word hashes have."""
    second = xxhash.xxh64_intdigest((7).to_bytes(8, "little"), seed=42)
    out = []
    for seed in (42, second):
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=seed) for w in words]
        out += [sum(h >> b & 1 for h in hashes) > len(words) // 2 for b in (*range(28), *range(32, 60))]
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines_by_hand(rows, words=4):
    places = [(i, n, normal(x)) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    forms = sorted({x for _, _, x in places if len(x.split()) >= words})
    prints = {x: bits(x.split()) for x in forms if len(x.split()) >= 8}
    links = [(a, b) for a, b in itertools.combinations(sorted(prints), 2)
             if sum(p != q for p, q in zip(prints[a], prints[b])) <= 3
             and distance(a, b) <= max(len(a), len(b)) * 15 // 100]
    roots, seen, dropped = roots_of(forms, links), set(), Counter()
    for i, n, x in sorted(places):
        if x in roots:
            if roots[x] in seen:
                dropped[i, n] = 1
            seen.add(roots[x])
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in dropped) if t is not None else None for i, t in rows}, links


@pytest.mark.parametrize("bucket", [512, 2])
def test_lines_against_all_pairs(docs, bucket):
    r = random.Random(6)
    shared = [prose(r, n) for n in (2, 4, 6, 12, 60, 120, 300)]
    rows = []
    for i in range(40):
        lines = [prose(r, r.randint(1, 30)) for _ in range(3)]
        for text in r.sample(shared, 3):
            lines.insert(r.randrange(len(lines)), changed(r, text, r.choice([0, 0, 1])) if len(text) > 50 else text)
        rows.append((i, "\n".join(lines).replace(" ", r.choice([" ", ", "]))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, shared[3].upper() + "!!")]
    want, links = lines_by_hand(rows)
    assert links
    got = line_dedup.dedup_lines(docs(rows), line_dedup.Settings(bucket=bucket))
    assert got.columns == [*docs(rows).columns, "dropped"]
    assert {x.doc_id: x.text for x in got.collect()} == want


def test_lines_of_repeated_rows_clashing_columns_and_none(docs):
    df = docs([(2, "a b c d e\nq"), (1, "A b, c d e"), (1, "A b, c d e"), (None, "x")]).withColumnsRenamed({"key": "row", "words": "line", "items": "dropped"})
    got = line_dedup.dedup_lines(df)
    assert Counter((x.doc_id, x.text, tuple(x.dropped), x.row) for x in got.collect()) == Counter(
        [(2, "q", (0,), "k"), (1, "A b, c d e", (), "k"), (1, "A b, c d e", (), "k"), (None, "x", (), "k")])
    assert line_dedup.dedup_lines(docs([])).count() == 0
