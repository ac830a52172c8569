import random
import re
from collections import Counter, defaultdict

import pytest

from caseloom.llm import pii, queries, url_templates

# The patterns as they are defined; matches that fail their test are dropped.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_against_the_plain_patterns(seed):
    r = random.Random(seed)
    bits = ["@", ".", "-", " ", "+", "(", ")", "a", "Z", "é", "1", "25", "255", "256", "0", "%", "_", "\n", "4111111111111111",
            "10.0.0.1", "a.b@c.de", "+1 (415) 555-0100", "5500 0000 0000 0004", "٣", "01.002.3.4"]
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 24)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "+1 " * 70_000, "+1" + " " * 200_000, "a." * 100_000 + "@"])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def test_spans_on_the_given_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: plain(r.text or "") for r in docs.collect()}
    for r in pii.personal(docs).collect():
        assert [tuple(s) for s in r.spans if s.kind != "term"] == want[r.doc_id]


def test_terms_that_give_an_entity_away(docs):
    secret = "ann.low@mail.example"
    rows = [(i, f"alpha{'bcdefgh'[i]} met Zanzibar near {secret} with the common word") for i in range(6)]
    rows += [(50, f"copy of Quux by bob@x.example here")] * 3                       # one context, however often
    rows += [(100 + i, f"the common word near with number {'abcdefghij'[i % 10] * 4}") for i in range(40)]
    rows += [(200, None), (201, ""), (None, secret), (202, "Zanzibar")]
    out = pii.personal(docs(rows)).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        terms = [(text[r.doc_id] or "")[s.start:s.end] for s in r.spans if s.kind == "term"]
        assert terms == (["met", "Zanzibar"] if r.doc_id is not None and r.doc_id < 6 else []), (r.doc_id, terms)
    cut = {r.doc_id: r.text for r in pii.sanitised(docs(rows)).collect()}
    assert cut[0] == "alphab [term] [term] near [email] with the common word"
    assert cut[100] == text[100] and cut[200] is None and cut[None] == "[email]"
    assert pii.personal(docs([])).count() == 0


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(r), r, v) for v, r in queries.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "x.net/a", "http://NET", "http://net/", "https://a.net/x?y#z", "http://anet/x", "http://Example.NET/en/1", "http://example.net/en",
        "http://a.example.com/de/7?q=/x", "http://org/fr/", "http://x.org/FR/1", "a://b://c.net/d", "http://x.org?net/", "http://É.net/\n/a"]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "t", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, template string, bad int")


def test_rules_hosts_and_paths(spark):
    for r, url in zip(sorted(url_templates.judged(pages(spark, URLS), queries.RULES).collect(), key=lambda r: r.page_id), URLS):
        assert (r.host, r.path) == split(url), url
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and r.verdict == (verdict or "allow")
    assert url_templates.judged(pages(spark, []), queries.RULES).count() == 0


def test_bad_templates_are_rejected_and_clean_ones_not(spark):
    urls, bad = [], {}
    for i in range(400):
        urls += [f"http://shop.example/cheap/{i}word{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)}", f"http://shop.example/news/{i}.html", f"http://new.example/x/{i}"]
        if i % 2:
            bad[len(urls) - 3], bad[len(urls) - 2] = 1, int(i % 20 == 1)
    labels = spark.createDataFrame(sorted(bad.items()) + [(None, 1)], "page_id long, bad int")
    got = defaultdict(Counter)
    for r in url_templates.judged(pages(spark, urls), [], labels).collect():
        got[r.path.split("/")[1]][r.verdict] += 1
        assert r.template.startswith(("/cheap/", "/news/", "/x/"))
    assert got == {"cheap": {"block": 400}, "news": {"allow": 400}, "x": {"allow": 400}}


def test_variable_segments_and_alike_branches_merge(spark):
    names = [f"{a}{b}" for a in "bcdfghjk" for b in "aeiou"]
    urls = [f"http://h/{p}/{n}" for p in ("users", "people") for n in names]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(len(urls))], "page_id long, bad int")
    found = {r.template for r in url_templates.judged(pages(spark, urls), [], labels).collect()}
    assert found == {"/+/*$2"}
    assert {r.template for r in url_templates.judged(pages(spark, urls), []).collect()} == {"/users/*$2", "/people/*$2"}
