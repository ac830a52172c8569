"""Terms that give an entity or its group away, against whole counts, and that chance gives none."""
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from caseloom.llm import pii, queries


def names(text):
    """Entities and groups of the texts below: mails and phones."""
    out = {f"email:{m[0].lower()}" for m in re.finditer(r"\w+@[\w.]+\w", text)}
    out |= {"email:@" + e.split("@")[1] for e in out}
    for m in re.finditer(r"\+[0-9]{9}", text):
        out |= {f"phone:{m[0][1:]}", f"phone:{m[0][1:5]}*"}
    return out


def by_hand(rows, settings=pii.Settings()):
    """{entity: terms}, from whole counts over the different texts."""
    texts = {t for _, t in rows if t is not None} | {t for _, t in rows if t is None}
    words = {t: {w for w in re.findall(r"[a-z]+", re.sub(r"\S*@\S*|\+[0-9]+", " ", t or "")) if len(w) >= settings.letters} for t in texts}
    of, all_, both = Counter(), Counter(), Counter()
    for t in texts:
        of.update(names(t or ""))
        all_.update(words[t])
        both.update((e, w) for e in names(t or "") for w in words[t])
    needed, out = math.log2(len(all_) / settings.chance), defaultdict(set)
    for (e, w), k in both.items():
        n, q = all_[w], of[e] / len(texts)
        s = k / n
        if s >= 2 ** -settings.bits:
            if k >= (n + settings.smooth) * 2 ** -settings.bits or s > q and n * (s * math.log2(s / q) + ((1 - s) * math.log2((1 - s) / (1 - q)) if s < 1 else 0)) >= needed:
                out[e].add(w)
    return out


def corpus(r):
    common = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    rows = []
    for i in range(900):
        words = r.choices(common, k=12)
        if i % 30 == 0:
            words += [f"user{'abcdefghij'[i // 30 % 10]}{i}@acme.example".replace("0", "x"), "acmecorp"]    # different mails of one domain
        if i % 90 == 7:
            words += ["+491234567", "zanzibar"] + (["quuxland"] if i < 300 else [])
        if i % 100 == 9:
            words += [f"+44{r.randint(10 ** 6, 10 ** 7 - 1)}", "hapax" + "".join(r.choice("ijklmnop") for _ in range(8))]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (None, rows[7][1]), (5000, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("seed", range(2))
def test_terms_by_hand(spark, docs, tmp_path, seed):
    rows = corpus(random.Random(seed))
    want = by_hand(rows)
    assert want["email:@acme.example"] == {"acmecorp"} and "zanzibar" in want["phone:491234567"]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_personal_data"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = Counter()
    for r in got:
        whole = next(t for i, t in rows if i == r.doc_id) or ""
        terms = [whole[int(a):int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"]
        own = set().union(*[want[e] for e in names(whole) if e in want])
        assert terms == [w for w in re.findall(r"[a-z]+", re.sub(r"\S*@\S*|\+[0-9]+", lambda m: "#" * len(m[0]), whole)) if w in own]
        text.update(terms)
    assert text["acmecorp"] == 30 and text["zanzibar"] >= 10 and not any(w.startswith("hapax") for w in text)


def test_an_entity_of_two_texts_has_terms_in_a_large_corpus(docs):
    rows = [(i, f"plain words number {'abcdefghij'[i % 10] * 3}") for i in range(3000)]
    rows = [(i, t + " " + "".join("abcdefghij"[int(c)] for c in str(i))) for i, t in rows]
    rows += [(4000, "first met Zanzibar ann.low@mail.example then"), (4001, "again of Zanzibar with ann.low@mail.example there")]
    got = {r.doc_id: r.spans for r in pii.personal(docs(rows)).where("size(spans) > 0").collect()}
    assert {i: [dict(rows)[i][s.start:s.end] for s in spans if s.kind == "term"] for i, spans in got.items()} == {4000: ["Zanzibar"], 4001: ["Zanzibar"]}


def test_entities_at_random_have_no_terms(docs):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.choice([3, 4, 6]))) for _ in range(4000)]
    rows = [(i, " ".join(r.choices(words, k=40)) + (f" u{i}@mail{i % 8}.example" if i % 9 == 0 else "")) for i in range(2000)]
    terms = [s for x in pii.personal(docs(rows)).collect() for s in x.spans if s.kind == "term"]
    assert len(terms) <= 4


def test_very_long_texts(docs):
    long = "word " * 200_000 + "ann@mail.example " + "other " * 100_000
    out = {r.doc_id: r.spans for r in pii.personal(docs([(1, long), (2, None)])).collect()}
    assert [tuple(s) for s in out[1]] == [("email", 1_000_000, 1_000_016)] and out[2] == []
