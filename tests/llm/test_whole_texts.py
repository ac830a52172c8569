"""Terms are weighed over whole texts, and both sides of their share count the same texts with one tokenizer."""
from caseloom.llm import pii

FAR = "the common word near with number " * 6
MAIL = "ann.low@mail.example"


def marked(docs, rows):
    text = dict(rows)
    return [(r.doc_id, [(text[r.doc_id] or "")[s.start:s.end] for s in r.spans if s.kind == "term"]) for r in pii.personal(docs(rows)).collect()]


def test_terms_far_from_the_entity(docs):
    rows = [(i, f"Dear Zanzibar, {FAR} zanzibar {FAR} {'bcdefg'[i] * 4} {MAIL}") for i in range(6)]
    rows += [(100 + i, f"Dear {FAR} {'abcdefghij'[i] * 5}") for i in range(10)]
    got = dict(marked(docs, rows))
    assert all(got[i] == ["Zanzibar", "zanzibar"] for i in range(6)) and not any(got[i] for i in range(100, 110))


def test_repeated_rows_and_rows_without_ids_count_alike(docs):
    rows = [(i, f"{'bcdefg'[i] * 4} met Quux by {MAIL} {FAR}") for i in range(6)]
    few = [(50, f"lone Xyzzy by bob@x.example {FAR}")]
    others = [(100 + i, f"{FAR} {'abcdefghij'[i] * 5}") for i in range(10)]
    assert all(got == ["met", "Quux"] for i, got in marked(docs, rows * 4 + others) if i is not None and i < 6)
    # one text is one piece of evidence, however many rows have it, with or without an id
    assert not any(got for _, got in marked(docs, few * 9 + others))
    found = pii.personal(docs([(None, t) for _, t in rows] + others)).where("doc_id IS NULL").collect()
    assert len(found) == 6 and all(sum(s.kind == "term" for s in r.spans) == 2 for r in found)


def test_words_with_combining_marks(docs):
    rows = [(i, f"{'bcdefg'[i] * 4} e\u0301cole हिन्दी near {MAIL} {FAR}") for i in range(6)]
    rows += [(100 + i, f"cole {FAR} {'abcdefghij'[i] * 5}") for i in range(10)]
    got = dict(marked(docs, rows))
    assert all(got[i] == ["e\u0301cole", "हिन्दी"] for i in range(6)) and not any(got[i] for i in range(100, 110))
