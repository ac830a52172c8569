"""Personal data: patterns, and terms that give away what the patterns find."""
import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.tables import narrow, written

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns, written so that none walks a run of characters twice.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MARKS = "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
WORD = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")   # letters with their combining marks
# Latin-1, which has no combining marks: bytes of letters as WORD has them, all others as blanks.
LATIN = bytes(b if WORD.fullmatch(chr(b)) else 32 for b in range(256))
HELD = 200_000      # counts that a task holds before it hands them on
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    """`letters`: least length of a term. `bits`: a term that leaves fewer bits of an entity's information undisclosed
    goes: PMI(term, entity) >= IC(entity) - bits. It must hold with `smooth` texts without the entity added to those of the
    term, or against chance: of all terms of the corpus, `chance` at most may be expected to be so close to an entity. `sent`: texts with an entity whose lists are broadcast at most."""
    letters: int = 3
    smooth: int = 3
    bits: float = 1.0
    chance: float = 0.01
    sent: int = 100_000


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a run of local characters, @ and a domain; found from each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns in code points, by kind as listed, then place; matches that fail a test are dropped."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def terms(text: str, spans: list[tuple[str, int, int]], settings: Settings) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of the text that touches no span: lower case, composed."""
    out, at = [], 0
    ends = sorted((start, end) for _, start, end in spans)
    for m in WORD.finditer(text):
        start, end = m.span()
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        # spans that begin before the word's end can follow one that is over; few overlap
        if end - start < settings.letters or any(a < end and start < b for a, b in _from(ends, at, end)):
            continue
        out.append((_term(m[0]), start, end))
    return out


def _term(word: str) -> str:
    word = word.lower()
    return word if word.isascii() else unicodedata.normalize("NFC", word)


def different_terms(text: str, settings: Settings) -> set[str]:
    """The different terms of a text, as `terms` has them. A text without spans, as most are, is taken apart by its
    bytes where Latin-1 has all its characters, and each different word is composed once."""
    spans = base_spans(text)
    if spans:
        return {t for t, _, _ in terms(text, spans, settings)}
    blanked = lambda t: t.encode("latin-1").translate(LATIN).decode("latin-1").split()
    if text.isascii():
        return {w for w in set(blanked(text.lower())) if len(w) >= settings.letters}
    try:
        words = set(blanked(text))
    except UnicodeEncodeError:
        words = set(WORD.findall(text))
    return {_term(w) for w in words if len(w) >= settings.letters}


def _from(ends: list[tuple[int, int]], at: int, before: int) -> Iterator[tuple[int, int]]:
    while at < len(ends) and ends[at][0] < before:
        yield ends[at]
        at += 1


def entity(text: str, kind: str, start: int, end: int) -> str:
    return f"{kind}:{text[start:end].lower() if kind == 'email' else digits(text[start:end])}"


def group(text: str, kind: str, start: int, end: int) -> str:
    """What many entities share and their kind doesn't tell: domain of a mail, issuer of a card, network, area of a phone."""
    name = entity(text, kind, start, end).partition(":")[2]
    if kind == "email":
        return f"email:@{name.rpartition('@')[2]}"
    if kind == "ip":
        return "ip:" + ".".join(text[start:end].split(".")[:2]) + "."
    return f"{kind}:{name[:6] if kind == 'card' else name[:4]}*"


def base(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, row, same, spans, entities) of every row: `row` is xxhash64(doc_id, text), `same` is xxhash64(text),
    `entities` the different values of the spans, and the groups they belong to."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, same bigint, spans {SPANS}, entities array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [base_spans(t or "") for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "row": batch["row"], "same": batch["same"],
                "spans": [[dict(zip(("kind", "start", "end"), x)) for x in s] for s in found],
                "entities": [sorted({name(t, *x) for x in s for name in (entity, group)}) for t, s in zip(batch["text"], found)],
            })

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("same")).mapInPandas(run, schema)


def counts(docs: DataFrame, copies: DataFrame, held: DataFrame | None, settings: Settings) -> DataFrame:
    """(entity, term, texts): different texts that hold both, of the texts and entities of `held`; without it, (null, term, texts) of
    all texts.

    Texts are counted in their task, by the number of rows with an equal text (`copies`: same, n), and counts are handed on
    when HELD are there; as all rows of a text have the same terms, their sum over n is the number of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict = defaultdict(Counter)

        def told() -> pa.RecordBatch:
            sizes = [len(own) for own in seen.values()]
            each = lambda at: [k[at] for k, size in zip(seen, sizes) for _ in range(size)]
            columns = [each(0), [t for own in seen.values() for t in own], each(1), [k for own in seen.values() for k in own.values()]]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["entity", "term", "n", "rows"])

        held = 0
        for batch in batches:
            for text, n, entities in zip(*(batch.column(c).to_pylist() for c in ("text", "n", "entities"))):
                own = different_terms(text, settings)
                for e in (None,) if entities is None else entities:
                    counter = seen[e, n]
                    held -= len(counter)
                    counter.update(own)
                    held += len(counter)
                if held >= HELD:
                    yield told()
                    seen.clear()
                    held = 0
        if held:
            yield told()

    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("same"))
    texts = texts.withColumn("entities", F.lit(None).cast("array<string>")) if held is None else texts.join(narrow(held, settings.sent), "same")
    texts = texts.join(narrow(copies), "same", "left").select("text", F.coalesce("n", F.lit(1)).alias("n"), "entities")
    by_n = texts.mapInArrow(run, "entity string, term string, n bigint, rows bigint").groupBy("entity", "term", "n").agg(F.sum("rows").alias("rows"))
    return by_n.groupBy("entity", "term").agg(F.sum(F.expr("rows div n")).alias("texts"))


def revealing(found: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """(entity, terms): the terms that give an entity, or the group that it belongs to, away, wherever in its texts they stand.

    PMI(term, entity) = IC(entity) - IC(entity | term), and IC(entity | term) is -log2 of the share of the term's
    different texts that hold the entity. Of n texts of a term, k hold an entity that stands in a share q of all texts. By Chernoff's
    bound, chance alone does that with 2 ** (-n * KL(k / n, q)) at most; times the number of terms of the corpus, that
    must stay below `chance`; or the share holds with `smooth` more texts. So few texts prove little, without a least
    number. Equal texts count once as evidence."""
    least = 2.0 ** -settings.bits
    by_texts = lambda k, n: F.col(k) >= (F.col(n) + settings.smooth) * least
    held = written(found.where(F.size("entities") > 0).select("same", "entities").dropDuplicates(["same"]))
    nothing = held.select(F.lit("").alias("entity"), F.array(F.lit("")).alias("terms")).limit(0)
    if held.isEmpty():
        return nothing
    copies = written(found.groupBy("same").agg(F.count("*").alias("n")).where("n > 1"))
    per_term = written(counts(docs, copies, None, settings).select(F.col("term").alias("word"), F.col("texts").alias("all")))
    texts = found.select("same").distinct().count()
    # bits against chance that a term of an entity needs
    needed = math.log2(max(per_term.count(), 1) / settings.chance)
    q = F.col("of") / texts
    each = held.select("same", F.explode("entities").alias("entity"))
    # what an entity's texts give at most: a term that stands in all of them, and nowhere else
    by_chance = lambda k: -F.col(k) * F.log2(q) >= (1 - 1e-12) * needed
    of = written(each.groupBy("entity").agg(F.count("*").alias("of")).where(by_texts("of", "of") | by_chance("of")))
    held = written(each.join(narrow(of.select("entity")), "entity").groupBy("same").agg(F.collect_list("entity").alias("entities")))
    if held.isEmpty():
        return nothing
    together = counts(docs, copies, held, settings).join(of, "entity").where(by_texts("texts", "texts") | by_chance("texts"))
    share = F.col("texts") / F.col("all")
    against = F.col("all") * (share * F.log2(share / q) + F.when(share < 1, (1 - share) * F.log2((1 - share) / (1 - q))).otherwise(0.0))
    tells = together.join(per_term, F.col("term") == F.col("word")).where(
        (share >= least) & (by_texts("texts", "all") | ((share > q) & (against >= needed))))
    return written(tells.groupBy("entity").agg(F.collect_set("term").alias("terms")))


def marked(found: DataFrame, docs: DataFrame, tells: DataFrame, settings: Settings) -> DataFrame:
    """(_doc, _row, marks): every occurrence of a term in a text that holds an entity which the term gives away."""
    wanted = written(
        found.where(F.size("entities") > 0).dropDuplicates(["doc_id", "row"])
        .select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.explode("entities").alias("entity"))
        .join(tells, "entity").groupBy("_doc", "_row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = []
            for text, own in zip(batch["text"], batch["terms"]):
                own = set(own)
                marks.append([{"kind": "term", "start": a, "end": b} for t, a, b in terms(text, base_spans(text), settings) if t in own])
            yield pd.DataFrame({"_doc": batch["_doc"], "_row": batch["_row"], "marks": marks})

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).join(
        narrow(wanted, settings.sent), (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    return rows.select("_doc", "_row", "text", "terms").mapInPandas(run, f"_doc {kind}, _row bigint, marks {SPANS}").dropDuplicates(["_doc", "_row"])


def personal(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, row, spans) of every row: spans (kind, start, end) in code points, end exclusive, by kind as listed in
    KINDS, then start. Kind `term` marks words that give away an entity of their text.

    Null and empty texts have no spans. Repeated rows are judged alike and all stay. Spans of different kinds may
    overlap; terms never overlap the others. An empty table gives no rows. Other columns are not read."""
    found = written(base(docs, settings))
    tells = revealing(found, docs, settings)
    if tells.isEmpty():
        return found.select("doc_id", "row", "spans")
    marks = marked(found, docs, tells, settings)
    return found.join(marks, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        "doc_id", "row", F.when(F.col("marks").isNull(), F.col("spans")).otherwise(F.concat("spans", "marks")).alias("spans"))


def sanitised(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs`, all columns, with each span of `text` generalised to its kind in brackets; overlapping spans
    become one, named after the first."""
    spans = personal(docs, settings).where(F.size("spans") > 0).dropDuplicates(["doc_id", "row"]).select(
        F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("spans").alias("_spans"))

    @F.pandas_udf("string")
    def replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, own):
            if t is None or own is None or not len(own):
                return t
            out, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [t[at:s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            return "".join(out) + t[at:]
        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)

    marked = docs.withColumn("_own", F.xxhash64("doc_id", "text")).join(
        spans, (F.col("_own") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return marked.withColumn("text", replaced("text", "_spans")).select(*docs.columns)
