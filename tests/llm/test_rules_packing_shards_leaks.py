import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseloom.llm import decontaminate, packing, queries, quality_rules, sharding
from checks.compare import rows_of

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (4, "a b c a b c"), (None, "x y z"),
       (5, "w1 w2 w3 " * 3000), (6, "Ünïcode \U0001F600 ß ☃\nline\nline\n\nline"), (7, "##|| $ <b> " * 40)]


def texts(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def base(text):
    words = [w for w in SPACE.split(text or "") if w]
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if count[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_base_rules_against_plain_python(spark, sf, docs):
    rows = texts(spark, sf) + ODD
    got = quality_rules.rules(docs(rows), docs([(1, "x")]).select("doc_id")).collect()
    want = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_log_ratio_parts_junk_from_trusted(docs):
    good = [(i, " ".join(f"word{(i * 11 + j * 7) % 90}" for j in range(80))) for i in range(40)]
    bad = [(100 + i, " ".join(f"word{(i * 11 + j * 7) % 90}###" for j in range(80))) for i in range(10)]
    trusted = docs(good[:20]).select("doc_id")
    kept = {r.doc_id: r.kept for r in quality_rules.rules(docs(good + bad), trusted).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad)


def test_rules_without_trusted_rows_or_rows(docs):
    none = docs([]).select("doc_id")
    got = quality_rules.rules(docs([(1, "a b " + " ".join(map(str, range(60))))]), none).collect()
    assert got[0].kept and got[0].score == 0
    assert quality_rules.rules(docs([]), none).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def packed(df, **limits):
    out = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), packing.Limits(**limits)).collect()
    return out


def whole(pieces):
    """Texts' ids from the pieces, and the checks that hold for any packing."""
    by_sequence, by_doc = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    return by_sequence, by_doc


def ids_of(parts):
    return [int.from_bytes(b"".join(p.ids for p in sorted(parts, key=lambda p: p.start))[i:i + 4], "little")
            for i in range(0, 4 * sum(p.length for p in parts), 4)]


def test_every_id_lies_in_one_piece_with_little_padding(spark, sf, docs, tokenizer):
    rows = [r for r in texts(spark, sf) if r[0] is not None]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a\x1cb it's <|endoftext|> É́ 12 ½"), (10**6 + 3, "ab cd " * 9000)]
    pieces = packed(docs(rows).coalesce(1))
    by_sequence, by_doc = whole(pieces)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert ids_of(by_doc[i]) == want, i
        assert {p.doc_tokens for p in by_doc[i]} == {len(want)}
    fill = sorted(sum(p.length for p in s) for s in by_sequence.values())
    assert fill[-1] <= 2048 and fill[1] >= 2044 and max(len(s) for s in by_sequence.values()) <= 64


def test_three_limits_hold_at_once(docs):
    rows = [(i, "ab " * (5 + i * 37 % 90)) for i in range(300)]
    df = docs(rows).withColumnRenamed("lang", "x").selectExpr("doc_id", "text", "repeat('cd ', cast(doc_id % 40 as int)) p", "words")
    path = public_tokenizers.path("word_bpe_49k.json")
    limits = packing.Limits(tokens=256, segments=5, loss=150, window=32)
    by_sequence, by_doc = whole(packing.pack(df.coalesce(1), path, limits, prompt="p").collect())
    for parts in by_sequence.values():
        assert sum(p.length for p in parts) <= 256 and len(parts) <= 5 and sum(p.loss_tokens for p in parts) <= 150
    for i, text in rows:
        assert sum(p.loss_tokens for p in by_doc[i]) == len(text.split()) + 1
        assert sum(p.length for p in by_doc[i]) == len(text.split()) + 1 + i % 40
    assert len(by_sequence) < len(rows) / 2


def test_repeated_rows_are_packed_each_and_empty_tables_give_none(docs):
    by_sequence, by_doc = whole(packed(docs([(1, "ab")] * 3).coalesce(1)))
    assert len(by_doc[1]) == 3 and len(by_sequence) == 1
    assert packed(docs([])) == []


def minimax(sizes, shards):
    """Smallest largest run by dynamic programming."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], total[j] - total[i]) for i in range(j)) for j in range(1, len(total))]
    return best[-1]


@pytest.mark.parametrize("shards", [1, 3, 8])
@pytest.mark.parametrize("hot", [0, 400])
def test_shards_reach_the_smallest_capacity(docs, shards, hot):
    rows = [(i, "x" * (i * 31 % 97) + str(i % 150)) for i in range(200)] + [(1000 + i, "copy " * 3) for i in range(hot)]
    rows += [(5000, None), (5001, ""), (5001, "")]
    df = docs(rows)
    got = sharding.shards(df, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    fill, slots, homes = Counter(), {}, {}
    text = dict(rows)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        fill[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values())
    groups = df.selectExpr("doc_id", "text").select(sharding.group_key().alias("k"), "text").collect()
    sizes = Counter()
    for r in groups:
        sizes[r.k] += len((r.text or "").encode()) + 1
    assert max(fill.values()) == minimax([n for _, n in sorted(sizes.items())], shards)


def test_shards_of_an_empty_table(docs):
    assert sharding.shards(docs([]), 8).count() == 0


def test_cut_keys_refines_to_single_groups(spark):
    rows = [(k * 1000 + j, 1 + (k * j) % 17) for k in range(50) for j in range(40)]   # all in one first cell
    keys, capacity = sharding.cut_keys(spark.createDataFrame(rows, "key long, size long"), 8)
    sizes = [s for _, s in sorted(rows)]
    assert capacity == minimax(sizes, 8) and len(keys) == 7


def found_by_hand(text, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, names = low(text), set(), set()
    for item, t in items:
        own = low(t)
        n = min(width, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(item)
    return len(words), len(hit), tuple(sorted(names))


@pytest.mark.parametrize("block", [10**7, 60])
def test_leaks_against_plain_python(spark, docs, block):
    items = [(1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "Kurz Öl!"), (3, None), (4, "..."),
             (5, "two three four five six seven eight nine ten eleven and more of it here now"), (2, "kurz öl")]
    long = "one two three four five six seven eight nine ten eleven twelve "
    rows = ODD + [(20, "pre " + long + "post"), (21, long * 500), (22, "KURZ, öl kurz ÖL"), (23, "one two three four five six seven eight nine"),
                  (24, "ten eleven twelve one two three four five six seven"), (20, "kurz öl"), (20, "kurz öl")]
    df = decontaminate.hits(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_chars=block)
    got = Counter((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), tuple(r["items"])) for r in df.collect())
    assert got == Counter((i, *found_by_hand(t, items)) for i, t in rows)


def test_clean_keeps_all_columns_of_clean_rows(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    df = docs([(1, "x A b. c y"), (2, "a b d"), (None, "z"), (3, None)])
    out = decontaminate.clean(df, items)
    assert sorted(out.columns) == sorted(df.columns) and {r.doc_id for r in out.collect()} == {2, None, 3}
    assert decontaminate.clean(df, items.limit(0)).count() == 4


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    res = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in res.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(columns, res.fetchall()) == rows_of(df.columns, [tuple(r) for r in df.collect()])


