"""Operators on hand-made rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxfield.llm import decontamination, licenses, packing, quality_crf, quality_rules, simhash, token_counts, toxicity, warc, wfst
from boxfield.llm.common import Scratch
from boxfield.llm.graph import components
from boxfield.llm.hamming import table_bits, table_links
from boxfield.llm.jaccard import set_components
from boxfield.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
LONG = "wort und satz " * 20_000
TEXTS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (4, LONG), (5, "  two  spaces\n\nand\tlines ▁ x"), (6, "The quick brown fox jumps over the lazy dog again and again"), (6, "The quick brown fox jumps over the lazy dog again and again"), (None, "no id é 😀 \x00")]


def documents(spark, rows=None):
    """With columns whose names clash with what the operators make."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "x", 9, 8, False) for i, t in rows], "doc_id bigint, text string, score string, n_words int, fp0 int, kept boolean")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# Token counts and SentencePiece


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n=400):
    draw = random.Random(3)
    letters = list("abtheing \n▁é日😀#$%\t") + ["the", "<s>", "<0x0A>", "  "]
    return ["", " ", "\n", "x" * 500, "ab" * 300, *("".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(n))]


def test_token_counts_equal_the_library(docs, empty):
    sp = library()
    got = rows(token_counts.token_counts(docs, MODEL, keep=["doc_id"]))
    want = sorted(((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in TEXTS), key=str)
    assert got == want
    assert rows(token_counts.token_counts(empty, MODEL, keep=["doc_id"])) == []


def test_token_counts_on_odd_texts():
    sp, model = library(), token_counts.read_model(MODEL)
    known = token_counts.counter(model)
    assert all(len(sp.encode(p.replace("▁", " ")[1:])) == 1 for p in list(model.whole)[:300] if p[0] == "▁")
    for t in odd_texts():
        assert sum(known.values_of(t)) == len(sp.encode(t)), t


def test_transducer_equals_the_library(spark):
    import numpy as np

    sp, model = library(), wfst.read_model(MODEL)
    enc, dec = wfst.Transducer(model).encoder(), wfst.Decoder(model)
    for t in odd_texts():
        ids = np.frombuffer(b"".join(enc.values_of(t)), "<i4").tolist()
        assert ids == sp.encode(t), t
        assert dec.text(ids) == sp.decode(ids)
    draw = random.Random(5)
    for _ in range(300):
        ids = [draw.randrange(300) if draw.random() < 0.6 else draw.randrange(32000) for _ in range(draw.randrange(20))]
        assert dec.text(ids) == sp.decode(ids)


def test_unigram_weights_take_the_lightest_path():
    import math

    model = wfst.read_model(MODEL)
    model.kind = 1
    small = {"▁a": -1.0, "▁": -2.5, "a": -2.0, "b": -2.0, "ab": -1.5, "▁ab": -4.0}
    model.ids = {p: i for i, p in enumerate(small)}
    model.scores = list(small.values())
    best = lambda s: min(((sum(-small[p] for p in c), c) for c in cuts(s)), default=(math.inf, None))

    def cuts(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in small:
                yield from ([s[:k], *rest] for rest in cuts(s[k:]))

    t = wfst.Transducer(model)
    for s in ("▁a", "▁ab", "▁aab", "▁abab", "▁bab"):
        assert sum(-small[t.names[p]] for p in t.shortest(s)) == best(s)[0]
    # A character of a longer piece that is no piece itself is spelled where the longer piece does not fit.
    model.ids, model.scores = {"▁": 0, "cd": 1, "d": 2}, [-1.0, -1.0, -1.0]
    t = wfst.Transducer(model)
    assert [t.names[p] for p in t.shortest("▁cdc")] == ["▁", "cd", "c"]
    assert t.written[t.shortest("c")[0]] == model.byte_ids[ord("c")].to_bytes(4, "little")


def test_neighbour_weights_equal_merging():
    model = wfst.read_model(MODEL)
    t = wfst.Transducer(model)
    draw = random.Random(11)
    whole = sorted(model.whole)
    long = [p for p in whole if len(p) > 2]
    allowed = 0
    for _ in range(20_000):
        p = draw.choice(long)
        k = draw.randrange(1, len(p))  # neighbours that often join across their border
        a, b = (p[:k], p[k:]) if draw.random() < 0.7 else (p, draw.choice(whole))
        if not {a, b} <= model.whole:
            continue
        want = model.merge(a + b) == [a, b]
        allowed += want
        assert (t.neighbours.weight(a, b) == 0.0) == want, (a, b)
    assert 1000 < allowed < 10_000


def test_encoding_merges_nothing(monkeypatch):
    model = wfst.read_model(MODEL)
    enc = wfst.Transducer(model).encoder()
    monkeypatch.setattr(type(model), "merge", lambda *_: 1 / 0)
    sp = library()
    for t in odd_texts(100):
        assert b"".join(enc.values_of(t)) == b"".join(i.to_bytes(4, "little") for i in sp.encode(t))


def test_relaxing_equals_the_composed_machines():
    """The lattice of a small model against generic composition: normaliser, pieces, acceptor, every path walked."""
    import math

    model = wfst.read_model(MODEL)
    t = wfst.Transducer(model)
    draw = random.Random(2)
    for _ in range(60):
        text = "".join(draw.choices(list("the an") + ["\U0001f600"], k=draw.randrange(1, 8)))
        norm = t.normalise(text)
        paths = []

        def walk(i, before, cost, out):
            if i == len(norm):
                paths.append((cost, out))  # noqa: B023
            for j in range(i + 1, len(norm) + 1):
                if (s := norm[i:j]) in model.whole or (j == i + 1 and s not in model.ids):  # noqa: B023
                    piece = model.ids.get(s)
                    piece = t.spell(s) if piece is None else piece
                    w = 0.0 if before is None else t.neighbours.weight(t.names[before], s)
                    if w < math.inf:
                        walk(j, piece, cost + w + t.weight[piece], [*out, piece])

        walk(0, None, 0.0, [])
        assert [p for _, p in paths] == [t.shortest(norm)]


def test_round_trip(docs, empty):
    got = {r.doc_id: r for r in wfst.round_trip(docs, MODEL, keep=["doc_id"]).collect()}
    assert got[2].ids is None and got[2].n_tokens == 0 and got[2].round_trip is None
    assert got[3].ids == [] and got[3].round_trip is True
    assert got[4].ids == library().encode(LONG) and got[4].round_trip is True
    assert got[5].round_trip is False  # an escaped space in the text comes back as a space
    assert rows(wfst.round_trip(empty, MODEL, keep=["doc_id"])) == []


# SimHash


def test_simhash_equals_brute_force(spark):
    draw = random.Random(1)
    base = [draw.choice("red green blue grey pink".split()) + str(k) for k in range(60)]
    texts = [(0, None), (1, ""), (2, "A b"), (3, "a B"), (4, " ".join(base)), (4, " ".join(base)), (5, " ".join(base).upper())]
    for i in range(6, 60):
        w = list(base)
        for _ in range(draw.randrange(3)):
            w[draw.randrange(len(w))] = "z"
        texts.append((i, " ".join(w)))
    df = documents(spark, texts)
    want = sorted({(i, p, c) for i, p, c in simhash.brute_force(texts)})
    assert sorted(set(rows(simhash.digest(simhash.components_within(df))))) == want
    assert len(rows(simhash.digest(simhash.components_within(df)))) == len(texts)


def test_simhash_empty_and_null_ids(spark, empty):
    assert rows(simhash.digest(simhash.components_within(empty))) == []
    got = rows(simhash.digest(simhash.components_within(documents(spark, [(None, "a b c d"), (7, "a b c d")]))))
    assert {(r[0], r[2]) for r in got} == {(None, None), (7, 7)}


def test_links_are_exact_with_split_buckets(spark):
    draw = random.Random(2)
    words = [draw.getrandbits(64) for _ in range(8)]
    for w in list(words):
        for _ in range(40):
            x = w
            for b in draw.sample(range(64), draw.randrange(5)):
                x ^= 1 << b
            words.append(x)
    words = sorted(set(words))
    nodes = spark.createDataFrame([(i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)], "id bigint, fp0 bigint")
    for split_rows in (10_000, 5):
        scratch = Scratch(spark)
        found = components(table_links(scratch.write(nodes), ["fp0"], table_bits(4, 64), 3, scratch, split_rows=split_rows), scratch)
        got = {r.node: r.component for r in found.collect()}
        up = list(range(len(words)))
        for i, a in enumerate(words):
            for j in range(i):
                if (a ^ words[j]).bit_count() <= 3 and up[i] != up[j]:
                    low, high = sorted((up[i], up[j]))
                    up = [low if u == high else u for u in up]
        assert [got.get(i, i) for i in range(len(words))] == up


def test_near_duplicates_and_keep_one(spark, empty):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    base = [word() for _ in range(300)]
    near = list(base)
    near[150] = "changed"
    other = [word() for _ in range(300)]
    df = documents(spark, [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(other)), (5, " ".join(base)), (None, " ".join(base))])
    assert rows(simhash.near_duplicates(df).where("doc_id is not null")) == [(1, 1), (2, 2), (3, 1), (5, 1)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and rows(kept, "doc_id") == [(1,), (2,), (None,)]
    assert rows(simhash.keep_one(empty)) == []


def pairs_at(lowest, highest, count, seed):
    """[(id, text)]: pairs (2k, 2k + 1) that differ in their last words, and their exact similarities by k."""
    draw = random.Random(seed)
    out, exact = [], []
    while len(exact) < count:
        base = ["".join(draw.choices("abcdefghijkl", k=7)) for _ in range(220)]
        changed = draw.randrange(5, 50)
        other = base[:-changed] + [w[::-1] + "x" for w in base[-changed:]]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, other))
        share = len(a & b) / len(a | b)
        if lowest <= share < highest:
            out += [(2 * len(exact), " ".join(base)), (2 * len(exact) + 1, " ".join(other))]
            exact.append(share)
    return out, exact


def test_near_duplicates_equal_an_exact_join_about_the_threshold(spark):
    texts, exact = pairs_at(0.66, 0.92, 400, 6)
    got = dict(rows(simhash.near_duplicates(documents(spark, texts))))
    linked = [got[2 * k + 1] == 2 * k for k in range(len(exact))]
    assert not any(hit for hit, s in zip(linked, exact) if s < 0.8)
    assert all(hit for hit, s in zip(linked, exact) if s >= 0.8) and sum(linked) > 100


def exact_components(texts: list[tuple], similarity: float = 0.8) -> list[tuple]:
    """(id, smallest id of its component) by the Jaccard similarity of all pairs of rows."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").translate(LOWER).encode().split()) else set() for _, t in texts]
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if up[i] != up[j] and ((not a and not sets[j]) or len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9 and a):
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    least: dict[int, int] = {}
    for (i, _), u in zip(texts, up):
        least[u] = min(i, least.get(u, i))
    return sorted(((i, least[u]) for (i, _), u in zip(texts, up)), key=str)


LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def variants(seed: int) -> list[tuple]:
    """Groups of near copies around the threshold, short and long, with a passage that a third of the texts share."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(24):
        base = [word() for _ in range(draw.choice([1, 4, 6, 9, 14, 40, 120, 400]))]
        if draw.random() < 0.34:
            base = base + passage
        for _ in range(draw.randrange(1, 9)):
            out.append([w if draw.random() > 0.02 else word() for w in base])
    return [(i, " ".join(w)) for i, w in enumerate(out)] + [(len(out), ""), (len(out) + 1, None), (3, " ".join(passage)), (4, " ".join(out[0]))]


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    texts = variants(8)
    assert rows(simhash.near_duplicates(documents(spark, texts))) == exact_components(texts)
    # Hot buckets and large components in blocks, and the passage known to be frequent.
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    monkeypatch.setattr(simhash, "CONFIRM_BYTES", 4000)
    monkeypatch.setattr(simhash, "OFTEN", 2)
    assert rows(simhash.near_duplicates(documents(spark, texts))) == exact_components(texts)


def test_near_duplicates_of_the_documents_table_equal_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = exact_components(texts)
    assert rows(simhash.near_duplicates(docs)) == expected
    assert len({c for _, c in expected}) < len(texts)
    assert rows(simhash.keep_one(docs), "doc_id") == sorted({(c,) for _, c in expected}, key=str)


def test_repeated_ids(spark):
    a, b, c = ("some words that make a text of their own", "quite another text with nothing in common", "a third one that is unlike the others")
    texts = [(5, a), (7, a), (7, b), (8, b), (9, c), (9, c)]
    got = rows(simhash.digest(simhash.components_within(documents(spark, texts))))
    assert got == sorted(((i, p, k) for i, p, k in simhash.brute_force(texts)), key=str)
    assert {k for i, _, k in got if i in (5, 7, 8)} == {5}
    # keep_one looks at rows: the text b of document 5 is no copy of its text a.
    kept = simhash.keep_one(documents(spark, [(3, a), (5, a), (5, b), (6, c), (6, c)]))
    assert rows(kept, "doc_id", "text") == [(3, a), (5, b), (6, c)]


def test_near_duplicates_compare_sets_whatever_is_repeated(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    line = text(14)
    unlike = [(1, f"{text(200)} {' '.join([line] * 50)}"), (2, f"{text(200)} {' '.join([line] * 50)}")]
    body = text(300)
    copies = [(3, f"{body} {line}"), (4, f"{body} {' '.join([line] * 60)}")]
    got = rows(simhash.near_duplicates(documents(spark, unlike + copies)))
    assert got == [(1, 1), (2, 2), (3, 3), (4, 3)]


def test_set_components_equal_all_pairs():
    draw = random.Random(7)
    sets = []
    for _ in range(12):
        base = [draw.getrandbits(64) for _ in range(draw.randrange(1, 60))]
        for _ in range(12):
            sets.append(np.unique(np.array([x if draw.random() > 0.1 else draw.getrandbits(64) for x in base], np.uint64)))
    sets.append(np.zeros(0, np.uint64))
    up = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if len(a) and both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9 and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    assert set_components(sets, 0.8).tolist() == up


def test_least_shingles_are_shared_in_any_order():
    draw = np.random.default_rng(3)
    for n in (1, 2, 5, 6, 30, 200):
        for _ in range(50):
            both = draw.integers(0, 2**63, n, np.uint64)
            a = np.unique(np.r_[both, draw.integers(0, 2**63, draw.integers(0, n // 4 + 1), np.uint64)])
            b = np.unique(np.r_[both, draw.integers(0, 2**63, draw.integers(0, n // 8 + 1), np.uint64)])
            common = len(np.intersect1d(a, b))
            if common < 0.8 * (len(a) + len(b) - common):
                continue
            often = draw.permutation(np.union1d(a, b))[: draw.integers(0, n + 1)]
            order = np.argsort(often)
            x, y = (simhash.least_shingles(s, 0.8, often[order], order) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_components_of_a_chain(spark):
    scratch = Scratch(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges, scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Decontamination


def test_decontamination_equals_brute_force(spark, docs, empty):
    w = "a0 b1 c2 d3 e4 f5 g6 h7 i8 j9 k0 l1 m2".split()
    items = [(1, " ".join(w)), (2, " ".join(w[2:])), (3, "short Item"), (3, "short Item"), (4, None), (None, "fox jumps"), (5, "!!"), (6, "a a a a a a a a a a a"), (7, "éa")]
    texts = [(1, "x " + " ".join(w).upper() + " y"), (2, " ".join(w[:9])), (3, "a SHORT, item! short-item"), (4, None), (5, "a " * 30), (6, " ".join(w[1:] + w)), (7, "ÉA éa")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n_words int")
    df = documents(spark, texts)
    want = sorted(decontamination.brute_force(texts, items), key=str)
    assert rows(decontamination.digest(decontamination.spans(df, bench))) == want
    assert rows(decontamination.digest(decontamination.spans(df, bench, max_patterns=2))) == want
    assert rows(decontamination.digest(decontamination.spans(empty, bench))) == []
    assert {r[5] for r in rows(decontamination.digest(decontamination.spans(df, bench.limit(0))))} == {False}
    clean = decontamination.remove_hits(df, bench)
    assert clean.columns == df.columns and rows(clean, "doc_id") == [(i,) for i, *_, hit in want if not hit]


# Quality rules


def test_quality_rules(docs, empty, spark):
    got = {r.doc_id: r for r in quality_rules.digest(docs).collect()}
    assert (got[2].n_words, got[2].base_failed, got[2].kept) == (0, True, False)
    assert got[4].n_repeat_words == got[4].n_words == 60_000 and not got[4].kept
    assert got[1].kept and got[1].n_repeat_words == 0
    assert rows(quality_rules.digest(empty)) == []
    draw = random.Random(0)
    for _ in range(200):
        words = [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(40))]
        wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 5)}
        assert quality_rules.repeated_positions(words) == len(inside)


def test_order_of_rules_does_not_change_the_verdict(docs):
    first = rows(quality_rules.cascade(docs, keep=["doc_id"]), "doc_id", "kept")
    assert rows(quality_rules.cascade(docs, keep=["doc_id"], rules=quality_rules.RULES[::-1], sample=0), "doc_id", "kept") == first
    slow = quality_rules.Estimate("a", 1.0, 0.5)
    assert [r.name for r in quality_rules.ordered([quality_rules.Rule("a", bool), quality_rules.Rule("b", bool)], [slow, quality_rules.Estimate("b", 0.1, 0.4)])] == ["b", "a"]


# WARC


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>" + "x" * 200, None, "", "short", "short", "é" * 90_000, "<p>" + "x" * 200, "<p>" + "x" * 200, "\r\n\r\nWARC/1.1\r\n" * 20]
    pages = [(i, f"http://e/{i}\n", h, "z") for i, h in enumerate(html, 10)] + [(None, None, "<p>" + "x" * 200, "z")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, payload string")
    scratch = Scratch(spark)
    warc.write_archives(warc.record_types(df, scratch), f"file://{tmp_path}/w", segment_bytes=1000, file_bytes=7 * (1000 + warc.HEAD_BYTES))
    records = warc.read_archives(spark, f"file://{tmp_path}/w", scratch)
    got = {r.page_id: r for r in warc.digest(records).collect()}
    assert all(r.problem is None for r in got.values()) and len(got) == len(pages)
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {16: 10, 17: 10}
    assert got[15].n_segments > 100 and got[15].payload_bytes == 180_000
    payloads = {r.record_id.split(":")[3]: r.payload for r in records.where("record_type = 'response'").collect()}
    assert payloads["15"].decode() == html[5] and payloads["11"] == b"" and payloads["18"].decode() == html[8]
    full = {r.record_id.split(":")[3]: r.payload for r in warc.resolved(scratch.write(records), scratch).collect()}
    assert full["16"].decode() == html[0]


def test_warc_refers_to_records_that_exist(spark, tmp_path):
    long = "<p>" + "x" * 200
    pages = [(3, "u", long), (3, "u", long), (3, "v", "other " * 40), (5, "u", long), (4, "u", "other " * 40), (None, "u", "tiny"), (None, "u", "tiny")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    scratch = Scratch(spark)
    seen = []
    for n in (1, 5):
        at = f"file://{tmp_path}/w{n}"
        warc.write_archives(warc.record_types(df.repartition(n), scratch), at)
        found = warc.read_archives(spark, at, scratch).collect()
        seen.append(sorted(r.record_id for r in found))
        responses = {r.record_id for r in found if r.record_type == "response"}
        revisits = [r for r in found if r.record_type == "revisit"]
        assert len(seen[-1]) == len(set(seen[-1])) == len(pages) and len(revisits) == 2
        assert all(r.refers_to in responses for r in revisits)
    assert seen[0] == seen[1]  # ids do not depend on partitions
    got = rows(warc.digest(warc.write_and_read(df)), "page_id", "record_type", "refers_to")
    assert got == sorted([(3, "response", None)] * 3 + [(5, "revisit", 3), (4, "revisit", 3)] + [(None, "response", None)] * 2, key=str)


def test_warc_empty_and_broken(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.digest(warc.write_and_read(empty)).collect() == []
    part = lambda k, b, **x: {"number": k, "block": b, **x}
    block = warc.HTTP_HEAD + warc.chunked(b"hello")
    base = {"origin": "urn:x", "record_type": "response", "target_uri": None, "refers_to": None, "payload_digest": None, "payload_length": None}
    good = warc.joined({**base, "segments": [part(1, block[:9]), part(2, block[9:])], "total": len(block)})
    assert good["payload"] == b"hello" and good["problem"] is None
    assert "missing" in warc.joined({**base, "segments": [part(1, block[:9]), part(3, block[9:])], "total": len(block)})["problem"]
    assert "length" in warc.joined({**base, "segments": [part(1, block[:9]), part(2, block[10:])], "total": len(block)})["problem"]
    assert "last" in warc.joined({**base, "segments": [part(1, block)], "total": None})["problem"]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nhel")
    assert warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"


# Packing


def test_best_fit_decreasing_equals_a_plain_search():
    draw = random.Random(7)
    for _ in range(50):
        sizes = [draw.randrange(1, 33) for _ in range(draw.randrange(60))]
        room: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [r for r in range(len(room)) if room[r] >= s]
            if fits:
                room[min(fits, key=lambda r: room[r])] -= s
            else:
                room.append(32 - s)
        packed = packing.best_fit_decreasing(sizes, 32)
        assert sorted(i for r in packed for i in r) == list(range(len(sizes)))
        assert sorted(32 - sum(sizes[i] for i in r) for r in packed) == sorted(room)


def test_packing_gives_every_document_back(docs, empty):
    import numpy as np

    sp = library()
    packed = packing.pack(docs, MODEL, length=64, group_bytes=50_000)
    for r in packed.collect():
        assert len(r.input_ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        at = np.frombuffer(r.position_ids, "<u2")
        assert [x for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for x in range(b - a)] == at[: r.n_tokens].tolist()
    back: dict = {}
    for r in sorted(packing.unpacked(packed).collect(), key=lambda r: r.part):
        back.setdefault(r.doc_id, []).append((r.part, np.frombuffer(bytes(r.ids), "<u2").tolist()))
    for i, t in TEXTS:
        if t:
            parts = sorted(back[i])
            copies = 2 if i == 6 else 1
            assert sum((p for _, p in parts[::copies]), []) == sp.encode(t)
    assert rows(packing.pack(empty, MODEL)) == []


# Licences


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", mit), ("a/x.txt", "words"), ("a/b/y.txt", None), ("a/b/c/z.txt", f"{'Some text here. ' * 40}\n{apache}\nMore."), ("a/b/c/w.txt", ""), ("a/c/notes.txt", apache), ("a/c/d/v.txt", "license to say nothing of it"), ("q.txt", "x"), (None, "y"), ("a/x.txt", "words"), ("r/one.txt", f"{'Plain words of a long file. ' * 50} {mit}")]
    df = spark.createDataFrame([(*f, "s") for f in files], "path string, text string, license string")
    got = {(r.path, r.license, r.license_dir, r.levels) for r in licenses.licenses(df.withColumnRenamed("license", "own"), keep=["path"]).collect()}
    assert {("a/LICENSE", "MIT", None, 0), ("a/x.txt", "MIT", "a", 1), ("a/b/y.txt", "MIT", "a", 2), ("a/b/c/z.txt", "Apache-2.0", None, 0), ("a/b/c/w.txt", "MIT", "a", 3), ("a/c/notes.txt", "Apache-2.0", None, 0), ("a/c/d/v.txt", "Apache-2.0", "a/c", 2), ("q.txt", None, None, None), (None, None, None, None), ("r/one.txt", "MIT", None, 0)} == got
    assert licenses.licenses(df.limit(0), keep=["path"]).collect() == []


def test_anchors_lose_no_unit():
    from collections import Counter

    draw = random.Random(1)
    for frequency in ({}, {x: draw.randrange(100) for x in licenses.Scanner(licenses.templates(), {}, 100, 0.6).idf}):
        scanner = licenses.Scanner(licenses.templates(), frequency, 100, 0.6)
        vocabulary = sorted(scanner.idf)
        for n in range(3000):
            if n % 2:
                unit = draw.choices(vocabulary, k=draw.randrange(1, 12))
            else:  # most of a template
                unit = [x for x in licenses.terms(draw.choice(licenses.templates()).text.encode()) if draw.random() < 0.8] or [b"x"]
            full, near = scanner.cosine(Counter(unit)), scanner.cosine(Counter(unit), scanner.near(unit))
            assert full == near if full[0] >= 0.6 else near[0] < 0.6


def test_licences_of_one_family_are_told_apart():
    scanner = licenses.Scanner(licenses.templates(), {}, 1000, 0.6)
    gnu = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    texts = {
        "GPL-2.0": gnu.format("program", "General Public License", "2"),
        "GPL-3.0": gnu.format("program", "General Public License", "3"),
        "LGPL-2.1": gnu.format("library", "Lesser General Public License", "2.1"),
        "AGPL-3.0": gnu.format("program", "Affero General Public License", "3"),
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "ISC": "Copyright (c) 2020, A. Person\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "EPL-2.0": "// SPDX-License-Identifier: EPL-2.0",
        "CC-BY-SA-4.0": "SPDX-License-Identifier: CC-BY-SA-4.0",
        "CC-BY-4.0": "Licensed under CC BY 4.0.",
        "BSD-2-Clause": licenses._BSD + "\n\n" + licenses._BSD_END,
        "BSD-3-Clause": licenses._BSD + "\n\n" + licenses._BSD_CLAUSE + "\n\n" + licenses._BSD_END,
        None: "Ein Text über Lizenzen, die nichts sagen. 许可证 许可证 许可证",
    }
    assert {name: scanner.scan(t.encode())[0] for name, t in texts.items()} == {name: name for name in texts}


def test_licences_equal_brute_force(spark, sf):
    """Own licences by dense cosines of every unit, inherited ones by walking up from each file."""
    import math
    from collections import Counter

    files = licenses.document_files(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r.doc_id: r for r in licenses.licenses(files, keep=["doc_id"]).collect()}
    every = [(r.doc_id, r.path, (r.text or "").encode().lower()) for r in files.collect()]
    found = licenses.templates()
    df = Counter(x for _, _, t in every for x in set(licenses.terms(t)))
    known = {x for t in found for x in licenses.terms(t.text.encode())}
    idf = lambda x: math.log((1 + len(every)) / (1 + (df[x] if x in known else 0))) + 1
    vectors = [(t, {x: n * idf(x) for x, n in Counter(licenses.terms(t.text.encode())).items()}) for t in found]

    def best(unit):
        terms = Counter(licenses.terms(unit))
        own = {x: n * idf(x) for x, n in terms.items()}
        size = math.sqrt(sum(w * w for w in own.values()))
        out = (0.0, None)
        for t, v in vectors:
            if size and all(any(x.encode() in terms for x in g) for g in t.needs) and not any(x.encode() in terms for x in t.without):
                cos = sum(w * own.get(x, 0.0) for x, w in v.items()) / size / math.sqrt(sum(w * w for w in v.values()))
                out = max(out, (cos, t.name), key=lambda k: k[0])
        return out

    own, speaks = {}, {}
    for i, path, text in every:
        units = {u for p in licenses.PARAGRAPH.split(text) for u in (p, *licenses.UNIT.split(p))} | {text}
        score, name = max((best(u) for u in units), key=lambda k: k[0])
        own[i] = name if score >= 0.6 else None
        if own[i] and (best(text)[0] >= 0.6 or licenses.NAMES.search(path)):
            place = path.rpartition("/")[0]
            speaks[place] = min(speaks.get(place, (0, "", "")), (-score, path, own[i]), key=lambda k: (round(k[0], 9), k[1]))
    inherited = 0
    for i, path, _ in every:
        want, place = own[i], path.rpartition("/")[0]
        while want is None:
            if place in speaks:
                want = speaks[place][2]
                inherited += 1
            if not place:
                break
            place = place.rpartition("/")[0]
        assert got[i].license == want and got[i].own_license == own[i], i
    assert inherited > 0 and sum(map(bool, own.values())) > 0


# Classifiers


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize(("digest", "label", "least"), [(quality_crf.digest, "quality", 0.95), (toxicity.digest, "toxic", 0.93)])
def test_classifiers_on_held_out_rows(spark, digest, label, least):
    docs, labels = labelled(spark, "/root/testdata/sf0.01")
    found = digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found[label]).mean() >= least
    assert found.score.between(0, 1).all()


@pytest.mark.parametrize("digest", [quality_crf.digest, toxicity.digest])
def test_classifiers_without_labels(spark, docs, empty, digest):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert digest(docs, none).count() == len(TEXTS)
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    assert {r.score is not None for r in digest(docs, one).collect()} == {True}
    assert digest(empty, one).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    draw = np.random.default_rng(0)
    model = quality_crf.Crf(draw.normal(size=quality_crf.SIZE), 0.3, draw.normal(size=(2, 2)), np.zeros(2))
    x = draw.random((6, quality_crf.SIZE))
    pull = x @ model.weights + model.constant
    total, bad = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(p for p, k in zip(pull, y) if k) + sum(model.step[a, b] for a, b in zip(y, y[1:])))
        total += w
        bad += w * np.array(y)
    assert np.allclose(model.marginals(x), bad / total)


def test_grammar_reads_clauses():
    import numpy as np

    g = toxicity.Grammar({"idiot": 4.0}, {"vequ": 3.0}, np.array([1.0, 0.0, -2.0]))
    score = lambda t: g.features(t.encode())[0]
    assert score("You are an idiot.") > score("What an idiot.") > score("He is not an idiot.")
    assert score("She said: fine. They called it idiot") < score("the idiot")
    assert score("I will kill you") > 0 and score("kill the process") == 0
    assert score("des vequai mots") == 3.0 and score("vequ") == 0
    assert g.features(None) == (0.0, 0.0) == g.features(b"")


def grammar():
    return toxicity.Grammar({"idiot": 5.0, "scum": 4.0, "clown": 2.0}, {"vequ": 3.0}, np.array([1.0, 0.0, -3.0]))


def by_hand(g, tokens) -> float:
    """Weight of a clause by trying every reading of every word against the rules as they are stated; no machine."""
    import itertools

    best = 0.0
    near = lambda i, kinds, reach, ahead: any(tokens[j] in kinds for j in range(max(0, i - reach), min(len(tokens), i + (reach if ahead else 0) + 1)) if j != i)
    gains = []
    for i, w in enumerate(tokens):
        marks = toxicity.NEGATED * near(i, toxicity.NEGATIONS, toxicity.NEAR_NEGATION, False) + toxicity.REPORTED * near(i, toxicity.REPORTS, toxicity.NEAR_REPORT, False)
        options = [0.0]
        if g.insult(w) > 0:
            options += [g.insult(w) - marks]
            if near(i, toxicity.TARGETS, toxicity.NEAR_TARGET, True):
                options += [g.insult(w) + toxicity.TARGETED - marks]
        if w in toxicity.THREATS and near(i, toxicity.TARGETS, toxicity.NEAR_THREAT, True):
            options += [toxicity.THREAT_WEIGHT - marks]
        gains.append(options)
    for pick in itertools.product(*gains):
        best = max(best, sum(pick))
    return best


def test_grammar_equals_every_reading():
    from boxfield.llm.machines import every_path

    g, draw = grammar(), random.Random(4)
    machine = toxicity.grammar_machine()
    vocabulary = ["idiot", "scum", "clown", "you", "they", "kill", "not", "said", *["word"] * 6]
    for n in range(400):
        tokens = draw.choices(vocabulary, k=draw.randrange(1, 30))
        weight, kinds = g.clause(tokens)
        assert abs(weight - by_hand(g, tokens[:])) < 1e-9 if sum(t in ("idiot", "scum", "clown", "kill") for t in tokens) < 9 else True
        assert (weight > 0) == bool(kinds)
        if n < 60 and len(tokens) < 9:
            assert abs(weight + min(c for c, _ in every_path(machine, [g.readings(w) for w in tokens]))) < 1e-9


def test_composition_equals_one_machine_after_another():
    from boxfield.llm.machines import every_path, shortest

    draw = random.Random(6)
    for _ in range(40):
        tape = [[(draw.choice(toxicity.CLASSES), -draw.random())] for _ in range(draw.randrange(1, 7))]
        paths = [(sum(w for (_, w), in tape), tuple(x for (x, _), in tape))]
        for m in toxicity.parts():
            paths = [(c + d, out) for c, own in paths for d, out in every_path(m, [[(x, 0.0)] for x in own])]
        assert abs(min(c for c, _ in paths) - shortest(toxicity.grammar_machine(), tape)[0]) < 1e-9


def test_grammar_tells_clauses_that_a_word_list_cannot():
    g = grammar()
    toxic = ["you are scum", "I will kill you", "they are a vequo crowd", "the idiot lost again", "we burn them and their house"]
    clean = ["she is not an idiot", "he said that they called her scum", "kill the process", "never a clown", "he wrote scum in quotes", "burn the disc"]
    score = lambda t: float(g.scores([t.encode()])[0])
    assert all(score(t) >= 0.5 for t in toxic) and all(score(t) < 0.5 for t in clean)
    # The heaviest word alone gets these wrong: threats weigh nothing, negated and reported insults in full.
    alone = lambda t: max(g.insult(w) for w in toxicity.words(t)) >= 3.0
    right = sum(alone(t) for t in toxic) + sum(not alone(t) for t in clean)
    assert right <= len(toxic) + len(clean) - 5


def test_toxicity_recall_and_precision_on_held_out_rows(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    found = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert hit / (found.toxic == 1).sum() >= 0.9 and hit / (found.predicted == 1).sum() >= 0.95


def test_very_long_texts_are_scored_whole(spark):
    g = grammar()
    long = "word " * 200_000
    assert g.features((long + "you idiot").encode())[0] == 6.0
    assert g.features(("you idiot " * 20_000).encode())[1] == 6.0 * 20_000


def test_packing_writes_matrices_and_takes_any_id(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    texts = [("b", "same text here"), ("a", "same text here"), (None, "same text here"), ("c", "word " * 300), ("c", "word " * 300)]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    packing.write_packed(packing.pack(df, MODEL, length=64), str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    sp = library()
    got = sorted(((r.doc_id, r.part, r.start, np.frombuffer(r.ids, "<u2").tolist()) for r in packing.unpacked(packed).collect()), key=str)
    want = sorted(((d, k, at, ids[at : at + 64]) for d, t in texts for ids in [sp.encode(t)] for k, at in enumerate(range(0, len(ids), 64))), key=str)
    assert got == want
    for b in packed.toArrow().to_batches():
        ids, positions = packing.matrices(b)
        assert ids.shape == positions.shape == (b.num_rows, 64)
        for k, r in enumerate(pa.RecordBatch.to_pylist(b)):
            cu = r["cu_seqlens"]
            assert cu[0] == 0 and cu[-1] == r["n_tokens"] and (ids[k, cu[-1] :] == packing.PAD).all()
            for a, z in zip(cu, cu[1:]):
                assert positions[k, a:z].tolist() == list(range(z - a))


def test_wide_vocabularies_are_unpacked_in_full(spark):
    import numpy as np

    ids = [70_000, 3, 99_999, 1]
    row = [(1, 6, 4, np.array([*ids, 0, 0], "<i4").tobytes(), [0, 3, 4], [5, 6], [0, 0], [0, 0])]
    packed = spark.createDataFrame(row, "pack_id bigint, length int, n_tokens int, input_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, parts array<int>, starts array<bigint>")
    assert {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in packing.unpacked(packed).collect()} == {5: ids[:3], 6: ids[3:]}


def test_a_rule_of_a_known_name_is_the_callers_own(docs):
    never = (quality_rules.Rule("symbols", lambda f: False),)
    assert {r.kept for r in quality_rules.cascade(docs, keep=["doc_id"], rules=never).collect()} == {True}


def test_crf_learns_from_lines_behind_the_first_hundred():
    import numpy as np

    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randrange(2, 8)))
    good = lambda n: "".join(" ".join(word() for _ in range(12)) + ".\n" for _ in range(n)).encode()
    bad = lambda n: "".join(f"BUY NOW !!! {word().upper()} $$$ ***\n" for _ in range(n)).encode()
    rows_ = [r for _ in range(6) for r in ((good(300), 1), (good(150) + bad(250), 0), (good(40), 1), (good(130) + bad(100), 0))]
    feats = [quality_crf.line_features(t) for t, _ in rows_]
    model = quality_crf.fit([quality_crf.with_neighbours(f) for f, _ in feats], [w for _, w in feats], np.array([y for _, y in rows_]))
    scores = model.score(np.array([model.badness(t) for t, _ in rows_]))
    assert ((scores >= 0.5) == np.array([y == 1 for _, y in rows_])).all()


def test_sentencepiece_composes_stretches_apart():
    """Stretches between characters that no piece has side by side are relaxed one by one and once; ids are the library's."""
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    machine = wfst.Transducer(wfst.read_model(path))
    seen, real = [], machine.shortest
    machine.shortest = lambda text: seen.append(text) or real(text)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeé ▁\n日😀.th") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    known, library = machine.encoder(), SentencePieceProcessor(model_file=path)
    got = [np.frombuffer(b"".join(known.values_of(t)), "<i4").tolist() for t in texts]
    assert got == library.encode(texts)
    assert len(seen) == len(set(seen)) and all(s[i : i + 2] in machine.inner for s in seen for i in range(len(s) - 1))


def test_packing_encodes_a_word_once():
    """A word goes to the library once; texts that can't be cut at spaces go whole; ids are those of whole texts."""
    from sentencepiece import SentencePieceProcessor

    from boxfield.llm.pieces import PieceModel

    path = tokenizer_path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = PieceModel(f.read())
    library, asked = SentencePieceProcessor(model_file=path), []

    class Watched:
        def encode(self, x, **more):
            asked.extend([x] if isinstance(x, str) else x)
            return library.encode(x, **more)

    rng = random.Random(6)
    texts = ["one two one", "", " lead", "tail ", "a  b", "a ▁b"] + ["".join(rng.choice("abé  ▁\n日.") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    words = packing.Words(Watched(), model)
    first = words.encode(texts[:1])
    assert asked and sorted(asked) == ["one", "two"]
    got = [np.frombuffer(x, "<u2").tolist() for x in first + words.encode(texts[1:])]
    assert got == library.encode(texts)
