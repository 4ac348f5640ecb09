"""Suffix dedup, decontamination, urls, near duplicates and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lodestrata.llm import decontaminate as dc
from lodestrata.llm import near_dedup as nd
from lodestrata.llm import packing, queries
from lodestrata.llm import quality_rules as qr
from lodestrata.llm import secret_scan as ss
from lodestrata.llm import suffix_dedup as sd
from lodestrata.llm import url_filter as uf
from tests.llm.test_text_operators import GOOD, JWT, SCHEMA, TOKENIZER, base_brute, empty, key, own_brute, repeats_brute

SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "x") for i, t in rows], SCHEMA).repartition(4)


# ---------------------------------------------------------------- suffix arrays


def lcp(a, b):
    return next((i for i in range(len(a)) if a[i] != b[i]), len(a))


@pytest.mark.parametrize("seed", range(4))
def test_loser_tree(seed):
    r = random.Random(seed)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(8)) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 9))]
    shared = [[lcp(x[i - 1], x[i]) if i else 0 for i in range(len(x))] for x in runs]
    order, common = sd.merge_runs(runs, shared)
    flat = [s for x in runs for s in x]
    out = [flat[i] for i in order]
    assert out == sorted(flat) and sorted(order) == list(range(len(flat)))
    assert all(lcp(out[i - 1], out[i]) == common[i] for i in range(1, len(out)))


def test_front_coding_round_trip():
    r = np.random.default_rng(0)
    m = r.integers(0, 2, (200, 12), dtype=np.uint8)
    m = m[np.lexsort(m.T[::-1])]
    same, fresh = sd.front_code(m)
    assert (sd.front_decode(same, fresh, 12) == m).all() and len(fresh) < m.size


def removed(rows):
    last, first = 1 << 63, {}
    rows = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], last), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((None if i == last else i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def repeated_texts(seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab é\x00") for _ in range(r.randint(20, 200))) for _ in range(20)]
    rows = [(i, "".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 6)))) for i in range(90)]
    return [*rows, (200, "x" * 300), (201, "x" * 49), (202, "x" * 50), (203, rows[3][1]), (203, rows[3][1]), (5, "same id " + pool[0]), (6, ""), (None, rows[3][1]), (1 << 60, "y" * 100_000), (300, None)]


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup(spark, seed):
    rows = repeated_texts(seed)
    assert sorted((tuple(r) for r in sd.dedup_report(docs(spark, rows)).collect()), key=key) == removed(rows)


#: Of these strings the one of least hash, which is an anchor wherever it stands.
SHARED = min((b"%020d" % i for i in range(1000)), key=lambda x: sd.gram_hash(np.frombuffer(x, np.uint8)[None], sd.GRAM)[0])


def in_most_texts(seed, n):
    r = random.Random(seed)
    around = lambda: "".join(r.choice("abcd") for _ in range(r.randint(40, 70)))
    return [(1000 + i, around() + SHARED.decode() + around()) for i in range(n)]


@pytest.mark.parametrize("few", [1, 30])
def test_suffix_dedup_with_crowded_buckets(spark, few, monkeypatch):
    """Buckets are many, and crowded from a few anchors on; a string stands in most texts with other bytes around it."""
    for k, v in {"FEW": few, "SAMPLED": 1, "PER_BUCKET": 500}.items():
        monkeypatch.setattr(sd, k, v)
    rows = [x for x in repeated_texts(few) if len(x[1] or "") < 1000] + in_most_texts(few, 150)
    keyed = docs(spark, rows).selectExpr("coalesce(doc_id, 0) AS id", "xxhash64(text) AS key", "encode(coalesce(text, ''), 'UTF-8') AS text")
    assert sd.crowded_slots(keyed, 80)[0].any()
    assert sorted((tuple(r) for r in sd.dedup_report(docs(spark, rows)).collect()), key=key) == removed(rows)
    rows = repeated_texts(few)
    assert sorted((tuple(r) for r in sd.dedup_report(docs(spark, rows)).collect()), key=key) == removed(rows)


def test_a_string_in_many_surroundings_fills_no_bucket(spark, monkeypatch):
    """The largest bucket stays near the mean, however many surroundings a string has; without the slots it holds all of them."""
    monkeypatch.setattr(sd, "FEW", 1)
    for n in (2_000, 8_000):
        rows, buckets = in_most_texts(n, n), n // 50
        keyed = docs(spark, rows).selectExpr("doc_id AS id", "xxhash64(text) AS key", "encode(text, 'UTF-8') AS text")
        crowded, anchors = sd.crowded_slots(keyed, buckets)
        assert anchors > n / 4
        batch = keyed.toPandas()
        at = [bytes(t).find(SHARED) for t in batch["text"]]
        batch["at"] = [[k] for k in at]

        def largest(bits, batch=batch, buckets=buckets):
            runs = pd.concat(sd.sorted_runs(buckets, bits, buckets)(iter([batch])))
            runs = runs[runs["bucket"] >= 0]
            return runs["pos"].map(lambda x: len(sd.unplanes(x))).groupby(runs["bucket"]).sum().max()

        assert largest(np.zeros_like(crowded)) == n
        assert largest(crowded) < 2 * sd.ROOM * n / buckets


@pytest.mark.parametrize("few", [20_000, 1])
def test_suffix_dedup_by_way_of_cells(spark, few, monkeypatch):
    """Few bytes a bucket and few buckets that are sent to directly: runs go by cells, in several parts, and get longer."""
    for k, v in {"FEW": few, "SAMPLED": 1, "DIRECT": 3, "PER_BUCKET": 2_000, "PER_PART": 5_000}.items():
        monkeypatch.setattr(sd, k, v)
    rows = repeated_texts(7)
    assert sd.cells_of(100) == 10 and sd.cells_of(101) == 11 and sd.cells_of(3) == 1
    assert sorted((tuple(r) for r in sd.dedup_report(docs(spark, rows)).collect()), key=key) == removed(rows)


def test_dealt_runs_are_fewer_and_longer(monkeypatch):
    monkeypatch.setattr(sd, "DIRECT", 3)
    texts = [t.encode() for _, t in repeated_texts(3) if t and len(t) >= sd.SPAN]
    batch = lambda part, at: pd.DataFrame({"id": np.arange(at, at + len(part)), "key": np.arange(at, at + len(part)) + 7, "text": part, "at": [list(range(len(t) - sd.GRAM + 1)) for t in part]})
    none = np.zeros(400 * sd.SLOTS // 8, np.uint8)
    sent = pd.concat([x for k in range(0, len(texts), 10) for x in sd.sorted_runs(400, none, 400)(iter([batch(texts[k : k + 10], k)]))])
    sent, width = sent[sent["bucket"] >= 0], sd.cells_of(400)
    dealt = pd.concat([sd.dealt_runs(width)(g) for _, g in sent.groupby("bucket")])

    def held(rows, fine):
        out = []
        for r in rows.itertuples():
            (ids, keys, pos), where = sd.numbered(pd.DataFrame([r])), sd.unplanes(r.fine) + r.bucket * width if fine else [r.bucket] * len(sd.unplanes(r.pos))
            text = sd.front_decode(np.frombuffer(sd.grown(r.shared), np.uint8), sd.grown(r.fresh), sd.SPAN)
            assert [x.tobytes() for x in text] == sorted(x.tobytes() for x in text)
            out += zip(map(int, where), ids.tolist(), keys.tolist(), pos.tolist(), map(bytes, text), strict=True)
        return sorted(out)

    known, dealt = dealt[dealt["bucket"] < 0], dealt[dealt["bucket"] >= 0]
    before, after = held(sent, True), held(dealt, False)
    assert set(after) <= set(before) and len(dealt) == dealt["bucket"].nunique() > len(sent)
    again = [x for part in (known, dealt) for x in zip(*map(list, sd.numbered(part)), strict=True)]
    assert len(known) and sorted(again) == sorted(x[1:4] for x in before)  # each goes on or is known, once
    windows = lambda found: {(b, text) for b, _, _, _, text in found}
    assert windows(before) == windows(after)


def test_suffix_dedup_takes_ids_of_any_type(spark):
    rows = [("b", "x" * 60), ("a", "x" * 60), (None, "x" * 60), ("c", "plain")]
    got = {r["doc_id"]: r["n_removed"] for r in sd.dedup_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 60, None: 60, "c": 0}


def test_windows_differ_by_any_byte_before_the_anchor():
    r = np.random.default_rng(1)
    n = 400
    prior = r.integers(0, 2, (n, sd.BEFORE), dtype=np.uint8)
    prior[:, :12] = 0
    ids = r.integers(0, 50, n)
    low, high = sd.window_spans(np.r_[0, np.full(n - 1, sd.SPAN)], prior, np.full(n, sd.BEFORE), np.full(n, sd.SPAN), ids)
    for i in range(n):
        gone = [o for o in range(sd.BEFORE + 1) if any(ids[j] < ids[i] and (prior[j, :o] == prior[i, :o]).all() for j in range(n))]
        assert (low[i], high[i]) == ((min(gone), max(gone)) if gone else (sd.SPAN, -1))


def test_suffix_dedup_texts(spark):
    rows = [(1, "a" * 60 + "end"), (2, "start" + "a" * 55)]
    got = {r["doc_id"]: r["text"] for r in sd.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: "a" * 60 + "end", 2: "start"}
    assert sd.dedup_report(empty(spark)).count() == 0


# ---------------------------------------------------------------- decontamination


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best / (dc.MATCH * len(a))


def test_alignment_equals_the_plain_recurrence():
    r = random.Random(0)
    pairs = [([r.randint(1, 4) for _ in range(r.randint(1, 12))], [r.randint(1, 4) for _ in range(r.randint(1, 20))]) for _ in range(300)]
    got = dc.align([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    assert np.allclose(got, [smith_waterman(a, b) for a, b in pairs])


def test_decontamination(spark):
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(15, 50)))) for i in range(12)] + [(98, None), (99, "tooshort item"), (None, " ".join(vocabulary[:20]))]
    rows, want = [], set()
    for d in range(80):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 300))]
        if d % 2:
            item, text = items[d % 12]
            copy = [w if r.random() > 0.12 * (d % 3) / 2 else "changed" for w in text.upper().split()]
            words[len(words) // 2 : len(words) // 2] = copy
            want.add((d, item))
        rows.append((d, ", ".join(words)))
    rows += [(100, None), (101, ""), (102, " ".join(vocabulary[:20])), (102, " ".join(vocabulary[:20]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = dc.contamination(docs(spark, rows), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want | {(102, None)} and Counter(x["doc_id"] for x in got)[102] == 2
    kept = dc.drop_contaminated(docs(spark, rows), bench)
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(i for i, _ in rows if i not in {d for d, _ in want} | {102})
    assert dc.contamination(empty(spark), bench).count() == 0 and dc.drop_contaminated(docs(spark, rows), bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("exact", [0, 3])
def test_copies_edited_every_few_words_are_found(spark, exact):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(i, [r.choice(vocabulary) for _ in range(r.randint(15, 50))]) for i in range(9)]
    rows, want = [], set()
    for d in range(54):
        item, copy = items[d % 9]
        gap, at = 4 + d % 3, d // 9 % 4
        edited = [w if k % gap != at else f"edit{d}x{k}" for k, w in enumerate(copy)]
        words = [r.choice(vocabulary) for _ in range(120)]
        words[60:60] = edited
        score = smith_waterman(copy, words)
        assert score >= 0.5
        rows.append((d, " ".join(words)))
        want.add((d, item, round(score, 9)))
    whole = [(100 + 10 * i + k, " ".join(w)) for i, w in items for k in range(exact)]
    common = [(500 + k, " ".join(w[4:7])) for k in range(50) for _, w in items]  # n-grams of items that many documents hold
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = dc.contamination(docs(spark, rows + whole + common), bench).collect()
    assert {(x["doc_id"], x["item_id"], round(x["score"], 9)) for x in got if x["doc_id"] < 100} == want
    assert {x["doc_id"] for x in got if x["doc_id"] >= 100} == {i for i, _ in whole}
    kept = dc.drop_contaminated(docs(spark, rows + whole + common), bench)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in common}


def every_alignment(items, texts):
    """(text, item): score of the alignment of every pair, by the vectors that are held against the plain recurrence."""
    code = {w: k + 1 for k, w in enumerate({w for x in [*items, *texts] for w in x})}
    coded = lambda x: np.array([code[w] for w in x], np.uint64)
    own, near = [coded(w) for w in items], [coded(t) for t in texts]
    pairs = [(d, i) for d in range(len(texts)) if len(texts[d]) for i in range(len(items))]
    return dict(zip(pairs, dc.align([(own[i], near[d]) for d, i in pairs]).tolist(), strict=True))


@pytest.mark.parametrize("size", [3, 6, 8, 12, 20, 40])
def test_seeds_find_what_alignment_of_all_pairs_finds(spark, size):
    """Recall against the alignment of every pair, for copies with every k-th word changed, words dropped or put in."""
    r = random.Random(size)
    vocabulary = [f"word{i}" for i in range(2000)] + ["the", "of", "and"] * 100
    items, texts = [], []
    for k in (3, 4, 5, 6):
        for _ in range(40):
            w = [r.choice(vocabulary) for _ in range(size)]
            first, how = r.randrange(k), r.choice(["change", "drop", "insert"])
            copy = [x for i, x in enumerate(w) for x in ((x,) if i % k != first else ("odd",) if how == "change" else () if how == "drop" else (x, "odd"))]
            items.append(w)
            texts.append([r.choice(vocabulary) for _ in range(30)] + copy + [r.choice(vocabulary) for _ in range(30)])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = dc.contamination(docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)]), bench).collect()
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in found}
    want = {p: s for p, s in every_alignment(items, texts).items() if s >= 0.5}
    for k in range(4):
        own = {p for p in want if p[0] // 40 == k}
        assert len(own) >= 20 and sum(p in got for p in own) >= 0.9 * len(own), (size, k, len(own))
    assert set(got) <= set(want) and sum(abs(got[p] - want[p]) < 1e-9 for p in got) == len(got) == len(found)


def test_any_alignment_above_a_half_holds_a_seed(spark):
    """Random edits of every kind: what reaches the threshold is found, to the last pair."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items, texts = [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 7, 8, 9, 15, 30]))] for _ in range(60)], []
    for w in items * 4:
        rate = r.choice([0.2, 0.35, 0.5])
        edit = lambda x: (x,) if r.random() > rate else r.choice([("odd",), (), (x, "odd"), ("odd", "odd"), (x, x)])  # noqa: B023, E731
        texts.append([r.choice(vocabulary) for _ in range(9)] + [y for x in w for y in edit(x)] + ["end"])
    texts += [[y for x in w for y in (x, "odd")] for w in items]  # a word put in behind every word
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in dc.contamination(docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)]), bench).collect()}
    want = {p: s for p, s in every_alignment(items, texts).items() if s >= 0.5}
    assert len(want) > 150 and got == pytest.approx(want)


def test_heavy_seeds_are_left_to_rarer_ones(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(2000)]
    heavy = ["one", "of", "the", "most"]
    items = [[r.choice(vocabulary) for _ in range(12)] + heavy + [r.choice(vocabulary) for _ in range(12)] for _ in range(8)]
    items += [heavy * 3, heavy + ["things", "that", "all", "say"]]  # every text has the last one
    texts = [[r.choice(vocabulary) for _ in range(60)] + items[9] for _ in range(120)]
    for k, w in enumerate(items[:8]):
        texts[k][20:20] = [x if n % 4 else "odd" for n, x in enumerate(w)]
    texts[8][20:20] = items[8]
    for k, w in enumerate(items[:8]):
        texts[20 + k][20:20] = w
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)])
    keys = dc.keyed(bench, "text", "item_key")
    own = dc.item_grams(keys)
    seeds = dc.chosen_seeds(dc.keyed(rows, "text"), own, [2])
    code = int(dc.grams(*dc.hashed_words(["one of the"]), (0, 1, 2))[1].view(np.int64)[0])
    assert own.filter(f"gram = {code}").select("item_key").distinct().count() == 10
    assert seeds.filter(f"gram = {code}").count() == 0 and seeds.select("item_key").distinct().count() == 10
    got = {(x["doc_id"], x["item_id"]) for x in dc.contamination(rows, bench).collect()}
    assert got == {p for p, s in every_alignment(items, texts).items() if s >= 0.5} == {(k, k) for k in range(9)} | {(20 + k, k) for k in range(8)} | {(d, 9) for d in range(120)}


def test_a_field_of_bits_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(dc, "PART_BITS", 8)
    r = np.random.default_rng(1)
    own, others = r.integers(-(2**63), 2**63 - 1, 3000), r.integers(-(2**63), 2**63 - 1, 20000)
    field = dc.field_of(spark.createDataFrame([(int(x),) for x in [*own, *own[:9]]], "gram long"))
    assert len(field.held(own.view(np.uint64))) == 3000 and len(field.held(others.view(np.uint64))) < 200
    monkeypatch.setattr(dc, "MAX_BITS", 12)  # a crowded field lets more through, and still loses none
    field = dc.field_of(spark.createDataFrame([(int(x),) for x in own], "gram long"))
    assert len(field.bits) == 512 and len(field.held(own.view(np.uint64))) == 3000
    assert dc.field_of(spark.createDataFrame([], "gram long")) is None


def test_items_of_one_and_two_words(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, ""), (4, "--")], "item_id long, text string")
    got = dc.contamination(docs(spark, [(1, "x Alpha y"), (2, "beta x gamma"), (3, "beta gamma"), (4, "beta x x gamma"), (5, "gamma beta"), (6, "beta beta gamma x")]), bench)
    assert {(x["doc_id"], x["item_id"], x["score"]) for x in got.collect()} == {(1, 1, 1.0), (2, 2, 0.75), (3, 2, 1.0), (6, 2, 1.0)}


def test_short_items_find_all_that_their_score_admits(spark):
    r = random.Random(5)
    for size in (1, 2):
        items = [[r.choice("abcdefgh") for _ in range(size)] for _ in range(30)]
        texts = [[r.choice("abcdefghxyz") for _ in range(r.randint(0, 9))] for _ in range(200)]
        bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
        got = {(x["doc_id"], x["item_id"]): x["score"] for x in dc.contamination(docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)]), bench).collect()}
        assert got == {(d, i): s for d, t in enumerate(texts) for i, w in enumerate(items) if t and (s := smith_waterman(w, t)) >= dc.SHORT_SCORE}


def test_hits_of_a_text_need_few_rows_and_none_is_lost(spark):
    """A text of one item's words over and over: rows grow with its length in items."""
    r = random.Random(2)
    vocabulary = ["the", "of", "and", "to", *(f"w{i}" for i in range(30))]
    items = [[r.choice(vocabulary) for _ in range(r.choice([2, 5, 20]))] for _ in range(40)] + [["the"] * 30]
    texts = [[r.choice(vocabulary) for _ in range(r.choice([30, 600]))] for _ in range(15)] + [[], items[0], ["the"] * 900]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)])
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in dc.contamination(rows, bench).collect()}
    least = lambda w: dc.SHORT_SCORE if len(w) <= dc.SHORT else 0.5
    assert got == pytest.approx({p: s for p, s in every_alignment(items, texts).items() if s >= least(items[p[1]])})
    own = dc.item_grams(dc.keyed(bench.filter("item_id = 40"), "text", "item_key"))
    slots = dc.slots_of(dc.keyed(rows.filter("doc_id = 17"), "text"), own, [2], dc.field_of(own)).collect()
    assert len(slots) <= 900 // 30 + 2 and sum(s["n_seeds"] for s in slots) > 3000 and all(s["hi"] - s["lo"] < 30 for s in slots)


def test_ids_of_one_name_in_both_tables(spark):
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon")], "doc_id long, text string")
    got = dc.contamination(docs(spark, [(1, "x alpha beta gamma delta epsilon y"), (2, "z")]), bench, item_col="doc_id")
    assert [(x["doc_id"], x["item_doc_id"]) for x in got.collect()] == [(1, 7)]


# ---------------------------------------------------------------- urls


def url_brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c.lower() if c.isascii() else c
    path = rest[len(host) :].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fit)[2], max(fit)[3]) if fit else (None, default))


def test_urls(spark):
    r = random.Random(1)
    rules = [("com", "/", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/x/y", "block"), ("b.a.com", "", "allow"), ("net", "/é", "block"), ("x.net", "", "block"), ("om", "/", "block"), ("a.co", "", "block")]
    urls = [None, "", "nohost", "http://", "HTTP://COM", "x://a.com?q=/x", "://com/", "http://É.net/é"]
    urls += ["http://" + r.choice(["", "www.", "b.", "c.b."]) + r.choice(["com", "a.com", "A.Com", "xa.com", "net", "x.net", "a.co", "."]) + r.choice(["", "/", "/x", "/x/y#f", "/x/yz?q", "/é", "?a", "#/x"]) for _ in range(400)]
    pages = spark.createDataFrame([(i % 350, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string").repartition(3)
    got = uf.url_filter(pages, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((i % 350, *url_brute(u, rules)) for i, u in enumerate(urls))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert uf.url_filter(pages, none).count() == len(urls) and uf.url_filter(pages.limit(0), none).count() == 0
    assert {x["verdict"] for x in uf.url_filter(pages, none).collect()} == {"allow"}


def test_url_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
    got = queries.op9_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict")
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(f"select page_id, host, path, rule, verdict from ({queries.oracle_sql()['op9_url_filter']})").fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


# ---------------------------------------------------------------- near duplicates


def counted(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in both) for d in a if d in b)


def near_texts(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 160))]
        for k in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(k % 5):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += r.randint(1, 3)
    rows += [(n + 1, rows[0][1]), (n + 2, "a b"), (n + 3, "a  b"), (n + 4, ""), (n + 5, " "), (n + 6, None), (n + 1, rows[0][1]), (None, rows[0][1]), (None, "alone here"), (n + 7, "w " * 50_000)]
    r.shuffle(rows)
    return rows


def class_of(rows):
    last = 1 << 63
    texts = sorted({t or "" for _, t in rows})
    first = {t: min(last if i is None else i for i, x in rows if (x or "") == t) for t in texts}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: counted(t) for t in texts}
    for a in texts:
        for b in texts:
            if a < b and root(a) != root(b) and similarity(sets[a], sets[b]) >= 0.8:
                parent[root(b)] = root(a)
    least = {}
    for t in texts:
        least[root(t)] = min(least.get(root(t), last), first[t])
    return {t: (None if least[root(t)] == last else least[root(t)]) for t in texts}


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rows = near_texts(seed)
    want = class_of(rows)
    got = nd.near_duplicate_classes(docs(spark, rows))
    assert Counter((r["doc_id"], r["class_id"]) for r in got.collect()) == Counter((i, want[t or ""]) for i, t in rows)
    kept = nd.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(want.values()))
    assert nd.near_duplicate_classes(empty(spark)).count() == nd.keep_first(empty(spark)).count() == 0


def test_links_are_near_pairs_and_join_what_is_near(spark):
    rows = near_texts(0)
    want, last = class_of(rows), 1 << 63
    first = {}
    for i, t in rows:
        first[t or ""] = min(first.get(t or "", last), last if i is None else i)
    text_of = {i: t for t, i in first.items()}
    links = nd.near_duplicate_links(docs(spark, rows)).collect()
    parent = {i: i for i in text_of}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for x in links:
        exact = similarity(counted(text_of[x["a"]]), counted(text_of[x["b"]]))
        assert x["a"] < x["b"] and abs(x["similarity"] - exact) < 1e-9 and exact >= 0.8
        parent[max(root(x["a"]), root(x["b"]))] = min(root(x["a"]), root(x["b"]))
    assert len(links) > 10 and all(root(i) == (last if want[t] is None else want[t]) for i, t in text_of.items())
    assert nd.near_duplicate_links(empty(spark)).count() == 0


def test_near_duplicates_take_ids_and_columns_of_any_name_and_type(spark):
    near = [" ".join(f"n{i}" for i in range(100)), " ".join(f"n{i}" for i in range(98)) + " x y"]
    rows = [("b", near[0], "mine", 7), ("a", near[1], "mine", 8), (None, near[0], "own", 9), ("c", "alone", "own", None)]
    df = spark.createDataFrame(rows, "id string, text string, _STAY_ID string, _rank int")
    got = {r["id"]: (r["class_id"], r["text_id"], r["is_first"]) for r in nd.near_duplicate_classes(df, "id").collect()}
    assert got == {"a": ("a", "a", True), "b": ("a", "b", False), None: ("a", "b", False), "c": ("c", "c", True)}
    kept = nd.keep_first(df, "id")
    assert kept.schema == df.schema and sorted(tuple(r) for r in kept.collect()) == [rows[1], rows[3]]
    clash = spark.createDataFrame([(2, near[0], "mine"), (1, near[1], "own")], "doc_id int, text string, _stay_key string")
    assert [tuple(r) for r in nd.keep_first(clash).collect()] == [(1, near[1], "own")]


@pytest.mark.parametrize("seed", range(3))
def test_borderline_pairs_are_found(spark, seed):
    """Recall over pairs of a similarity of 0.80 to 0.85, each alone in its class."""
    r = random.Random(seed)
    rows, want = [], set()
    while len(want) < 120:
        n = r.randint(40, 200)
        a = [f"s{seed}p{len(want)}w{i}" for i in range(n)]
        b = list(a)
        for i in r.sample(range(n), max(1, n // 55)):
            b[i] = "edit"
        if 0.80 <= similarity(counted(" ".join(a)), counted(" ".join(b))) <= 0.85:
            k = 2 * len(want)
            rows += [(k, " ".join(a)), (k + 1, " ".join(b))]
            want.add((k, k + 1))
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicate_classes(docs(spark, rows)).collect()}
    assert sum(got[b] == a for a, b in want) >= 0.99 * len(want)


def test_probability_jaccard_and_registers():
    r = random.Random(5)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(30)]
    d, h, w = nd.shingles([t.encode() for t in texts])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(nd.probability_jaccard((h[d == i], w[d == i]), (h[d == j], w[d == j])) - similarity(counted(a), counted(b))) < 1e-9
    base = [f"x{i}" for i in range(150)]
    other = [w if i % 40 else "z" for i, w in enumerate(base)]
    pair = nd.shingles([" ".join(base).encode(), " ".join(other).encode()])
    registers, _ = nd.signatures(*pair, 2, m=3000)
    assert abs((registers[0] == registers[1]).mean() - similarity(counted(" ".join(base)), counted(" ".join(other)))) < 0.04


def test_buckets_of_several_chunks_give_the_same_classes(spark, monkeypatch):
    rows = near_texts(5)
    monkeypatch.setattr(nd, "CHUNK", 2)
    want = class_of(rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in nd.near_duplicate_classes(docs(spark, rows)).collect()) == Counter((i, want[t or ""]) for i, t in rows)


def test_large_group_emits_few_pairs(spark):
    r = random.Random(0)
    base = [f"g{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    keyed = nd._keyed(docs(spark, rows), "doc_id", "text")
    links = nd.find_links(nd.distinct_texts(keyed), keyed)
    assert links.count() < 40 * 300


def unlucky_pair(seed):
    """Two texts of similarity 0.806."""
    words = [f"s{seed}w{i}" for i in range(60)]
    return " ".join(words), " ".join(["x0" if i == 59 else "x1" if i == 30 else w for i, w in enumerate(words)])


def test_similar_pairs_with_few_equal_registers_are_verified(spark):
    a, b = unlucky_pair(2729)
    assert 0.8 <= similarity(counted(a), counted(b)) < 0.81
    registers, _ = nd.signatures(*nd.shingles([a.encode(), b.encode()]), 2)
    assert (registers[0] == registers[1]).mean() < 0.7
    far = " ".join(a.split()[:30] + ["z"] * 30)
    keyed = nd._keyed(docs(spark, [(1, a), (2, b), (3, far)]), "doc_id", "text")
    texts = nd.distinct_texts(keyed).cache()
    rid = {r["id"]: r["rid"] for r in texts.collect()}
    mixed = texts.selectExpr("rid", "rid AS root", "explode(bands) AS bucket").select("bucket", "rid", "root")
    mixed = mixed.join(mixed.groupBy("bucket").count().filter("count > 1").select("bucket"), "bucket")
    for pick in (nd.hopeful_pairs, nd.forest_pairs):
        got = nd.picked(mixed, texts, pick).collect()
        assert [(r["a"], r["b"]) for r in got] == [(min(rid[1], rid[2]), max(rid[1], rid[2]))]


def test_bound_is_never_below_the_similarity():
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.randint(1, 400))) for _ in range(60)]
    base = [f"y{i}" for i in range(3000)]
    texts += [" ".join(w if r.random() > e else "z" for w in base[:n]) for n in (100, 1000, 3000) for e in (0, 0.01, 0.02, 0.05)] + [" ".join(base[:100] * 400)]
    d, h, w = nd.shingles([t.encode() for t in texts])
    share = np.stack([nd.shares(x) for x in nd.binned(d, h, w, len(texts))])
    for i in range(len(texts)):
        exact = [nd.probability_jaccard((h[d == i], w[d == i]), (h[d == j], w[d == j])) for j in range(len(texts))]
        assert (nd.most_similar(share[i], share) >= np.array(exact) - nd.ROUNDING).all()


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame, kept = source, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.schema.names == source.schema.names
        kept.append(out.count())
        frame = out
    assert kept[0] > kept[1] > kept[2] == kept[3]
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == kept[3]


def brute_pipeline(rows, items):
    """The stages' decisions by plain means: (id, text) of the documents that reach packing."""
    kept = []
    for i, t in rows:
        n, _, repeated, longest = repeats_brute(t or "")
        spans = [x if x >= qr.MIN_REPEAT else 0 for x in longest]
        within = sum(any(j <= k < j + spans[j] for j in range(n)) for k in range(n))
        if n >= 10 and 100 * repeated <= 20 * n and within <= qr.MAX_COVERED * n and max(spans, default=0) <= qr.MAX_LONGEST:
            kept.append((i, t))
    classes, first = class_of(kept), []
    for i, t in sorted(kept, key=lambda x: (x[0] is None, x[0])):
        if classes[t] == i and i not in {x for x, _ in first}:
            first.append((i, t))
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    clean = [(i, t) for i, t in first if not any(smith_waterman(split(x), split(t)) >= dc.THRESHOLD for x in items)]
    out = []
    for i, t in clean:
        spans = sorted(base_brute(t) + own_brute(t) + [(m.start(), m.end(), "crc_token") for m in ss.CRC_TOKEN.finditer(t) if ss._crc_ok(m)], key=lambda x: (x[0], ss.KINDS.index(x[2]), x[1]))
        text, at = "", 0
        for s, e, k in spans:
            if s >= at:
                text += t[at:s] + f"<{k}>"
            at = max(at, e)
        out.append((i, text + t[at:]))
    return out


def test_pipeline_equals_its_brute_force(spark, tmp_path):
    r = random.Random(12)
    vocabulary = [f"word{i}" for i in range(900)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items, rows = [say(20) for _ in range(4)], []
    for i in range(60):
        w = say(r.randint(5, 120))
        if i % 6 == 1:
            w[len(w) // 2 : len(w) // 2] = [x if k % 7 else "edited" for k, x in enumerate(items[i % 4])]
        if i % 6 == 2:
            w += [GOOD, "password=abcdefghijklmnop", JWT, "4111 1111 1111 1111"]
        if i % 6 == 3:
            w += w[:30]
        if i % 6 == 4:
            w = rows[-1 - r.randrange(len(rows))][1].split()
            w[-1] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(70, None), (71, ""), (None, " ".join(say(40))), (3, rows[3][1])]
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_pipeline(rows, [" ".join(x) for x in items])
    coder, pieces = packing.IdBytes(TOKENIZER), Counter()
    for i, t in want:
        ids = coder.whole(t) + (1).to_bytes(4, "little")
        for s in range(0, len(ids), 4 * 2048):
            pieces[i, s // 4, zlib.crc32(ids[s : s + 4 * 2048]), len(ids) // 4] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x["doc_id"], x["start"], x["ids_crc32"], x["doc_tokens"]) for x in got) == pieces and 10 < len(want) < len(rows)


def test_pipeline_takes_odd_rows(spark, sf_dir):
    rows = repeated_texts(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs(spark, rows), sf_dir)
        assert out.columns == SCHEMA_NAMES and Counter(r["doc_id"] for r in out.collect()) <= Counter(i for i, _ in rows)
        assert stage(spark, empty(spark), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert {r["doc_id"] for r in last(spark, docs(spark, rows), sf_dir).collect()} == {i for i, _ in rows} and last(spark, empty(spark), sf_dir).count() == 0
