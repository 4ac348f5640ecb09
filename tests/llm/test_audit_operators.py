"""License scans, filter audits and conversation tries against brute force and their SQL."""

import glob
import hashlib
import math
import os
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import filter_audit as fa
from lodestrata.llm import license_scan as ls
from lodestrata.llm import prefix_trie as pt
from lodestrata.llm import queries
from tests.test_queries import rows as plain_rows

SCHEMA = "doc_id long, text string, source string, own string, key long, t string, words string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "own", 1, "t", "words", 2) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_filter_audit", "op13_prefix_trie"])
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = plain_rows(queries.queries()[name](spark, sf_dir).toPandas())
    assert got == plain_rows(con.execute(queries.oracle_sql()[name]).fetchdf()) and got[1]


# ---------------------------------------------------------------- licenses


def licensed(text, templates=ls.TEMPLATES, phrases=ls.PHRASES, threshold=ls.THRESHOLD):
    """All pieces against all blocks."""
    words = ls.WORD.findall(ls.lowered(text or "").decode())
    base, labels, places, score = set(), set(), [], 0.0
    for label, p in phrases:
        at = [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places += at
        if at:
            base.add(label)
            score = 1.0
    for label, t in templates:
        all_words = ls.WORD.findall(t.lower())
        n = -(-len(all_words) // ls.PIECE)
        for k in range(n):
            piece = all_words[k * len(all_words) // n : (k + 1) * len(all_words) // n]
            own, width = set(piece), next(w for w in ls.WIDTHS if w >= 2 * len(piece))
            for s in range(0, len(words), width // 4):
                share = Fraction(len(own & set(words[s : s + width])), len(own))
                if share >= Fraction(str(threshold)):
                    labels.add(label)
                    score = max(score, float(share))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def license_texts():
    r = random.Random(4)
    out = [None, "", " \n", "É ñ 中文 CC-by", "cc by cc by cc\nby", "all rights reserved all rights reserved", "General Public\tLicense", "accc by general public licenses", "word " * 60_000 + "cc by"]
    for _, t in ls.TEMPLATES:
        words = t.split()
        for cut in range(4):
            edited = [w for w in words if r.random() > 0.08 * cut]
            r.shuffle(edited) if cut == 3 else None
            out.append(" ".join(r.choice("the of and work under license is".split()) for _ in range(r.randint(0, 90))) + " " + " ".join(edited).upper() + " tail")
    return out


def test_license_report_equals_all_pieces_against_all_blocks(spark):
    texts = license_texts()
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "cc by", None), (3, "MIT license released under the", None), (7, "cc by", None), (7, "cc by", None)]
    got = ls.license_report(frame(spark, rows)).collect()
    want = [(i, *licensed(t)) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {w[6] for w in want if w[2] == 0} > {"", "mit", "bsd"} and any(0 < w[7] < 1 for w in want)


def test_license_report_of_hot_lines_other_templates_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ls, "TEMPLATE_CHARS", 40)  # several sets of templates
    templates = [("one", "alpha beta gamma delta epsilon"), ("two", "alpha zeta eta theta iota kappa"), ("none", "!!")]
    texts = ["alpha beta gamma delta"] * 300 + ["zeta eta theta iota kappa", "beta gamma " * 40, "ALPHA beta, gamma; epsilon by cc by"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = ls.license_report(frame(spark, rows), templates, [("cc-by", "cc by")]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *licensed(t, templates, [("cc-by", "cc by")]))) for i, t, _ in rows)
    assert ls.license_report(frame(spark, []), templates).collect() == [] and ls.license_report(frame(spark, []), (), ()).collect() == []
    blocks = ls.license_blocks(frame(spark, rows[300:]), templates, [("cc-by", "cc by")]).collect()
    assert {(b["doc_id"], b["label"], b["containment"]) for b in blocks} == {(300, "two", 5 / 6), (302, "one", 0.8), (302, "cc-by", 1.0)}
    with pytest.raises(ValueError):
        ls.license_report(frame(spark, rows), templates, [("long", "one two three four five six")])


def test_rarest_words_make_the_prefix(spark):
    docs = frame(spark, [(i, "the license of the work " * 5, None) for i in range(20)] + [(99, "mozilla", None)])
    pieces = ls.Pieces([("a", "the mozilla license of work")], (), 0.8)
    pieces.order(ls.word_counts(ls._rows(docs, "doc_id", "text"), pieces))
    assert pieces.words[0] == "mozilla" and pieces.words[-1] == "the" and len(pieces.rows[0]["prefix"]) == 2
    made = ls.candidate_blocks(ls._rows(docs, "doc_id", "text"), pieces).collect()
    assert sum(len(m["blocks"]) for m in made if m["own"] == "99") == 1


# ---------------------------------------------------------------- filter audit


def audited(rows, labels):
    """All orders, filter by filter."""
    first = {}
    for i, t, _ in rows:
        t = t or ""
        if t not in first or (i is not None and (first[t] is None or i < first[t])):
            first[t] = i
    failed = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        bad = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i != first[t])
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        failed.append((s or "", {f for f, b in zip("ABCDE", bad, strict=True) if b}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shares = [], Counter()
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        for p in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(p):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shares[part, f] += len(gone)
                all_failing = sum(f in x[1] for x in mine)
                out.append((part, "".join(p), k + 1, len(left), len(gone), all_failing - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
    return [(*r[:9], shares[r[0], r[9]]) for r in out]


def test_audit_equals_filters_applied_in_every_order(spark):
    r = random.Random(8)
    texts = [None, "", "  ", "\x1c a", "Ü" * 5, "word " * 250, " ".join(map(str, range(200))), " ".join(map(str, range(199))), "A" * 3 + "b" * 147, "A" * 3 + "b" * 146, "x" * 300_000]
    texts += [" ".join(r.choice(["a", "B", "c#", "d", str(k)]) for k in range(r.randint(150, 300))) for _ in range(60)]
    rows = [(r.randint(0, 90), t, r.choice(["s", None, "t"])) for t in texts * 3] + [(None, "", "s"), (None, "null ids", "s"), (None, "null ids", "s"), (5, "twice", "s"), (5, "twice", "t")]
    labels = [(r.choice([*range(0, 90), None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(120)]
    got = fa.filter_audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == sorted(audited(rows, labels))
    assert fa.filter_audit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_least_squares_give_the_shapley_values():
    r = random.Random(1)
    for n in range(2, 6):
        value = [0, *(r.randint(-50, 50) for _ in range((1 << n) - 1))]
        marginal = Counter()
        for p in permutations(range(n)):
            s = 0
            for i in p:
                marginal[i] += value[s | 1 << i] - value[s]
                s |= 1 << i
        assert [sum(w * v for w, v in zip(row, value, strict=True)) for row in fa.shapley_weights(n)] == [marginal[i] for i in range(n)]


def test_a_group_of_copies_is_spread_over_the_tasks(spark):
    docs = frame(spark, [(i, "same text", "s") for i in range(2000)])
    failed = fa.failures(docs).collect()
    assert len(failed) == 2000 and sum(x["mask"] & 16 == 0 for x in failed) == 1


# ---------------------------------------------------------------- conversation tries


def trie(rows):
    """All prefixes of all rebuilt conversations."""
    conv = {}
    for c, t, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    conv = {c: [x[2:] for x in sorted(turns)] for c, turns in conv.items()}
    made = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = conv.get(c - int(math.fmod(c, 5)), [])[:h] + conv[c][h:]
    nodes, below = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved = Counter(), Counter()
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            below.setdefault(p[:-1], []).append(p)
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ended = lambda p, m: ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], hashlib.sha256(ended(p, m).encode()).hexdigest()) for p, m in nodes.items()]


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x", "n", 3) for r in rows], "conv_id long, turn long, role string, text string, conv int, tid binary, chain string, place int").repartition(3)


def talk_rows():
    r = random.Random(6)
    rows = [(None, 0, "user", "nobody's"), (2, None, None, None), (2, None, "a", "b"), (2, 1, "user", ""), (3, 5, "u", "same"), (3, 5, "u", "same"), (3, 5, "u", "other"), (-7, 1, "u", "below zero"), (1 << 60, 0, "ü", "ünïcode")]
    for c in range(10, 200):  # copies, near copies and a first turn that most share
        rows += [(c, k, "user", "hot" if k < 3 else f"{r.randint(0, 1 + k % 3)}") for k in range(r.randint(1, 14))]
    for c in range(300, 420):
        rows += [(c, k, "user", f"copy {k}") for k in range(12)]
    for c in (500, 501):  # two long ones with a long common beginning
        rows += [(c, k, "bot", f"long {k}" if k < 900 else f"{c} {k}") for k in range(1000)]
    return rows


@pytest.mark.parametrize("container", [1, 6, 100, pt.CONTAINER])
def test_trie_equals_all_prefixes(spark, container):
    rows = talk_rows()
    got = pt.prefix_trie(*pt.rebuilt(pt.numbered(talks(spark, rows))), container=container)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, trie(rows)))


def test_trie_of_little(spark):
    assert pt.conversation_trie(talks(spark, [])).collect() == []
    assert pt.conversation_trie(talks(spark, [(None, 1, "a", "b")])).collect() == []
    for rows in ([(4, 0, "u", "x")], [(5, 0, "u", "x"), (6, 0, "u", "y")]):
        assert sorted(map(repr, map(tuple, pt.conversation_trie(talks(spark, rows)).collect()))) == sorted(map(repr, trie(rows)))


def test_a_conversation_longer_than_a_part_keeps_its_order(spark):
    rows = [(1, k, "u", str(k % 7)) for k in range(500)] + [(2, 0, "u", "x")]
    got = {(x["conv"], x["place"]): x for x in pt.in_order(pt.turn_rows(talks(spark, rows)).withColumn("at", F.col("turn")), "at", parts=9).collect()}
    chain, cum = 1, 0
    for k in range(500):
        x = got[1, k]
        chain, cum = (chain * pt.BASE + int.from_bytes(x["tid"])) % pt.PRIME, cum + len(str(k % 7))
        assert x["chain"] == chain.to_bytes(16) and x["cum"] == cum


def test_digest_of_many_copies_is_made_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 20)
    ends = spark.createDataFrame([(b"a", c) for c in range(300)] + [(b"b", 7)], "seq binary, conv long").repartition(5)
    got = {bytes(r["seq"]): (r["conv"], r["n"], r["ends"]) for r in pt.end_digests(ends).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {b"a": (0, 300, sha(range(300))), b"b": (7, 1, sha([7]))}
