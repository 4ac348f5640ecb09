"""Token counts, secrets, quality rules, classifier, language and packing against brute force."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestrata.llm import language_id as lang
from lodestrata.llm import packing, queries
from lodestrata.llm import quality_classifier as qc
from lodestrata.llm import quality_rules as qr
from lodestrata.llm import secret_scan as ss
from lodestrata.llm import token_counts as tc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, t string"


def frame(spark, texts):
    """Texts with null, empty, blank, long and repeated ones, and columns whose names clash."""
    odd = [(None, "null id"), (1 << 60, "large id"), (7, None), (8, ""), (9, " \n\t"), (10, "x" * 200_000), (10, "same row"), (10, "same row")]
    rows = [(i + 100, t) for i, t in enumerate(texts)] + odd
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "t") for i, t in rows], SCHEMA).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return repr(x)


# ---------------------------------------------------------------- tokens


def best_split(word, scores):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        s, n = best[i - 1]
        top = (s + tc.UNKNOWN, n - 1)
        for j in range(i):
            if word[j:i] in scores:
                top = max(top, (best[j][0] + scores[word[j:i]], best[j][1] - 1))
        best.append(top)
    return -best[-1][1], best[-1][0]


def test_trie_counts_equal_word_by_word_counts():
    scores = tc.unigram_scores(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(2)
    words = sorted({tc.MARK + "".join(r.choice("theandioné!") for _ in range(r.randint(1, 14))) for _ in range(400)})
    trie = tc.TrieCounter(scores)
    assert trie.counts(words) == [best_split(w, scores) for w in words]
    assert trie.steps < sum(map(len, words))  # shared prefixes were computed once


def test_token_counts(spark):
    df, rows = frame(spark, ["the cat sat", "the the"])
    model = public_tokenizers.path("piece_bpe_32k.model")
    scores = tc.unigram_scores(model)
    want = [(i, len((t or "").split()), sum(best_split(tc.MARK + w, scores)[0] for w in (t or "").split() if len(w) < 1000)) for i, t in rows]
    got = [(r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in tc.token_counts(df, model).collect()]
    long = max(n for *_, n in got)
    assert sorted((g for g in got if g[2] != long), key=key) == sorted((w for w in want if not (w[0] == 10 and w[2] == 0)), key=key)
    assert tc.token_counts(empty(spark), model).count() == 0
    given = {tc.MARK + "the": -1.0, tc.MARK: -9.0, "c": -1.0, "at": -1.0, "cat": -2.5, "s": -1.0}
    one = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in tc.token_counts(df, model, given).collect() if r["doc_id"] in (100, 101)}
    assert one == {100: (7, -1.0 - 11.0 - 11.0), 101: (2, -2.0)}


# ---------------------------------------------------------------- secrets


def token62(body):
    n, s = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        s = ss.DIGITS62[r] + s
    return f"ghp_{body}{s}"


GOOD = token62("abcdefghijKLMNOPQRST0123456789")
JWT = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=") + ".eyJzdWIiOjF9.c2ln"


def base_brute(t):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], ss.KINDS.index(x[2])))


def test_base_spans_equal_plain_regular_expressions():
    r = random.Random(4)
    parts = ["password", "ToKen", "api_key", "APIKEY", "ſecret", "secret", "=", ":", " ", "'", '"', "abc123DEF456ghi", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "tok", "İ", "K"]
    auto = ss.automaton()
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [x for x in ss.scan(t, auto) if x[2] in ss.BASE] == base_brute(t), t


def test_checks_inside_secrets():
    auto = ss.automaton()
    kinds = lambda t: {k for *_, k in ss.scan(t, auto)}
    assert "crc_token" in kinds(f"é {GOOD} x") and "crc_token" not in kinds(GOOD[:-1] + ("0" if GOOD[-1] != "0" else "1"))
    assert "jwt" in kinds(f"bearer {JWT}") and "jwt" not in kinds("eyJhbGciOiJIUzI1NiIsxxxx.eyJx.y")
    assert "card" in kinds("pay 4111 1111 1111 1111 now") and "card" not in kinds("pay 4111 1111 1111 1112 now")
    assert "private_key" in kinds("-----BEGIN RSA PRIVATE KEY-----\nabc=\n-----END RSA PRIVATE KEY-----")


JWT_PLAIN = re.compile(r"(?a:(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+)")
ARMOUR_PLAIN = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----[A-Za-z0-9+/=\s,:-]+?-----END \1-----")


def own_brute(t):
    out = [(m.start(), m.end(), "jwt") for m in JWT_PLAIN.finditer(t) if ss._jwt_ok(m[1])]
    out += [(m.start(), m.end(), "private_key") for m in ARMOUR_PLAIN.finditer(t)]
    out += [(m.start(), m.end(), "card") for m in ss.CARD.finditer(t) if ss.luhn_ok(m[0])]
    return sorted(out)


def test_own_spans_equal_plain_regular_expressions():
    r = random.Random(9)
    head = JWT.split(".")[0]
    parts = ["eyJ", head, head, ".", ".", "-", "x", " ", "é", "eyJzdWIi", "-----BEGIN ", "-----END ", "PRIVATE KEY", "RSA ", "-----", "\n", "abc=", "4111", "1111", "1111 ", "41111111", "4111 1111 1111 1111", "5", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "!", f"{head}.eyJzdWIi.x"]
    auto, seen = ss.automaton(), Counter()
    for _ in range(60_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        got = sorted(x for x in ss.scan(t, auto) if x[2] in ("jwt", "private_key", "card"))
        assert got == own_brute(t), t
        seen.update(k for *_, k in got)
    assert min(seen[k] for k in ("jwt", "private_key", "card")) > 5


@pytest.mark.parametrize("unit", ["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "eyJ", "eyJabcdefgh.", "password", "token=", "secret ", "AKIA", "ghp_", "4111 ", "4111", "a1", "-----BEGIN A PRIVATE KEY-----x"])
def test_long_repeats_take_time_in_proportion(unit):
    began = time.process_time()
    ss.scan(unit * (10_000_000 // len(unit)), ss.automaton())
    assert time.process_time() - began < 30


def test_a_deeply_nested_header_is_no_token():
    head = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    assert [k for *_, k in ss.scan(f"{head}.eyJzdWIi.c2ln", ss.automaton()) if k == "jwt"] == []


def test_secret_report_and_redaction(spark):
    texts = [f"é password = abcdefghijklmnop and {GOOD}", "0123456789abcdef0123", "clean"]
    df, rows = frame(spark, texts)
    got = {(r["doc_id"], r["n_assign"], r["n_hex"], r["base_sha256"]) for r in ss.secret_report(df).collect()}
    for i, t in rows:
        base = base_brute(t or "")
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert (i, sum(k == "assign" for *_, k in base), sum(k == "hex" for *_, k in base), hashlib.sha256(text.encode()).hexdigest()) in got
    new = ss.redact(df)
    assert new.schema == df.schema
    out = {r["doc_id"]: r for r in new.collect()}
    assert out[100]["text"] == "é <assign> and <crc_token>" and out[100]["n_chars"] == len(out[100]["text"])
    assert out[102]["text"] == "clean" and out[102]["n_chars"] is None and out[7]["text"] is None and out[1 << 60]["text"] == "large id"
    assert ss.secret_report(empty(spark)).count() == ss.redact(empty(spark)).count() == ss.find_secrets(empty(spark)).count() == 0


# ---------------------------------------------------------------- quality rules


def repeats_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    c = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    mark = [any(c[tuple(w[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, n - 5) + 1)) for i in range(n)]
    longest = [max((next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), 0) for j in range(n) if j != i), default=0) for i in range(n)]
    return n, sum(map(len, w)), sum(mark), longest


def test_repetition_equals_brute_force():
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(80)] + ["", "  ", "one two three four five one two three four five"]
    m = qr.measure(texts, 6)
    for i, t in enumerate(texts):
        n, chars, words, longest = repeats_brute(t)
        spans = [x if x >= 6 else 0 for x in longest]
        assert (m["n_words"][i], m["word_chars"][i], m["n_repeat_words"][i]) == (n, chars, words)
        assert m["longest_repeat"][i] == max(spans, default=0)
        assert m["repeat_covered"][i] == sum(any(j <= k < j + x for j, x in enumerate(spans)) for k in range(n))


def test_quality_report(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    quote = " ".join(f"q{i}" for i in range(60))
    df, rows = frame(spark, [clean, "a b c " * 30, "# $ same\nsame\n\nsame\n one two three four five six seven", f"{quote} {clean} {' '.join(f'v{i}' for i in range(400))} {quote}"])
    got = {(r["doc_id"], r["n_words"]): r for r in qr.quality_report(df).collect()}
    assert got[100, 200]["kept"] and not got[101, 90]["kept"] and got[101, 90]["base_failed"]
    assert got[102, 12]["n_dup_lines"] == 1 and got[102, 12]["n_symbols"] == 2
    assert not got[8, 0]["kept"] and not got[7, 0]["kept"]
    long = got[103, 720]
    assert not long["base_failed"] and long["longest_repeat"] == 60
    kept = qr.reject_low_quality(df)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {i for (i, _), r in got.items() if r["kept"]}
    assert qr.quality_report(empty(spark)).count() == qr.reject_low_quality(empty(spark)).count() == 0
    assert len(rows) == qr.quality_report(df).count()


def test_each_limit_rejects_what_the_base_rule_keeps(spark):
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    twice = lambda n, total: f"{words('r', n)} {words('a', total - 2 * n)} {words('r', n)}"
    texts = {"covered": twice(20, 300), "longest": twice(60, 4000), "long text": twice(900, 20_000), "short repeat": twice(50, 4000), "little": twice(9, 300), "none": words("c", 300)}
    df, _ = frame(spark, list(texts.values()))
    got = {name: r for name, r in zip(texts, sorted((r for r in qr.quality_report(df).collect() if 100 <= (r["doc_id"] or 0) < 200), key=lambda r: r["doc_id"]), strict=True)}
    assert not any(r["base_failed"] for r in got.values())
    assert {name for name, r in got.items() if not r["kept"]} == {"covered", "longest", "long text"}
    assert (got["covered"]["repeat_covered"], got["covered"]["longest_repeat"]) == (40, 20)
    assert (got["longest"]["repeat_covered"], got["longest"]["longest_repeat"]) == (120, 60)
    kept = {r["doc_id"] for r in qr.reject_low_quality(df).collect()}
    assert kept & set(range(100, 106)) == {103, 104, 105}


# ---------------------------------------------------------------- models


def test_attention_finds_the_bad_passage():
    r = np.random.default_rng(0)
    bags, y = [], []
    for i in range(1100):
        b = r.normal(size=(r.integers(1, 9), qc.N_FEATURES))
        if i % 2:
            b[r.integers(len(b)), 3] += 6
        bags.append(b)
        y.append(float(i % 2 == 0))
    m = qc.Attention(qc.N_FEATURES).fit(bags[:1000], np.array(y[:1000]), epochs=30)
    assert ((m.score(bags[1000:]) > 0.5) == (np.array(y[1000:]) > 0.5)).mean() > 0.9


def test_attention_equals_a_loop_over_passages():
    """Scores of bags of any length, word for word as the method says: gated attention, weighted passages, a logistic."""
    import math

    r = np.random.default_rng(9)
    bags = [r.normal(0, 3, size=(k, qc.N_FEATURES)) for k in (1, 4, 2, 30)]
    m = qc.Attention(qc.N_FEATURES)
    m.mean, m.scale = r.normal(size=qc.N_FEATURES), r.uniform(0.5, 2, qc.N_FEATURES)
    for v in m.p.values():
        v += r.normal(0, 0.2, v.shape)
    p, scores = {k: v.tolist() for k, v in m.p.items()}, []
    logistic = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda row, matrix, j: sum(x * w[j] for x, w in zip(row, matrix, strict=True))
    for bag in bags:
        encoded, energy = [], []
        for passage in bag.tolist():
            x = [max(-8.0, min(8.0, (f - a) / b)) for f, a, b in zip(passage, m.mean.tolist(), m.scale.tolist(), strict=True)]
            h = [math.tanh(dot(x, p["W"], j) + p["b"][j]) for j in range(qc.HIDDEN)]
            energy.append(sum(math.tanh(dot(h, p["V"], j)) * logistic(dot(h, p["U"], j)) * p["w"][j] for j in range(qc.ATTENTION)))
            encoded.append(h)
        total = sum(math.exp(e) for e in energy)
        z = [sum(math.exp(e) / total * h[j] for e, h in zip(energy, encoded, strict=True)) for j in range(qc.HIDDEN)]
        scores.append(logistic(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"][0]))
    assert np.allclose(m.score(bags), scores, atol=1e-9)
    assert np.allclose(m.score([bags[2]]), scores[2], atol=1e-9) and len(m.score([])) == 0


def test_attention_learns_down_its_gradient():
    """The fit's step against the loss measured at two near points, for every weight."""
    r = np.random.default_rng(4)
    bags, y = [r.normal(size=(k, qc.N_FEATURES)) for k in (1, 3, 2, 5)], np.array([1.0, 0.0, 1.0, 0.0])
    m = qc.Attention(qc.N_FEATURES)
    flat = np.concatenate(bags)
    m.mean, m.scale = flat.mean(0), flat.std(0) + 1e-3

    def loss():
        s = m.score(bags)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    before, old = loss(), {k: v.copy() for k, v in m.p.items()}
    m.fit(bags, y, epochs=1, batch=4, rate=1e-5, decay=0)  # Adam's first step is the sign of the gradient
    step = {k: m.p[k] - old[k] for k in old}
    assert loss() < before
    m.p.update({k: v.copy() for k, v in old.items()})
    for k in old:
        for at in list(np.ndindex(old[k].shape))[:: max(1, old[k].size // 12)]:
            m.p[k][at] = old[k][at] + 1e-5
            up = loss()
            m.p[k][at] = old[k][at] - 1e-5
            slope = (up - loss()) / 2e-5
            m.p[k][at] = old[k][at]
            assert abs(slope) < 1e-6 or np.sign(slope) == -np.sign(step[k][at]), (k, at, slope)


def test_rare_languages_and_repeated_ids_train(spark):
    rows = [(i, f"wort{i % 7} und nicht das", "de") for i in range(3000)] + [(5000, "kaksi yksi ja hyvä on ei kyllä", "fi")] + [(7, "wort und", "de")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang.fit_languages(docs, max_docs=100)
    assert model.languages == ["de", "fi"] and next(lang.predict(model, ["hyvä kyllä kaksi yksi"]))[0] == "fi"
    labels = spark.createDataFrame([(7, 1)] * 40 + [(8, 0)], "doc_id long, quality int")
    assert qc.fit_quality(docs, labels, max_docs=10) is not None


def test_long_texts_are_labelled_in_parts(monkeypatch):
    m = lang.ChainField(["a", "b"], {})
    m.weights[:] = np.random.default_rng(2).normal(size=m.weights.shape)
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i % 7)}x" for i in range(3000))
    want = list(lang.predict(m, [text, "", text[:500]]))
    monkeypatch.setattr(lang, "PART", lang.CHAIN * 3)
    got = list(lang.predict(m, [text, "", text[:500]]))
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_quality_classifier(spark, sf_dir):
    got = queries.op5_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    df, rows = frame(spark, ["a"])
    assert {r["score"] for r in qc.classify_quality(df, none).collect()} == {0.5} and qc.classify_quality(empty(spark), none).count() == 0
    some = spark.createDataFrame([(100, 1), (100, 0), (101, None), (8, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    assert qc.classify_quality(df, some).count() == len(rows)


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
    df, all_ = frame(spark, ["the and of", "123 456 ²", "---"])
    got = {r["doc_id"]: r["lang_pred"] for r in lang.identify(df, lang.fit_languages(spark.read.parquet(f"{sf}/documents.parquet"), 300)).collect()}
    assert got[100] == "en" and got[101] == got[102] == got[7] == got[8] == "und" and len(all_) == lang.identify_languages(df).count()
    assert {r["lang_pred"] for r in lang.identify_languages(df).collect()} == {"und"} and lang.identify_languages(empty(spark)).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    m = lang.ChainField(["a", "b", "c"], {})
    r = np.random.default_rng(3)
    m.moves = r.normal(size=(3, 3))
    scores = r.normal(size=(5, 3))
    got, expected = m.marginals(scores, *lang.chains(np.array([5])))
    want, pairs = np.zeros((5, 3)), np.zeros((3, 3))
    for p in itertools.product(range(3), repeat=5):
        w = np.exp(sum(scores[i, x] for i, x in enumerate(p)) + sum(m.moves[x, y] for x, y in itertools.pairwise(p)))
        for i, x in enumerate(p):
            want[i, x] += w
        for x, y in itertools.pairwise(p):
            pairs[x, y] += w
    assert np.allclose(got, want / want.sum(1, keepdims=True)) and np.allclose(expected, pairs / want[0].sum())


# ---------------------------------------------------------------- packing


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", ["It's 'sdon't ''s <|endoftext|> a", "a\x1cb ΑΣ Σ. é é", "ça va? “quoted” ½ ² x² 日本語 İ ŉ ß", "", "  ", "'re 've''ll--'d", "a. b, c.d ., . ,, é. É, Aƻ. ǆ. x²."])
def test_ids_are_the_tokenizers(text):
    c = packing.IdBytes(TOKENIZER)
    texts = [text, "", f"x {text} y", text]
    flat, count = c.ids(pa.array(texts))
    assert [x.tobytes() for x in np.split(flat, np.cumsum(count)[:-1])] == [c.whole(t) for t in texts]


def test_a_file_with_other_steps_gets_its_own_ids(spark):
    other = public_tokenizers.path("byte_bpe_50k.json")
    c = packing.IdBytes(other)
    flat, count = c.ids(pa.array(["The cat  sat", "", "É"]))
    assert not c.known_steps and [x.tobytes() for x in np.split(flat, np.cumsum(count)[:-1])] == [c.whole(t) for t in ["The cat  sat", "", "É"]]
    df, rows = frame(spark, ["The cat  sat"] * 3)
    assert sum(r["length"] for r in packing.pack(df, other, size=64).collect()) == sum(len(c.whole(t or "")) // 4 + 1 for _, t in rows)


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packs_hold_everything(seed):
    r = random.Random(seed)
    counts = Counter(min(64, int(r.expovariate(0.05)) + 1) for _ in range(r.randint(0, 3000)))
    patterns, got = packing.pack_histogram(dict(counts), 64), Counter()
    for n, lengths in patterns:
        assert n > 0 and 0 < sum(lengths) <= 64
        for x in lengths:
            got[x] += n
    assert got == counts
    packs = sum(n for n, _ in patterns)
    assert packs * 64 - sum(k * v for k, v in counts.items()) <= max(64, 0.05 * packs * 64)


def test_packing(spark):
    df, rows = frame(spark, ["the cat sat on the mat " * 40, "hello"] * 20)
    got = packing.pack(df, TOKENIZER, size=128).collect()
    coder = packing.IdBytes(TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = coder.whole(t or "") + (1).to_bytes(4, "little")
        for s in range(0, len(ids), 512):
            want[i, s // 4, len(ids[s : s + 512]) // 4, zlib.crc32(ids[s : s + 512]), len(ids) // 4] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 128
    assert sorted(held) == list(range(len(held)))
    assert packing.pack(empty(spark), TOKENIZER).count() == 0
