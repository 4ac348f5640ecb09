"""Word hashes by running sums, and the bound that spares passages a look."""

import numpy as np

from lodestrata.llm.common import ALNUM, ODD, mix64, word_hashes
from lodestrata.llm.decontaminate import Field, again, grams, may_match, most_matches, most_shared, pair_hashes, times_before


def test_word_hashes_are_those_of_single_words():
    texts = [b"", b"ab a  ab", b"x" * 9000 + b" y!ab", b"", b"\xff\x00"]

    def one(w):
        return int(mix64(np.array([sum((c + 1) * pow(int(ODD), k + 1, 1 << 64) for k, c in enumerate(w)) % (1 << 64)], dtype=np.uint64))[0])

    doc, h = word_hashes(texts, ALNUM)
    want = [(1, b"ab"), (1, b"a"), (1, b"ab"), (2, b"x" * 9000), (2, b"y"), (2, b"ab"), (4, b"\xff")]
    assert list(zip(doc.tolist(), h.tolist(), strict=True)) == [(d, one(w)) for d, w in want]
    assert len(word_hashes([b"", b" "], ALNUM)[0]) == 0


def test_cheap_bound_of_matches_is_never_below_the_exact_one():
    r = np.random.default_rng(3)
    items, passages = ([mix64(r.integers(0, 80, n).astype(np.uint64)) for n in r.integers(lo, 90, 300)] for lo in (1, 0))
    cheap = may_match([x.tobytes() for x in items], [x.tobytes() for x in passages])
    assert (cheap >= most_matches(items, passages)).all()
    apart = may_match([x.tobytes() for x in items], [mix64(x + np.uint64(1 << 40)).tobytes() for x in passages])
    assert (apart <= 0.2 * np.array(list(map(len, items))) + 1).all()
    assert len(may_match([], [])) == 0


def field_with(found, width=20):
    on = np.zeros(1 << width, np.uint8)
    for place in (found >> np.uint64(64 - width), found & np.uint64((1 << width) - 1)):
        on[place] = 1
    return Field(np.packbits(on, bitorder="little").tobytes(), width)


def test_bound_from_the_field_is_never_below_the_exact_one_and_near_it():
    r = np.random.default_rng(4)
    items, passages = ([mix64(r.integers(0, 80, n).astype(np.uint64)) for n in r.integers(lo, 90, 300)] for lo in (1, 0))
    own = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    row = lambda lists: np.repeat(np.arange(300), list(map(len, lists)))
    pair = pair_hashes(own[row(items)], np.concatenate(items))
    bound = most_shared(own, row(passages), np.concatenate(passages), field_with(again(pair, times_before(pair, row(items)))))
    exact = most_matches(items, passages)
    assert (bound >= exact).all() and (bound - exact).mean() < 2
    assert most_shared(own[:2], np.empty(0, np.int64), np.empty(0, np.uint64), field_with(pair)).tolist() == [0, 0]


def test_grams_of_known_words_are_those_that_may_be_an_items():
    doc, word = np.array([0] * 6 + [1] * 4), mix64(np.arange(10).astype(np.uint64))
    known = np.array([1, 1, 1, 0, 1, 1, 1, 1, 1, 1], dtype=bool)
    at, gram = grams(doc, word, (0, 1, 3))
    assert at.tolist() == [0, 1, 2, 6]
    some, found = grams(doc, word, (0, 1, 3), known)
    assert some.tolist() == [1, 6] and found.tolist() == gram[[1, 3]].tolist()


def test_passages_that_cannot_reach_the_threshold_stay_with_their_text(spark):
    from lodestrata.llm import decontaminate as dc

    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"a b {item} c"), (2, "w0 w1 w2 " + " ".join(f"x{i}" for i in range(60))), (3, " ".join(["w3"] * 40))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    sent, plain = [], dc.scored
    try:
        dc.scored = lambda passages, *rest: sent.append(passages.count()) or plain(passages, *rest)
        assert [(r["doc_id"], r["score"]) for r in dc.contamination(docs, bench).collect()] == [(1, 1.0)]
    finally:
        dc.scored = plain
    assert sent == [1]
