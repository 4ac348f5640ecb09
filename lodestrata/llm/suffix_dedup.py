"""Suffix-array dedup: a distributed merge sort of suffixes that never compares a known common prefix again.

Removed is every byte covered by a `SPAN`-byte string that also starts in a document with a smaller id.

1. Anchors. Of each window of `SPAN` bytes the `GRAM`-byte string of least hash is its anchor, so two copies of a
   window have the same anchor at the same place, and about one suffix in fifteen starts at an anchor. Hashes of
   anchors meet in buckets; those of two or more documents are kept. A task sends a hash that several of its own
   documents share once, however often it occurs.
2. Runs. Each task sorts the suffixes at kept anchors, cut after `SPAN` bytes, with the bytes before them. Of equal
   suffixes with equal bytes before them only the smallest document's goes on: for the others the answer is known. A
   run is front-coded: the common prefix with the suffix before, and only the bytes beyond it.
3. Merge. A loser tree combines the runs of a bucket. Each contender carries its common prefix with the last winner:
   the longer prefix wins without looking at the texts, equal ones are compared beyond it, and the result is the
   common prefix that the loser keeps. The output is a suffix array with common prefixes.
4. Verdicts. In that order the suffixes that share SPAN - o bytes are intervals; within one, those with the same o
   bytes before them (compared in full, by their own order and common prefixes) hold the same window. All but the
   smallest document's are removed.
5. Spans come back to their documents, overlaps are joined, and the rest is hashed.

Two levels. A task that sends straight to each of very many buckets would send runs of a suffix or two, with nothing
to front-code. So beyond `DIRECT` buckets both exchanges go by way of cells of neighbouring buckets, about as many as a
cell has buckets. A part of a cell, of bounded size, merges the runs that came to it and deals them to its buckets as
fewer and longer ones.

Crowded buckets. A string that very many documents hold with other bytes around it would fill one bucket with different
suffixes. So a bucket has slots, whose anchors are counted first. Where a bucket has more than twice the mean, its slots
beyond an eighth of the mean go as the windows around their anchors, each a suffix of its own in the bucket of all its
bytes, where equal ones are again sent once by a task and once by a part of a cell. The mean is bounded by PER_BUCKET, so
what a bucket keeps is, at any size of the input. The counts are estimates from one anchor in SAMPLED, by its hash; they
choose the way of an anchor and no result. The driver holds a bit a slot, that is a bit for each 750 KB of text.

Defined results: texts are UTF-8; a null text is empty. Ids that aren't integers are compared in their own order. Texts shorter than SPAN lose nothing. Of equal texts all but the
smallest id's go. Rows with the same id don't remove each other's bytes; identical rows each keep a row. Null ids come
after all others. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import groups_of, id_ranks, materialise, mix64, partitions, short_batches, with_number

SPAN, GRAM = 50, 20
#: Anchors that a window has room for, and the most bytes before an anchor that a window holds.
ROOM = SPAN - GRAM + 1
BEFORE = SPAN - GRAM
#: Bytes hashed at once, bytes whose anchors and whose suffixes are grouped in a task, bytes of text that a bucket's anchors come from.
BLOCK, GROUP, RUN_GROUP, PER_BUCKET = 1_000_000, 8_000_000, 4_000_000, 12_000_000
#: Slots of a bucket, one anchor of how many is counted, and anchors up to which a bucket is never crowded.
SLOTS, SAMPLED, FEW = 16, 16, 20_000
#: Buckets that a task sends to directly, and bytes of text that a part of a cell comes from.
DIRECT, PER_PART = 4096, 16_000_000
LAST_ID = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- anchors


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each position, composed from hashes of powers of two."""
    cur, size, out, held = mix64(b.astype(np.uint64) + np.uint64(1)), 1, None, 0
    power = lambda n: np.uint64(pow(int(ODD), n, 1 << 64))
    while True:
        if k & size:
            if out is None:
                out = cur
            else:
                n = len(b) - held - size + 1
                out = out[:n] * power(size) + cur[held : held + n]
            held += size
        if held == k:
            return mix64(out)
        n = len(b) - 2 * size + 1
        cur = cur[:n] * power(size) + cur[size : size + n]
        size *= 2


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of each w consecutive values."""
    size = 1
    while 2 * size <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of all anchors of texts of SPAN bytes or more."""
    long = [i for i, t in enumerate(texts) if len(t) >= SPAN]
    if not long:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    b = np.frombuffer(b"".join(texts[i] for i in long), dtype=np.uint8)
    sizes = np.array([len(texts[i]) for i in long])
    ends = np.cumsum(sizes)
    h = gram_hashes(b, GRAM)
    least = sliding(h, ROOM, np.minimum)  # by window start
    for e in ends[:-1]:
        least[e - SPAN + 1 : e] = 0  # windows that would cross into the next text
    reach = sliding(np.r_[np.zeros(ROOM - 1, np.uint64), least, np.zeros(ROOM - 1, np.uint64)], ROOM, np.maximum)
    at = np.flatnonzero((reach == h) & (h > 0))
    doc = np.searchsorted(ends, at, side="right")
    return np.array(long)[doc], at - (ends - sizes)[doc], h[at]


def shrunk(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def grown(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def planes(x: np.ndarray) -> bytes:
    """32-bit values as four planes of bytes, compressed: the high ones are mostly zero."""
    return shrunk(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(grown(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def grouped(batches: Iterator[pd.DataFrame], text: str, most: int) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += int(b[text].map(len).sum())
        if size >= most:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def slot_counts(slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(slot, n) of a group of texts: how many of its anchors that are counted lie in each slot."""
        for b in grouped(batches, "text", GROUP):
            texts, which = [bytes(t) for t in b["text"]], mix64(b["id"].to_numpy(np.int64).view(np.uint64)) ^ b["key"].to_numpy(np.int64).view(np.uint64)
            found = []
            for lo, hi in groups_of([len(t) for t in texts], BLOCK):
                doc, at, h = anchors(texts[lo:hi])
                found.append(h[mix64(which[lo + doc] + at.astype(np.uint64) * ODD) % np.uint64(SAMPLED) == 0])
            slot, n = np.unique(np.concatenate(found) % np.uint64(slots), return_counts=True)
            yield pd.DataFrame({"slot": slot.astype(np.int64), "n": n})

    return run


def crowded_slots(keyed: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """A bit for each slot, set where its anchors go as windows, and about how many anchors these are."""
    slots = buckets * SLOTS
    counts = materialise(keyed.select("id", "key", "text").mapInPandas(slot_counts(slots), "slot bigint, n bigint").groupBy("slot").agg((F.sum("n") * SAMPLED).alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) // buckets
    own = counts.groupBy((F.col("slot") / SLOTS).cast("bigint").alias("bucket")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("slot", "n")).alias("own"))  # SLOTS at most
    full = own.filter(F.col("total") > max(2 * mean, FEW)).select(F.inline("own")).filter(F.col("n") > max(mean, FEW) // 8).toPandas()
    bits = np.zeros(slots, dtype=bool)
    bits[full["slot"].to_numpy(np.int64)] = True
    return np.packbits(bits, bitorder="little"), int(full["n"].sum())


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


ANCHORS = "bucket int, shared boolean, ids binary, keys binary, doc binary, pos binary, gram binary, fine binary"


def names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def anchor_row(bucket: int, shared: bool, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, gram: np.ndarray, fine: np.ndarray | None) -> tuple:
    """A row of ANCHORS; ids and keys are numbered by `doc`, and `fine` is each anchor's bucket within its cell."""
    used, local = np.unique(doc, return_inverse=True)
    return bucket, shared, ids[used].tobytes(), keys[used].tobytes(), planes(local), planes(pos), planes(np.diff(gram, prepend=gram[:0].dtype.type(0))), b"" if fine is None else planes(fine)


def one_of(keys: np.ndarray, n: int) -> int:
    """A number below n for rows that may go anywhere."""
    return int(mix64(keys[:1].view(np.uint64))[0] % np.uint64(n))


def cells_of(buckets: int) -> int:
    """Buckets of a cell: 1 where tasks send to buckets directly."""
    return 1 if buckets <= DIRECT else math.isqrt(buckets - 1) + 1


def by_cells(rows: DataFrame, deal, columns: str, total: int, buckets: int) -> DataFrame:
    """Rows that came by cells, in parts of bounded size, as rows by buckets."""
    width = cells_of(buckets)
    if width == 1:
        return rows
    parts = total * width // buckets // PER_PART + 1
    part = F.pmod(F.xxhash64("ids", "keys", "pos"), F.lit(parts)).alias("part")
    return rows.groupBy("bucket", part).applyInPandas(deal(width), columns)


def numbered(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(id, key, position) of everything in these rows, end to end."""
    each = [(np.frombuffer(r.ids, np.int64)[d], np.frombuffer(r.keys, np.int64)[d], unplanes(r.pos).astype(np.int64)) for r in pdf.itertuples() for d in [unplanes(r.doc)]]
    return tuple(map(np.concatenate, zip(*each, strict=True)))


def pairs_of(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (id, key), and the number of each row's."""
    both, doc = np.unique(np.stack([ids, keys], axis=1), axis=0, return_inverse=True)
    return both[:, 0], both[:, 1], doc.ravel()


def met(ids: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted anchors whose hash is `new` where it differs from the one before: those that two documents have, and the first of each."""
    start = np.flatnonzero(new)
    two = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
    return np.repeat(two, np.diff(np.r_[start, len(ids)])), new


def dealt_anchors(width: int):
    """The anchors of a part of a cell by bucket; those known to be shared pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[names(ANCHORS)]
        known, sent = pdf[pdf["shared"]], pdf[~pdf["shared"]]
        if not len(sent):
            return known
        ids, keys, pos = numbered(sent)
        gram = np.concatenate([np.cumsum(unplanes(x), dtype=np.uint32) for x in sent["gram"]])
        fine = np.concatenate([unplanes(x) for x in sent["fine"]]).astype(np.int64)
        order = np.lexsort((gram, fine))
        ids, keys, doc = pairs_of(ids, keys)
        doc, pos, gram, fine = doc[order], pos[order], gram[order].astype(np.uint64), fine[order]
        shared, first = met(ids[doc], np.r_[True, (gram[1:] != gram[:-1]) | (fine[1:] != fine[:-1])])
        start, rows = int(sent["bucket"].iloc[0]) * width, []
        if shared.any():  # of an anchor that this part shows to be shared, one goes on
            rows.append(anchor_row(start + one_of(keys, width), True, ids, keys, doc[shared], pos[shared], gram[shared], None))
        send = np.flatnonzero(~shared | first)
        edges = np.flatnonzero(np.r_[True, fine[send][1:] != fine[send][:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at = send[lo:hi]
            rows.append(anchor_row(start + int(fine[at[0]]), False, ids, keys, doc[at], pos[at], gram[at], None))
        return pd.concat([known, pd.DataFrame(rows, columns=names(ANCHORS))], ignore_index=True)

    return run


def anchor_blocks(buckets: int):
    width = cells_of(buckets)
    cells = (buckets - 1) // width + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in grouped(batches, "text", GROUP):
            texts = [bytes(t) for t in b["text"]]
            found = []
            for lo, hi in groups_of([len(t) for t in texts], BLOCK):
                d, p, h = anchors(texts[lo:hi])
                found.append((d + lo, p, h))
            doc, pos, h = map(np.concatenate, zip(*found, strict=True))
            if not len(h):
                continue
            ids, keys = b["id"].to_numpy(np.int64), b["key"].to_numpy(np.int64)
            full = ((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))
            order = np.argsort(full, kind="stable")
            full, doc, pos = full[order], doc[order], pos[order]
            shared, first = met(ids[doc], np.r_[True, full[1:] != full[:-1]])
            rows = []

            def add(bucket: int, known: bool, at: np.ndarray) -> None:
                fine = None if width == 1 or known else (full[at] >> np.uint64(32)) % np.uint64(width)
                rows.append(anchor_row(bucket, known, ids, keys, doc[at], pos[at], full[at] & np.uint64(0xFFFFFFFF), fine))

            if shared.any():
                add(one_of(keys, buckets), True, np.flatnonzero(shared))
            send = np.flatnonzero(~shared | first)
            edges = np.searchsorted((full[send] >> np.uint64(32)) // np.uint64(width), np.arange(cells + 1).astype(np.uint64))
            for k in np.flatnonzero(np.diff(edges)):
                add(int(k), False, send[edges[k] : edges[k + 1]])
            yield pd.DataFrame(rows, columns=names(ANCHORS))

    return run


def shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors whose hash two or more documents have."""
    out = []
    parts = [[], [], [], []]
    for r in pdf.itertuples():
        local = unplanes(r.doc)
        ids, keys, pos = np.frombuffer(r.ids, np.int64)[local], np.frombuffer(r.keys, np.int64)[local], unplanes(r.pos)
        if r.shared:
            out.append(pd.DataFrame({"id": ids, "key": keys, "pos": pos.astype(np.int32)}))
        else:
            for x, y in zip(parts, (ids, keys, pos, np.cumsum(unplanes(r.gram), dtype=np.uint32)), strict=True):
                x.append(y)
    if parts[0]:
        ids, keys, pos, gram = map(np.concatenate, parts)
        order = np.argsort(gram, kind="stable")
        gram, mine = gram[order], ids[order]
        at = order[met(mine, np.r_[True, gram[1:] != gram[:-1]])[0]]
        out.append(pd.DataFrame({"id": ids[at], "key": keys[at], "pos": pos[at].astype(np.int32)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "key": [], "pos": []}).astype({"id": np.int64, "key": np.int64, "pos": np.int32})


# ---------------------------------------------------------------- front-coded runs

RUNS = "bucket int, shared binary, fresh binary, before binary, room binary, ids binary, keys binary, doc binary, pos binary, fine binary"


def run_row(bucket: int, after: np.ndarray, prior: np.ndarray, room: np.ndarray, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, fine: np.ndarray | None) -> tuple:
    """A row of RUNS from suffixes in order; spans that are known already (a bucket below 0) need no bytes."""
    same, fresh = front_code(after) if bucket >= 0 else (np.empty(0, np.uint8), b"")
    before = prior.tobytes() if bucket >= 0 else b""
    used, local = np.unique(doc, return_inverse=True)
    return bucket, shrunk(same.tobytes()), shrunk(fresh), shrunk(before), shrunk(room.tobytes()), ids[used].tobytes(), keys[used].tobytes(), planes(local), planes(pos), b"" if fine is None else planes(fine)


def front_code(m: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted row with the one before, and the bytes beyond."""
    same = np.zeros(len(m), dtype=np.uint8)
    if len(m) > 1:
        differs = m[1:] != m[:-1]
        same[1:] = np.where(differs.any(1), differs.argmax(1), m.shape[1])
    return same, m[np.arange(m.shape[1]) >= same[:, None]].tobytes()


def front_decode(same: np.ndarray, fresh: bytes, width: int) -> np.ndarray:
    n = len(same)
    own = np.arange(width) >= same[:, None]
    m = np.zeros((n, width), dtype=np.uint8)
    m[own] = np.frombuffer(fresh, np.uint8)
    source = np.where(own, np.arange(n)[:, None], 0)
    np.maximum.accumulate(source, axis=0, out=source)
    return m[source, np.arange(width)]


def sorted_runs(buckets: int, crowded: np.ndarray, wide: int):
    """Front-coded runs of a task's suffixes at shared anchors, and spans that are known already (buckets below 0).

    crowded: a bit a slot; their windows go to all of `wide` buckets.
    """
    width = cells_of(wide)
    cells = (wide - 1) // width + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in grouped(batches, "text", RUN_GROUP):
            pos = [np.unique(np.asarray(p, dtype=np.int64)) for p in b["at"]]
            sizes = np.array([len(p) for p in pos])
            texts = [bytes(t) for t in b["text"]]
            lengths = np.array([len(t) for t in texts])
            flat = np.frombuffer(b"".join([bytes(BEFORE), *(t + bytes(SPAN) for t in texts)]), np.uint8)
            starts = BEFORE + np.cumsum(lengths + SPAN) - (lengths + SPAN)
            doc, at = np.repeat(np.arange(len(b)), sizes), np.concatenate(pos)
            windows = np.lib.stride_tricks.sliding_window_view(flat, SPAN)
            slot = (gram_hash(windows[starts[doc] + at], GRAM) % np.uint64(buckets * SLOTS)).astype(np.int64)
            spread = is_set(crowded, slot)
            own_doc, own_at = windows_around(doc[spread], at[spread], lengths)
            alone = np.repeat([False, True], [int((~spread).sum()), len(own_at)])
            doc, at = np.r_[doc[~spread], own_doc], np.r_[at[~spread], own_at]
            bucket = np.r_[slot[~spread] // SLOTS, (gram_hash(windows[starts[own_doc] + own_at], SPAN) % np.uint64(wide)).astype(np.int64)]
            here = starts[doc] + at
            after = windows[here]
            left, right = np.where(alone, 0, np.minimum(at, BEFORE)), np.minimum(lengths[doc] - at, SPAN)
            prior = np.lib.stride_tricks.sliding_window_view(flat, BEFORE)[here - BEFORE][:, ::-1].copy()
            prior[np.arange(BEFORE) >= left[:, None]] = 0
            room = np.stack([left, right], axis=1).astype(np.uint8)
            ids, keys = b["id"].to_numpy(np.int64), b["key"].to_numpy(np.int64)
            first, known = least_of_equals(after, prior, room, ids[doc])
            rows = []

            def add(bucket: int, pick: np.ndarray, fine: np.ndarray | None = None) -> None:
                rows.append(run_row(bucket, after[pick], prior[pick], room[pick], ids, keys, doc[pick], at[pick], fine))

            if len(known):
                add(-1 - one_of(keys, wide), known)
            bucket = bucket[first]
            by = np.argsort(bucket // width, kind="stable")
            edges = np.searchsorted(bucket[by] // width, np.arange(cells + 1))
            for k in np.flatnonzero(np.diff(edges)):
                here = by[edges[k] : edges[k + 1]]
                add(int(k), first[here], None if width == 1 else bucket[here] % width)
            yield pd.DataFrame(rows, columns=names(RUNS))

    return run


def least_of_equals(after: np.ndarray, prior: np.ndarray, room: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, of equal ones with equal bytes before them only the least document's, and the others."""
    whole = np.concatenate([after, prior, room], axis=1)
    lines = np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel()
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(lines[order], kind="stable")]  # by content and then by id
    content = lines[order]
    new = np.r_[True, content[1:] != content[:-1]][: len(order)]
    least = ids[order][new][np.cumsum(new) - 1]
    return order[ids[order] == least], order[ids[order] > least]


def gram_hash(rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of the first k bytes of each row, the same as that of `gram_hashes`."""
    h, each = np.zeros(len(rows), dtype=np.uint64), mix64(np.arange(1, 257, dtype=np.uint64))
    for j in range(k):
        h = h * ODD + each[rows[:, j]]
    return mix64(h)


def windows_around(doc: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all windows that hold the GRAM bytes at these places, each once."""
    doc, start = np.repeat(doc, ROOM), (at[:, None] - np.arange(ROOM)).ravel()
    fits = (start >= 0) & (start + SPAN <= lengths[doc])
    both = np.unique(np.stack([doc[fits], start[fits]], axis=1), axis=0)
    return both[:, 0], both[:, 1]


# ---------------------------------------------------------------- loser tree


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs. shared: common prefix of each string with the one before it in its run.

    Returns, in order, the number of each string (runs laid end to end) and its common prefix with the one before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    base, total = [], 0
    for r in runs:
        base.append(total)
        total += len(r)
    place, known = [0] * k, [0] * k  # next string of each run; its common prefix with the last winner
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    tree = [0] * k  # the loser at each inner node

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); only bytes beyond an equal known prefix are compared."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = known[a]
        diff = int.from_bytes(x[n:]) ^ int.from_bytes(y[n:])
        if not diff:
            known[b] = len(x)
            return a, b
        n = len(x) - (diff.bit_length() + 7) // 8
        if x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            w, tree[level + i] = play(winners[2 * i], winners[2 * i + 1])
            nxt.append(w)
        winners = nxt
    w = winners[0]
    order, prefixes = [], []
    while head[w] is not None:
        order.append(base[w] + place[w])
        prefixes.append(known[w])
        place[w] = i = place[w] + 1
        if i < len(runs[w]):
            head[w], known[w] = runs[w][i], shared[w][i]
        else:
            head[w] = None
        node = (k + w) // 2
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2
    return order, prefixes


# ---------------------------------------------------------------- verdicts


def window_spans(common: np.ndarray, prior: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order, the least and largest number of bytes before the anchor at which a window is removed.

    common: common prefix with the suffix before. Windows around one anchor overlap, so what they cover is one span.
    """
    n = len(ids)
    low, high = np.full(n, SPAN), np.full(n, -1)
    # rows in the order of the bytes before them, and how many of these each has in common with the row before
    by_prior = np.argsort(np.ascontiguousarray(prior).view(f"V{BEFORE}").ravel(), kind="stable")
    differs = prior[by_prior[1:]] != prior[by_prior[:-1]]
    same = np.r_[0, np.where(differs.any(1), differs.argmax(1), BEFORE)] if n else np.zeros(0, dtype=np.int64)
    alike = np.zeros(n, dtype=np.int64)
    for o in range(BEFORE + 1):
        alike[by_prior] = np.cumsum(same < o)  # equal numbers: the same o bytes before
        need = SPAN - o
        joined = common >= need
        near = joined | np.r_[joined[1:], False]
        at = np.flatnonzero(near & (left >= o) & (right >= need))
        if not len(at):
            continue
        key = np.cumsum(~joined)[at] * (n + 1) + alike[at]
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        least = np.repeat(np.minimum.reduceat(ids[at][order], start), np.diff(np.r_[start, len(at)]))
        gone = at[order[ids[at][order] > least]]
        low[gone], high[gone] = np.minimum(low[gone], o), o
    return low, high


SPANS = "id bigint, key bigint, first int, last int"


def rooms(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.frombuffer(grown(x), np.uint8).reshape(-1, 2) for x in pdf["room"]])


def merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes, bytes before them, order, common prefixes) of the runs in these rows; the first two lie end to end."""
    runs, shared, decoded = [], [], []
    for r in pdf.itertuples():
        same = np.frombuffer(grown(r.shared), np.uint8)
        decoded.append(front_decode(same, grown(r.fresh), SPAN))
        flat = decoded[-1].tobytes()
        runs.append([flat[i : i + SPAN] for i in range(0, len(flat), SPAN)])
        shared.append(same.tolist())
    order, common = merge_runs(runs, shared)
    prior = np.concatenate([np.frombuffer(grown(x), np.uint8).reshape(-1, BEFORE) for x in pdf["before"]])
    return np.concatenate(decoded), prior, np.array(order), np.array(common)


def dealt_runs(width: int):
    """The runs of a part of a cell, merged, as one run for each of its buckets; known spans pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[names(RUNS)]
        if int(pdf["bucket"].iloc[0]) < 0:
            return pdf
        after, prior, order, _ = merged(pdf)
        room, (ids, keys, pos) = rooms(pdf), numbered(pdf)
        ids, keys, doc = pairs_of(ids, keys)
        fine = np.concatenate([unplanes(x) for x in pdf["fine"]]).astype(np.int64)
        # of suffixes that are equal with what is before them only the least document's go on, as in a task
        known = least_of_equals(after, prior, room, ids[doc])[1]
        go = np.ones(len(order), dtype=bool)
        go[known] = False
        order = order[go[order]]
        order = order[np.argsort(fine[order], kind="stable")]
        edges = np.flatnonzero(np.r_[True, fine[order][1:] != fine[order][:-1], True])
        start = int(pdf["bucket"].iloc[0]) * width
        picks = [order[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        rows = [run_row(start + int(fine[k[0]]), after[k], prior[k], room[k], ids, keys, doc[k], pos[k], None) for k in picks]
        if len(known):
            rows.append(run_row(-1 - start - one_of(keys, width), after[known], prior[known], room[known], ids, keys, doc[known], pos[known], None))
        return pd.DataFrame(rows, columns=names(RUNS))

    return run


def merged_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """Removed spans from a bucket's runs."""
    out = []
    known, pdf = pdf[pdf["bucket"] < 0], pdf[pdf["bucket"] >= 0]
    if len(known):  # a smaller document of the same task has the same bytes here
        (ids, keys, pos), room = numbered(known), rooms(known).astype(np.int64)
        out.append(pd.DataFrame({"id": ids, "key": keys, "first": pos - room[:, 0], "last": pos + room[:, 1]})[room.sum(1) >= SPAN])
    if len(pdf):
        (ids, keys, pos), room = numbered(pdf), rooms(pdf).astype(np.int64)
        _, prior, order, common = merged(pdf)
        low, high = window_spans(common, prior[order], room[order, 0], room[order, 1], ids[order])
        at = np.flatnonzero(high >= 0)
        pick = order[at]
        out.append(pd.DataFrame({"id": ids[pick], "key": keys[pick], "first": pos[pick] - high[at], "last": pos[pick] - low[at] + SPAN}))
    if not out:
        return pd.DataFrame({c: [] for c in names(SPANS)}).astype({"id": np.int64, "key": np.int64, "first": np.int32, "last": np.int32})
    got = pd.concat(out, ignore_index=True).astype({"first": np.int32, "last": np.int32})
    # neighbours of one document join here already, so that fewer rows move
    got = got.sort_values(["id", "key", "first"], ignore_index=True)
    top = got.groupby(["id", "key"])["last"].cummax()
    new = (got["id"] != got["id"].shift()) | (got["key"] != got["key"].shift()) | (got["first"] > top.shift(fill_value=0))
    return got.assign(g=new.cumsum()).groupby("g", as_index=False).agg(id=("id", "first"), key=("key", "first"), first=("first", "first"), last=("last", "max"))[["id", "key", "first", "last"]]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, UTF-8 text and the spans (array of first, last) that smaller documents hold too."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text"))
    keyed = with_number(rows, "own_id", id_ranks(docs, id_col), "id", LAST_ID).select("own_id", "id", "text", F.xxhash64("text").alias("key"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(partitions(spark), total // PER_BUCKET + 1)
    found = keyed.select("id", "key", "text").mapInPandas(anchor_blocks(buckets), ANCHORS)
    found = by_cells(found, dealt_anchors, ANCHORS, total, buckets).groupBy("bucket").applyInPandas(shared_anchors, "id bigint, key bigint, pos int")
    at = found.groupBy("id", "key").agg(F.collect_list("pos").alias("at"))
    # both joins deal `keyed` out by the same key, so the texts move once
    crowded, spread = crowded_slots(keyed, buckets)
    wide = max(buckets, buckets * spread * ROOM // 2 // (total // 15 + 1))  # windows of neighbours overlap, so about half of ROOM an anchor
    runs = keyed.join(at, ["id", "key"]).select("own_id", "id", "key", "text", "at").mapInPandas(sorted_runs(buckets, crowded, wide), RUNS)
    runs = by_cells(runs, dealt_runs, RUNS, total, wide)
    spans = runs.groupBy("bucket").applyInPandas(merged_spans, SPANS).groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return keyed.join(spans, ["id", "key"], "left").select(F.col("own_id").alias(id_col), "text", "spans")


def _with_ids(docs: DataFrame, run, columns: str, id_col: str, text_col: str) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col)
    out = spans.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(run, f"`{id_col}` string, {columns}")
    return out.select(F.col(id_col).cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, removed bytes and spans, and the digest of what is left, per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, spans in zip(b["text"], b["spans"], strict=True):
                text, digest, at = bytes(text), hashlib.sha256(), 0
                cut = union([(s["first"], s["last"]) for s in spans]) if spans is not None else []
                for s, e in cut:
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                rows.append((len(text), sum(e - s for s, e in cut), len(cut), digest.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, id_col, b[id_col].to_numpy())
            yield out

    return _with_ids(docs, run, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", id_col, text_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and what is left of its text; bytes of a character that is cut in two are dropped with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for text, spans in zip(b["text"], b["spans"], strict=True):
                text, at, kept = bytes(text), 0, []
                for s, e in union([(s["first"], s["last"]) for s in spans]) if spans is not None else []:
                    kept.append(text[at:s])
                    at = e
                texts.append(b"".join([*kept, text[at:]]).decode("utf-8", "ignore"))
            yield pd.DataFrame({id_col: b[id_col], text_col: texts})

    return _with_ids(docs, run, f"`{text_col}` string", id_col, text_col)
