"""Removal of 100-byte strings that occur earlier, by difference-cover suffix sorting.

Sorting every suffix of the corpus would shuffle many times the input, so an exact sieve comes first:

1. Every LENGTH-byte window has a minimizer, the SEED-byte string in it with the least hash (leftmost if
   equal). Equal windows have equal minimizers at the same offset, so a window can only repeat where its
   seed does. Each task emits one row for each seed and context (all bytes that windows around the seed can
   reach) and links each later equal context it has seen itself to the one before; hot passages so shrink
   before the exchange.
2. Rows meet by seed, sorted, in a stream; a seed with very many contexts in a first look at a part of the
   documents is dealt out by seed and context instead (it has several contexts for certain). A context that
   occurred earlier is linked to its last earlier place. Seeds with one context are done; only contexts of seeds
   that have several different ones go on.
3. Linked places next to each other form runs. The bytes of a run's earlier place go to its document and are
   compared there: only bytes that are equal are removed, and each place is asked for by its next one alone, so a
   hot passage has no hot source. If any comparison fails, two contexts had equal hashes, and all is done again
   with other hash functions; so no place is lost to a collision either.
4. The bytes of the contexts left by step 2, in two halves keyed by the 66 bytes that all windows of a half share,
   meet by that key. Each block of them gets a suffix array by the difference-cover algorithm (Karkkainen and
   Sanders 2003): sort the sampled triples, recurse on their names, merge the remaining suffixes. Adjacent suffixes
   are compared for LENGTH bytes, and of each run of equal windows all but the earliest are removed. A seed with
   more contexts than one array may hold (a passage of a great many documents, with other text around it) goes
   window by window instead: each task keeps the earliest place of each window and marks the later ones, and what
   is left meets by the whole window. So no array is over twice BLOCK bytes.

Every removed byte has been compared with the bytes of an earlier place. A document is a doc_id with a text (63 bits
of its hash); documents are ordered by doc_id, null first, then by that hash.

Defined cases: null texts are empty; texts under LENGTH bytes keep everything; a null doc_id comes first; several
texts may share a doc_id; rows with equal doc_id and text count as one document and get the same result; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, scratch, ship, text_or_empty

LENGTH, SEED = 100, 32
REACH = LENGTH - SEED  # bytes before a seed that its windows can reach
HALF = REACH // 2
#: Bytes hashed together, seeds a task holds before it emits them, bytes of one suffix array, single windows a
#: task holds.
BATCH, HELD, BLOCK, HELD_WINDOWS = 1 << 16, 4_000_000, 2 << 20, 1 << 17
_NO_ID = -(1 << 63)
#: Of the documents one in LOOK is looked at for seeds with at least HOT contexts there; the table of these seeds has at
#: most HOT_SEEDS rows, and any others are merely not dealt out.
LOOK, HOT, HOT_SEEDS = 64, 64, 100_000
_END = 256  # stands for what lies outside a document


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@functools.lru_cache(maxsize=4)
def _tables(salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of one hash function: of each symbol, of each doubling."""
    rng = np.random.default_rng(7 + salt)
    return tuple(rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (257, 16))


def _rolling(x: np.ndarray, span: int, salt: int) -> np.ndarray:
    """Hashes of all strings of `span` (a power of two) symbols."""
    of_symbol, factor = _tables(salt)
    h, s, k = of_symbol[x], 1, 0
    while s < span:
        h = h[:-s] * factor[k] + h[s:]
        s, k = 2 * s, k + 1
    return h


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each `span` neighbours, the leftmost if several are equal."""

    def join(value, place, step):
        right = value[step:] < value[:-step]
        return np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])

    value, place, s = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * s <= span:
        value, place = join(value, place, s)
        s *= 2
    return join(value, place, span - s)[1] if span > s else place


def seeds(texts: list[bytes], salt: int = 0, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place, seed hash and context hash of the minimizers of some texts. bits: of the hashes."""
    sizes = np.array([len(t) for t in texts])
    gap = bytes(LENGTH)
    x = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8).astype(np.int64)
    starts = LENGTH + np.concatenate([[0], np.cumsum(sizes + LENGTH)[:-1]])
    outside = np.ones(len(x), bool)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(len(owner))
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        outside[s : s + n] = False
    x[outside] = _END
    h = _mix(_rolling(x, SEED, salt)) >> np.uint64(64 - bits)
    at = _least(h, REACH + 1)[first].astype(np.int64)
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    at, owner = at[new], owner[new]
    context, factor = np.zeros(len(at), np.uint64), _tables(salt)[1]
    for k, off in enumerate((0, 32, 64, 96, 128, REACH + LENGTH - SEED)):
        context = _mix(context * factor[8 + k] + h[at - REACH + off])
    return owner, at - starts[owner], h[at].view(np.int64), (context >> np.uint64(64 - bits)).view(np.int64)


def _not_again(*columns: np.ndarray) -> np.ndarray:
    """False for sorted rows that equal the one before: those of documents that are stored twice."""
    again = np.ones(len(columns[0]), bool)
    for v in columns:
        again[1:] &= v[1:] == v[:-1]
    again[:1] = False
    return ~again


#: Rows of the exchange by seed. kind: 0 by seed, 1 linked already (h is any number), 2 of a hot seed.
_ROWS = "h bigint, c bigint, doc bigint, tie bigint, place int, kind tinyint, s_doc bigint, s_tie bigint, s_place int"
#: Links to an earlier place (h null), and contexts that go on.
_MET = "h bigint, doc bigint, tie bigint, place int, s_doc bigint, s_tie bigint, s_place int"


def _emit(rows: list[tuple[np.ndarray, ...]], hot: np.ndarray) -> pa.RecordBatch:
    """One candidate for each seed and context, the earliest; the others are linked to the one before."""
    doc, tie, place, h, c = (np.concatenate(v) for v in zip(*rows, strict=True))
    order = np.lexsort((place, tie, doc, c, h))
    order = order[_not_again(doc[order], tie[order], place[order], h[order], c[order])]
    doc, tie, place, h, c = doc[order], tie[order], place[order].astype(np.int32), h[order], c[order]
    later = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])] if len(h) else np.zeros(0, bool)
    source = np.maximum(np.arange(len(h)) - 1, 0)
    kind = np.where(later, 1, np.where(np.isin(h, hot), 2, 0) if len(hot) else 0).astype(np.int8)
    # Linked rows aren't looked at again; any key spreads them.
    h = np.where(later, _mix((doc * 31 + place).view(np.uint64)).view(np.int64), h)
    linked = [pa.array(v[source], mask=~later) for v in (doc, tie, place)]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (h, c, doc, tie, place, kind)] + linked, names=["h", "c", "doc", "tie", "place", "kind", "s_doc", "s_tie", "s_place"])


def _seed_rows(batches: Iterator[pa.RecordBatch], salt: int, bits: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        ids, ties, texts, size = [], [], [], 0
        n = batch.num_rows
        for i in range(n):
            doc, tie, t = (batch.column(k)[i].as_py() for k in range(3))
            if len(t) >= LENGTH:
                ids.append(doc)
                ties.append(tie)
                texts.append(t)
                size += len(t)
            if texts and (size >= BATCH or i == n - 1):
                owner, place, h, c = seeds(texts, salt, bits)
                held.append((np.array(ids, np.int64)[owner], np.array(ties, np.int64)[owner], place, h, c))
                count += len(h)
                ids, ties, texts, size = [], [], [], 0
            if count >= HELD:
                yield _emit(held, hot)
                held, count = [], 0
    if held:
        yield _emit(held, hot)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by seed, context, document and place: links and contexts that go on."""
    none = (0, 0, 0)
    last_key, last_at = None, none  # the last row's seed and context, and its place
    waiting: tuple[int, ...] | None = None  # the only context so far of the seed that the last batch ended with
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, doc, tie, place, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        linked = kind == 1
        links = [batch.filter(pa.array(linked)).select(["doc", "tie", "place", "s_doc", "s_tie", "s_place"])]
        h, c, doc, tie, place, hot = (v[~linked] for v in (h, c, doc, tie, place, kind == 2))
        fresh = _not_again(doc, tie, place, h, c)
        if len(h) and (h[0], c[0]) == last_key and (doc[0], tie[0], place[0]) == last_at:
            fresh[0] = False
        h, c, doc, tie, place, hot = (v[fresh] for v in (h, c, doc, tie, place, hot))
        on: list[tuple[np.ndarray, ...]] = []
        if len(h):
            new_h = np.r_[last_key is None or h[0] != last_key[0], h[1:] != h[:-1]]
            new_c = new_h | np.r_[last_key is None or c[0] != last_key[1], c[1:] != c[:-1]]
            before = [np.r_[np.array([x], v.dtype), v[:-1]][~new_c] for x, v in zip(last_at, (doc, tie, place), strict=True)]
            links.append(pa.RecordBatch.from_arrays([pa.array(v[~new_c]) for v in (doc, tie, place)] + [pa.array(v) for v in before], names=links[0].schema.names))
            group = np.cumsum(new_h)  # 0: the seed of the last batch goes on
            rep_group = group[new_c]
            per = np.bincount(rep_group, minlength=group[-1] + 1)
            contested = (per[rep_group] > 1) | hot[new_c]
            if not new_h[0]:
                if per[0] and waiting is not None:
                    on.append(tuple(np.array([v]) for v in waiting))
                    waiting = None
                contested |= rep_group == 0
            end = int(group[-1])
            if end > 0:
                waiting = None
                k = np.flatnonzero(new_c)[-1]
                if per[end] == 1 and not hot[k]:
                    waiting = (int(h[k]), int(doc[k]), int(tie[k]), int(place[k]))
            reps = np.flatnonzero(new_c)[contested]
            on.append((h[reps], doc[reps], tie[reps], place[reps]))
            last_key, last_at = (h[-1], c[-1]), (doc[-1], tie[-1], place[-1])
        out = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), *b.columns], names=["h", *b.schema.names]) for b in links])
        if on:
            h, doc, tie, place = (np.concatenate(v) for v in zip(*on, strict=True))
            nothing = [pa.nulls(len(h), t) for t in (pa.int64(), pa.int64(), pa.int32())]
            out = pa.concat_tables([out, pa.Table.from_arrays([pa.array(h), pa.array(doc), pa.array(tie), pa.array(place.astype(np.int32)), *nothing], names=out.schema.names)])
        yield from out.combine_chunks().to_batches()


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From links sorted by document, source, shift and place: runs of places that reach each other: doc, tie, start,
    the source's, and the size (the end of the text may come first; 0: can't be equal)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, tie, place, s_doc, s_tie, s_place = (batch.column(i).to_numpy() for i in range(6))
        new = np.ones(len(doc), bool)
        same = np.ones(len(doc) - 1, bool)
        for v in (doc, tie, s_doc, s_tie, place.astype(np.int64) - s_place):
            same &= v[1:] == v[:-1]
        new[1:] = ~(same & (place[1:] <= place[:-1] + REACH + LENGTH))
        lead = np.flatnonzero(new)
        last = place[np.r_[lead[1:], len(doc)] - 1]
        start, s_start = np.maximum(place[lead] - REACH, 0), np.maximum(s_place[lead] - REACH, 0)
        # Equal contexts begin alike in their texts, and a source begins earlier; else hashes have collided.
        apart = (place[lead] - start != s_place[lead] - s_start) | ((doc[lead] == s_doc[lead]) & (tie[lead] == s_tie[lead]) & (s_start >= start))
        runs = [doc[lead], tie[lead], start, s_doc[lead], s_tie[lead], s_start, np.where(apart, 0, last + LENGTH - start).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in runs], names=["doc", "tie", "start", "s_doc", "s_tie", "s_start", "size"])


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with the runs that have their source there: doc, tie, start and the source's bytes of each run."""
    last = None
    for batch in batches:
        for i in range(batch.num_rows):
            at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if at == last:  # a document stored twice
                continue
            last, t, out = at, batch.column(2)[i].as_py(), [[], [], [], []]
            for r in batch.column(3)[i].as_py():
                for v, x in zip(out, (r["doc"], r["tie"], r["start"], t[r["s_start"] : r["s_start"] + r["size"]]), strict=True):
                    v.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc", "tie", "start", "piece"])


def _numbered(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of documents in their order, and document and tie of each number."""
    order = np.lexsort((tie, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    number = np.empty(len(doc), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, doc[order][new], tie[order][new]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last start of the runs of windows that start next to each other."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]
    lead = np.flatnonzero(new)
    return doc[lead], start[lead], start[np.r_[lead[1:], len(doc)] - 1]


_PART = "key bigint, doc bigint, tie bigint, start int, last int, part binary"


def _parts_batch(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["key", "doc", "tie", "start", "last", "part"])


def _window_rows(held: dict[bytes, tuple[int, int, int]], later: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The earliest place of each window held, and the runs of later ones, which have no bytes."""
    if held:
        docs, ties, starts = zip(*held.values(), strict=True)
        yield _parts_batch([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "big", signed=True) for w in held], docs, ties, starts, starts, list(held))
    if later:
        doc, tie, start = np.array(later, np.int64).T
        number, docs, ties = _numbered(doc, tie)
        number, start, last = _runs(number, start)
        # These rows aren't compared again; any key spreads them.
        yield _parts_batch(_mix((docs[number] * 31 + start).view(np.uint64)).view(np.int64), docs[number], ties[number], start, last, [None] * len(start))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with places that go on: both halves of each context, with the hash of what they share;
    of hot seeds the single windows."""
    held: dict[bytes, tuple[int, int, int]] = {}
    later: list[tuple[int, int, int]] = []
    before = None
    for batch in batches:
        keys, docs, ties, starts, parts = [], [], [], [], []
        for i in range(batch.num_rows):
            doc, tie, t, marks = (batch.column(k)[i].as_py() for k in range(4))
            if (doc, tie) == before:  # a document stored twice
                continue
            before = doc, tie
            for m in marks:
                p, h = m["place"], m["h"]
                if m["hot"]:
                    for a in range(max(p - REACH, 0), min(p, len(t) - LENGTH) + 1):
                        w, at = t[a : a + LENGTH], (doc, tie, a)
                        first = held.setdefault(w, at)
                        if at < first:
                            held[w] = at
                        if at != first:
                            later.append(max(at, first))
                    if len(held) + len(later) >= HELD_WINDOWS:
                        yield from _window_rows(held, later)
                        held, later = {}, []
                    continue
                for a, b, c, d in ((p - HALF, p + LENGTH, p, p + LENGTH - HALF), (p - REACH, p + LENGTH - HALF, p - HALF, p + SEED)):
                    if c >= 0 and d <= len(t):  # else no window of this half fits into the text
                        a, b = max(a, 0), min(b, len(t))
                        if b - a >= LENGTH:
                            keys.append(int.from_bytes(hashlib.blake2b(t[c:d], digest_size=8, salt=(h & (1 << 64) - 1).to_bytes(8, "big")).digest(), "big", signed=True))
                            docs.append(doc)
                            ties.append(tie)
                            starts.append(a)
                            parts.append(t[a:b])
        yield _parts_batch(keys, docs, ties, starts, starts, parts)
    yield from _window_rows(held, later)


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """Positions in the order of keys under `most`; a sort of key and position in one number where they fit."""
    bits = len(keys).bit_length()
    if most < 1 << 62 - bits:
        return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1)
    return np.argsort(keys)


def _names(keys: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Order-preserving names from 1 of keys under `most`, and how many there are."""
    if most <= max(1 << 16, 2 * len(keys)):
        seen = np.zeros(most, np.int64)
        seen[keys] = 1
        np.cumsum(seen, out=seen)
        return seen[keys], int(seen[-1])
    order = _order(keys, most)
    new = np.ones(len(keys), np.int64)
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def suffix_ranks(t: np.ndarray) -> np.ndarray:
    """Rank (from 1) of each suffix of t, symbols from 1 up; the difference-cover algorithm with the cover
    {1, 2} modulo 3."""
    n = len(t)
    if n < 3:
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(1, n + 1)
        return out
    size = int(t.max()) + 1
    if size ** 3 >= 1 << 62:
        t, size = _names(t, size)
        size += 1
    x = np.concatenate([t, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    # Sort the sampled triples and name them; recurse on the names where some are equal.
    if size ** 3 < 1 << 62:
        triples = (x[sample] * size + x[np.minimum(sample + 1, n + 2)]) * size + x[np.minimum(sample + 2, n + 2)]
        names, kinds = _names(triples, size**3)
    else:
        head, heads = _names(x[sample] * size + x[np.minimum(sample + 1, n + 2)], size * size)
        names, kinds = _names(head * size + x[np.minimum(sample + 2, n + 2)], (heads + 1) * size)
    if kinds < len(sample):
        ranks = suffix_ranks(names)
    else:
        ranks = names
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = ranks
    by_rank = np.empty(len(sample), np.int64)
    by_rank[ranks - 1] = sample
    m = len(sample) + 2
    # The remaining suffixes: by first symbol and rank of the next; then merge by comparing with either kind.
    zero = np.arange(0, n, 3)
    k0 = x[zero] * m + rank[zero + 1]
    order = _order(k0, size * m)
    zero, k0 = zero[order], k0[order]
    s1, s2 = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    s1, s2 = s1[s1 < n], s2
    k1 = x[s1] * m + rank[s1 + 1]
    if size * size * m < 1 << 62:
        z2 = (x[zero] * size + x[zero + 1]) * m + rank[zero + 2]
        k2 = (x[s2] * size + x[s2 + 1]) * m + rank[np.minimum(s2 + 2, n + 2)]
    else:
        pair, _ = _names(np.concatenate([x[zero] * size + x[zero + 1], x[s2] * size + x[s2 + 1]]), size * size)
        z2 = pair[: len(zero)] * m + rank[zero + 2]
        k2 = pair[len(zero) :] * m + rank[np.minimum(s2 + 2, n + 2)]
    out = np.empty(n, np.int64)
    out[zero] = np.arange(len(zero)) + np.searchsorted(k1, k0) + np.searchsorted(k2, z2) + 1
    place1, place2 = np.searchsorted(k0, k1, side="right"), np.searchsorted(z2, k2, side="right")
    inner = np.zeros(n + 3, np.int64)
    live = by_rank[by_rank < n]
    inner[live] = np.arange(1, len(live) + 1)
    out[s1] = inner[s1] + place1
    out[s2] = inner[s2] + place2
    return out


def repeated_windows(docs: np.ndarray, starts: np.ndarray, parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every window of the fragments that equals an earlier one of them."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts) + bytes(length), np.uint8)
    used = np.cumsum(np.bincount(text, minlength=256) > 0)  # few bytes occur, so names of triples need no sort
    rank = suffix_ranks(used[text[: int(sizes.sum())]])
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(parts)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
    doc, start = docs[owner], starts[owner] + inside
    order = _order(rank[at], len(rank) + 1)
    at, doc, start = at[order], doc[order], start[order]
    same = np.zeros(len(at), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for a in range(1, len(at), 1 << 16):
        b = min(len(at), a + (1 << 16))
        same[a:b] = (view[at[a:b]] == view[at[a - 1 : b - 1]]).all(1)
    run = np.cumsum(~same)
    order = np.lexsort((start, doc, run))
    run, doc, start = run[order], doc[order], start[order]
    # The same window of the same document can come with two fragments; only what starts later goes.
    head = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(run) else np.zeros(0, np.int64)
    later = (doc != doc[first]) | (start != start[first])
    return doc[later], start[later]


def _contested_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From fragments sorted by key: runs of removed windows (doc, tie, from, to), block by block. Rows without bytes
    are such runs already."""

    def block(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(rows)
        keys = table["key"].to_numpy()
        alone = np.r_[True, keys[1:] != keys[:-1]] & np.r_[keys[1:] != keys[:-1], True]
        if alone.all():
            return
        table = table.filter(pa.array(~alone))
        keys, doc, tie, starts = (table[c].to_numpy().astype(np.int64) for c in ("key", "doc", "tie", "start"))
        parts = table["part"].to_pylist()
        docs, doc_of, tie_of = _numbered(doc, tie)
        # Equal fragments: all windows of the later ones go.
        order = np.lexsort((starts, docs, keys))
        first: dict[tuple[int, bytes], int] = {}
        ks = keys.tolist()
        lead = [first.setdefault((ks[i], parts[i]), i) for i in order.tolist()]
        lead_of = np.empty(len(keys), np.int64)
        lead_of[order] = lead
        copies = np.flatnonzero((docs != docs[lead_of]) | (starts != starts[lead_of]))
        windows = np.array([len(parts[i]) - LENGTH + 1 for i in copies.tolist()], np.int64)
        copied = np.repeat(docs[copies], windows), np.repeat(starts[copies] - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        # Only keys with several fragments are left to be sorted.
        heads = np.array(sorted(first.values()), np.int64)
        kinds, inverse, count = np.unique(keys[heads], return_inverse=True, return_counts=True)
        heads = heads[count[inverse] > 1]
        number, start = repeated_windows(docs[heads], starts[heads], [parts[i] for i in heads.tolist()]) if len(heads) else (docs[:0], starts[:0])
        number, start = np.r_[number, copied[0]], np.r_[start, copied[1]]
        if len(number):
            number, start, last = _runs(number, start)
            yield pa.RecordBatch.from_arrays([pa.array(doc_of[number]), pa.array(tie_of[number]), pa.array(start.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc", "tie", "start", "last"])

    rows, last_key, size = [], None, 0
    for batch in batches:
        if batch.column(5).null_count:
            yield batch.filter(batch.column(5).is_null()).select(["doc", "tie", "start", "last"])
            batch = batch.filter(batch.column(5).is_valid())
        if not batch.num_rows:
            continue
        table, k = pa.Table.from_batches([batch]), batch.column(0).to_numpy()
        ends = np.cumsum(np.array([len(x) for x in batch.column(5).to_pylist()]))
        at = 0
        for cut in np.flatnonzero(np.r_[k[0] != last_key, k[1:] != k[:-1]]).tolist():  # a block may end where a key ends
            if size + (ends[cut - 1] if cut else 0) - (ends[at - 1] if at else 0) >= BLOCK:
                if cut > at:
                    rows.append(table.slice(at, cut - at))
                if rows:
                    yield from block(rows)
                rows, size, at = [], 0, cut
        if at < len(k):
            rows.append(table.slice(at))
            size += int(ends[-1] - (ends[at - 1] if at else 0))
        last_key = k[-1]
    if rows:
        yield from block(rows)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes out the spans; those with bytes only where the text has these bytes (`failed`: how many have not)."""
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "failed", "kept")}
        for t, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs: list[list[int]] = []
            failed, held = 0, []
            for x in spans or ():
                start, stop, piece = x["start"], min(len(t), x["stop"]), x["piece"]
                if piece is not None and (len(piece) < LENGTH or t[start : start + len(piece)] != piece):
                    failed += 1
                else:
                    held.append((start, stop if piece is None else start + len(piece)))
            for s in sorted(held):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                elif s[1] > s[0]:
                    runs.append(list(s))
            kept, at = [], 0
            for a, b in runs:
                kept.append(t[at:a])
                at = b
            kept.append(t[at:])
            for k, v in zip(out, (len(t), sum(b - a for a, b in runs), len(runs), failed, b"".join(kept)), strict=True):
                out[k].append(v)
        numbers = [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans", "failed")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(out["kept"], pa.binary())], names=["doc", "tie", *out])


def _parts(base: DataFrame, met: DataFrame, block: int) -> DataFrame:
    """The fragments of contexts that go on; the bytes of those that share a key are no more than `block`."""
    marks = met.filter("h is not null")
    hot = marks.groupBy("h").count().filter(F.col("count") > block // (LENGTH + HALF)).select("h", F.lit(True).alias("hot"))
    marks = marks.join(hot, "h", "left").groupBy("doc", "tie").agg(F.collect_list(F.struct("place", "h", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("marks"))
    return base.join(marks, ["doc", "tie"]).select("doc", "tie", "bytes", "marks").mapInArrow(_fragments, _PART)


def hot_seeds(base: DataFrame, salt: int, bits: int, look: int, least: int, most: int) -> np.ndarray:
    """Hashes of seeds with at least `least` contexts in one of `look` documents. It only decides where rows meet: these
    seeds' contexts go on in any case, being several."""
    some = base.filter(F.pmod(F.xxhash64("doc", "tie"), F.lit(look)) == 0).mapInArrow(functools.partial(_seed_rows, salt=salt, bits=bits, hot=np.zeros(0, np.int64)), _ROWS)
    found = some.filter("kind = 0").select("h", "c").distinct().groupBy("h").count().filter(F.col("count") >= max(2, least))
    return np.array(sorted(r[0] for r in found.orderBy(F.desc("count"), "h").limit(most).collect()), np.int64)


@scratch
def _attempt(docs: DataFrame, salt: int, bits: int, block: int, kept: Callable[[], Column]) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, failed, kept of every document, materialized."""
    # 63 bits of the text's hash, under 0 where there is no doc_id.
    tie = F.shiftrightunsigned(F.xxhash64("bytes"), 1)
    base = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_or_empty().cast("binary").alias("bytes"))
    base = base.select(F.coalesce("id", F.lit(_NO_ID)).alias("doc"), F.when(F.col("id").isNull(), -tie - 1).otherwise(tie).alias("tie"), "bytes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = base.mapInArrow(functools.partial(_seed_rows, salt=salt, bits=bits, hot=hot_seeds(base, salt, bits, LOOK, HOT, HOT_SEEDS)), _ROWS)
    dealt = rows.repartition(n, F.when(F.col("kind") == 2, F.xxhash64("h", "c")).otherwise(F.col("h")))
    met = materialize(dealt.sortWithinPartitions("h", "c", "doc", "tie", "place").mapInArrow(_met, _MET), "suffix-met")
    links = met.filter("h is null").drop("h").repartition(n, "doc", "tie").sortWithinPartitions("doc", "tie", "s_doc", "s_tie", F.col("place") - F.col("s_place"), "place")
    runs = links.mapInArrow(_run_rows, "doc bigint, tie bigint, start int, s_doc bigint, s_tie bigint, s_start int, size int")
    asked = runs.groupBy(F.col("s_doc").alias("doc"), F.col("s_tie").alias("tie")).agg(F.collect_list(F.struct("doc", "tie", "start", "s_start", "size")).alias("runs"))
    claims = base.join(asked, ["doc", "tie"]).select("doc", "tie", "bytes", "runs").mapInArrow(_claims, "doc bigint, tie bigint, start int, piece binary")
    windows = _parts(base, met, block).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_contested_windows, "doc bigint, tie bigint, start int, last int")
    spans = windows.select("doc", "tie", "start", (F.col("last") + LENGTH).alias("stop"), F.lit(None).cast("binary").alias("piece"))
    spans = spans.unionByName(claims.select("doc", "tie", "start", F.col("start").alias("stop"), "piece"))
    spans = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop", "piece")).alias("spans"))
    out = base.join(spans, ["doc", "tie"], "left").select("doc", "tie", "bytes", "spans")
    out = out.mapInArrow(_kept, "doc bigint, tie bigint, n_bytes bigint, n_removed bigint, n_spans bigint, failed bigint, kept binary")
    known = (F.col("doc") != _NO_ID) | (F.col("tie") >= 0)
    return materialize(out.select(F.when(known, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "failed", kept().alias("kept")), "suffix-kept")


def remove_repeats(docs: DataFrame, block: int = BLOCK, bits: tuple[int, ...] = (64,), kept: Callable[[], Column] = lambda: F.col("kept")) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, or what `kept` makes of them) of every document.
    bits: those of the hashes in each attempt, the last for all further ones."""
    ship(docs.sparkSession)
    for salt in itertools.count():
        out = _attempt(docs, salt, bits[min(salt, len(bits) - 1)], block, kept)
        if out.filter("failed > 0").isEmpty():
            return out.drop("failed")


def report_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(docs, kept=lambda: F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")
