"""MinHash near-dedup with BagMinHash signatures of weighted (multiset) Jaccard similarity.

A text is the multiset of its five-word shingles. BagMinHash (Ertl 2018): every shingle owns one Poisson process
over [0, infinity) of weights, cut into the dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; an interval's
points come in order of time at a rate of its length. A point goes down the halves of its interval by the bits of a
hash of its own, one bit a level; points above the shingle's count are then rejected, which at most doubles the
points of the last interval. A point falls into one register; a register keeps its first point. Two texts agree in
a register with probability sum(min) / sum(max) of their counts. Points past a text's time limit can't be first once
all registers are filled, so only those before it are drawn; where a register stays empty the limit doubles.

BANDS bands of ROWS registers make candidates (a pair of similarity 0.8 is missed with probability 7e-6). Exact
copies meet by a digest first, so a group of them is one row of each task. Then come rounds that compare only
texts of different components, since more links inside one change nothing: in each bucket the texts outside
its largest component are compared with one member of that component, at first for some bands only, and in
later rounds with about 4, 16, ... members, others in each bucket. So a large group of near copies costs some
comparisons for each text. Once what is left outside is small (or ROUNDS are over), it is compared with all
texts of other components in its buckets. Pairs whose sizes or whose sketches exclude a similarity of 0.8 are left
out before: one bit of each of SKETCH registers, in the last round of FINE more registers of the texts that are
left; the bounds are 4.5 standard deviations away. The comparison is of whole multisets. Components are found
by minimum labels and pointer jumping.

A text is known by 128 bits of its sha256, so a doc_id may have several texts and a text several doc_ids. Texts are
numbered in the order of their least doc_id (null first), then digest; all steps above work on these numbers.

Defined cases: null texts are empty; a text of 1 to 4 words is one shingle; a text without words is linked to
nothing but its exact copies; the class id is the least doc_id of its first text, null if that has none, and
class_text (that text's digest) tells classes apart whose first texts share a doc_id; rows that repeat doc_id and
text get the same result, and drop_near_duplicates keeps one of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, scratch, ship, text_or_empty

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Registers whose lowest bit makes the sketch, and how many of them may differ.
SKETCH, SKETCH_MOST = 128, 28
#: The same for the last round's sketch.
FINE, FINE_MOST = 2048, 265
#: Bands of the first round, most rounds, and the pairs for each row of a shared bucket that the last one may look at.
FIRST_BANDS, ROUNDS, LAST_PAIRS = 4, 5, 256
#: Hash values by which texts that nobody asks for are left out before a shuffle: the bound of what is broadcast.
ASKED_BITS = 20
BATCH = 1 << 18
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    p = _powers.get(name)
    if p is None or len(p) < n:
        size = max(n, BATCH * 2)
        p = _powers[name] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
    return p[:n]


def shingle_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of the distinct shingles of some texts, sorted by both."""
    sizes = np.array([len(t) + 1 for t in texts])
    x = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[x]
    # A word starts after white space and ends before it; texts are set apart by a space.
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * _power("base", _BASE, len(x)), dtype=np.uint64)])
    word = _mix((sums[end] - sums[start]) * _power("back", _BACK, len(x))[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    per = np.bincount(owner, minlength=len(texts))
    head = np.cumsum(per) - per
    inside = np.arange(len(word)) - np.repeat(head, per)
    full = inside <= np.repeat(per, per) - SHINGLE
    short = (inside == 0) & (np.repeat(per, per) < SHINGLE)
    at = np.flatnonzero(full | short)
    padded = np.r_[word, np.zeros(SHINGLE, np.uint64)]
    length = np.repeat(per, per)[at]
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        h += np.where(length > k, padded[at + k], np.uint64(0)) * _PLACE[k]
    h, doc = _mix(h), owner[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    return doc[lead], h[lead], np.diff(np.r_[lead, len(h)])


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """For each text and register the hash of the first point (0 in texts without shingles)."""
    out = np.zeros((texts, registers), np.uint64)
    total = np.bincount(doc, count, texts)
    limit = np.where(total > 0, registers * (np.log(registers) + 3) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        first = np.full((texts, registers), np.inf)
        ident = np.zeros((texts, registers), np.uint64)
        mine = todo[doc]
        d, h, w = doc[mine], shingle[mine], count[mine]
        # Interval 0 is [0, 1), interval j is [2 ** (j - 1), 2 ** j); a count reaches as many as it has bits, of count - 1, and one.
        parts = [(d, h, w, np.zeros(len(d), np.int64))]
        j = 1
        while (more := w > 1 << (j - 1)).any():
            parts.append((d[more], h[more], w[more], np.full(int(more.sum()), j)))
            j += 1
        d, h, w, j = (np.concatenate(v) for v in zip(*parts, strict=True))
        low = np.where(j > 0, 1 << np.maximum(j - 1, 0), 0)
        span, levels = np.where(j > 0, low, 1), np.maximum(j - 1, 0).astype(np.uint64)
        h = _mix(h + _mix(j.astype(np.uint64) + np.uint64(1)))
        t, k = np.zeros(len(d)), 0
        while len(d):
            k += 1
            p = _mix(h + np.uint64(k * int(_BASE) & (1 << 64) - 1))
            t = t - np.log(((p >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
            live = t <= limit[d]
            d, h, w, low, span, levels, t, p = d[live], h[live], w[live], low[live], span[live], levels[live], t[live], p[live]
            q = _mix(p)
            # Its highest bit chooses the half of the interval, the next one the quarter, ...: as many as the interval has levels.
            inside = np.ones(len(d), bool)
            wide = np.flatnonzero(span > 1)
            halves = _mix(q[wide] ^ _BASE) >> (np.uint64(64) - levels[wide])
            inside[wide] = low[wide] + halves.astype(np.int64) < w[wide]
            register = ((q & np.uint64((1 << 32) - 1)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            cell = (d * registers + register)[inside]
            np.minimum.at(first.reshape(-1), cell, t[inside])
            won = first.reshape(-1)[cell] == t[inside]
            ident.reshape(-1)[cell[won]] = q[inside][won]
        filled = np.isfinite(first).all(1)
        done = todo & filled
        out[done] = ident[done]
        todo &= ~filled
        limit = np.where(todo, limit * 2, limit)
    return out


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, size, at, n = [], 0, 0, batch.num_rows
        for i in range(n):
            t = batch.column(2)[i].as_py()
            texts.append(t)
            size += len(t)
            if size >= BATCH or i == n - 1:
                doc, shingle, count = shingle_counts(texts)
                sig = signatures(doc, shingle, count, len(texts))
                keys = np.zeros((len(texts), BANDS), np.uint64)
                for b in range(BANDS):
                    h = np.full(len(texts), b + 1, np.uint64)
                    for r in range(ROWS):
                        h = _mix(h * _BASE + sig[:, b * ROWS + r])
                    keys[:, b] = h
                low = np.packbits((sig[:, :SKETCH] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                total = np.bincount(doc, count, len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(1).slice(at, len(texts)),
                        pa.array(total),
                        pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                        pa.array(low[:, 0]),
                        pa.array(low[:, 1]),
                    ],
                    names=["doc", "digest", "weight", "bands", "s0", "s1"],
                )
                texts, size, at = [], 0, i + 1


def _fine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tid and the sketch of FINE registers, as longs."""
    for batch in batches:
        ids, texts, size, n = [], [], 0, batch.num_rows
        for i in range(n):
            t = batch.column(1)[i].as_py()
            ids.append(batch.column(0)[i].as_py())
            texts.append(t)
            size += len(t)
            if size >= BATCH or len(texts) >= 128 or i == n - 1:
                doc, shingle, count = shingle_counts(texts)
                sig = signatures(doc, shingle, count, len(texts), FINE)
                low = np.packbits((sig & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(low), pa.list_(pa.int64()))], names=["tid", "fine"])
                ids, texts, size = [], [], 0


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, given as sorted hashes and counts."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def bag(doc: int, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        v = known.get(doc)
        if v is None:
            v = shingle_counts([text])[1:]
            if len(v[0]) <= 100_000:
                known[doc] = v
                if len(known) > 256:
                    known.popitem(last=False)
        return v

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [overlap(bag(x, batch.column(2)[i].as_py()), bag(y, batch.column(3)[i].as_py())) for i, (x, y) in enumerate(zip(a, b, strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def _verified(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Those of distinct candidate pairs (a, b), at most so many, that are similar enough."""
    both = materialize(pairs, "bag-pairs", most).join(texts.select(F.col("tid").alias("a"), F.col("bytes").alias("ta")), "a").join(texts.select(F.col("tid").alias("b"), F.col("bytes").alias("tb")), "b")
    compared = both.select("a", "b", "ta", "tb").mapInArrow(_compared, "a bigint, b bigint, similarity double")
    return materialize(compared.filter(F.col("similarity") >= SIMILARITY).select("a", "b"), "bag-links")


@scratch
def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """tid, comp (the least tid of its component) of all ends of the edges (a, b), at most so many. In each step a tid takes the least of
    its own label, its neighbours' labels and its label's label, until nothing changes."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u != v").distinct(), "bag-edges", most and 2 * most)
    most = both.count()
    labels = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("comp")).select(F.col("u").alias("tid"), F.lit(True).alias("moved"), "comp"), "bag-labels", most)
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("tid").alias("v"), F.col("comp").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        further = labels.select(F.col("tid").alias("of"), F.col("comp").alias("further"))
        step = labels.join(near, labels["tid"] == near["u"]).join(further, F.col("comp") == F.col("of")).select("tid", F.col("comp").alias("was"), F.least("comp", "near", "further").alias("comp"))
        labels = materialize(step.select("tid", (F.col("comp") != F.col("was")).alias("moved"), "comp"), "bag-labels", most)
    out = labels.select("tid", "comp")
    out._table_path = labels._table_path
    return out


def _merged(comps: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """comps (tid, comp), of at most so many rows, after these links between their tids: components of components."""
    at = lambda end: comps.select(F.col("tid").alias(end), F.col("comp").alias(f"{end}_comp"))
    found = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")), links.count())
    new = found.select(F.col("tid").alias("comp"), F.col("comp").alias("new"))
    return materialize(comps.join(new, "comp", "left").select("tid", F.coalesce("new", "comp").alias("comp")), "bag-comps", most)


def _may_match(a: str, b: str) -> Column:
    """False if weights or sketches of two sides (column prefixes) exclude the similarity."""
    c = lambda side, name: F.col(f"{side}{name}")
    sizes = F.least(c(a, "weight"), c(b, "weight")) >= F.lit(SIMILARITY) * F.greatest(c(a, "weight"), c(b, "weight"))
    return sizes & (F.bit_count(c(a, "s0").bitwiseXOR(c(b, "s0"))) + F.bit_count(c(a, "s1").bitwiseXOR(c(b, "s1"))) <= SKETCH_MOST)


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _shared_rows(texts: DataFrame) -> DataFrame:
    """tid, weight, s0, s1, band, key of the texts in buckets of at least two."""
    rows = texts.filter("weight > 0").select("tid", F.posexplode("bands").alias("band", "key"))
    keys = materialize(rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"), "bag-keys", texts.count() * BANDS)
    shared = materialize(rows.join(keys, "key"), "bag-shared")
    return materialize(shared.join(texts.select("tid", "weight", "s0", "s1"), "tid"), "bag-rows")


def _asked(base: DataFrame, ids: DataFrame) -> DataFrame:
    """tid, bytes of the texts of ids (tid, doc, digest), from the rows of base that have their doc and digest. Rows whose
    hash none of the ids has go before the shuffle: at most 2 ** ASKED_BITS hash values are broadcast, whatever the
    number of ids."""
    at = lambda: F.pmod(F.xxhash64("doc", "digest"), F.lit(1 << ASKED_BITS)).cast("int")
    seen = materialize(ids.select(at().alias("_at")).distinct(), "bag-hashes", 1 << ASKED_BITS)
    near = base.withColumn("_at", at()).join(F.broadcast(seen), "_at", "left_semi").drop("_at")
    wanted = ids.select("tid", F.col("doc").alias("_doc"), F.col("digest").alias("_digest"))
    met = near.join(wanted, near["doc"].eqNullSafe(wanted["_doc"]) & (near["digest"] == wanted["_digest"])).select("tid", "bytes").dropDuplicates(["tid"])
    return materialize(met, "bag-asked")


def _open_buckets(rows: DataFrame, turn: int, most: int) -> DataFrame:
    """key, n, h_n, h_comp and h_ columns of the buckets with several components: the size of the bucket and of its
    largest component there, and one member of that. There are at most so many rows."""
    one = F.min(F.struct(F.xxhash64("tid", "key", F.lit(turn)).alias("o"), "tid", "weight", "s0", "s1"))
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("_c"), one.alias("_one"))
    out = per.groupBy("key").agg(F.sum("_c").alias("n"), F.max(F.struct("_c", "comp", "_one")).alias("h"), F.count("*").alias("_comps")).filter("_comps > 1")
    return materialize(out.select("key", "n", F.col("h._c").alias("h_n"), F.col("h.comp").alias("h_comp"), *[F.col(f"h._one.{c}").alias(f"h_{c}") for c in ("tid", "weight", "s0", "s1")]), "bag-open", most)


def _star_pairs(rows: DataFrame, buckets: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs of texts outside their bucket's largest component with one member of it, or from turn 2 on
    with about 4 ** (turn - 1) members."""
    if turn < 2:
        heads = buckets.drop("n", "h_n")
    else:
        step = F.greatest(F.expr(f"h_n div {4 ** (turn - 1)}"), F.lit(1))
        met = rows.join(buckets.select(F.col("key").alias("h_key"), "h_n", "h_comp"), (F.col("key") == F.col("h_key")) & (F.col("comp") == F.col("h_comp")) & (F.pmod(F.xxhash64("tid", "key", F.lit(turn)), step) == 0))
        heads = materialize(met.select("key", "h_comp", *[F.col(c).alias(f"h_{c}") for c in ("tid", "weight", "s0", "s1")]), "bag-heads")
    met = rows.join(heads.withColumnRenamed("key", "h_key"), (F.col("key") == F.col("h_key")) & (F.col("comp") != F.col("h_comp")) & _may_match("", "h_"))
    return met.select(F.least("h_tid", "tid").alias("a"), F.greatest("h_tid", "tid").alias("b")).distinct()


def _last_pairs(rows: DataFrame, buckets: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs between texts outside their bucket's largest component and those of other components."""
    at = buckets.select(F.col("key").alias("x_key"), "h_comp")
    held = rows.join(at, F.col("key") == F.col("x_key")).drop("x_key")
    held = materialize(held, "bag-held-rows")
    # Only texts still held have finer sketches. Python looks at them, so they are dealt out by a hash, in as many tasks as
    # there are shuffle partitions, however few bytes they have.
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.join(held.select("tid").distinct(), "tid", "left_semi").repartition(n, F.xxhash64("tid"))
    fine = dealt.select("tid", "bytes").mapInArrow(_fine_rows, "tid bigint, fine array<bigint>")
    held = materialize(held.join(fine, "tid").join(texts.select("tid", "bands"), "tid"), "bag-held")
    out = materialize(held.filter("comp != h_comp").select(F.col("key").alias("x_key"), *[F.col(c).alias(f"x_{c}") for c in ("tid", "weight", "s0", "s1", "comp", "fine", "bands")]), "bag-outside")
    asks = (F.col("comp") != F.col("x_comp")) & ((F.col("comp") == F.col("h_comp")) | (F.col("tid") < F.col("x_tid"))) & _may_match("", "x_")
    differ = F.expr(" + ".join(f"bit_count(fine[{i}] ^ x_fine[{i}])" for i in range(FINE // 64)))
    # Of all buckets that two texts of different components share, and in each of which one of them asks, the first counts.
    earlier = F.expr(" + ".join(f"if(band > {i} and bands[{i}] = x_bands[{i}], 1, 0)" for i in range(BANDS)))
    return held.join(out, (F.col("key") == F.col("x_key")) & asks & (differ <= FINE_MOST) & (earlier == 0)).select(F.least("tid", "x_tid").alias("a"), F.greatest("tid", "x_tid").alias("b")).distinct()


@scratch
def _classes(docs: DataFrame) -> DataFrame:
    """doc, digest, text_doc (the least of the text's docs), class_doc and class_digest (of its class's first text) of
    every row of docs."""
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc"), text_or_empty().cast("binary").alias("bytes")).select("doc", _digest(F.col("bytes")).alias("digest"), "bytes")
    signed = materialize(base.mapInArrow(_signed_rows, "doc bigint, digest binary, weight bigint, bands array<bigint>, s0 bigint, s1 bigint"), "bag-signed")
    least = F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc")).alias("who")
    texts = signed.groupBy("digest").agg(least, F.first(F.struct("weight", "bands", "s0", "s1")).alias("v"))
    numbered = texts.repartitionByRange(n, "who", "digest").sortWithinPartitions("who", "digest").withColumn("tid", F.monotonically_increasing_id())
    texts = materialize(numbered.select("tid", F.col("who.doc").alias("doc"), "digest", "v.*"), "bag-texts")
    rows = _shared_rows(texts)
    size, turn = rows.count(), 0
    comps = materialize(rows.select("tid").distinct().withColumn("comp", F.col("tid")), "bag-comps", size)
    asked = _asked(base, texts.select("tid", "doc", "digest").join(comps, "tid", "left_semi"))
    while size:
        placed = rows.join(comps, "tid")
        buckets = _open_buckets(placed.filter(F.col("band") < FIRST_BANDS) if turn == 0 else placed, turn, size)
        left = buckets.agg(F.sum((F.col("n") - F.col("h_n")) * F.col("n"))).first()[0] or 0
        if not left and turn:
            break
        last = turn > 1 and (left <= LAST_PAIRS * size or turn >= ROUNDS)
        pairs = _last_pairs(placed, buckets, asked, texts) if last else _star_pairs(placed, buckets, turn)
        more = _verified(pairs, asked, max(left, size))
        if not more.isEmpty():
            comps = _merged(comps, more, size)
        if last:
            break
        turn += 1
    heads = comps.filter("comp != tid").join(texts.select(F.col("tid").alias("comp"), F.struct("doc", "digest").alias("head")), "comp").select("tid", "head")
    known = texts.select("tid", "digest", "doc").join(heads, "tid", "left").withColumn("head", F.coalesce("head", F.struct("doc", "digest")))
    known = materialize(known.select("digest", F.col("doc").alias("text_doc"), F.col("head.doc").alias("class_doc"), F.col("head.digest").alias("class_digest")), "bag-classes")
    return materialize(signed.select("doc", "digest").join(known, "digest").select("doc", "digest", "text_doc", "class_doc", "class_digest"), "bag-rows-classes")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, text_id (least doc_id of its exact copies) and class_text (digest of the class's first text)."""
    return _classes(docs).select(F.col("doc").alias("doc_id"), F.col("class_doc").alias("class_id"), F.col("text_doc").alias("text_id"), F.lower(F.hex("class_digest")).alias("class_text"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first text of each class, once, with the columns of docs. Of rows that repeat its doc_id and text the one of
    least hash stays."""
    first = F.col("doc").eqNullSafe(F.col("class_doc")) & (F.col("digest") == F.col("class_digest"))
    marks = _classes(docs).groupBy("doc", "digest").agg(F.bool_and(first).alias("first"), F.count("*").alias("n")).filter("not first or n > 1")
    marks = materialize(marks.select(F.col("doc").alias("_m_doc"), F.col("digest").alias("_m_digest"), F.col("first").alias("_m_first")), "bag-marks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), _digest(text_or_empty().cast("binary")).alias("_digest"))
    on = F.col("_doc").eqNullSafe(F.col("_m_doc")) & (F.col("_digest") == F.col("_m_digest"))
    kept = rows.join(marks, on, "left_anti").select("_row")
    again = marks.filter("_m_first")
    if not again.isEmpty():
        one = rows.join(again, on).groupBy("_doc", "_digest").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        kept = kept.unionByName(one.select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
