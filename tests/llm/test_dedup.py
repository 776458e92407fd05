"""Near dedup, repeated strings and line chunks against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import bagminhash as bag
from quantloom.llm import linededup, suffix


def multiset(text):
    w = (text or "").encode().split()
    return collections.Counter([b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [b" ".join(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_are_unbiased():
    r, z = random.Random(5), []
    for _ in range(40):
        a = collections.Counter({r.randint(1, 10**9): r.choice([1, 1, 1, 2, 3, 5, 17, 300]) for _ in range(r.choice([3, 20, 100]))})
        b = collections.Counter(a)
        for k in list(b):
            if r.random() < 0.2:
                b[k] = r.choice([1, 2, 4, 100])
        arrays = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        doc = np.repeat([0, 1], [len(x[0]) for x in arrays])
        s = bag.signatures(doc, np.concatenate([x[0] for x in arrays]), np.concatenate([x[1] for x in arrays]), 2, 1000)
        j = similarity(a, b)
        assert abs(bag.overlap(*arrays) - j) < 1e-12
        z.append(((s[0] == s[1]).mean() - j) / max(1e-9, (j * (1 - j) / 1000) ** 0.5) if j < 1 else 0)
    assert abs(np.mean(z)) < 0.6 and 0.6 < np.std(z) < 1.5 and max(map(abs, z)) < 4.5


def classes(rows):
    """Components of all pairs of similarity 0.8, and of equal texts."""
    ids = [i for i, _ in rows]
    bags, parent = [multiset(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 62), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(rows))}


def mutated(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    r, rows = random.Random(2), []
    for g in range(12):
        base = [f"v{r.randrange(3000)}" for _ in range(r.choice([30, 120, 300]))]
        rows += [mutated(r, base, r.choice([0, 1, 2, 3, 6])) for _ in range(8)]
    hub = [f"h{k}" for k in range(200)]  # a star: copies are near the hub, less so among themselves
    rows += [mutated(r, hub, 4) for _ in range(60)] + [" ".join(hub)]
    rows += ["", None, "a", "a", "a b c d", "a b c d", "a b c d e", " a  b c d ", "x " * 900, "x " * 880, "x " * 300, "x y " * 400]
    return list(enumerate(rows))


def test_near_duplicates(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as class_id", "'x' as comp", "'y' as key", "2 as _gone").repartition(5)
    got = {r.doc_id: r.class_id for r in bag.near_duplicate_classes(df).collect()}
    assert got == classes(rows)
    kept = bag.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "other words here")]])
def test_near_duplicates_nulls_and_repeats(spark, rows):
    got = bag.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    if rows:
        assert {(r.doc_id, r.class_id) for r in got} == {(None, None), (3, None), (5, 5)}


def test_near_duplicates_of_shared_doc_ids(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    near_b = b + "more"
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (6, near_b, 3), (7, c, 4), (7, c, 5), (None, "p q r s t u", 6), (None, "other words are here now", 7), (-(1 << 63), near_b + " yet", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k int")
    got = bag.near_duplicate_classes(df).collect()
    groups = collections.Counter((r.class_id, r.class_text) for r in got)
    assert len(got) == len(rows) and sorted(groups.values()) == [1, 1, 2, 2, 3]
    kept = [(r.doc_id, r.text) for r in bag.drop_near_duplicates(df).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (-(1 << 63), near_b + " yet"), (7, c), (None, "p q r s t u"), (None, "other words are here now")]))
    again = [r.k for r in bag.drop_near_duplicates(df.repartition(3)).collect()]
    assert sorted(again) == sorted(r.k for r in bag.drop_near_duplicates(df).collect())


def test_counts_beyond_a_float(spark):
    """Signatures of huge counts: the share of agreeing registers follows the weights, not their low bits."""
    doc, h = np.array([0, 0, 1, 1]), np.array([5, 9, 5, 9], np.uint64)
    s = bag.signatures(doc, h, np.array([1 << 40, 1 << 39, 1 << 39, 1 << 39]), 2, 512)
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.09


def test_near_duplicate_recall(spark, sf):
    """Every text of sf0.001 against all others, brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in bag.near_duplicate_classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == classes(rows)


def test_suffix_ranks():
    r = random.Random(3)
    for _ in range(300):
        t = [r.randint(1, r.choice([1, 2, 3, 30])) for _ in range(r.randint(1, 60))]
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert [suffix.suffix_ranks(np.array(t)).tolist()[i] for i in order] == list(range(1, len(t) + 1))


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: -(1 << 63) if x[0] is None else x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def repeat_rows():
    r = random.Random(4)
    base = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(400))
    rows = [(i, base[r.randint(0, 500) :][: r.randint(0, 1200)] + r.choice(["", "x", "zz" * 60, base[100:230]]) + "".join(r.choices("ab ", k=r.randint(0, 300)))) for i in range(60)]
    return rows + [(100, "a" * 1000), (101, "ab" * 400), (102, None), (103, ""), (104, "a" * 99), (105, "a" * 100), (106, "a" * 101), (None, base), (107, base + base), (108, "ä" * 200)]


def test_repeated_strings(spark):
    rows = repeat_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as doc", "2 as n_bytes").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.report_documents(df).collect()}
    assert got == removed(rows)
    assert suffix.report_documents(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "b" * 90 + "c" * 60)] * 2, "doc_id bigint, text string")
    assert [r.n_removed for r in suffix.report_documents(twice).collect()] == [0, 0]  # one document, stored twice


def test_repeated_strings_of_shared_doc_ids(spark):
    r = random.Random(21)
    a, b, c = ("".join(r.choices("abcdefgh ", k=359)) for _ in range(3))
    df = spark.createDataFrame([(2, a), (2, b), (1, a), (None, c), (None, b + "x"), (None, c), (-(1 << 63), c)], "doc_id bigint, text string")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in suffix.report_documents(df).collect())
    assert got == sorted([("2", 359, 359), ("2", 359, 359), ("1", 359, 0), ("None", 359, 0), ("None", 359, 0), ("None", 360, 0), (str(-(1 << 63)), 359, 359)])


def test_seeds_do_not_depend_on_batches():
    r = random.Random(22)
    texts = ["".join(r.choices("ab ", k=r.choice([100, 3000, 70_000]))).encode() for _ in range(12)] + [b"ab" * 40_000]
    for bits in (64, 9):
        owner, place, h, c = suffix.seeds(texts, 3, bits)
        for k, t in enumerate(texts):
            alone = suffix.seeds([t], 3, bits)
            assert all((x[owner == k] == y).all() for x, y in zip((place, h, c), alone[1:], strict=True))


def test_repeated_strings_with_colliding_hashes(spark):
    """Hashes of 10 bits link places of other bytes; these are found by comparing, and another attempt is made."""
    rows = [x for x in repeat_rows() if x[0] is not None][::4]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    first = suffix._attempt(df, 0, 10, suffix.BLOCK, lambda: F.col("kept")).collect()
    assert sum(x.failed for x in first) > 0
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in suffix.remove_repeats(df, bits=(10, 64)).collect()}
    assert got == removed(rows)


def test_repeated_strings_of_hot_seeds(spark, monkeypatch):
    """A passage under LENGTH bytes in all documents, and a long text: seeds are dealt out by context, results are the same."""
    r = random.Random(23)
    passage = "".join(r.choices("abcdefgh ", k=90))
    own = lambda k: "".join(r.choices("ijklmnopqrstuvwxyz ", k=k))
    rows = [(i, own(80) + passage + own(80)) for i in range(1500)] + [(9000, own(70_000) + passage + own(40)), (9001, passage * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(suffix, "LOOK", 8)
    base = df.selectExpr("doc_id as doc", "0L as tie", "cast(text as binary) as bytes")
    suffix.ship(spark)
    assert len(suffix.hot_seeds(base, 0, 64, 8, suffix.HOT, 10)) > 0
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.report_documents(df).collect()}
    assert got == removed(rows)


def test_repeated_strings_in_small_blocks(spark, monkeypatch):
    import quantloom.llm.suffix as module

    rows = [(i, t) for i, t in repeat_rows() if i is not None][:30]
    parts = [(t or "").encode() for _, t in rows if len(t or "") >= 100]
    doc, start = module.repeated_windows(np.arange(len(parts)), np.zeros(len(parts), np.int64), parts)
    seen, want = set(), set()
    for d, p in enumerate(parts):
        for k in range(len(p) - 99):
            if p[k : k + 100] in seen:
                want.add((d, k))
            seen.add(p[k : k + 100])
    assert set(zip(doc.tolist(), start.tolist(), strict=True)) == want


def test_repeated_strings_of_hot_keys(spark, monkeypatch):
    """One passage with other text before and after it in each document: no key has more bytes than an array may hold."""
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh ", k=300))
    rows = [(i, "".join(r.choices("ijklmnop ", k=r.randrange(60, 200))) + passage[r.choice([0, 0, 7]) :] + "".join(r.choices("qrstuv ", k=r.randrange(150)))) for i in range(120)]
    sizes, parts = [], suffix._parts

    def watched(*args):
        out = parts(*args)
        sizes.append(out.groupBy("key").agg(F.sum(F.length("part")).alias("n")).agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(suffix, "_parts", watched)
    df = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string").repartition(6)
    for block in (4000, suffix.BLOCK):  # hot keys, and none
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in suffix.remove_repeats(df, block).collect()}
        assert got == removed(rows)
    assert sizes[0] <= 4000 < sizes[1]


def line_chunks(text):
    lines, out, h0, cur = text.split("\n"), [], 0, []
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
        cur.append(line)
        if (h * 31 + h0) % linededup.MODULUS == 0 or i == len(lines) - 1:
            out.append(cur)
            cur = []
        h0 = h
    return out


def without_passages(rows):
    """Plain version of dedup_lines over (doc_id, text), and how many lines go."""
    first, places, out, total = {}, [], {}, 0
    rows = sorted(rows, key=lambda x: -1 if x[0] is None else x[0])
    for i, t in rows:
        if t is None:
            continue
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        spans, k = set(zip(at, at[1:], strict=False)), 0
        for c in line_chunks(t):
            if sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in c) >= 2:
                spans.add((k, k + len(c) - 1))
            k += len(c)
        for a, b in sorted(spans):
            first.setdefault("\n".join(lines[a : b + 1]), (i, b))
            places.append((i, a, b, "\n".join(lines[a : b + 1])))
    gone = collections.defaultdict(set)
    for i, a, b, chunk in places:
        doc, end = first[chunk]
        if doc != i or a > end:
            gone[i] |= set(range(a, b + 1))
    for i, t in rows:
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        total += len(gone[i])
    return out, total


def test_line_chunks(spark):
    r = random.Random(5)
    pool = [f"line {k} of the pool" for k in range(60)]
    rows = [(i, "\n".join(pool[(a := r.randrange(50)) : a + r.randrange(12)] + [f"own {r.random()}" for _ in range(r.randrange(3))] + pool[:7] * r.randrange(2))) for i in range(40)]
    rows += [(50, ""), (51, None), (52, "\n\n\n"), (53, "same\n" * 40), (54, "same\n" * 40), (None, "\n".join(pool)), (55, "x " * 50_000 + "\n" + "y\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'keep' as _lines", "7 as other", "'x' as n_lines", "1 as _gone").repartition(5)
    got = {x.doc_id: x for x in linededup.dedup_lines(df, report=True).collect()}
    want, gone = without_passages(rows)
    assert {i: x.text for i, x in got.items()} == want
    assert sum(x.n_removed_lines for x in got.values()) == gone > 20 and got[51].n_lines == 0
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\ng")] * 2, "doc_id bigint, text string")
    assert [x.n_removed_lines for x in linededup.dedup_lines(twice, report=True).collect()] == [0, 0]
    plain = linededup.dedup_lines(df)
    assert plain.columns == df.columns and plain.filter((F.col("other") == 7) & (F.col("n_lines") == "x")).count() == len(rows)


def test_line_chunks_of_shared_doc_ids(spark):
    rows = [(2, "a\nb\nown"), (2, "c\nd"), (1, "a\nb"), (None, "c\nd\ne"), (None, "f\ng")]
    got = {(x.doc_id, x.text) for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(2, "own"), (2, ""), (1, "a\nb"), (None, "c\nd\ne"), (None, "f\ng")}


def passage_rows():
    r = random.Random(9)
    passages = [[f"line {k} of passage {p}" for k in range(n)] for p, n in enumerate([2, 2, 3, 4, 5, 7, 10])]
    passages.append(["a", "", "b", " ", "c"])
    rows = [(i, "\n".join([f"own {r.random()}" for _ in range(r.randrange(1, 5))] + r.choice(passages) + [f"own {r.random()}"])) for i in range(80)]
    return rows + [(90, ""), (91, None), (92, "\n\n\n"), (93, "same\n" * 40), (94, "one line"), (95, "one line"), (None, "\n".join(passages[4]))]


def test_passages_in_other_text(spark):
    import corpus_pipeline as cp

    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'keep' as _lines", "7 as _gone", "length(text) as n_chars").repartition(5)
    got = cp.dedup_lines(spark, df, "")
    want, gone = without_passages(rows)
    assert got.columns == df.columns and {x.doc_id: x.text for x in got.collect()} == want
    assert gone > 200 and not any(x.n_chars != len(x.text or "") for x in got.collect() if x.text)
    assert cp.dedup_lines(spark, df.limit(0), "").count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc")] * 2, "doc_id bigint, text string")
    assert [x.text for x in linededup.dedup_lines(twice).collect()] == ["a\nb\nc"] * 2
