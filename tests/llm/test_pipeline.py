"""The pipeline's rows against plain versions of its stages."""

import collections
import hashlib
import re

from test_dedup import classes, without_passages
from test_select import waterfill

from quantloom.llm import mixing, piece_bpe
from quantloom.llm._common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(rows):
    """(doc_id, source, text) of each time the mix takes a document."""
    size = {i: len(WORD.findall(t or "")) for i, _, t in rows}
    sizes = collections.Counter()
    for i, s, _ in rows:
        sizes[s] += size[i]
    target, out = waterfill(sizes), []
    for s in sizes:
        budget = min(mixing.MOST * sizes[s], int(target[s] + 0.5))
        own = sorted((hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest(), i, t) for i, x, t in rows if x == s and size[i])
        out += [(i, s, t) for _, i, t in own] * (budget // max(1, sizes[s]))
        rest = budget % max(1, sizes[s])
        for _, i, t in own:
            if rest > 0:
                out.append((i, s, t if size[i] <= rest else " ".join(WORD.findall(t)[:rest])))
            rest -= size[i]
    return out


def test_pipeline_rows(spark, sf):
    import corpus_pipeline as cp

    docs = cp.reject_toxic(spark, table(spark, sf, "documents"), sf).select("doc_id", "source", "text").collect()
    source = {r.doc_id: r.source for r in docs}
    assert len(source) == len(docs)
    texts, gone = without_passages([(r.doc_id, r.text) for r in docs])
    least = classes(sorted(texts.items()))
    kept = [(i, source[i], t) for i, t in texts.items() if least[i] == i]
    assert gone and len(kept) < len(docs)
    library = piece_bpe.loaded(piece_bpe.default_model()).library
    want = collections.Counter()
    for i, s, t in mixed(kept):
        ids = library.encode(t)
        want[i, s, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in cp.run(spark, sf).collect())
    assert got == want
