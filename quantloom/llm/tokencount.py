"""Token counts at every prefix by dynamic programming over a merge-type vocabulary.

The merges' result for a prefix ends in exactly one token t for which the pair (last token of the prefix
before t, t) is one that the merges leave alone; so `count[i] = count[i - len(t)] + 1`. The table of a
text is that of its chunks (see piece_bpe: no merge crosses a chunk's border) with running offsets, so it
answers "how many tokens has this prefix" and "what is the longest prefix within a budget" without encoding
again. Chunks' tables are kept in a bounded cache; in each Arrow slice the last entry of every new table is
compared with the sentencepiece library, and so is one whole text.

Narrow: no shuffle. Defined cases: null is the empty text, which has 0 tokens; prefixes are in code points.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_or_empty
from .piece_bpe import PieceModel, _caches, default_model, loaded

LIMIT = 4096
#: Token pairs whose compatibility a worker remembers.
PAIRS = 400_000


class PrefixCounter:
    def __init__(self, model: PieceModel):
        self.model, self.pairs, self.cache = model, {}, None
        # Pieces that the merges make from their own symbols, and by last sign the lengths to try, longest first.
        self.whole = {p for p in model.ids if len(p) == 1 or model.agenda(p) == [p]}
        lengths: dict[str, set[int]] = {}
        for p in self.whole:
            lengths.setdefault(p[-1], {1}).add(len(p))
        self.lengths = {c: tuple(sorted(n, reverse=True)) for c, n in lengths.items()}

    def _stays(self, a: str, b: str) -> bool:
        """True if the merges of a + b end with just these two."""
        v = self.pairs.get((a, b))
        if v is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            v = self.pairs[a, b] = self.model.agenda(a + b) == [a, b]
        return v

    def table(self, s: str) -> tuple[int, ...]:
        """Token count of s[:1], s[:2], ... for a chunk s."""
        ids, whole, lengths, pairs = self.model.ids, self.whole, self.lengths, self.pairs
        last, count = [""], [0]
        for i in range(1, len(s) + 1):
            for n in lengths.get(s[i - 1], (1,)):
                if n > i or (t := s[i - n : i]) not in whole and n > 1:
                    continue
                if i == n or (pairs.get((last[i - n], t)) if (last[i - n], t) in pairs else self._stays(last[i - n], t)):
                    last.append(t)
                    count.append(count[i - n] + (1 if t in ids else len(t.encode())))
                    break
            else:
                raise ValueError(f"no token ends {s[:i][-50:]!r}")
        return tuple(count[1:])

    def tables(self, text: str) -> list[tuple[int, ...]]:
        """The tables of a text's chunks in order; the first starts with the dummy prefix."""
        new, out = self.cache.new, []
        for c in self.model.split(text):
            v = new.get(c)
            if v is None:
                v = self.cache.miss(c)
                new = self.cache.new
            out.append(v)
        return out

    def prefixes(self, text: str) -> list[int]:
        """Token count of text[:0], text[:1], ..., text."""
        out, base = [], 0
        for t in self.tables(text):
            out += [base + x for x in t]
            base += t[-1]
        return ([0] + out[1:]) if out else [0]

    def longest_prefix(self, tables: list[tuple[int, ...]], budget: int) -> int:
        """Code points of the longest prefix (not all shorter ones need fit) of at most `budget` tokens."""
        ends, n, k = [], 0, 0
        for t in tables:
            ends.append((n, k))
            n, k = n + len(t), k + t[-1]
        if k <= budget:
            return max(0, n - 1)
        best = 0
        # A chunk's table can fall, but never under the count before the chunk plus one.
        for i in range(min(len(tables), bisect_right([e[1] for e in ends], budget)) - 1, -1, -1):
            n, k = ends[i]
            if fits := [j for j, x in enumerate(tables[i], 1) if k + x <= budget]:
                best = n + fits[-1]
                break
        return max(0, best - 1)

    def check_fresh(self) -> None:
        names = list(self.cache.fresh)
        for c, ids in zip(names, self.model.library.encode(["\n" + c for c in names]), strict=True):
            if len(ids) - 2 != self.cache.fresh[c][-1]:
                raise ValueError(f"the table and the library differ on {c[:200]!r}: {self.cache.fresh[c][-1]}, {len(ids) - 2}")
        self.cache.fresh.clear()


_counters: dict[int, PrefixCounter] = {}


def counter(proto: bytes) -> PrefixCounter:
    model = loaded(proto)
    if id(model) not in _counters:
        c = _counters[id(model)] = PrefixCounter(model)
        c.cache = _caches("count", proto, c.table)
    return _counters[id(model)]


def count_documents(df: DataFrame, limit: int = LIMIT, proto: bytes | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the longest prefix of at most `limit` tokens."""
    proto = proto or default_model()

    def make():
        c = counter(proto)

        def rows(cols):
            out = {k: [] for k in ("n_bytes", "n_tokens", "over_limit", "fit_chars")}
            for no, text in enumerate(cols["text"]):
                tables = c.tables(text)
                n = sum([t[-1] for t in tables])
                if no == 0 and n != len(c.model.library.encode(text)):
                    raise ValueError(f"the table and the library differ on a text that begins {text[:200]!r}")
                out["n_bytes"].append(len(text.encode()))
                out["n_tokens"].append(n)
                out["over_limit"].append(n > limit)
                out["fit_chars"].append(len(text) if n <= limit else c.longest_prefix(tables, limit))
            c.check_fresh()
            return out | {"doc_id": cols["doc_id"]}

        return rows

    return map_rows(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")


def prefix_tables(df: DataFrame, proto: bytes | None = None) -> DataFrame:
    """doc_id and prefix_tokens: an array whose i-th entry (from 0) is the token count of the first i code points."""
    proto = proto or default_model()
    make = lambda: lambda cols: {"doc_id": cols["doc_id"], "prefix_tokens": [counter(proto).prefixes(t) for t in cols["text"]]}
    return map_rows(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), make, "doc_id bigint, prefix_tokens array<int>", 64)


def tokens_of_prefix(tables: DataFrame, chars: int) -> DataFrame:
    """The token count of each text cut after `chars` code points, read from stored prefix tables."""
    return tables.select("doc_id", F.col("prefix_tokens")[F.least(F.lit(chars), F.size("prefix_tokens") - 1)].cast("bigint").alias("n_tokens"))
