"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A score-ordered agenda holds the adjacent symbol pairs whose concatenation is a piece; the best one (highest
score, then leftmost) is merged until none is left, as in Sennrich et al. 2016 with SentencePiece's scores.
No piece spans certain neighbours (letter next to other signs, anything before a space mark), which is proved
from the vocabulary when it is loaded, so texts are cut there and the agenda runs once for each distinct chunk
that a worker's bounded cache doesn't hold. In each Arrow slice all chunks that were new to the cache, and one
whole text with its decoding, are compared with the sentencepiece library; a difference raises.

Narrow: no shuffle; a task holds one slice of rows and a cache of at most 2 * CACHE chunks.

Defined cases: null is the empty text; an empty text has no ids and decodes to an empty text; literal U+2581 is
a space, as in the library; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_or_empty

MARK = "▁"
#: Chunks in each of the two generations of a worker's cache.
CACHE = 300_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the model format (fixed values)
_WHOLE = re.compile(r"(?s).+")


def default_model() -> bytes:
    import public_tokenizers

    return model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PieceModel:
    """Vocabulary, agenda and library of one model. Only models that the agenda matches exactly are taken:
    BPE, identity normalisation with a dummy prefix, byte fallback, no user-defined pieces."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto)
        norm, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or m.trainer_spec.treat_whitespace_as_suffix or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError("not a merge-type vocabulary with identity normalisation and byte fallback")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.order = {p.piece: -p.score for p in m.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.piece_of = {i: p for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.chunks = self._chunks()

    def _chunks(self) -> re.Pattern:
        """Runs of letters or of other signs, each with the space marks before it, if no piece joins two of
        them: then no merge can either. Letters that some piece joins with other signs count as such."""
        pairs = {ab for p in self.ids for ab in zip(p, p[1:], strict=False)}
        if any(a != MARK and b == MARK for a, b in pairs):
            return _WHOLE
        pairs = {(a, b) for a, b in pairs if a != MARK}
        letter, odd = re.compile(r"[^\W\d_]"), set()
        while found := {x for a, b in pairs if (bool(letter.match(a)) and a not in odd) != (bool(letter.match(b)) and b not in odd) for x in (a, b) if letter.match(x)} - odd:
            odd |= found
            if len(odd) > 100:
                return _WHOLE
        odd_class = "".join(map(re.escape, sorted(odd)))
        return re.compile(rf"{MARK}*(?:[^\W\d_{odd_class}]+|(?:[\d_{odd_class}]|[^\w{MARK}])+)|{MARK}+")

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(MARK + text.replace(" ", MARK)) if text else []

    def agenda(self, s: str) -> list[str]:
        """The pieces (or single symbols) that the merges leave of a chunk."""
        if len(s) == 1:
            return [s]
        order, parts, n = self.order, list(s), len(s)
        heap = [(order[p], i, i + 1, 2) for i in range(n - 1) if (p := s[i : i + 2]) in order]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, j, size = heapq.heappop(heap)
            a, b = parts[i], parts[j]
            if not a or not b or len(a) + len(b) != size or after[i] != j:
                continue  # one of the two has been merged since
            parts[i], parts[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := parts[i] + parts[k]) in order:
                    heapq.heappush(heap, (order[p], i, k, len(p)))
            if (h := before[i]) >= 0 and (p := parts[h] + parts[i]) in order:
                heapq.heappush(heap, (order[p], h, i, len(p)))
        return [x for x in parts if x]

    def chunk_ids(self, s: str) -> list[int]:
        out: list[int] = []
        for p in self.agenda(s):
            i = self.ids.get(p)
            if i is None:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for c in self.split(text) for i in self.chunk_ids(c)]

    def pieces_text(self, ids: list[int]) -> str:
        """The text of ids, with the dummy prefix still in front."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(self.piece_of.get(i, "").replace(MARK, " "))
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text.startswith(" ") and ids and ids[0] not in self.byte_of else text

    def check_chunks(self, got: dict[str, list[int]]) -> None:
        """Raises where the library encodes a chunk otherwise. A line feed in front keeps the library's dummy prefix apart."""
        names = list(got)
        for c, ids in zip(names, self.library.encode(["\n" + c for c in names]), strict=True):
            if ids[2:] != got[c]:
                raise ValueError(f"the agenda and the library differ on {c[:200]!r}: {got[c][:50]}, {ids[2:52]}")

    def check_text(self, text: str, ids: list[int], decoded: str) -> None:
        """Raises where the library encodes or decodes a whole text otherwise."""
        if (own := self.library.encode(text)) != ids or self.library.decode(own) != decoded:
            raise ValueError(f"the agenda and the library differ on a text that begins {text[:200]!r}")


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is no part of a character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[bytes, PieceModel] = {}


def loaded(proto: bytes) -> PieceModel:
    """One model for each worker process."""
    key = hashlib.sha256(proto).digest()
    if key not in _loaded:
        _loaded[key] = PieceModel(proto)
    return _loaded[key]


class Recent:
    """A bounded cache of two generations: what hasn't been used while one filled up goes."""

    def __init__(self, make: Callable[[str], tuple], limit: int = CACHE):
        self.make, self.limit, self.new, self.old, self.fresh = make, limit, {}, {}, {}

    def miss(self, s: str) -> tuple:
        v = self.old.get(s)
        if v is None:
            v = self.fresh[s] = self.make(s)
        if len(s) <= 64:  # long ones are rare and would fill the memory
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[s] = v
        return v


def _caches(kind: str, proto: bytes, make: Callable[[str], tuple], limit: int = CACHE) -> Recent:
    key = (kind, hashlib.sha256(proto).digest())
    if key not in _cached:
        _cached[key] = Recent(make, limit)
    return _cached[key]


_cached: dict[tuple, Recent] = {}


def encode_column(df: DataFrame, keep: tuple[str, ...] = (), text: str = "text", proto: bytes | None = None, with_ids: bool = True, digests: bool = False) -> DataFrame:
    """`keep` columns, then n_tokens, ids (if with_ids) and, if digests, ids_sha256 and decoded_sha256."""
    proto = proto or default_model()
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = (kinds + ", " if kinds else "") + "n_tokens bigint" + (", ids array<int>" if with_ids else "") + (", ids_sha256 string, decoded_sha256 string" if digests else "")

    def make():
        model = loaded(proto)

        def entry(c: str) -> tuple:
            ids = model.chunk_ids(c)
            return len(ids), ",".join(map(str, ids)), model.pieces_text(ids), ids

        cache = _caches("encode", proto, entry)

        def rows(cols):
            n_tokens, all_ids, shas, decs = [], [], [], []
            texts = cols["__text"]
            for no, text in enumerate(texts):
                got, new = [], cache.new
                for c in model.split(text):
                    v = new.get(c)
                    if v is None:
                        v = cache.miss(c)
                        new = cache.new
                    got.append(v)
                n_tokens.append(sum([v[0] for v in got]))
                if with_ids or no == 0:
                    ids = [i for v in got for i in v[3]]
                if with_ids:
                    all_ids.append(ids)
                if digests or no == 0:
                    decoded = "".join([v[2] for v in got])
                    decoded = decoded[1:] if decoded.startswith(" ") else decoded
                    shas.append(hashlib.sha256(",".join([v[1] for v in got]).encode()).hexdigest())
                    decs.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if no == 0:
                        model.check_text(text, ids, decoded)
            model.check_chunks({c: v[3] for c, v in cache.fresh.items()})
            cache.fresh.clear()
            return {c: cols[c] for c in keep} | {"n_tokens": n_tokens, "ids": all_ids, "ids_sha256": shas, "decoded_sha256": decs}

        return rows

    return map_rows(df.select(*[F.col(c) for c in keep], text_or_empty(text).alias("__text")), make, schema)


def decode_column(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = (), proto: bytes | None = None) -> DataFrame:
    """`keep` columns, then `decoded`: the text of a column of ids. Null ids decode to null."""
    proto = proto or default_model()
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        model = loaded(proto)

        def rows(cols):
            out = [None if x is None else model.decode(x) for x in cols["__ids"]]
            for x, y in [(x, y) for x, y in zip(cols["__ids"], out, strict=True) if x is not None][:1]:
                if model.library.decode(x) != y:
                    raise ValueError(f"decoding differs from the library's: {x[:50]}")
            return {c: cols[c] for c in keep} | {"decoded": out}

        return rows

    return map_rows(df.select(*[F.col(c) for c in keep], F.col(ids).alias("__ids")), make, (kinds + ", " if kinds else "") + "decoded string")


def encode_documents(df: DataFrame, proto: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    return encode_column(df.withColumn("doc_id", F.col("doc_id").cast("bigint")), ("doc_id",), proto=proto, with_ids=False, digests=True)
