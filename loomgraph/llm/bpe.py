"""Byte-level BPE encoding with forced-boundary splitting, and decoding.

A pair of bytes that occurs inside no vocabulary token can never be merged
across, so it marks a certain cut.  Text is cut first where such a pair is a
visible character followed by ASCII white space (the pre-tokeniser always
breaks there as well, whatever surrounds it); each piece is pre-tokenised, and
each pre-token is cut again at its own impossible pairs.  The fragments are
encoded independently and their ids concatenated.  Pieces repeat, so a bounded
memo per worker holds their ids.

Texts with white space outside ASCII's four usual characters are pre-tokenised
whole, as there a cut might change what the pre-tokeniser sees.

Edge cases: null or empty text gives no ids; null ids decode to null; unknown
ids are skipped, invalid UTF-8 is replaced, as the common library does.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed

#: Fixed value: the byte-level pre-tokeniser's pattern, white space by its Unicode property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
)
RARE_SPACE = re.compile("[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MEMO_ENTRIES = 100_000
#: Longer pieces are not worth keeping.
MEMO_PIECE = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, as char -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary file (the ``tokenizers`` JSON layout)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[self.vocab[raw(a)], self.vocab[raw(b)]] = (r, self.vocab[raw(a + b)])
        self.byte_id = [self.vocab[bytes([b])] for b in range(256)]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in self.vocab.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.inside = np.zeros((256, 256), bool)
        for t in self.vocab:
            if len(t) > 1:
                d = np.frombuffer(t, np.uint8)
                self.inside[d[:-1], d[1:]] = True
        self.pairs = frozenset((np.flatnonzero(self.inside.ravel())).tolist())
        # a piece ends before white space, but not after a byte that some token has before white space
        blank = b" \t\n\r"
        tied = bytes(a for a in range(256) if a not in blank and any(self.inside[a, b] for b in blank))
        more = b"(?:(?<=[" + re.escape(tied) + rb"])[ \t\n\r]+)?" if tied else b""
        self.piece = re.compile(rb"[ \t\n\r]*(?:[^ \t\n\r]+" + more + rb")+|[ \t\n\r]+")
        self.pattern = regex.compile(PRE_TOKEN)
        # where ids follow the order of the merges, a compiled merge by ids gives the same
        order = [new for _, new in sorted(self.rank.values())]
        self.core = None
        if order == sorted(order) and not any(self.byte_id[b] >= order[0] for b in range(256)):
            self.core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.vocab, special_tokens={})._core_bpe.encode_single_piece
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def merge(self, fragment: bytes) -> list[int]:
        """BPE of one fragment: repeatedly the lowest-ranked pair, leftmost first."""
        if self.core is not None:
            return self.core(fragment)
        ids = [self.byte_id[b] for b in fragment]
        rank = self.rank
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                r = rank.get((ids[i], ids[i + 1]))
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long fragments."""
        rank, n = self.rank, len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if r := rank.get((new, ids[nxt[i]])):
                    heapq.heappush(heap, (r[0], i, new, ids[nxt[i]], r[1]))
            if (p := prv[i]) >= 0 and (r := rank.get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, ids[p], new, r[1]))
        return [x for x in ids if x >= 0]

    def fragments(self, token: bytes) -> Iterator[bytes]:
        """A pre-token cut at every pair that no vocabulary token contains."""
        at, inside = 0, self.pairs
        for c in range(1, len(token)):
            if (token[c - 1] << 8 | token[c]) not in inside:
                yield token[at:c]
                at = c
        yield token[at:]

    def encode_piece(self, text: str) -> list[int]:
        out: list[int] = []
        for t in self.pattern.findall(text):
            b = t.encode()
            for f in self.fragments(b):
                if (ids := self.memo.get(f)) is None:
                    ids = self.merge(f)
                out.extend(ids)
        return out

    def encode_plain(self, text: str) -> list[int]:
        if RARE_SPACE.search(text):
            return self.encode_piece(text)
        memo, out = self.memo, []
        for p in self.piece.findall(text.encode()):
            ids = memo.get(p)
            if ids is None:
                ids = tuple(self.encode_piece(p.decode()))
                if len(p) <= MEMO_PIECE:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[p] = ids
            out.extend(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split_special is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        out: list[int] = []
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self.encode_plain(part))
        return out

    def decode(self, ids) -> str:
        size, token = len(self.token), self.token
        return b"".join([token[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One vocabulary per worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` plus token_ids (array<int>) of the whole text; ``path`` must exist on every executor."""
    keep = [c for c in df.columns if c not in ("token_ids", text_col)]
    src = df.select(*keep, text_col)
    fields = (src if keep_text else src.select(*keep)).schema.fields
    out = T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    width = len(keep) + keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            text = b.column(b.num_columns - 1)
            values, offs = [], [0]
            for k in range(b.num_rows):
                ids = np.array(bpe.encode(text[k].as_py()), np.int32)
                values.append(ids)
                offs.append(offs[-1] + len(ids))
                if offs[-1] > 1 << 22 or k + 1 == b.num_rows:
                    n = len(values)
                    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
                    ids_col = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))
                    part = [c.slice(k + 1 - n, n) for c in b.columns[:width]]
                    yield pa.RecordBatch.from_arrays([*part, ids_col], [*b.schema.names[:width], "token_ids"])
                    values, offs = [], [0]

    return src.mapInArrow(*freed(run, out))


def decode(df: DataFrame, path: str, *, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` plus the text of ``ids_col``."""
    keep = [c for c in df.columns if c != out_col]
    src = df.select(*keep)
    out = df.select(*keep).schema.add(out_col, "string")
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            col = b.column(at)
            offs = np.asarray(col.offsets)
            flat = np.asarray(col.values)
            ok = np.asarray(col.is_valid())
            texts = [bpe.decode(flat[offs[k] : offs[k + 1]].tolist()) if ok[k] else None for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    return src.mapInArrow(*freed(run, out))
