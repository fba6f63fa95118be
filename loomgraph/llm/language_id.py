"""Hierarchical language identification.

The language family is predicted first, then one-versus-one linear support
vector machines separate the languages within it.  Inputs are hashed byte
trigrams and words of the whole text, nothing else.

Training takes at most about ``max_train`` rows (one a label at least), dealt evenly
over the labels and drawn by a hash of the id; their sparse counts (not texts) go to
the driver.  Languages of the fixed table share a family; other labels join the family
of their kind, up to ``KIN`` labels whose mean counts are nearest.  A family has one
machine against all others, so the number of machines grows with the labels and not
with their square.

Edge cases: null text and text without a letter: ``und`` with score 0.  With no
labelled row nothing can be learned, and every row is ``und``.  With one label
every text with a letter gets it.  Null labels are never learned from.  Columns but the
id are not carried; the id column may have any name but those of the results.  Repeated
rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, mix64, prefix_hash, slices, span_hash, text_bytes, word_spans

#: Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
}
GRAMS = WORDS = 4096
DIM = GRAMS + WORDS
#: Bytes of letters, A-Z lower-cased; all else is one separator.
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)
NOT_LETTER = LETTER == 32


#: Most labels of a family beside those of the table.
KIN = 12
#: Rows that are counted at once: each takes DIM numbers.
ROWS = 1024


def families(means: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """Family to languages: by the table, others with those of the nearest mean counts."""
    tree = {f: [a for a in ls if a in means] for f, ls in FAMILIES.items()}
    tree = {f: sorted(ls) for f, ls in tree.items() if ls}
    rest = sorted(set(means) - {a for ls in tree.values() for a in ls})
    while rest:
        near = sorted(rest, key=lambda a: (float(((means[a] - means[rest[0]]) ** 2).sum()), a))[:KIN]
        tree[f"kin of {rest[0]}"] = sorted(near)
        rest = [a for a in rest if a not in near]
    return dict(sorted(tree.items()))


def count_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, DIM) square-rooted counts, each row of unit length."""
    rows = len(offs) - 1
    low = LETTER[data]
    row_of = np.repeat(np.arange(rows), np.diff(offs))
    out = np.zeros((rows, DIM), np.float32)
    if len(low) >= 3:
        code = low[:-2].astype(np.uint32) * np.uint32(65599 * 65599 & 0xFFFFFFFF) + low[1:-1].astype(np.uint32) * np.uint32(65599) + low[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(20)
        inside = (row_of[:-2] == row_of[2:]) & (low[1:-1] != 32)
        flat = row_of[:-2][inside] * GRAMS + code[inside]
        out[:, :GRAMS] = np.sqrt(np.bincount(flat, minlength=rows * GRAMS).reshape(rows, GRAMS))
    start, end, row = word_spans(data, offs, NOT_LETTER)
    if len(start):
        code = (mix64(span_hash(prefix_hash(low), start, end)) >> np.uint64(52)).astype(np.int64)
        out[:, GRAMS:] = np.sqrt(np.bincount(row * WORDS + code, minlength=rows * WORDS).reshape(rows, WORDS))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def train_rows(doc_id: Column) -> Column:
    """The fold that may be learned from (null ids: none)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def linear_svm(x: np.ndarray, y: np.ndarray, *, lam: float = 1e-4, epochs: int = 20, seed: int = 5) -> np.ndarray:
    """Weights (bias last) of a hinge-loss machine: averaged mini-batch subgradient
    steps, classes weighted to equal totals."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(y)
    x = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    w, mean, t, kept = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    for e in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 32):
            i = order[a : a + 32]
            t += 1
            step = 1 / (lam * (t + 1000))
            hit = y[i] * (x[i] @ w) < 1
            grad = lam * w - ((y[i] * weight[i] * hit) @ x[i]) / len(i)
            w -= step * grad
            if e >= epochs // 2:
                mean += w
                kept += 1
    return mean / max(kept, 1)


class Model:
    """Family machines and, for each family, machines between its languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        lang = np.array(langs, object)
        self.tree = families({a: x[lang == a].mean(axis=0) for a in sorted(set(langs))})
        fam = np.array([{a: f for f, ls in self.tree.items() for a in ls}[a] for a in langs], object)
        # two families need one machine
        tops = list(self.tree)[: 1 if len(self.tree) == 2 else None] if len(self.tree) > 1 else []
        self.top = self._stack([linear_svm(x, np.where(fam == f, 1.0, -1.0)) for f in tops])
        self.pairs = {f: list(combinations(range(len(ls)), 2)) for f, ls in self.tree.items()}
        self.low = {}
        for f, ls in self.tree.items():
            use = [(lang == ls[a]) | (lang == ls[b]) for a, b in self.pairs[f]]
            self.low[f] = self._stack([linear_svm(x[u], np.where(lang[u] == ls[a], 1.0, -1.0)) for (a, _), u in zip(self.pairs[f], use, strict=True)])

    @staticmethod
    def _stack(w: list[np.ndarray]) -> np.ndarray:
        return np.array(w, np.float32).T if w else np.zeros((DIM + 1, 0), np.float32)

    def _vote(self, family: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most wins, then the largest sum of margins; score: how sure the closest win is."""
        w, n, names = self.low[family], len(x), len(self.tree[family])
        margin = x @ w[:-1] + w[-1]
        wins, total, least = np.zeros((n, names)), np.zeros((n, names)), np.full((n, names), 50.0)
        for j, (a, b) in enumerate(self.pairs[family]):
            for c, m in ((a, margin[:, j]), (b, -margin[:, j])):
                wins[:, c] += m > 0
                total[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        best = np.argmax(wins + 1e-3 * np.tanh(total / 10), axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(n), best]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = x @ self.top[:-1] + self.top[-1]
        if margin.shape[1] == 0:
            best, score = np.zeros(len(x), np.int64), np.ones(len(x))
        elif margin.shape[1] == 1:
            best, score = (margin[:, 0] <= 0).astype(np.int64), 1 / (1 + np.exp(-4 * np.abs(margin[:, 0])))
        else:
            best = np.argmax(margin, axis=1)
            two = np.sort(margin, axis=1)[:, -2:]
            score = 1 / (1 + np.exp(-4 * (two[:, 1] - two[:, 0])))
        lang = np.empty(len(x), object)
        for f, (name, ls) in enumerate(self.tree.items()):
            at = np.flatnonzero(best == f)
            if len(at):
                own, sure = self._vote(name, x[at])
                lang[at] = np.array(ls, object)[own]
                score[at] *= sure
        return lang, score


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = text_bytes(b.column(1))
        for lo, hi in slices(offs, rows=ROWS):
            x = count_features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            at = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([r[a].tolist() for r, a in zip(x, at, strict=True)], pa.list_(pa.float32()))],
                ["lang", "at", "v"],
            )


def train(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, max_train: int) -> Model | None:
    rows = docs.where(train_rows(F.col(id_col)) & F.col(lang_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()
    if not counts:
        return None
    share = max(1, max_train // len(counts))
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("language id")), F.lit(1_000_000))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(1, int(min(1.0, share / r["count"]) * 1_000_000)))])
    got = rows.where(part < F.element_at(shares, F.col(lang_col))).select(F.col(lang_col).alias("lang"), text_col).mapInArrow(*freed(_sparse, "lang string, at array<int>, v array<float>")).collect()
    got = sorted({(r["lang"], tuple(r["at"]), tuple(r["v"])) for r in got if r["at"]})
    if not got:
        return None
    x = np.zeros((len(got), DIM), np.float32)
    for i, (_, at, v) in enumerate(got):
        x[i, list(at)] = v
    return Model(x, [lang for lang, _, _ in got])


def language_id(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 3000
) -> DataFrame:
    """id, held_out, lang_pred, score for every row of ``docs``."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, max_train=max_train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, offs = text_bytes(b.column(b.num_columns - 1))
            text = b.column(b.num_columns - 1)
            for lo, hi in slices(offs, rows=ROWS):
                part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                ascii_letter = np.add.reduceat(np.append(((part | 32) >= 97) & ((part | 32) <= 122), False), at[:-1]) > 0
                ascii_letter &= np.diff(at) > 0
                ok = np.array([bool(ascii_letter[i]) or has_letter(text[lo + i].as_py()) for i in range(hi - lo)])
                lang, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if model is not None and ok.any():
                    found, sure = model.predict(count_features(part, at))
                    lang[ok], score[ok] = found[ok], sure[ok]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())],
                    [id_col, "held_out", "lang_pred", "score"],
                )

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held, text_col).mapInArrow(*freed(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double"))
