"""Language-model scoring by online logistic context mixing over bits.

A text is coded as its words (A-Z lower-cased) with one space between, and a line feed
as its end token; every byte is coded bit by bit, the highest first.  The predictors of
a bit are the training counts of a one and a zero in hashed contexts of the last 0 to 5
bytes, across words.  Their log odds are combined by weights that a gate picks (the
longest known context, and how often it was seen).  The weights are learned online, in
small steps on coding cost over the stream of every block of training events, and are
merged over the blocks between epochs; an adaptive probability map refines the mix.
As each bit's two probabilities sum to one, so do those of all texts.

The model's last context has five bytes, so a prediction depends on six bytes: an event.
Texts are dealt into groups of about ``GROUP`` bytes.  A group asks for its distinct
events and words, packed, and looks its own text up in the answers; neither a vocabulary
nor a table of events is ever broadcast.  Events with the same last three context bytes
meet in one block, so the counts of orders 3 to 5 are exact there (a block of three bytes
has at most 2**24 events, whatever the corpus); those of orders 0 to 2 come from the
table of three-byte strings, of which there are at most 2**24.  All training texts count,
all their events train the mixer.  Blocks depend on the input alone, not on partitions
or settings, so scores don't change with them.

Edge cases: null and empty texts have the end token only.  Null ids are never learned
from nor held out.  With nothing to learn from, all predictors are even.  Repeated rows
are scored each, and learned from as often as they occur.  Words are told apart by
64-bit hashes.  Only the id column is carried; others do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MIX, SPACE, Scratch, freed, input_bytes, mix64, slices, text_bytes, with_row_id, word_hash, word_spans

ORDER = 5
INPUTS = ORDER + 2  # with a bias
#: Gates: longest known order (none, 0 to 5) by how often its context was seen.
SEEN = np.array([1, 2, 4, 16, 256])
GATES = (ORDER + 2) * len(SEEN)
KNOTS = 33
#: Bytes of text that ask together, and that one vectorised step handles.
GROUP, STEP = 16 << 20, 1 << 21
END = 10
WORDS, GRAMS, TEXT = 0, 1, 2
ASK = "kind int, block long, grp long, data binary, counts binary, rids binary, sizes binary"
NAMES = ["kind", "block", "grp", "data", "counts", "rids", "sizes"]


def coded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of all rows, and their offsets."""
    start, end, row = word_spans(data, offs)
    rows = len(offs) - 1
    words = np.bincount(row, minlength=rows)
    size = np.bincount(row, end - start, minlength=rows).astype(np.int64) + np.maximum(words, 1)
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 32, np.uint8)
    solid = np.ones(len(out), bool)
    # a separator follows every word; a row without words is its end alone
    lead = np.cumsum(end - start + 1) if len(start) else np.zeros(0, np.int64)
    bare = np.concatenate([[0], np.cumsum(words == 0)])[:-1]
    solid[lead - 1 + bare[row]] = False
    out[to[1:] - 1], solid[to[1:] - 1] = END, False
    out[solid] = LOWER[data[~SPACE[data]]]
    return out, to


def events(text: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each coded byte the six bytes that end with it, as one integer; line feeds stand
    before a text's begin."""
    x = np.concatenate([np.full(ORDER, END, np.uint8), text]).astype(np.uint64)
    code = np.zeros(len(text), np.uint64)
    for j in range(ORDER + 1):
        code = (code << np.uint64(8)) | x[j : j + len(text)]
    begin = offs[:-1]
    for q in range(ORDER):
        at = (begin + q)[begin + q < offs[1:]]
        fixed = np.zeros(len(at), np.uint64)
        for back in range(ORDER, -1, -1):
            fixed = (fixed << np.uint64(8)) | (text[at - back].astype(np.uint64) if back <= q else np.uint64(END))
        code[at] = fixed
    return code


def tokens(text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token of coded texts: the words, then each row's end."""
    start, end, row = word_spans(text, offs)
    last = word_hash(np.array([END], np.uint8), np.array([0]), np.array([1]))
    rows = np.arange(len(offs) - 1)
    return np.concatenate([word_hash(text, start, end), np.repeat(last, len(rows))]), np.concatenate([row, rows])


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted codes with the sums of their numbers."""
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[at], np.add.reduceat(n, at)


def _distinct(code: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their occurrences where ``train``."""
    if train.all():
        u, n = np.unique(code, return_counts=True)
        return u, n.astype(np.int64)
    u, n = np.unique(code[train], return_counts=True)
    other = np.unique(code[~train])
    return np.concatenate([u, other]), np.concatenate([n, np.zeros(len(other), np.int64)]).astype(np.int64)


def planes(code: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each integer, all first bytes first: sorted ones compress."""
    return np.ascontiguousarray(code.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, :width] = own.T
    return out.view(np.uint64).ravel()


def block_of(code: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of events: those with the same last three context bytes share one."""
    return (mix64((code >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(blocks)).astype(np.int64)


class Lookup:
    """An open hash table from distinct integers to their positions."""

    def __init__(self, code: np.ndarray):
        self.code, self.bits = code, max(int(3 * len(code)).bit_length(), 4)
        self.at = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(code), np.arange(len(code), dtype=np.int32)
        while len(left):
            free = self.at[slot[left]] < 0
            self.at[slot[left[free]]] = left[free]
            left = left[self.at[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * MIX[41]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """Positions of codes that are all in the table."""
        slot = self._slot(code)
        out = self.at[slot]
        left = np.flatnonzero(self.code[out] != code)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.at[slot[left]]
            left = left[self.code[out[left]] != code[left]]
        return out


def _dealt(code: np.ndarray, n: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(block, kind="stable")
    code, n, block = code[order], n[order], block[order]
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
    for a, z in zip(cut, [*cut[1:], len(block)], strict=False):
        yield int(block[a]), code[a:z], n[a:z]


def _groups(blocks: int):
    """(rid, train, text) to packed questions, and each group's coded texts."""

    def flush(rids: list, texts: list, grams: list, words: list) -> Iterator[pa.RecordBatch]:
        grp = rids[0]
        out: list[tuple] = []
        code, n = summed(*(np.concatenate(x) for x in zip(*grams, strict=True)))
        out += [(GRAMS, b, grp, planes(c, 6), planes(k, 6), None, None) for b, c, k in _dealt(code, n, block_of(code, blocks))]
        code, n = summed(*(np.concatenate(x) for x in zip(*words, strict=True)))
        out += [(WORDS, b, grp, planes(c, 8), planes(k, 6), None, None) for b, c, k in _dealt(code, n, (code % np.uint64(blocks)).astype(np.int64))]
        sizes = np.concatenate([np.diff(to) for _, to in texts])
        out.append((TEXT, grp % blocks, grp, pa.compress(b"".join(t.tobytes() for t, _ in texts), codec="zstd", asbytes=True), None, np.array(rids, np.int64).tobytes(), sizes.tobytes()))
        types = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, texts, grams, words, total = [], [], [], [], 0
        for b in batches:
            all_rids, all_train = b.column(0).to_pylist(), np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            data, offs = text_bytes(b.column(2))
            for lo, hi in slices(offs, STEP):
                text, to = coded(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                train = all_train[lo:hi]
                rids += all_rids[lo:hi]
                texts.append((text, to))
                grams.append(_distinct(events(text, to), np.repeat(train, np.diff(to))))
                token, row = tokens(text, to)
                words.append(_distinct(token, train[row]))
                total += len(text)
                if total >= GROUP:
                    yield from flush(rids, texts, grams, words)
                    rids, texts, grams, words, total = [], [], [], [], 0
        if rids:
            yield from flush(rids, texts, grams, words)

    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each block, of what was dealt by block."""
    found: dict[int, list[dict]] = {}
    for b in batches:
        for r in b.to_pylist():
            found.setdefault(r["block"], []).append(r)
    for block in sorted(found):
        yield block, found.pop(block)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct events with their training counts."""
    for block, rows in _by_block(batches):
        code, n = summed(np.concatenate([unplanes(r["data"], 6) for r in rows]), np.concatenate([unplanes(r["counts"], 6) for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([planes(code, 6)]), pa.array([planes(n, 6)])], ["block", "data", "counts"])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of three-byte strings."""
    for b in batches:
        for data, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            code, n = summed(unplanes(data, 6) & np.uint64(0xFFFFFF), unplanes(counts, 6))
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])


class Counts:
    """Training counts of both values of each bit, in hashed contexts of ``order`` bytes."""

    def __init__(self, order: int, code: np.ndarray, n: np.ndarray):
        self.order, self.bits = order, []
        code, n = summed(code & np.uint64((1 << (8 * order + 8)) - 1), n.astype(float))
        for j in range(8):
            key, at = np.unique(self.hashed(code, j), return_inverse=True)
            one = ((code >> np.uint64(7 - j)) & np.uint64(1)) == 1
            self.bits.append((key, np.stack([np.bincount(at, n * ~one, minlength=len(key)), np.bincount(at, n * one, minlength=len(key))])))

    def hashed(self, code: np.ndarray, j: int) -> np.ndarray:
        """The context with the bits of the byte before bit j."""
        code = code & np.uint64((1 << (8 * self.order + 8)) - 1)
        return mix64((code >> np.uint64(8 - j)) * MIX[43] + MIX[44 + self.order : 45 + self.order] * np.uint64(j + 1))

    def __call__(self, code: np.ndarray, j: int) -> np.ndarray:
        key, n = self.bits[j]
        if not len(key):
            return np.zeros((2, len(code)))
        want = self.hashed(code, j)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return n[:, at] * (key[at] == want)


class Model:
    """The counts of one block's events, low orders included."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray], code: np.ndarray, n: np.ndarray):
        known = n > 0
        self.counts = [Counts(o, *low) if o < 3 else Counts(o, code[known], n[known]) for o in range(ORDER + 1)]

    def inputs(self, code: np.ndarray, j: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bit, predictor inputs and gate of bit j of each event.  ``own``: one occurrence of
        the event itself is taken out of the counts."""
        bit = ((code >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
        ins, gate = np.zeros((len(code), INPUTS)), np.zeros(len(code), np.int64)
        for o, counts in enumerate(self.counts):
            n = counts(code, j)
            if own:
                n = n.copy()
                n[bit, np.arange(len(code))] -= 1
            total = n.sum(axis=0)
            met = total > 0
            ins[:, o] = np.log((n[1] + 0.2) / (n[0] + 0.2)) * met
            gate[met] = (o + 1) * len(SEEN) + np.searchsorted(SEEN, total[met], side="right") - 1
        ins[:, -1] = 0.3
        return bit, ins, gate


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """Gated weights and the adaptive probability map."""

    def __init__(self):
        self.w = np.zeros((GATES, INPUTS))
        for g in range(GATES):
            # at first the longest known context and the one below it count most
            top = g // len(SEEN) - 1
            self.w[g, : max(top + 1, 0)] = 0.15
            if top >= 0:
                self.w[g, top] = 0.5
        self.map = np.tile(squash((np.arange(KNOTS) - KNOTS // 2) / 2.0), (GATES, 1))

    def mixed(self, ins: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((ins * self.w[gate]).sum(axis=1), -14, 14)

    def refined(self, dot: np.ndarray, gate: np.ndarray) -> np.ndarray:
        at = np.clip(dot, -7.99, 7.99) * 2 + KNOTS // 2
        low = at.astype(np.int64)
        frac = at - low
        mapped = self.map[gate, low] * (1 - frac) + self.map[gate, low + 1] * frac
        return np.clip((squash(dot) + mapped) / 2, 1e-6, 1 - 1e-6)

    def step(self, bit: np.ndarray, ins: np.ndarray, gate: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One online step against the gradient of coding cost, in each gate that is met."""
        err = (bit - squash(self.mixed(ins, gate))) * weight
        move, mass = np.zeros_like(self.w), np.bincount(gate, weight, minlength=GATES)
        np.add.at(move, gate, err[:, None] * ins)
        self.w += rate * move / (mass + weight.mean())[:, None]


def _learn(low, state: bytes, rate: float, last: bool, batch: int = 256):
    """Each block's events to its weights after one online pass from ``state``, times its
    number of bits in each gate, and (in the last epoch) sums for the probability map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            code, n = unplanes(rows[0]["data"], 6), unplanes(rows[0]["counts"], 6).astype(np.int64)
            model, mixer = Model(low.value, code, n), Mixer()
            mixer.w = np.frombuffer(state).reshape(GATES, INPUTS).copy()
            seen = n > 0
            code, weight = code[seen], n[seen].astype(float)
            order = np.argsort(mix64(code + MIX[42]), kind="stable")
            code, weight = code[order], weight[order]
            mass, ones, all_ = np.zeros(GATES), np.zeros((GATES, KNOTS)), np.zeros((GATES, KNOTS))
            for a in range(0, len(code), 1 << 14):
                part, wt = code[a : a + (1 << 14)], weight[a : a + (1 << 14)]
                for j in range(8):
                    bit, ins, gate = model.inputs(part, j, True)
                    mass += np.bincount(gate, wt, minlength=GATES)
                    if last:
                        at = np.rint(np.clip(mixer.mixed(ins, gate), -8, 8) * 2 + KNOTS // 2).astype(np.int64)
                        np.add.at(ones, (gate, at), wt * bit)
                        np.add.at(all_, (gate, at), wt)
                    for i in range(0, len(part), batch):
                        x = slice(i, i + batch)
                        mixer.step(bit[x], ins[x], gate[x], wt[x], rate)
            sums = np.concatenate([(mixer.w * mass[:, None]).ravel(), mass, ones.ravel(), all_.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sums.tobytes()])], ["block", "sums"])

    return run


def _merge(width: int):
    """(block, sums) added up by block modulo ``width``, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for block, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(block % width, []).append((block, sums))
        for part in sorted(found):
            rows = sorted(found.pop(part))
            total = np.zeros(len(rows[0][1]) // 8)
            for _, sums in rows:
                total += np.frombuffer(sums)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()])], ["block", "sums"])

    return run


def trained(blocks: int, learn_pass: Callable, rates=(0.05, 0.02)) -> Mixer:
    """The mixer after an epoch for each rate.  learn_pass(state, rate, last): a frame of sums."""
    mixer = Mixer()
    for i, rate in enumerate(rates):
        last = i == len(rates) - 1
        width = max(1, isqrt(blocks))
        merged = learn_pass(mixer.w.tobytes(), rate, last).select(F.pmod("block", F.lit(width)).alias("part"), "block", "sums")
        rows = merged.repartition(width, "part").select("block", "sums").mapInArrow(*freed(_merge(width), "block long, sums binary")).collect()
        if not rows:
            return mixer
        total = sum(np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["block"]))
        n = GATES * INPUTS
        w, mass = total[:n].reshape(GATES, INPUTS), total[n : n + GATES]
        met = mass > 0
        mixer.w[met] = w[met] / mass[met][:, None]
        if last:
            ones, all_ = total[n + GATES :].reshape(2, GATES, KNOTS)
            mixer.map = (ones + 4 * mixer.map) / (all_ + 4)
    return mixer


def log_probabilities(model: Model, mixer: Mixer, code: np.ndarray) -> np.ndarray:
    """log10 of each event's probability, given its context."""
    out = np.zeros(len(code))
    for j in range(8):
        bit, ins, gate = model.inputs(code, j, False)
        p = mixer.refined(mixer.mixed(ins, gate), gate)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def _score_events(low, mixer: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            code, n = unplanes(rows[0]["data"], 6), unplanes(rows[0]["counts"], 6).astype(np.int64)
            model = Model(low.value, code, n)
            lp = np.concatenate([np.zeros(0), *(log_probabilities(model, mixer, code[a : a + (1 << 15)]) for a in range(0, len(code), 1 << 15))])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([planes(code, 6)]), pa.array([lp.astype(np.float32).tobytes()])], ["block", "data", "lp"])

    return run


ANSWER = "kind int, grp long, data binary, value binary, rids binary, sizes binary, n long, v long"
ANSWERS = ["kind", "grp", "data", "value", "rids", "sizes", "n", "v"]


def _answer(kind: int, grp: int | None, data: bytes | None, value: bytes | None, n: int | None = None, v: int | None = None) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, grp, data, value, None, None, n, v), types, strict=True)], ANSWERS)


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's words with their training counts; a row without a group has the block's
    number of training tokens and of distinct ones."""
    for _, rows in _by_block(batches):
        codes = [unplanes(r["data"], 8) for r in rows]
        code, n = summed(np.concatenate(codes), np.concatenate([unplanes(r["counts"], 6) for r in rows]))
        yield _answer(WORDS, None, None, None, int(n.sum()), int((n > 0).sum()))
        for r, own in zip(rows, codes, strict=True):
            yield _answer(WORDS, r["grp"], r["data"], planes(n[np.searchsorted(code, own)], 6))


def _answer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_block(batches):
        table = next(r for r in rows if r["lp"] is not None)
        code, lp = unplanes(table["data"], 6), np.frombuffer(table["lp"], np.float32)
        for r in rows:
            if r["lp"] is None:
                yield _answer(GRAMS, r["grp"], r["data"], lp[np.searchsorted(code, unplanes(r["data"], 6))].tobytes())


def _total(n_train: int, n_words: int):
    """Groups' coded texts and answers to one row a text."""
    base = log10(n_train + 0.1 * (n_words + 1))

    def table(rows: list[dict], width: int, read) -> tuple[Lookup, np.ndarray]:
        return Lookup(np.concatenate([unplanes(r["data"], width) for r in rows])), np.concatenate([read(r["value"]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                found.setdefault(r["grp"], []).append(r)
        for grp in list(found):
            rows = found.pop(grp)
            head = next(r for r in rows if r["kind"] == TEXT)
            size = np.frombuffer(head["sizes"], np.int64)
            text = np.frombuffer(pa.decompress(head["data"], decompressed_size=int(size.sum()), codec="zstd", asbytes=True), np.uint8)
            gram, lp = table([r for r in rows if r["kind"] == GRAMS], 6, lambda x: np.frombuffer(x, np.float32).astype(float))
            word, count = table([r for r in rows if r["kind"] == WORDS], 8, lambda x: unplanes(x, 6).astype(np.int64))
            logs = np.log10(count + 0.1)
            offs = np.concatenate([[0], np.cumsum(size)])
            parts = []
            for lo, hi in slices(offs, STEP):
                own, to = text[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                score = np.add.reduceat(lp[gram(events(own, to))], to[:-1])
                token, row = tokens(own, to)
                at = word(token)
                m = np.bincount(row, minlength=hi - lo)
                known = np.bincount(row, count[at] > 0, minlength=hi - lo)
                parts.append((m, known, np.bincount(row, logs[at], minlength=hi - lo) - m * base, score))
            m, known, plain, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            cols = [np.frombuffer(head["rids"], np.int64), m.astype(np.int64), known.astype(np.int64), plain, score, -score * log2(10) / size]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["rid", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    return run


def mixing_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    spark = docs.sparkSession
    final = Scratch(spark)
    fold = F.crc32(F.col("id").cast("string")) % 10
    rows = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), final, "rid")
    bytes_in = input_bytes(rows)
    blocks = max(8, -(-bytes_in // block_bytes))
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-bytes_in // GROUP))
    with Scratch(spark) as scratch:
        train = F.coalesce(fold != 0, F.lit(False))
        asked = scratch.table(rows.select("rid", train.alias("train"), "t").mapInArrow(*freed(_groups(blocks), ASK)))
        grams = asked.where(F.col("kind") == GRAMS)
        seen = scratch.table(grams.select("block", "data", "counts").repartition(wide, "block").mapInArrow(*freed(_events, "block long, data binary, counts binary")))
        low = seen.mapInArrow(*freed(_triples, "code long, n long")).groupBy("code").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
        low = spark.sparkContext.broadcast((np.asarray(low["code"]).astype(np.uint64), np.asarray(low["n"]).astype(np.int64)))
        sums = "block long, sums binary"
        mixer = trained(blocks, lambda state, rate, last: seen.mapInArrow(*freed(_learn(low, state, rate, last), sums)))
        scored = seen.mapInArrow(*freed(_score_events(low, mixer), "block long, data binary, lp binary"))
        questions = grams.select("block", "grp", "data", F.lit(None).cast("binary").alias("lp"))
        both = questions.unionByName(scored.select("block", F.lit(None).cast("long").alias("grp"), "data", "lp"))
        words = asked.where(F.col("kind") == WORDS).select("block", "grp", "data", "counts").repartition(wide, "block").mapInArrow(*freed(_answer_words, ANSWER))
        words = scratch.table(words)
        n_train, n_words = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("v")).first())
        answers = both.repartition(wide, "block").mapInArrow(*freed(_answer_grams, ANSWER)).unionByName(words.where("grp is not null")).drop("n", "v")
        texts = asked.where(F.col("kind") == TEXT).select("kind", "grp", "data", F.lit(None).cast("binary").alias("value"), "rids", "sizes")
        got = "rid long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
        done = final.table(texts.unionByName(answers).repartition(wide, "grp").mapInArrow(*freed(_total(n_train, n_words), got)))
        low.unpersist()
    held = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    out = rows.select("rid", "id", held).join(done, "rid")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
