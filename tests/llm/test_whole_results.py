"""Results against brute force, and results that must not depend on settings."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from loomgraph.llm import common, context_mixing, language_id, line_dedup, ngram_join, quality_model, quality_rules, queries, repeats, url_filters
from loomgraph.llm.common import Scratch, connected_components, with_row_id

SCHEMA = "doc_id long, text string, lang string, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def stored(spark, rows, tmp_path, schema=SCHEMA, name="d", files=5):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


# ------------------------------------------------------------ shared parts
def test_row_keys_hold_when_files_are_packed_otherwise(spark, tmp_path):
    d = stored(spark, [(i, f"t{i}", "en", "") for i in range(500)], tmp_path)
    seen = []
    for split, cost in (("128m", "4m"), ("2k", "1"), ("1m", "1")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        with Scratch(spark) as scratch:
            seen.append({r.doc_id: r.k for r in with_row_id(d.where("doc_id % 7 <> 3").select("doc_id"), scratch, "k").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) == len(seen[0]) > 400
    with Scratch(spark) as scratch:  # what is no scan is stored first
        made = with_row_id(d.groupBy("doc_id").agg(F.max("text").alias("text")), scratch, "k")
        assert made.select("k").distinct().count() == 500 and dict(made.select("doc_id", "k").collect()) == dict(made.select("doc_id", "k").collect())


@pytest.mark.parametrize("op", ["join", "lines", "repeats"])
def test_results_hold_when_files_are_packed_otherwise(spark, tmp_path, op):
    d = queries.table(spark, SF, "documents").select("doc_id", "text")
    d = stored(spark, d.collect(), tmp_path, "doc_id long, text string")
    run = {
        "join": lambda: {r.doc_id: r.component_id for r in ngram_join.jaccard_components(d).collect()},
        "lines": lambda: {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()},
        "repeats": lambda: {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(d).collect()},
    }[op]
    want = run()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_digests_tell_long_strings_of_a_known_trap_apart():
    a = b"a"
    while len(a) < 4096:
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(a + a.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    start, end = np.array([0, 4096]), np.array([4096, 8192])
    h = common.digests(data, start, end)
    assert (h[0] != h[1]).all() and len(set(common.word_hash(data, start, end).tolist())) == 2


def test_components_equal_a_plain_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, 1000 + i) for i in range(1, 3000)]
    edges += [(5000 + i, 5001 + i) for i in range(60)] + [(7, 7)]
    plain = Union()
    for a, b in edges:
        plain.join(a, b)
    with Scratch(spark) as scratch:
        got = {r.id: r.comp for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), scratch).collect()}
        assert got == {x: plain.find(x) for a, b in edges if a != b for x in (a, b)}
        assert connected_components(spark.createDataFrame([], "src long, dst long"), scratch).count() == 0


# ----------------------------------------------------------------- op1, op4
def test_references_in_blocks_give_one_verdict(spark):
    d = queries.table(spark, SF, "documents").withColumn("lang", F.concat("lang", (F.col("doc_id") % 2).cast("string")))
    run = lambda n: {r.doc_id: (r.kept, r.js_class, r.js_words) for r in quality_rules.quality_rules(d, carry=["doc_id"], ref_block=n, min_ref_docs=1).collect()}
    many, one = run(1000), run(1)
    assert many == one and any(x[1] for x in one.values())


def test_quality_of_long_repeated_and_clashing_rows(spark, tmp_path):
    long = "word " * (1 << 18) + "other text here"
    rows = [(1, long, "en", "x"), (1, long, "en", "x"), (2, "a", None, None)]
    d = stored(spark, rows, tmp_path).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    out = quality_rules.quality_rules(d).orderBy("doc_id").collect()
    assert [r.n_words for r in out] == [(1 << 18) + 3] * 2 + [1] and [r.kept for r in out] == [False] * 3


def test_aliases_equal_a_plain_union_find(spark, tmp_path):
    rng = random.Random(9)
    url = lambda i: f"http://h{i}.{'net/es/x' if i % 41 == 5 else 'com/q' if i % 13 == 2 else 'org/p'}"
    to = {i: [rng.randrange(400) for _ in range(rng.choice([0, 0, 1, 1, 2]))] for i in range(300)} | {i: [0] for i in range(400, 900)}
    page = lambda i: "".join(f'<link rel="canonical" href="{url(j)}">' for j in to[i])
    rows = [(i, url(i), page(i), "x" * 5) for i in to]
    plain = Union()
    for i, js in to.items():
        for j in js:
            plain.join(i, j)
    down = {plain.find(i) for i in range(900) if i % 41 == 5}
    d = stored(spark, rows, tmp_path, "page_id long, url string, html string, extra string").withColumn("verdict", F.lit("clash"))
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(d).collect()}
    assert got == {i: "allow" if i % 13 == 2 and i % 41 != 5 else "block" if plain.find(i) in down else "allow" for i in to}
    both = [("block", "a.org/x"), ("allow", "a.org/x")]
    tie = stored(spark, [(1, "http://a.org/xy", None, "")], tmp_path, "page_id long, url string, html string, extra string", "tie")
    for rules in (both, both[::-1]):
        assert url_filters.filter_urls(tie, rules).first().verdict == "allow"


# ---------------------------------------------------------------------- op3
def test_more_labels_than_any_cap(spark, tmp_path):
    rng = random.Random(1)
    words = {f"l{i}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(230)}
    rows = [(i, " ".join(rng.choices(words[f"l{i % 230}"], k=40)), f"l{i % 230}", "") for i in range(230 * 6)]
    rows += [(9000, "x " * 200_000, "l0", ""), (9000, "x " * 200_000, "l0", "")]
    out = language_id.language_id(stored(spark, rows, tmp_path)).join(spark.createDataFrame(rows, SCHEMA), "doc_id").where("held_out and doc_id < 9000").collect()
    assert len({r.lang_pred for r in out}) > 200
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)


def test_families_are_bounded():
    means = {f"x{i:03}": np.eye(300, dtype=np.float32)[i] for i in range(300)} | {"en": np.zeros(300, np.float32), "de": np.ones(300, np.float32)}
    tree = language_id.families(means)
    assert tree["germanic"] == ["de", "en"] and sorted(a for ls in tree.values() for a in ls) == sorted(means)
    assert max(map(len, tree.values())) <= language_id.KIN and len(tree) == 26


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    langs = ["en", "de", "fr", "es", "it", "zz"] * 20
    x = np.zeros((120, language_id.DIM), np.float32)
    x[np.arange(120), [langs.index(a) for a in langs]] = 1
    x[:, 50:60] = rng.random((120, 10))
    model = language_id.Model(x, langs)
    got, score = model.predict(x)
    assert got.tolist() == langs and ((score >= 0) & (score <= 1)).all()
    for i in range(0, 120, 7):  # one by one, in plain Python
        row = np.append(x[i], 1).astype(float)
        tops = [float(row @ w) for w in model.top.T.astype(float)]
        family = list(model.tree)[max(range(len(tops)), key=tops.__getitem__)]
        names = model.tree[family]
        wins = defaultdict(float)
        for (a, b), w in zip(model.pairs[family], model.low[family].T.astype(float), strict=True):
            m = float(row @ w)
            wins[a if m > 0 else b] += 1
        assert names[max(range(len(names)), key=lambda c: wins[c])] == got[i]


# ---------------------------------------------------------------------- op6
def test_join_of_long_texts_and_text_ids(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(5000)]
    long = rng.choices(vocab, k=60_000)
    near = [w if i % 40 else "zz" for i, w in enumerate(long)]
    rows = [("b", " ".join(long), "x"), ("a", " ".join(near), "x"), ("c", "tiny", "x"), (None, "tiny", "x"), ("c", "tiny", "x")]
    d = stored(spark, rows, tmp_path, "doc_id string, text string, component_id string")
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(d).collect())
    n = {t: len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for t, w in (("b", long), ("a", near))}
    assert out == [("None", 1, "c"), ("a", n["a"], "a"), ("b", n["b"], "a"), ("c", 1, "c"), ("c", 1, "c")]
    assert sorted(r.doc_id for r in ngram_join.keep_one(d).collect()) == ["a", "c"]


def test_join_of_a_large_near_group(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(2000)]
    base = rng.choices(vocab, k=120)
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(116)) for t in texts]
    plain = Union()
    for i in range(400):
        plain.find(i)
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                plain.join(i, j)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(stored(spark, [(i, t, "", "") for i, t in enumerate(texts)], tmp_path)).collect()}
    assert got == {i: plain.find(i) for i in range(400)} and 20 < len(set(got.values())) < 300


# ---------------------------------------------------------------------- op7
def test_ridge_and_isotonic_equal_brute_force():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, quality_model.NAMES)).astype(np.float32), rng.integers(0, 2, 300).astype(float)
    fourier = quality_model.Fourier(x.mean(axis=0), x.std(axis=0), 16)
    batch = lambda a, z: pa.RecordBatch.from_arrays([pa.array(x[a:z].tolist(), pa.list_(pa.float32())), pa.array(y[a:z])], ["x", "y"])
    sums = [r for a, z in ((0, 100), (100, 300)) for r in quality_model._equations(fourier)(iter([batch(a, z)]))]
    total = np.frombuffer(next(quality_model._add(iter(sums))).column(0)[0].as_py()).reshape(17, 18)
    f = fourier(x.astype(float))
    assert np.allclose(total, f.T @ np.concatenate([f, y[:, None]], axis=1))
    v, w = rng.random(30), rng.random(30) + 0.1
    got = np.interp(np.arange(30), *quality_model.isotonic(np.arange(30.0), v, w))
    # the isotonic fit at i is the largest of the least means of the intervals around it
    mean = lambda a, z: float((v[a:z] * w[a:z]).sum() / w[a:z].sum())
    assert np.allclose(got, [max(min(mean(a, z) for z in range(i + 1, 31)) for a in range(i + 1)) for i in range(30)])


# ---------------------------------------------------------------------- op8
def test_mixing_scores_do_not_depend_on_partitions(spark):
    d = queries.table(spark, SF, "documents")
    runs = []
    for n in ("2", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append({r.doc_id: r.score for r in context_mixing.mixing_scores(d, block_bytes=20_000).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0].keys() == runs[1].keys() and max(abs(runs[0][i] - runs[1][i]) for i in runs[0]) < 1e-9


def slow_log10(text: bytes, train: list[bytes], mixer) -> float:
    """One text's score with dictionaries, byte by byte and bit by bit."""
    counts = defaultdict(lambda: [0, 0])
    steps = lambda t: (((b"\n" * 5 + t)[i : i + 5], t[i]) for i in range(len(t)))
    for t in train:
        for before, byte in steps(t):
            for j in range(8):
                for o in range(6):
                    counts[o, before[5 - o :], j, byte >> (8 - j)][(byte >> (7 - j)) & 1] += 1
    total = 0.0
    for before, byte in steps(text):
        for j in range(8):
            ins, gate = [], 0
            for o in range(6):
                n0, n1 = counts.get((o, before[5 - o :], j, byte >> (8 - j)), (0, 0))
                ins.append(math.log((n1 + 0.2) / (n0 + 0.2)) if n0 + n1 else 0.0)
                if n0 + n1:
                    gate = (o + 1) * 5 + sum(n0 + n1 >= s for s in (1, 2, 4, 16, 256)) - 1
            dot = max(min(sum(a * b for a, b in zip([*ins, 0.3], mixer.w[gate], strict=True)), 14), -14)
            at = min(max(dot, -7.99), 7.99) * 2 + 16
            lo = int(at)
            p = (1 / (1 + math.exp(-dot)) + mixer.map[gate][lo] * (1 - at + lo) + mixer.map[gate][lo + 1] * (at - lo)) / 2
            p = min(max(p, 1e-6), 1 - 1e-6)
            total += math.log10(p if (byte >> (7 - j)) & 1 else 1 - p)
    return total


def model_of(texts: list[bytes]):
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, to = context_mixing.coded(data, offs)
    code, n = context_mixing.summed(*context_mixing._distinct(context_mixing.events(text, to), np.ones(len(text), bool)))
    return context_mixing.Model(context_mixing.summed(code & np.uint64(0xFFFFFF), n), code, n)


def test_mixing_equals_a_slow_version_and_sums_to_one():
    rng, words = random.Random(6), ["ab", "abc", "the", "cat", "é", "dog"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))).encode() for _ in range(40)]
    model, mixer = model_of(texts), context_mixing.Mixer()
    noise = np.random.default_rng(1)
    mixer.w = noise.normal(0.2, 0.2, mixer.w.shape)
    mixer.map = np.sort(noise.random(mixer.map.shape), axis=1)
    coded = [t + b"\n" for t in texts]
    for t in (b"the cat abc\n", b"zzz the\n", b"\n", "é é dog\n".encode()):
        code = context_mixing.events(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert context_mixing.log_probabilities(model, mixer, code).sum() == pytest.approx(slow_log10(t, coded, mixer), abs=1e-9)
    for before in (b"\n\n\n\n\n", b"e cat", b"qqqqq"):
        nxt = np.array([int.from_bytes(before + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** context_mixing.log_probabilities(model, mixer, nxt)).sum() == pytest.approx(1)


def test_mixing_learns_word_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["red fish", "blue bird", "old tree"]) for _ in range(30)), "", "") for i in range(60)]
    shuffled = lambda t: " ".join(sorted(t.split()))
    held = [i for i in range(1000, 1300) if context_mixing_held(i)][:10]
    rows += [(i, rows[k][1], "", "") for k, i in enumerate(held[:5])] + [(i, shuffled(rows[k][1]), "", "") for k, i in enumerate(held[5:])]
    out = {r.doc_id: r for r in context_mixing.mixing_scores(stored(spark, rows, tmp_path)).collect()}
    assert sum(out[i].score for i in held[:5]) > 1.5 * sum(out[i].score for i in held[5:]) / 2 and out[held[0]].held_out
    assert all(out[a].score > out[b].score for a, b in zip(held[:5], held[5:], strict=True))
    assert all(out[a].base_score == pytest.approx(out[b].base_score) for a, b in zip(held[:5], held[5:], strict=True))


def context_mixing_held(i: int) -> bool:
    import zlib

    return zlib.crc32(str(i).encode()) % 10 == 0


# --------------------------------------------------------------------- op10
def brute_lines(texts: dict[int, str | None]) -> dict[int, str | None]:
    """Exact fuzzy line dedup at similarity 0.8 over 5-byte shingles."""
    where = defaultdict(list)
    for i, t in sorted(texts.items()):
        for n, line in enumerate((t or "").split("\n")):
            key = line.encode().translate(LOW).strip(b" \t\n\r\x0b\x0c")
            if key:
                where[key].append((i, n))
    keys = list(where)
    sets = {k: {k[j : j + 5] for j in range(len(k) - 4)} for k in keys}
    have, plain = defaultdict(list), Union()
    for k in keys:
        plain.find(k)
        shared = defaultdict(int)
        for g in sets[k]:
            for other in have[g]:
                shared[other] += 1
            have[g].append(k)
        for other, n in shared.items():
            if n * 100 >= (len(sets[k]) + len(sets[other]) - n) * 80:
                plain.join(k, other)
    groups = defaultdict(list)
    for k in keys:
        groups[plain.find(k)] += where[k]
    gone = {p for places in groups.values() for p in sorted(places)[1:]}
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()}


def test_lines_equal_brute_force(spark):
    d = queries.table(spark, SF, "documents")
    want = brute_lines({r.doc_id: r.text for r in d.collect()})
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()}
    lost = sum(got[i] != want[i] for i in want)
    assert lost <= 0.01 * len(want) and any(got[r.doc_id] != r.text for r in d.collect())


def test_band_recall():
    hit = lambda s: (np.random.default_rng(0).random((100_000, line_dedup.HASHES)) < s)[:, line_dedup.PICKS].all(axis=2).any(axis=1).mean()
    assert hit(0.8) > 0.994 and hit(0.9) > 0.9999 and hit(0.05) < 1e-4


def test_lines_of_odd_shapes(spark, tmp_path):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    rows = [("b", long + "\nab\n\n", "x"), ("a", long.upper() + "\n ab \nabcd", "x"), (None, "abcd\nab", "x"), ("a", "abcd", "y"), ("z", "", None)]
    d = stored(spark, rows, tmp_path, "doc_id string, text string, n_lines string")
    out = sorted((str(r.doc_id), r.n_lines, r.n_removed, hashlib.md5(r.text.encode()).hexdigest()[:6], len(r.text)) for r in line_dedup.dedup_lines(d).collect())
    assert [(x[0], x[1], x[2], x[4]) for x in out] in (
        [("None", 2, 2, 0), ("a", 1, 1, 0), ("a", 3, 0, len(long) + 10), ("b", 4, 2, 1), ("z", 1, 0, 0)],
        [("None", 2, 2, 0), ("a", 1, 0, 4), ("a", 3, 1, len(long) + 5), ("b", 4, 2, 1), ("z", 1, 0, 0)],
    )


def few_syllables(rng, n: int) -> str:
    return " ".join("".join(rng.choices(("an", "er", "st", "ion", "wh", "and", "tr", "ou", "the", "re", "se", "ti", "qu", "le"), k=3)) for _ in range(n))


def test_strangers_of_a_band_are_no_candidates():
    rng = random.Random(4)
    lines = [few_syllables(rng, 60) for _ in range(3000)]
    copies = [f"{x[:100]}#{x[103:]}" for x in lines[:40]]
    batches = [pa.RecordBatch.from_arrays([pa.array(["\n".join(part)])], ["text"]) for part in (lines[:1500], lines[1500:] + copies)]
    found = set()
    for b in line_dedup._shared(80)(line_dedup._bands(5, 4)(iter(batches))):
        found |= set(b.column(1).to_pylist())
    name = lambda x: int(common.digests(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x)]))[:, 0].view(np.uint64)[0] >> np.uint64(16))
    near = {name(x) for x in lines[:40] + copies}
    assert near <= found and len(found - near) <= 30


def test_minhash_values_of_a_pair_at_the_threshold_are_alike():
    for pct in (60, 80, 90):
        differ = np.random.default_rng(1).random((200_000, line_dedup.HASHES - line_dedup.ROWS)) < (100 - pct) / 100 * 3 / 4
        assert (differ.sum(axis=1) > line_dedup.most_apart(pct)).sum() <= 3
    rng = random.Random(6)  # pairs of lines at 0.8 and above, as they are in text
    pairs = []
    while len(pairs) < 400:
        a = few_syllables(rng, 40)
        b = "".join("#" if rng.random() < 0.015 else x for x in a)
        x, y = ({t[j : j + 5] for j in range(len(t) - 4)} for t in (a, b))
        if a != b and 0.8 <= len(x & y) / len(x | y) < 0.86:
            pairs.append((a, b))
    for both in pairs:
        raw = np.frombuffer("\n".join(both).encode(), np.uint8)
        cut = len(both[0])
        _, sig = line_dedup.signatures(raw, np.array([0, cut + 1]), np.array([cut, len(raw)]), 5)
        x = sig[0] ^ sig[1]
        assert int(np.bitwise_count((x | x >> np.uint32(1)) & np.uint32(0x55555555)).sum()) <= line_dedup.most_apart(80)


@pytest.mark.parametrize("gram", [5, 8])
def test_sketches_are_sound_and_tell_long_lines_apart(gram):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n)).encode()
    lines = []
    for n in (gram, 30, 200, 900, 1500):
        x = word(n).strip().ljust(gram, b"q")
        lines += [x, x[: n // 2] + b"#" + x[n // 2 :], x[: n * 3 // 4] + word(max(n // 4, gram)), word(n).strip().ljust(gram, b"q")]
    sets = [{x[j : j + gram] for j in range(len(x) - gram + 1)} for x in lines]
    size, sketch = line_dedup.sketches(lines, gram)
    assert size.tolist() == [len(x) for x in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            odd = int(np.bitwise_count((sketch[i, : line_dedup.SKETCH] ^ sketch[j, : line_dedup.SKETCH]).view(np.uint64)).sum())
            assert odd <= len(a ^ b)
            if len(a & b) < 0.65 * len(a | b) and min(len(a), len(b)) > 100:
                assert odd * 180 > (len(a) + len(b)) * 20


# ----------------------------------------------------------------- pipeline
def brute_near(texts: dict[int, str]) -> set[int]:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").encode().translate(LOW).decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    have, plain = defaultdict(list), Union()
    for i in sorted(sets):
        plain.find(i)
        shared = defaultdict(int)
        for g in sets[i]:
            for j in have[g]:
                shared[j] += 1
            have[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                plain.join(i, j)
    return {i for i in sets if plain.find(i) == i}


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = queries.table(spark, SF, "documents")
    path = lambda k: str(tmp_path / f"s{k}")
    stages = [f for _, f in P.STAGES]
    assert len(stages) == 5

    def stage(k, docs):
        stages[k](spark, docs, SF).write.parquet(path(k))
        out = spark.read.parquet(path(k))
        if k < 4:
            assert out.columns == docs.columns
        return out

    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    one = stage(0, docs)
    judged = {r.doc_id for r in queries.op1_quality_rules(spark, SF).where("kept").collect()}
    assert set(texts(one)) == judged and len(judged) > 50
    two = stage(1, one)
    want = brute_lines(texts(one))
    want = {i: t for i, t in want.items() if t == texts(one)[i] or WORD.search(t)}
    got = texts(two)
    assert len(set(got) ^ set(want)) <= 2 and sum(got[i] != want[i] for i in set(got) & set(want)) <= 2
    three = stage(2, two)
    assert set(texts(three)) == brute_near(got)
    four = stage(3, three)
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW).decode())
    windows = set()
    for r in queries.table(spark, SF, "benchmark").collect():
        w = word(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = lambda t: not any(tuple(word(t)[k : k + n]) in windows for n in sizes for k in range(len(word(t)) - n + 1))
    assert texts(four) == {i: t for i, t in texts(three).items() if clean(t)}
    five = stage(4, four)
    lib = Tokenizer.from_file(queries.vocabulary())
    for r in five.collect():
        ids = lib.encode(texts(four)[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts(four)[r.doc_id].encode()).hexdigest()
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(texts(four))


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rng = random.Random(11)
    good = " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 8))) for _ in range(300))
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, good, "en", "s", 1, "x"), (3, good, "en", "s", 1, "x"), (None, good + " more", None, None, None, "x")]
    sf = tmp_path / "sf"
    spark.createDataFrame(rows, schema).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(1, "q a z")], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    assert [r.doc_id for r in P.run(spark, str(sf)).collect()] == [3]
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([(1, "q a z")], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
