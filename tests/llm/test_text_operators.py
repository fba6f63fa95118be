"""op1, op2, op5, op9, op10: edge cases and brute force on small fixtures."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontaminate, line_dedup, quality_rules, queries, repeats
from loomgraph.llm.induced_sort import Queues, sorted_suffixes

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def docs(spark, texts, tmp_path, name="d"):
    """Rows with ids, a null id at the end, and a column that clashes with a result."""
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    path = str(tmp_path / name)
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def empty(spark, tmp_path):
    path = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_quality_base(spark, tmp_path):
    texts = [None, "", "a b c a b c", "x\nx\n\n x\n#$", "one two three one two three four", "é ü" * 40, "w " * 60]
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, texts, tmp_path)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + o for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (r.kept is False or not r.base_failed)
        assert r.text == t
    assert quality_rules.quality_rules(empty(spark, tmp_path), carry=["doc_id"]).count() == 0


def test_other_scripts_references_do_not_count(spark, tmp_path):
    rng = random.Random(3)
    other = ["река", "старый", "город", "вечером", "дорога", "тихий", "берег", "люди", "говорили", "снова", "зимой", "окно"]
    english = ["the", "of", "river", "and", "old", "to", "town", "in", "a", "road", "is", "quiet", "that", "people", "it", "for", "again", "window"]
    text = lambda ws: " ".join(rng.choice(ws) + rng.choice(["", "", ","]) for _ in range(150))
    rows = [(i, text(english), "en", "s", None) for i in range(25)] + [(i, text(other), "ru", "s", None) for i in range(25, 30)]
    rows += [(30, text(other), None, "s", None), (31, text(["#$%&", "@@!!", "0123", "9876"]), "en", "s", None), (32, text(["#$%&", "@@!!", "0123", "9876"]), None, "s", None)]
    path = str(tmp_path / "langs")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    for block in (1000, 1):
        got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.read.parquet(path), ref_block=block, max_repeat_pct=100).collect()}
        assert all(got[i] for i in range(31)) and not got[31] and not got[32]


def test_repeat_words_when_hash_bits_collide(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POS_BITS", 62)  # next to no hash bits: every window collides
    df = spark.createDataFrame([("a b c d a b c",), ("a b c d e f",)], "t string")
    assert [r.n for r in df.select(quality_rules.repeat_words(quality_rules.words_of(F.col("t"))).alias("n")).collect()] == [6, 0]


def naive_hits(text, items, window):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = word(text), set(), set()
    for i, t in items:
        iw = word(t)
        k = min(window, len(iw))
        wins = {tuple(iw[p : p + k]) for p in range(len(iw) - k + 1)} if k else set()
        for p in range(len(w) - k + 1) if k else ():
            if tuple(w[p : p + k]) in wins:
                hit |= set(range(p, p + k))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontaminate(spark, tmp_path, block_bytes):
    rng = random.Random(4)
    vocab = ["aa", "b", "Cc", "dé", "7", "e"]
    texts = [None, "", "!!", " ".join(rng.choice(vocab) for _ in range(200)), "Aa, b-cc.", "aa aa b"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    items = [(1, "aa b cc"), (10, "b"), (2, None), (3, "--"), (4, "dé 7 e aa b cc dé 7"), (5, "aa b cc")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts, tmp_path)
    out = {r.doc_id: r for r in decontaminate.decontaminate(d, bench, window=3, block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        n, hit, found = naive_hits(t, items, 3)
        assert (out[i].n_words, out[i].n_hit, out[i].item_ids, out[i].contaminated) == (n, hit, found, hit > 0)
    assert [(s.start, s.end) for s in out[4].spans] == [(0, 8)]
    assert not decontaminate.decontaminate(d, bench.limit(0)).where("contaminated").count()
    assert decontaminate.decontaminate(empty(spark, tmp_path), bench).count() == 0


def test_bpe_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(3)
    al = ["a", "b'", "'s", " ", "  ", "\n", "\t", " ", "　", "é", "漢", "😀", "12", ".", "!!", "\x1c", "\x0b", "<|endoftext|>", "the", "à", "\x00", "\x85"]
    texts = [None, "", "x" * 3000, "ab" * 2000 + " à b"] + ["".join(rng.choice(al) for _ in range(rng.randint(0, 15))) for _ in range(400)]
    d = docs(spark, texts, tmp_path)
    enc = bpe.encode(d, path)
    out = {r.doc_id: r for r in bpe.decode(enc, path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert out[i].token_ids == ids and out[i].decoded == lib.decode(ids, skip_special_tokens=False) == (t or "")
    own = bpe.ByteBPE(path)
    own.core = None  # the merges in Python give the same
    assert [own.encode(t) for t in texts[:120]] == [out[i].token_ids for i in range(120)]
    assert own.decode([10**9, 0]) == "!" and bpe.encode(empty(spark, tmp_path), path).count() == 0


@pytest.mark.parametrize("memory", [0, 64, 1 << 20])
@pytest.mark.parametrize("depth", [5, 1000])
def test_induced_sort(memory, depth):
    import numpy as np

    rng = random.Random(memory + depth)
    for _ in range(300):
        s = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(1, 50))]
        s += s[: rng.choice([0, 0, 20])]
        got = np.concatenate(list(sorted_suffixes(np.array(s, np.uint16), depth, memory)))
        pos, lcp = got["pos"].tolist(), got["lcp"].tolist()
        assert sorted(pos) == list(range(len(s)))
        assert [s[i : i + depth] for i in pos] == sorted((s[i : i + depth] for i in range(len(s))), reverse=True)
        for a, b, n in zip(pos, pos[1:], lcp[1:], strict=False):
            k = 0
            while k < min(depth, len(s) - max(a, b)) and s[a + k] == s[b + k]:
                k += 1
            assert k == n


def test_a_shard_larger_than_its_memory_spills(monkeypatch):
    import numpy as np

    spilled = []
    monkeypatch.setattr(Queues, "close", lambda q, close=Queues.close: spilled.append(q.spilled) or close(q))
    rng = random.Random(1)
    p = bytes(rng.randrange(97, 123) for _ in range(700))
    raws = [bytes(rng.randrange(97, 123) for _ in range(30_000)) + bytes([i]) + p + bytes([i]) + bytes(rng.randrange(97, 123) for _ in range(500)) for i in range(4)]
    seg, start = repeats.shard_repeats(raws, 400, 10_000)
    assert {(int(a), int(b)) for a, b in zip(seg, start, strict=True)} == {(i, 30_001 + k) for i in range(4) for k in range(301)}
    assert sum(spilled) > 10 * 10_000 and np.all(np.diff(seg) >= 0)


@pytest.mark.parametrize("hot", [64 << 20, 500])
def test_repeats(spark, tmp_path, hot):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    p, q = word(900), word(500)
    texts = [None, "", p, word(50) + p[100:700] + word(60), p, q + word(10) + q, "x" * 1000, "ab" * 600, word(399), word(2000), q[:399]]
    d = docs(spark, texts, tmp_path)
    out = {r.doc_id: r for r in repeats.remove_repeats(d, hot_bytes=hot).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
        r = out[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want
    assert repeats.remove_repeats(empty(spark, tmp_path)).count() == 0


def test_line_dedup(spark, tmp_path):
    base = "The quick brown fox jumps over the lazy dog near the old river bank, while two herons stand and watch the slow water pass"
    texts = [None, "", base + "\nshort\n\n" + base, "  " + base.upper() + " \nother unrelated line of words", base.replace("quick", "quack") + "\nshort", "x\n\n"]
    d = docs(spark, texts, tmp_path)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert [out[i].text for i in range(6)] == [None, "", base + "\nshort\n", "other unrelated line of words", "", "x\n\n"]
    assert [out[i].n_removed for i in range(6)] == [0, 0, 1, 1, 2, 0]
    assert line_dedup.dedup_lines(empty(spark, tmp_path)).count() == 0


def test_line_dedup_of_short_edited_lines(spark, tmp_path):
    rng = random.Random(5)
    texts = []
    for i in range(120):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice([50, 56, 62, 68, 96, 110, 130]))).strip().ljust(49, "q")
        at = [len(line) // 2] if len(line) < 90 else [len(line) // 3, 2 * len(line) // 3]
        texts += [line, "".join("#" if j in at else x for j, x in enumerate(line)), "".join("#" if j % 9 == 4 else x for j, x in enumerate(line))]
    sets = [{t[j : j + 5] for j in range(len(t) - 4)} for t in texts]
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 100 >= len(sets[i] | sets[j]) * 80:
                a, b = first[i], first[j]
                first = [min(a, b) if x in (a, b) else x for x in first]
    want = [t if first[i] == i else "" for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts, tmp_path)).collect()}
    assert want.count("") >= 100 and [got[i] for i in range(len(texts))] == want
