"""Quality rules: base counts and distribution divergence, native expressions only.

A document's histograms over character classes and over common words are held
against the references of the languages by Jensen-Shannon distance (the square
root of the base-2 divergence, 0 to 1); the nearest language counts, as stated
languages can be wrong.  References are the summed histograms of all documents
of a language that pass the base rules and the length guards; a language needs
``min_ref_docs`` of them.  A document whose stated language has no reference,
or that states none, is held against the references of like script only (told by
the UTF-8 bytes a character), and keeps the base verdict where there is none:
other scripts say nothing about it.  With no such language the sum over all
documents is the reference, if alike.  With more than ``max_langs`` languages a document
is held against its stated language's reference only, by a join.  Documents
below a guard are too short for that comparison and keep the base verdict.

Edge cases: null text has no words and fails the base rules; a table whose
documents all fail them has no reference, and then no distance is judged.
Extra columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, with_row_id

WS = r"[\x20\x09-\x0D]"
#: The most common short words of four languages, one histogram bin each.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "nicht"],
    "es": ["el", "y", "los", "se", "del", "las", "por", "con", "una", "para"],
}
BINS = [w for ws in COMMON_WORDS.values() for w in ws]
N_CLASS = 6
#: Positions fit in this many low bits of a packed sort key.
POS_BITS = 20
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_class", "js_words", "kept")


def count_class(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{WS}+"), "")


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more.

    Windows are sorted as packed (hash bits, position) longs, a primitive sort;
    neighbours of equal bits are compared word by word.  Only where unequal
    windows share their bits, or positions do not fit, are the words sorted.
    """
    mask = (1 << POS_BITS) - 1

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def exact(ws: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", ws[i], ws[i + 1], ws[i + 2])
        rows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            near = lambda i: F.coalesce(F.get(s, i)["g"], F.lit(""))
            return F.transform(F.filter(s, lambda x, i: (near(i - 1) == x["g"]) | (near(i + 1) == x["g"])), lambda x: x["i"])

        return let(rows, lambda s: covered(flagged(s)))

    def packed(ws: Column) -> Column:
        keys = F.sort_array(
            F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
        )
        place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

        def near(k: Column) -> Column:
            same = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(~mask)) == 0, F.lit(False))
            twins = F.filter(k, lambda x, i: same(F.get(k, i - 1), x) | same(F.get(k, i + 1), x))
            # among the twins, a neighbour with the same bits but other words is a collision
            odd = lambda a, b: (ws[a] != ws[b]) | (ws[a + 1] != ws[b + 1]) | (ws[a + 2] != ws[b + 2])

            def judged(t: Column) -> Column:
                clash = F.exists(
                    F.sequence(F.lit(1), F.size(t) - 1), lambda i: same(F.get(t, i - 1), F.get(t, i)) & odd(place(F.get(t, i - 1)), place(F.get(t, i)))
                )
                return F.when(F.size(t) == 0, F.lit(0)).when(clash, exact(ws)).otherwise(covered(F.transform(t, place)))

            return let(twins, judged)

        return let(keys, near)

    def any_size(ws: Column) -> Column:
        return F.when(F.size(ws) < 4, F.lit(0)).when(F.size(ws) > mask, exact(ws)).otherwise(packed(ws))

    return let(words, any_size).cast("long")


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """The base counts, and the raw histograms __class (array of N_CLASS) and __bins."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    line_word = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rare = F.regexp_replace(t, r"[a-z\x00-\x20\x7F-\x{10FFFF}]+", "")
    df = docs.withColumns({"__w": words_of(t), "__rare": rare})
    n, w = F.length(t).cast("long"), F.col("__w")
    common = F.array(*[F.lit(x) for x in BINS])
    at = F.transform(F.filter(w, lambda x: x.isin(BINS)), lambda x: F.array_position(common, x).cast("int"))
    counts = let(at, lambda h: F.array(*[(F.size(h) - F.size(F.array_remove(h, i + 1))).cast("long") for i in range(len(BINS))], (F.size(w) - F.size(h)).cast("long")))
    left = lambda drop: F.length(F.regexp_replace("__rare", drop, "")).cast("long")
    df = df.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        let(line_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        left("[^A-Z]+").alias("__up"),
        left("[^0-9]+").alias("__num"),
        F.length("__rare").cast("long").alias("__seen"),
        (F.octet_length(t) - n).cast("long").alias("__wide"),
        n.alias("__n"),
        counts.alias("__bins"),
    )
    c = F.col
    space = c("__n") - c("word_chars")
    mark = c("__seen") - c("__up") - c("__num")
    # UTF-8 bytes beyond one a character stand for the share of other scripts and accents
    classes = F.array(c("__n") - c("__seen") - space, c("__up"), c("__num"), mark, space, c("__wide"))
    return df.withColumn("__class", classes).drop("__up", "__num", "__seen", "__wide")


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two distributions of like length."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return half(p) + half(q)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def script(wide: Column, chars: Column) -> Column:
    """0 to 2: about how many bytes a character has beyond one."""
    return F.when(wide * 4 < chars, 0).when(wide * 4 < chars * 5, 1).otherwise(2)


def _gaps(own: Column, known: Column, gap_to) -> Column:
    return let(own, lambda v: F.transform(known, gap_to(v)))


def _less(new: Column, old: Column) -> Column:
    return let(new, lambda x: F.struct(F.least(x["any"], old["any"]).alias("any"), F.least(x["like"], old["like"]).alias("like")))


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    carry: list[str] | None = None,
    min_words: int = 50,
    max_repeat_pct: int = 50,
    min_class_chars: int = 200,
    min_common_words: int = 100,
    max_js_class: float = 0.3,
    max_js_words: float = 0.275,
    min_ref_docs: int = 20,
    ref_block: int = 1000,
) -> DataFrame:
    """``docs`` plus the base counts, base_failed, js_class, js_words (null below
    their guards and with no reference) and kept.

    The text is read once; counts and histograms go to a scratch table from
    which the references are summed.  ``carry`` names the columns wanted beside
    the results (they ride along in that table); by default all of ``docs`` are
    joined back by row.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    scratch = Scratch(docs.sparkSession)
    # without the join back the numbers are never used
    src = with_row_id(docs.select(*own), scratch) if carry is None else docs.select(*own, F.lit(0).cast("long").alias("__rid"))
    side = [c for c in (carry or []) if c in own]
    need = list(dict.fromkeys([*side, *[c for c in (lang_col,) if c in own]]))
    df = with_counts(src.select("__rid", *dict.fromkeys([*need, text_col])), text_col)
    w = F.col("n_words")
    df = df.withColumn("base_failed", (w < min_words) | (F.col("n_repeat_words") * 100 > w * max_repeat_pct))
    df = scratch.table(df if text_col in side else df.drop(text_col))
    lang = F.col(lang_col) if lang_col in own else F.lit(None).cast("string")
    n_bins = len(BINS) + 1
    sums = (
        df.where(~F.col("base_failed") & (w >= min_common_words) & (F.col("__n") >= min_class_chars))
        .groupBy(lang.alias("__lang"))
        .agg(
            F.count("*").alias("__docs"),
            *[F.sum(F.col("__class")[i]).alias(f"c{i}") for i in range(N_CLASS)],
            *[F.sum(F.col("__bins")[i]).alias(f"b{i}") for i in range(n_bins)],
        )
    )
    sums = scratch.table(sums)
    total = sums.agg(*[F.sum(x).alias(x) for x in sums.columns if x != "__lang"]).first().asDict()
    sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, y: s + y)
    share = lambda a: let(a, lambda v: F.transform(v, lambda x: x / sum_of(v)))
    refs = sums.where(F.col("__lang").isNotNull() & (F.col("__docs") >= min_ref_docs)).select(
        "__lang", share(F.array(*[f"c{i}" for i in range(N_CLASS)])).alias("__rc"), share(F.array(*[f"b{i}" for i in range(n_bins)])).alias("__rb")
    )
    def whole(prefix: str, n: int) -> Column:
        vals = [total.get(f"{prefix}{i}") or 0 for i in range(n)]
        s = sum(vals)
        return F.array(*[F.lit(v / s) for v in vals]) if s else F.lit(None).cast("array<double>")

    lit = lambda v: F.array(*[F.lit(x) for x in v])
    level = lambda r: script(r[N_CLASS - 1], F.lit(1.0) - r[N_CLASS - 1])
    entry = lambda r, rc: F.struct(r.alias("ref"), level(rc).alias("script"))
    mine = script(F.col("__class")[N_CLASS - 1], F.col("__n"))
    parts = (("class", "__rc", N_CLASS, F.col("__n") >= min_class_chars), ("bins", "__rb", n_bins, w >= min_common_words))

    def nearer(df: DataFrame, ref: dict[str, Column], stated: Column) -> DataFrame:
        """Least distances so far to any reference and to those of like script, and whether the
        stated language is among them."""
        cols = {"__stated": F.col("__stated") | stated}
        for own, name, _, guard in parts:
            old, known = F.col(f"__near_{own}"), ref[name]
            gap_to = lambda v: lambda r: F.struct(r["script"].alias("s"), distance(v, r["ref"]).alias("d"))
            gaps = _gaps(share(F.col(f"__{own}")), known, gap_to)
            least = let(gaps, lambda g: F.struct(F.array_min(g["d"]).alias("any"), F.array_min(F.filter(g, lambda x: x["s"] == mine)["d"]).alias("like")))
            cols[f"__near_{own}"] = F.when(guard, _less(least, old))
        return df.withColumns(cols)

    none = F.lit(None).cast("struct<any:double,like:double>")
    df = df.withColumns({"__stated": F.lit(False), "__near_class": none, "__near_bins": none})
    # every document is held against every reference, a block of them at a time
    block, n_refs = [], 0
    for r in [*refs.toLocalIterator(), None]:
        if r is not None:
            block.append(r)
            n_refs += 1
        if block and (r is None or len(block) == ref_block):
            if n_refs > len(block):
                df = scratch.table(df)
            here = {name: F.array(*[entry(lit(x[name]), lit(x["__rc"])) for x in block]) for _, name, _, _ in parts}
            df = nearer(df, here, F.coalesce(lang.isin([x["__lang"] for x in block]), F.lit(False)))
            block = []
    if not n_refs:
        df = nearer(df, {name: F.array(entry(whole(name[3:], n), whole("c", N_CLASS))) for _, name, n, _ in parts}, F.lit(False))
    pick = lambda own: F.when(F.col("__stated"), F.col(f"__near_{own}.any")).otherwise(F.col(f"__near_{own}.like"))
    js_class, js_words = pick("class"), pick("bins")
    df = df.select("__rid", *side, *RESULTS[:6], js_class.alias("js_class"), js_words.alias("js_words")).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("js_class") <= max_js_class, F.lit(True)) & F.coalesce(F.col("js_words") <= max_js_words, F.lit(True))
    )
    if carry is not None:
        return df.drop("__rid")
    return src.join(df, "__rid").drop("__rid")
