"""Components of a similarity graph from shared bucket keys, without all pairs.

Two items can be similar only if they share a key.  Keys with the same members are
one.  A key's members are held against one leader (a star, linear in the group): the
member of the highest score, which most others resemble, as an original among its
edited copies.  What that links is contracted by a union-find, and members of one
component are never compared again.  Where a star links little of what it asked,
or few pairs are left, the pairs of a key that still lie in different components are
compared in full, so no link between components is lost.  Shapes (sizes and sketches)
rule pairs out inside the join, before any content is shipped; they lose none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Keys with so few open pairs for each member are compared in full at once.
FEW = 2
#: A star that links a smaller share of the pairs it asked about is the last one.
LEAST_SHARE = 0.3


def link_components(
    buckets: DataFrame,
    shapes: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    may_match: Callable[[Column, Column], Column],
    scratch: Scratch,
) -> DataFrame | None:
    """buckets: (key, id, score), distinct.  shapes: (id, n), n a struct for ``may_match``.
    verify: pairs (a, b) to links (src, dst).  Returns (id, comp) of linked ids."""
    sets = buckets.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    keys = sets.where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")
    state = scratch.table(buckets.join(keys, "key").select("key", "id", "score", F.col("id").alias("comp"), F.lit(False).alias("done")))
    labels, last = None, False
    of = lambda name, at: shapes.select(F.col("id").alias(name), F.col("n").alias(at))
    while True:
        each = state.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("q"))
        size = each.agg(F.sum("c").alias("rows"), F.sum((F.col("c") * F.col("c") - F.col("q")) / 2).alias("pairs")).first()
        if not size["pairs"]:
            return labels
        full = last or size["pairs"] <= FEW * size["rows"]
        if full:
            one = state.join(shapes, "id").select("key", "id", "comp", "n")
            two = one.select("key", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))
            pairs = one.join(two, "key").where((F.col("a") < F.col("id")) & (F.col("ca") != F.col("comp")) & may_match(F.col("na"), F.col("n")))
            pairs = pairs.select("a", F.col("id").alias("b")).distinct()
        else:
            lead = state.groupBy("key").agg(F.max(F.struct((~F.col("done")).alias("f"), "score", (-F.col("id")).alias("o"), "comp")).alias("x"))
            lead = scratch.table(lead.select("key", (-F.col("x.o")).alias("a"), F.col("x.comp").alias("ca")))
            pairs = state.join(lead, "key").where(F.col("ca") != F.col("comp")).select(F.col("a"), F.col("id").alias("b")).distinct()
            pairs = pairs.join(of("a", "na"), "a").join(of("b", "nb"), "b").where(may_match(F.col("na"), F.col("nb"))).select("a", "b")
        pairs = scratch.table(pairs)
        links = scratch.table(verify(pairs))
        found = links.count()
        if found:
            if labels is not None:
                at = lambda name: labels.select(F.col("id").alias(name), F.col("comp").alias(f"{name}_"))
                links = links.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(F.coalesce("src_", "src").alias("src"), F.coalesce("dst_", "dst").alias("dst"))
            above = connected_components(links, scratch)
            if labels is None:
                labels = scratch.table(above)
            else:
                known = labels.join(above.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
                labels = scratch.table(known.unionByName(above.join(labels, "id", "left_anti")))
        if full:
            return labels
        last = found < LEAST_SHARE * max(pairs.count(), 1)
        rest = state.join(lead, "key")
        if labels is not None:
            rest = rest.drop("comp", "ca").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            rest = rest.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").withColumn("ca", F.coalesce("ca", "a"))
        rest = rest.select("key", "id", "score", "comp", (F.col("done") | (F.col("comp") == F.col("ca"))).alias("done"))
        again = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        before, state = state, scratch.table(rest.join(again, "key"))
        scratch.drop(before)
