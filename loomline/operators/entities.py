"""Entity resolution: blocked pairs, clusters, their tiers and canonical members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.scalars import fold, name_tokens
from loomline.operators.components import connected_components
from loomline.storage import Scratch


def initials_fit(x: Column, y: Column) -> Column:
    """Equal, or one is the other's initial."""
    return (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))


def pair_tier(a: Column, b: Column) -> Column:
    """high, medium or null for two token arrays of one last token."""
    middle = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))
    ma, mb = middle(a), middle(b)
    middles = (F.size(ma) == 0) | (F.size(mb) == 0) | ((F.size(ma) == F.size(mb)) & F.forall(F.zip_with(ma, mb, initials_fit), lambda x: x))
    first_a, first_b = F.get(a, 0), F.get(b, 0)
    full = (F.length(first_a) > 1) & (first_a == first_b)
    fits = (F.size(a) >= 2) & (F.size(b) >= 2) & initials_fit(first_a, first_b)
    return F.when(fits, F.when(full & middles, "high").otherwise("medium"))


def named(native: Column) -> Column:
    """A native name; an empty one is none."""
    return F.when(native != "", native)


def last_of(tokens: Column) -> Column:
    return F.get(tokens, F.size(tokens) - 1)


def candidate_pairs(names: DataFrame) -> DataFrame:
    """Pairs (a, b, tier) of names(id, tokens, native) that share the last token or the native name.

    Names are first reduced to distinct token sequences, so copies of one name meet
    once and are linked to their first id.  First tokens that fit share their first
    letter, so blocks are of that and the last token; a block that many names share is
    split by adaptive execution.
    """
    whole = names.filter("size(tokens) >= 2")
    same = whole.groupBy("tokens").agg(F.min("id").alias("id"))
    copies = whole.join(same.withColumnRenamed("id", "a"), "tokens").select("a", F.col("id").alias("b"), pair_tier(F.col("tokens"), F.col("tokens")).alias("tier")).filter("a <> b")
    block = same.select("id", "tokens", last_of(F.col("tokens")).alias("last"), F.substring(F.get("tokens", 0), 1, 1).alias("letter"))
    one, other = block.select("last", "letter", F.col("id").alias("x"), F.col("tokens").alias("tx")), block.select("last", "letter", F.col("id").alias("y"), F.col("tokens").alias("ty"))
    pairs = one.join(other, ["last", "letter"]).filter("x < y").withColumn("tier", pair_tier(F.col("tx"), F.col("ty"))).filter("tier is not null")
    linked = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "tier")
    written = names.withColumn("native", named(F.col("native"))).filter("native is not null")
    native = written.join(written.groupBy("native").agg(F.min("id").alias("a")), "native").select("a", F.col("id").alias("b")).filter("a <> b")
    return linked.unionByName(copies).unionByName(native.withColumn("tier", F.lit("high")))


def name_links(names: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same names as ``candidate_pairs``, in rows linear in the names.

    Names of one last and one first token form a star around their smallest id.  An
    initial fits every first token of its letter, so where a surname has one, the stars
    of that letter are linked to the smallest of their ids.  Names of one native name
    form a star too.
    """
    whole = names.filter("size(tokens) >= 2").select("id", last_of(F.col("tokens")).alias("last"), F.get("tokens", 0).alias("first"))
    stars = whole.groupBy("last", "first").agg(F.min("id").alias("a"))
    own = whole.join(stars, ["last", "first"]).select("a", F.col("id").alias("b"))
    letter = stars.withColumn("letter", F.substring("first", 1, 1))
    tops = letter.groupBy("last", "letter").agg(F.min("a").alias("top"), F.max(F.length("first") == 1).alias("initial")).filter("initial")
    between = letter.join(tops, ["last", "letter"]).select(F.col("top").alias("a"), F.col("a").alias("b"))
    written = names.withColumn("native", named(F.col("native"))).filter("native is not null")
    native = written.join(written.groupBy("native").agg(F.min("id").alias("a")), "native").select("a", F.col("id").alias("b"))
    return own.unionByName(between).unionByName(native).filter("a <> b")


def tokens_of(names: DataFrame, id_col: str, name_col: str, native_col: str | None = None, sources: str | None = None) -> DataFrame:
    return names.select(
        F.col(id_col).alias("id"), name_tokens(fold(F.col(name_col))).alias("tokens"), (F.col(native_col) if native_col else F.lit(None).cast("string")).alias("native"),
        (F.size(sources) if sources else F.lit(0)).alias("n_sources"),
    )


def _unlike(placed: DataFrame) -> DataFrame:
    """(component) of those in which some two names aren't a high pair, told by counts: no pair is made.

    All names need two tokens, one last and one full first token; the middles that
    aren't empty need one length, and at each of their places one full word and its
    initial at most.
    """
    tokens, first = F.col("tokens"), F.get("tokens", 0)
    middle = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    whole = placed.groupBy("component").agg(
        (F.min(F.size(tokens)) < 2).alias("short"), F.min(last_of(tokens)).alias("l1"), F.max(last_of(tokens)).alias("l2"), F.min(first).alias("f1"), F.max(first).alias("f2"),
        F.min(F.when(F.size(middle) > 0, F.size(middle))).alias("m1"), F.max(F.size(middle)).alias("m2"),
    ).filter("short or l1 <> l2 or f1 <> f2 or length(f1) < 2 or m1 <> m2 and m2 > 0")
    word, initial = F.when(F.length("word") > 1, F.col("word")), F.when(F.length("word") == 1, F.col("word"))
    places = placed.select("component", F.posexplode(middle).alias("at", "word")).groupBy("component", "at").agg(F.min(word).alias("w1"), F.max(word).alias("w2"), F.min(initial).alias("i1"), F.max(initial).alias("i2"))
    return whole.select("component").union(places.filter("w1 <> w2 or i1 <> i2 or left(w1, 1) <> i1").select("component")).distinct()


def clusters(names: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, cluster, tier, canonical) for every member of a cluster of names(id, tokens, native, n_sources).

    A cluster is high if every pair of its members is, by their names or by one native
    name; counts tell which clusters are so by names alone, and only others in which a
    native name stands are looked at pair by pair of their distinct (tokens, native).
    The canonical member, of high clusters only, has most tokens, then most sources,
    then the largest id.  Membership is rows, so a cluster of any size is no single value.
    """
    scratch = scratch or Scratch(names.sparkSession)
    names = scratch.cut(names.withColumn("native", named(F.col("native"))), "names")
    found = connected_components(name_links(names), scratch)
    placed = scratch.cut(names.join(found, "id"), "placed")
    unlike = scratch.cut(_unlike(placed), "unlike")
    kinds = placed.join(unlike, "component", "left_semi").groupBy("component", "tokens", "native").agg(F.count("*").alias("n"))
    by_native = kinds.filter("native is not null").select("component").distinct()
    kinds = kinds.join(by_native, "component", "left_semi").withColumn("__k", F.struct("tokens", "native"))
    one, other = kinds.select("component", F.col("__k").alias("x"), F.col("n").alias("nx")), kinds.select("component", F.col("__k").alias("y"))
    same_last = last_of(F.col("x.tokens")) == last_of(F.col("y.tokens"))
    good = F.coalesce(same_last & (pair_tier(F.col("x.tokens"), F.col("y.tokens")) == "high"), F.lit(False)) | F.coalesce(F.col("x.native") == F.col("y.native"), F.lit(False))
    clash = one.join(other, "component").filter((F.col("x") < F.col("y")) | (F.col("x").eqNullSafe(F.col("y")) & (F.col("nx") > 1))).filter(~good).select("component").distinct()
    bad = unlike.join(by_native, "component", "left_anti").union(clash).distinct().withColumn("medium", F.lit(True))
    best = placed.groupBy("component").agg(F.max_by("id", F.struct(F.size("tokens"), "n_sources", "id")).alias("best")).join(bad, "component", "left")
    high = F.col("medium").isNull()
    return placed.join(best, "component").select("id", F.col("component").alias("cluster"), F.when(high, "high").otherwise("medium").alias("tier"), F.when(high, F.col("best")).alias("canonical"))


def listed(members: DataFrame) -> DataFrame:
    """One row per cluster with its sorted members, for a review queue of small clusters."""
    return members.groupBy("cluster", "tier", "canonical").agg(F.array_sort(F.collect_list("id")).alias("members"))
