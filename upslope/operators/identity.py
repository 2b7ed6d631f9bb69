"""Duplicate profiles, precedence, collapse of repeated records and evidence classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from upslope.operators.graph import connected_components


# The names by which an event is run by a team.
_RELAY = r"^\s*4x|relay|medley|^\s*[ds]mr\s*$"


def is_relay(event: Column) -> Column:
    """Whether an event is run by a team; null is not."""
    return F.coalesce(F.lower(event).rlike(_RELAY), F.lit(False))


def row_signature(*columns: Column) -> Column:
    """md5 of the columns' texts, told apart by the unit separator; null counts as empty."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def duplicate_pairs(rows: DataFrame, profile: str, name: str, group: str, signature: Column, min_shared: int = 2, min_share: float = 0.25, max_profiles: int | None = 20, block: int = 256) -> DataFrame:
    """Pairs of profiles of one name that share signatures, with a confidence.

    A signature that more than ``max_profiles`` profiles of a name hold says nothing about identity and is left out;
    with None every shared signature counts.  Holders of one signature are cut into blocks of about ``block``
    profiles and joined block by block, so a common signature is dealt over many tasks.
    """
    sig = rows.select(F.col(profile).alias("p"), F.col(name).alias("nm"), F.col(group).alias("g"), signature.alias("s")).where("s is not null").distinct()
    sizes = sig.groupBy("p").agg(F.count_distinct("s").alias("size"), F.min("g").alias("g"))
    common = F.col("c") >= 2 if max_profiles is None else F.col("c").between(2, max_profiles)
    shared = sig.groupBy("nm", "s").agg(F.count_distinct("p").alias("c")).where(common).select("nm", "s", F.ceil(F.col("c") / block).alias("blocks"))
    held = sig.join(shared, ["nm", "s"]).select("nm", "s", "p", "blocks", F.pmod(F.xxhash64("p"), "blocks").alias("own")).distinct()
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("nm", "s", "p", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    a, b = met.alias("a"), met.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("nm", "s", "lo", "hi")]
    once = (F.col("a.lo") == F.col("a.hi")) | (F.col("a.own") != F.col("b.own"))
    pairs = a.join(b, same[0] & same[1] & same[2] & same[3] & (F.col("a.p") < F.col("b.p")) & once)
    pairs = pairs.groupBy(F.col("a.p").alias("left"), F.col("b.p").alias("right")).agg(F.count_distinct("a.s").alias("shared"))
    l, r = sizes.select(F.col("p").alias("left"), F.col("size").alias("ls"), F.col("g").alias("lg")), sizes.select(F.col("p").alias("right"), F.col("size").alias("rs"), F.col("g").alias("rg"))
    out = pairs.join(l, "left").join(r, "right").withColumn("share", F.col("shared") / F.least("ls", "rs"))
    high = F.col("lg").eqNullSafe(F.col("rg")) & (F.col("shared") >= min_shared) & (F.col("share") >= min_share)
    return out.select("left", "right", "shared", "share", F.when(high, "high").otherwise("low").alias("confidence"))


def canonical_ids(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(profile, canonical): the smallest profile each one is linked to."""
    return connected_components(pairs, left, right).select(F.col("node").alias("profile"), F.col("component").alias("canonical"))


def by_precedence(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Value of the first source, in the order given, that has the key; smallest value within a source."""
    tagged = [s.select(key, value, F.lit(i).alias("precedence")) for i, s in enumerate(sources, 1)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    w = W.partitionBy(key).orderBy("precedence", value)
    return every.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def collapse_repeats(df: DataFrame, key: str, flag: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a key that differ only in a flag become one with the flags or-ed; other differences are conflicts.

    Returns (collapsed, conflicts): the first row of each agreeing key and (key, variants) of the others.
    """
    rest = [c for c in df.columns if c not in (key, flag)]
    content = F.struct(*rest)
    groups = df.groupBy(key).agg(F.count_distinct(content).alias("variants"), F.bool_or(flag).alias("__flag"), F.count("*").alias("copies"))
    first = df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r", flag)
    good = first.join(groups.where("variants = 1").select(key, F.col("__flag").alias(flag), "copies"), key)
    return good, groups.where("variants > 1").select(key, "variants")


def evidence_class(df: DataFrame, keys: list[str], team: str, school: str) -> DataFrame:
    """Whether the non-blank teams and schools of a key agree, with representative and list."""
    t, s = F.nullif(F.trim(team), F.lit("")), F.nullif(F.trim(school), F.lit(""))
    g = df.select(*keys, t.alias("__t"), s.alias("__s")).groupBy(*keys).agg(
        F.count_distinct("__t").alias("teams"), F.count_distinct("__s").alias("schools"), F.min("__t").alias("team"), F.nullif(F.array_join(F.sort_array(F.collect_set("__s")), "|"), F.lit("")).alias("school_list")
    )
    c = F.when((F.col("teams") == 0) & (F.col("schools") == 0), "none").when(F.col("teams") == 1, "consistent_team").when(F.col("schools") == 1, "consistent_school_multiple_teams").otherwise("mixed")
    return g.withColumn("evidence", c)


def overlay(df: DataFrame, exceptions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Reviewed values replace a row's own where an exception exists; ``reviewed`` says where."""
    e = exceptions.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = df.join(e, F.col(key) == F.col("__k"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    return out.withColumn("reviewed", F.col("__k").isNotNull()).drop("__k", *(f"__{c}" for c in columns))


def match_names(left: DataFrame, registries: list[DataFrame], key: str, group: str, entity: str) -> DataFrame:
    """Entity of each name from the first registry with its key; groups must agree where both are known."""
    tagged = [r.select(F.col(key).alias("__k"), F.col(group).alias("__g"), F.col(entity), F.lit(i).alias("precedence")) for i, r in enumerate(registries, 1)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    agree = F.col(group).isNull() | F.col("__g").isNull() | (F.col(group) == F.col("__g"))
    hits = left.join(every, (F.col(key) == F.col("__k")) & agree, "left")
    keys = left.columns
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("precedence").asc_nulls_last(), F.col(entity)))
    return hits.withColumn("__r", best).where("__r = 1").drop("__r", "__k", "__g")
