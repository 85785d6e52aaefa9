"""Majority votes and lineages on a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RANK_PREFIX
from .lineage import cut
from .skew import salted_join


#: Votes that one task counts.
VOTES = 1 << 20


def resolve_merged(df: DataFrame, merged: DataFrame, taxid: str = "taxid") -> DataFrame:
    """Replace ids that have been merged into others."""
    lookup = merged.select(F.col("old").alias(taxid), F.col("new").alias("_new"))
    return df.join(lookup, taxid, "left").withColumn(
        taxid, F.coalesce("_new", taxid)
    ).drop("_new")


def ancestors(nodes: DataFrame) -> DataFrame:
    """Every (taxid, ancestor, distance), the taxon itself at distance 0.

    Paths are doubled each round until no longer one appears, so a tree of depth 40 takes six
    joins. The root is its own parent or has none; any other cycle is an error.
    """
    self_rows = nodes.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("distance"))
    step = nodes.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("taxid"))).select(
        "taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")
    )
    paths, reach = cut(step), 1
    while True:
        longer = (
            paths.where(F.col("distance") == reach)
            .select("taxid", F.col("ancestor").alias("_mid"))
            .join(paths.select(F.col("taxid").alias("_mid"), "ancestor", "distance"), "_mid")
            .select("taxid", "ancestor", (F.col("distance") + reach).alias("distance"))
        )
        longer = cut(longer)
        if longer.isEmpty():
            return cut(self_rows.unionByName(paths))
        if not longer.where(F.col("taxid") == F.col("ancestor")).isEmpty():
            raise ValueError("the parents of the taxa form a cycle")
        paths, reach = paths.unionByName(longer), reach * 2


def majority_lca(
    hits: DataFrame, closure: DataFrame, key: str, fraction: float = 0.6
) -> DataFrame:
    """Deepest taxon found in more than ``fraction`` of the hit lineages of each key.

    Hits are counted per key and taxon before the lineages are attached, so a taxon hit by very
    many windows is one row per key; the join is salted for taxa common to many keys. A row becomes
    as many votes as its lineage is long, so votes are dealt by their number, not by the size of the
    rows before.
    """
    counts = cut(hits.groupBy(key, "taxid").agg(F.count(F.lit(1)).alias("_n")))
    longest = (closure.agg(F.max("distance").alias("m")).first()["m"] or 0) + 1
    parts = min(max(32, -(-counts.count() * longest // VOTES)), 1 << 14)
    totals = counts.groupBy(key).agg(F.sum("_n").alias("n_hits"))
    depth = closure.groupBy("taxid").agg(F.max("distance").alias("_depth"))
    votes = (
        salted_join(counts, closure.select("taxid", "ancestor"), ["taxid"], [key])
        .select(key, "ancestor", "_n")
        .repartition(parts, key, "ancestor")
        .groupBy(key, "ancestor")
        .agg(F.sum("_n").alias("votes"))
    )
    shared = (
        votes.join(totals, key)
        .where(F.col("votes") > F.col("n_hits") * fraction)
        .join(depth.withColumnRenamed("taxid", "ancestor"), "ancestor")
    )
    return shared.groupBy(key).agg(
        F.max_by("ancestor", F.struct("_depth", "votes", -F.col("ancestor"))).alias("lca"),
        F.max("n_hits").alias("n_hits"),
    )


def rank_prefix(rank: Column) -> Column:
    pairs = [F.lit(x) for item in RANK_PREFIX.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rank), F.substring(rank, 1, 1))


def lineage_string(
    taxa: DataFrame, closure: DataFrame, nodes: DataFrame, names: DataFrame
) -> DataFrame:
    """Root-to-taxon text such as ``d__X;p__Y`` for each ``taxid``; unranked nodes are left out.

    A lineage has at most the depth of the tree, which bounds each list.
    """
    ranked = (
        nodes.where(F.col("rank") != "no rank")
        .select("taxid", "rank")
        .join(names.select("taxid", "name"), "taxid")
        .select(
            F.col("taxid").alias("ancestor"),
            F.concat(rank_prefix(F.col("rank")), F.lit("__"), "name").alias("_part"),
        )
    )
    parts = (
        taxa.select("taxid").distinct()
        .join(closure, "taxid")
        .join(ranked, "ancestor")
        .groupBy("taxid")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "_part")), asc=False).alias("_p"))
    )
    return parts.select(
        "taxid", F.array_join(F.transform("_p", lambda s: s["_part"]), ";").alias("lineage")
    )


def attach_taxid(df: DataFrame, acc2taxid: DataFrame, accession: str) -> DataFrame:
    """Left lookup of the taxon of an accession."""
    lookup = acc2taxid.select(F.col("accession").alias(accession), "taxid")
    return df.join(lookup, accession, "left")


