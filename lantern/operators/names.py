"""Names that contain a string, for any number of both, by trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.operators.graph import LABEL_RANK, label_rank, small
from lantern.plans.lineage import cut

GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct runs of size characters; of a shorter text none."""
    size = F.lit(size) if isinstance(size, int) else size
    whole = F.length(text) >= size
    return F.array_distinct(F.when(whole, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>")))


def containing(texts: DataFrame, sought: DataFrame) -> DataFrame:
    """(text_id, sought_id) of all texts (text_id, text) that contain a sought (sought_id, text), letter for letter.

    Of the trigrams of each sought string the one that fewest texts have is its key: texts with it are candidates, and are looked at. A
    string of one or two characters is its own key. Empty strings are in no text; nulls match nothing.
    """
    wanted = cut(sought.where(F.length("text") > 0).select("sought_id", F.col("text").alias("s"), F.least(F.length("text"), F.lit(GRAM)).alias("size")))
    grams = cut(wanted.select("sought_id", "s", F.explode(_grams(F.col("s"), F.col("size"))).alias("gram")))
    sizes = [r[0] for r in wanted.select("size").distinct().collect()]  # three at most
    if not sizes:
        return texts.select("text_id").limit(0).crossJoin(sought.select("sought_id").limit(0))
    posted = texts.select("text_id", "text", F.explode(F.concat(*(_grams(F.col("text"), n) for n in sizes))).alias("gram"))
    met = posted.select("gram").join(small(grams.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    keys = grams.join(met, "gram", "left").groupBy("sought_id", "s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).where("k.n > 0")
    return posted.join(small(keys.select("sought_id", "s", F.col("k.gram").alias("gram"))), "gram").where(F.contains("text", F.col("s"))).select("text_id", "sought_id")


def lookup(nodes: DataFrame, names: DataFrame, ranks: dict[str, int] = LABEL_RANK, pool: int = 24, most: int = 4) -> DataFrame:
    """(name, id, label, rank) of up to `most` nodes for each name: equal names, else names that contain it; letter case makes no difference."""
    asked = cut(names.select(F.col("name").alias("q"), F.lower("name").alias("_q")).distinct())
    held = nodes.select("id", "label", F.lower("name").alias("_name"))
    equal = held.join(small(asked), F.col("_name") == F.col("_q")).select("q", "id", "label")
    equal = cut(equal)
    rest = asked.join(equal.select("q").distinct(), "q", "left_anti").select(F.col("q").alias("sought_id"), F.col("_q").alias("text"))
    found = containing(held.select(F.struct("id", "label").alias("text_id"), F.col("_name").alias("text")), rest)
    near = equal.unionByName(found.select(F.col("sought_id").alias("q"), "text_id.id", "text_id.label"))
    pooled = near.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy("id"))).where(F.col("_n") <= pool)
    rank = F.row_number().over(W.partitionBy("q").orderBy(label_rank(F.col("label"), ranks), "id"))
    return pooled.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("q").alias("name"), "id", "label", "rank")


def endpoints(nodes: DataFrame, names: DataFrame, tokens: DataFrame, ranks: dict[str, int] = LABEL_RANK, most: int = 3) -> DataFrame:
    """(name, id, label, rank, hits) of up to `most` nodes for the end of each connection: names that contain it or that it contains, else names that hold some of its tokens.

    names: (name); tokens: (name, token). As graph.endpoint_candidates for each name by itself.
    """
    asked = cut(names.select("name", F.lower("name").alias("_low")).distinct())
    held = nodes.select("id", "label", F.length("name").alias("size"), F.lower("name").alias("low"))
    once = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if once:  # of nodes that differ in their ids alone, more than `most` can't be among the best
        alike = W.partitionBy("low", "label", "size").orderBy("id")
        held = cut(held.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= most).drop("_n"))
    held = held.select(F.struct("id", "label", "size", F.length("low").alias("long")).alias("node"), "low")
    inside = containing(held.select(F.col("node").alias("text_id"), F.col("low").alias("text")), asked.select(F.col("name").alias("sought_id"), F.col("_low").alias("text"))).select(F.col("sought_id").alias("name"), F.col("text_id").alias("node"))
    around = containing(asked.select(F.col("name").alias("text_id"), F.col("_low").alias("text")), held.select(F.col("node").alias("sought_id"), F.col("low").alias("text"))).select(F.col("text_id").alias("name"), F.col("sought_id").alias("node"))
    # Equal names contain each other
    both = inside.union(around.where(F.col("node.long") != F.length(F.lower("name")))) if once else inside.union(around).distinct()
    whole = cut(both.withColumn("hits", F.lit(0)))
    rest = tokens.join(whole.select("name").distinct(), "name", "left_anti").select("name", "token").distinct()
    words = rest.select(F.col("token").alias("sought_id"), F.col("token").alias("text")).distinct()
    met = containing(held.select(F.col("node").alias("text_id"), F.col("low").alias("text")), words).select(F.col("sought_id").alias("token"), F.col("text_id").alias("node"))
    part = met.join(rest, "token").groupBy("name", "node").agg(F.count("*").cast("int").alias("hits"))
    near = F.when(F.col("hits") == 0, F.abs(F.col("node.size") - F.length("name"))).otherwise(-F.col("hits"))
    rank = F.row_number().over(W.partitionBy("name").orderBy(label_rank(F.col("node.label"), ranks), near, "node.id"))
    return whole.unionByName(part).withColumn("rank", rank).where(F.col("rank") <= most).select("name", "node.id", "node.label", "rank", "hits")
