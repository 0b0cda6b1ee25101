"""Nearly equal texts: exact Jaccard similarity of word shingles by prefix filtering, and classes of linked texts.

Equal texts are one document first. Two sets of n shingles whose similarity reaches s must share one of
the n - ceil(s * n) + 1 rarest shingles of each, so only those are joined; the pairs are then measured on
the whole sets. Classes are the connected components of the links.

Defined results: null and blank texts, and texts without words, are classes of their own without links;
texts shorter than a shingle have one shingle, all their words. Repeated rows share a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

WORDS, SIMILARITY = 5, 0.8


def shingles(text: Column, words: int = WORDS) -> Column:
    """Distinct hashes of the runs of words of a text in lower case; empty without words."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, words), " ")))
    return F.when(F.size(tokens) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def links(documents: DataFrame, key: str, text: str, words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members: key, node; links: a, b, similarity between nodes, a < b). A node is a distinct text."""
    node = F.unhex(F.sha2(F.col(text), 256))
    members = documents.select(F.col(key).alias("key"), node.alias("node"))
    nodes = documents.select(node.alias("node"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(nodes.select("node", shingles(F.col("text"), words).alias("set")).filter(F.size("set") > 0), "sets")
    one = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    counts = one.groupBy("shingle").agg(F.count("*").alias("count")).filter("count > 1")
    # a shingle of one text alone can't link, but comes first in the order
    ranked = one.join(counts, "shingle", "left").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("count"), "shingle"))).alias("order"))
    size = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    prefix = ranked.select("node", "n", F.explode(F.slice("order", F.lit(1), size)).alias("s")).filter("s.count > 1").select("node", "n", F.col("s.shingle").alias("shingle"))
    left, right = prefix.select(F.col("node").alias("a"), F.col("n").alias("na"), "shingle"), prefix.select(F.col("node").alias("b"), F.col("n").alias("nb"), "shingle")
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    pairs = left.join(right, "shingle").filter(close).select("a", "b").distinct()
    measured = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    found = measured.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    return members, stored(found.filter(F.col("similarity") >= similarity - 1e-9), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, class: the smallest node that is linked with a node, over any number of links."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("class").alias("near")).select(F.col("a").alias("node"), "near")
        step = labels.join(near, "node").select("node", F.least("class", "near").alias("class"))
        # pointer jumping: a node takes the class of its class, so paths halve each round
        jump = step.select(F.col("node").alias("at"), F.col("class").alias("further"))
        moved = stored(step.join(jump, step["class"] == jump["at"], "left").select("node", F.least("class", F.coalesce("further", F.col("class"))).alias("class")), "labels")
        changed = not moved.join(labels.select("node", F.col("class").alias("old")), "node").filter("class <> old").isEmpty()
        labels = moved
        if not changed:
            return labels


def near_duplicates(documents: DataFrame, key: str, text: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """key, class (the smallest key of the class), links of the text to other texts, copies of it in the class."""
    members, edges = links(documents, key, text, words, similarity)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    placed = members.join(components(edges), "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = placed.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("key").alias("first"))
    joined = placed.join(named, "class", "left").join(degree, "node", "left")
    return joined.select(F.col("key").alias(key), F.coalesce("first", "key").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
