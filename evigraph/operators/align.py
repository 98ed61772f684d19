"""Alignment of concepts across books: blocked candidate pairs, six signals, classes and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .components import connected_components

MIN_CONFIDENCE, REVIEW_BELOW, REFINE_RATIO, REFINE_CONFIDENCE = 0.62, 0.78, 1.55, 0.58
WEIGHTS = {"name": 0.24, "alias": 0.26, "definition": 0.20, "context": 0.10, "neighbour": 0.10, "embedding": 0.10}


def features(nodes: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """nodes (node_id, book, name, definition, context, extra_aliases, neighbours) with their keys and tokens.

    aliases maps normalised aliases to canonical names; the first of a node's name and aliases that it
    has gives the canonical key, else the normalised name.
    """
    out = nodes.withColumn("norm", T.normalize_term(F.col("name")))
    out = out.withColumn("alias_keys", F.array_distinct(F.transform(F.coalesce("extra_aliases", F.array().cast("array<string>")), T.normalize_term)))
    canonical = F.col("norm")
    if aliases:
        table = F.create_map(*[x for k, v in sorted(aliases.items()) for x in (F.lit(k), F.lit(v))])
        hits = F.filter(F.transform(F.concat(F.array("norm"), F.col("alias_keys")), lambda k: table[k]), lambda v: v.isNotNull())
        canonical = F.coalesce(F.get(hits, F.lit(0)), F.col("norm"))
    out = out.withColumn("canonical", canonical)
    out = out.withColumn("keys", F.array_distinct(F.concat(F.array("norm", "canonical"), F.col("alias_keys"))))
    return out.withColumn("def_tokens", F.array_distinct(T.tokens(F.col("definition")))).withColumn("ctx_tokens", F.array_distinct(T.tokens(F.col("context"))))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def candidate_pairs(feats: DataFrame) -> DataFrame:
    """Pairs of nodes of different books that share a key, once each, the smaller id first.

    Pairs without a shared key score at most 0.50, so this blocking is exact above that threshold.
    """
    keyed = feats.select("node_id", "book", F.explode("keys").alias("key"))
    left = keyed.select("key", F.col("node_id").alias("l"), F.col("book").alias("lb"))
    right = keyed.select("key", F.col("node_id").alias("r"), F.col("book").alias("rb"))
    return left.join(right, "key").where("l < r and lb <> rb").select("l", "r").distinct()


def signals(pairs: DataFrame, feats: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """l, r and the six signals. vectors: node_id, bucket, w (unit length), if embeddings are wanted."""
    cols = ["norm", "canonical", "keys", "def_tokens", "ctx_tokens", "neighbours", "definition", "name"]
    side = lambda k: feats.select(F.col("node_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])
    both = pairs.join(side("l"), "l").join(side("r"), "r")
    if vectors is not None:
        lv = vectors.select(F.col("node_id").alias("l"), "bucket", "w")
        rv = vectors.select(F.col("node_id").alias("r"), "bucket", F.col("w").alias("w2"))
        dots = pairs.join(lv, "l").join(rv, ["r", "bucket"]).groupBy("l", "r").agg(F.sum(F.col("w") * F.col("w2")).alias("dot"))
        both = both.join(dots, ["l", "r"], "left")
        embedding = F.greatest(F.lit(0.0), F.coalesce("dot", F.lit(0.0)))
    else:
        embedding = F.lit(0.0)
    same = (F.col("l_norm") != "") & (F.col("l_norm") == F.col("r_norm"))
    alias = F.arrays_overlap("l_keys", "r_keys") | ((F.col("l_canonical") != "") & (F.col("l_canonical") == F.col("r_canonical")))
    return both.select(
        "l", "r", F.when(same, 1.0).otherwise(0.0).alias("s_name"), F.when(alias, 1.0).otherwise(0.0).alias("s_alias"),
        jaccard(F.col("l_def_tokens"), F.col("r_def_tokens")).alias("s_definition"), jaccard(F.col("l_ctx_tokens"), F.col("r_ctx_tokens")).alias("s_context"),
        jaccard(F.col("l_neighbours"), F.col("r_neighbours")).alias("s_neighbour"), embedding.alias("s_embedding"),
        F.length(F.coalesce("l_definition", F.lit(""))).alias("l_len"), F.length(F.coalesce("r_definition", F.lit(""))).alias("r_len"),
        F.concat_ws(" ", "l_name", "l_definition").alias("l_text"), F.concat_ws(" ", "r_name", "r_definition").alias("r_text"),
    )


def confidence() -> Column:
    """The weighted mean of the signals, raised to a floor where names or aliases agree."""
    mean = sum((F.col(f"s_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    name = F.when(F.col("s_name") >= 1, 0.9 + 0.05 * F.col("s_definition")).otherwise(0.0)
    alias = F.when(F.col("s_alias") >= 1, 0.78 + 0.10 * F.col("s_definition") + 0.05 * F.col("s_context") + 0.05 * F.col("s_embedding")).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean, name, alias))


def relation(negative: tuple[str, ...], positive: tuple[str, ...]) -> Column:
    """CONFLICTS_WITH, then ALIAS_OF, REFINES, SAME_AS."""
    ln, rn = T.contains_any(F.col("l_text"), negative), T.contains_any(F.col("r_text"), negative)
    lp, rp = T.contains_any(F.col("l_text"), positive), T.contains_any(F.col("r_text"), positive)
    conflict = ((ln & rp) | (rn & lp)) & (F.col("s_alias") >= 1)
    longer = F.greatest("l_len", "r_len") / F.greatest(F.lit(1), F.least("l_len", "r_len"))
    refines = (F.least("l_len", "r_len") > 0) & (longer >= REFINE_RATIO) & (F.col("confidence") >= REFINE_CONFIDENCE)
    return F.when(conflict, "CONFLICTS_WITH").when((F.col("s_alias") >= 1) & (F.col("s_name") < 1), "ALIAS_OF").when(refines, "REFINES").otherwise("SAME_AS")


def candidates(signalled: DataFrame, negative: tuple[str, ...], positive: tuple[str, ...], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Pairs at or above the threshold, and all conflicts, with confidence, relation and review flag."""
    out = signalled.withColumn("confidence", confidence()).withColumn("relation", relation(negative, positive))
    out = out.where((F.col("confidence") >= min_confidence) | (F.col("relation") == "CONFLICTS_WITH"))
    review = (F.col("relation") == "CONFLICTS_WITH") | (F.col("confidence") < REVIEW_BELOW)
    return out.withColumn("needs_review", review).withColumn("confidence", F.round("confidence", 4))


def clusters(cands: DataFrame, nodes: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """cluster (its smallest node id), node_id of every class of two nodes or more."""
    links = cands.where((F.col("relation") != "CONFLICTS_WITH") & (F.col("confidence") >= min_confidence))
    return connected_components(links, "l", "r").select(F.col("component").alias("cluster"), F.col("id").alias("node_id"))


def cluster_confidence(members: DataFrame, cands: DataFrame) -> DataFrame:
    """cluster, confidence: the mean over candidates with both ends inside."""
    a = members.select(F.col("cluster").alias("c"), F.col("node_id").alias("l"))
    b = members.select(F.col("cluster").alias("c"), F.col("node_id").alias("r"))
    return cands.join(a, "l").join(b, ["c", "r"]).groupBy(F.col("c").alias("cluster")).agg(F.round(F.avg("confidence"), 4).alias("confidence"))


def canonical_names(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """cluster, name: the most common name of its members, the first of equals by name."""
    counts = members.join(nodes, "node_id").groupBy("cluster", "name").agg(F.count("*").alias("c"))
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "name"))
    return counts.withColumn("r", r).where("r = 1").select("cluster", "name")


def alias_rows(members: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """cluster, canonical, alias, n_members of every other name in a class."""
    own = members.join(nodes.select("node_id", F.col("name").alias("alias")), "node_id").groupBy("cluster", "alias").agg(F.count("*").alias("n_members"))
    return own.join(names.withColumnRenamed("name", "canonical"), "cluster").where("alias <> canonical").select("cluster", "canonical", "alias", "n_members")
