"""Recall over a repository and a person's global preferences, which local ones of the same subject shadow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.tables import stored
from tracelode.operators import recall
from tracelode.operators.evolution import effective_promotions

#: Stands between the asking repository and what is seen from there.
SEP = "\x1f"


def visibility(memories: DataFrame, promotions: DataFrame, repositories: DataFrame) -> DataFrame:
    """Each effective promotion as each asking repository sees it: view, promotion_id, memory_id, subject_key, repo_key, shadowed_by (an ordered array, empty where it is in force).

    memories: repo_key, memory_id, memory_type, status, subject_key; promotions: promotion_id,
    memory_id, repo_key, subject_key, replaces; repositories: repo_key. A repository's active preference
    of the same subject shadows a promotion, unless it is the promoted memory itself. Promotions
    are one person's, so they are few; local preferences meet them by subject.
    """
    force = effective_promotions(promotions).select("promotion_id", "memory_id", "subject_key", "repo_key")
    local = memories.where("status = 'active' and memory_type = 'user_preference'").select(F.col("repo_key").alias("view"), F.col("memory_id").alias("local_id"), "subject_key")
    local = local.join(repositories.select(F.col("repo_key").alias("view")).distinct(), "view", "left_semi")
    own = (F.col("local_id") == F.col("memory_id")) & (F.col("view") == F.col("repo_key"))
    shadows = local.join(force, "subject_key").where(~own).groupBy("view", "promotion_id").agg(F.array_sort(F.collect_set("local_id")).alias("shadowed_by"))
    every = force.crossJoin(F.broadcast(repositories.select(F.col("repo_key").alias("view")).distinct()))
    return every.join(shadows, ["view", "promotion_id"], "left").withColumn("shadowed_by", F.coalesce("shadowed_by", F.array().cast("array<string>")))


def scoped_recall(memories: DataFrame, promotions: DataFrame, queries: DataFrame, limit: int, threshold: float, embedder=None) -> DataFrame:
    """Recall for queries (query_id, query, repo_key): the asking repository's memories, and of others those that promotions in force make global.

    Each source is ranked for itself before fusion, as with several repositories. Adds scope
    (repository or global) and promotion_id to what ``recall.hybrid`` gives. A promotion whose
    memory isn't an active preference there is an error, as is a memory id of several repositories.
    """
    bad = effective_promotions(promotions).join(memories.where("status = 'active' and memory_type = 'user_preference'").select("memory_id", "repo_key"), ["memory_id", "repo_key"], "left_anti")
    if not bad.isEmpty():
        raise ValueError("global_preference_invalid: a promotion's memory is no active preference")
    seen = stored(visibility(memories, promotions, queries.select("repo_key")), "visibility")
    shared = seen.where("size(shadowed_by) = 0 and view <> repo_key").select("view", "memory_id", "repo_key")
    # Only promoted memories are there once more for each repository that asks.
    asking = queries.select(F.col("repo_key").alias("view")).distinct()
    local = memories.join(F.broadcast(asking), F.col("repo_key") == F.col("view")).select("view", *memories.columns)
    views = local.unionByName(memories.join(F.broadcast(shared), ["memory_id", "repo_key"]).select("view", *memories.columns))
    views = views.withColumn("memory_id", F.concat_ws(SEP, "view", "memory_id")).withColumn("repo_key", F.concat_ws(SEP, "view", "repo_key")).drop("view")
    sources = seen.select("view", "repo_key").union(asking.select("view", "view")).distinct().groupBy("view").agg(F.collect_set(F.concat_ws(SEP, "view", "repo_key")).alias("repo_keys"))
    asked = queries.withColumnRenamed("repo_key", "view").join(F.broadcast(sources), "view").select("query_id", "query", "repo_keys")
    found = recall.hybrid(views, asked, limit, threshold, by_repository=True, embedder=embedder)
    part = lambda n: F.split("memory_id", SEP)[n]
    found = found.withColumn("view", part(0)).withColumn("memory_id", part(1))
    scope = seen.where("size(shadowed_by) = 0").select("view", "memory_id", "promotion_id")
    return found.join(F.broadcast(scope), ["view", "memory_id"], "left").withColumn("scope", F.when(F.col("promotion_id").isNull(), "repository").otherwise("global")).withColumnRenamed("view", "repo_key")
