"""Queues, cursors, pages, index parity and health: views over append-only state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import columns as C
from tracelode.functions.tables import small, stored

#: The states of both queues.
SEMANTIC_STATES = ("pending", "leased", "completed", "failed")
INDEX_STATES = ("pending", "leased", "indexed", "failed", "stale")
ATTEMPTS = 3


def zero_filled(rows: DataFrame, keys: list[str], state: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """One row for each key with a count for each state of the vocabulary, 0 where there are none."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(state) == v).alias(v) for v in vocabulary))


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_last"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def eligible(now_ms: Column, attempts: int = ATTEMPTS) -> Column:
    """Whether a job can be claimed: pending, failed or stale, or leased with a lease that is over; and attempts left."""
    return (F.col("attempts") < attempts) & (F.col("status").isin("pending", "failed", "stale") | ((F.col("status") == "leased") & (F.col("lease_expires_ms") <= now_ms)))


def claim(jobs: DataFrame, now_ms: Column, k: int, worker: str, lease_ms: int) -> DataFrame:
    """The k oldest eligible jobs as leased rows to append to the log: each task offers k rows, and k of them are taken."""
    first = jobs.where(eligible(now_ms)).orderBy("created_ms", "job_id").limit(k)
    return first.withColumns({"status": F.lit("leased"), "attempts": F.col("attempts") + 1, "owner": F.lit(worker), "lease_expires_ms": now_ms + lease_ms})


def finish(jobs: DataFrame, reports: DataFrame, now_ms: Column, done: str = "indexed") -> DataFrame:
    """Reports (job_id, owner, ok) of leases that still stand become done or failed; others are refused as lease_lost."""
    rows = reports.withColumnRenamed("owner", "_by").join(jobs, "job_id", "left")
    stands = F.coalesce((F.col("status") == "leased") & (F.col("owner") == F.col("_by")) & (F.col("lease_expires_ms") > now_ms), F.lit(False))
    return rows.select("job_id", F.when(~stands, "lease_lost").when(F.col("ok"), done).otherwise("failed").alias("status"))


def requeue(jobs: DataFrame, profile: Column) -> DataFrame:
    """Indexed jobs of another profile are pending again, with no attempts used; the rest stay."""
    other = (F.col("status") == "indexed") & ~F.col("profile").eqNullSafe(profile)
    return jobs.withColumns({"status": F.when(other, "pending").otherwise(F.col("status")), "attempts": F.when(other, 0).otherwise(F.col("attempts")), "requeued": other})


def cursors(imports: DataFrame, jobs: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: source_cursor (-1 without imports), index_cursor (the source's if nothing is pending, else -1) and semantic_state."""
    source = imports.groupBy(*keys).agg(F.max("committed_index").alias("m"))
    open_ = jobs.groupBy(*keys).agg(F.max(F.col("status") != "indexed").alias("open"))
    state = semantic.groupBy(*keys).agg(F.count_if(F.col("status") == "failed").alias("f"), F.count_if(F.col("status").isin("pending", "leased")).alias("p"))
    rows = source.join(open_, keys, "full_outer").join(state, keys, "full_outer")
    at = F.coalesce("m", F.lit(-1)).cast("long")
    return rows.select(
        *keys, at.alias("source_cursor"), F.when(F.coalesce("open", F.lit(False)), F.lit(-1)).otherwise(at).cast("long").alias("index_cursor"),
        F.when(F.col("f") > 0, "failed").when(F.col("p") > 0, "pending").otherwise("complete").alias("semantic_state"))


def swap_cursor(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Compare and swap: updates (key, expected, next) apply where the current cursor is the expected one; repeats of what holds are no-ops."""
    rows = updates.join(current, "key", "left").withColumn("_now", F.coalesce("cursor", F.lit(0)))
    state = F.when(F.col("_now") == F.col("next"), "repeated").when(F.col("_now") == F.col("expected"), "advanced").otherwise("conflict")
    return rows.select("key", state.alias("state"), F.when(state == "advanced", F.col("next")).otherwise(F.col("_now")).cast("long").alias("cursor"))


def page(rows: DataFrame, key: str, size: int, repo: Column, after: Column | None = None) -> DataFrame:
    """A keyset page in the order of the key, with the cursor of the next page in its last row, if there is one."""
    from pyspark.sql.window import Window

    start = rows if after is None else rows.where(F.col(key) > after)
    some = start.orderBy(key).limit(size + 1)
    # The page and one row more, so this window holds size + 1 rows.
    some = some.withColumn("_n", F.row_number().over(Window.orderBy(key)))
    more = F.count("*").over(Window.partitionBy()) > size
    return some.withColumn("next_cursor", F.when((F.col("_n") == size) & more, C.page_cursor(repo, F.col(key).cast("string")))).where(F.col("_n") <= size).drop("_n")


def parity(expected: DataFrame, actual: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Differences between what should be indexed and what is: key, state missing, extra or changed. None means parity."""
    e = expected.select(key, F.col(fingerprint).alias("_e"), F.lit(True).alias("_in_e"))
    a = actual.select(key, F.col(fingerprint).alias("_a"), F.lit(True).alias("_in_a"))
    rows = e.join(a, key, "full_outer")
    state = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "extra").when(~F.col("_e").eqNullSafe(F.col("_a")), "changed")
    return rows.withColumn("state", state).where("state is not null").select(key, "state")


def to_requeue(expected: DataFrame, actual: DataFrame, memory: str, columns: list[str]) -> DataFrame:
    """Memories of which some document's fingerprint is in one set and not in the other."""
    e, a = expected.select(memory, *columns), actual.select(memory, *columns)
    return e.exceptAll(a).unionByName(a.exceptAll(e)).select(memory).distinct()


def health(checks: DataFrame) -> DataFrame:
    """One row from checks (ordinal, name, ok, remediation): degraded if any is bad, how many, and the first remediation."""
    return checks.agg(
        F.when(F.bool_or(~F.col("ok")), "degraded").otherwise("healthy").alias("status"), F.count_if(~F.col("ok")).alias("failing"),
        F.min_by("remediation", F.when(~F.col("ok"), F.col("ordinal"))).alias("remediation"))


def receipts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hook receipts summed up: total, failed and the latest that asks for a retry."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.max_by("receipt_id", F.when(F.col("outcome") == "retry", F.struct("at_ms", "receipt_id"))).alias("latest_retry"))


def source_states(found: DataFrame, imported: DataFrame) -> DataFrame:
    """Onboarding preview: each discovered source (source, digest, events) against what was imported (source, digest, cursor)."""
    rows = found.join(imported.select("source", F.col("digest").alias("_digest"), "cursor"), "source", "left")
    state = F.when(F.col("cursor").isNull(), "new").when(F.col("events") < F.col("cursor"), "invalid").when(F.col("digest") == F.col("_digest"), "already_imported").otherwise("incremental")
    return rows.select("source", state.alias("state"))


def onboarding_outcome(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of import attempts (state done, failed, skipped) and their outcome: partial, failed, complete or noop."""
    sums = rows.groupBy(*keys).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "skipped")))
    done, failed = F.col("done") > 0, F.col("failed") > 0
    return sums.withColumn("outcome", F.when(done & failed, "partial").when(failed, "failed").when(done, "complete").otherwise("noop"))


def library_issues(promotions: DataFrame, people: DataFrame, memories: DataFrame) -> DataFrame:
    """What is wrong with promoted preferences: (promotion_id, issue), a row for each broken rule.

    promotions: promotion_id, person_id, memory_id, subject_key, replaces; people: person_id;
    memories: memory_id, status, subject_key.
    """
    owner = promotions.join(people.select("person_id"), "person_id", "left_anti").select("promotion_id", F.lit("owner_mismatch").alias("issue"))
    broken = promotions.where("replaces is not null").join(promotions.select(F.col("promotion_id").alias("replaces")), "replaces", "left_anti").select("promotion_id", F.lit("broken_replacement").alias("issue"))
    force = promotions.join(promotions.where("replaces is not null").select(F.col("replaces").alias("promotion_id")), "promotion_id", "left_anti")
    twice = force.groupBy("person_id", "subject_key").agg(F.count("*").alias("_n")).where("_n > 1")
    double = force.join(twice, ["person_id", "subject_key"], "left_semi").select("promotion_id", F.lit("duplicate_subject").alias("issue"))
    seen = promotions.join(memories.select("memory_id", F.col("status").alias("_status"), F.col("subject_key").alias("_subject")), "memory_id", "left")
    issue = F.when(F.col("_status").isNull(), "missing_memory").when(F.col("_status") != "active", "superseded_memory").when(~F.col("_subject").eqNullSafe(F.col("subject_key")), "subject_mismatch")
    memory = seen.select("promotion_id", issue.alias("issue")).where("issue is not null")
    return owner.unionByName(broken).unionByName(double).unionByName(memory)


def onboarding_preview(requests: DataFrame, sources: DataFrame, ttl_ms: int) -> DataFrame:
    """What each request would import, and a snapshot of it: request_id, repo_key, chosen (source ids, in order), state, snapshot_id, expires_ms.

    requests: request_id, repo_key, selected (source ids, or null for all that aren't imported
    yet), at_ms; sources: repo_key, source_id, fingerprint, import_state. A selection that names a source
    twice or one of another repository is invalid_selection; one of nothing is nothing_selected. The
    snapshot is over the chosen sources as they are now, so any change of one of them shows.
    Sources are met by each distinct selection of a repository, so requests that choose the same cost
    no more than one; a selection has sources of one repository, whose number discovery limits.
    """
    asked = requests.withColumn("_choice", _choice("repo_key", "selected"))
    found = small(_choices(asked.select("repo_key", "_choice", "selected").distinct(), sources))
    rows = asked.join(found, "_choice")
    expires = F.col("at_ms") + ttl_ms
    rows = rows.select("request_id", "repo_key", "chosen", "state", _snapshot(expires, F.col("repo_key"), F.col("_sources")).alias("snapshot_id"), expires.alias("expires_ms"))
    return rows.withColumn("snapshot_id", F.when(F.col("state") == "ready", F.col("snapshot_id")))


def _choice(repo: str, selected: str) -> Column:
    """One text for a repository and a selection."""
    return F.sha2(C.canonical_json(repo_key=F.col(repo), selected=F.col(selected)), 256)


def _snapshot(expires: Column, repo: Column, sources: Column) -> Column:
    return F.concat(F.lit("onb_"), F.sha2(C.canonical_json(expires_ms=expires, repo_key=repo, sources=sources), 256))


def _choices(distinct: DataFrame, sources: DataFrame) -> DataFrame:
    """(_choice, chosen, state, _sources) of distinct selections (repo_key, _choice, selected): _sources is a digest of the chosen sources as they are."""
    every = distinct.where("selected is null").select("repo_key", "_choice").join(sources.where("import_state <> 'already_imported'"), "repo_key").select("_choice", "source_id", "fingerprint", "import_state")
    named = distinct.where("selected is not null").select("repo_key", "_choice", F.explode(F.array_distinct("selected")).alias("source_id"))
    found = every.unionByName(named.join(sources, ["repo_key", "source_id"]).select("_choice", "source_id", "fingerprint", "import_state"))
    marks = found.groupBy("_choice").agg(F.array_sort(F.collect_list(F.struct("source_id", "fingerprint", "import_state"))).alias("m"))
    rows = distinct.join(marks, "_choice", "left").withColumn("m", F.coalesce("m", F.array().cast(marks.schema["m"].dataType)))
    wrong = F.coalesce(F.size("selected") != F.size("m"), F.lit(False))
    state = F.when(wrong, "invalid_selection").when(F.size("m") == 0, "nothing_selected").otherwise("ready")
    rows = rows.select("_choice", F.transform("m", lambda x: x["source_id"]).alias("chosen"), state.alias("state"), F.sha2(C.canonical_json(sources=F.col("m")), 256).alias("_sources"))
    return stored(rows, "choices")


def onboarding_apply(consents: DataFrame, previews: DataFrame, sources: DataFrame) -> DataFrame:
    """What becomes of consents (request_id, snapshot_id, at_ms) to previews: request_id, outcome, and to_import, the sources still to be read.

    Outcomes: unknown_consent (no preview of that snapshot), consent_expired, snapshot_stale (a chosen source
    changed, came under another state or is gone), else noop where all are imported, or applied.
    A snapshot that was applied gives the same again, as sources imported meanwhile make it stale.
    """
    ready = previews.where("state = 'ready'").withColumn("_choice", _choice("repo_key", "chosen"))
    # What became of sources is told by each distinct choice.
    distinct = stored(ready.select("repo_key", "_choice", F.col("chosen").alias("selected")).distinct(), "chosen")
    choices = _choices(distinct, sources).select("_choice", F.when(F.col("state") == "ready", F.col("_sources")).alias("_sources"))
    left = sources.where("import_state <> 'already_imported'").select("repo_key", "source_id")
    todo = distinct.select("repo_key", "_choice", F.explode("selected").alias("source_id")).join(left, ["repo_key", "source_id"], "left_semi").groupBy("_choice").agg(F.array_sort(F.collect_set("source_id")).alias("todo"))
    now = choices.join(todo, "_choice", "left")
    known = ready.select("request_id", "repo_key", "_choice", "snapshot_id", "expires_ms")
    rows = consents.join(known, ["request_id", "snapshot_id"], "left").join(small(stored(now, "now")), "_choice", "left").withColumn("todo", F.coalesce("todo", F.array().cast(previews.schema["chosen"].dataType)))
    rows = rows.withColumn("_now", F.when(F.col("_sources").isNotNull(), _snapshot(F.col("expires_ms"), F.col("repo_key"), F.col("_sources"))))
    outcome = (
        F.when(F.col("_choice").isNull(), "unknown_consent").when(F.col("at_ms") > F.col("expires_ms"), "consent_expired").when(~F.col("_now").eqNullSafe(F.col("snapshot_id")), "snapshot_stale")
        .when(F.size("todo") == 0, "noop").otherwise("applied"))
    return rows.select("request_id", outcome.alias("outcome"), F.when(outcome == "applied", F.col("todo")).otherwise(F.slice("todo", 1, 0)).alias("to_import"))
