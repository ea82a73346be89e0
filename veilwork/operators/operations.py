"""Operations of the service as queries: limits, replays, job lives, breakers, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the service.
CLAIM, MOST_TRIES, MOST_DELAY = 300, 5, 60
FAILURES_TO_OPEN, COOLDOWN = 3, 5


def owner_token(key: Column) -> Column:
    """What stands for an API key in stored records."""
    return F.substring(F.sha2(key, 256), 1, 32)


def fixed_window(df: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """df with the window's start, place in it, accepted, and seconds to wait.

    The place is counted per key and window, so a busy key is spread over its windows. Rows without a key bypass the
    limit and have no place, so they meet nowhere; everything passes if the limit is not positive.
    """
    epoch = F.unix_seconds(F.col(ts).cast("timestamp"))
    df = df.withColumn("window_start", F.floor(epoch / seconds) * seconds)
    place = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, order))
    keyed = df.where(F.col(key).isNotNull()).withColumn("place", place)
    df = keyed.unionByName(df.where(F.col(key).isNull()).withColumn("place", F.lit(None).cast("int")))
    accepted = F.lit(True) if limit <= 0 else F.col(key).isNull() | (F.col("place") <= limit)
    wait = F.greatest(F.lit(1), F.col("window_start") + seconds - epoch)
    return df.withColumn("accepted", accepted).withColumn("retry_after", F.when(~F.col("accepted"), wait))


def retry_delay(tries: Column, jitter: Column | float = 0.0) -> Column:
    """Seconds before the next try."""
    return F.least(F.lit(float(MOST_DELAY)), F.pow(F.lit(2.0), tries - 1) + jitter)


def job_states(events: DataFrame) -> DataFrame:
    """Last state of each job of events (job_id, seq, event): transitions that the state does not allow change nothing.

    A job's events are its own short history: they are folded in order inside one row.
    """
    history = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("h"))

    def step(acc: Column, e: Column) -> Column:
        state, event = acc["state"], e["event"]
        new = (
            F.when((event == "submit") & (state == "none"), "queued")
            .when((event == "claim") & (state == "queued"), "running")
            .when((event == "cancel") & (state == "queued"), "cancelled")
            .when(event.isin("done", "failed") & state.isin("queued", "running"), event)
            .otherwise(state)
        )
        return F.struct(new.alias("state"), (acc["applied"] + F.when(new != state, 1).otherwise(0)).alias("applied"))

    folded = F.aggregate("h", F.struct(F.lit("none").alias("state"), F.lit(0).alias("applied")), step)
    out = history.select("job_id", F.size("h").alias("events"), folded.alias("f"))
    return out.select("job_id", F.col("f.state").alias("status"), F.col("f.applied").cast("long").alias("applied"))


def stale(jobs: DataFrame, now: int, lease: int = CLAIM) -> DataFrame:
    """Live jobs whose lease has run out; a bad time counts as the beginning of time."""
    live = F.col("status").isin("queued", "running")
    return jobs.where(live & (F.coalesce(F.col("updated_at").try_cast("double"), F.lit(0.0)) <= now - lease))


def idempotent(requests: DataFrame) -> DataFrame:
    """outcome of each request (key, seq, fingerprint): the first acquires, the same again replays, another conflicts."""
    order = Window.partitionBy("key").orderBy("seq")
    first = F.first("fingerprint").over(order)
    outcome = F.when(F.row_number().over(order) == 1, "acquired").when(F.col("fingerprint") == first, "replayed")
    return requests.withColumn("outcome", outcome.otherwise("conflict"))


def breaker_replay(calls: DataFrame, threshold: int = FAILURES_TO_OPEN, cooldown: float = COOLDOWN) -> DataFrame:
    """What a circuit breaker does with each call of a log (model, seq, at, ok): allowed, and the state after it.

    States depend on all calls before; a model's log is folded in order inside one row.
    """
    logs = calls.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "ok"))).alias("h"))
    row = "array<struct<seq:bigint,allowed:boolean,state:string,failures:int>>"

    def step(acc: Column, c: Column) -> Column:
        probing = (acc["state"] == "open") & (c["at"] - acc["opened"] >= cooldown)
        allowed = (acc["state"] == "closed") | probing
        failures = F.when(~allowed, acc["failures"]).when(c["ok"], 0).otherwise(acc["failures"] + 1)
        opens = allowed & ~c["ok"] & (probing | (failures >= threshold))
        state = F.when(~allowed, acc["state"]).when(c["ok"], "closed").when(opens, "open").otherwise(acc["state"])
        one = F.struct(c["seq"].alias("seq"), allowed.alias("allowed"), state.alias("state"), failures.alias("failures"))
        return F.struct(
            state.alias("state"),
            failures.alias("failures"),
            F.when(opens, c["at"]).otherwise(acc["opened"]).alias("opened"),
            F.concat(acc["out"], F.array(one)).cast(row).alias("out"),
        )

    first = F.struct(
        F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(0.0).alias("opened"), F.expr(f"cast(array() as {row})").alias("out")
    )
    folded = F.aggregate("h", first, step, lambda acc: acc["out"])
    return logs.select("model", F.explode(folded).alias("r")).select("model", "r.*")


def admission(requests: DataFrame, most: int, most_per_owner: int) -> DataFrame:
    """Whether each job request (seq, owner, change: 1 to enter, -1 to leave) is admitted under both caps.

    The global cap makes this one sequence, and so one task: how many requests pass through is bounded by what one
    task can fold, as it is in any store that keeps such a cap.
    """
    log = requests.groupBy().agg(F.array_sort(F.collect_list(F.struct("seq", "owner", "change"))).alias("h"))
    row = "array<struct<seq:bigint,owner:string,admitted:boolean>>"

    def step(acc: Column, r: Column) -> Column:
        mine = F.coalesce(acc["owners"][r["owner"]], F.lit(0))
        enters = r["change"] > 0
        admitted = enters & (acc["all"] < most) & (mine < most_per_owner)
        moved = F.when(enters, F.when(admitted, 1).otherwise(0)).otherwise(F.when(mine > 0, -1).otherwise(0))
        others = F.map_filter(acc["owners"], lambda k, _: k != r["owner"])
        return F.struct(
            (acc["all"] + moved).alias("all"),
            F.map_concat(others, F.create_map(r["owner"], mine + moved)).alias("owners"),
            F.when(enters, F.concat(acc["out"], F.array(F.struct(r["seq"].alias("seq"), r["owner"].alias("owner"), admitted.alias("admitted"))))).otherwise(acc["out"]).cast(row).alias("out"),
        )

    first = F.struct(F.lit(0).alias("all"), F.expr("cast(map() as map<string,int>)").alias("owners"), F.expr(f"cast(array() as {row})").alias("out"))
    folded = F.aggregate("h", first, step, lambda acc: acc["out"])
    return log.select(F.explode(folded).alias("r")).select("r.*")


def last_events(df: DataFrame, n: int, ts: str, order: str, *by: str) -> DataFrame:
    """The last n rows; with by, of each group."""
    if not by:
        return df.orderBy(F.desc(ts), F.desc(order)).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(order)))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def retained(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows from the cutoff on; a time that cannot be read keeps its row."""
    at = F.try_to_timestamp(F.col(ts))
    return df.where(at.isNull() | (at >= F.lit(cutoff).cast("timestamp")))


def request_id(given: Column, fallback: Column) -> Column:
    """A client's request id if it is short and plain."""
    return F.when(given.rlike(r"\A[A-Za-z0-9._:-]+\z") & (F.length(given) <= 128), given).otherwise(fallback)


def request_status(chars: Column, batch_chars: Column, policy: Column, types: Column, staged: Column) -> Column:
    """HTTP status that the static checks give a request."""
    return (
        F.when((policy & types) | (staged & (policy | types)), 422)
        .when(chars < 1, 422)
        .when((chars > 100_000) | (batch_chars > 1_000_000), 413)
        .otherwise(200)
    )


def dead_letters(tries: DataFrame, most: int) -> DataFrame:
    """The last most records of jobs that failed for good (job_id, tries, ok, decoded, error, at), without payloads.

    A job fails for good at its last try, or at once if its payload cannot be read.
    """
    dead = tries.where(~F.col("ok") & ((F.col("tries") >= MOST_TRIES) | ~F.col("decoded")))
    last = dead.orderBy(F.desc("at"), F.desc("job_id")).limit(most)
    return last.select(F.lit(1).alias("schema_version"), "job_id", "error", F.col("tries").alias("attempts"), F.col("at").alias("recorded_at"))


def lease_log(log: DataFrame, ttl: int) -> DataFrame:
    """outcome of each event (key, seq, at, event, fingerprint, token) on idempotency keys.

    reserve: conflict with a result of another fingerprint, completed by a result of the same, acquired if no lease
    holds, else in_progress. complete publishes a result, and release gives the lease back, for the holder alone; any
    other has lost it. Leases and results end ttl after they begin. A key's events are folded in order inside one row.
    """
    row = "array<struct<seq:bigint,outcome:string>>"
    logs = log.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "event", "fingerprint", "token"))).alias("h"))

    def step(acc: Column, e: Column) -> Column:
        result = F.when(acc["kept_until"] > e["at"], acc["result"])
        holder = F.when(acc["held_until"] > e["at"], acc["holder"])
        own = F.coalesce(holder == e["token"], F.lit(False))
        reserved = (
            F.when(result != e["fingerprint"], "conflict").when(result.isNotNull(), "completed").when(holder.isNull(), "acquired").otherwise("in_progress")
        )
        outcome = F.when(e["event"] == "reserve", reserved).when(~own, "lost").when(e["event"] == "complete", "published").otherwise("released")
        takes, ends = outcome == "acquired", outcome.isin("published", "released")
        one = F.struct(e["seq"].cast("long").alias("seq"), outcome.alias("outcome"))
        return F.struct(
            F.when(outcome == "published", e["fingerprint"]).otherwise(result).alias("result"),
            F.when(outcome == "published", e["at"] + ttl).otherwise(acc["kept_until"]).alias("kept_until"),
            F.when(takes, e["token"]).when(~ends, holder).alias("holder"),
            F.when(takes, e["at"] + ttl).otherwise(acc["held_until"]).alias("held_until"),
            F.concat(acc["out"], F.array(one)).cast(row).alias("out"),
        )

    none, zero = F.lit(None).cast("string"), F.lit(0)
    first = F.struct(none.alias("result"), zero.alias("kept_until"), none.alias("holder"), zero.alias("held_until"), F.array().cast(row).alias("out"))
    return logs.select("key", F.explode(F.aggregate("h", first, step, lambda acc: acc["out"])).alias("r")).select("key", "r.*")


def shared_breaker(log: DataFrame, threshold: int = FAILURES_TO_OPEN, cooldown: float = COOLDOWN) -> DataFrame:
    """allowed (of allow events) and the state after each event of a breaker that replicas share.

    log: model, seq, at, event (allow, success, failure), probe (whether what succeeded or failed was a probe). Open, and
    after the cooldown, one probe is let through at a time. A model's log is folded in order inside one row.
    """
    row = "array<struct<seq:bigint,allowed:boolean,state:string>>"
    logs = log.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "event", "probe"))).alias("h"))

    def step(acc: Column, e: Column) -> Column:
        asks, works, fails = (e["event"] == k for k in ("allow", "success", "failure"))
        ready = (acc["state"] == "open") & (e["at"] - acc["opened"] >= cooldown) & ~acc["probing"]
        failures = F.when(works, 0).when(fails, acc["failures"] + 1).otherwise(acc["failures"])
        opens = fails & (e["probe"] | (failures >= threshold))
        state = F.when(works, "closed").when(opens, "open").otherwise(acc["state"])
        probing = F.when(works | opens, False).when(asks & ready, True).otherwise(acc["probing"])
        one = F.struct(e["seq"].cast("long").alias("seq"), F.when(asks, (acc["state"] == "closed") | ready).alias("allowed"), state.alias("state"))
        return F.struct(
            state.alias("state"),
            failures.alias("failures"),
            F.when(works, 0.0).when(opens, e["at"]).otherwise(acc["opened"]).alias("opened"),
            probing.alias("probing"),
            F.concat(acc["out"], F.array(one)).cast(row).alias("out"),
        )

    first = F.struct(
        F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(0.0).alias("opened"), F.lit(False).alias("probing"), F.array().cast(row).alias("out")
    )
    return logs.select("model", F.explode(F.aggregate("h", first, step, lambda acc: acc["out"])).alias("r")).select("model", "r.*")
