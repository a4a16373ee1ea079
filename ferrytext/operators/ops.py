"""Job records, logs, rates and chat context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytext.functions.text import clip, py_strip


def job_status_fold(events: DataFrame) -> DataFrame:
    """The latest record of each job (job_id, ts, seq, kind, status, progress, message); updated_at is its time. An older
    update never replaces a newer one. Partial aggregation makes a hot job cheap."""
    latest = F.max_by(F.struct("ts", "kind", "status", "progress", "message"), F.struct("ts", "seq"))
    folded = events.groupBy("job_id").agg(latest.alias("x"), F.min("ts").alias("created_at"))
    return folded.select("job_id", "created_at", F.col("x.ts").alias("updated_at"), "x.kind", "x.status", "x.progress", "x.message")


def job_warnings(events: DataFrame) -> DataFrame:
    """(job_id, warnings): messages of error rows in order."""
    rows = events.where("status = 'failed'").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "message"))).alias("x"))
    return rows.select("job_id", F.transform("x", lambda w: w["message"]).alias("warnings"))


def recent_jobs(jobs: DataFrame, n: int = 8) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "job_id").limit(n)


def recent_outputs(outputs: DataFrame, n: int = 20) -> DataFrame:
    """The newest zip outputs (name, size, modified)."""
    return outputs.where(F.lower("name").endswith(".zip")).orderBy(F.col("modified").desc(), "name").limit(n)


def attach_failure_logs(jobs: DataFrame, logs: DataFrame, root: str, chars: int = 6000) -> DataFrame:
    """Adds log: the last characters of the job's log if that lies under ``root``, else empty."""
    mine = logs.where(F.startswith("path", F.lit(root))).select("job_id", F.when(F.length("log") > chars, F.right("log", F.lit(chars))).otherwise(F.col("log")).alias("log"))
    return jobs.join(mine, "job_id", "left").withColumn("log", F.coalesce("log", F.lit("")))


def dedupe_active_setup(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Setup requests of owners (owner) without a queued or running setup."""
    active = jobs.where(F.col("status").isin("queued", "running") & (F.col("kind") == "setup")).select("owner").distinct()
    return requests.join(active, "owner", "left_anti")


def failed_job_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "failed").alias("failed"))


def download_progress(files: DataFrame) -> DataFrame:
    """(download_id, done, total, percent, stage) over its files (done, total or null): percent is cut and at most 100,
    the stage value runs from 15 to 50."""
    sums = files.groupBy("download_id").agg(F.sum("done").alias("done"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return sums.select(
        "download_id", "done", "total", F.when(F.col("total") > 0, F.least(F.lit(100), F.expr("done * 100 div total"))).alias("percent"),
        F.when(F.col("total") > 0, F.least(F.lit(50.0), 15 + 35 * F.col("done") / F.col("total"))).otherwise(F.lit(15.0)).alias("stage"),
    )


def throughput(samples: DataFrame, seconds: int = 4) -> DataFrame:
    """Adds speed: bytes per time unit over the samples (download_id, t, bytes) of the trailing window, never negative; 0
    with fewer than two or no time between."""
    w = Window.partitionBy("download_id").orderBy("t").rangeBetween(-seconds, 0)
    bytes_ = F.max_by("bytes", "t").over(w) - F.min_by("bytes", "t").over(w)
    time = F.max("t").over(w) - F.min("t").over(w)
    return samples.withColumn("speed", F.when(time > 0, F.greatest(F.lit(0.0), bytes_ / time)).otherwise(F.lit(0.0)))


def recent_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each conversation; only then are other roles than user and assistant, and empty ones, left out."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth").where(F.col("role").isin("user", "assistant") & (py_strip(F.col("text")) != ""))


def chat_messages(turns: DataFrame, questions: DataFrame, system: str, context: Column) -> DataFrame:
    """(conv_id, messages, rejected): system and context (18000 characters at most), recent turns (1800 each), the
    question (12000); an empty question is rejected."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    history = recent_turns(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", clip(F.col("text"), 1800).alias("content")))).alias("h"))
    asked = clip(F.col("question"), 12000)
    first = message(F.lit("system"), F.concat(F.lit(system + "\n"), clip(context, 18000)))
    said = F.transform(F.coalesce("h", F.array().cast("array<struct<turn:bigint,role:string,content:string>>")), lambda x: message(x["role"], x["content"]))
    rows = questions.join(history, "conv_id", "left")
    return rows.select("conv_id", F.when(asked != "", F.concat(F.array(first), said, F.array(message(F.lit("user"), asked)))).alias("messages"), (asked == "").alias("rejected"))


def jobs_context(jobs: DataFrame, logs: DataFrame, root: str) -> DataFrame:
    """(job_id, context): the newest jobs as JSON with clipped message and log."""
    rows = attach_failure_logs(recent_jobs(jobs), logs, root)
    return rows.select("job_id", F.to_json(F.struct("job_id", "status", clip(F.col("message"), 1800).alias("message"), clip(F.col("log"), 6000).alias("log"))).alias("context"))


def job_report(files: DataFrame) -> DataFrame:
    """(job_id, n, regions, entries): a JSON array of the job's files (job_id, nth, name, regions)."""
    entries = F.array_sort(F.collect_list(F.struct("nth", "name")))
    return files.groupBy("job_id").agg(F.count("*").alias("n"), F.sum("regions").alias("regions"), F.to_json(F.transform(entries, lambda x: x["name"])).alias("entries"))
