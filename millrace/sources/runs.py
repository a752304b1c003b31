"""What surrounds runs of a model server: prompts, parameters that must not change, cached answers, calls."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces, so that equal values give equal bytes."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def request_key(*parts: Any) -> str:
    """The key of a cached answer: a digest of the model's name, the prompt and whatever else decides the answer."""
    return hashlib.sha256(canonical_json(parts).encode()).hexdigest()


def template(text: str, **lists: tuple[str, ...]) -> str:
    """A prompt template with each ``{name}`` of ``lists`` replaced by its items; other braces stay as they are."""
    for name, items in lists.items():
        if f"{{{name}}}" not in text:
            raise ValueError(f"the template has no place for {name}")
        text = text.replace(f"{{{name}}}", ", ".join(items))
    return text


def guard(spark: SparkSession, path: str, params: dict[str, Any], force: bool = False) -> None:
    """Keep a run's parameters in ``path`` and refuse to go on with others, unless ``force`` is given."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there and not force:
        before = json.loads(spark.read.text(path).first()["value"])
        changed = sorted(k for k in before.keys() | params.keys() if before.get(k) != json.loads(canonical_json(params.get(k))))
        if changed:
            raise ValueError(f"{path} holds a run with other parameters: {', '.join(changed)}")
        return
    spark.createDataFrame([(canonical_json(params),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def unanswered(requests: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Requests whose answer no cache line holds."""
    return requests.join(cached.select(key).distinct(), key, "left_anti")


class ServerError(Exception):
    """A failed call; ``status`` is the HTTP status, None where there was no answer at all."""

    def __init__(self, status: int | None, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status

    @property
    def lasting(self) -> bool:
        """Whether the same call would fail again: client errors but for too many requests."""
        return self.status is not None and 400 <= self.status < 500 and self.status != 429


def called(call: Callable[[list[str]], list[dict]], inputs: list[str], tries: int = 8, wait: float = 1.0) -> list[dict]:
    """Answers in input order. ``call`` returns dicts with an ``index``; passing failures are tried again, waiting twice as long."""
    for attempt in range(tries):
        try:
            answers = sorted(call(inputs), key=lambda a: a["index"])
            if [a["index"] for a in answers] != list(range(len(inputs))):
                raise ServerError(None, "the answers' indexes are not those of the inputs")
            return answers
        except ServerError as failure:
            if failure.lasting or attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("tries must be 1 at least")


def served(df: DataFrame, call: Callable[[list[str]], list[dict]], schema: str, column: str = "input", batch: int = 64, tries: int = 8, wait: float = 1.0) -> DataFrame:
    """``df`` with the fields of ``schema`` from a server's answers, and ``error``, null where there is none.

    Batches of at most ``batch`` rows go to ``call``; a batch whose calls fail for good leaves its
    rows with nulls and the failure's text, so a run goes on and a later one can ask again.
    """
    fields = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].reset_index(drop=True)
                try:
                    answers, error = called(call, part[column].tolist(), tries, wait), None
                except ServerError as failure:
                    answers, error = [{}] * len(part), str(failure)
                extra = pd.DataFrame([{f: a.get(f) for f in fields} for a in answers], columns=fields, dtype=object)
                yield pd.concat([part, extra, pd.Series([error] * len(part), name="error", dtype=object)], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kept}, {schema}, error string")


def progress(counts: DataFrame, started_done: int, elapsed_s: float) -> DataFrame:
    """One row from one row (total, done, failed): what is left, percent, documents a second, minutes to go."""
    now = F.col("done") - started_done
    rate = F.when((F.lit(elapsed_s) > 0) & (now > 0), now / F.lit(elapsed_s))
    left = F.col("total") - F.col("done")
    return counts.select(
        "total",
        "done",
        left.alias("left"),
        "failed",
        F.round(F.lit(100.0) * F.col("done") / F.nullif(F.col("total"), F.lit(0)), 2).alias("percent"),
        now.alias("done_this_run"),
        F.round(F.coalesce(rate, F.lit(0.0)), 2).alias("docs_per_sec"),
        F.round(left / rate / 60, 1).alias("eta_minutes"),
    )


def cost(summary: DataFrame, elapsed_minutes: float, gpu_price: float, gpus: int = 1) -> DataFrame:
    """A run summary (documents, ...) with gpu_hours and cost_per_document."""
    hours = elapsed_minutes / 60 * gpus
    return summary.withColumns({"gpu_hours": F.lit(round(hours, 3)), "cost_per_document": F.round(F.lit(gpu_price * hours) / F.nullif(F.col("documents"), F.lit(0)), 6)})


def closed_shards(done: DataFrame, total: int, size: int = 5000) -> DataFrame:
    """(shard_id, rows) of shards that may be written: full ones, and the last one once its tail is there.

    ``done`` has one row per finished row with its shard_id; ``total`` is the number of rows of the input.
    """
    want = F.least(F.lit(size), F.lit(total) - F.col("shard_id") * size)
    return done.groupBy("shard_id").agg(F.count("*").alias("rows")).where(F.col("rows") >= want)
