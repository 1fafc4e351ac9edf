"""Resumable adjudication by an external service: cache split, batching, calls, validation, decision log.

The client is injected: a function from a JSON request text to a response text. Calls run in mapInPandas, a batch per
call; a response that fails validation is asked for again, then recorded as failed. The log only grows; the last record
of a key wins.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.windows import batches

#: Decisions, marks of network errors, waits before another attempt.
DECISIONS = ("CONFIRM", "CORRECTED_MATCH", "NO_MATCH")
FAILED = "LLM_FAILED"
NETWORK_MARKERS = ("tls:", "read tcp", "dial tcp", "connection reset", "eof", "context deadline exceeded", "no such host", "wsarecv", "connection refused", "timeout", "unauthorized")
WAITS = (3, 8, 20)
ANSWER = "array<struct<id:int,decision:string,chosen_match:string,reasoning:string,self_reported_confidence:string>>"
LOG = "key string, id int, decision string, chosen_match string, reasoning string, self_reported_confidence string, model_used string, timestamp string"


def last_wins(log: DataFrame, key: str = "key", at: str = "timestamp") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("id"))
    return log.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def split_by_cache(pool: DataFrame, log: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(already decided, to process); the keys to process are distinct."""
    known = log.select(key).distinct()
    return pool.join(known, key, "left_semi"), pool.join(known, key, "left_anti").dropDuplicates([key])


def purge_log(spark: SparkSession, path: str, to: str, dry_run: bool = False) -> tuple[int, int]:
    """(failed, total) of the log under path; unless dry_run, or where none failed, the log without them is written to ``to``.

    The log under path stays as it is and so is the backup. One log a call: match and parse logs are purged apart.
    """
    log = spark.read.schema(LOG).json(path)
    kept, counts = purge_failed(log)
    row = counts.first()
    if row["failed"] and not dry_run:
        kept.write.json(to)
    return row["failed"], row["total"]


def purge_failed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log without failed records, counts) for a new version of the log; nothing is overwritten."""
    return log.filter(~F.col("decision").eqNullSafe(F.lit(FAILED))), log.agg(F.count_if(F.col("decision") == FAILED).alias("failed"), F.count(F.lit(1)).alias("total"))


def response_array(text: Column, schema: str = ANSWER) -> Column:
    """The JSON array in a response: fences off; an array, or the first list inside an object, or what stands in brackets."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?", ""), r"```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    whole = F.when(bare.startswith("["), F.from_json(bare, schema))
    return F.coalesce(whole, F.from_json(F.nullif(inner, F.lit("")), schema))


def valid_response(answers: Column, size: Column, candidates: Column | None = None) -> Column:
    """As many answers as asked, ids 0..size-1 each once, known decisions, chosen names among the candidates by id."""
    ids = F.transform(answers, lambda a: a["id"])
    ok = (F.size(answers) == size) & (F.size(F.array_distinct(ids)) == size) & F.forall(answers, lambda a: (a["id"] >= 0) & (a["id"] < size) & a["decision"].isin(*DECISIONS))
    if candidates is not None:
        ok = ok & F.forall(answers, lambda a: a["chosen_match"].isNull() | F.array_contains(F.get(candidates, a["id"]), a["chosen_match"]))
    return F.coalesce(ok, F.lit(False))


def is_network_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(m.replace(".", r"\.") for m in NETWORK_MARKERS))


def requests(pool: DataFrame, order: list[str], size: int = 15, coarse: Column | None = None) -> DataFrame:
    """(batch, size, request, keys, candidates): JSON requests of at most ``size`` items; pool has key, name, candidates."""
    rows = batches(pool, order, size, coarse)
    item = F.struct("id", "name", "candidates", "key")
    got = rows.groupBy("batch").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return got.select(
        "batch", F.size("items").alias("size"), F.to_json(F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["name"].alias("name"), i["candidates"].alias("candidates")))).alias("request"),
        F.transform("items", lambda i: i["key"]).alias("keys"), F.transform("items", lambda i: i["candidates"]).alias("candidates"),
    )


def call(asked: DataFrame, client: Callable[[str], str], model: str, retries: int = 1, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The decision log of the requests; network-shaped errors are retried after growing waits, bad answers ``retries`` times."""

    def once(request: str) -> str | None:
        for pause in (*WAITS, None):
            try:
                return client(request)
            except Exception as error:  # noqa: BLE001 - the service may raise anything; other errors than network ones end the batch
                if pause is None or not any(m in str(error).lower() for m in NETWORK_MARKERS):
                    return None
                wait(pause)
        return None

    def parse(text: str | None, keys: list, candidates: list) -> list[dict] | None:
        if text is None:
            return None
        text = text.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
        try:
            got = json.loads(text)
        except ValueError:
            a, b = text.find("["), text.rfind("]")
            try:
                got = json.loads(text[a : b + 1]) if 0 <= a < b else None
            except ValueError:
                return None
        if isinstance(got, dict):
            got = next((v for v in got.values() if isinstance(v, list)), None)
        if not isinstance(got, list) or len(got) != len(keys) or {a.get("id") for a in got if isinstance(a, dict)} != set(range(len(keys))):
            return None
        if any(a.get("decision") not in DECISIONS or (a.get("chosen_match") is not None and a["chosen_match"] not in list(candidates[a["id"]])) for a in got):
            return None
        return got

    def work(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_:
            rows = []
            for r in pdf.itertuples():
                answers = None
                for _ in range(retries + 1):
                    answers = parse(once(r.request), list(r.keys), list(r.candidates))
                    if answers is not None:
                        break
                now = time.strftime("%Y-%m-%dT%H:%M:%S")
                by_id = {a["id"]: a for a in answers} if answers is not None else {}
                for i, key in enumerate(r.keys):
                    a = by_id.get(i, {"decision": FAILED})
                    rows.append((key, i, a["decision"], a.get("chosen_match"), a.get("reasoning"), a.get("self_reported_confidence"), model, now))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in LOG.split(", ")])

    return asked.select("request", "keys", "candidates").mapInPandas(work, LOG)


def final_status(matched: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """matched (key, tier, best_match) with final_status and best_match after the decisions."""
    d = last_wins(log).select(F.col("key").alias("__key"), F.col("decision").alias("__d"), F.col("chosen_match").alias("__m"))
    out = matched.join(d, F.col(key) == F.col("__key"), "left")
    medium = F.col("tier") == "MEDIUM_LLM_REVIEW"
    status = (
        F.when(F.col("tier") == "HIGH_AUTO_ACCEPT", "AUTO_ACCEPTED").when(F.col("tier") == "LOW_NO_MATCH", "NO_MATCH").when(F.col("__d").isNull(), "Unresolved")
        .when(F.col("__d") == FAILED, FAILED).when(F.col("__d") == "NO_MATCH", "LLM_REJECTED").when(F.col("__d").isin("CONFIRM", "CORRECTED_MATCH"), "LLM_CONFIRMED")
    )
    best = F.when(medium & (F.col("__d") == "NO_MATCH"), None).when(medium & F.col("__d").isin("CONFIRM", "CORRECTED_MATCH"), F.coalesce("__m", "best_match")).otherwise(F.col("best_match"))
    return out.withColumn("final_status", status).withColumn("best_match", best).drop("__key", "__d", "__m")


def merge_parsed(parsed: DataFrame, log: DataFrame, fields: list[str], key: str = "key") -> DataFrame:
    """Regex fields overridden by logged ones where review was needed and the logged one is not null; parse_source says which."""
    d = last_wins(log)
    out = parsed.join(d.select(F.col("key").alias("__key"), F.col("decision").alias("__d"), *[F.col(f).alias(f"__{f}") for f in fields]), F.col(key) == F.col("__key"), "left")
    use = F.col("needs_review") & F.col("__key").isNotNull() & ~F.col("__d").eqNullSafe(F.lit(FAILED))
    source = F.when(~F.col("needs_review"), "Regex").when(F.col("__key").isNull(), "Unresolved").when(F.col("__d") == FAILED, FAILED).otherwise("LLM")
    return out.withColumns({f: F.when(use, F.coalesce(f"__{f}", f)).otherwise(F.col(f)) for f in fields}).withColumn("parse_source", source).drop("__key", "__d", *[f"__{f}" for f in fields])
