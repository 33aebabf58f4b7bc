"""Trials: their records, their log, cost, leaderboard and marginals."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftwell import schema
from siftwell.errors import ConfigError, StorageError
from siftwell.operators.store import latest
from siftwell.plans.component import digest16
from siftwell.sources.folders import Folder

#: fixed values: stages that are paid once a corpus, and those that are paid for each question
INDEX_STAGES = ("parse", "store_raw", "store_parsed", "chunk", "enrich")
QUERY_STAGES = ("retrieve", "refine", "generate")


def trial_id(spec: Mapping) -> str:
    return digest16(spec)


@dataclass(frozen=True)
class Trial:
    """What ran, how well, and at what cost."""

    trial_id: str
    pipeline_spec: dict
    fingerprints: dict[str, str]
    metrics: dict[str, float] = field(default_factory=dict)
    cost: dict[str, float] = field(default_factory=dict)
    cache_hits: dict[str, bool] = field(default_factory=dict)
    started_at: str = ""
    finished_at: str = ""
    metadata: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)

    @classmethod
    def from_json(cls, line: str) -> Trial:
        record = json.loads(line)
        if extra := sorted(set(record) - {f.name for f in fields(cls)}):
            raise ValueError(f"a trial has no {', '.join(extra)}; a later version may have written it")
        return cls(**record)


class TrialLog:
    """One JSON line for each trial, appended and synced as it ends; read and queried through Spark."""

    def __init__(self, path: str):
        self.path = path

    def append(self, trial: Trial) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(trial.to_json() + "\n")
            f.flush()
            os.fsync(f.fileno())

    def __iter__(self) -> Iterator[Trial]:
        if not os.path.exists(self.path):
            return
        with open(self.path, encoding="utf-8") as f:
            yield from self._trials(f)

    def _trials(self, lines) -> Iterator[Trial]:
        for number, line in enumerate(lines, 1):
            if line.strip():
                try:
                    yield Trial.from_json(line)
                except (ValueError, TypeError) as error:
                    raise StorageError(f"{self.path}, line {number}: {error}") from error

    def read(self) -> list[Trial]:
        return list(self)

    def latest(self) -> dict[str, Trial]:
        """The last record of each trial."""
        return {t.trial_id: t for t in self}

    def frame(self, spark: SparkSession) -> DataFrame:
        """All records with line, their order in the log; spec as JSON, metadata as text."""
        return parsed(spark.read.text(self.path), self.path)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        """sql over the view trials, the latest record of each trial."""
        latest(self.frame(spark), "trial_id", "line").createOrReplaceTempView("trials")
        return spark.sql(sql)


class SharedTrialLog(TrialLog):
    """A log that many writers append to, in a folder of any Hadoop file system.

    Each append is a file of its own, which is there whole or not at all.  Its
    record has a sequence, nanoseconds of the writer's clock and never less than
    its last one, by which readers order records, whatever files they lie in.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(path.rstrip("/"))
        self.spark, self._folder, self._last = spark, Folder(spark, path), 0

    def append(self, trial: Trial) -> None:
        self._last = max(time.time_ns(), self._last + 1)
        record = {"seq": self._last} | json.loads(trial.to_json())
        self._folder.put(f"{self._last:020d}-{uuid.uuid4().hex}.json", (json.dumps(record, sort_keys=True) + "\n").encode())

    def __iter__(self) -> Iterator[Trial]:
        if not self._folder.names():
            return iter(())
        lines = self.spark.read.text(self.path).where(F.trim("value") != "").withColumn("seq", F.get_json_object("value", "$.seq").cast("long")).orderBy("seq", "value")
        return self._trials(json.dumps({k: v for k, v in json.loads(r.value).items() if k != "seq"}) if r.seq is not None else r.value for r in lines.toLocalIterator())


def parsed(lines: DataFrame, name: str = "log") -> DataFrame:
    """Trial records of JSON lines (value), with line, the sequence in the record or else its place; a line that is none is an error."""
    place = F.coalesce(F.get_json_object("value", "$.seq").cast("long"), F.monotonically_increasing_id())
    numbered = lines.withColumn("line", place).where(F.trim("value") != "")
    rows = numbered.select(F.from_json("value", schema.TRIAL).alias("t"), "line").select("t.*", "line")
    bad = F.raise_error(F.concat(F.lit(f"{name} has a line that is no trial, number "), F.col("line").cast("string")))
    return rows.withColumn("trial_id", F.when(F.col("trial_id").isNull(), bad).otherwise(F.col("trial_id")))


def trial_frame(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """The same records from trials in memory, one row for each trial."""
    rows = spark.createDataFrame([(n, t.to_json()) for n, t in enumerate(trials)], "n long, value string")
    kept = rows.select("n", F.from_json("value", schema.TRIAL).alias("t")).select("t.*", F.col("n").alias("line"))
    return latest(kept, "trial_id", "line")


# --- cost ---------------------------------------------------------------------------------------------------------------


def stage_cost(trace: DataFrame, key: str = "trial_id") -> DataFrame:
    """(key, stage, duration_ms, cache_hit): sums; a stage hit the cache if all of it did."""
    return trace.groupBy(key, "stage").agg(F.sum("duration_ms").alias("duration_ms"), F.bool_and("cache_hit").alias("cache_hit"), F.count("*").alias("events"))


def cost_rollup(trace: DataFrame, key: str = "trial_id") -> DataFrame:
    """(key, latency_ms, index_ms, query_ms, events) of trace events."""
    of = lambda stages: F.sum(F.when(F.col("stage").isin(list(stages)), F.col("duration_ms")).otherwise(0.0))
    return trace.groupBy(key).agg(F.sum("duration_ms").alias("latency_ms"), of(INDEX_STAGES).alias("index_ms"), of(QUERY_STAGES).alias("query_ms"), F.count("*").alias("events"))


def usage_cost(trace: DataFrame, prices: Mapping[str, float] | None = None, key: str = "trial_id") -> DataFrame:
    """(key, usage, api_usd): amounts by name; api_usd is null unless something of the trial has a price."""
    sums = trace.select(key, F.explode("usage").alias("name", "amount")).groupBy(key, "name").agg(F.sum("amount").alias("amount"))
    price = F.create_map(*[x for k, v in (prices or {}).items() for x in (F.lit(k), F.lit(float(v)))]) if prices else F.create_map().cast("map<string,double>")
    priced = sums.withColumn("usd", F.col("amount") * F.try_element_at(price, F.col("name")))
    return priced.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "amount")))).alias("usage"), F.sum("usd").alias("api_usd"))


def trial_costs(trace: DataFrame, prices: Mapping[str, float] | None = None, key: str = "trial_id") -> DataFrame:
    """(key, cost, cache_hits): all sums of a trial's trace events as one map, and which stages were read from a cache.

    A stage without a word on caches has no entry; api_usd stands there only if
    something has a price.
    """
    entry = lambda name, value: F.struct(name.alias("name"), value.cast("double").alias("value"))
    sums = cost_rollup(trace, key).select(key, F.array(*[entry(F.lit(c), F.col(c)) for c in ("latency_ms", "index_ms", "query_ms")]).alias("sums"))
    stages = stage_cost(trace, key).groupBy(key).agg(F.collect_list(entry(F.concat(F.lit("latency_ms."), "stage"), F.col("duration_ms"))).alias("stages"))
    known = trace.where("cache_hit is not null").groupBy(key, "stage").agg(F.bool_and("cache_hit").alias("hit"))
    hits = known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("stage", "hit"))).alias("cache_hits"))
    used = usage_cost(trace, prices, key)
    used = used.select(key, F.concat(F.transform(F.map_entries("usage"), lambda e: entry(e["key"], e["value"])), F.when(F.col("api_usd").isNull(), F.array().cast("array<struct<name:string,value:double>>")).otherwise(F.array(entry(F.lit("api_usd"), F.col("api_usd"))))).alias("used"))
    none = F.array().cast("array<struct<name:string,value:double>>")
    rows = sums.join(stages, key).join(used, key, "left").join(hits, key, "left")
    return rows.select(key, F.map_from_entries(F.concat("sums", "stages", F.coalesce("used", none))).alias("cost"), F.coalesce("cache_hits", F.create_map().cast("map<string,boolean>")).alias("cache_hits"))


class Trace:
    """Events of one run, kept on the driver until they are made a table."""

    def __init__(self, trial: str = ""):
        self.trial, self.events = trial, []

    def __call__(self, stage: str, duration_ms: float, cache_hit: bool | None = None, usage: Mapping | None = None, rows: int | None = None) -> None:
        """The rows of a stage are a number of its usage."""
        numbers = {k: float(v) for k, v in (usage or {}).items() if type(v) in (int, float)}
        if rows is not None:
            numbers[f"rows.{stage}"] = float(rows)
        self.events.append((self.trial, stage, float(duration_ms), cache_hit, numbers))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, schema.TRACE)


# --- leaderboard ----------------------------------------------------------------------------------------------------------

_ENTRIES = "array<struct<name:string,config:map<string,string>,params:map<string,string>>>"


def option(spec: Column, stage: str) -> Column:
    """What a spec (JSON) has at a stage, as text: name(setting=value,...), a chain joined by +, none for an empty one; null without the stage."""
    entries = F.from_json(F.get_json_object(spec, f"$.{stage}"), _ENTRIES)

    def shown(e):
        settings = F.coalesce(e["config"], e["params"], F.create_map().cast("map<string,string>"))
        pairs = F.transform(F.array_sort(F.map_entries(settings)), lambda p: F.concat_ws("=", p["key"], p["value"]))
        return F.concat(F.coalesce(e["name"], F.lit("?")), F.when(F.size(pairs) > 0, F.concat(F.lit("("), F.array_join(pairs, ","), F.lit(")"))).otherwise(F.lit("")))

    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, shown), "+")).when(entries.isNotNull(), F.lit("none"))


def top(trials: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """The n best of trials (trial_id, metrics map, cost map) that have metric; ties by id."""
    if n <= 0:
        raise ConfigError(f"top needs a positive number, not {n}")
    value = F.try_element_at("metrics", F.lit(metric))
    return trials.withColumn("value", value).where("value is not null").orderBy(F.col("value").desc(), "trial_id").limit(n)


def marginals(rows: DataFrame, stages: Sequence[str] = ("option",), metric: str = "metric", cost: str = "cost") -> DataFrame:
    """(stage, option, trials, quality, cost): each option's mean less the mean of all, for every stage in one pass.

    rows has a column for each stage with the label of the trial's option; a
    trial without a cost counts 0.
    """
    known = rows.where(F.col(metric).isNotNull()).withColumn("__c", F.coalesce(F.col(cost), F.lit(0.0)))
    overall = known.agg(F.avg(metric).alias("__q_all"), F.avg("__c").alias("__c_all"))
    flat = known.select(metric, "__c", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("string").alias("option")) for s in stages])).alias("o"))
    groups = flat.where("o.option is not null").groupBy("o.stage", "o.option").agg(F.count("*").alias("trials"), F.avg(metric).alias("q"), F.avg("__c").alias("c"))
    return groups.crossJoin(F.broadcast(overall)).select("stage", "option", "trials", (F.col("q") - F.col("__q_all")).alias("quality"), (F.col("c") - F.col("__c_all")).alias("cost"))


class Leaderboard:
    """A table of trials, one row each, as rankings and as effects of options."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def __len__(self) -> int:
        return self.frame.count()

    def metrics(self) -> list[str]:
        return sorted(r[0] for r in self.frame.select(F.explode(F.map_keys("metrics"))).distinct().collect())

    def _known(self, by: str) -> None:
        if by not in (there := self.metrics()):
            raise ConfigError(f"no trial has {by!r}; there are {', '.join(there) or 'none'}")

    def top(self, n: int = 5, *, by: str) -> DataFrame:
        self._known(by)
        return top(self.frame, by, n)

    def best(self, *, by: str) -> Row | None:
        return self.top(1, by=by).first()

    def stages(self) -> list[str]:
        return sorted(r[0] for r in self.frame.select(F.explode(F.json_object_keys("pipeline_spec"))).distinct().collect())

    def marginals(self, *stages: str, by: str, cost: str = "query_ms") -> DataFrame:
        """(stage, option, trials, quality, cost) of the named stages, of all by default."""
        self._known(by)
        there = self.stages()
        if lacking := sorted(set(stages) - set(there)):
            raise ConfigError(f"no trial has a stage {', '.join(lacking)}; there are {', '.join(there)}")
        names = stages or there
        rows = self.frame.select(F.try_element_at("metrics", F.lit(by)).alias("metric"), F.try_element_at("cost", F.lit(cost)).alias("price"), *[option(F.col("pipeline_spec"), s).alias(s) for s in names])
        return marginals(rows, names, "metric", "price").orderBy("stage", F.col("quality").desc(), "option")

    def to_table(self, *, by: str, n: int = 10, cost: str = "query_ms") -> str:
        """The best trials as a table in markdown."""
        rows = self.top(n, by=by).select("trial_id", "value", F.try_element_at("cost", F.lit(cost)).alias("price")).collect() if by in self.metrics() else []
        body = [f"| {r.trial_id} | {r.value:.4g} | {'' if r.price is None else f'{r.price:.4g}'} |" for r in rows]
        return "\n".join([f"| trial | {by} | {cost} |", "|-|-|-|", *body])
