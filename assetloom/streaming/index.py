"""Incremental indexing and step streams with Structured Streaming; both end when the input is read (available-now by default)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from assetloom.operators.incremental import change_plan, upsert_assets
from assetloom.plans.durable import Scratch
from assetloom.plans.ranked import first_by

ASSETS = "path string, content string, version long"
STEPS = "owner long, ts timestamp, ord long, kind string"


MANIFEST = "kind string, shard int, folder string"
ROWS = "path string, hash string, n_lines int, version long, shard int"


def _batches(spark: SparkSession, snapshot_path: str) -> list[int]:
    """Numbers of the batches whose manifests are written to the end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot_path}/batch-*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(x.getPath().getParent().getName().rpartition("-")[2]) for x in found)


def _manifest(spark: SparkSession, snapshot_path: str, before: int | None = None) -> tuple[dict[int, str], list[str]]:
    """Folder of each shard, and the folders of facts, in the latest finished manifest (of a batch ``before`` that one). It has a row a shard and one for each batch that wrote facts."""
    done = [n for n in _batches(spark, snapshot_path) if before is None or n < before]
    rows = spark.read.schema(MANIFEST).parquet(f"{snapshot_path}/batch-{done[-1]}").collect() if done else []
    return {r.shard: r.folder for r in rows if r.kind == "shard"}, [r.folder for r in rows if r.kind == "facts"]


def _rows(spark: SparkSession, snapshot_path: str, folders: dict[int, str], shards: list[int] | None = None) -> DataFrame:
    paths = [f"{snapshot_path}/data/{folder}/shard={i}" for i, folder in folders.items() if shards is None or i in shards]
    if not paths:
        return spark.createDataFrame([], ROWS).drop("shard")
    return spark.read.schema(ROWS.rpartition(",")[0]).parquet(*paths)


def current_snapshot(spark: SparkSession, snapshot_path: str, before: int | None = None) -> DataFrame | None:
    """The rows of the latest finished manifest (of a batch ``before`` that one); None before the first batch."""
    folders, _ = _manifest(spark, snapshot_path, before)
    return _rows(spark, snapshot_path, folders) if folders else None


def current_facts(spark: SparkSession, snapshot_path: str) -> DataFrame | None:
    """What has been extracted from the assets as they are now (path, hash and further columns); None where nothing was."""
    folders, facts = _manifest(spark, snapshot_path)
    if not facts:
        return None
    return spark.read.parquet(*(f"{snapshot_path}/facts/{x}" for x in facts)).distinct().join(_rows(spark, snapshot_path, folders).select("path", "hash"), ["path", "hash"], "left_semi")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stream_index(spark: SparkSession, input_path: str, snapshot_path: str, checkpoint_path: str, trigger: dict | None = None, keep: int = 3, shards: int = 64, extract: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """New and changed assets (``ASSETS`` as JSON files) update a snapshot: path, hash, n_lines, version. Unchanged assets keep their rows; of several versions of a path the last counts.

    Rows lie in shards by a hash of their path, in files that are never changed. A batch writes the shards in which something has changed to a folder of its own, and then a manifest that says
    which folder holds each shard; a manifest counts once Spark has marked it as finished. So what is written grows with the batch, a driver
    lost between shards and manifest leaves the state as it was, and a batch that is run again writes folders of its own again. The last ``keep`` manifests stay, and the folders that they name.

    ``extract`` takes the changed assets (path, hash, content) and returns rows with path and hash; they are kept as ``current_facts``, and nothing is extracted again from what
    hasn't changed. It runs on the cluster, as part of the batch's plan."""

    def apply(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        scratch = Scratch(s)
        last = first_by(batch, ["path"], [F.col("version").desc(), "content"])
        new = scratch.saved(last.select("path", F.sha2("content", 256).alias("hash"), F.size(F.split("content", "\n")).alias("n_lines"), "version", "content", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int").alias("shard")))
        folders, facts = _manifest(s, snapshot_path, number)
        touched = [r.shard for r in new.select("shard").distinct().collect()]  # ``shards`` at most
        old = _rows(s, snapshot_path, folders, touched)
        stale = new.join(old.select("path", F.col("version").alias("had")), "path", "left").where(F.col("had").isNull() | (F.col("version") >= F.col("had"))).drop("had")
        plan = change_plan(old, stale.select("path", "hash", "n_lines", "version"))
        changed = scratch.saved(stale.join(plan.where("status <> 'unchanged'").select("path"), "path", "left_semi"))
        hit = [r.shard for r in changed.select("shard").distinct().collect()]
        if hit:
            name = f"{number}-{uuid.uuid4().hex}"
            merged = upsert_assets(_rows(s, snapshot_path, folders, hit), changed.select("path", "hash", "n_lines", "version"))
            merged.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")).repartition("shard").write.partitionBy("shard").parquet(f"{snapshot_path}/data/{name}")
            folders = folders | dict.fromkeys(hit, name)
            if extract is not None:
                extract(changed.select("path", "hash", "content")).write.parquet(f"{snapshot_path}/facts/{name}")
                facts = [*facts, name]
        rows = [("shard", i, x) for i, x in folders.items()] + [("facts", None, x) for x in facts]
        s.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{snapshot_path}/batch-{number}")
        scratch.clear()
        done = _batches(s, snapshot_path)
        used = {x for n in done[-keep:] for x in _manifest(s, snapshot_path, n + 1)[0].values()}
        before = {x for n in done[:-keep] for x in _manifest(s, snapshot_path, n + 1)[0].values()}
        for x in before - used:
            _delete(s, f"{snapshot_path}/data/{x}")
        for n in done[:-keep]:
            _delete(s, f"{snapshot_path}/batch-{n}")

    source = spark.readStream.schema(ASSETS).json(input_path)
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start()


_STATE = "kinds array<string>, us array<long>, ords array<long>, last long"
_CLOSED = "owner long, kind string, us long, ord long, rank int"


def _first_steps(idle_ms: int):
    """State of one owner: the first step of each kind by event time, whatever order they come in; emitted and forgotten when the owner has been idle."""

    def run(key, frames, state):
        if state.hasTimedOut:
            kinds, us, ords, _ = state.get
            state.remove()
            found = sorted(zip(us, ords, kinds, strict=True))
            yield pd.DataFrame({"owner": [key[0]] * len(found), "kind": [x[2] for x in found], "us": [x[0] for x in found], "ord": [x[1] for x in found], "rank": range(1, len(found) + 1)})
            return
        first, last = {}, None
        if state.exists:
            kinds, us, ords, last = state.get
            first = dict(zip(kinds, zip(us, ords, strict=True), strict=True))
        for f in frames:
            f = f[f["counts"]]
            if f.empty:
                continue
            last = max(int(f["us"].max()), last or 0)
            for kind, at in f.sort_values(["us", "ord"]).groupby("kind").first()[["us", "ord"]].iterrows():
                at = (int(at["us"]), int(at["ord"]))
                first[kind] = min(at, first.get(kind, at))
        if last is None:
            return
        state.update(([*first], [x[0] for x in first.values()], [x[1] for x in first.values()], last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    return run


def stream_steps(spark: SparkSession, input_path: str, output_path: str, checkpoint_path: str, delay: str = "1 day", idle_hours: int = 24, drop_kinds: tuple[str, ...] = (), trigger: dict | None = None) -> StreamingQuery:
    """The first step of each kind of an owner, in order of event time: (owner, kind, ts, ord, rank), appended as Parquet.

    A step may come late and out of order by ``delay``; later ones are dropped by the watermark. An owner is closed once the watermark is ``idle_hours`` past its last step, and
    its rows are written then, ranked from 1 as in ``edges_sequence``; what comes afterwards begins anew. State is one entry for each kind of an open owner.
    Rows without owner, kind or time move the watermark only, as do those of ``drop_kinds``."""
    steps = spark.readStream.schema(STEPS).json(input_path).withWatermark("ts", delay)
    counts = F.col("owner").isNotNull() & F.col("kind").isNotNull() & F.col("ts").isNotNull() & ~F.coalesce(F.col("kind").isin(*drop_kinds), F.lit(False))
    keyed = steps.select("owner", "kind", "ts", F.unix_micros("ts").alias("us"), F.coalesce("ord", F.lit(0)).alias("ord"), counts.alias("counts"))  # a filter would be pushed below the watermark
    closed = keyed.groupBy("owner").applyInPandasWithState(_first_steps(idle_hours * 3_600_000), _CLOSED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    rows = closed.select("owner", "kind", F.timestamp_micros("us").alias("ts"), "ord", "rank")
    return rows.writeStream.format("parquet").option("path", output_path).option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start()
