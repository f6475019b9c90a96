"""Structured Streaming: windows, sessions, quotas, masks and ingestion over file streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.guard import Masker
from granary.operators.said import Memory
from granary.sources.commits import Commits


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream. Checkpointing takes the place of a queue with claims: a file is taken once, in the
    order of its time, and again after a failure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_time(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """ts as an instant (a watermark needs one), with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, size: str, *keys: str, slide: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """start, keys, n and total of windows of `size`, every `slide` where given."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(window.alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, start, end and n of runs of events with less than `gap` between them."""
    return events.groupBy(F.session_window(ts, gap).alias("_w"), key).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def once(events: DataFrame, *keys: str) -> DataFrame:
    """Events without those of keys that came before, within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def masked(tokens: DataFrame, keywords: list[str], mask: str = "***") -> DataFrame:
    """run_id and text of a stream of tokens (run_id, seq, token, last): what each batch lets go. The tail of a run that may still
    become a keyword waits in the state, until the run's last token. Batches of a run are taken in the order of seq."""

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("seq")
        masker = Masker(keywords, mask, state.get[0] if state.exists else "")
        out = "".join(masker.append(t or "") for t in rows["token"])
        if rows["last"].any():
            out += masker.finish()
            if state.exists:
                state.remove()
        else:
            state.update((masker.pending,))
        yield pd.DataFrame({"run_id": [key[0]], "text": [out]})

    kind = tokens.schema["run_id"].dataType.simpleString()
    return tokens.groupBy("run_id").applyInPandasWithState(step, f"run_id {kind}, text string", "pending string", "append", GroupStateTimeout.NoTimeout)


def quota_decisions(requests: DataFrame, daily: int, monthly: int) -> DataFrame:
    """request_id, user_id and allowed of a stream of requests (request_id, user_id, day, tokens), in the order of request_id: a request
    is let through while what was used before is below the limits (-1: none), and counts from then on. Counters start
    again with a new day or month."""

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        day, month, used_day, used_month = state.get if state.exists else ("", "", 0, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("request_id").itertuples():
            now = str(row.day)
            if now > day:
                day, used_day = now, 0
            if now[:7] > month:
                month, used_month = now[:7], 0
            allowed = (daily < 0 or used_day < daily) and (monthly < 0 or used_month < monthly)
            if allowed:
                used_day, used_month = used_day + int(row.tokens), used_month + int(row.tokens)
            out.append((row.request_id, key[0], allowed))
        state.update((day, month, used_day, used_month))
        yield pd.DataFrame(out, columns=["request_id", "user_id", "allowed"])

    return requests.withColumn("day", F.col("day").cast("string")).groupBy("user_id").applyInPandasWithState(
        step, "request_id long, user_id long, allowed boolean", "day string, month string, used_day long, used_month long", "append", GroupStateTimeout.NoTimeout
    )


def latest_facts(found: DataFrame) -> DataFrame:
    """Versions of facts in a stream (session_id, seq, key, value): a row for each change, with what it supersedes. Repeated messages
    change nothing, and late ones are never dropped: they are told as such and don't replace what came after them.
    The state is a session's last values: a call to Python costs more than a session's rows, so it is not made for each key."""

    def step(key, frames: Iterator, state: GroupState):
        import json

        import pandas as pd

        held = {k: (seq, value) for k, seq, value in json.loads(state.get[0])} if state.exists else {}
        rows, out = [row for f in frames for row in zip(f["seq"].tolist(), f["key"].tolist(), f["value"].tolist(), strict=True)], []
        rows.sort(key=lambda row: row[0])
        for now, name, said in rows:
            seq, value = held.get(name, (-1, None))
            if now > seq:
                if said != value:
                    out.append((key[0], name, now, said, value, False))
                held[name] = (now, said)
            elif now < seq:
                out.append((key[0], name, now, said, None, True))
        state.update((json.dumps([(k, *last) for k, last in held.items()]),))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "key", "seq", "value", "superseded", "late"])

    return found.groupBy("session_id").applyInPandasWithState(step, "session_id long, key string, seq long, value string, superseded string, late boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def remembered(found: DataFrame, most: int = 128) -> DataFrame:
    """session_id, seq, position, key, value, outcome and replaced of a stream of facts (memory.facts()): what becomes of each, in the order of
    messages, by said.Memory. A session's state is its active facts, at most `most`; facts of messages before the last one taken are
    LATE: they are told as such and change nothing."""

    def step(key, frames: Iterator, state: GroupState):
        import json

        import pandas as pd

        last, held = state.get if state.exists else (-1, "{}")
        memory, out = Memory(json.loads(held), most), []
        for row in pd.concat(list(frames)).sort_values(["seq", "position"]).itertuples():
            outcome, replaced = ("LATE", None) if row.seq < last else memory.step(row.key, row.value, row.scope, row.field, bool(row.correction))
            last = max(last, row.seq)
            out.append((key[0], row.seq, row.position, row.key, row.value, outcome, replaced))
        state.update((int(last), json.dumps(memory.active)))
        yield pd.DataFrame(out, columns=["session_id", "seq", "position", "key", "value", "outcome", "replaced"])

    return found.groupBy("session_id").applyInPandasWithState(
        step, "session_id long, seq long, position int, key string, value string, outcome string, replaced string", "last long, held string", "append", GroupStateTimeout.NoTimeout
    )


def ingest(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs `work` over each batch and writes its rows under the batch's number, over what an interrupted try left: so that a
    batch counts once. Ends when the stream's present files are done."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_documents(stream: DataFrame, work: Callable[[DataFrame], DataFrame], into: Commits, checkpoint: str, status: str = "READY"):
    """Runs `work` over each batch of documents and commits what it gives (rows with the key of `into`) together with a status for every document of
    the batch, those without rows too: staged first, then pointed to, so a batch that is killed shows neither rows nor status. A
    batch that is taken again after that commits under its old version and counts once. Ends when the present files are done."""

    def write(batch: DataFrame, number: int) -> None:
        attempt = into.stage(work(batch))
        into.commit(batch.select(*into.key).distinct().withColumn("status", F.lit(status)), attempt, version=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_state(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, now: str, failed: DataFrame | None = None, timeout_minutes: int = 15) -> DataFrame:
    """document_id, chunks, vectors, progress and status by what is there: PENDING without chunks (FAILED once it is older than the
    timeout), VECTORIZING with some vectors missing, READY with all; FAILED where an error is on record."""
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    v = vectors.groupBy("document_id").agg(F.count("*").alias("vectors"))
    joined = documents.join(c, "document_id", "left").join(v, "document_id", "left").na.fill(0, ["chunks", "vectors"])
    joined = joined.join(failed.select("document_id", F.lit(True).alias("_failed")), "document_id", "left") if failed is not None else joined.withColumn("_failed", F.lit(None).cast("boolean"))
    late = F.col("created_at") < F.to_timestamp(F.lit(now)) - F.expr(f"interval {timeout_minutes} minutes")
    status = F.when(F.col("_failed"), "FAILED").when((F.col("chunks") == 0) & late, "FAILED").when(F.col("chunks") == 0, "PENDING").when(F.col("vectors") < F.col("chunks"), "VECTORIZING").otherwise("READY")
    return joined.select("document_id", "chunks", "vectors", F.round(F.try_divide(F.col("vectors"), F.col("chunks")), 4).alias("progress"), status.alias("status"))
