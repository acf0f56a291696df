"""The ledger of batches: what was asked, what left under which batch, what has come back.

Below `path`:
  runs/R              who rates a run of requests, in which version
  asked/run=R         what is asked, with its chunk: written once for a whole run, each file by chunk; a chunk is what one
                      call to the rater takes. (requests/run=R/chunk=K in ledgers from before; they are read too)
  members/run=R       for batches that were found at the rater: all ids they have, with a request here or without
  events/R-K/N        what became of batch K of run R: one file for each change of state

A change of state is a file with the next number. Files are created whole and only where none is, so of several writers
that saw the same state one makes the change and the others learn that they did not. Before a call to the rater its
intent is noted, with a key under which the rater knows the call: after a crash in between, the rater is asked for the key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.answers import parsed
from quorate.functions.text import custom_id_parts
from quorate.operators.state import collected, last_write
from quorate.sources.shared import create_once, file_system, read_text

INTENDED, REFUSED, SUBMITTED, COLLECTED, FAILED, CANCELLED = "intended", "refused", "submitted", "collected", "failed", "cancelled"
#: What may follow a state; None: nothing is noted yet.
FOLLOWS = {None: (INTENDED, SUBMITTED), INTENDED: (SUBMITTED, REFUSED), REFUSED: (INTENDED,), SUBMITTED: (COLLECTED, FAILED, CANCELLED)}
#: States in which a request is at the rater or was, so that it is not to be submitted again.
TAKEN = (SUBMITTED, COLLECTED, FAILED)
REQUEST = "custom_id string, article_id long, company_id long, company string, text string"
PLAIN = ["custom_id", "article_id", "company_id", "company", "text"]
#: Bytes of requests that are read for calls at a time (one chunk at least), and batches whose results are written at a time.
CALL_BYTES, TOGETHER = 16 << 20, 100


class BatchFailed(Exception):
    """A batch, or the rater as a whole, cannot go on."""


class BatchRater(Protocol):
    def submit(self, requests: list[dict], version: str, key: str) -> str:
        """custom_id, text, company of each -> the batch's id, under the caller's key. BatchFailed: nothing was submitted."""

    def sent(self, key: str) -> str | None:
        """The batch that was submitted under this key, if any."""

    def status(self, batch_id: str) -> str:
        """`in_progress` (also where the status can't be had just now) or `ended`. BatchFailed: it never will."""

    def results(self, spark: SparkSession, batch_id: str) -> DataFrame:
        """(custom_id, raw) of an ended batch. BatchFailed: not to be had now, try again later.

        A rater may offer results_of(spark, batch_ids) too, which is asked instead: ((batch_id, custom_id, raw) of many
        batches in one frame, the ids of the batches that can be had now).
        """

    def cancel(self, batch_id: str) -> None:
        """Gives up the batch's place in the queue. BatchFailed: it can't be cancelled (any more)."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    # Files.

    def _names(self, folder: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _any(self, folder: str) -> bool:
        fs, path = file_system(self.spark, f"{self.path}/{folder}")
        return fs.exists(path) and len(fs.listStatus(path)) > 0

    def _table(self, name: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).parquet(f"{self.path}/{name}") if self._any(name) else self.spark.createDataFrame([], shape)

    def _asked(self) -> DataFrame:
        shape = f"{REQUEST}, chunk long, run string"
        asked = self._table("asked", shape)
        return asked.unionByName(self._table("requests", shape)) if self._any("requests") else asked

    def _ask(self, run: str, requests: DataFrame) -> None:
        requests.select(*PLAIN, "chunk").repartition("chunk").sortWithinPartitions("chunk", "custom_id").write.parquet(f"{self.path}/asked/run={run}")

    def state(self, key: str) -> dict | None:
        """The last event of a batch."""
        names = [n for n in self._names(f"events/{key}") if n.isdigit()]
        return json.loads(read_text(self.spark, f"{self.path}/events/{key}/{names[-1]}")) if names else None

    def advance(self, key: str, seen: dict | None, state: str, **facts) -> bool:
        """Notes that the batch, seen in one state, is in another now; False where somebody else has noted a change since."""
        return self._advanced(key, seen, state, **facts) is not None

    def _advanced(self, key: str, seen: dict | None, state: str, **facts) -> dict | None:
        if state not in FOLLOWS.get(seen and seen["state"], ()):
            raise ValueError(f"{seen and seen['state']} cannot become {state}")
        run, chunk = key.rsplit("-", 1)
        event = {**(seen or {"run": run, "chunk": int(chunk), "seq": -1}), **facts, "state": state, "at": time.time()}
        event["seq"] += 1
        return event if create_once(self.spark, f"{self.path}/events/{key}/{event['seq']:06}", json.dumps(event)) else None

    # What is known.

    def _last(self) -> DataFrame:
        """The last event of each batch."""
        shape = "run string, chunk long, seq long, state string, batch_id string, rater string, version string, at double, attempt string"
        log = self.spark.read.schema(shape).json(f"{self.path}/events/*") if self._any("events") else self.spark.createDataFrame([], shape)
        return last_write(log, ["run", "chunk"], F.col("seq"), ["batch_id", "rater", "version", "state", "at", "attempt", "seq"])

    def _states(self) -> dict[str, dict]:
        """The last event of each batch by its key, as state() gives it, of one read of the log: a row a batch."""
        rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in self._last().collect()]
        return {f"{r['run']}-{r['chunk']}": r for r in rows}

    def batches(self) -> DataFrame:
        """(run, chunk, batch_id, rater, version, state, at, attempt): each batch as it stands."""
        return self._last().drop("seq")

    def requests(self) -> DataFrame:
        """(custom_id, batch_id, article_id, company_id, company, text): batch_id is null for what no batch has taken."""
        return self._requests(self.batches())

    def _requests(self, batches: DataFrame) -> DataFrame:
        taken = batches.where(F.col("state").isin(*TAKEN)).select("run", "chunk", "batch_id")
        return self._asked().join(taken, ["run", "chunk"], "left").select("custom_id", "batch_id", *PLAIN[1:])

    def not_submitted(self) -> DataFrame:
        return self.requests().where("batch_id IS NULL")

    def waiting(self) -> DataFrame:
        """Batches that still hold a place in the rater's queue."""
        return self.batches().where(F.col("state") == SUBMITTED)

    def submitted_events(self) -> DataFrame:
        """Events for the evaluations log: what is in flight keeps its note under the new version."""
        return self.requests().join(self.waiting().select("batch_id", "version"), "batch_id").select("article_id", "company_id", "version", F.lit("submitted").alias("status"))

    def without_request(self) -> DataFrame:
        """(batch_id, custom_id): ids that a batch has at the rater, but for which nothing could be asked here."""
        return self._without_request(self.batches())

    def _without_request(self, batches: DataFrame) -> DataFrame:
        members = self._table("members", "custom_id string, run string, chunk long")
        asked = self._asked().select("run", "custom_id").distinct()
        return members.join(asked, ["run", "custom_id"], "left_anti").join(batches, ["run", "chunk"]).select("batch_id", "custom_id")

    def report(self) -> DataFrame:
        """(batch_id, rater, version, state, requests, without_request) of each batch that was ever submitted."""
        count = lambda df, name: df.groupBy("batch_id").agg(F.count("*").alias(name))
        batches = self.batches()
        out = batches.where("batch_id IS NOT NULL").select("batch_id", "rater", "version", "state")
        out = out.join(count(self._requests(batches), "requests"), "batch_id", "left").join(count(self._without_request(batches), "without_request"), "batch_id", "left")
        return out.na.fill(0, ["requests", "without_request"])

    # What is done.

    def submit(self, requests: DataFrame, name: str, rater: BatchRater, version: str) -> int:
        """Submits requests (custom_id, article_id, company_id, company, text, chunk) chunk by chunk; gives how many went.

        The requests are evaluated once, when they are written by chunk; the rows of some calls at a time, CALL_BYTES at most,
        come to the driver. Where a chunk is refused, it and all that follow stay as requests without a batch; if it is the
        first one, nothing stays.
        """
        run = uuid.uuid4().hex
        self._ask(run, requests)
        create_once(self.spark, f"{self.path}/runs/{run}", json.dumps({"rater": name, "version": version}))
        went = self._go_on(run, rater, {})
        if not went:
            for folder in (f"asked/run={run}", f"runs/{run}", *[f"events/{n}" for n in self._names("events") if n.startswith(run)]):
                fs, path = file_system(self.spark, f"{self.path}/{folder}")
                fs.delete(path, True)
        return went

    def resume(self, rater: BatchRater) -> int:
        """Goes on with all runs that a crash or a refusal has cut short; gives how many chunks went."""
        states = self._states()
        return sum(self._go_on(run, rater, states) for run in self._names("runs"))

    def _go_on(self, run: str, rater: BatchRater, states: dict[str, dict]) -> int:
        about = json.loads(read_text(self.spark, f"{self.path}/runs/{run}"))
        went = 0
        done = {e["chunk"] for e in states.values() if e["run"] == run and e["state"] not in (INTENDED, REFUSED)}
        for chunk, asked in self._calls(run, done):
            key = f"{run}-{chunk}"
            seen = self.state(key) if key in states else None
            if seen and seen["state"] not in (INTENDED, REFUSED):
                continue
            batch = None
            if seen and seen["state"] == INTENDED:
                batch = rater.sent(key)
            else:
                seen = self._advanced(key, seen, INTENDED, **about)
                if seen is None:
                    return went  # another one is at it
            try:
                batch = batch or rater.submit(asked, about["version"], key)
            except BatchFailed:
                self.advance(key, seen, REFUSED)
                return went
            went += self.advance(key, seen, SUBMITTED, batch_id=batch)
        return went

    def _calls(self, run: str, done: set[int]) -> Iterator[tuple[int, list[dict]]]:
        """(chunk, its requests by custom_id) of the chunks that are not done, in order; they are read as calls get to them."""
        asked = self._asked().where(F.col("run") == run)
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("custom_id", "text", "company")), F.lit(64))
        sizes = asked.groupBy("chunk").agg(F.sum(size).alias("size"), F.count("*").alias("n")).orderBy("chunk")
        spans, full = [], CALL_BYTES
        for r in sizes.collect():  # a row a chunk
            if r["chunk"] in done:
                full = CALL_BYTES
                continue
            if full + r["size"] > CALL_BYTES:
                spans.append([])
                full = 0
            spans[-1].append(r)
            full += r["size"]
        for span in spans:
            rows = asked.where(F.col("chunk").between(span[0]["chunk"], span[-1]["chunk"])).orderBy("chunk", "custom_id").select("custom_id", "text", "company").toArrow()
            at = 0
            for r in span:
                yield r["chunk"], rows.slice(at, r["n"]).to_pylist()
                at += r["n"]

    def collect(self, rater: BatchRater, log: str, timeout_s: float | None = None) -> int:
        """Asks once after each waiting batch and appends what has ended to the evaluations log; gives how many ended.

        A batch that failed, or is in progress for longer than timeout_s, makes all its requests failed. One whose results
        can't be had stays as it is. A request without a result is failed; a result nobody asked for is ignored. Results are
        written aside, those of TOGETHER batches at a time, a folder each; then each batch's change of state names its folder,
        then that is moved into the log: of two collectors one has its rows in the log, and what a crash leaves unmoved is
        moved next time.
        """
        states = self._states()
        self._publish(log, states.values())
        over = []
        for seen in sorted((e for e in states.values() if e["state"] == SUBMITTED), key=lambda e: e["batch_id"]):
            try:
                if rater.status(seen["batch_id"]) != "in_progress":
                    over.append((seen, COLLECTED))
                elif timeout_s is not None and time.time() - seen["at"] > timeout_s:
                    over.append((seen, FAILED))
            except BatchFailed:
                over.append((seen, FAILED))
        over.sort(key=lambda x: (x[0]["run"], x[0]["chunk"]))  # files have neighbours side by side
        return sum(self._collect(rater, log, over[k : k + TOGETHER]) for k in range(0, len(over), TOGETHER))

    def _collect(self, rater: BatchRater, log: str, over: list[tuple[dict, str]]) -> int:
        """Writes the results of batches (last event, what becomes of it), then notes and publishes them; gives how many."""
        raw, had = self._results(rater, [seen["batch_id"] for seen, state in over if state == COLLECTED])
        got = [(f"{e['run']}-{e['chunk']}", e, state) for e, state in over if state != COLLECTED or e["batch_id"] in had]
        if not got:
            return 0
        tasks = self.spark.sparkContext.defaultParallelism  # by number: what is few bytes is many files and much to parse
        results = parsed(raw.repartition(tasks, "batch_id", "custom_id")).drop("raw")  # behind the shuffle: not once for each batch's frame
        of = self.spark.createDataFrame([(e["run"], e["chunk"], key, e["batch_id"], e["version"]) for key, e, _ in got], "run string, chunk long, _key string, batch_id string, version string")
        chunks = [e["chunk"] for _, e, _ in got]
        asked = self._asked().where(F.col("run").isin(*{e["run"] for _, e, _ in got}) & F.col("chunk").between(min(chunks), max(chunks)))
        asked = asked.join(F.broadcast(of), ["run", "chunk"]).select("batch_id", "custom_id", "article_id", "company_id", "version", "_key")
        rows = collected(asked, results, ["batch_id", "custom_id"]).drop("batch_id")
        attempt = uuid.uuid4().hex
        rows = rows.select(*[c for c in rows.columns if c != "version"], "version").repartition(tasks, "_key")
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("_key").parquet(f"{log}/_aside/{attempt}")
        fs, aside = file_system(self.spark, f"{log}/_aside/{attempt}")
        there = {s.getPath().getName() for s in fs.listStatus(aside)}
        noted = []
        for key, seen, state in got:
            if f"_key={key}" in there:
                noted.append(self._advanced(key, seen, state, attempt=f"{attempt}/_key={key}"))
            else:
                self.advance(key, seen, state)  # a batch that was found, without any request of ours
        noted = [e for e in noted if e]
        self._publish(log, noted)
        return len(noted)

    def _results(self, rater: BatchRater, batches: list[str]) -> tuple[DataFrame, set[str]]:
        """(batch_id, custom_id, raw) of these batches, and which of them can be had now."""
        if hasattr(rater, "results_of"):
            raw, had = rater.results_of(self.spark, batches)
            return raw.select("batch_id", "custom_id", "raw"), set(had)
        frames, had = [], set()
        for batch in batches:
            try:
                frames.append(rater.results(self.spark, batch).select(F.lit(batch).alias("batch_id"), "custom_id", "raw").coalesce(1))
                had.add(batch)
            except BatchFailed:
                continue
        while len(frames) > 1:  # by pairs: each union goes over what is below it
            frames = [a[0].union(a[1]) if len(a) > 1 else a[0] for a in (frames[k : k + 2] for k in range(0, len(frames), 2))]
        return (frames[0] if frames else self.spark.createDataFrame([], "batch_id string, custom_id string, raw string")), had

    def _publish(self, log: str, events: Iterable[dict]) -> None:
        """Moves results that a change of state names into the log, each under its batch's folder."""
        fs, aside = file_system(self.spark, f"{log}/_aside")
        at = lambda name: file_system(self.spark, f"{log}/_aside/{name}")[1]

        def names(path) -> set[str]:
            try:
                return {s.getPath().getName() for s in fs.listStatus(path)}
            except Py4JJavaError:
                if fs.exists(path):  # else there is nothing yet, or another collector has deleted it
                    raise
                return set()

        found = dict.fromkeys(names(aside))
        for e in events:
            top, _, part = e.get("attempt", "").partition("/")
            if top not in found:
                continue
            if part and found[top] is None:
                found[top] = names(at(top))
            if part and part not in found[top]:
                continue
            try:
                fs.rename(at(e["attempt"]), file_system(self.spark, f"{log}/batch_id={e['batch_id']}")[1])
            except Py4JJavaError:
                if fs.exists(at(e["attempt"])):  # else another collector has moved it
                    raise
        for top in [t for t, parts in found.items() if parts is not None]:
            if names(at(top)) <= {"_SUCCESS"}:
                fs.delete(at(top), True)

    def cancel(self, rater: BatchRater) -> list[str]:
        """Cancels all waiting batches, so that they free the rater's queue; their requests are without a batch again. Gives
        the batches that were cancelled; one that can't be stays as it is."""
        done = []
        waiting = [(key, seen) for key, seen in self._states().items() if seen["state"] == SUBMITTED]
        for key, seen in sorted(waiting, key=lambda x: x[1]["batch_id"]):
            try:
                rater.cancel(seen["batch_id"])
            except BatchFailed:
                continue
            if self.advance(key, seen, CANCELLED):
                done.append(seen["batch_id"])
        return done

    def adopt(self, listed: DataFrame, articles: DataFrame, name: str, version: str) -> None:
        """Takes in orphan batches: listed (batch_id, custom_id, ord) as the rater tells them, articles (article_id,
        company_id, company, text) to rebuild requests from.

        Every batch is noted as submitted, with all its ids. An id that several batches have is asked for in the last of
        them. Ids that are malformed or lack an article stay with their batch, without a request.
        """
        run = uuid.uuid4().hex
        order = listed.groupBy("batch_id").agg(F.min("ord").alias("o")).orderBy("o", "batch_id")
        batches = [r["batch_id"] for r in order.collect()]  # a row a batch
        numbers = F.broadcast(self.spark.createDataFrame(list(enumerate(batches)), "chunk long, batch_id string"))
        members = listed.join(numbers, "batch_id")
        members.select("custom_id", "chunk").distinct().write.parquet(f"{self.path}/members/run={run}")
        p = members.withColumn("p", custom_id_parts(F.col("custom_id"))).select("custom_id", "chunk", "ord", F.col("p.article_id").alias("article_id"), F.col("p.company_id").alias("company_id"))
        last = last_write(p, ["custom_id", "article_id", "company_id"], F.struct("ord", "chunk"), ["chunk"])
        built = last.join(articles, ["article_id", "company_id"]).select(*PLAIN, "chunk")
        self._ask(run, built)
        for k, batch in enumerate(batches):
            self.advance(f"{run}-{k}", None, SUBMITTED, batch_id=batch, rater=name, version=version)
