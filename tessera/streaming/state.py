"""Keyed state of streams on the RocksDB state store: aliases of sessions, and cached dictionary answers.

Both need `spark.sql.streaming.stateStore.providerClass` to be ROCKSDB, since their state is maps of which a batch reads
and writes single entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALIASES = "session_id string, original string, type string, n int"
RESULTS = "array<struct<dict:string,type:string,jurisdiction:string>>"


class SessionNumbers(StatefulProcessor):
    """Numbers texts that are new to their session, by type from 1: a map of texts and one of counters.

    Of a batch only its new texts are held, and only they and the counters of their types are written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "original string", "n int")
        self.counters = handle.getMapState("counters", "type string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, tuple] = {}
        for batch in rows:
            # By row and not by column: seq may be a struct, whose fields order it.
            for text, kind, seq in zip(batch["text"], batch["type"], map(sequence, batch["seq"])):
                if text not in fresh and not self.known.containsKey((text,)) or text in fresh and seq < fresh[text][0]:
                    fresh[text] = (seq, kind)
        counts: dict[str, int] = {}
        out = []
        for text, (_, kind) in sorted(fresh.items(), key=lambda x: (x[1][0], x[0])):
            if kind not in counts:
                there = self.counters.getValue((kind,))
                counts[kind] = there[0] if there else 0
            counts[kind] += 1
            self.known.updateValue((text,), (counts[kind],))
            out.append((key[0], text, kind, counts[kind]))
        for kind, n in counts.items():
            self.counters.updateValue((kind,), (n,))
        yield pd.DataFrame(out, columns=["session_id", "original", "type", "n"])

    def close(self) -> None:
        pass


def sequence(value) -> tuple:
    """What orders requests, as a tuple: the fields of a struct, which comes as a dict or a Row, or the value itself."""
    if isinstance(value, dict):
        return tuple(value.values())
    return tuple(value) if isinstance(value, tuple) else (value,)


def numbered(requests: DataFrame) -> DataFrame:
    """requests (session_id, text, type, seq) as a stream; out come ALIASES for texts that are new to their session.

    Texts are numbered in the order of their first use: by batch, and by seq inside a batch. Of a text's types in a batch
    the first counts. Requests without a text are left out.
    """
    asked = requests.where("text is not null").select(F.coalesce("session_id", F.lit("")).alias("session_id"), "text", F.coalesce("type", F.lit("unknown")).alias("type"), "seq")
    return asked.groupBy("session_id").transformWithStateInPandas(SessionNumbers(), ALIASES, "append", "None")


class Answers(StatefulProcessor):
    """The answer of a term as it was when the term was last looked up.

    By the event clock an answer counts up to and at its expiry, and a timer removes it when the watermark is past that; by
    the processing clock the state store itself forgets it, whose time to live is the cache's.
    """

    def __init__(self, ms: int, clock: str):
        self.ms, self.clock = ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", f"results {RESULTS}, expires long", self.ms if self.clock == "processing" else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = (self.answer.get() if self.answer.exists() else None), []
        for r in pd.concat(list(rows)).sort_values("ms", kind="stable").itertuples():
            hit = held is not None and (self.clock == "processing" or r.ms <= held[1])
            if not hit:
                if held is not None and self.clock == "event":
                    self.handle.deleteTimer(held[1] + 1)
                held = ([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in r.results], r.ms + self.ms)
                self.answer.update(held)
                if self.clock == "event":
                    self.handle.registerTimer(held[1] + 1)
            out.append((key[0], r.at, hit, [dict(zip(("dict", "type", "jurisdiction"), x)) for x in held[0]]))
        yield pd.DataFrame(out, columns=["term", "at", "hit", "results"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def answers_of(dictionary: DataFrame) -> DataFrame:
    """term, results: what a dictionary (term, dict, match, type, jurisdiction, ord) says of each of its terms, in its order."""
    of = F.array_sort(F.collect_list(F.struct("ord", "dict", "type", "jurisdiction")))
    rows = dictionary.where("match").groupBy("term").agg(of.alias("found"))
    return rows.select("term", F.transform("found", lambda x: F.struct(x["dict"].alias("dict"), x["type"].alias("type"), x["jurisdiction"].alias("jurisdiction"))).alias("results"))


def cached_lookups(probes: DataFrame, dictionary: DataFrame | None = None, hours: float = 24, clock: str = "event") -> DataFrame:
    """probes (term, at) as a stream with hit and results: a hit has the answer of the lookup that was cached.

    A lookup asks the dictionary and is cached for `hours`, by event time (at, with a watermark) or by processing time; hits
    don't renew it. Terms that the dictionary doesn't have are answered, and cached, with an empty array. Probes without a
    term or a time are left out.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock is event or processing")
    none = F.array().cast(RESULTS)
    if dictionary is None:
        rows = probes.withColumn("results", none)
    else:
        rows = probes.join(answers_of(dictionary), "term", "left").withColumn("results", F.coalesce("results", none))
    rows = rows.where("term is not null and at is not null").select("term", "at", "results", F.unix_millis("at").alias("ms"))
    out = f"term string, at timestamp, hit boolean, results {RESULTS}"
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    return rows.groupBy("term").transformWithStateInPandas(Answers(int(hours * 3_600_000), clock), out, "append", mode)
