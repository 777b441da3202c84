"""A register cache as keyed state: what is known of each company, decisions per link, and their time to live.

The log holds observations of a company (``fetched``, or ``absent``: the register has no such company) and decisions
about links to it (``verdict``). State is kept per company: one value for its observations, one map from
link to decision. Both are joins of a semilattice (latest by time, the two latest absences), so the order of rows, the
cut into batches and repeated batches don't change the outcome:

* an absence counts as final (``outside``) once a second one confirms it within the retention, with no fetch between;
  until then it is ``pending``;
* an observation ends RETENTION after its last sight, a decision VERDICT_RETENTION after it was made, by event time: one timer
  wakes the key when the watermark has passed the first end, drops all that has ended, and asks for the next. Only what is still that old then goes.

Every change comes out as a row (``put`` or ``drop``) with its event time; ``latest`` folds the rows to the table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RETENTION, VERDICT_RETENTION = dt.timedelta(days=35), dt.timedelta(days=45)
LOG = "company string, link string, event string, kind string, publishable boolean, rules string, inputs string, at timestamp"
CHANGES = "company string, link string, op string, at timestamp, kind string, publishable boolean, rules string, inputs string"
#: One provider keeps state on the executors' disks, and only changes go to the checkpoint.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class RegisterCache(StatefulProcessor):
    """One company. Times are milliseconds; 0 means never."""

    def __init__(self, retention: dt.timedelta = RETENTION, verdict_retention: dt.timedelta = VERDICT_RETENTION) -> None:
        self.keep, self.keep_verdict = (int(d.total_seconds() * 1000) for d in (retention, verdict_retention))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "fetched long, absent long, absent_before long")
        self.verdicts = handle.getMapState("verdicts", "link string", "kind string, publishable boolean, rules string, inputs string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        (company,) = key
        before = self.seen.get() or (0, 0, 0)
        fetched, absences, decided = before[0], {before[1], before[2]}, {}
        for pdf in rows:
            at_ms = pdf["at"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            said = zip(at_ms, *(pdf[c].tolist() for c in ("event", "link", "kind", "publishable", "rules", "inputs")), strict=True)
            for at, event, link, kind, publishable, rules, inputs in said:
                if event == "fetched":
                    fetched = max(fetched, at)
                elif event == "absent":
                    absences.add(at)
                elif event == "verdict" and (link not in decided or self._order(decided[link]) < (at, str(kind), str(inputs))):
                    decided[link] = (kind, bool(publishable), rules, inputs, at)
            absences = set(sorted(absences)[-2:])
        late, *rest = sorted(absences, reverse=True)
        after = (fetched, late, rest[0] if rest else 0)
        out, ends = [], []
        if after != tuple(before):
            self.seen.update(after)
            ends.append(max(fetched, late) + self.keep)
            out.append(self._sight(company, after))
        had = bool(decided) and self.verdicts.exists()
        for link, new in decided.items():
            old = self.verdicts.getValue((link,)) if had else None
            if old is None or self._order(tuple(old)) < self._order(new):
                self.verdicts.updateValue((link,), new)
                ends.append(new[4] + self.keep_verdict)
                out.append((company, link, "put", _time(new[4]), *new[:4]))
        if out:
            self.handle.registerTimer(min(ends))  # the first end: it wakes the next
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        (company,), now, out, later = key, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), [], []
        if (seen := self.seen.get()) is not None:
            end = max(seen[0], seen[1]) + self.keep
            if end <= now:
                self.seen.clear()
                out.append((company, "", "drop", _time(end), None, None, None, None))
            else:
                later.append(end)
        for link, end in [(k[0], v[4] + self.keep_verdict) for k, v in self.verdicts.iterator()] if self.verdicts.exists() else []:
            if end <= now:
                self.verdicts.removeKey((link,))
                out.append((company, link, "drop", _time(end), None, None, None, None))
            else:
                later.append(end)
        if later:
            self.handle.registerTimer(min(later))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _order(v: tuple) -> tuple:
        """At one instant the greater kind, then the greater hash, stays: any order of rows ends alike."""
        return v[4], str(v[0]), str(v[3])

    def _sight(self, company: str, seen: tuple[int, int, int]) -> tuple:
        fetched, absent, before = seen
        if fetched >= absent:
            status = "fetched"
        else:
            status = "outside" if before > max(fetched, absent - self.keep) else "pending"
        return company, "", "put", _time(max(fetched, absent)), status, None, None, None

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["company", "link", "op", "at", "kind", "publishable", "rules", "inputs"])
        return out.astype({"publishable": "boolean"})


def changes(log: DataFrame, lateness: str = "0 seconds", retention: dt.timedelta = RETENTION, verdict_retention: dt.timedelta = VERDICT_RETENTION) -> DataFrame:
    """The stream of puts and drops of a streaming log (LOG). Rows without company or time carry no state and go."""
    rows = log.where("company IS NOT NULL AND at IS NOT NULL AND (event <> 'verdict' OR link <> '')").withWatermark("at", lateness)
    return rows.groupBy("company").transformWithStateInPandas(RegisterCache(retention, verdict_retention), CHANGES, "Append", "EventTime")


def latest(changed: DataFrame) -> DataFrame:
    """The table that the changes leave: per company and link the last change, if that is a put."""
    last = changed.groupBy("company", "link").agg(F.max(F.struct("at", F.col("op") == "drop", "kind", "inputs", "publishable", "rules", "op")).alias("c"))
    return last.where("c.op = 'put'").select("company", "link", "c.at", "c.kind", "c.publishable", "c.rules", "c.inputs")


def stale(links: DataFrame, table: DataFrame, rules: str, now: dt.datetime, max_age: dt.timedelta | None = None) -> DataFrame:
    """links(link, company, inputs) without a decision that still holds: none, other rules, other inputs, or too old."""
    had = table.where("link <> ''").select("link", F.col("rules").alias("_rules"), F.col("inputs").alias("_inputs"), F.col("at").alias("_at"))
    holds = (F.col("_rules") == rules) & F.col("_inputs").eqNullSafe(F.col("inputs"))
    if max_age is not None:
        holds &= F.col("_at") >= F.lit(now - max_age)
    return links.join(had, "link", "left").where(~F.coalesce(holds, F.lit(False))).select(*links.columns, F.col("_at").alias("decided_at"))


def coverage(links: DataFrame, stale_links: DataFrame) -> DataFrame:
    """wanted, current, missing and their ratio (1 where nothing is wanted)."""
    wanted = links.agg(F.count("*").alias("wanted"))
    missing = stale_links.agg(F.count("*").alias("missing"))
    both = wanted.join(F.broadcast(missing))  # one row each
    return both.select("wanted", (F.col("wanted") - F.col("missing")).alias("current"), "missing", F.when(F.col("wanted") == 0, 1.0).otherwise((F.col("wanted") - F.col("missing")) / F.col("wanted")).alias("ratio"))


def next_companies(stale_links: DataFrame, n: int) -> DataFrame:
    """The n companies to ask next: those with an undecided link first, then by the oldest decision; ties by company."""
    oldest = F.min(F.struct(F.col("decided_at").isNotNull(), "decided_at")).alias("o")
    waiting = stale_links.groupBy("company").agg(F.count("*").alias("links"), oldest)
    top = waiting.orderBy("o", "company").limit(n)
    return top.select(F.row_number().over(Window.orderBy("o", "company")).alias("rank"), "company", "links", F.col("o.decided_at").alias("waiting_since"))


def run_log(log: DataFrame, folder: str, **options) -> DataFrame:  # noqa: ANN003
    """Runs what is there now of a streaming log and returns all its changes; again with the same folder, it goes on from there."""
    spark = log.sparkSession
    (name, provider), = STATE_STORE.items()
    had = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        writer = changes(log, **options).writeStream.format("parquet").outputMode("append")
        writer.option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes")
