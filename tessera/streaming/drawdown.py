"""Running drawdowns of a stream of returns, with state for each ticker.

Rows wait in the ticker's state until the watermark has passed their time; a timer then takes them in order of time,
so late rows within the watermark stand where they belong. What is older than the watermark is dropped by Spark. State
is in RocksDB: set spark.sql.streaming.stateStore.providerClass to its provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "ticker string, ts timestamp, ret double, cum double, peak double, drawdown double"


class RunningDrawdown(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "cum double, peak double")
        self.waiting = handle.getMapState("waiting", "ms long", "rets array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for row in rows:
            ms = int(row["ms"])
            held = [*self.waiting.getValue((ms,))[0]] if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), ([*held, row["ret"]],))
            if not held:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        import datetime

        due = expiredTimerInfo.getExpiryTimeInMs()
        cum, peak = self.run.get() if self.run.exists() else (None, None)
        # timers may come in any order of time, so each takes all that waits up to its own
        for ms in sorted(k[0] for k in self.waiting.keys() if k[0] <= due):
            for ret in self.waiting.getValue((ms,))[0]:
                if ret is not None:
                    cum = (1.0 if cum is None else cum) * (1.0 + ret)
                    peak = cum if peak is None else max(peak, cum)
                drawdown = None if cum is None or not peak else (cum - peak) / peak
                yield Row(ticker=key[0], ts=datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc).replace(tzinfo=None), ret=ret, cum=cum, peak=peak, drawdown=drawdown)
            self.waiting.removeKey((ms,))
        if cum is not None:
            self.run.update((cum, peak))

    def close(self) -> None:
        pass


def running_drawdowns(returns: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(ticker, ts, ret, cum, peak, drawdown) of a streaming DataFrame (ticker, ts, ret), in append mode. Null tickers are dropped; rows of one ticker and time come in the order they arrived."""
    rows = returns.where("ticker IS NOT NULL AND ts IS NOT NULL").selectExpr("ticker", "ts", "ret", "unix_millis(ts) AS ms").withWatermark("ts", lateness)
    return rows.groupBy("ticker").transformWithState(statefulProcessor=RunningDrawdown(), outputStructType=SCHEMA, outputMode="append", timeMode="EventTime")
