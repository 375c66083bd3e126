"""The archive's files: folders that never change, and a manifest that names those that count.

Every change writes new folders, then a new manifest, and makes it the newest with one rename. A
failure before that leaves the archive as it was, one after it as it is to be; folders that no
manifest names are removed afterwards, or by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.keys import window_day
from tidewake.operators.archive import ARCHIVE_KEY, with_day


class ArchiveFiles:
    """An archive of emissions by day in a folder that all machines share.

    ``step`` is called with a name between the steps of every change; tests let it fail.
    """

    def __init__(self, spark: SparkSession, path: str, step: Callable[[str], None] = lambda name: None):
        self.spark, self.path, self.step = spark, path.rstrip("/"), step
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [str(x.getPath().getName()) for x in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def _newest(self) -> tuple[int, dict[str, list[str]]]:
        """(number, folders of each day) of the manifest that counts; a day's folders are few, as rewriting one joins them."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and n[0] != "."]
        if not numbers:
            return 0, {}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{max(numbers):09d}.json").collect())
        return max(numbers), json.loads(text)

    def days(self) -> list[str]:
        return sorted(self._newest()[1])

    def _read(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{f}" for f in folders))
        return rows.withColumn("window_day", F.col("window_day").cast("string")).drop("change")

    def read(self, days: list[str] | None = None) -> DataFrame | None:
        """The archive's rows, of some days or all; other days' folders are not opened. None if there are none."""
        held = self._newest()[1]
        return self._read([f for day in sorted(held) if days is None or day in days for f in held[day]])

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New folders for the days of ``rows``; a day of many rows is several files."""
        change = f"change={uuid.uuid4().hex}"
        rows.hint("rebalance", "window_day").write.partitionBy("window_day").parquet(f"{self.path}/data/{change}")
        self.step("data written")
        return {n.removeprefix("window_day="): [f"{change}/{n}"] for n in self._names(f"data/{change}") if n.startswith("window_day=")}

    def _switch(self, number: int, folders: dict[str, list[str]]) -> None:
        """Make ``folders`` the archive. Of two changes of the same manifest the later fails."""
        aside = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({d: f for d, f in folders.items() if f}, indent=0).encode()))
        out.close()
        self.step("manifest written")
        to = self._at(f"manifest/{number + 1:09d}.json")
        if self._fs.exists(to) or not self._fs.rename(aside, to):
            raise RuntimeError("the archive has changed meanwhile")
        self.step("switched")

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the newest ``keep`` manifests names, and older manifests; returns the folders removed.

        Readers and changes that have begun before lose what they have not read yet.
        """
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and n[0] != ".")
        if not numbers:
            return 0
        named = set()
        for n in numbers[-keep:]:
            named |= {f for fs in json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{n:09d}.json").collect())).values() for f in fs}
        gone = [f"data/{c}/{d}" for c in self._names("data") for d in self._names(f"data/{c}") if d.startswith("window_day=") and f"{c}/{d}" not in named]
        for name in gone:
            self._fs.delete(self._at(name), True)
            self.step("folder removed")
        for c in self._names("data"):
            if not any(d.startswith("window_day=") for d in self._names(f"data/{c}")):
                self._fs.delete(self._at(f"data/{c}"), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"manifest/{n:09d}.json"), False)
        for n in self._names("manifest"):
            if n.startswith("."):
                self._fs.delete(self._at(f"manifest/{n}"), False)
        return len(gone)

    def append(self, emissions: DataFrame, day: str | None = None) -> tuple[int, int]:
        """Add what is new and return (inserted, duplicate). With ``day`` rows are filed there, wherever they belong (see ``refile``)."""
        number, held = self._newest()
        placed = with_day(emissions) if day is None else emissions.withColumn("window_day", F.lit(day))
        placed = placed.persist()
        try:
            total = placed.count()
            touched = [r[0] for r in placed.select("window_day").distinct().collect()]
            once = placed.dropDuplicates(["window_day", *ARCHIVE_KEY])
            before = self._read([f for d in touched for f in held.get(d, [])])
            if before is not None:
                once = once.join(before.select("window_day", *ARCHIVE_KEY), ["window_day", *ARCHIVE_KEY], "left_anti").select(once.columns)
            fresh = self._write(once)
        finally:
            placed.unpersist()
        new = [f for fs in fresh.values() for f in fs]
        inserted = self._read(new).count() if new else 0
        if inserted:
            self._switch(number, {d: held.get(d, []) + fresh.get(d, []) for d in held.keys() | fresh.keys()})
        return inserted, total - inserted

    def _replace(self, number: int, held: dict[str, list[str]], days: set[str], rows: DataFrame) -> None:
        """Put ``rows`` in the place of all folders of ``days``."""
        fresh = self._write(rows)
        self._switch(number, {d: f for d, f in held.items() if d not in days} | fresh)
        self.vacuum()

    def refile(self) -> int:
        """File rows that stand under another day where they belong, once each; returns how many stood elsewhere."""
        number, held = self._newest()
        whole = self.read()
        if whole is None:
            return 0
        right = window_day(F.col("window_start_unix_nanos"))
        moved = whole.where(F.col("window_day") != right).groupBy("window_day", right.alias("to")).count().collect()
        if not moved:
            return 0
        days = {r["window_day"] for r in moved} | {r["to"] for r in moved}
        rows = self._read([f for d in sorted(days) for f in held.get(d, [])])
        self._replace(number, held, days, with_day(rows.drop("window_day")).dropDuplicates(["window_day", *ARCHIVE_KEY]))
        return sum(r["count"] for r in moved)

    def drop_days_before(self, cutoff_day: str) -> int:
        """Drop whole days strictly before the cutoff's, without reading them; returns how many."""
        number, held = self._newest()
        old = [d for d in held if d < cutoff_day]
        if old:
            self._switch(number, {d: f for d, f in held.items() if d not in old})
            self.vacuum()
        return len(old)

    def erase_device(self, user_id: str, device_id: str) -> int:
        """Rewrite the days that hold a device without it and return the rows erased; none means not found."""
        number, held = self._newest()
        whole = self.read()
        if whole is None:
            return 0
        own = F.coalesce((F.col("user_id") == user_id) & (F.col("device_id") == device_id), F.lit(False))
        gone = whole.where(own).groupBy("window_day").count().collect()
        if gone:
            days = {r["window_day"] for r in gone}
            rows = self._read([f for d in sorted(days) for f in held[d]])
            self._replace(number, held, days, rows.where(~own))
        return sum(r["count"] for r in gone)
