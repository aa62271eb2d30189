"""The evidence log as a streaming sink, and freshness as timers: records go in, sealed lines come out, and what nobody renews goes stale by itself.

A log is a folder of Parquet with a part for each batch (lote): its lines, chained by seals. A line's seal is the hash of its number, the seal
before and the digest of its content, so it can be checked from its own row.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from probatum.functions.lineage import shared_folder
from probatum.operators import evidence

GENESIS = "genesis"
RECORD = "control_id string, sujeto_digest string, contenido string, cuando timestamp, orden long"
FIELDS = ("tipo", "registro_id", "control_id", "sujeto_digest", "contenido", "cuando")
LINE = "n long, tipo string, registro_id string, control_id string, sujeto_digest string, contenido string, cuando timestamp, previo string, sello string"


class BrokenLog(ValueError):
    """The log doesn't verify: what is appended would cover the break."""


class OtherWriter(RuntimeError):
    """Another writer holds the log."""


def content_digest() -> Column:
    """Digest of a line's content, nulls told from empty texts."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in FIELDS]), {"ignoreNullFields": "false"}), 256)


def due_seal() -> Column:
    return F.sha2(F.concat_ws("\x1f", F.col("n").cast("string"), F.coalesce("previo", F.lit("")), content_digest()), 256)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log's lines with their batch; without any batch an empty table."""
    if not _exists(spark, f"{path}/lineas"):
        return spark.createDataFrame([], f"{LINE}, lote long")
    return spark.read.schema(f"{LINE}, lote long").parquet(f"{path}/lineas")


def breaks(log: DataFrame) -> DataFrame:
    """Lines of a log that break its chain."""
    return evidence.chain_breaks(log.withColumn("sello_debido", due_seal()).withColumn("_log", F.lit(0)), "_log").where("rota")


def head(log: DataFrame) -> tuple[int, str]:
    """(number of the last line, its seal): what is to be noted elsewhere."""
    last = log.agg(F.max(F.struct("n", "sello")).alias("x")).first().x
    return (last.n, last.sello) if last else (0, GENESIS)


#: Lines, and bytes of their texts, that one task sorts, and lines whose seals one job makes in order.
LINES, BYTES, STEP = 1 << 18, 64 << 20, 1 << 20


def _dealt(rows: DataFrame) -> tuple[int, int]:
    """(rows, parts that they are dealt to, so that no task's memory grows with the table)."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind == "string"]
    many, size = rows.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0))).first()
    return many, max(1, -(-many // LINES), -(-size // BYTES))


def _laid(rows: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder, and the path there."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds orden, a row's number from 1. Ranges of the order are sorted side by side; what is ordered as a whole is a count for each range.

    Rows of equal order have one range; where they differ elsewhere, their numbers are left open.
    """
    ranges = rows.repartitionByRange(_dealt(rows)[1], *order).sortWithinPartitions(*order).withColumn("_en", F.monotonically_increasing_id())
    placed = _laid(ranges, "orden")[0].withColumn("_rango", F.shiftright("_en", 33))
    before = F.coalesce(F.sum("_filas").over(Window.orderBy("_rango").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_rango").agg(F.count("*").alias("_filas")).select("_rango", before.alias("_antes"))
    at = F.col("_antes") + F.col("_en").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(counts), "_rango").select(*rows.columns, at.cast("long").alias("orden"))


def _seal(n: int, before: str, digest: str) -> str:
    return hashlib.sha256(f"{n}\x1f{before}\x1f{digest}".encode()).hexdigest()


def _starts(seal: str):
    """(tramo, previo) of each block's first line in ordered lines, and the last seal without a block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, last, found = seal, None, []
        for f in frames:
            for block, n, digest in zip(f["_tramo"], f["n"], f["cuerpo"], strict=True):
                if block != last:
                    found.append((block, before))
                    last = block
                before = _seal(n, before, digest)
        yield pd.DataFrame([*found, (None, before)], columns=["_tramo", "previo"]).astype({"_tramo": "Int64"})

    return run


def _chained(starts: dict[int, str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, last = None, None
        for f in frames:
            previous, seals = [], []
            for block, n, digest in zip(f["_tramo"], f["n"], f["cuerpo"], strict=True):
                if block != last:
                    before, last = starts[block], block
                previous.append(before)
                before = _seal(n, before, digest)
                seals.append(before)
            yield f.assign(previo=previous, sello=seals)[["n", *FIELDS, "previo", "sello"]]

    return run


def sealed(rows: DataFrame, n: int, seal: str, many: int, parts: int) -> tuple[DataFrame, str]:
    """So many lines (n, tipo, ...) chained from a head on, and the folder that they are read from.

    Each seal needs the one before: that pass takes numbers and digests alone, STEP lines a job, and keeps the seal that each of so many blocks begins
    with. From these the blocks are sealed side by side.
    """
    size = max(1, -(-many // parts))
    block = F.coalesce(F.floor((F.col("n") - n - 1) / size), F.lit(0)).cast("long")
    deal = lambda df: df.repartitionById(parts, F.pmod("_tramo", F.lit(parts)).cast("int")).sortWithinPartitions("_tramo", "n", "cuerpo")
    laid, path = _laid(deal(rows.select("n", *FIELDS, content_digest().alias("cuerpo"), block.alias("_tramo"))), "tramos", "_tramo")
    jobs, held = [], STEP
    for r in laid.groupBy("_tramo").count().orderBy("_tramo").collect():  # a row for each block
        if held + r["count"] > STEP:
            jobs.append([])
            held = 0
        jobs[-1].append(r._tramo)
        held += r["count"]
    starts = {}
    for blocks in jobs:
        lines = laid.where(F.col("_tramo").between(blocks[0], blocks[-1])).select("_tramo", "n", "cuerpo")
        for r in lines.repartition(1).sortWithinPartitions("_tramo", "n", "cuerpo").mapInPandas(_starts(seal), "_tramo long, previo string").collect():
            starts[r._tramo] = r.previo
        seal = starts.pop(None)
    return deal(laid).mapInPandas(_chained(starts), LINE), path


class Log:
    """A log with one writer at a time. verify: "all" checks every line before an append, "tail" those of the last batch only; either way the head noted at the last append must be there."""

    def __init__(self, spark: SparkSession, path: str, writer: str, verify: str = "all"):
        if verify not in ("all", "tail"):
            raise ValueError(verify)
        self.spark, self.path, self.writer, self.verify = spark, path.rstrip("/"), writer, verify

    def hold(self) -> None:
        """Take the log, or fail if another writer has it. The same writer takes it again after it was cut off."""
        fs, at = _fs(self.spark, f"{self.path}/escritor")
        fs.mkdirs(at)
        mine = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, hashlib.sha256(self.writer.encode()).hexdigest()[:32])
        if not fs.createNewFile(mine) and not fs.exists(mine):
            raise OtherWriter(self.path)
        others = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName() != mine.getName()]
        if others:
            fs.delete(mine, False)
            raise OtherWriter(f"{self.path} is held by {others}")

    def release(self) -> None:
        fs, at = _fs(self.spark, f"{self.path}/escritor")
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, hashlib.sha256(self.writer.encode()).hexdigest()[:32]), False)

    def _checked(self) -> tuple[DataFrame, int, str]:
        log = read(self.spark, self.path)
        if self.verify == "all":
            bad = breaks(log)
        else:
            last = log.agg(F.max("lote")).first()[0]
            tail = log.where(F.col("lote") == last)
            start = tail.agg(F.min("n")).first()[0]
            before = log.where(F.col("n") == (start or 1) - 1).select("sello").first()
            # The tail is a chain of its own: its numbers are moved to begin at 1, the seals they enter are checked as they stand.
            moved = tail.withColumn("sello_debido", due_seal()).withColumn("n", F.col("n") - (start or 1) + 1).withColumn("_log", F.lit(0))
            bad = evidence.chain_breaks(moved, "_log", genesis=before.sello if before else GENESIS).where("rota")
        first, many = bad.agg(F.min("n"), F.count("*")).first()
        if many:
            raise BrokenLog(f"{self.path}: {many} lines break the chain, the first is number {first}")
        n, seal = head(log)
        noted = self._noted()
        if noted and (noted.n > n or not log.where((F.col("n") == noted.n) & (F.col("sello") == noted.sello)).take(1)):
            raise BrokenLog(f"{self.path}: the head noted as number {noted.n} isn't in the log; a cut tail leaves a valid chain")
        return log, n, seal

    def _noted(self):
        """The last head that was noted beside the log."""
        if not _exists(self.spark, f"{self.path}/cabezas"):
            return None
        return self.spark.read.schema("n long, sello string, lote long").parquet(f"{self.path}/cabezas").agg(F.max(F.struct("n", "sello")).alias("x")).first().x

    def append(self, records: DataFrame, batch: int) -> int:
        """Lines added for a batch of records (RECORD): observations of what is new, revalidations of what is known. A batch that is there already changes nothing."""
        target = f"{self.path}/lineas/lote={batch}"
        if _exists(self.spark, f"{target}/_SUCCESS"):
            return 0
        self.hold()
        if _exists(self.spark, target):  # cut off while it was written: not part of the log
            fs, at = _fs(self.spark, target)
            fs.delete(at, True)
        log, n, seal = self._checked()
        lines, laid = sealed(evidence.append(log, records, n).select("n", *FIELDS), n, seal, *_dealt(records))
        lines.write.parquet(target)
        fs, at = _fs(self.spark, laid)
        fs.delete(at, True)
        written = self.spark.read.schema(LINE).parquet(target)
        count = written.count()
        if count:
            written.agg(F.max(F.struct("n", "sello")).alias("x")).select("x.*").write.mode("overwrite").parquet(f"{self.path}/cabezas/lote={batch}")
        return count

    def sink(self, records: DataFrame) -> DataStreamWriter:
        """A stream of records (control_id, sujeto_digest, contenido, cuando) into the log; a batch that runs again is written once."""

        def each(batch: DataFrame, i: int) -> None:
            # A batch's order: by time, then content, so that a rerun numbers its records alike.
            rows = batch.select("control_id", "sujeto_digest", "contenido", "cuando")
            self.append(numbered(rows, "cuando", "control_id", "sujeto_digest", "contenido"), i)

        return records.writeStream.foreachBatch(each)


STALE = "control_id string, estado string, cuando timestamp, vence timestamp"


class _Freshness(StatefulProcessor):
    """Of each control the last look and when it expires; a timer says so when the stream's time passes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("visto", "cuando_ms long, vence_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:
            got = pdf[["cuando", "frescura_dias"]].dropna(subset=["cuando"]).sort_values(["cuando", "frescura_dias"]).tail(1)
            for r in got.itertuples():
                if newest is None or r.cuando >= newest[0]:
                    newest = (r.cuando, r.frescura_dias)
        held = self.state.get() if self.state.exists() else None
        if newest is None or (held is not None and held[0] > newest[0].value // 1_000_000):
            return iter(())  # late: a later look is known
        seen = newest[0].value // 1_000_000
        due = -1 if pd.isna(newest[1]) else seen + int(newest[1]) * 86_400_000
        if held is not None and held[1] >= 0:
            self.handle.deleteTimer(held[1])
        self.state.update((seen, due))
        if due >= 0:
            self.handle.registerTimer(due)
        return iter([self._row(key[0], "valida", seen, due)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, due = self.state.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        return iter([self._row(key[0], "rancia", seen, due)])

    @staticmethod
    def _row(control: str, state: str, seen: int, due: int) -> pd.DataFrame:
        at = lambda ms: pd.Timestamp(ms, unit="ms") if ms >= 0 else pd.NaT
        return pd.DataFrame({"control_id": [control], "estado": [state], "cuando": [at(seen)], "vence": [at(due)]})

    def close(self) -> None:
        pass


def freshness(looks: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of looks (control_id string, cuando timestamp, frescura_dias) to changes of state (STALE): valida at a look, rancia once it expires.

    Time is the watermark's: it moves with any control's looks, so a control goes stale without a look of its own. No freshness, no
    timer. Looks that come after a later one of their control change nothing. Needs the RocksDB state store.
    """
    marked = looks.withWatermark("cuando", late)
    return marked.groupBy("control_id").transformWithStateInPandas(_Freshness(), STALE, "append", "eventTime")


def freshness_as_of(looks: DataFrame, as_of: datetime.datetime | Column) -> DataFrame:
    """(control_id, estado, cuando, vence) of every control as the stream leaves it once its time has passed as_of: the same without a stream."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    last = looks.where("cuando is not null").groupBy("control_id").agg(F.max(F.struct("cuando", "frescura_dias")).alias("x"))
    due = F.when(F.col("x.frescura_dias").isNotNull(), F.col("x.cuando") + F.make_dt_interval(F.col("x.frescura_dias")))
    return last.select("control_id", F.when(due.isNotNull() & (now >= due), "rancia").otherwise("valida").alias("estado"), F.col("x.cuando").alias("cuando"), due.alias("vence"))
