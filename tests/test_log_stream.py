"""The log as a streaming sink, its chain in runs, and freshness by timers."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from probatum.operators import evidence
from probatum.streaming import log as sink

DAY = datetime.datetime(2026, 1, 1)


def plain_breaks(rows):
    """{index: (rota, tachada)} of one log's rows (n, previo, sello, debido)."""
    out, before, tainted = {}, None, False
    for i, (n, previo, sello, due) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[1][2] is not None, x[1][2] or "")):
        place = n is None or n != (1 if before is None or before[0] is None else before[0] + 1)
        want = "genesis" if before is None else before[1]
        broken = place or previo is None or previo != want or sello is None or sello != due
        tainted |= broken
        out[i], before = (broken, tainted), (n, sello)
    return out


@pytest.mark.parametrize("run", [1, 3, 7, 1000])
def test_chain_in_runs_equals_one_pass(spark, run):
    """Lines changed, cut out, stripped, doubled and moved, in logs of many lengths, one of them without a name."""
    rnd = random.Random(run)
    rows, want = [], {}
    for log in [*(f"l{k}" for k in range(40)), None]:
        chain, before = [], "genesis"
        for n in range(1, rnd.randint(1, 40)):
            chain.append([n, before, f"s{n}", f"s{n}"])
            before = f"s{n}"
        for _ in range(rnd.choice([0, 0, 1, 1, 3])):
            if chain:
                at = rnd.randrange(len(chain))
                what = rnd.randrange(6)
                if what == 0:
                    del chain[at]
                elif what == 1:
                    chain.append([chain[at][0], chain[at][1], "other", "other"])
                else:
                    chain[at][(what - 2) % 4] = rnd.choice([None, "x"]) if what > 2 else rnd.choice([None, 99, 0])
        for i, w in plain_breaks(chain).items():
            want[str(log), i] = w
        rows += [(log, i, *r) for i, r in enumerate(chain)]
    frame = spark.createDataFrame(rows, "log string, i long, n long, previo string, sello string, sello_debido string")
    got = {(str(r.log), r.i): (r.rota, r.tachada) for r in evidence.chain_breaks(frame, "log", run).collect()}
    assert got == want


def records(spark, *rows):
    return spark.createDataFrame([(c, s, t, DAY + datetime.timedelta(hours=h), i) for i, (c, s, t, h) in enumerate(rows, 1)], sink.RECORD)


def test_batches_are_appended_once(spark, tmp_path):
    log = sink.Log(spark, str(tmp_path / "log"), "w1")
    assert log.append(records(spark, ("a", "d1", "{}", 1), ("b", "d1", "{}", 1), ("a", "d1", "{}", 2)), 0) == 3
    first = sink.read(spark, log.path).orderBy("n").collect()
    assert [r.tipo for r in first] == ["observacion", "observacion", "revalidacion"] and first[2].registro_id == first[0].registro_id
    assert log.append(records(spark, ("a", "d1", "{}", 1)), 0) == 0  # the batch runs again
    assert log.append(records(spark, ("a", "d2", "{}", 3), ("b", "d1", "{}", 4), ("c", None, None, 4)), 1) == 3
    rows = sink.read(spark, log.path).orderBy("n").collect()
    assert rows[:3] == first and [(r.n, r.tipo) for r in rows[3:]] == [(4, "observacion"), (5, "revalidacion"), (6, "observacion")]
    assert all(b.previo == a.sello for a, b in zip(rows, rows[1:])) and rows[0].previo == "genesis" and sink.breaks(sink.read(spark, log.path)).count() == 0
    assert log.append(records(spark).limit(0), 2) == 0 and log.append(records(spark, ("d", "x", "{}", 9)), 3) == 1
    with pytest.raises(sink.OtherWriter):
        sink.Log(spark, log.path, "w2").append(records(spark, ("e", "x", "{}", 9)), 4)
    log.release()
    assert sink.Log(spark, log.path, "w2", "tail").append(records(spark, ("e", "x", "{}", 9)), 4) == 1


@pytest.mark.parametrize("verify", ["all", "tail"])
@pytest.mark.parametrize("harm", ["changed", "cut", "tail"])
def test_a_broken_log_is_refused(spark, tmp_path, harm, verify):
    log = sink.Log(spark, str(tmp_path / "log"), "w", verify)
    for batch in range(3):
        log.append(records(spark, *[(f"c{batch}{i}", "d", "{}", i) for i in range(3)]), batch)
    bad = {"changed": F.col("n") == 8, "cut": F.col("n") == 8, "tail": F.col("n") == 9}[harm]
    part = spark.read.parquet(f"{log.path}/lineas/lote=2").orderBy("n").collect()
    rows = spark.createDataFrame(part, sink.LINE)
    rows = rows.withColumn("contenido", F.when(bad, "{1}").otherwise(F.col("contenido"))) if harm == "changed" else rows.where(~bad)
    rows.write.mode("overwrite").parquet(f"{log.path}/lineas/lote=2")
    with pytest.raises(sink.BrokenLog):
        log.append(records(spark, ("z", "d", "{}", 1)), 3)
    assert sink.read(spark, log.path).where("lote = 3").count() == 0


@pytest.mark.parametrize("step", [1, 5, 1000])
def test_a_batch_is_numbered_and_sealed_in_parts(spark, tmp_path, monkeypatch, step):
    """No task takes a whole batch, and the chain is that of one ordered pass."""
    monkeypatch.setattr(sink, "LINES", 4)
    monkeypatch.setattr(sink, "STEP", step)
    rnd = random.Random(step)
    hours = [rnd.choice([None, *range(9)]) for _ in range(41)]
    raw = [(str(i % 3), rnd.choice([None, "d"]), "x" * (i % 5), None if h is None else DAY + datetime.timedelta(hours=h), i) for i, h in enumerate(hours)]
    rows = spark.createDataFrame(rnd.sample(raw, len(raw)), "control_id string, sujeto_digest string, contenido string, cuando timestamp, i int")
    want = {r[4]: k for k, r in enumerate(sorted(raw, key=lambda r: (r[3] is not None, r[3] or DAY, r[4])), 1)}
    given = sink.numbered(rows, "cuando", "i")
    assert {r.i: r.orden for r in given.collect()} == want
    log = sink.Log(spark, str(tmp_path / "log"), "w")
    assert log.append(given.drop("i"), 0) == 41 and log.append(records(spark, *[("z", "d", str(h), h) for h in range(10)]), 1) == 10
    assert max(r["count"] for r in spark.read.parquet(f"{log.path}/lineas").groupBy(F.input_file_name()).count().collect()) <= 4
    lines, before = sink.read(spark, log.path).withColumn("cuerpo", sink.content_digest()).orderBy("n").collect(), sink.GENESIS
    assert [r.n for r in lines] == list(range(1, 52))
    for r in lines:
        assert r.previo == before
        before = hashlib.sha256(f"{r.n}\x1f{before}\x1f{r.cuerpo}".encode()).hexdigest()
        assert r.sello == before
    assert sink.breaks(sink.read(spark, log.path)).count() == 0


def test_a_stream_into_the_log(spark, tmp_path):
    """Each file is a batch; a query that starts again from its checkpoint, and one that lost it, add nothing twice."""
    source, schema = tmp_path / "in", "control_id string, sujeto_digest string, contenido string, cuando timestamp"
    log = sink.Log(spark, str(tmp_path / "log"), "stream")

    def run(checkpoint):
        q = log.sink(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))).option("checkpointLocation", str(tmp_path / checkpoint)).start()
        q.processAllAvailable()
        q.stop()
        return [(r.n, r.tipo, r.control_id) for r in sink.read(spark, log.path).orderBy("n").collect()]

    records(spark, ("b", "d", "{}", 2), ("a", "d", "{}", 1)).drop("orden").coalesce(1).write.parquet(str(source))
    once = run("c")
    assert once == [(1, "observacion", "a"), (2, "observacion", "b")]
    assert run("c") == once and run("lost") == once
    records(spark, ("a", "d", "{}", 5)).drop("orden").coalesce(1).write.mode("append").parquet(str(source))
    assert run("c") == [*once, (3, "revalidacion", "a")]


def test_controls_go_stale_on_the_clock(spark, tmp_path):
    """Timers fire as other controls' looks move the time on, and leave every control as the batch form says."""
    schema = "control_id string, cuando timestamp, frescura_dias int"
    at = lambda d, h=0: DAY + datetime.timedelta(days=d, hours=h)
    batches = [[("a", at(0), 30), ("b", at(0), 90), ("c", at(0), None)], [("a", at(20), 30), ("d", at(21), 1)], [("x", at(40), 365)], [("x", at(49, 23), 365)], [("x", at(60), 365)], [("x", at(100), 365)]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        looks = spark.readStream.schema(schema).parquet(str(tmp_path / "in"), pathGlobFilter="*.parquet") if (tmp_path / "in").mkdir() is None else None
        q = sink.freshness(looks).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        seen = []
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
            q.processAllAvailable()
            seen.append({(r.control_id, r.estado, r.vence) for r in spark.sql("SELECT * FROM states").collect()})
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    stale = lambda k: {(c, v) for c, e, v in seen[k] if e == "rancia"}
    assert stale(1) == set() and stale(2) == {("d", at(22))}  # a's second look moved its term
    assert stale(3) == {("d", at(22))} and stale(4) == {("d", at(22)), ("a", at(50))} and stale(5) == {("d", at(22)), ("a", at(50)), ("b", at(90))}
    flat = spark.createDataFrame([r for b in batches for r in b], schema)
    final = {r.control_id: r.estado for r in sink.freshness_as_of(flat, at(99, 23)).collect()}
    last = {c: "rancia" if (c, v) in stale(5) else "valida" for c, e, v in sorted(seen[5], key=lambda x: (x[0], x[2] or DAY))}
    assert final == last == {"a": "rancia", "b": "rancia", "c": "valida", "d": "rancia", "x": "valida"}
