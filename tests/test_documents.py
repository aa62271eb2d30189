"""Images, agent structure, SARIF, tickets and the token bucket on small cases."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from probatum.operators import exports, tickets
from probatum.operators.rules import WHOLE_REPOSITORY
from probatum.sources import agents, images
from probatum.streaming import limits


def chunk(kind, body):
    return struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))


PNG = images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def test_image_facts_of_each_container():
    assert images.image_facts(PNG)["width"] == 7 and images.image_facts(PNG)["xmp_packets"] == 0
    assert images.image_facts(images.png_with_mark(PNG))["digital_source_type"] == images.VOCABULARY + "trainedAlgorithmicMedia"
    packed = PNG[:33] + chunk(b"zTXt", images.XMP_KEYWORD + b"\x00\x00" + zlib.compress(b"<x:DigitalSourceType>digitalArt</x:DigitalSourceType>")) + PNG[33:]
    assert images.image_facts(packed)["digital_source_type"] == "digitalArt"
    segment = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    jpeg = b"\xff\xd8" + segment(0xE1, images.XMP_SEGMENT + b"DigitalSourceType='potato'") + segment(0xEB, b"jumb") + segment(0xC0, b"\x08\x00\x05\x00\x07\x03")
    got = images.image_facts(jpeg)
    assert (got["width"], got["height"], got["c2pa"], got["digital_source_type"]) == (7, 5, "present_unverified", "potato")
    for broken in (None, b"", b"GIF89a", images.PNG, images.PNG + b"\xff\xff\xff\xffIHDR", b"\xff\xd8\xff", PNG[:20]):
        assert images.image_facts(broken)["width"] is None


def test_image_scan(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.png_with_mark(PNG))
    (tmp_path / "b.PNG").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[-1]: r for r in images.scan(spark, str(tmp_path)).collect()}
    assert got["a.png"].marca == "sintetico" and got["a.png"].height == 5 and got["b.PNG"].container is None and got["b.PNG"].marca == "sin_marca"


CODE = """
from sdk import tool
@tool(readOnlyHint=True)
def look(): ...
@tool
def erase(): ...
bot = kit.Agent(tools=[look, erase, {"name": "send", "effect": "mail"}, make()], max_steps=3)
"""


def test_agent_structure(spark):
    config = json.dumps({"mcpServers": {"db": {"tools": [{"name": "q", "annotations": {"readOnlyHint": True}}, 3]}, "bare": None}})
    rows = [("a.py", CODE), (".cursor/mcp.json", config), ("broken.py", "def ("), ("requirements.txt", "CrewAI==1"), ("none.py", None), ("mcp.json", "[1]")]
    got = agents.structure(spark.createDataFrame(rows, "path string, text string"))
    kinds = {(r.kind, r.name) for r in got.collect()}
    assert {("delegation", "kit.Agent"), ("limit", "pasos"), ("server", "db"), ("server", "bare"), ("framework", "crewai")} <= kinds
    t = {r.name: r for r in agents.tools(got).collect()}
    assert {n: r.effect for n, r in t.items()} == {"look": "declarado", "erase": "sin_declarar", "send": "declarado", "make": "sin_declarar", "db.q": "declarado"}
    assert t["look"].places == "a.py:4, a.py:7" and t["look"].origin == "decorador"
    assert not agents.signals_without_reading(got).first()[0]
    assert agents.signals_without_reading(got.where("kind = 'framework'")).first()[0]
    assert not agents.signals_without_reading(got.limit(0)).first()[0]


def test_sarif_document_is_json(spark):
    found = spark.createDataFrame([("R2", "media", 'a"b.py (linea 3)', "x\n"), ("R1", "alta", WHOLE_REPOSITORY, "y")], "regla_id string, severidad string, localizacion string, mensaje string")
    lost = spark.createDataFrame([("z.md", "no es UTF-8")], "fichero string, por_que string")
    run = json.loads(exports.sarif_document(found, lost, "probatum", "1").first().sarif)["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R1", "R2"] and not run["invocations"][0]["executionSuccessful"]
    by = {r["ruleId"]: r for r in run["results"]}
    assert by["R2"]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == 'a"b.py' and "locations" not in by["R1"]
    empty = json.loads(exports.sarif_document(found.limit(0), lost.limit(0), "probatum", "1").first().sarif)["runs"][0]
    assert empty["results"] == [] and empty["invocations"][0]["executionSuccessful"]


def test_tickets_never_verify_nor_go_back(spark):
    assert "verificada" not in {v for m in tickets.MEANING.values() for v in m.values()}
    rows = [("jira", " DONE ", "abierta", "a", "d", "r"), ("jira", "done", "verificada", "a", "d", "r"), ("jira", "?", "abierta", "a", "d", "r"), ("linear", "canceled", "abierta", "a", "d", "r"), (None, "done", "abierta", "a", "d", "r"), ("github", "closed", "abierta", None, "d", "r")]
    got = tickets.translate(spark.createDataFrame(rows, "system string, external string, current string, actor string, when string, role string"))
    assert [r.verdict for r in got.collect()] == ["mueve", "no_retrocede", "estado_desconocido", "no_retrocede", "estado_desconocido", "sin_persona"]


def test_bucket_refills_and_ignores_a_clock_that_goes_back(spark, tmp_path):
    assert limits.take(0.5, 0, 0, 120, 40) == (False, 0.5, 0)
    assert limits.take(0.0, 0, 500_000, 120, 40) == (True, 0.0, 500_000)
    assert limits.take(3.0, 10, 5, 120, 40) == (True, 2.0, 10)
    rows = spark.range(50).select(F.lit("k").alias("key"), F.col("id").alias("n"), F.timestamp_seconds(F.col("id") * 0).alias("ts"))
    assert limits.throttle_batch(rows).where("allowed").count() == 40
    rows.write.parquet(str(tmp_path / "in"))
    stream = limits.throttle(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bucket").where("allowed").count() == 40 and spark.table("bucket").count() == 50
