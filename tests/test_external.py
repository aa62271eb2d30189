"""Signatures against published vectors, tickets by profile, calls in SQL, counts at several levels, digests of trees."""

import hashlib
import hmac
import json
import random

from pyspark.sql import functions as F

from probatum.functions import signatures
from probatum.operators import rules, tickets
from probatum.sources import files

#: Keys, data and results of RFC 4231, cases 1 to 4, 6 and 7 (fixed values).
VECTORS = (
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (bytes(range(1, 26)), b"\xcd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
)


def test_hmac_vectors(spark):
    rnd = random.Random(2)
    cases = [*VECTORS, *((k, d, hmac.new(k, d, "sha256").hexdigest()) for k, d in ((rnd.randbytes(n), rnd.randbytes(rnd.randint(0, 300))) for n in (0, 1, 63, 64, 65, 200)))]
    rows = spark.createDataFrame([(bytearray(k), bytearray(d), w) for k, d, w in cases] + [(None, bytearray(b"x"), None)], "k binary, d binary, w string")
    assert all(r.x == r.w for r in rows.select("w", signatures.hmac_sha256(F.col("k"), F.col("d")).alias("x")).collect())


def test_signed_events_have_four_verdicts(spark):
    mac = hmac.new(b"s3", b"body", hashlib.sha256).hexdigest()
    hub, lab, own = signatures.HEADERS
    cases = [("c", {hub: f"sha256={mac}"}, "valida", hub), ("c", {hub: mac}, "valida", hub), ("c", {own: f" {mac} "}, "valida", own), ("c", {lab: "s3"}, "valida", lab), ("c", {lab: mac}, "no_valida", lab), ("c", {hub: "sha256=00", own: mac}, "no_valida", hub), ("c", {hub: " ", own: mac}, "valida", own), ("c", {}, "sin_firma", None), ("c", None, "sin_firma", None), ("nadie", {hub: mac}, "sin_secreto", None), ("vacio", {}, "sin_secreto", None), (None, {}, "sin_secreto", None)]
    events = spark.createDataFrame([(i, c, bytearray(b"body"), h) for i, (c, h, _, _) in enumerate(cases)], "i int, cliente string, cuerpo binary, cabeceras map<string, string>")
    got = signatures.verified(events, spark.createDataFrame([("c", "s3"), ("vacio", ""), ("otro", "x")], "cliente string, secreto string")).orderBy("i").collect()
    assert [(r.firma, r.cabecera) for r in got] == [(v, h) for _, _, v, h in cases] and got[0].asDict().keys() == {"i", "cliente", "cuerpo", "cabeceras", "firma", "cabecera"}


def test_a_new_system_is_a_row(spark):
    rows = [("x", '{"a":[{"b":"Hecho"}],"q":{"w.z":1}}'), ("x", "not json"), ("x", None), ("y", '{"a":1}'), ("x", '{"a":[]}'), (None, "{}")]
    profiles = spark.createDataFrame([("x", "a.0.b", "q", None)], tickets.PROFILE)
    got = tickets.answers(spark.createDataFrame(rows, "system string, respuesta string"), profiles)
    assert [(r.external, r.actor, r.when) for r in got.collect()] == [("Hecho", '{"w.z":1}', None)] + [(None, None, None)] * 5
    t = spark.createDataFrame([("x", " hecho", "abierta", "ana", "2026", "r"), ("x", "otro", "abierta", "ana", "2026", "r"), ("z", "hecho", "abierta", "ana", "2026", "r")], "system string, external string, current string, actor string, when string, role string")
    moved = tickets.translate_by(t, spark.createDataFrame([("x", "Hecho ", "ejecutada")], tickets.COLUMN)).collect()
    assert sorted((r.system, r.external, r.verdict, r.after) for r in moved) == [("x", " hecho", "mueve", "ejecutada"), ("x", "otro", "estado_desconocido", "abierta"), ("z", "hecho", "estado_desconocido", "abierta")]


def test_templates_cannot_be_broken_out_of(spark):
    template = json.dumps({"fields": {"summary": "{titulo}", "content": [{"text": "[{nc}] {cuerpo}"}], "n": 1}}, ensure_ascii=False)
    values = [('a "q" \\ {modelo}\n', "x", "línea\t1"), (None, "y", ""), ('"},"admin":{"', "z", "{nada}")]
    rows = spark.createDataFrame(values, "t string, n string, c string").select("*", tickets.request_body(F.lit(template), {"titulo": F.col("t"), "nc": F.col("n"), "cuerpo": F.col("c")}).alias("x")).collect()
    assert [json.loads(r.x) for r in rows] == [{"fields": {"summary": t or "", "content": [{"text": f"[{n}] {c}"}], "n": 1}} for t, n, c in values]


def test_calls_as_a_lateral_join(spark):
    files.register(spark)
    t = spark.createDataFrame([("a.py", "x.f(1)\ny()\n"), ("b.py", "def ("), ("c.py", None), ("d.py", "z = 1")], "path string, text string")
    inner = spark.sql("SELECT path, c.* FROM {t}, LATERAL calls_of(text) c", t=t).collect()
    assert sorted(tuple(r) for r in inner) == [("a.py", 1, 0, "x.f"), ("a.py", 2, 0, "y")]


def test_levels_of_nulls_and_of_nothing(spark):
    rows = spark.createDataFrame([("a", None, "x"), (None, None, "x"), (None, "s", "y"), ("a", "s", "z")], "l string, s string, v string")
    got = {(r.nivel, r.l, r.s, r.v): r.n for r in rules.counted_levels(rows, "v", ("x", "y"), ("l", "s"), ("l",), ()).collect()}
    assert got[("total", None, None, "x")] == 2 and got[("l", None, None, "x")] == 1 and got[("l", "a", None, "y")] == 0 and got[("l+s", None, None, "x")] == 1 and got[("l+s", "a", "s", "x")] == 0
    assert len(got) == 2 * (4 + 2 + 1)
    assert rules.counted_levels(rows.limit(0), "v", ("x", "y"), ("l",), ()).collect() == []


def test_tree_digest_moves_with_what_it_says(spark):
    base = [(f"p{i}", f"t{i}", None) for i in range(300)] + [("u", None, None), ("e", None, "no es UTF-8")]
    digest = lambda rows: rules.tree_digest(spark.createDataFrame([("r", *x) for x in rows], "repo string, path string, text string, error string"), "repo").first()
    first = digest(base)
    assert (first.ficheros, first.ilegibles) == (302, 1) and digest(base[::-1]) == first
    for changed in ([*base[1:], ("p0", "other", None)], [*base[1:], ("p0b", "t0", None)], base[1:], [*base[:-1], ("e", None, "otro")], [*base[:-2], base[-1], ("u", "", None)], [*base[:-2], base[-1], ("u2", None, None)]):
        assert digest(changed).sujeto_digest != first.sujeto_digest


def test_pads_are_made_for_keys_and_not_for_events(spark):
    from probatum.catalog import QUERIES

    plan = QUERIES["signed_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("Join ")]
    assert above.count("Join ") == 1 and "sha2(" in above and "translate(" in plan and "translate(" not in above
