"""Registered queries on catalogues, access, dependencies, logs and pushes; as before, driver tables stand in.

parts stand for questions, suppliers for obligations, nations for clauses, customers for dependencies and users.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probatum.functions import merkle
from probatum.operators import access, catalogue, dossier, evidence
from probatum.plans.queries import query, table
from probatum.sources import files, logs, pushes


def _clauses(spark, sf_dir):
    """A ring of clauses in which some edges go one way only, some lead nowhere, and some products are missing."""
    n = F.col("n_nationkey")
    name = lambda x: F.concat(F.lit("C-"), x.cast("string"))
    return table(spark, sf_dir, "nation").select(
        name(n).alias("id"), F.array(name((n + 1) % 25), F.when(n % 5 == 0, F.lit("C-99"))).alias("alimenta"),
        F.array(name((n + 24) % 25), F.when(n % 6 == 0, name((n + 2) % 25)), F.when(n % 11 == 0, F.lit("C-77"))).alias("depende_de"),
        (n % 4 == 0).alias("exige"), F.when(n % 8 == 0, F.array(F.lit("acta"))).otherwise(F.array().cast("array<string>")).alias("produce"),
    )


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation),
    f AS (SELECT 'C-' || k AS id, 'C-' || ((k + 1) % 25) AS d FROM n UNION SELECT 'C-' || k, 'C-99' FROM n WHERE k % 5 = 0),
    p AS (SELECT 'C-' || k AS id, 'C-' || ((k + 24) % 25) AS d FROM n UNION SELECT 'C-' || k, 'C-' || ((k + 2) % 25) FROM n WHERE k % 6 = 0 UNION SELECT 'C-' || k, 'C-77' FROM n WHERE k % 11 = 0),
    ids AS (SELECT 'C-' || k AS id FROM n),
    must AS (SELECT * FROM (VALUES ('C-3', 'C-2'), ('C-4', 'C-50')) t(id, d)),
    r AS (SELECT x.id, y.id AS d FROM ids x, ids y UNION SELECT id, 'C-99' FROM ids)
    SELECT id, 'alimenta_inexistente' AS problema, d AS detalle FROM f WHERE d NOT IN (SELECT id FROM ids)
    UNION ALL SELECT id, 'depende_inexistente', d FROM p WHERE d NOT IN (SELECT id FROM ids)
    UNION ALL SELECT id, 'una_sola_direccion', d FROM p WHERE d IN (SELECT id FROM ids) AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = p.d AND f.d = p.id)
    UNION ALL SELECT 'C-' || k, 'sin_producto', NULL FROM n WHERE k % 4 = 0 AND k % 8 <> 0
    UNION ALL SELECT id, 'ciclo_abierto', d FROM must WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = must.id AND r.d = must.d)""")
def management_cycle(spark, sf_dir):
    """25 clauses at every size; a walk of as many steps reaches whatever can be reached."""
    return catalogue.management_problems(_clauses(spark, sf_dir), (("C-3", "C-2"), ("C-4", "C-50")), 25)


_FORMAT = "CASE p_partkey % 9 WHEN 0 THEN 'eleccion' WHEN 1 THEN 'si_no' WHEN 2 THEN 'fecha' WHEN 3 THEN 'dibujo' ELSE 'lista' END"
_LEVEL = "CASE s_suppkey % 3 WHEN 0 THEN 'organizativa' WHEN 1 THEN 'juzgada' ELSE 'maquina' END"


@query(f"""WITH q AS (SELECT p_partkey AS k, 'Q-' || p_partkey AS id, {_FORMAT} AS formato, CASE WHEN p_partkey % 10 = 7 THEN 'nadie' ELSE 'tecnico' END AS destinatario FROM part),
    s AS (SELECT DISTINCT id, k, unnest(['S-' || (k * 7 % 60), CASE WHEN k % 3 = 0 THEN 'C-' || (k % 30) ELSE 'R-' || (k % 5) END]) AS d FROM q),
    ob AS (SELECT 'S-' || s_suppkey AS id, {_LEVEL} AS nivel FROM supplier), cl AS (SELECT 'C-' || n_nationkey AS id FROM nation), co AS (SELECT 'R-' || r_regionkey AS id FROM region),
    known AS (SELECT id FROM ob UNION ALL SELECT id FROM cl UNION ALL SELECT id FROM co)
    SELECT id, 'sirve_a_inexistente' AS problema, d AS detalle FROM s WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.id = s.d)
    UNION ALL SELECT id, 'control_no_declarado', 'R-' || (k % 7) FROM q WHERE k % 4 = 0 AND k % 7 > 4
    UNION ALL SELECT id, 'formato', formato FROM q WHERE formato = 'dibujo'
    UNION ALL SELECT id, 'destinatario', destinatario FROM q WHERE destinatario = 'nadie'
    UNION ALL SELECT id, 'eleccion_sin_opciones', formato FROM q WHERE formato = 'eleccion' AND k % 2 = 0
    UNION ALL SELECT id, 'condicion_inexistente', 'Q-X' || k FROM q WHERE k % 50 = 49
    UNION ALL SELECT id, 'clausula_sin_pregunta', NULL FROM cl WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.d = cl.id)
    UNION ALL SELECT id, 'obligacion_sin_pregunta', nivel FROM ob WHERE nivel <> 'maquina' AND NOT EXISTS (SELECT 1 FROM s WHERE s.d = ob.id)""")
def question_bank(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    none = F.array().cast("array<string>")
    questions = table(spark, sf_dir, "part").select(
        name("Q-", k).alias("id"), F.array(name("S-", k * 7 % 60), F.when(k % 3 == 0, name("C-", k % 30)).otherwise(name("R-", k % 5))).alias("sirve_a"),
        F.when(k % 4 == 0, F.array(name("R-", k % 7))).otherwise(none).alias("salta_si_cubre"), F.expr(_FORMAT).alias("formato"),
        F.when(k % 10 == 7, "nadie").otherwise("tecnico").alias("destinatario"), F.when(k % 2 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("opciones"),
        F.when(k % 50 == 49, name("Q-X", k)).when(k % 50 == 1, name("Q-", k - 1)).alias("si"),
    )
    obligations = table(spark, sf_dir, "supplier").select(name("S-", F.col("s_suppkey")).alias("id"), F.expr(_LEVEL).alias("nivel"))
    clauses = table(spark, sf_dir, "nation").select(name("C-", F.col("n_nationkey")).alias("id"))
    controls = table(spark, sf_dir, "region").select(name("R-", F.col("r_regionkey")).alias("id"))
    return catalogue.question_problems(questions, obligations, clauses, controls, controls)


_ROLE = "CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'observacion' WHEN 2 THEN 'remediacion' WHEN 3 THEN 'lectura' END"
_VERB = "CASE c_custkey % 7 WHEN 0 THEN 'plan' WHEN 1 THEN 'almacen verificar' WHEN 2 THEN 'almacen migrar' WHEN 3 THEN 'anexo iv' WHEN 4 THEN 'remediar' WHEN 5 THEN 'borrar' ELSE 'soa' END"


@query(f"""SELECT c_custkey, CASE WHEN v IN ('almacen migrar', 'borrar') OR r IS NULL THEN false WHEN v IN ('almacen verificar', 'anexo iv', 'soa') OR r = 'admin' THEN true
    WHEN v = 'plan' THEN r = 'observacion' ELSE r = 'remediacion' END AS puede FROM (SELECT c_custkey, {_ROLE} AS r, {_VERB} AS v FROM customer)""")
def role_access(spark, sf_dir):
    role = F.expr(_ROLE)
    roles = F.when(role.isNotNull(), F.array(role)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", access.may(roles, F.expr(_VERB)).alias("puede"))


_DEP = "'lib' || (c_custkey % 50) || CASE c_custkey % 4 WHEN 0 THEN '==1.' || (c_custkey % 9) WHEN 1 THEN '~=2.0' WHEN 2 THEN ' @sha256:ab' ELSE '>2' END"


@query(f"""SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE regexp_matches(d, '[=~]=|@sha256:')) AS fijadas, list_sort(list(DISTINCT d))[1:60] AS lista
    FROM (SELECT c_nationkey, {_DEP} AS d FROM customer) GROUP BY c_nationkey""")
def pinned_dependencies(spark, sf_dir):
    """The list is the first 60 of the sorted distinct declarations, as its reports show them; the counts are of all."""
    d = table(spark, sf_dir, "customer").select("c_nationkey", F.expr(_DEP).alias("d"))
    return dossier.dependencies(d, "c_nationkey", "d")


@query("""WITH b AS (SELECT event_id AS i, substr(sha256('x' || event_id), 1, 40) AS s FROM events)
    SELECT i AS event_id, CASE i % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' WHEN 3 THEN 'azure' END AS provider,
           CASE WHEN i % 5 < 4 THEN s END AS sha, CASE WHEN i % 5 < 4 THEN 'refs/heads/r' || (i % 3) END AS ref FROM b""")
def webhook_paths(spark, sf_dir):
    """A payload for each event, of one of four hosts or with a commit that isn't one."""
    i = F.col("event_id")
    s = F.substring(F.sha2(F.concat(F.lit("x"), i.cast("string")).cast("binary"), 256), 1, 40)
    ref = F.concat(F.lit("refs/heads/r"), (i % 3).cast("string"))
    body = (
        F.when(i % 5 == 0, F.format_string('{"repository":{"full_name":"a/b"},"ref":"%s","after":"%s"}', ref, s))
        .when(i % 5 == 1, F.format_string('{"object_kind":"push","ref":"%s","checkout_sha":"%s"}', ref, s))
        .when(i % 5 == 2, F.format_string('{"push":{"changes":[{"new":{"name":"%s","target":{"hash":"%s"}}}]}}', ref, s))
        .when(i % 5 == 3, F.format_string('{"eventType":"git.push","resource":{"refUpdates":[{"name":"%s","newObjectId":"%s"}]}}', ref, s))
        .otherwise(F.format_string('{"object_kind":"push","ref":"%s","checkout_sha":"zz%s"}', ref, s))
    )
    return pushes.decode(table(spark, sf_dir, "events").select("event_id", body.alias("body"))).select("event_id", "provider", "sha", "ref")


@query("SELECT conv_id, arg_max(role, turn) AS encargo, count(*) AS encargos FROM conversations GROUP BY conv_id")
def latest_delegation(spark, sf_dir):
    return dossier.latest_order(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 256")
def failed_retention(spark, sf_dir):
    """The last 256 failures are kept: that bound is the operator."""
    return evidence.retained(table(spark, sf_dir, "events").where("event_type = 'error'"), 256, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id")


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, sha256('\\x00'::BLOB || vec_id::VARCHAR::BLOB) AS h FROM embeddings)
    SELECT i // 2 AS i, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256('\\x01'::BLOB || unhex(max(h) FILTER (WHERE i % 2 = 0)) || unhex(max(h) FILTER (WHERE i % 2 = 1))) END AS h FROM l GROUP BY i // 2""")
def merkle_level1(spark, sf_dir):
    """The level above the leaves; vec_id is dense from 0, as an index must be."""
    return merkle.above(merkle.leaves(table(spark, sf_dir, "embeddings").withColumn("d", F.col("vec_id").cast("string")), "vec_id", "d"))


@query("SELECT 'kit.m' || (p_partkey % 12) AS dotted, count(*) AS sitios, min(p_partkey) AS primero FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL")
def call_extract(spark, sf_dir):
    """One Python file for each part, a fifth of which doesn't parse."""
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, "def (").otherwise(F.concat(F.lit("import kit\nkit.m"), (k % 12).cast("string"), F.lit("(1)\n")))
    calls, _ = files.call_sites(table(spark, sf_dir, "part").select(F.concat(k.cast("string"), F.lit(".py")).alias("path"), code.alias("text")))
    return calls.groupBy("dotted").agg(F.count("*").alias("sitios"), F.min(F.split_part("path", F.lit("."), F.lit(1)).cast("long")).alias("primero"))


@query("""SELECT user_id::VARCHAR AS log, count(*) AS lineas, count(*) AS sin_cadena FROM events GROUP BY user_id""")
def log_migration(spark, sf_dir):
    """One log for each user, all without seals: moved, every line is marked and the new chain has no break."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    line = F.to_json(F.struct(F.lit("observacion").alias("tipo"), F.col("ts").cast("string").alias("cuando"), F.col("props").alias("registro")))
    moved = logs.migrate(e.select(F.col("user_id").cast("string").alias("log"), line.alias("line"), n.alias("n")))
    return moved.groupBy("log").agg(F.count("*").alias("lineas"), F.count_if(F.col("origen").isin(*logs.UNPROVEN)).alias("sin_cadena"))
