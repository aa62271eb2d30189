"""Registered queries on what comes from outside and what is counted over all: signatures, tickets by profile, calls in SQL, levels, trees, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.functions import signatures
from probatum.operators import rules, tickets
from probatum.plans.queries import query, table
from probatum.sources import files
from probatum.streaming import log as sink

_BYTES = "list_transform(range(1, 129, 2), lambda k: ('0x' || rpad(hex(encode(secreto)), 128, '0')[k:k + 1])::INT)"
_PAD = lambda byte: f"unhex(array_to_string(list_transform({_BYTES}, lambda b: lpad(hex(xor(b, {byte}))[-2:], 2, '0')), ''))"
_MAC = "sha256(o || unhex(sha256(i || cuerpo)))"


@query(f"""WITH s AS (SELECT n_nationkey AS c, n_name || '-' || n_nationkey AS secreto FROM nation WHERE n_nationkey % 5 <> 0), k AS (SELECT c, secreto, {_PAD(0x36)} AS i, {_PAD(0x5C)} AS o FROM s),
    e AS (SELECT event_id, user_id % 25 AS c, encode(coalesce(props, '')) AS cuerpo, event_id % 7 AS m FROM events),
    j AS (SELECT e.*, k.secreto, {_MAC} AS mac FROM e LEFT JOIN k USING (c))
    SELECT event_id, CASE WHEN secreto IS NULL THEN 'sin_secreto' WHEN m = 5 THEN 'sin_firma' WHEN m IN (0, 1, 2) THEN 'valida' ELSE 'no_valida' END AS firma, CASE WHEN secreto IS NOT NULL AND m <> 5 THEN CASE WHEN m IN (2, 4) THEN 'X-Gitlab-Token' WHEN m = 1 THEN 'X-Firma' ELSE 'X-Hub-Signature-256' END END AS cabecera, mac FROM j""")
def signed_events(spark, sf_dir):
    """Events signed with their client's secret, with another's, with the bare secret, or not at all; a fifth of the clients has none."""
    n, m = F.col("n_nationkey"), F.col("event_id") % 7
    secrets = table(spark, sf_dir, "nation").where(n % 5 != 0).select(n.alias("cliente"), F.concat("n_name", F.lit("-"), n).alias("secreto"))
    inner, outer = signatures.pads(F.col("secreto").cast("binary"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("cliente"), F.coalesce("props", F.lit("")).cast("binary").alias("cuerpo"))
    right = e.join(F.broadcast(secrets.select("*", inner.alias("i"), outer.alias("o"))), "cliente", "left").withColumn("mac", signatures.signed(F.col("i"), F.col("o"), F.col("cuerpo")))  # one for each nation
    sent = (
        F.when(m == 0, F.create_map(F.lit("X-Hub-Signature-256"), F.concat(F.lit("sha256="), "mac"))).when(m == 1, F.create_map(F.lit("X-Firma"), F.col("mac"), F.lit("X-Gitlab-Token"), F.lit(" ")))
        .when(m == 2, F.create_map(F.lit("X-Gitlab-Token"), F.col("secreto"))).when(m == 4, F.create_map(F.lit("X-Gitlab-Token"), F.col("mac")))
        .when(m == 5, F.create_map(F.lit("Otra"), F.col("mac"))).otherwise(F.create_map(F.lit("X-Hub-Signature-256"), F.concat(F.lit("sha256=0"), F.substring("mac", 2, 63)), F.lit("X-Firma"), F.col("mac")))
    )
    first = F.when((m == 3) | (m == 6), F.create_map(F.lit("X-Hub-Signature-256"), F.concat(F.lit("sha256=x"), F.substring("mac", 2, 63)), F.lit("X-Firma"), F.col("mac"))).otherwise(sent)
    return signatures.verified(right.select("event_id", "cliente", "cuerpo", "mac", first.alias("cabeceras")), secrets).select("event_id", "firma", "cabecera", "mac")


@query("""WITH r AS (SELECT o_orderkey AS k, ['jira', 'linear', 'propio', 'nadie'][(o_orderkey % 4 + 1)::INT] AS s, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'In Progress' ELSE 'raro' END AS x, 'C#' || o_custkey AS a, strftime(o_orderdate, '%Y-%m-%d') AS w FROM orders),
    t AS (SELECT *, CASE WHEN s <> 'nadie' THEN x END AS external, CASE WHEN s = 'jira' OR (s = 'propio' AND k % 8 = 2) THEN a END AS actor, CASE WHEN s <> 'nadie' THEN w END AS momento FROM r),
    m AS (SELECT *, CASE WHEN external = 'Done' THEN 'ejecutada' WHEN external = 'In Progress' AND s <> 'propio' THEN 'en_analisis' END AS read FROM t)
    SELECT k AS o_orderkey, external, actor, momento, read, CASE WHEN read IS NULL THEN 'estado_desconocido' WHEN actor IS NULL THEN 'sin_persona' ELSE 'mueve' END AS verdict FROM m""")
def ticket_profiles(spark, sf_dir):
    """Responses of three systems, each read by the paths of its row; one of them is nobody's code. Of a fourth there is no profile."""
    k, who, when = F.col("o_orderkey"), F.concat(F.lit("C#"), "o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    state = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "In Progress").otherwise("raro")
    text = (
        F.when(k % 4 == 0, F.to_json(F.struct(F.struct(F.struct(state.alias("name")).alias("status"), F.struct(who.alias("displayName")).alias("assignee"), when.alias("changed")).alias("fields"))))
        .when(k % 4 == 1, F.to_json(F.struct(F.struct(F.struct(state.alias("name"), when.alias("at")).alias("state")).alias("data"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("otra").alias("columna"), F.lit(None).cast("string").alias("dia")), F.struct(state.alias("columna"), when.alias("dia"))).alias("pasos"), F.when(k % 8 == 2, F.array(who)).alias("gente"))))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in ("jira", "linear", "propio", "nadie")]), (k % 4 + 1).cast("int")).alias("system"), text.alias("respuesta"))
    profiles = spark.createDataFrame([("jira", "fields.status.name", "fields.assignee.displayName", "fields.changed"), ("linear", "data.state.name", "data.state.by", "data.state.at"), ("propio", "pasos.1.columna", "gente.0", "pasos.1.dia")], tickets.PROFILE)
    meanings = spark.createDataFrame([("jira", "Done", "ejecutada"), ("jira", "in progress", "en_analisis"), ("linear", "done", "ejecutada"), ("linear", "In Progress ", "en_analisis"), ("propio", "done", "ejecutada")], tickets.COLUMN)
    read = tickets.answers(rows, profiles).withColumn("current", F.lit("abierta")).withColumn("role", F.lit("responsable"))
    return tickets.translate_by(read, meanings).select("o_orderkey", "external", "actor", F.col("when").alias("momento"), "read", "verdict")


@query("""SELECT p_partkey, unnest([2, 3]) AS line, unnest([0, 4]) AS col, unnest(['kit.m' || (p_partkey % 12), 'f.g']) AS dotted FROM part WHERE p_partkey % 5 <> 0""")
def calls_in_sql(spark, sf_dir):
    """One Python file for each part, a fifth of which doesn't parse; its calls are a lateral join in SQL."""
    files.register(spark)
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, "def (").otherwise(F.concat(F.lit("import kit\nkit.m"), k % 12, F.lit("(1)\nx = f.g()\n")))
    return spark.sql("SELECT p_partkey, c.* FROM {code}, LATERAL calls_of(text) c", code=table(spark, sf_dir, "part").select(k, code.alias("text")))


_KINDS = ("corto", "medio", "largo", "enorme")
_KIND = "CASE WHEN length(coalesce(text, '')) < 500 THEN 'corto' WHEN length(coalesce(text, '')) < 2000 THEN 'medio' WHEN length(coalesce(text, '')) < 500000000 THEN 'largo' ELSE 'enorme' END"
_LEVEL = lambda cols, name: f"SELECT {'lang' if 'lang' in cols else 'NULL'} AS lang, {'source' if 'source' in cols else 'NULL'} AS source, '{name}' AS nivel, k.clase, count(*) FILTER (WHERE d.clase = k.clase) AS n FROM d, (SELECT unnest(['corto', 'medio', 'largo', 'enorme']) AS clase) k GROUP BY ALL"


@query(f"WITH d AS (SELECT lang, source, {_KIND} AS clase FROM documents) {_LEVEL(('lang', 'source'), 'lang+source')} UNION ALL {_LEVEL(('lang',), 'lang')} UNION ALL {_LEVEL(('source',), 'source')} UNION ALL {_LEVEL((), 'total')}")
def counts_by_level(spark, sf_dir):
    """Documents of each class by language and source, by either, and overall, from one pass; one class is always empty."""
    d = table(spark, sf_dir, "documents").select("lang", "source", F.expr(_KIND).alias("clase"))
    return rules.counted_levels(d, "clase", _KINDS, ("lang", "source"), ("lang",), ("source",), ())


_TREE = "(SELECT source, sha256(path) AS pos, path || ':' || CASE WHEN doc_id % 13 = 0 THEN '(ilegible) no es UTF-8' WHEN doc_id % 7 = 0 THEN '(no leido)' ELSE sha256(coalesce(text, '')) END AS d, doc_id % 13 = 0 AS bad FROM (SELECT *, lang || '/' || doc_id AS path FROM documents))"


@query(f"""WITH a AS (SELECT source, pos[1:4] AS pos, sha256(string_agg(d, chr(10) ORDER BY t.pos, d)) AS d, count(*) AS n, count(*) FILTER (WHERE bad) AS m FROM {_TREE} t GROUP BY source, pos[1:4]),
    b AS (SELECT source, pos[1:2] AS pos, sha256(string_agg(pos || ':' || d, chr(10) ORDER BY a.pos)) AS d, sum(n) AS n, sum(m) AS m FROM a GROUP BY source, pos[1:2])
    SELECT source, sha256(string_agg(pos || ':' || d, chr(10) ORDER BY pos)) AS sujeto_digest, sum(n)::BIGINT AS ficheros, sum(m)::BIGINT AS ilegibles FROM b GROUP BY source""")
def tree_digests(spark, sf_dir):
    """A digest of every source's tree, with the names of files that weren't read and those that couldn't be."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("source", F.concat("lang", F.lit("/"), i).alias("path"), F.when((i % 13 != 0) & (i % 7 != 0), F.coalesce("text", F.lit(""))).alias("text"), F.when(i % 13 == 0, "no es UTF-8").alias("error"))
    return rules.tree_digest(d, "source")


@query("""WITH e AS (SELECT user_id, event_id, ts, ['30', '1', NULL][(user_id % 3 + 1)::INT]::INT AS d FROM events), x AS (SELECT user_id, max(ts) AS cuando, arg_max(d, ts) AS d FROM e GROUP BY user_id)
    SELECT user_id::VARCHAR AS control_id, CASE WHEN d IS NOT NULL AND TIMESTAMP '2024-02-01' >= cuando + to_days(d) THEN 'rancia' ELSE 'valida' END AS estado, cuando, cuando + to_days(d) AS vence FROM x""")
def freshness_terms(spark, sf_dir):
    """Every user's last look and its term as of a moment: what the timers of the stream leave behind."""
    days = F.element_at(F.array(F.lit(30), F.lit(1), F.lit(None).cast("int")), (F.col("user_id") % 3 + 1).cast("int"))
    looks = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("control_id"), F.col("ts").alias("cuando"), days.alias("frescura_dias"))
    return sink.freshness_as_of(looks, F.lit("2024-02-01").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT event_id, user_id::VARCHAR AS control_id, event_type AS sujeto_digest, coalesce(props, '') AS contenido, ts AS cuando, (event_id % 3)::BIGINT AS lote FROM events),
    o AS (SELECT *, row_number() OVER (ORDER BY lote, cuando, event_id) AS n FROM r)
    SELECT n, lote, CASE WHEN n = min(n) OVER (PARTITION BY control_id, sujeto_digest, contenido) THEN 'observacion' ELSE 'revalidacion' END AS tipo, control_id, sujeto_digest, contenido, true AS encadena FROM o""")
def log_in_batches(spark, sf_dir):
    """All events appended to a new log in three batches, read back: new content is an observation, and every line enters the seal before."""
    from probatum.functions.lineage import shared_folder

    log = sink.Log(spark, shared_folder(spark, "log"), "log_in_batches")
    e = table(spark, sf_dir, "events")
    for batch in range(3):
        rows = e.where(F.col("event_id") % 3 == batch).select(F.col("user_id").cast("string").alias("control_id"), F.col("event_type").alias("sujeto_digest"), F.coalesce("props", F.lit("")).alias("contenido"), F.col("ts").cast("timestamp").alias("cuando"), "event_id")
        log.append(sink.numbered(rows, "cuando", "event_id").drop("event_id"), batch)
    lines = sink.read(spark, log.path)
    bad = sink.breaks(lines).select("n").withColumn("mal", F.lit(True))
    return lines.join(bad, "n", "left").select("n", "lote", "tipo", "control_id", "sujeto_digest", "contenido", F.col("mal").isNull().alias("encadena"))
