"""Registered queries on plans of several analysers: every source of documents stands for a repository.

Its files are MCP configurations, dependency lists, agents and generators made from ids, and the documents themselves as prose;
calls and imports are those of the generators. lineitem stands for the artefacts that a repository supplied, supplier for its publication steps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.operators import analysers, controls, packs
from probatum.operators.rules import RuleSpec
from probatum.plans.queries import query, table

_AG = [RuleSpec(i, "agentes", "alta", pack="agentes", obligation="AIA-014", engine="agentes") for i in (controls.UNDECLARED, controls.BLIND, controls.UNLIMITED, controls.UNCAPPED)]
_ART = [
    RuleSpec(analysers.IMAGE, "art50", "alta", signatures=("images.generate", "replicate.run"), requires_import=("openai", "replicate"), pack="art50", obligation="AIA-050", engine="art50"),
    RuleSpec(analysers.TEXT, "art50", "media", signatures=("chat.completions.create",), requires_import=("openai",), pack="art50", obligation="AIA-050", engine="art50"),
    RuleSpec(analysers.BOT, "art50", "alta", signatures=("app.post",), requires_import=("fastapi",), pack="art50", obligation="AIA-050", engine="art50"),
    *[RuleSpec(i, "art50", "alta", pack="art50", obligation="AIA-050", engine="art50") for i in (analysers.UNMARKED, analysers.UNREADABLE, analysers.ERASED, analysers.FRAGILE)],
]
RULES = (
    RuleSpec("G-PROSA", "fichero", "media", patterns=(r"^n.*\.md$",), pack="art14", obligation="AIA-014"),
    RuleSpec("G-PROHIBIDO", "contenido_prohibido", "alta", patterns=("depth=9",), pack="art14", obligation="AIA-014"),
    RuleSpec("G-APORTA", "aportado", "alta", pack="art15", obligation="AIA-015", question="que cifra"),
    *_AG, RuleSpec("ACT-AG-APROBACION", "aportado", "alta", pack="agentes", obligation="AIA-014", engine="agentes"), *_ART,
)

#: Repositories that end in 3 have prose only, those in 7 a framework that nothing shows, those in 1 a limit of steps.
_D = """(SELECT source AS repo, doc_id AS i, doc_id % 7 AS j, CASE WHEN source LIKE '%3' THEN 5 WHEN source LIKE '%7' THEN CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 5 END ELSE (doc_id // 20) % 6 END AS k FROM documents)"""
_TREES = f"""(SELECT repo, i, j, k, CASE k WHEN 0 THEN 'cfg' || i || '/mcp.json' WHEN 1 THEN 'r' || i || '/requirements.txt' WHEN 2 THEN 'ag' || i || '.py' WHEN 3 THEN 'img' || i || '.py' WHEN 4 THEN 'bot' || i || '.py' ELSE 'n' || i || '.md' END AS path FROM {_D})"""
#: Structure of agents: what the reader makes of these files.
_ROWS = f"""(SELECT repo, 'server' AS kind, CASE WHEN i % 5 = 0 THEN 'v' ELSE 's' END || j AS name, 'mcp' AS origin, path, 0 AS line, false AS noted FROM {_TREES} WHERE k = 0
    UNION ALL SELECT repo, 'tool', 's' || j || '.t' || j, 'mcp', path, 0, i % 4 = 0 FROM {_TREES} WHERE k = 0 AND i % 5 <> 0
    UNION ALL SELECT repo, 'framework', 'langchain', 'dependencia', path, 0, false FROM {_TREES} WHERE k = 1
    UNION ALL SELECT repo, 'delegation', 'run_agent', 'llamada', path, 2, false FROM {_TREES} WHERE k = 2
    UNION ALL SELECT repo, 'limit', CASE WHEN repo LIKE '%1' THEN 'pasos' ELSE 'tiempo' END, CASE WHEN repo LIKE '%1' THEN 'max_steps' ELSE 'timeout' END, path, 2, false FROM {_TREES} WHERE k = 2 AND (repo LIKE '%1' OR repo LIKE '%4'))"""
_REPOS = "(SELECT DISTINCT source AS repo FROM documents)"
_SEEN = f"""(SELECT repo, bool_or(kind IN ('tool', 'delegation', 'server')) AS hay, bool_or(kind = 'framework') AS marco, bool_or(kind = 'limit') AS lim, bool_or(kind = 'limit' AND name = 'pasos') AS pasos, count(DISTINCT name) FILTER (WHERE kind = 'server') AS sv,
    count(*) FILTER (WHERE kind = 'delegation') AS dl, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE kind = 'limit')), ', ') AS limits FROM {_ROWS} GROUP BY repo)"""
_TOOLS = f"(SELECT repo, name, bool_or(noted) AS d FROM {_ROWS} WHERE kind = 'tool' GROUP BY ALL)"
_BLIND = f"(SELECT DISTINCT repo, name FROM {_ROWS} s WHERE kind = 'server' AND NOT EXISTS (SELECT 1 FROM {_TOOLS} t WHERE t.repo = s.repo AND split_part(t.name, '.', 1) = s.name))"
_CALL = f"(SELECT repo, path, i, unnest(CASE k WHEN 3 THEN ['client.images.generate', 'x.save'] ELSE ['c.chat.completions.create', 'app.post'] END) AS dotted, CASE WHEN i % 3 = 0 THEN 'otro' ELSE 'openai' END AS m1, CASE WHEN i % 2 = 0 THEN 'fastapi' ELSE 'flask' END AS m2 FROM {_TREES} WHERE k = 3 OR k = 4)"
_SITES = f"""(SELECT repo, count(*) FILTER (WHERE dotted = 'client.images.generate' AND m1 = 'openai') AS img, count(*) FILTER (WHERE dotted = 'c.chat.completions.create' AND m1 = 'openai') AS txt, count(*) FILTER (WHERE dotted = 'app.post' AND m2 = 'fastapi' AND m1 = 'openai') AS bot FROM {_CALL} GROUP BY repo)"""
_MARKS = """(SELECT 'src' || (l_suppkey % 20) AS repo, count(*) FILTER (WHERE l_suppkey % 20 > 8) AS ok, count(*) FILTER (WHERE l_suppkey % 20 IN (5, 6, 10)) AS doubt, count(*) FILTER (WHERE l_suppkey % 20 = 12 AND l_partkey % 2 = 0) AS bad, count(*) FILTER (WHERE l_suppkey % 20 = 12 AND l_partkey % 2 = 1) AS unread FROM lineitem WHERE l_linenumber < 7 AND l_suppkey % 20 NOT IN (0, 2) GROUP BY ALL)"""
_MARKS = _MARKS.replace("l_suppkey % 20 > 8)", "l_suppkey % 20 > 8 AND l_suppkey % 20 NOT IN (10, 12))")
_STEPS = """(SELECT 'src' || s_suppkey % 20 AS repo, CASE min(s_suppkey) % 5 WHEN 0 THEN 'PIPE-BORRA' WHEN 1 THEN 'PIPE-FRAGIL' WHEN 2 THEN 'sin_decidir' END AS cadena FROM supplier GROUP BY s_suppkey % 20)"""
_A50 = f"""(SELECT repo, img, txt, bot, ok, doubt, bad, unread, cadena, img + txt + bot > 0 AS gen, img + txt + bot > 0 AND NOT (img > 0 AND ok + doubt + bad + unread = 0) AS looked FROM (SELECT r.repo, coalesce(img, 0) AS img, coalesce(txt, 0) AS txt, coalesce(bot, 0) AS bot, coalesce(ok, 0) AS ok, coalesce(doubt, 0) AS doubt, coalesce(bad, 0) AS bad, coalesce(unread, 0) AS unread, cadena
    FROM {_REPOS} r LEFT JOIN {_SITES} s USING (repo) LEFT JOIN {_MARKS} m USING (repo) LEFT JOIN {_STEPS} p USING (repo)))"""
_NONE = "NULL::VARCHAR"
_row = lambda pack, rule, applies, n, signal, limit=_NONE, strength="presencia": f"'{pack}' AS paquete, '{rule}' AS regla_id, {applies} AS aplicable, (CASE WHEN {applies} THEN {n} ELSE 0 END)::BIGINT AS hallazgos, CASE WHEN {applies} THEN {signal} END AS senal, {limit} AS limite, '{strength}' AS fuerza"
_AGROW = lambda rule, n, signal: f"SELECT repo, {_row('agentes', rule, 'coalesce(hay, false)', n, signal)} FROM {_REPOS} r LEFT JOIN {_SEEN} s USING (repo)"
_E = f"""(SELECT repo, {_row('art14', 'G-PROSA', 'true', '(n = 0)::INT', "CASE WHEN n > 0 THEN n || ' ficheros casan (' || p || ')' END")} FROM (SELECT repo, count(*) FILTER (WHERE k = 5) AS n, min(path) FILTER (WHERE k = 5) AS p FROM {_TREES} GROUP BY repo)
    UNION ALL SELECT repo, {_row('art14', 'G-PROHIBIDO', 'true', 'n', "CASE WHEN n = 0 THEN 'ninguna aparicion en ' || c || ' ficheros' END")} FROM (SELECT repo, count(*) FILTER (WHERE k = 2 AND i % 9 = 0) AS n, count(*) FILTER (WHERE k IN (0, 2, 3, 4)) AS c FROM {_TREES} GROUP BY repo)
    UNION ALL SELECT repo, {_row('art15', 'G-APORTA', 'false', '0', _NONE, "'falta_aporte'", 'aportado')} FROM {_REPOS}
    UNION ALL {_AGROW(controls.UNDECLARED, f"(SELECT count(*) FROM {_TOOLS} t WHERE t.repo = r.repo AND NOT d)", f"(SELECT CASE WHEN count(*) FILTER (WHERE d) > 0 THEN count(*) FILTER (WHERE d) || ' de ' || count(*) || ' herramientas declaran su efecto' END FROM {_TOOLS} t WHERE t.repo = r.repo)")}
    UNION ALL {_AGROW(controls.BLIND, f"(SELECT count(*) FROM {_BLIND} b WHERE b.repo = r.repo)", f"CASE WHEN sv > 0 AND NOT EXISTS (SELECT 1 FROM {_BLIND} b WHERE b.repo = r.repo) THEN 'los ' || sv || ' servidores enumeran sus herramientas' END")}
    UNION ALL {_AGROW(controls.UNLIMITED, "(NOT lim)::INT", "CASE WHEN lim THEN limits END")}
    UNION ALL {_AGROW(controls.UNCAPPED, "CASE WHEN pasos THEN 0 ELSE dl END", "CASE WHEN pasos AND dl > 0 THEN dl || ' delegaciones con tope de pasos' END")}
    UNION ALL SELECT repo, {_row('agentes', 'ACT-AG-APROBACION', 'false', '0', _NONE, "'falta_aporte'", 'aportado')} FROM {_REPOS}
    UNION ALL SELECT repo, {_row('art50', analysers.IMAGE, 'gen', '0', "CASE WHEN img > 0 THEN img || ' puntos de generacion de imagen' END")} FROM {_A50}
    UNION ALL SELECT repo, {_row('art50', analysers.TEXT, 'gen', '0', "CASE WHEN txt > 0 THEN txt || ' puntos de generacion de texto' END")} FROM {_A50}
    UNION ALL SELECT repo, {_row('art50', analysers.BOT, 'gen', '0', "CASE WHEN bot > 0 THEN bot || ' puntos de entrada de asistente' END")} FROM {_A50}
    UNION ALL SELECT repo, {_row('art50', analysers.UNMARKED, 'gen', 'CASE WHEN looked THEN bad ELSE 0 END', "CASE WHEN looked AND ok > 0 THEN ok || ' artefactos con marcado leido' END")} FROM {_A50}
    UNION ALL SELECT repo, {_row('art50', analysers.UNREADABLE, 'gen', 'CASE WHEN looked THEN unread ELSE 0 END', _NONE)} FROM {_A50}
    UNION ALL SELECT repo, {_row('art50', analysers.ERASED, 'gen', "CASE WHEN looked AND cadena = 'PIPE-BORRA' THEN ok ELSE 0 END", _NONE)} FROM {_A50}
    UNION ALL SELECT repo, {_row('art50', analysers.FRAGILE, 'gen', "CASE WHEN looked AND cadena = 'PIPE-FRAGIL' THEN ok ELSE 0 END", _NONE)} FROM {_A50})"""


def _trees(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("source")
    k = F.when(s.endswith("3"), 5).when(s.endswith("7"), F.when(i % 2 == 0, 1).otherwise(5)).otherwise(F.expr("(doc_id div 20) % 6"))
    d = table(spark, sf_dir, "documents").select(s.alias("repo"), i.cast("string").alias("i"), i.alias("n"), (i % 7).cast("string").alias("j"), k.alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    pick = lambda *xs: F.element_at(F.array(*xs), F.col("k").cast("int") + 1)
    c = lambda *xs: F.concat(*[F.col(x) if x in ("i", "j", "t") else F.lit(x) for x in xs])
    tool = F.when(F.col("n") % 5 == 0, c('{"mcpServers": {"v', "j", '": {"command": "x"}}}')).otherwise(F.concat(c('{"mcpServers": {"s', "j", '": {"tools": [{"name": "t', "j", '"'), F.when(F.col("n") % 4 == 0, ', "annotations": {"readOnlyHint": true}').otherwise(""), F.lit("}]}}}")))
    limit = F.when(F.col("repo").endswith("1"), ", max_steps=3").when(F.col("repo").endswith("4"), ", timeout=5").otherwise("")
    agent = F.concat(F.lit("import agents\nrun_agent(goal"), limit, F.when(F.col("n") % 9 == 0, ", depth=9").otherwise(""), F.lit(")\n"))
    text = pick(tool, c("langchain==1\n", "t"), agent, F.lit("client.images.generate()\nx.save()\n"), F.lit("c.chat.completions.create()\napp.post()\n"), F.col("t"))
    path = pick(c("cfg", "i", "/mcp.json"), c("r", "i", "/requirements.txt"), c("ag", "i", ".py"), c("img", "i", ".py"), c("bot", "i", ".py"), c("n", "i", ".md"))
    d = d.select("repo", "n", "k", path.alias("path"), text.alias("text"), F.when(F.col("k").isin(0, 2, 3, 4), text).alias("code"), F.lit(None).cast("string").alias("error"))
    makers = d.where("k = 3 or k = 4")
    dotted = F.when(F.col("k") == 3, F.array(F.lit("client.images.generate"), F.lit("x.save"))).otherwise(F.array(F.lit("c.chat.completions.create"), F.lit("app.post")))
    modules = F.array(F.when(F.col("n") % 3 == 0, "otro").otherwise("openai"), F.when(F.col("n") % 2 == 0, "fastapi").otherwise("flask"))
    r, p = F.col("l_suppkey") % 20, F.col("l_partkey")
    art = table(spark, sf_dir, "lineitem").where(~r.isin(0, 2)).where((r > 8) | r.isin(5, 6))
    mark = F.when(r == 12, F.when(p % 2 == 1, "no_reconocido").otherwise("sin_marca")).when(r.isin(5, 6, 10), "sin_marca").otherwise("sintetico")
    art = art.select(F.concat(F.lit("src"), r).alias("repo"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("path"), F.when(F.col("l_linenumber") < 7, "png").alias("container"), mark.alias("marca"), F.when(r.isin(5, 6, 10), "present_unverified").alias("c2pa"))
    m = F.min("s_suppkey") % 5
    steps = F.when(m == 0, F.array(F.lit("a_png"), F.lit(controls.ERASES))).when(m == 1, F.array(F.lit("rotar_90"))).when(m == 2, F.array(F.lit("rotar_90"), F.lit("desconocido"))).otherwise(F.array().cast("array<string>"))
    pipes = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("src"), F.col("s_suppkey") % 20).alias("repo")).agg(steps.alias("pasos"))
    files = d.select("repo", "path", "text", "code", "error")
    return analysers.Trees(files, makers.select("repo", "path", F.explode(dotted).alias("dotted")), makers.select("repo", "path", F.explode(modules).alias("module")), art, pipes)


@query(f"SELECT * FROM {_E}")
def engine_evaluations(spark, sf_dir):
    return analysers.run(_trees(spark, sf_dir), RULES)[0].select("repo", "paquete", "regla_id", "aplicable", "hallazgos", "senal", "limite", "fuerza")


_OWN = f"""(SELECT repo, 'agentes' AS paquete, CASE WHEN coalesce(hay, false) OR coalesce(marco, false) THEN 'completada' ELSE 'no_aplicable' END AS ejecucion, CASE WHEN NOT coalesce(hay, false) AND marco THEN 'indeterminada' WHEN hay AND (SELECT sum(hallazgos) FROM {_E} e WHERE e.repo = r.repo AND e.paquete = 'agentes') = 0 THEN 'insuficiente' END AS suficiencia FROM {_REPOS} r LEFT JOIN {_SEEN} USING (repo)
    UNION ALL SELECT repo, 'art50', CASE WHEN gen THEN 'completada' ELSE 'no_aplicable' END, CASE WHEN NOT gen THEN NULL WHEN NOT looked OR (cadena = 'sin_decidir' AND ok > 0) THEN 'indeterminada' WHEN (SELECT sum(hallazgos) FROM {_E} e WHERE e.repo = a.repo AND e.paquete = 'art50') > 0 THEN NULL WHEN doubt > 0 OR ok = 0 THEN 'indeterminada' WHEN txt + bot > 0 THEN 'insuficiente' ELSE 'suficiente' END FROM {_A50} a)"""
_O = f"""(SELECT e.repo, e.paquete, sum(hallazgos)::BIGINT AS hallazgos, count(senal) AS senales, any_value(suficiencia) AS suficiencia, coalesce(any_value(ejecucion), CASE WHEN bool_or(aplicable) THEN 'completada' ELSE 'no_aplicable' END) AS ejecucion FROM {_E} e LEFT JOIN {_OWN} o ON o.repo = e.repo AND o.paquete = e.paquete GROUP BY e.repo, e.paquete)"""
_RESULT = "CASE WHEN ejecucion = 'no_aplicable' THEN 'no_aplica' WHEN hallazgos > 0 THEN 'con_hallazgos' WHEN suficiencia IN ('indeterminada', 'insuficiente') THEN 'indeterminado' ELSE 'sin_hallazgos' END"


@query(f"SELECT *, {_RESULT} AS resultado FROM {_O}")
def engine_outcomes(spark, sf_dir):
    trees = _trees(spark, sf_dir)
    evaluated, own = analysers.run(trees, RULES)
    got = packs.outcomes(evaluated, trees.files.groupBy("repo").agg(F.count("error").alias("ilegibles")), own)
    return got.select("repo", "paquete", "hallazgos", "senales", "suficiencia", "ejecucion", "resultado")


@query(f"""WITH o AS (SELECT *, CASE paquete WHEN 'art15' THEN 'AIA-015' WHEN 'art50' THEN 'AIA-050' ELSE 'AIA-014' END AS obligacion FROM {_O}),
    m AS (SELECT repo, obligacion, sum(hallazgos)::BIGINT AS hallazgos, CASE WHEN bool_and(ejecucion = 'no_aplicable') THEN 'no_aplicable' ELSE 'completada' END AS ejecucion, arg_min(suficiencia, paquete) FILTER (WHERE suficiencia IS NOT NULL) AS suficiencia, (obligacion = 'AIA-015')::INT AS q, sum(senales) AS s FROM o GROUP BY ALL),
    l AS (SELECT *, {_RESULT} AS r FROM m)
    SELECT repo, obligacion, 'ata' AS situacion, CASE r WHEN 'con_hallazgos' THEN r WHEN 'sin_hallazgos' THEN CASE WHEN q = 0 THEN 'comprobada' ELSE 'a_preguntar' END ELSE 'a_preguntar' END AS estado, hallazgos, (q + (r = 'indeterminado')::INT)::BIGINT AS preguntas, CASE WHEN s > 0 THEN 'presencia' END AS fuerza_maxima,
    (SELECT coalesce(list(regla_id ORDER BY regla_id) FILTER (WHERE senal IS NOT NULL), []) FROM {_E} e WHERE e.repo = l.repo AND CASE paquete WHEN 'art15' THEN 'AIA-015' WHEN 'art50' THEN 'AIA-050' ELSE 'AIA-014' END = l.obligacion) AS controles_cubiertos FROM l""")
def plan_of_engines(spark, sf_dir):
    trees = _trees(spark, sf_dir)
    levels = F.array(*[F.struct(F.lit(o).alias("obligacion"), F.lit("maquina").alias("nivel")) for o in ("AIA-014", "AIA-015", "AIA-050")])
    verdicts = trees.files.select("repo").distinct().select("repo", F.inline(levels)).withColumn("situacion", F.lit("ata"))
    return analysers.plan(trees, RULES, verdicts, trees.files.groupBy("repo").agg(F.count("error").alias("ilegibles")))
