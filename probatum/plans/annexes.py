"""Registered queries on Annex IV: every source of documents stands for a repository, every document for one of its files.

Paths, manifests and calls are made from ids, as the tables hold no code; a file's text is the whole text of its document, after what
its kind of file begins with. Every eleventh file can't be read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probatum.operators import annex
from probatum.plans.queries import query, table

#: By doc_id % 12: path (with {i} for the id) and what the text begins with.
KINDS = (
    ("d{i}/requirements.txt", ""), ("lib{i}/pyproject.toml", 'dependencies = ["a{j}==1", "b"]\n'), ("deploy/{i}.yml", "memory: {j}Gi\ncpus: {j}\n"), ("app/{i}/main.py", ""), ("src{j}/m{i}.py", "vault "), ("docs/manual{i}.md", ""),
    ("data/dataset_{i}.csv", ""), ("CHANGELOG{i}.md", "# [1.{j}.0]\n## v0.{j}.2\n"), (".github/workflows/gpu{i}.yml", "gpu: {j}\n"), ("infra/{i}.tf", "machine_type = m{j}\n"), ("tool{i}.py", "rate_limit "), ("notes/{i}.rst", ""),
)
#: The first documents are a repository's manifest.
ROOT_PATH, ROOT_TEXT = "pyproject.toml", 'name = "n{i}"\nversion = "{j}.1"\ndependencies = ["c{j}~=2"]\n'


def _sql(template: str) -> str:
    parts = template.replace("'", "''").replace("{i}", "' || i || '").replace("{j}", "' || j || '").replace("\n", "' || chr(10) || '")
    return f"'{parts}'"


def _col(template: str):
    parts = template.replace("{i}", "\0i\0").replace("{j}", "\0j\0").split("\0")
    return F.concat(*[F.col(p) if p in ("i", "j") else F.lit(p) for p in parts])


_CASE = lambda at: "CASE WHEN i < 24 THEN " + _sql((ROOT_PATH, ROOT_TEXT)[at]) + " " + " ".join(f"WHEN i % 12 = {k} THEN {_sql(x[at])}" for k, x in enumerate(KINDS)) + " END"
_T = f"""(SELECT *, CASE WHEN text IS NOT NULL AND regexp_matches(path, '\\.(py|yml|toml)$') THEN text END AS code FROM (SELECT source AS repo, i, {_CASE(0)} AS path, CASE WHEN i % 11 <> 0 THEN {_CASE(1)} || replace(t, ' a', '==1' || chr(10)) END AS text
    FROM (SELECT source, doc_id AS i, doc_id % 7 AS j, coalesce(text, '') AS t FROM documents)))"""
_CALLS = f"(SELECT repo, path, unnest(CASE WHEN i % 5 = 0 THEN ['hub.from_pretrained', 'run.fit'] ELSE ['run.fit'] END) AS dotted FROM {_T} WHERE path LIKE '%.py' AND text IS NOT NULL)"


def _tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("i"), (F.col("doc_id") % 7).alias("j"), F.coalesce("text", F.lit("")).alias("t"))

    def case(at):
        out = F.when(F.col("i") < 24, _col((ROOT_PATH, ROOT_TEXT)[at]))
        for k, x in enumerate(KINDS):
            out = out.when(F.col("i") % 12 == k, _col(x[at]))
        return out

    ok = F.col("i") % 11 != 0
    files = d.select("repo", "i", case(0).alias("path"), F.when(ok, F.concat(case(1), F.replace("t", F.lit(" a"), F.lit("==1\n")))).alias("text"), F.when(~ok, "no es UTF-8").alias("error"))
    files = files.withColumn("code", F.when(F.col("path").rlike(r"\.(py|yml|toml)$"), F.col("text")))
    calls = files.where(F.col("path").endswith(".py") & F.col("text").isNotNull())
    calls = calls.select("repo", "path", F.explode(F.when(F.col("i") % 5 == 0, F.array(F.lit("hub.from_pretrained"), F.lit("run.fit"))).otherwise(F.array(F.lit("run.fit")))).alias("dotted"))
    return files.drop("i"), calls


_FIRST = "list_sort(list(DISTINCT {x}))"
_DEPS = f"""(SELECT repo, path, unnest(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '#')), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS dep FROM {_T} WHERE path LIKE '%/requirements.txt' AND text IS NOT NULL
    UNION ALL SELECT repo, path, unnest(regexp_extract_all(regexp_extract(text, '(?s)dependencies\\s*=\\s*\\[(.*?)\\]', 1), '["'']([^"'']+)["'']', 1)) FROM {_T} WHERE (path = 'pyproject.toml' OR path LIKE '%/pyproject.toml') AND text IS NOT NULL)"""
_HINTS = f"(SELECT repo, path, unnest(regexp_extract_all(text, '(?i)\\b(gpu|cuda|nvidia|memory|cpus?|instance_type|machine_type|node_type)\\b[^\\n]{{0,60}}', 1)[:6]) AS hint FROM {_T} WHERE text IS NOT NULL AND (path LIKE 'deploy/%' OR path LIKE 'infra/%'))"
_PY = f"(SELECT repo, path FROM {_T} WHERE path LIKE '%.py' AND text IS NOT NULL)"
_SEEN = "(" + " UNION ALL ".join(f"SELECT repo, path, {k} AS o, '{label}' AS label FROM {_T} WHERE code IS NOT NULL AND regexp_matches(code, '{p}')" for k, (label, p) in enumerate(annex.MEASURES, 1)) + ")"
_MANIFEST = f"(SELECT repo, path, regexp_extract(text, '(?m)^\\s*version\\s*[=:]\\s*[\"'']([^\"'']+)[\"'']', 1) AS version, regexp_extract(text, '(?m)^\\s*name\\s*[=:]\\s*[\"'']([^\"'']+)[\"'']', 1) AS nombre FROM {_T} WHERE path = 'pyproject.toml' AND text IS NOT NULL)"
_LOG = f"(SELECT repo, path, coalesce(text, '') AS text FROM {_T} WHERE path LIKE 'CHANGELOG%')"
_PATHS = lambda name, key, like: f"SELECT repo, '{name}' AS extractor, to_json({{{key}: list_sort(list(DISTINCT path))}})::VARCHAR AS contenido, list_sort(list(DISTINCT path)) AS fuentes FROM {_T} WHERE path LIKE '{like}' GROUP BY repo"
_X = f"""(SELECT r.repo, e.extractor, contenido, coalesce(fuentes, []) AS fuentes, CASE WHEN contenido IS NULL THEN e.falta END AS motivo FROM (SELECT DISTINCT repo FROM {_T}) r CROSS JOIN (VALUES {', '.join(f"('{e.name}', '{e.reason}')" for e in annex.EXTRACTORS)}) e(extractor, falta) LEFT JOIN (
    SELECT repo, 'version_y_proveedor' AS extractor, to_json({{version: max(version), nombre: max(nombre)}})::VARCHAR AS contenido, list_sort(list(DISTINCT path)) AS fuentes FROM {_MANIFEST} GROUP BY repo
    UNION ALL SELECT repo, 'dependencias', to_json({{total: count(*), fijadas: count(*) FILTER (WHERE regexp_matches(dep, '[=~]=|@sha256:')), lista: list_sort(list(DISTINCT dep))[:60]}})::VARCHAR,
        (SELECT list_sort(list(DISTINCT path)) FROM {_T} t WHERE t.repo = d.repo AND text IS NOT NULL AND regexp_matches(path, '(^|/)(requirements\\.txt|pyproject\\.toml)$')) FROM {_DEPS} d GROUP BY repo
    UNION ALL SELECT repo, 'computo', to_json({{pistas: list_sort(list(DISTINCT hint))[:20]}})::VARCHAR, list_sort(list(DISTINCT path)) FROM {_HINTS} GROUP BY repo
    UNION ALL SELECT repo, 'terceros', to_json({{sitios: list_sort(list(DISTINCT path || ' (' || dotted || ')'))}})::VARCHAR, list_sort(list(DISTINCT path)) FROM {_CALLS} WHERE dotted LIKE '%from_pretrained' GROUP BY repo
    UNION ALL SELECT repo, 'arquitectura', to_json({{modulos: sum(n)::BIGINT, paquetes: map_from_entries(list((k, n) ORDER BY k)), puntos_de_entrada: coalesce(any_value(puntos), ['(ninguno reconocido por nombre)'])}})::VARCHAR, any_value(f)
        FROM (SELECT repo, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(raiz)' END AS k, count(*) AS n FROM {_PY} GROUP BY ALL) JOIN (SELECT repo, list_sort(list(DISTINCT path) FILTER (WHERE path LIKE '%/main.py')) AS puntos, list_sort(list(DISTINCT path))[:40] AS f FROM {_PY} GROUP BY repo) USING (repo) GROUP BY repo
    UNION ALL {_PATHS('datos', 'fichas', '%dataset%')} UNION ALL {_PATHS('instrucciones', 'documentos', '%manual%.md')}
    UNION ALL SELECT repo, 'ciberseguridad', to_json({{patrones: list({{patron_observado: label, fichero: path}} ORDER BY path, o)[:20], total_observados: count(*)}})::VARCHAR, list_sort(list(DISTINCT path))[:20] FROM {_SEEN} GROUP BY repo
    UNION ALL SELECT repo, 'cambios', to_json({{fichero: min(path), versiones: regexp_extract_all(arg_min(text, path), '(?m)^#{{1,3}}\\s*\\[?v?(\\d+\\.\\d+\\.\\d+)', 1)[:20]}})::VARCHAR, list_sort(list(DISTINCT path)) FROM {_LOG} GROUP BY repo
    ) x ON x.repo = r.repo AND x.extractor = e.extractor)"""


@query(f"SELECT * FROM {_X}")
def annex_extractors(spark, sf_dir):
    return annex.extracted(*_tree(spark, sf_dir))


_LINES = "(SELECT 'src' || (s_suppkey % 20) AS repo, 'AIA-' || lpad((s_suppkey % 16)::VARCHAR, 3, '0') AS obligacion, 'con_hallazgos' AS estado, max(s_suppkey % 9)::BIGINT AS hallazgos, min(s_suppkey % 3)::BIGINT AS preguntas FROM supplier GROUP BY ALL)"
_SUPPLIED = "(SELECT 'src' || (c_custkey % 20) AS repo, 'AIV-' || (c_custkey % 9 + 1) AS seccion, max(c_name) AS texto, max('p' || (c_custkey % 5)) AS firmado_por, max('2026-01-0' || (c_custkey % 9 + 1)) AS fecha FROM customer GROUP BY ALL)"
_SPEC = "(VALUES " + ", ".join(f"({i}, '{s}', '{p}', {repr(e) if e else 'NULL'}, {repr(ob) if ob else 'NULL'})" for i, (s, p, _, e, ob) in enumerate(annex.SECTIONS)) + ") s(orden, seccion, punto, extractor, obligacion)"
_S = f"""(SELECT r.repo, s.orden, s.seccion, s.punto, CASE WHEN coalesce(x.contenido, c) IS NOT NULL THEN CASE WHEN texto IS NOT NULL THEN 'derivada+aportada' ELSE 'derivada' END WHEN texto IS NOT NULL THEN 'aportada' ELSE 'ausente' END AS procedencia, coalesce(x.contenido, c) AS contenido,
    coalesce(x.fuentes, CASE WHEN c IS NOT NULL THEN ['control de ' || s.obligacion] END, []) AS fuentes, CASE WHEN coalesce(x.contenido, c, texto) IS NULL THEN coalesce(x.motivo, CASE WHEN s.extractor = 'control' THEN 'no hay línea del plan de ' || s.obligacion END, 'nadie la ha aportado') END AS motivo, texto, firmado_por, fecha
    FROM (SELECT DISTINCT source AS repo FROM documents) r CROSS JOIN {_SPEC} LEFT JOIN {_X} x ON x.repo = r.repo AND x.extractor = s.extractor
    LEFT JOIN (SELECT repo, obligacion, to_json({{estado: estado, hallazgos: hallazgos, preguntas_abiertas: preguntas}})::VARCHAR AS c FROM {_LINES}) l ON l.repo = r.repo AND l.obligacion = s.obligacion LEFT JOIN {_SUPPLIED} a ON a.repo = r.repo AND a.seccion = s.seccion)"""


def _sections(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    lines = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("src"), s % 20).alias("repo"), F.concat(F.lit("AIA-"), F.lpad((s % 16).cast("string"), 3, "0")).alias("obligacion")).agg(F.lit("con_hallazgos").alias("estado"), F.max(s % 9).alias("hallazgos"), F.min(s % 3).alias("preguntas"))
    supplied = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("src"), c % 20).alias("repo"), F.concat(F.lit("AIV-"), c % 9 + 1).alias("seccion"))
    supplied = supplied.agg(F.max("c_name").alias("texto"), F.max(F.concat(F.lit("p"), c % 5)).alias("firmado_por"), F.max(F.concat(F.lit("2026-01-0"), c % 9 + 1)).alias("fecha"))
    return annex.sections(annex.extracted(*_tree(spark, sf_dir)), lines, supplied)


@query(f"SELECT * FROM {_S}")
def annex_derived_sections(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(f"""SELECT repo, to_json({{esquema: 'anexo-iv/v1', repo: repo, recuento: {{derivada: count(*) FILTER (WHERE procedencia = 'derivada'), aportada: count(*) FILTER (WHERE procedencia = 'aportada'), "derivada+aportada": count(*) FILTER (WHERE procedencia = 'derivada+aportada'), ausente: count(*) FILTER (WHERE procedencia = 'ausente')}},
    total_secciones: count(*), secciones: list({{seccion: seccion, punto: punto, procedencia: procedencia, de_donde: fuentes, motivo: motivo, texto: texto, firmado_por: firmado_por, fecha: fecha, contenido: contenido}} ORDER BY orden)}})::VARCHAR AS documento FROM {_S} GROUP BY repo""")
def annex_document(spark, sf_dir):
    return annex.document(_sections(spark, sf_dir))


_LABEL = "CASE procedencia " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in annex.LABELS.items()) + " END"


@query(f"""SELECT repo, string_agg(concat_ws(chr(10), '## ' || punto || '. ' || seccion, '*' || {_LABEL} || '*', CASE WHEN len(fuentes) > 0 THEN 'Fuentes: ' || array_to_string(list_transform(fuentes[:8], lambda x: '`' || x || '`'), ', ') END,
    '```json' || chr(10) || substring(contenido, 1, 1200) || chr(10) || '```', CASE WHEN length(contenido) > 1200 THEN '> Cortado: faltan ' || (length(contenido) - 1200) || ' caracteres; el JSON los tiene.' END,
    '> ' || texto || chr(10) || '> Firmado por ' || firmado_por || ' el ' || fecha || '.', '**Falta**: ' || motivo), chr(10) || chr(10) ORDER BY orden) AS documento FROM {_S} GROUP BY repo""")
def annex_markdown(spark, sf_dir):
    return annex.markdown(_sections(spark, sf_dir))
