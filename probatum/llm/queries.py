"""One query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_rules, budget_mix, dense_search, kneser_ney, packing, pii_semicrf, prefix_tree_join, projection_search, spelling, token_attribution, warc, weak_labels, winnowing
from .common import read


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.sections(read(spark, sf_dir, "documents"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, sf_dir, "pages")))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(read(spark, sf_dir, "documents"), 3)


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(read(spark, sf_dir, "documents"))


def op6_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_search.nearest(read(spark, sf_dir, "embeddings"), 20, 20).drop("verified")


def op7_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree_join.similarity_groups(read(spark, sf_dir, "documents"), 3, 90, 100)


def op8_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_semicrf.find(read(spark, sf_dir, "documents"))


def op10_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = adaptive_rules.judge(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = winnowing.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), winnowing.digest_of(F.col("items")).alias("items_sha256"), "contaminated")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which belongs to this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_attribution, op2_length_buckets, op3_warc_derivatives, op4_kneser_ney, op5_weak_labels, op6_projection_search, op7_prefix_tree_join, op8_budget_mix, op9_pii_semicrf, op10_adaptive_rules, op11_winnowing, op12_spelling_variants, op13_dense_search, pipeline)}

_SPACES = r"[\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op6_projection_search": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_prefix_tree_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM s),
        t AS (SELECT doc_id, unnest(sh) AS g FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
        SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id,
               (SELECT count(*) FROM l WHERE l.a = n.doc_id)::BIGINT AS n_links
        FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op10_adaptive_rules": rf"""
        WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACES}'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS ls FROM d),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
        m AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
                     length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
                     length(t) - length(translate(t, '!', '')) AS n_bangs, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.c, 0) AS n_repeat_words,
                     len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same_words
              FROM w LEFT JOIN cov USING (doc_id)),
        r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
        u AS (SELECT lang, source, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest([n_symbols * 1000 // greatest(word_chars, 1), n_upper * 1000 // greatest(word_chars, 1), n_bangs * 1000 // greatest(n_words, 1),
                     n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // greatest(n_words, 1), n_same_words * 1000 // greatest(n_words, 1)])::BIGINT AS v, unnest([word_chars, word_chars, n_words, n_lines, n_words, n_words])::BIGINT AS z FROM r WHERE NOT base_failed),
        f AS (SELECT lang, source, k, CASE WHEN v < 32 THEN v ELSE (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) END AS v,
                     CASE WHEN z < 32 THEN z ELSE (z >> greatest(length(bin(z)) - 6, 0)) << greatest(length(bin(z)) - 6, 0) END AS z FROM u),
        h AS (SELECT 0 AS level, lang, source, k, list(v ORDER BY v) AS vs, list(z ORDER BY z) AS zs FROM f GROUP BY ALL UNION ALL
              SELECT 1, lang, NULL, k, list(v ORDER BY v), list(z ORDER BY z) FROM f GROUP BY ALL UNION ALL
              SELECT 2, NULL, NULL, k, list(v ORDER BY v), list(z ORDER BY z) FROM f GROUP BY ALL),
        c AS (SELECT level, lang, source, k, len(vs) AS n, greatest(zs[(len(zs) + 1) // 2], 1) AS size, CASE WHEN k = 5 THEN 64 ELSE 4 END * 1000 AS spare, list_transform(range(25, 100), lambda p: vs[(p * len(vs) + 99) // 100]) AS qs FROM h),
        o AS (SELECT *, list_min(list_filter(range(1, 76), lambda i: i = 75 OR 2 * size * qs[i + 1] > 3 * size * qs[i] + 2 * spare)) AS i FROM c),
        e AS (SELECT level, lang, source, k, n, CASE WHEN i < 75 THEN 3 * qs[i] + qs[i + 1] WHEN qs[75] > 0 THEN 6 * qs[75] END AS stop FROM o),
        p AS (SELECT a.lang, a.source, a.k, coalesce(CASE WHEN a.n >= 50 THEN a.stop END, CASE WHEN b.n >= 50 THEN b.stop END, c.stop) AS l
              FROM e a JOIN e b ON a.level = 0 AND b.level = 1 AND a.k = b.k AND a.lang IS NOT DISTINCT FROM b.lang JOIN e c ON c.level = 2 AND c.k = a.k),
        j AS (SELECT *, row_number() OVER () AS row_id FROM r),
        x AS (SELECT row_id, lang, source, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest([n_symbols, n_upper, n_bangs, n_dup_lines, n_repeat_words, n_same_words]) AS c, unnest([word_chars, word_chars, n_words, n_lines, n_words, n_words]) AS z FROM j),
        bad AS (SELECT DISTINCT row_id FROM x JOIN p ON x.k = p.k AND x.lang IS NOT DISTINCT FROM p.lang AND x.source IS NOT DISTINCT FROM p.source
                WHERE c - l * z / 4000.0::DOUBLE > 3 * sqrt(CASE WHEN x.k = 5 THEN 16 ELSE 1 END * (l * z / 4000.0::DOUBLE)))
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND bad.row_id IS NULL AS kept
        FROM j LEFT JOIN bad USING (row_id)""",
    "op11_winnowing": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS width, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda k: array_to_string(ws[k:k + 9], ' '))) AS win FROM i WHERE len(ws) > 0),
        wd AS (SELECT DISTINCT width FROM iw),
        dw AS (SELECT r, width, unnest(range(1, len(ws) - width + 2)) AS k, unnest(list_transform(range(1, len(ws) - width + 2), lambda k: array_to_string(ws[k:k + width - 1], ' '))) AS win FROM d, wd WHERE len(ws) >= width),
        hits AS (SELECT r, k, width, item_id FROM dw JOIN iw USING (width, win)),
        cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + width)) AS p FROM hits) GROUP BY r),
        its AS (SELECT r, list(DISTINCT item_id::VARCHAR) AS ids FROM hits GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
               sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE bits AS (SELECT range AS k, range AS c, 0 AS b FROM range(256) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b + 1 FROM bits WHERE b < 8),
        tab AS (SELECT list(c::BIGINT ORDER BY k) AS t FROM bits WHERE b = 8),
        run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        hx AS (SELECT w, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run WHERE length(w) >= 6),
        bs AS (SELECT w, list_transform(range(1, length(x), 2), lambda i: ((strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT) AS b FROM hx),
        h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM bs, tab),
        v AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word FROM h),
        words AS MATERIALIZED (SELECT word, count(*) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
        del AS MATERIALIZED (SELECT word, n, k, substring(word, 1, k) || substring(word, k + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM words)),
        near AS (SELECT a.word, a.n, b.word AS o, b.n AS m FROM del a JOIN del b ON a.d = b.d AND a.k = b.k AND a.word <> b.word
                 UNION SELECT a.word, a.n, b.word, b.n FROM del a JOIN words b ON a.d = b.word UNION SELECT b.word, b.n, a.word, a.n FROM del a JOIN words b ON a.d = b.word),
        best AS (SELECT word, n, count(*) AS n_near, first(o ORDER BY m DESC, o) AS o, max(m) AS m FROM near GROUP BY word, n),
        f AS (SELECT word, o AS form, m AS form_n FROM best WHERE m >= 5 * n),
        walk AS (SELECT word, form AS up, 1 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN f ON f.word = w.up)
        SELECT words.word, form, coalesce((SELECT first(up ORDER BY step DESC) FROM walk WHERE walk.word = words.word), words.word) AS root, words.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
        FROM words LEFT JOIN best USING (word) LEFT JOIN f USING (word)""",
    "op13_dense_search": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        s AS (SELECT count(*) FILTER (len(ws) > 0) AS docs, coalesce(sum(len(ws)), 0)::BIGINT AS terms FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT r, doc_id, term, len(ws) AS n, count(*) AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, doc_id, term, len(ws)),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
        m AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS x FROM p, s),
        t AS (SELECT item_id, r, doc_id, sum(w * x)::BIGINT AS score FROM q JOIN m USING (term) JOIN w USING (term) GROUP BY item_id, r, doc_id)
        SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM t WHERE score > 0) WHERE rank <= 10""",
}
