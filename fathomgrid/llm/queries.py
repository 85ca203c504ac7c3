"""The subpackage's queries under the contract's names, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, contamination, divergence, html, jaccard, language, lines, neighbours, packing, sharding, substrings, tokens, warc
from .common import materialize, planned_bytes, small_files, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train(docs))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    files = small_files(planned_bytes(docs) // 8)
    out = packing.pack(materialize(packing.pieces(docs, tokenizer_path()), files, True))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contamination.judged().alias("contaminated"),
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ALL = (
    op1_line_dedup,
    op2_language_id,
    op3_substring_dedup,
    op4_best_fit_packing,
    op5_decontamination,
    op6_html_extraction,
    op7_nearest_neighbours,
    op8_warc,
    op9_token_counts,
    op10_jaccard_join,
    op11_source_divergence,
    op12_vector_codes,
    op13_sharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
     found AS (SELECT source, unnest(list_distinct(lines)) AS line FROM pages),
     counts AS (SELECT source, line, count(*) AS n FROM found WHERE trim(line) <> '' GROUP BY source, line),
     totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
     boiler AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 2 AND n > 0.1 * pages),
     each AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS at FROM pages),
     kept AS (SELECT e.doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
                     coalesce(string_agg(e.line, chr(10) ORDER BY e.at) FILTER (b.line IS NULL), '') AS kept
              FROM each e LEFT JOIN boiler b ON e.line = b.line AND e.source IS NOT DISTINCT FROM b.source GROUP BY e.doc_id)
SELECT p.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN p.text IS NOT NULL THEN sha256(k.kept) END AS kept_sha256
FROM pages p LEFT JOIN kept k USING (doc_id)
"""

OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
     k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM g),
     least AS (SELECT gram, min(doc_id) AS d FROM k GROUP BY gram),
     hit AS (SELECT DISTINCT k.doc_id, unnest(range(i, i + 13)) AS at FROM k JOIN least USING (gram) WHERE least.d < k.doc_id),
     each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM w),
     kept AS (SELECT e.doc_id, count(h.at) AS n, coalesce(string_agg(e.word, ' ' ORDER BY e.at) FILTER (h.at IS NULL), '') AS kept
              FROM each e LEFT JOIN hit h ON e.doc_id = h.doc_id AND e.at = h.at GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
     b AS (SELECT DISTINCT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
     sized AS (SELECT item_id, ws, least(len(ws), 13) AS m FROM b WHERE len(ws) > 0),
     bi AS (SELECT item_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM sized),
     bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS gram FROM bi),
     di AS (SELECT doc_id, s.m, ws, unnest(range(1, len(ws) - s.m + 2)) AS i FROM d, (SELECT DISTINCT m FROM sized) s WHERE len(ws) >= s.m),
     hits AS (SELECT di.doc_id, di.i, di.m, item_id FROM di JOIN bw ON di.m = bw.m AND array_to_string(di.ws[di.i:di.i + di.m - 1], ' ') = bw.gram),
     words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html),
     s AS (SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS hex, top FROM p JOIN g ON p.html = g.html),
     v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT) AS fives FROM s)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + j // 4] >> (15 - 5 * (j % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM v
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
     g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0),
     s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram FROM g),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = w.doc_id
"""

OP11 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
     t AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
     total AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
     grp AS (SELECT DISTINCT lang, source FROM d),
     held AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term),
     sums AS (SELECT lang, source, sum(n)::BIGINT AS n FROM held GROUP BY lang, source),
     p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
                  1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * total.v) AS p,
                  1 + (1000000000::HUGEINT * (k.n + 5)) // (total.n + 5 * total.v) AS q
           FROM grp g JOIN kept k USING (lang) JOIN total USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
           LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
     apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
     pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
              FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
     term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
     every AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM every WHERE part = 'pair' OR rank <= 50
"""

_ROUND = """
     near{i} AS (SELECT v.vec_id, v.part, arg_min(b.entry, (list_sum(list_transform(range(1, {w} + 1), lambda j: (v.x[j] - b.x[j]) * (v.x[j] - b.x[j]))), b.entry)) AS entry,
                        min(list_sum(list_transform(range(1, {w} + 1), lambda j: (v.x[j] - b.x[j]) * (v.x[j] - b.x[j]))))::BIGINT AS far
                 FROM parts v JOIN book{i} b ON v.part = b.part GROUP BY v.vec_id, v.part),"""
_MOVED = """
     sum{i} AS (SELECT v.part, n.entry, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS place FROM parts v JOIN near{i} n USING (vec_id, part)),
     mean{i} AS (SELECT part, entry, list(m ORDER BY place) AS x FROM
                 (SELECT part, entry, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM sum{i} GROUP BY part, entry, place) GROUP BY part, entry),
     book{j} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m USING (part, entry)),"""

OP12 = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     parts AS (SELECT vec_id, p AS part, v[1 + p * (len(v) // 16):(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
     first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
     book0 AS (SELECT part, entry, x FROM parts JOIN first USING (vec_id)),{rounds}
     whole AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near2 GROUP BY vec_id),
     digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS sha FROM
                (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS place FROM book2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM whole JOIN kept USING (vec_id), digest
""".replace("{rounds}", "".join((_ROUND + (_MOVED if i < 2 else "")).format(i=i, j=i + 1, w="len(v.x)") for i in range(3)))


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op3_substring_dedup": OP3, "op5_decontamination": OP5, "op8_warc": OP8, "op10_jaccard_join": OP10, "op11_source_divergence": OP11, "op12_vector_codes": OP12}
