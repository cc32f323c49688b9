"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.block_search import block_search
from tidewright.llm.filter_audit import filter_audit, flag_counts
from tidewright.llm.line_dedup import line_dedup
from tidewright.llm.mixing import mix
from tidewright.llm.mpeg_audio import audio_digests, texts_to_audio
from tidewright.llm.ngram_join import ngram_join
from tidewright.llm.piece_bpe import piece_digests
from tidewright.llm.piece_language import fit_on_documents, predict_language
from tidewright.llm.shared import held_out, spread, written
from tidewright.llm.simhash import near_duplicates
from tidewright.llm.source_audit import source_audit
from tidewright.llm.subword_quality import fit_quality, score_texts
from tidewright.llm.toxicity import fit_toxicity, score_toxicity
from tidewright.llm.warc import build_index, look_up, read_ranges, write_archives


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file *name* is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_explicit", "p_coded", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ids and texts (and languages), on all cores."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = write_archives(pages)
    found = read_ranges(spark, folder, look_up(pages, build_index(spark, folder)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_texts(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    scored = score_texts(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, _ = mix(_table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op6_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return block_search(vectors, vectors.filter("vec_id % 100 = 0"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(written(texts_to_audio(_texts(spark, sf_dir).select("doc_id", "text")), "media"))


def op9_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_texts(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op10_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    found = predict_language(docs, fit_on_documents(docs, tokenizer_path("piece_bpe_32k.model")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_texts(spark, sf_dir))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(spread(_table(spark, sf_dir, "documents").select("text", "lang", "source")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = filter_audit(written(flag_counts(_texts(spark, sf_dir), _table(spark, sf_dir, "labels")), "flags"))
    return steps.filter(F.col("part").isNotNull())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_warc_index": op2_warc_index,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_subword_quality": op4_subword_quality,
    "op5_source_mix": op5_source_mix,
    "op6_block_search": op6_block_search,
    "op7_line_dedup": op7_line_dedup,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_piece_encode": op9_piece_encode,
    "op10_piece_language": op10_piece_language,
    "op11_ngram_join": op11_ngram_join,
    "op12_source_audit": op12_source_audit,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op2_warc_index": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d),
c AS (SELECT *, list_transform(string_split(upper(h), ''), lambda x: instr('0123456789ABCDEF', x) - 1) AS n FROM k)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5),
         lambda j: ((n[((5 * i + j) // 4 + 1)::INT] >> (3 - (5 * i + j) % 4)::INT) & 1) << (4 - j)::INT))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM c""",
    "op6_block_search": r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op5_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS r, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, text IS NULL AS n,
         md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w,
             sum(source_size) OVER ()::BIGINT AS total FROM s),
r AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0))::BIGINT / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS level, cap / w AS ratio
      FROM w WINDOW o AS (ORDER BY cap / w, w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM r WHERE level <= ratio ORDER BY ratio, w, source IS NULL, source LIMIT 1),
t AS (SELECT source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS sid, source_size,
             coalesce(least(cap::DOUBLE, (SELECT level FROM l) * w), 0.0) AS target, floor(coalesce(least(cap::DOUBLE, (SELECT level FROM l) * w), 0.0))::BIGINT AS goal FROM r),
p AS (SELECT d.doc_id, d.r, d.size, t.sid, t.source_size, t.target, t.goal,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.n, d.r ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
a AS (SELECT sid, source_size, ceil(source_size / 4096)::BIGINT AS nb, goal // source_size AS passes, goal % source_size AS rest,
             (goal // source_size) * ceil(source_size / 4096)::BIGINT + ceil((goal % source_size) / 4096)::BIGINT AS need
      FROM t WHERE source_size > 0 AND goal > 0),
e AS (SELECT *, (sum(need) OVER o - need)::BIGINT / (sum(need) OVER ())::BIGINT AS f, (sum(need) OVER o)::BIGINT / (sum(need) OVER ())::BIGINT AS g
      FROM a WINDOW o AS (ORDER BY sid ROWS UNBOUNDED PRECEDING)),
u AS (SELECT n AS slot, ((n + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM range((SELECT coalesce(sum(need), 0)::BIGINT FROM a)) x(n)),
k AS (SELECT u.slot, e.sid, row_number() OVER (PARTITION BY e.sid ORDER BY u.slot) - 1 AS k FROM u JOIN e ON e.f <= u.u AND u.u < e.g),
m AS (SELECT a.sid, a.need, coalesce(max(k.k) + 1, 0) AS got FROM a LEFT JOIN k ON a.sid = k.sid GROUP BY a.sid, a.need),
o AS (SELECT *, coalesce(sum(need - got) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS late FROM m WHERE got < need),
z AS (SELECT slot, sid, k FROM k UNION ALL
      SELECT x.k - o.got + o.late + (SELECT count(*) FROM u), o.sid, x.k FROM o, LATERAL (SELECT unnest(range(o.got, o.need)) AS k) x),
b AS (SELECT z.sid, z.k % a.nb AS b, (z.k % a.nb) * 4096 AS lo,
             least((z.k % a.nb + 1) * 4096, CASE WHEN z.k >= a.passes * a.nb THEN a.rest ELSE a.source_size END) AS hi, min(z.slot) AS slot
      FROM z JOIN a ON z.sid = a.sid WHERE z.k < a.need GROUP BY ALL),
q AS (SELECT sid, r, start, size, unnest(range(start // 4096, (start + size - 1) // 4096 + 1)) AS b FROM p WHERE size > 0),
f AS (SELECT q.r, min(b.slot)::BIGINT AS first_slot FROM q JOIN b ON q.sid = b.sid AND q.b = b.b
      WHERE least(q.start + q.size, b.hi) > greatest(q.start, b.lo) GROUP BY q.r)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (goal // source_size) + greatest(0, least(start + size, goal % source_size) - start) END::BIGINT AS taken,
       first_slot
FROM p LEFT JOIN f ON p.r = f.r""",
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, r, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
    "op12_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
e AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 30),
vs AS (SELECT lang, count(*)::HUGEINT AS v FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT e.lang, e.source, e.term, count(*)::HUGEINT AS n FROM e JOIN v ON e.lang = v.lang AND e.term = v.term GROUP BY ALL),
grid AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n
         FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT grid.lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY grid.lang, source) + 5 * vs.v) AS p
      FROM grid JOIN vs ON grid.lang = vs.lang),
ls AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM grid GROUP BY ALL),
lp AS (SELECT ls.lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY ls.lang) + 5 * vs.v) AS q FROM ls JOIN vs ON ls.lang = vs.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
         GROUP BY ALL),
term AS (SELECT p.lang, p.source, p.term AS item, (p.p - lp.q)::BIGINT AS value FROM p JOIN lp ON p.lang = lp.lang AND p.term = lp.term WHERE p.n > 0 AND p.p > lp.q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT row_number() OVER () AS r, d.doc_id, part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
             {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails.A AS a, fails.B AS b, fails.C AS c, fails.D AS d, fails.E AS e, count(*) AS n,
             count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (SELECT g.part, s.filter_order, s.step, substr(filter_order, s.step::INT, 1) AS x, g.n, g.good, g.toxic,
             list_filter([CASE WHEN a THEN instr(filter_order, 'A') END, CASE WHEN b THEN instr(filter_order, 'B') END, CASE WHEN c THEN instr(filter_order, 'C') END,
                          CASE WHEN d THEN instr(filter_order, 'D') END, CASE WHEN e THEN instr(filter_order, 'E') END], lambda y: y IS NOT NULL) AS hits
      FROM g, s),
t AS (SELECT part, filter_order, step, x, n, good, toxic, list_min(hits) AS hit, list_contains(hits, step) AS failed, len(hits) AS k FROM m),
r AS (SELECT part, filter_order, step, x,
             coalesce(sum(n) FILTER (hit IS NULL OR hit > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit = step), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (failed AND hit < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed AND k = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (hit = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit = step), 0)::BIGINT AS toxic_lost
      FROM t GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r""",
}
