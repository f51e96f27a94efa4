"""One query for each numbered operator: its whole table, production parameters, the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_dedup, lm_scoring, media, merkle, mixing, ngram_join, quality, resampling, secret_scan, substring_dedup, suffix_dedup, toxicity
from .common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("restored")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.read_back(media.store(table(spark, sf_dir, "documents"))))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digest(byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("text_key")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_embedding_dedup, op3_toxicity, op4_media_columns, op5_quality_classifier, op6_source_mixing, op7_byte_bpe, op8_substring_dedup, op9_ngram_jaccard_join, op10_suffix_array_dedup, op11_importance_resampling, op12_secret_scan, op13_merkle_manifest)}

# SQL of those operators that it can express; ids are taken to be unique, as they are in the tables.

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _reached(links: str) -> str:
    """CTEs after `links` (a, b; both ways): `least`, the smallest id reachable from each a."""
    return f"""reach AS (SELECT a, a b FROM ({links}) l UNION SELECT r.a, l.b FROM reach r JOIN ({links}) l ON r.b = l.a), least AS (SELECT a, min(b) least FROM reach GROUP BY a)"""


#: The 256 values of CRC-32's table, as list `crcs` of one row.
_CRC_TABLE = """steps AS (SELECT b, 0 k, CAST(b AS UBIGINT) c FROM range(256) t(b) UNION ALL SELECT b, k+1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM steps WHERE k < 8),
        crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) crcs FROM steps WHERE k = 8)"""


def _crc(text: str) -> str:
    """CRC-32 of a text, a byte at a time; needs `crc_table` in FROM."""
    values = f"list_transform(range(1, octet_length(encode({text}))+1), lambda i: CAST('0x' || hex(encode({text})[i:i]) AS UBIGINT))"
    start = f"list_prepend(CAST(4294967295 AS UBIGINT), {values})"
    return f"xor(list_reduce({start}, lambda c, x: xor(c >> 8, crcs[CAST(xor(c & 255, x) AS BIGINT)+1])), CAST(4294967295 AS UBIGINT))"


def _told(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || ({value}) END"


ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": f"""
        WITH RECURSIVE sound AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings
          WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT x.vec_id a, y.vec_id b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
        {_reached("SELECT a, b FROM links")}
        SELECT vec_id, coalesce(n, 0) n_links, coalesce(least, vec_id) component_id, coalesce(least, vec_id) = vec_id kept
        FROM embeddings e LEFT JOIN (SELECT a, count(*) n FROM links GROUP BY a) c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.a""",
    "op8_substring_dedup": f"""
        WITH texts AS (SELECT doc_id, {_WORDS} w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w)-48)) i FROM texts) a),
        first AS (SELECT k, min(doc_id) d FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i+50)) p FROM windows JOIN first USING (k) WHERE doc_id > d),
        lists AS (SELECT doc_id, list(p) ps FROM gone GROUP BY doc_id),
        words AS (SELECT t.doc_id, p, w[p] x FROM (SELECT doc_id, w, unnest(range(1, len(w)+1)) p FROM texts) t),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) s FROM words LEFT JOIN (SELECT doc_id d, p q FROM gone) g ON doc_id = d AND p = q WHERE q IS NULL GROUP BY doc_id)
        SELECT t.doc_id, len(w) n_words, coalesce(len(ps), 0) n_removed, sha256(coalesce(s, '')) kept_sha256 FROM texts t LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_ngram_jaccard_join": f"""
        WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS} w FROM documents),
        sets AS MATERIALIZED (
          SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w)-3)) i FROM texts) a
          UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) n FROM sets GROUP BY doc_id),
        common AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        half AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 5*c >= 4*(x.n+y.n-c)),
        links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
        {_reached("SELECT a, b FROM links")}
        SELECT d.doc_id, coalesce(n, 0) n_links, coalesce(least, d.doc_id) component_id, coalesce(least, d.doc_id) = d.doc_id kept
        FROM documents d LEFT JOIN (SELECT a, count(*) n FROM links GROUP BY a) c ON d.doc_id = c.a LEFT JOIN least l ON d.doc_id = l.a""",
    "op10_suffix_array_dedup": """
        WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) t FROM documents),
        windows AS (SELECT doc_id, i, t[i:i+99] k FROM (SELECT doc_id, t, unnest(range(1, octet_length(t)-98)) i FROM texts) a),
        first AS (SELECT k, min({'d': doc_id, 'i': i}) f FROM windows GROUP BY k HAVING count(*) > 1),
        late AS (SELECT doc_id, i, i+100 e FROM windows JOIN first USING (k) WHERE {'d': doc_id, 'i': i} > f),
        runs AS (SELECT doc_id, i, e, CASE WHEN i <= max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END fresh FROM late),
        spans AS (SELECT doc_id, r, min(i) b, max(e) e FROM (SELECT doc_id, i, e, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) r FROM runs) a GROUP BY 1, 2),
        gaps AS (SELECT doc_id, coalesce(lag(e) OVER w, 1) b, b e FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY b) UNION ALL SELECT s.doc_id, max(s.e), any_value(octet_length(t))+1 FROM spans s JOIN texts x ON s.doc_id = x.doc_id GROUP BY s.doc_id),
        kept AS (SELECT g.doc_id, unhex(string_agg(hex(t[b:e-1]), '' ORDER BY b)) s FROM gaps g JOIN texts x ON g.doc_id = x.doc_id WHERE e > b GROUP BY g.doc_id),
        counts AS (SELECT doc_id, sum(e-b) n, count(*) k FROM spans GROUP BY doc_id)
        SELECT x.doc_id, octet_length(t) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, coalesce(c.k, 0) n_spans, sha256(CASE WHEN c.k IS NULL THEN t ELSE coalesce(s, unhex('')) END) kept_sha256
        FROM texts x LEFT JOIN counts c ON x.doc_id = c.doc_id LEFT JOIN kept q ON x.doc_id = q.doc_id""",
    "op11_importance_resampling": f"""
        WITH RECURSIVE {_CRC_TABLE},
        texts AS (
          SELECT doc_id, 0 side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
        words AS (SELECT doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM texts),
        features AS MATERIALIZED (
          SELECT doc_id, side, w[i] f FROM (SELECT *, unnest(range(1, len(w)+1)) i FROM words) a
          UNION ALL SELECT doc_id, side, w[i] || ' ' || w[i+1] FROM (SELECT *, unnest(range(1, len(w))) i FROM words) a),
        hashed AS MATERIALIZED (SELECT f, {_crc("f")} % 10000 b FROM (SELECT DISTINCT f FROM features) a, crc_table),
        counts AS (SELECT b, count(*) FILTER (side = 0) s, count(*) FILTER (side = 1) t FROM features JOIN hashed USING (f) GROUP BY b),
        gains AS (SELECT b, CAST(floor(1000*ln(CAST(t+1 AS DOUBLE)*(sum(s) OVER ()+10000)/(CAST(s+1 AS DOUBLE)*(sum(t) OVER ()+10000)))) AS BIGINT) g FROM counts),
        sums AS (SELECT doc_id, count(*) n, sum(g) g FROM features JOIN hashed USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY doc_id),
        weighed AS (SELECT doc_id, len(w) n_words, CAST(coalesce(n, 0) AS BIGINT) n_features, CAST(coalesce(floor(CAST(g AS DOUBLE)/n), 0) AS BIGINT) weight FROM words LEFT JOIN sums USING (doc_id) WHERE side = 0),
        scored AS (SELECT *, weight + CAST(floor(-1000*ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS UBIGINT)+0.5e0)/4294967296e0))) AS BIGINT) score FROM weighed),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, count(*) OVER () n FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25*n//100 THEN r END rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
        told AS MATERIALIZED (SELECT doc_id, lang, text, {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 forged, concat({", ".join(_told(c) for c in ("doc_id", "source", "lang", "n_chars"))}) head FROM documents, crc_table),
        leaves AS MATERIALIZED (
          SELECT doc_id, lang, sha256(head || {_told("text")}) leaf, sha256(head || {_told("CASE WHEN forged THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) sent,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id)-1 i, count(*) OVER (PARTITION BY lang) n FROM told),
        trees AS (
          SELECT lang, 0 level, i, n, leaf h FROM leaves
          UNION ALL SELECT lang, level+1, i//8, (n+7)//8, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY lang, level, i//8, n),
        nodes AS MATERIALIZED (SELECT * FROM trees),
        subroots AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST)-1 i, count(*) OVER () n FROM nodes WHERE n = 1),
        tops AS (
          SELECT 0 level, i, n, h FROM subroots
          UNION ALL SELECT level+1, i//8, (n+7)//8, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i//8, n),
        top_nodes AS MATERIALIZED (SELECT * FROM tops),
        runs AS MATERIALIZED (
          SELECT false top, coalesce('=' || lang, '') tree, level, i//8 run, n, list(h ORDER BY i) hs FROM nodes WHERE n > 1 GROUP BY ALL
          UNION ALL SELECT true, '', level, i//8, n, list(h ORDER BY i) FROM top_nodes WHERE n > 1 GROUP BY level, i//8, n),
        walk AS (
          SELECT doc_id, false top, coalesce('=' || l.lang, '') tree, 0 level, l.i, l.n, s.i top_i, s.n top_n, sent h, '' proof FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
          UNION ALL
          SELECT doc_id, CASE WHEN w.n = 1 THEN true ELSE w.top END, CASE WHEN w.n = 1 THEN '' ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.level+1 END,
            CASE WHEN w.n = 1 THEN top_i ELSE w.i//8 END, CASE WHEN w.n = 1 THEN top_n ELSE (w.n+7)//8 END, top_i, top_n,
            CASE WHEN w.n = 1 THEN h ELSE sha256(array_to_string(hs[:w.i%8], '') || h || array_to_string(hs[w.i%8+2:], '')) END,
            CASE WHEN w.n = 1 THEN proof ELSE proof || array_to_string(hs[:w.i%8], '') || array_to_string(hs[w.i%8+2:], '') END
          FROM walk w LEFT JOIN runs r ON w.top = r.top AND w.tree = r.tree AND w.level = r.level AND w.i//8 = r.run WHERE NOT (w.top AND w.n = 1)),
        ends AS (SELECT doc_id, h, proof FROM walk WHERE top AND n = 1)
        SELECT l.doc_id, leaf, s.h subroot, t.h root, sha256(proof) proof_sha256, e.h folded_root, e.h = t.h verified
        FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON l.doc_id = e.doc_id CROSS JOIN (SELECT h FROM top_nodes WHERE n = 1) t""",
}
