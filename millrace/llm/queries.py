"""The queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, divergence, exact_dedup, flac, langid, language_model, licenses, line_dedup, merkle, mixing, ngram_join, pieces, warc
from millrace.llm.shared import shared_dir
from millrace.sources.tables import spread


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf, "documents")).drop("spans")


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    warc.write_warc(warc.roles(_table(spark, sf, "pages")), path)
    back = warc.read_warc(spark, path)
    # a response's digest is that of the bytes read; a revisit has only what its header says
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    length = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return back.select("page_id", length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op3_flac(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return flac.from_pcm(flac.stored_pcm(flac.from_flac(flac.to_flac(docs).drop("text"))))


#: The tokenizer's model file; a parameter of the operator.
PIECES_MODEL = os.environ.get("MILLRACE_PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs, PIECES_MODEL, kind="unigram"), PIECES_MODEL)
    back = F.coalesce(F.translate("text", pieces.MARK, " "), F.lit("")) == F.col("decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", back.alias("round_trip"))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    known = langid.identify(docs.select("doc_id", "text"), model)
    return known.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf, "documents"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf, "documents"), words=3, percent=90)


def op8_chat_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    views = chat.perspectives(_table(spark, sf, "conversations"))
    return views.withColumn("spans", F.expr("array_join(transform(spans, s -> concat(s.start, '-', s.end)), ',')"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    cleaned = line_dedup.line_dedup(docs)
    return cleaned.select("doc_id", "dropped_lines", "text")


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf, "documents"))


def op11_divergence(spark: SparkSession, sf: str) -> DataFrame:
    found = divergence.divergence(_table(spark, sf, "documents"))
    return found.select("lang", "source", "part", "item", "value", "rank")


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(docs, claimed={"n_chars": F.col("n_chars") + F.when(tampered, 1).otherwise(0)})


def op13_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.score(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_warc, op3_flac, op4_sentencepiece, op5_language_id, op6_mixing, op7_ngram_jaccard, op8_chat_perspectives, op9_line_dedup, op10_exact_dedup, op11_divergence, op12_merkle, op13_language_model)}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
        FROM m
    """,
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
        c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM w),
        r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0) AS remains, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest
              FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT min_by(remains / rest, cap / weight) AS level FROM r WHERE remains / rest <= cap / weight),
        t AS (SELECT source, source_size, round(least(cap, weight * coalesce((SELECT level FROM l), 1e300)), 6) AS target FROM c),
        j AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
                     ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM j
    """,
    "op8_chat_perspectives": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        t AS (SELECT *, 0::BIGINT AS part FROM c),
        who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
        r AS (SELECT t.*, perspective, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
              FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
        o AS (SELECT *, row_number() OVER w AS rn, sum(length(head) + length(text) + 11) OVER w - length(text) - 11 AS s
              FROM r WINDOW w AS (PARTITION BY conv_id, part, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY rn) AS text,
               coalesce(string_agg((s::BIGINT)::VARCHAR || '-' || (s + length(text))::BIGINT::VARCHAR, ',' ORDER BY rn) FILTER (role = perspective), '') AS spans
        FROM o GROUP BY conv_id, perspective, part
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang,'') AS lang, coalesce(source,'') AS source,
         unnest(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        k AS (SELECT lang, term, count(*) AS overall FROM d GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        g AS (SELECT DISTINCT coalesce(lang,'') AS lang, coalesce(source,'') AS source FROM documents),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(overall)::HUGEINT AS n FROM k GROUP BY lang),
        c AS (SELECT g.lang, g.source, k.term, count(d.term)::HUGEINT AS n, any_value(k.overall)::HUGEINT AS overall
              FROM g JOIN k ON g.lang=k.lang LEFT JOIN d ON d.lang=g.lang AND d.source=g.source AND d.term=k.term GROUP BY ALL),
        p AS (SELECT c.*, 1 + (1000000000::HUGEINT*(c.n+5)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 5*v.v) AS p,
              1 + (1000000000::HUGEINT*(overall+5)) // (v.n + 5*v.v) AS q FROM c JOIN v ON c.lang=v.lang),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p-b.p)) AS value FROM p a JOIN p b ON a.lang=b.lang AND a.term=b.term AND a.source<>b.source GROUP BY ALL),
        pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value,0)::BIGINT AS value FROM g JOIN g h ON g.lang=h.lang AND g.source<>h.source LEFT JOIN s ON s.lang=g.lang AND s.source=g.source AND s.item=h.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p-q)::BIGINT AS value FROM p WHERE n>0 AND p>q),
        u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part='pair' OR rank<=50
    """,
    "op12_merkle": """
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, source, n_chars, text,
                   list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda k, i: xor(k >> 1, (k & 1::UBIGINT) * 3988292384::UBIGINT))) AS rest
            FROM documents),
        f AS (SELECT doc_id, lang, n_chars IS NOT NULL AND xor(rest, 4294967295::UBIGINT) % 7 = 0 AS tampered,
                     coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                     n_chars, coalesce(strlen(text) || ':' || text, '-') AS z FROM d),
        leaves AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS h,
                          CASE WHEN tampered THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS claimed FROM f),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, row_number() OVER () AS r FROM leaves),
        up(tree, level, pos, h) AS (
            SELECT lang, 0, pos, h FROM numbered
            UNION ALL
            SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, level, pos // 2),
        subroots AS (SELECT tree, arg_max(h, level) AS h, max(level) AS high, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM up GROUP BY tree),
        top(level, pos, h) AS (
            SELECT 0, pos, h FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // 2),
        root AS (SELECT arg_max(h, level) AS root, max(level) AS high FROM top),
        steps AS (
            SELECT r, n.level, (n.pos >> n.level) % 2 = 1 AS on_right, s.h AS sibling
            FROM (SELECT r, lang, n.pos, unnest(range(high)) AS level FROM numbered n JOIN subroots t ON n.lang IS NOT DISTINCT FROM t.tree) n
            LEFT JOIN up s ON s.tree IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.pos = xor(n.pos >> n.level, 1)
            UNION ALL
            SELECT n.r, below + n.level, (n.pos >> n.level) % 2 = 1, s.h
            FROM (SELECT r, t.high AS below, t.pos, unnest(range(root.high)) AS level FROM numbered n JOIN subroots t ON n.lang IS NOT DISTINCT FROM t.tree, root) n
            LEFT JOIN top s ON s.level = n.level AND s.pos = xor(n.pos >> n.level, 1)),
        proofs AS (SELECT r, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY level)) AS proof FROM steps GROUP BY r),
        fold(r, level, h) AS (
            SELECT r, 0::BIGINT, coalesce(claimed, h) FROM numbered
            UNION ALL
            SELECT f.r, f.level + 1, sha256(CASE WHEN on_right THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END) FROM fold f JOIN steps s ON s.r = f.r AND s.level = f.level),
        folded AS (SELECT r, arg_max(h, level) AS h FROM fold GROUP BY r)
        SELECT n.doc_id, n.h AS leaf, t.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM numbered n JOIN subroots t ON n.lang IS NOT DISTINCT FROM t.tree JOIN folded f ON f.r = n.r LEFT JOIN proofs p ON p.r = n.r, root
    """,
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
        reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN links ON x = reach.doc_id WHERE root < y)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.root AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
}
