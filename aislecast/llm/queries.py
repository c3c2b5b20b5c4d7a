"""The corpus operators as named queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable_by_workers
from . import decontaminate, dialogues, lines, near_copies, neighbours, overlap_join, privacy, quality, spellings, templates, token_files, trie_bpe, warc
from .checksum_sql import CRC_TABLE, crc32
from .text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable_by_workers(spark)
            return build(spark, sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files."""
    docs = table(spark, sf_dir, "documents")
    rows = token_files.token_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_trie_bpe")
def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and decoded text, as digests."""
    docs = table(spark, sf_dir, "documents")
    rows = trie_bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query(
    "op4_warc_segments",
    """
    WITH p AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
    ), d AS (
        SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
               sha256(payload) AS payload_digest FROM p
    ), f AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND later THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND later THEN first_id END AS refers_to
    FROM (SELECT *, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS later FROM f)
    """,
)
def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    rows = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op5_wu_manber",
    r"""
    WITH dw AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), bw AS (
        SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE item_id IS NOT NULL
    ), windows AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS size,
               unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
                      lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS pattern
        FROM bw WHERE len(w) > 0
    ), sizes AS (SELECT DISTINCT size FROM windows),
    places AS (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size
    ), found AS (
        SELECT p.doc_id, p.i, p.size, x.item_id
        FROM places p JOIN windows x ON x.size = p.size AND x.pattern = array_to_string(p.w[p.i : p.i + p.size - 1], ' ')
    ), hit AS (
        SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in windows of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op7_line_dedup",
    r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents
    ), k AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
    ), bad AS (
        SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
        SELECT k.*, bad.key IS NOT NULL AND k.doc_id <> stays AS gone FROM k LEFT JOIN bad USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines before and after the repeated ones are dropped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lines.drop_repeated_lines(docs)
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    return rows.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@query(
    "op10_hilbert_search",
    """
    WITH v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op10_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op9_quality_scores")
def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score from a model fitted on labelled documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = quality.score_documents(docs, model, carry=["doc_id"])
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op1_disclosure")
def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's identifiers and the words that disclose them."""
    rows = privacy.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "term")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *[count(kind) for kind in privacy.PATTERNS],
        F.sha2(privacy.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        privacy.spans_text(F.col("spans")).alias("spans"),
    )


@query(
    "op8_minhash_join",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
        FROM words
    ), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
        FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (
        SELECT doc_id, doc_id AS r FROM documents
        UNION
        SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a
    ), best AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
    FROM sets JOIN best USING (doc_id)
    """,
)
def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and group of near copies."""
    return near_copies.near_copies(table(spark, sf_dir, "documents"), width=4)


@query("op6_template_text")
def op6_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's article, cut out by its host's template."""
    return templates.extract_main_text(table(spark, sf_dir, "pages"))


@query(
    "op12_dialogue_repair",
    f"""
    WITH RECURSIVE {CRC_TABLE},
    filled AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
        FROM conversations
    ), drawn AS (
        SELECT conv_id, turn, role, text, {crc32('name')} % 20 AS draw FROM filled, crc
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
               CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM (SELECT *, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) FROM drawn WHERE draw <> 0)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
               md5(length(role) || ':' || role || ':' || text)) AS place FROM damaged
    ), ended AS (
        SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed
    ), marked AS (
        SELECT conv_id, turn, role, text, place, left(role, 1) AS initial,
               final = '' AS blank, final <> '' AND nth > 1 AS dup,
               nth = 1 AND final NOT IN ('', '.', '!', '?') AS cut,
               before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM ended
    ), totals AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
               count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal FROM marked GROUP BY conv_id
    ), inserts AS (
        -- Roles written by up to two inserts in a row; more never pay.
        SELECT * FROM (VALUES ('', '', 0), ('', 'u', 1), ('', 'a', 2), ('s', '', 0), ('s', 'u', 1), ('s', 'a', 2),
            ('u', '', 0), ('u', 'a', 1), ('u', 'u', 2), ('a', '', 0), ('a', 'u', 1), ('a', 'a', 2)) AS i(was, role, n)
    ), paths AS (
        SELECT conv_id, 0::BIGINT AS place, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM totals
        UNION ALL
        SELECT conv_id, place, state, best.cost, best.audit, best.lines
        FROM (
            SELECT conv_id, place, state, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best
            FROM (
                SELECT m.conv_id, m.place,
                    CASE edit WHEN 'D' THEN now WHEN 'K' THEN m.initial ELSE CASE now WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
                    p.cost + 2 * i.n + CASE edit WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END
                        + CASE WHEN m.cut AND edit <> 'D' THEN 1 ELSE 0 END AS cost,
                    p.audit || repeat('I', i.n) || edit AS audit,
                    p.lines || CASE WHEN i.n = 0 THEN '' WHEN i.n = 1 AND i.role = 'u' OR i.n = 2 AND i.role = 'a'
                            THEN 'user:' || chr(10) ELSE 'assistant:' || chr(10) END
                        || CASE WHEN i.n < 2 THEN '' WHEN i.role = 'u' THEN 'user:' || chr(10) ELSE 'assistant:' || chr(10) END
                        || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN m.role || ':' || m.text || chr(10)
                            ELSE CASE now WHEN 'u' THEN 'assistant:' ELSE 'user:' END || m.text || chr(10) END AS lines
                FROM paths p
                JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.place = p.place + 1
                JOIN inserts i ON i.was = p.state
                CROSS JOIN LATERAL (SELECT CASE WHEN i.n = 0 THEN p.state ELSE i.role END AS now)
                CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS e(edit)
                WHERE edit = 'D' OR NOT m.blank AND NOT m.dup
                    AND (edit = 'R' OR m.initial <> '' AND now || m.initial IN ('s', 'u', 'su', 'ua', 'au'))
            ) GROUP BY conv_id, place, state
        )
    ), ends AS (
        SELECT p.conv_id, min({{'cost': cost + tail, 'audit': audit || repeat('I', tail // 2), 'lines': lines || CASE tail
            WHEN 4 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS best
        FROM (SELECT *, CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS tail FROM paths) p
        JOIN totals t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND p.place = t.n GROUP BY p.conv_id
    ), ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
           coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
           sha256(coalesce(left(best.lines, length(best.lines) - 1), '')) AS repaired_sha256
    FROM ids LEFT JOIN totals ON totals.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
    """,
)
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    return dialogues.damage_and_repair(table(spark, sf_dir, "conversations"))


@query(
    "op11_spelling_variants",
    f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (
        SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents WHERE text IS NOT NULL
        ) WHERE length(run) >= 7 GROUP BY doc_id, run
    ), drawn AS (
        SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc
    ), words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                   ELSE run END AS word FROM drawn
        ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), left_out AS (
        SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
    ), pairs AS (
        SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn
        FROM left_out a JOIN left_out b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT w.word, w.n, l.word, l.n FROM words w JOIN left_out l ON l.rest = w.word
        UNION SELECT l.word, l.n, w.word, w.n FROM words w JOIN left_out l ON l.rest = w.word
    ), best AS (
        SELECT a, count(*) AS n_near, min({{'minus': -bn, 'word': b}}) AS top FROM pairs GROUP BY a
    ), forms AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near,
               CASE WHEN -top.minus >= 10 * n THEN top.word END AS form,
               CASE WHEN -top.minus >= 10 * n THEN -top.minus END AS form_n
        FROM words LEFT JOIN best ON word = a
    ), steps AS (
        SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
        UNION ALL
        SELECT s.word, f.form, s.step + 1 FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
    ), ends AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
    SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n
    FROM forms LEFT JOIN ends USING (word)
    """,
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words, form and root."""
    return spellings.spelling_variants(table(spark, sf_dir, "documents"))


@query(
    "op13_overlap_join",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
        FROM words
    ), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
        FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (
        SELECT doc_id, doc_id AS r FROM documents
        UNION
        SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a
    ), best AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
    FROM sets JOIN best USING (doc_id)
    """,
)
def op13_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component of linked documents."""
    return overlap_join.overlap_join(table(spark, sf_dir, "documents"))
