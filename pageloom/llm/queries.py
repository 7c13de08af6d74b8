"""One query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.llm import decontamination, line_dedup, lm_scoring, merkle, mixing, near_dedup, order_minhash, piece_tokens, quality, spelling, suffix_dedup, surrogates, toxicity
from pageloom.sources.tables import read_table


def op1_lm_scoring(spark, sf_dir):
    """Pseudo-likelihood of every document."""
    scored = lm_scoring.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood")


def op2_suffix_dedup(spark, sf_dir):
    """What is left of every document without its repeated 200-byte strings."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), keep="none", with_bytes=False)


def op3_near_dedup(spark, sf_dir):
    """The near-duplicate class of every document."""
    return near_dedup.near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_key", "class_size")


def op4_decontamination(spark, sf_dir):
    """Benchmark items found in documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark"))


def op5_surrogates(spark, sf_dir):
    """Every document with surrogates in place of its entities."""
    return surrogates.replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark, sf_dir):
    """Calibrated probability and draw of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixture(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected")


def op7_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark, sf_dir):
    """Every document without its host's boilerplate lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_removed", "text")


def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_order_minhash(spark, sf_dir):
    """Fingerprints of every document, its edited form and its next document."""
    return order_minhash.fingerprint_neighbours(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling_variants(spark, sf_dir):
    """Near words, form and root of every frequent word of the corpus."""
    words = spelling.spelt_words(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.spelling_forms(spelling.count_words(words))


def op12_merkle_manifest(spark, sf_dir):
    """Leaf, roots, proof and audit of every document; a seventh of the leaves are tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = fields | {"n_chars": F.col("n_chars") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        "doc_id", "lang", merkle.leaf_digest([*fields.values()]).alias("leaf"), F.when(tampered, merkle.leaf_digest([*changed.values()])).alias("claimed")
    )
    return merkle.audit(leaves, "lang", "doc_id").select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_piece_encoding(spark, sf_dir):
    """Piece ids of every document and the text they give back."""
    import public_tokenizers

    coded = piece_tokens.round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return piece_tokens.digests(coded)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_surrogates": op5_surrogates,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_order_minhash": op10_order_minhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_piece_encoding": op13_piece_encoding,
}

#: A one-row table of the CRC-32 table, and the CRC-32 of a list of bytes by it, in SQL.
CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_table)"""


def crc_sql(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    parts = (f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(parts)})"


ORACLE = {
    "op11_spelling_variants": f"""
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
        low AS (SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        coded AS (
            SELECT run, times, list_concat(list_transform(string_split(doc_id::VARCHAR || ':', ''), lambda x: ord(x)::BIGINT),
                   flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x) - 64] END))) AS codes
            FROM low
        ),
        hashed AS (SELECT run, times, {crc_sql('codes')} AS h FROM coded, {CRC_TABLE}),
        spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
        words AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
        cuts AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS cut FROM places),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.k = b.k AND a.cut = b.cut AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
            UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
        ),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ),
        steps(word, here, form) AS (
            SELECT word, word, form FROM forms
            UNION ALL
            SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.form
        )
        SELECT f.word, f.form, s.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.form IS NULL
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
                   CASE WHEN {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS claimed,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place
            FROM documents, {CRC_TABLE}
        ),
        climb(lang, level, place, digest, n) AS (
            SELECT lang, 0::BIGINT, place, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
            UNION ALL
            SELECT lang, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM climb WHERE n > 1 GROUP BY lang, level, place // 2, n
        ),
        subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM climb WHERE n = 1),
        top(level, place, digest, n) AS (
            SELECT 0::BIGINT, place, digest, count(*) OVER () FROM subroots
            UNION ALL
            SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, place // 2, n
        ),
        proofs AS (
            SELECT doc_id, 0 AS part, c.level, c.digest FROM leaves l JOIN climb c ON c.lang IS NOT DISTINCT FROM l.lang AND c.place = xor(l.place >> c.level, 1)
            UNION ALL
            SELECT doc_id, 1, t.level, t.digest FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.place = xor(s.place >> t.level, 1)
        ),
        folds(doc_id, lang, level, place, n, digest) AS (
            SELECT doc_id, l.lang, 0::BIGINT, l.place, c.n, coalesce(claimed, leaf) FROM leaves l JOIN climb c ON c.lang IS NOT DISTINCT FROM l.lang AND c.level = 0 AND c.place = l.place
            UNION ALL
            SELECT f.doc_id, f.lang, f.level + 1, f.place // 2, (f.n + 1) // 2,
                   sha256(CASE WHEN f.place % 2 = 1 THEN c.digest ELSE '' END || f.digest || CASE WHEN f.place % 2 = 0 THEN coalesce(c.digest, '') ELSE '' END)
            FROM folds f LEFT JOIN climb c ON c.lang IS NOT DISTINCT FROM f.lang AND c.level = f.level AND c.place = xor(f.place, 1) WHERE f.n > 1
        ),
        rises(doc_id, level, place, n, digest) AS (
            SELECT f.doc_id, 0::BIGINT, s.place, (SELECT count(*) FROM subroots), f.digest FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
            UNION ALL
            SELECT f.doc_id, f.level + 1, f.place // 2, (f.n + 1) // 2,
                   sha256(CASE WHEN f.place % 2 = 1 THEN t.digest ELSE '' END || f.digest || CASE WHEN f.place % 2 = 0 THEN coalesce(t.digest, '') ELSE '' END)
            FROM rises f LEFT JOIN top t ON t.level = f.level AND t.place = xor(f.place, 1) WHERE f.n > 1
        )
        SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root,
               sha256(coalesce((SELECT string_agg(p.digest, '' ORDER BY p.part, p.level) FROM proofs p WHERE p.doc_id = l.doc_id), '')) AS proof_sha256,
               r.digest AS folded_root, r.digest = t.digest AS verified
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN rises r ON r.doc_id = l.doc_id AND r.n = 1 JOIN top t ON t.n = 1
    """,
    "op8_line_dedup": f"""
        WITH pages AS (SELECT source, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        counted AS (
            SELECT source, line, count(*) AS n_pages
            FROM (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM pages)
            WHERE line <> '' GROUP BY source, line HAVING count(*) >= {line_dedup.MIN_PAGES}
        ),
        totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
        listed AS (
            SELECT c.source, list(c.line) AS bad
            FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
            WHERE c.n_pages > {line_dedup.RATIO} * t.host_pages GROUP BY c.source
        ),
        cut AS (
            SELECT p.doc_id, p.source, p.text, p.lines,
                   list_filter(p.lines, lambda x: l.bad IS NULL OR NOT list_contains(l.bad, trim(x, ' '))) AS kept
            FROM pages p LEFT JOIN listed l ON p.source IS NOT DISTINCT FROM l.source
        )
        SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines,
               CAST(coalesce(len(lines) - len(kept), 0) AS INTEGER) AS n_removed,
               array_to_string(kept, chr(10)) AS text
        FROM cut
    """,
}
