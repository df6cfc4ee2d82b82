"""DuckDB SQL for the rows of those queries that SQL can express."""

ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body)
    """,
    # Base32 of the 40 hex digits of SHA-1: five of them are twenty bits, four letters.
    "op2_warc_transactions": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        e AS (SELECT page_id, url, body, array_to_string(list_transform(range(32), lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5))::BIGINT // (32 ** (3 - k % 4))::BIGINT % 32 + 1 AS BIGINT), 1)), '') AS digest
              FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to,
               regexp_replace(coalesce(url, 'urn:unknown'), '[\\x00-\\x20]', '%20', 'g') AS uri, digest AS declared_digest
        FROM e WINDOW w AS (PARTITION BY body)
    """,
    "op9_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
    """,
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT min(doc_id) AS id, text, count(*) AS copies FROM documents WHERE regexp_matches(text, '\S') GROUP BY text),
        w AS (SELECT id, string_split_regex(trim(text, E' \n\t\r'), '\s+') AS ws FROM t),
        s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingle FROM w),
        z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        o AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
        c AS (SELECT t.id, t.text, t.copies, coalesce(n.n, 0) AS n_links, least(t.id, coalesce(m.least, t.id)) AS class_id FROM t LEFT JOIN n ON n.a = t.id LEFT JOIN m ON m.a = t.id)
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(copies - 1, 0) AS n_copies, d.doc_id = coalesce(class_id, d.doc_id) AS kept
        FROM documents d LEFT JOIN c ON c.text = d.text
    """,
}
