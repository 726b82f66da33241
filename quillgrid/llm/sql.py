"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CLASS_WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACE_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"



def lloyd(rounds: int, parts: int = 16, entries: int = 64) -> str:
    """Codes, errors and the digest of the codebooks after so many Lloyd rounds over whole numbers."""

    def assigned(book: str) -> str:
        far = "list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))"
        return f"""SELECT r, p, min(struct_pack(d, e)) AS best FROM (SELECT r, v.p AS p, e, ({far})::BIGINT AS d FROM v JOIN {book} b ON b.p = v.p) GROUP BY r, p"""

    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assigned(f'b{i}')})")
        floor = "((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
        mean = f"""SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, {floor} AS m
            FROM (SELECT a.p AS p, best.e AS e, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS y FROM a{i} a JOIN v ON v.r = a.r AND v.p = a.p) GROUP BY p, e, j) GROUP BY p, e"""
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p AS p, b.e AS e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN ({mean}) n ON n.p = b.p AND n.e = b.e)")
    between = "".join(f"{x},\n        " for x in steps)
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT r, p, w[p * (len(w) // {parts}) + 1:(p + 1) * (len(w) // {parts})] AS x FROM (SELECT r, w, unnest(range({parts})) AS p FROM k)),
        b0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM v WHERE r < {entries}),
        {between}f AS MATERIALIZED ({assigned(f"b{rounds}")}),
        s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM b{rounds}),
        z AS (SELECT r, string_agg(printf('%02x', best.e::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY r)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
        FROM z JOIN k USING (r), s"""


SQL: dict[str, str] = {
    "op11_vector_codes": lloyd(rounds=2),
    "op6_decontaminate": f"""
        WITH d AS (SELECT doc_id, {CLASS_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {CLASS_WORDS} AS w FROM benchmark),
        i AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS x
                FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
        sizes AS (SELECT DISTINCT k FROM win),
        places AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS x
                   FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes)),
        found AS (SELECT doc_id, p, places.k AS k, item_id FROM places JOIN win ON win.x = places.x AND win.k = places.k),
        hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY 1),
        ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
                FROM found GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
}
