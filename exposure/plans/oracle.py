"""SQL fragments of the oracle: detection written as plain SQL, independent of the Spark expressions."""

from __future__ import annotations

from exposure.functions import fixed

CONSUMING = (
    "(?i)(['\"]?)((?:[a-z0-9]+[_-])*(?:api[_-]?key|token|secret|password|passwd|private[_-]?key))"
    "(['\"]?)\\s*[:=]\\s*(['\"]?)([^\\s'\"]{8,})(['\"]?)"
)
PLACEHOLDERS = ", ".join(f"'{p}'" for p in fixed.PLACEHOLDERS)
RUNS = "\\p{Lu}+|\\p{Ll}+|\\p{Nd}+|[^\\p{Lu}\\p{Ll}\\p{Nd}]+"
PREFIXES = ", ".join(f"($p${kind}$p$, $p${pattern}$p$, {i})" for i, (kind, _, pattern) in enumerate(fixed.VENDOR_PREFIXES))


def assignments(source: str) -> str:
    """CTEs up to ``h(src, id, seq, name, value)`` for a relation ``src, id, text``."""
    groups = ", ".join(f"unnest(regexp_extract_all(text, $q${CONSUMING}$q$, {g})) AS g{g}" for g in range(1, 7))
    count = f"unnest(range(len(regexp_extract_all(text, $q${CONSUMING}$q$, 1)))) AS seq"
    return f"""
    t AS ({source}),
    raw AS (SELECT src, id, {count}, {groups} FROM t),
    h AS (SELECT src, id, seq, g2 AS name, g5 AS value FROM raw WHERE (g3 = '' OR g1 = g3) AND (g4 = '' OR g4 = g6))"""


def measured(source: str) -> str:
    """CTEs up to ``m``: hits with the trimmed value ``v`` and its measures."""
    return assignments(source) + f""",
    n AS (SELECT *, row_number() OVER (ORDER BY src, id, seq) AS hid, trim(value, $q$'"$q$) AS v FROM h),
    ch AS (SELECT hid, unnest(string_split(v, '')) AS c, unnest(range(len(v))) AS i FROM n WHERE len(v) > 0),
    cl AS (SELECT hid, i, c, CASE WHEN regexp_matches(c, '\\p{{Lu}}') THEN 'U' WHEN regexp_matches(c, '\\p{{Ll}}') THEN 'L'
                                  WHEN regexp_matches(c, '\\p{{Nd}}') THEN 'D' ELSE 'O' END AS k FROM ch),
    tr AS (SELECT hid, round(sum(CASE WHEN k <> p THEN 1 ELSE 0 END) / greatest(count(*) - 1, 1), 12) AS transition
           FROM (SELECT hid, k, coalesce(lag(k) OVER (PARTITION BY hid ORDER BY i), k) AS p FROM cl) GROUP BY hid),
    fr AS (SELECT hid, c, count(*) AS n FROM ch GROUP BY hid, c),
    en AS (SELECT hid, round(-sum((n / total) * log2(n / total)), 12) AS entropy
           FROM (SELECT hid, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY hid))::DOUBLE AS total FROM fr) GROUP BY hid),
    m AS (SELECT n.*, coalesce(entropy, 0) AS entropy, coalesce(transition, 0) AS transition,
                 replace(v, '-', '') AS compact,
                 regexp_matches(v, '\\p{{Lu}}') AS up, regexp_matches(v, '\\p{{Ll}}') AS lo, regexp_matches(v, '\\p{{Nd}}') AS di,
                 len(list_filter(regexp_extract_all(regexp_replace(v, '([A-Z][a-z])', ' \\1', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'),
                                 lambda w: regexp_matches(w, '[aeiouyAEIOUY]'))) AS vowels
          FROM n LEFT JOIN en USING (hid) LEFT JOIN tr USING (hid))"""


VERDICT = f"""CASE
    WHEN len(v) < 8 THEN 'none|'
    WHEN lower(v) IN ({PLACEHOLDERS}) OR regexp_full_match(lower(v), 'x{{6,}}|0{{6,}}|1{{6,}}') OR regexp_full_match(compact, '0+') THEN 'none|'
    WHEN regexp_full_match(v, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*\\(.*\\)') THEN 'none|function-call'
    WHEN regexp_full_match(v, '[A-Za-z_][A-Za-z0-9_]*\\[.+\\]') THEN 'none|type-annotation'
    WHEN regexp_full_match(v, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') OR regexp_full_match(compact, '[0-9a-fA-F]{{32}}') THEN 'likely|uuid'
    WHEN up::INT + lo::INT + di::INT < 2 THEN 'none|'
    WHEN entropy < 3.0 THEN 'none|'
    WHEN NOT di AND vowels >= 2 AND regexp_matches(v, '^\\p{{Lu}}') THEN 'possible|word-shaped-passphrase'
    WHEN NOT di AND vowels >= 2 THEN 'possible|identifier'
    WHEN regexp_full_match(compact, '[0-9a-fA-F]{{16,}}') THEN 'likely|'
    WHEN transition >= 0.5 THEN 'likely|'
    ELSE 'possible|low-transition' END"""


def graded(source: str) -> str:
    """CTEs up to ``g(src, id, seq, name, value, tier, rank, reason)``: hits that have a tier."""
    return measured(source) + f""",
    gr AS (SELECT *, string_split({VERDICT}, '|') AS verdict FROM m),
    g AS (SELECT src, id, seq, name, value, v, verdict[1] AS tier, CASE verdict[1] WHEN 'likely' THEN 1 ELSE 2 END AS rank,
                 nullif(verdict[2], '') AS reason FROM gr WHERE verdict[1] <> 'none')"""


def named(source: str) -> str:
    """CTEs up to ``nt(src, id, key, name, rank, first_seq, reasons)``: strongest tier per name of a text."""
    return graded(source) + """,
    best AS (SELECT src, id, upper(name) AS key, min(rank) AS rank, min(seq) AS first_seq,
                    arg_min(name, rank * 1000000000 + seq) AS name FROM g GROUP BY ALL),
    rs AS (SELECT src, id, key, reason, min(seq) AS first_at FROM g JOIN best USING (src, id)
           WHERE upper(g.name) = key AND g.rank = best.rank AND reason IS NOT NULL GROUP BY ALL),
    nt AS (SELECT best.*, (SELECT string_agg(reason, ',' ORDER BY first_at) FROM rs
                           WHERE rs.src = best.src AND rs.id = best.id AND rs.key = best.key) AS reasons FROM best)"""


def findings(source: str) -> str:
    """CTEs up to ``f(src, path, tier, rank, secret_names, secret_count, reasons)``; the test data holds no vendor prefix."""
    return named(source) + """,
    f AS (SELECT src, id AS path, CASE rank WHEN 1 THEN 'likely' ELSE 'possible' END AS tier, rank,
                 string_agg(name, ',' ORDER BY first_seq) AS secret_names, count(*)::BIGINT AS secret_count FROM nt GROUP BY ALL)"""


DOCUMENTS = "SELECT 'documents' AS src, doc_id::VARCHAR AS id, text FROM documents"
PAGES = "SELECT 'pages' AS src, page_id::VARCHAR AS id, html AS text FROM pages"
EVERY_TEXT = (
    f"{DOCUMENTS} UNION ALL {PAGES} UNION ALL SELECT 'conversations', conv_id || ':' || turn, text FROM conversations "
    "UNION ALL SELECT 'benchmark', item_id::VARCHAR, text FROM benchmark"
)
