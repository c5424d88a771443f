"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from proofset.llm.ann import op5_permutation_index
from proofset.llm.chat import op7_chat_formatting
from proofset.llm.decontaminate import op6_decontamination
from proofset.llm.divergence import op13_source_divergence
from proofset.llm.jaccard import op3_jaccard_join
from proofset.llm.language_id import op2_language_id
from proofset.llm.lm_scoring import op9_lm_scoring
from proofset.llm.near_vectors import op12_embedding_near_dedup
from proofset.llm.packing import op8_packing
from proofset.llm.repair import op11_conversation_repair
from proofset.llm.secrets import op10_secret_scans
from proofset.llm.sharding import op1_sharding
from proofset.llm.warc import op4_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_warc": op4_warc,
    "op5_permutation_index": op5_permutation_index,
    "op6_decontamination": op6_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_packing": op8_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_secret_scans": op10_secret_scans,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_source_divergence": op13_source_divergence,
}

# The letters that the contracts lower-case, and the patterns of secrets (their groups as RE2 has them).
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PLACES = "list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT))"


def _kind(name: str, rank: int, pattern: str, keep: str, value: str = "m[i]") -> str:
    return f"""SELECT doc_id, source, {rank} AS rank, '{name}' AS kind, s[i] AS a, s[i] + length(m[i]) AS b, {value} AS v FROM (
        SELECT *, {_PLACES} AS s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', 1) AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d)) WHERE {keep}"""


_SECRETS = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    c AS ({_kind("assign", 0, _ASSIGN, "length(g[i]) >= 6", "g[i]")}
        UNION ALL {_kind("access", 1, "(AKIA[A-Z0-9]{16,})", "TRUE")} UNION ALL {_kind("hex", 2, "([0-9a-f]{24,})", "TRUE")}
        UNION ALL {_kind("owned", 3, "([A-Za-z0-9_-]{20,})", "regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[0-9]')")}),
    o AS (SELECT v, count(DISTINCT coalesce(source, ' none')) AS owners, count(DISTINCT (coalesce(source, ' none'), doc_id)) AS repositories FROM c GROUP BY v),
    l AS (SELECT c.*, NOT (owners >= 5 OR (owners >= 2 AND repositories >= 25)) AS live FROM c JOIN o USING (v)),
    k AS (SELECT doc_id, rank, a, kind || ':' || a || ':' || b AS s, live FROM l WHERE rank < 3 OR live)
    SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        sha256(coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, rank), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""

# CRC-32 bit by bit, over the characters of an ASCII text k.
_CRC = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, n: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"

# Row after row, the lightest repair (cost, audit, repaired turns) that leaves the grammar in each of its four states.
_REPAIR = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
    f AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
        FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f) GROUP BY conv_id),
    ed(q, letter, ini, to_q, cost) AS (VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1), (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2)),
    ins(q, to_q, a, t) AS (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, 'II', ['user:', 'assistant:'])),
    s AS (SELECT conv_id, 0::BIGINT AS i, ins.to_q AS q, {{'c': 5 * len(a)::BIGINT, 'a': a, 't': t}} AS w FROM (SELECT DISTINCT conv_id FROM f), ins WHERE ins.q = 0
        UNION ALL SELECT conv_id, i, to_q AS q, min(w) AS w FROM (
            SELECT s.conv_id, f.i, ins.to_q, {{'c': s.w.c + ed.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END + 5 * len(ins.a)::BIGINT, 'a': s.w.a || letter || ins.a, 't': s.w.t || CASE letter WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE WHEN ed.to_q = 3 THEN 'assistant' ELSE 'user' END || ':' || f.text] ELSE [] END || ins.t}} AS w
            FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1 JOIN ed ON ed.q = s.q AND (ed.ini IS NULL OR ed.ini = f.ini) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) JOIN ins ON ins.q = ed.to_q) GROUP BY ALL),
    best AS (SELECT s.conv_id, min(w) AS w FROM s JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.i = g.n WHERE q IN (0, 3) GROUP BY s.conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id"""

_DIVERGENCE = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k FROM documents),
    t AS (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(w) AS term FROM d) GROUP BY ALL),
    kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(*) >= 10),
    g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
    m AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS q
        FROM gn JOIN v ON gn.lang = v.lang JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
    p AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM m WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""

ORACLE_SQL: dict[str, str] = {
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS k FROM embeddings),
        u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        p AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
        r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT a, min(vec_id) AS least FROM r JOIN v ON r.b = v.k GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept FROM v LEFT JOIN n ON n.a = v.k LEFT JOIN c ON c.a = v.k
    """,
    "op13_source_divergence": _DIVERGENCE,
    "op11_conversation_repair": _REPAIR,
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) g ON g.a = w.doc_id
    """,
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT id, k, s FROM (SELECT id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda j: array_to_string(w[j:j+least(10, len(w))-1], ' '))) AS s FROM i WHERE len(w) > 0)),
        dw AS (SELECT doc_id, k, j, array_to_string(w[j:j+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
        h AS (SELECT doc_id, j, dw.k, id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
        hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS pos FROM h) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM h GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
    """,
    "op10_secret_scans": _SECRETS,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT payload_digest, payload_bytes, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
        )
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
            CASE WHEN g.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
    """,
}
