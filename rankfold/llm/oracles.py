"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import ANCHORS, RULES, SENTENCE_END, SENTENCES, known_lines


def _license() -> str:
    anchors = "|".join(ANCHORS)
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = ", ".join(f"({k}, '{rule}', '{name}', '|{'|'.join(ids)}|')" for k, (rule, name, ids) in enumerate(RULES))
    return rf"""
    WITH known(sentence, sid) AS (VALUES {known}), rules(k, rule, license, ids) AS (VALUES {rules}),
    lowered AS (SELECT doc_id, lower(text) AS text FROM documents WHERE regexp_matches(lower(text), '{anchors}')),
    plain AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{SENTENCE_END}', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g') AS body FROM lowered),
    found AS (SELECT doc_id, regexp_extract_all(regexp_replace(body, ' ?\n[ \n]*', chr(10), 'g'), '{known_lines(SENTENCES)}', 1) AS parts FROM plain),
    parts AS (SELECT doc_id, generate_subscripts(parts, 1) AS place, replace(unnest(parts), chr(10), ' ') AS sentence FROM found),
    seqs AS (SELECT doc_id, count(*) AS n_known, string_agg(sid, '|' ORDER BY place) AS sequence FROM parts JOIN known USING (sentence) GROUP BY doc_id),
    hits AS (SELECT doc_id, k, rule, license FROM seqs, rules WHERE contains('|' || sequence || '|', ids)),
    firsts AS (SELECT doc_id, license, min(k) AS k FROM hits GROUP BY ALL),
    best AS (SELECT doc_id, arg_min(rule, k) AS rule, arg_min(license, k) AS license FROM hits GROUP BY doc_id),
    every AS (SELECT doc_id, string_agg(license, ',' ORDER BY k) AS all_licenses FROM firsts GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sequence, '') AS sequence, b.rule, b.license, coalesce(all_licenses, '') AS all_licenses
    FROM documents d LEFT JOIN seqs USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN every USING (doc_id)
    """


_EXACT = """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
    g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""

_CHAT = """
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns,
          string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat FROM t GROUP BY conv_id),
    g AS (SELECT turns, chat, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, chat)
    SELECT conv_id, len(turns)::BIGINT AS n_turns, n_copies, chat FROM g
    WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.turns[1] = g.turns[1] AND len(b.turns) > len(g.turns) AND b.turns[1:len(g.turns)] = g.turns)
"""

_LINES = r"""
    WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    u AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM l),
    r AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM u),
    f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth, count(*) OVER (PARTITION BY body) AS copies FROM r WHERE body IS NOT NULL AND regexp_matches(body, '\S')),
    g AS (SELECT doc_id, i FROM f WHERE nth > 1),
    firsts AS (SELECT doc_id, i + unnest([-1, 0, 1]) AS i FROM f WHERE nth = 1 AND copies > 1),
    cut AS (SELECT doc_id, i FROM g ANTI JOIN firsts USING (doc_id, i)),
    covered AS (SELECT doc_id, i, true AS gone FROM cut UNION SELECT doc_id, i + 1, true FROM cut),
    kept AS (SELECT doc_id, count(*) - 1 AS n_runs, count(gone) AS lines_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '') AS body
          FROM u LEFT JOIN covered USING (doc_id, i) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_repeated FROM g GROUP BY doc_id)
    SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE body END AS text, n_runs, coalesce(n_repeated, 0)::BIGINT AS n_repeated, lines_removed, sha256(body) AS text_sha256
    FROM kept JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
"""


_NGRAMS = r"""
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
    FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

_VECTORS = """
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
           AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
              WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SEARCH = rf"""
    WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    i AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    q AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL),
    p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
    g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
    m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, g),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
    s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 20
"""

#: crc32 is written out: a table by the reversed polynomial, then a step for each byte of a distinct word.
_RESAMPLE = rf"""
    WITH crc AS (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
    e AS (SELECT doc_id, unnest(words) AS word FROM d),
    b AS (SELECT unnest(list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS word FROM benchmark),
    v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM e UNION SELECT word FROM b)),
    k AS (SELECT word, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::UBIGINT)),
          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255::UBIGINT)::BIGINT + 1]))) % 10000 AS bucket FROM v, crc),
    s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
    a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
    g AS (SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
          FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
    w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM e JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
    c AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
          coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
    f AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM c WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM c LEFT JOIN f USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _license(), "op3_exact_dedup": _EXACT, "op4_ngram_jaccard_join": _NGRAMS, "op5_chat_format": _CHAT, "op7_line_dedup": _LINES, "op10_embedding_near_dedup": _VECTORS, "op11_lexical_search": _SEARCH, "op12_importance_resampling": _RESAMPLE}
