"""DuckDB SQL for the queries that SQL can express."""

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, upper(sha1(body)) AS hex,
         min(page_id) OVER (PARTITION BY body) AS first_id
  FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda j:
    list_aggregate(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(hex, CAST(5 * j + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')
  ), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


OP2 = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS body, text,
    string_split(CASE WHEN regexp_matches(text, '[0-9]')
      THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x: array_to_string(list_transform(
        regexp_extract_all(x, '\s+|\S+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), '')), chr(10))
      ELSE coalesce(text, '') END, chr(10)) AS shown,
    string_split(coalesce(text, ''), chr(10)) AS raw
  FROM documents
), e AS (
  SELECT doc_id, body, unnest(range(0, len(shown))) AS no, unnest(shown) AS line FROM l
), s AS (
  SELECT *, len(string_split(line, ' ')) AS words, array_to_string(string_split(line, ' ')[1:3], ' ') AS lead
  FROM e WHERE trim(line, ' ') <> ''
), kinds AS (
  SELECT words, lead, line, count(*) AS n FROM (SELECT DISTINCT doc_id, body, no, words, lead, line FROM s) GROUP BY ALL
), several AS (
  SELECT words, lead FROM kinds GROUP BY ALL HAVING count(*) > 1
), tokens AS (
  SELECT words, lead, place, word, sum(n) AS n FROM (
    SELECT words, lead, n, unnest(range(0, words)) AS place, unnest(string_split(line, ' ')) AS word
    FROM kinds SEMI JOIN several USING (words, lead)) GROUP BY ALL
), most AS (
  SELECT words, lead, list(word ORDER BY place) AS most FROM (
    SELECT *, row_number() OVER (PARTITION BY words, lead, place ORDER BY n DESC, word DESC) AS r FROM tokens) WHERE r = 1 GROUP BY ALL
), under AS (
  SELECT k.words, k.lead, k.line FROM kinds k JOIN most m USING (words, lead)
  WHERE len(list_filter(list_zip(string_split(k.line, ' '), m.most), lambda z: z[1] = z[2])) >= 0.8 * k.words
), named AS (
  SELECT s.doc_id, s.body, s.no, CASE WHEN u.line IS NULL THEN 'L' || s.line ELSE 'T' || s.words || ' ' || s.lead END AS template
  FROM s LEFT JOIN under u ON s.line = u.line
), recur AS (
  SELECT template, count(*) AS docs, min(doc_id) AS keeper FROM (SELECT DISTINCT template, doc_id, body FROM named) GROUP BY 1 HAVING count(*) >= 10
), gone AS (
  SELECT doc_id, body, list(DISTINCT no) AS nos FROM named JOIN recur USING (template) WHERE doc_id <> keeper GROUP BY ALL
), kept AS (
  SELECT l.doc_id, CAST(CASE WHEN l.text IS NULL THEN 0 ELSE len(raw) END AS BIGINT) AS n_lines, CAST(coalesce(len(nos), 0) AS BIGINT) AS n_dropped,
    CASE WHEN nos IS NULL THEN l.text ELSE array_to_string(list_transform(list_filter(range(0, len(raw)), lambda i: NOT list_contains(nos, i)), lambda i: raw[i + 1]), chr(10)) END AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.body = g.body
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256, text FROM kept
"""

OP6 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w WHERE len(words) >= 50
), k AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos : pos + 49], ' ')) AS k FROM s
), m AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS first_id FROM k
), c AS (
  SELECT doc_id, list(pos) AS ats FROM m WHERE first_id < doc_id GROUP BY 1
), g AS (
  SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS place FROM (SELECT doc_id, unnest(ats) AS a FROM c)
), p AS (
  SELECT doc_id, list(place) AS places, count(*) AS n FROM g GROUP BY 1
), x AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM w
), kept AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY place) AS body FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.place = g.place GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[pos : pos + 4], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), b AS (
  SELECT x.doc_id AS a, y.doc_id AS z, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, z FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = z WHERE 100 * b.n >= 85 * (p.n + q.n - b.n)
), u AS (
  SELECT a, z FROM e UNION SELECT z, a FROM e
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, u.z FROM r JOIN u ON u.a = r.seen
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""

OP9 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (
  SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM t
)
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM g
"""


def _op11(levels: int = 6, upper: int = 4) -> str:
    """Trees of up to 16 ** levels leaves a source and 16 ** upper sources, a common table expression a level."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    value = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    digest = lambda text: "sha256(concat(" + ", ".join(value.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    crc = "list_reduce([4294967295] || flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(substr(id, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    out = [
        f"d AS (SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS id, {digest('text')} AS leaf, {digest('(' + lower + ')')} AS touched FROM documents)",
        f"l AS (SELECT *, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN touched ELSE leaf END AS cur, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "n0 AS (SELECT source AS g, pos, leaf AS h FROM l)",
    ]

    def climb(name: str, depth: int) -> None:
        for k in range(depth):
            out.append(f"{name}r{k} AS (SELECT g, pos // 16 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT g, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")

    climb("n", levels)
    out.append(f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, g AS source FROM n{levels})")
    climb("t", upper)
    out.append("p0 AS (SELECT l.doc_id, l.leaf, l.cur, l.pos, l.source, t0.pos AS top, t0.h AS subroot, '' AS sib FROM l JOIN t0 ON l.source IS NOT DISTINCT FROM t0.source)")
    steps = [(f"nr{k}", "p.source", f"p.pos // {16**k}") for k in range(levels)] + [(f"tr{k}", "0", f"p.top // {16**k}") for k in range(upper)]
    for k, (runs, g, at) in enumerate(steps):
        j = f"CAST(({at}) % 16 AS BIGINT)"
        before, after = f"array_to_string(hs[1:{j}], '')", f"array_to_string(hs[{j} + 2:], '')"
        out.append(
            f"p{k + 1} AS (SELECT p.doc_id, p.leaf, p.pos, p.source, p.top, p.subroot, CASE WHEN n = 1 THEN p.sib ELSE concat(p.sib, {before}, {after}) END AS sib,"
            f" CASE WHEN n = 1 THEN p.cur ELSE sha256(concat({before}, p.cur, {after})) END AS cur FROM p{k} p JOIN {runs} r ON r.g IS NOT DISTINCT FROM {g} AND r.run = ({at}) // 16)"
        )
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM p{len(steps)}, t{upper}"


OP11 = _op11()

# As for op8, on runs of four words.
OP13 = OP8.replace("pos + 4", "pos + 3").replace("len(words) - 4", "len(words) - 3").replace("c.component_id, w.doc_id = c.component_id AS kept", "c.component_id")

OP12 = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*) FILTER (len(terms) > 0) AS N, CAST(sum(len(terms)) AS BIGINT) AS L FROM t
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM t) GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, N
), d AS (
  SELECT r, doc_id, 50 + (50 * len(terms) * N) // L AS m FROM t, s WHERE len(terms) > 0
), x AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x JOIN d USING (r) WHERE score > 0) WHERE rank <= 50
"""

ORACLES = {"op1_warc": OP1, "op2_lines": OP2, "op6_substrings": OP6, "op8_near": OP8, "op9_exact": OP9, "op11_merkle": OP11, "op12_lexical": OP12, "op13_ngram_join": OP13}
