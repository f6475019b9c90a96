"""DuckDB SQL of the operators that SQL can express on whole tables."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"


def _leads(n: int, word: str = "w") -> str:
    """The words from here on, up to n of one text, with blanks between."""
    return f"concat_ws(' ', {word}, " + ", ".join(f"lead({word}, {k}) OVER o" for k in range(1, n)) + ")"


_NEAR = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, i, n, {_leads(4)} AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= greatest(1, n - 3)),
c AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id), x AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 80 * (ca.n + cb.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.b AS component_id, m.b = d.doc_id AS kept FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CLEAN = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_BENCH_WORD}') AS ws FROM benchmark), bp AS (SELECT item, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM b),
g AS (SELECT DISTINCT item, w AS first, s, least(13, n) AS k FROM (SELECT item, w, i, n, {_leads(13)} AS s FROM bp WINDOW o AS (PARTITION BY item ORDER BY i)) WHERE i <= greatest(1, n - 12)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BENCH_WORD}') AS ws FROM documents), dp AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d), dw AS (SELECT doc_id, i, w, {_leads(13)} AS s FROM dp WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT dw.doc_id, dw.i, g.k, g.item FROM dw JOIN g ON dw.w = g.first AND starts_with(dw.s || ' ', g.s || ' ')),
n AS (SELECT doc_id, COUNT(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS place FROM h) GROUP BY doc_id), t AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

_BOILERPLATE = "all rights reserved|licensed under|terms of (?:use|service)|privacy policy|cookie policy|use cookies|enable javascript|sign up|log in|subscribe to|click here|skip to content|share this"
_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
g AS (SELECT doc_id, i, CASE WHEN i <= n - 7 THEN {_leads(8)} END AS s FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)), u AS (SELECT doc_id, i, s IS NOT NULL AND COUNT(*) OVER (PARTITION BY doc_id, s) > 1 AS twice FROM g),
v AS (SELECT doc_id, COUNT(*) FILTER (m) AS n_repeat_words FROM (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM u) GROUP BY doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_SPACED}')) AS nw, length(array_to_string(regexp_extract_all(line, '{_SPACED}'), '')) AS chars, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS caps,
 length(regexp_replace(line, '[^|>»•]', '', 'g')) AS navs, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT *, CASE WHEN 4 * navs >= greatest(12, nw) THEN 'navigation' WHEN 4 * syms >= greatest(12, nw) THEN 'symbols' WHEN letters >= 20 AND 10 * caps > 6 * letters THEN 'shouting' WHEN regexp_matches(line, '(?i){_BOILERPLATE}') THEN 'boilerplate'
 WHEN regexp_matches(line, '[.!?…。！？]["''”’»)\]]*[\x20\x09-\x0D]*\z') THEN NULL ELSE 'punctuation' END AS rule FROM l WHERE nw > 0),
a AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS dup, SUM(chars) AS chars, SUM(chars) FILTER (rule IS NOT NULL) AS lost, {", ".join(f"COUNT(*) FILTER (rule = '{r}') AS lines_{r}" for r in ("punctuation", "navigation", "symbols", "shouting", "boilerplate"))} FROM f GROUP BY doc_id),
z AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars,
 {", ".join(f"coalesce(lines_{r}, 0) AS lines_{r}" for r in ("punctuation", "navigation", "symbols", "shouting", "boilerplate"))} FROM d LEFT JOIN v USING (doc_id) LEFT JOIN a USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= word_chars AS kept FROM z"""

#: crc32, bit by bit from the lowest: 3988292384 is its reversed polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda b: (ord(ch) >> b) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(_field("text"))} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(_field(_LOWER))} END AS other FROM documents),
s AS (SELECT source, CAST(row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS BIGINT) AS tree, CAST(COUNT(*) AS BIGINT) AS n FROM d GROUP BY source), trees AS (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM s),
l AS (SELECT d.*, tree, s.n, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS i FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t(tree, level, i, n, h) AS (SELECT tree, CAST(0 AS BIGINT), i, n, leaf FROM l UNION ALL SELECT tree, level + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, level, i // 16),
top(tree, level, i, n, h) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), t.tree, trees.n, h FROM t, trees WHERE t.n = 1 UNION ALL SELECT tree, level + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY tree, level, i // 16),
nodes AS (SELECT * FROM t WHERE n > 1 UNION ALL SELECT * FROM top), runs AS (SELECT tree, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM nodes GROUP BY ALL),
p(doc_id, leaf, tree, level, i, n, sub, h, proof) AS (SELECT doc_id, leaf, CASE WHEN l.n = 1 THEN -1 ELSE tree END, CAST(0 AS BIGINT), CASE WHEN l.n = 1 THEN tree ELSE l.i END, CASE WHEN l.n = 1 THEN trees.n ELSE l.n END, tree, coalesce(other, leaf), '' FROM l, trees
 UNION ALL SELECT doc_id, leaf, CASE WHEN up THEN -1 ELSE tree END, CASE WHEN up THEN 0 ELSE level + 1 END, CASE WHEN up THEN sub ELSE i // 16 END, CASE WHEN up THEN total ELSE (n + 15) // 16 END, sub, sha256(before || h || after), proof || before || after
 FROM (SELECT p.*, p.tree >= 0 AND p.n <= 16 AS up, trees.n AS total, array_to_string(hs[1 : p.i % 16], '') AS before, array_to_string(hs[p.i % 16 + 2 :], '') AS after FROM p JOIN runs ON runs.tree = p.tree AND runs.level = p.level AND runs.run = p.i // 16, trees WHERE p.n > 1))
SELECT doc_id, leaf, b.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, p.h AS folded_root, p.h = r.h AS verified FROM p JOIN top b ON b.level = 0 AND b.i = p.sub, (SELECT h FROM top WHERE n = 1) r WHERE p.tree = -1 AND p.n = 1"""

#: Base32 of a hexadecimal digest: every five bits lie within two digits of four.
_BASE32 = "list_aggregate(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(((strpos('0123456789abcdef', h[5 * k // 4 + 1]) - 1) * 16 + greatest(strpos('0123456789abcdef', h[5 * k // 4 + 2]) - 1, 0)) // (8 >> (5 * k % 4)) % 32 + 1 AS INTEGER)]), 'string_agg', '')"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, row_number() OVER (ORDER BY page_id) AS i FROM pages), d AS (SELECT page_id, i, t, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
w AS (SELECT *, first_value(page_id) OVER o AS top, first_value(i) OVER o AS first FROM d WINDOW o AS (PARTITION BY t ORDER BY page_id DESC NULLS LAST, i DESC))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN i = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN i <> first THEN top END AS refers_to FROM w"""

_NEAREST = "SELECT p.id, p.part, p.v, arg_min(c.entry, {{'d': list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.entry}}) AS entry, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS error FROM p JOIN c{r} c USING (part) GROUP BY p.id, p.part, p.v"


def _round(r: int) -> str:
    mean = "(t - ((t % n) + n) % n) // n"
    return f"""a{r} AS MATERIALIZED ({_NEAREST.format(r=r)}), m{r} AS (SELECT part, entry, list(CAST({mean} AS BIGINT) ORDER BY place) AS v FROM (SELECT part, entry, place, SUM(x) AS t, COUNT(*) AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (part, entry))"""


_CODES = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS ns FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, ns[part * (len(ns) // 8) + 1 : (part + 1) * (len(ns) // 8)] AS v FROM e, range(8) AS r(part)), c0 AS MATERIALIZED (SELECT part, id AS entry, v FROM p WHERE id < 16),
{", ".join(_round(r) for r in range(6))}, a6 AS MATERIALIZED ({_NEAREST.format(r=6)}), s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6),
f AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(SUM(error) AS BIGINT) AS error FROM a6 GROUP BY id)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN e USING (id), s"""

#: The strings of 200 bytes take SQL over a minute on the second smallest tables; op6 is tested by brute force instead.
SQL: dict[str, str] = {"op1_near_duplicates": _NEAR, "op3_decontaminate": _CLEAN, "op8_quality_rules": _RULES, "op11_warc": _WARC, "op12_vector_codes": _CODES, "op13_merkle_manifest": _MERKLE}
