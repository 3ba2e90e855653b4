"""SQL for DuckDB of the text queries that SQL can express."""

from __future__ import annotations

from .collocations import ABSORBED, LEAST, LONGEST, TOP
from .fingerprints import BASE, K, LAST, MODULUS, PIECE, WINDOW
from .ngram_join import PERCENT, WORDS

_ROLL = "h[i]"
for _j in range(1, K):
    _ROLL = f"({_ROLL} * {BASE} + h[i + {_j}]) % {MODULUS}"


def _prints(source: str, text: str) -> str:
    """Common tables that end in {source}_p(doc_id, p): places and hashes of the fingerprints, as place * 2^31 + hash."""
    return f"""
{source}_h AS (SELECT rid, list_transform(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]{{1,{PIECE}}}'), lambda t: ('0x' || md5(t)[1:8])::BIGINT % {MODULUS}) AS h FROM {source}),
{source}_g AS (SELECT rid, CASE WHEN len(h) = 0 THEN [] WHEN len(h) < {K} THEN [list_reduce(h, lambda a, x: (a * {BASE} + x) % {MODULUS})] ELSE list_transform(range(1, len(h) - {K - 2}), lambda i: {_ROLL}) END AS g FROM {source}_h),
{source}_w AS (SELECT rid, list_transform(range(1, len(g) + 1), lambda i: g[i] * 4294967296 + ({LAST} - (i - 1))) AS w FROM {source}_g),
{source}_p AS (
  SELECT rid, list_sort(list_distinct(list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - {WINDOW - 1}, 1) + 1 END), lambda i: (({LAST} - (list_min(w[i:i + {WINDOW - 1}]) & {LAST})) * 2147483648 + (list_min(w[i:i + {WINDOW - 1}]) >> 32))::BIGINT))) AS p FROM {source}_w)"""


_TEXT = "list_aggregate(list_transform({0}, lambda x: (x % 2147483648)::VARCHAR || ':' || (x // 2147483648)::VARCHAR), 'string_agg', ',')"
_SET = "list_distinct(list_transform({0}, lambda x: x % 2147483648))"


def _likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({_SET.format(a)}, {_SET.format(b)}))"
    union = f"(len({_SET.format(a)}) + len({_SET.format(b)}) - {both})"
    return f"CASE WHEN {union} = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / {union}::DOUBLE END"


OP8 = f"""WITH own AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS rid FROM documents),
both_texts AS (SELECT *, coalesce(lead(text) OVER (ORDER BY rid), first_value(text) OVER (ORDER BY rid)) AS next, coalesce(lead(rid) OVER (ORDER BY rid), 1) AS next_rid FROM own),
edits AS (SELECT rid, doc_id, next_rid, length(text) AS n, left(text, length(text) - length(text) // 4) || left(next, length(text) // 4) AS edited FROM both_texts),{_prints("own", "text")},{_prints("edits", "edited")}
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, coalesce({_TEXT.format("a.p")}, '') AS fingerprint, coalesce({_TEXT.format("b.p")}, '') AS edited_fingerprint,
  {_likeness("a.p", "b.p")} AS near_edited, {_likeness("a.p", "c.p")} AS near_next
FROM edits e JOIN own_p a ON a.rid = e.rid JOIN edits_p b ON b.rid = e.rid JOIN own_p c ON c.rid = e.next_rid"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {g * 5 + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)

OP9 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM q"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP10 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM words),
entries AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM entries x JOIN entries y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * o >= {PERCENT} * (len(x.s) + len(y.s) - o)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)"""

OP12 = """WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.x, b.x)::BIGINT AS score FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other))::INT AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 3"""

_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {n} AS k, array_to_string([{', '.join(f'w{i}' for i in range(n))}], ' ') AS phrase, count(*) AS a FROM placed WHERE w{n - 1} IS NOT NULL GROUP BY 1, 3 HAVING count(*) >= {LEAST}" for n in range(1, LONGEST + 1)
)

OP13 = f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
split AS MATERIALIZED (SELECT id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
pieces AS MATERIALIZED (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM split),
words AS (SELECT id, lang, unnest(ws) AS w0, generate_subscripts(ws, 1) AS i FROM pieces),
placed AS MATERIALIZED (SELECT lang, w0, {", ".join(f"lead(w0, {n}) OVER (PARTITION BY id ORDER BY i) AS w{n}" for n in range(1, LONGEST))} FROM words),
totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY 1),
counts AS MATERIALIZED ({_GRAMS}),
longer AS (SELECT lang, k - 1 AS k, unnest([array_to_string(string_split(phrase, ' ')[:-2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase, a FROM counts WHERE k > 2),
absorbed AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY 1, 2),
cuts AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.a, f.a AS l, r.a AS r, cut, (2000000::HUGEINT * c.a) // (f.a + r.a) AS score FROM cuts c
  JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(p[:cut], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(p[cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT s.* FROM lowest s LEFT JOIN absorbed b ON b.lang = s.lang AND b.phrase = s.phrase WHERE b.most IS NULL OR 100::HUGEINT * b.most < {ABSORBED}::HUGEINT * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= {TOP}"""

ORACLE_SQL = {"op8_winnowing": OP8, "op9_warc": OP9, "op10_ngram_join": OP10, "op12_hard_negatives": OP12, "op13_collocations": OP13}
