"""DuckDB SQL for the numbered operators that SQL can express."""

from nightlights.llm import entropy
from nightlights.llm.quality import LINE_SHARE, NGRAM_SHARES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _ngram(n: int) -> str:
    return f"""
g{n} AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') g FROM pos WHERE i + {n - 1} <= n_words),
r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM g{n}) WHERE c > 1),
c{n} AS (SELECT doc_id, count(*) n, sum(length(w)) chars FROM (SELECT DISTINCT r.doc_id, r.i + k.k i FROM r{n} r, range({n}) k(k)) JOIN word USING (doc_id, i) GROUP BY doc_id)"""


OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') text, {_WORDS} ws FROM documents),
pos AS (SELECT doc_id, ws, len(ws) n_words, unnest(range(1, len(ws) + 1)) i FROM d),
word AS (SELECT doc_id, i, ws[i] w FROM pos),
{",".join(_ngram(n) for n in (3, *NGRAM_SHARES))},
line AS (SELECT doc_id, l, count(*) c, list_sum(list_transform(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) chars
         FROM (SELECT doc_id, unnest(string_split(text, chr(10))) l FROM d) GROUP BY doc_id, l HAVING len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) > 0),
lines AS (SELECT doc_id, sum(c - 1) n, sum((c - 1) * chars) chars FROM line GROUP BY doc_id),
base AS (SELECT d.doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) n_symbols, coalesce(lines.n, 0) n_dup_lines, coalesce(c3.n, 0) n_repeat_words, coalesce(lines.chars, 0) line_chars,
  {", ".join(f"coalesce(c{n}.chars, 0) chars{n}" for n in NGRAM_SHARES)}
  FROM d LEFT JOIN lines USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in (3, *NGRAM_SHARES))}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM base)
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words, base_failed,
  NOT base_failed AND line_chars <= {LINE_SHARE}::DOUBLE * word_chars AND {" AND ".join(f"chars{n} <= {s}::DOUBLE * word_chars" for n, s in NGRAM_SHARES.items())} kept
FROM f"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h FROM pages),
bits AS (SELECT DISTINCT h, list_aggregate(list_transform(range(20), lambda k: lpad(bin(('0x' || substr(h, (2 * k + 1)::INT, 2))::INT), 8, '0')), 'string_agg', '') b FROM p),
d AS (SELECT h, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CASE substr(b, (5 * k + j + 1)::INT, 1) WHEN '1' THEN (16 >> j::INT) ELSE 0 END))::INT, 1)), 'string_agg', '') digest FROM bits),
f AS (SELECT h, min(page_id) first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT payload_bytes, digest payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END refers_to, true sound
FROM p JOIN d USING (h) JOIN f USING (h)"""

OP7 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') esc, replace(replace(role, '&', '&amp;'), '<', '&lt;') esc_role FROM t)
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
  sum(length(esc) + length(esc_role) + 8 + 8 + 7)::BIGINT formatted_chars
FROM e GROUP BY conv_id"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') item_id, {_ALNUM} ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') g FROM (SELECT item_id, ws, least(10, len(ws)) n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) i FROM b WHERE len(ws) > 0)),
size AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM d, size WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
w AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: Windows of one document are named by md5 of their words; words hold no spaces.
OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM d WHERE len(ws) >= 50)),
least AS (SELECT g, min(doc_id) first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k i FROM (SELECT doc_id, i FROM win JOIN least USING (g) WHERE first < doc_id), range(50) t(k)),
word AS (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) i FROM d),
left_over AS (SELECT doc_id, count(*) n, string_agg(w, ' ' ORDER BY i) kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT n_words, (len(ws) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)"""

#: Strings of 50 bytes are 100 hexadecimal digits. Those whose 64-bit hash only one document has can't repeat; the others are compared whole.
OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) hx FROM documents),
win AS (SELECT doc_id, i, hash(substr(hx, 2 * i + 1, 100)) g FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 49)) i FROM d WHERE len(hx) >= 100)),
shared AS (SELECT g FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
again AS (SELECT doc_id, i, substr(hx, 2 * i + 1, 100) s FROM win JOIN shared USING (g) JOIN d USING (doc_id)),
cut AS (SELECT doc_id, i FROM again JOIN (SELECT s, min(doc_id) first FROM again GROUP BY s) USING (s) WHERE first < doc_id),
edge AS (SELECT doc_id, i, i > 50 + lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) starts FROM cut),
run AS (SELECT doc_id, min(i) lo, max(i) + 50 hi FROM (SELECT doc_id, i, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) r FROM edge) GROUP BY doc_id, r),
kept AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) before FROM run),
piece AS (SELECT doc_id, sum(hi - lo) n_removed, count(*) n_spans, string_agg(substr(hx, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(hx), 2 * max(hi) + 1) left_over
  FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(hx) // 2)::BIGINT n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0)::BIGINT n_spans, sha256(unhex(coalesce(left_over, hx))) kept_sha256
FROM d LEFT JOIN piece USING (doc_id)"""

_QUOTE = str.maketrans({"'": "''"})


def _matches(kind: int, pattern: str) -> str:
    """Places of a pattern's matches: those of the texts between them added up."""
    quoted = pattern.translate(_QUOTE)
    return f"""m{kind} AS (SELECT doc_id, f, sum(length(b) + length(f)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT e
  FROM (SELECT doc_id, unnest(fs) f, unnest(string_split_regex(text, '{quoted}')[1:len(fs)]) b, generate_subscripts(fs, 1) k FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') fs FROM d)))"""


_CLASS = " ".join(f"WHEN regexp_matches(f, '{p}') THEN {k}" for k, p, _ in entropy.CLASSES)
_ALLOWED = " OR ".join([*(f"contains(lower(f), '{x}')" for x in entropy.ALLOWED), *(f"regexp_matches(f, '{x}')" for x in entropy.ALLOWED_PATTERNS)])
_LIMIT = " ".join(f"WHEN {k} THEN {v}" for k, v in entropy.LIMITS.items())
_KIND = "['" + "', '".join(entropy.KINDS) + "'][kind + 1]"
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') text FROM documents),
{_matches(0, entropy.ASSIGN)}, {_matches(1, entropy.ACCESS)}, {_matches(2, entropy.HEX)}, {_matches(3, entropy.CANDIDATE)},
cand AS (SELECT doc_id, f, e - length(f) s, CASE {_CLASS} END kind FROM m3 WHERE NOT ({_ALLOWED})),
win AS (SELECT doc_id, s, kind, i, list_sum(list_transform(map_values(list_aggregate(string_split(substr(f, i + 1, {entropy.WINDOW}), ''), 'histogram')), lambda n: {entropy.WEIGHTS}[n::INT + 1])) w
  FROM (SELECT *, unnest(range(length(f) - {entropy.WINDOW - 1})) i FROM cand)),
hot AS (SELECT doc_id, s, kind, i, i > {entropy.WINDOW} + lag(i, 1, -1000) OVER (PARTITION BY doc_id, s ORDER BY i) starts FROM win WHERE w <= CASE kind {_LIMIT} END),
island AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, s ORDER BY i) r FROM hot),
spans AS (SELECT doc_id, e - length(f) s, 0 kind, e FROM m0 WHERE length(regexp_extract(f, '{entropy.ASSIGN.translate(_QUOTE)}', 2)) >= {entropy.MIN_VALUE}
  UNION ALL SELECT doc_id, e - length(f), 1, e FROM m1 UNION ALL SELECT doc_id, e - length(f), 2, e FROM m2
  UNION ALL SELECT doc_id, s + min(i), kind, s + max(i) + {entropy.WINDOW} FROM island GROUP BY doc_id, s, kind, r),
told AS (SELECT doc_id, kind, s, e, {_KIND} || ':' || s::BIGINT || ':' || e::BIGINT t FROM spans),
base AS (SELECT doc_id, string_agg(t, ',' ORDER BY s, kind, e) t, count(*) FILTER (kind = 0) a, count(*) FILTER (kind = 1) b, count(*) FILTER (kind = 2) c FROM told WHERE kind < 3 GROUP BY doc_id),
whole AS (SELECT doc_id, string_agg(t, ',' ORDER BY s, kind, e) t FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT n_assign, coalesce(b, 0)::BIGINT n_access, coalesce(c, 0)::BIGINT n_hex, sha256(coalesce(base.t, '')) base_sha256, coalesce(whole.t, '') spans
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN whole USING (doc_id)"""


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The checksum goes byte by byte over the hexadecimal digits; words are near if one is left when both lose, or one loses, a code point.
OP12 = f"""
WITH RECURSIVE run AS (SELECT doc_id, w, count(*) c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) w FROM documents) GROUP BY ALL),
hx AS (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || w)) x FROM run),
crc AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, list_extract({_crc_table()}::BIGINT[], (xor(a, b) & 255)::INT + 1))), 4294967295::BIGINT) h FROM hx),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END word, c FROM crc),
word AS (SELECT word, sum(c)::BIGINT n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) x FROM (SELECT word, n, unnest(range(length(word))) i FROM word)),
near AS (SELECT DISTINCT a.word, b.word other, b.n m FROM less a JOIN less b USING (x, i) WHERE a.word <> b.word
  UNION SELECT less.word, word.word, word.n FROM less JOIN word ON less.x = word.word UNION SELECT word.word, less.word, less.n FROM less JOIN word ON less.x = word.word),
best AS (SELECT word, count(*) n_near, max(m) m FROM near GROUP BY word),
form AS (SELECT word, min(other) form, any_value(near.m) form_n FROM near JOIN best USING (word) JOIN word USING (word) WHERE near.m = best.m AND best.m >= 2 * n GROUP BY word),
way AS (SELECT word, form upto FROM form UNION ALL SELECT way.word, form.form FROM way JOIN form ON way.upto = form.word),
root AS (SELECT word, upto root FROM way WHERE NOT EXISTS (SELECT 1 FROM form f WHERE f.word = way.upto))
SELECT word, form, coalesce(root, word) root, n, coalesce(n_near, 0)::BIGINT n_near, form_n FROM word LEFT JOIN best USING (word) LEFT JOIN form USING (word) LEFT JOIN root USING (word)"""

OP13 = rf"""
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, row_number() OVER () r, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws FROM documents),
w AS (SELECT lang, source, r, unnest(ws) term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
size AS (SELECT lang, count(*) v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT lang, source, term, coalesce(c, 0) c, v FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, (1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v))::BIGINT p FROM cell),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)))::BIGINT q FROM p GROUP BY lang, term),
near AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::BIGINT AS "value" FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN near ON near.lang = a.lang AND near.source = a.source AND near.item = b.source),
term AS (SELECT lang, source, 'term' part, term item, ((p - q) * (p - q) // q)::BIGINT AS "value" FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200"""

ORACLES = {"op11_secrets": OP11, "op12_spelling": OP12, "op13_divergence": OP13, "op8_substring": OP8, "op10_suffix_array": OP10, "op4_warc": OP4, "op6_quality": OP6, "op7_chat": OP7, "op9_decontamination": OP9}
