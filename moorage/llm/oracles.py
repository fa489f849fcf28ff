"""SQL for DuckDB that gives the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

from . import fill_middle, license_scan, quality, spelling

_SPACE = r"\x20\x09-\x0D"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _bigrams(words: str) -> str:
    return f"CASE WHEN len({words}) > 1 THEN list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])) ELSE {words} END"


def _plain(text: str) -> str:
    return f"trim(regexp_replace(translate({text}, '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^a-z0-9]+', ' ', 'g'))"


def licenses() -> str:
    """op2: every distinct piece of a text against every template that has the same telling words."""
    known = ", ".join(f"({_text(name)}, {_text(s)})" for name, sentences in license_scan.TEMPLATES.items() for s in sentences)
    marks = ", ".join(map(_text, license_scan.TELLING))
    told = lambda x: f"list_filter([{marks}], lambda m: contains(' ' || {x} || ' ', ' ' || m || ' '))"
    weak = ", ".join(map(_text, license_scan.WEAK_NAMES))
    return rf"""
WITH t(license, sentence) AS (VALUES {known}), tw AS (SELECT license, {_plain('sentence')} AS p FROM t), tb AS (SELECT license, {_bigrams("string_split(p, ' ')")} AS own, {told('p')} AS tells FROM tw),
p AS (SELECT doc_id, string_split_regex(text, {_text(license_scan.PARAGRAPH)}) AS paragraphs, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list_concat(list_concat(lines, paragraphs), flatten(list_transform(paragraphs, lambda x: string_split_regex(x, {_text(license_scan.SENTENCE)})))) AS cut FROM p),
q AS (SELECT doc_id, unnest(list_distinct(list_transform(cut, lambda x: {_plain('x')}))) AS piece FROM c),
w AS (SELECT doc_id, piece, string_split(piece, ' ') AS w FROM q WHERE piece <> ''), b AS (SELECT doc_id, piece, {_bigrams('w')} AS pairs FROM w),
n AS (SELECT doc_id, piece, license, pairs, own, tells FROM b, tb WHERE list_has_any(pairs, own)),
s AS (SELECT doc_id, piece, license, max(CAST(2 * len(list_intersect(pairs, own)) AS DOUBLE) / (len(pairs) + len(own))) AS dice FROM n WHERE tells = {told('piece')} GROUP BY ALL),
m AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, piece) AS best FROM s),
f AS (SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) AS n_pieces FROM m WHERE dice = best AND dice >= {license_scan.THRESHOLD} GROUP BY doc_id, license)
SELECT * FROM f WHERE license NOT IN ({weak}) OR doc_id NOT IN (SELECT doc_id FROM f WHERE license NOT IN ({weak}))"""


def _reached(like: int) -> str:
    """Shingles joined with shingles, links on full sets, then all that is reached: tables sets (doc_id, own) and c (doc_id, component_id)."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS own FROM w),
s AS (SELECT doc_id, len(own) AS n, unnest(own) AS x FROM sets),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {like} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


def near_groups() -> str:
    """op7."""
    return f"{_reached(75)} SELECT doc_id, CAST(len(own) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN c USING (doc_id)"


def ngram_groups() -> str:
    """op12."""
    return f"{_reached(80)} SELECT doc_id, CAST(len(own) AS BIGINT) AS n_shingles, component_id FROM sets JOIN c USING (doc_id)"


def _measures() -> str:
    size = quality.WINDOW
    return rf"""
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM documents),
v AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {size - 1} + 1), lambda i: {{'i': i, 'x': array_to_string(w[i:i + {size - 1}], ' ')}})) AS v FROM w WHERE len(w) > {size}),
d AS (SELECT doc_id, v.i AS i, count(*) OVER (PARTITION BY doc_id, v.x) AS times FROM v),
g AS (SELECT doc_id, least({size}, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {size})) AS new FROM d WHERE times > 1),
r AS (SELECT doc_id, sum(new) AS n FROM g GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits, CAST(length(regexp_replace(text, '\PL', '', 'g')) AS BIGINT) AS n_letters
 FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, CAST({' + '.join(f'CASE WHEN {cond} THEN {1 << i} ELSE 0 END' for i, (_, cond) in enumerate(quality.RULES))} AS BIGINT) AS failed FROM m)"""


def ledger() -> str:
    """op8: the measurements, the bits, the verdicts."""
    return f"WITH {_measures()} SELECT *, (failed & {quality.mask(quality.POLICIES['base'])}) <> 0 AS base_failed, (failed & {quality.mask(quality.POLICIES['v2'])}) = 0 AS kept FROM f"


def ablations(policy: str) -> str:
    held = quality.POLICIES[policy]
    all_bits = quality.mask(held)
    rows = " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(count(*) FILTER (failed & {quality.mask([r])} <> 0) AS BIGINT) AS fails, CAST(count(*) FILTER (failed & {all_bits} = {quality.mask([r])}) AS BIGINT) AS alone FROM f" for r in held)
    return f"WITH {_measures()} {rows}"


def trials() -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS policy, * FROM ({ablations(p)})" for p in sorted(quality.POLICIES))


def spelling_words() -> str:
    """The checksum byte by byte, its table from the polynomial."""
    table = "list_transform(range(256), lambda b: list_reduce(range(8), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b))"
    return rf"""t AS MATERIALIZED (SELECT {table} AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
times AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), 128 + (unicode(c) & 63)] END)) AS b FROM times),
crc AS (SELECT doc_id, run, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, t.t[1 + (xor(c, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, t),
cut AS (SELECT CASE WHEN h % {spelling.ODD} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM crc),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(times) >= {spelling.LEAST_TIMES})"""


def spelling_groups() -> str:
    """op11: words compared with words of like length. The distance counts bytes, so the letters beyond ASCII are told as other single ones."""
    wide, single = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(33, 97)))
    return rf"""
WITH RECURSIVE {spelling_words()},
own AS (SELECT word, n, translate(word, '{wide}', {_text(single)}) AS w, length(word) AS len FROM words),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM own a JOIN own b ON b.len BETWEEN a.len - 1 AND a.len + 1 AND a.word <> b.word WHERE levenshtein(a.w, b.w) = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.FACTOR} * n THEN other END AS form, CASE WHEN m >= {spelling.FACTOR} * n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def fill_in_middle() -> str:
    """op13: one unit is one code point, so offsets are the cuts themselves."""
    h = lambda i: f"CAST('0x' || substr(h, {8 * i - 7}, 8) AS BIGINT)"
    plain = f"n = 0 OR regexp_matches(text, '{fill_middle.ANY_MARK}') OR {h(3)} % 100 >= {100 - fill_middle.PLAIN}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('{fill_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
f AS (SELECT *, CASE WHEN {plain} THEN 'plain' WHEN {h(4)} % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form, least({h(1)} % (n + 1), {h(2)} % (n + 1)) AS a, greatest({h(1)} % (n + 1), {h(2)} % (n + 1)) AS b FROM d),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
