"""SQL of the rules around Hangul and the lexicon, built over the same seeds and fixed values; each function gives CTEs by name."""

from __future__ import annotations

from ..functions import hangul
from ..functions import normalize as N
from ..operators import lexicon


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(lit, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def token_sql(token: str) -> str:
    """A Hangul or Latin token, normalised; numbers are not handled here."""
    t = f"lower(trim({token}))"
    bare = f"CASE WHEN length({t}) <= 2 THEN {t} ELSE regexp_replace({t}, '^(.{{2,}}?)(?:{'|'.join(N.PARTICLES)})$', '\\1') END"
    ending = lambda x: f"regexp_replace({x}, '^(.{{2,}}?)(?:{'|'.join(N.ENDINGS)})$', '\\1')"
    return f"CASE WHEN regexp_full_match({t}, '[가-힣]+') THEN {ending(ending(bare))} ELSE regexp_replace({t}, '\\.+$', '') END"


def typos(source: str, out: str, limit: int) -> str:
    """out(word, t, variant): the first ``limit`` typing errors of source(word), in the order of their syllables."""
    vowels = [[hangul.JUNG.index((set(p) - {v}).pop()) for p in hangul.CONFUSED if v in p] for v in hangul.JUNG]
    near = {a + b for pairs in [[row[i : i + 2] for row in hangul.KEY_ROWS for i in range(len(row) - 1)], hangul.KEY_COLUMNS, hangul.SHIFTED] for a, b in pairs}
    initials = [sorted((hangul.CHO.index(o) for o in hangul.CHO if o != c and (c + o in near or o + c in near)), key=lambda i: hangul.CHO[i]) for c in hangul.CHO]
    return f"""{out}_c AS (SELECT word, i, x // 588 AS cho, (x % 588) // 28 AS jung, x % 28 AS jong FROM (SELECT word, i, unicode(substr(word, i, 1)) - 44032 AS x FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM {source})) WHERE x BETWEEN 0 AND 11171),
{out}_m AS (SELECT word, i, list_concat(list_concat(list_transform(CAST({lit(vowels)} AS INTEGER[][])[jung + 1], lambda v: chr((cho * 21 + v) * 28 + jong + 44032)), CASE WHEN jong > 0 THEN [chr((cho * 21 + jung) * 28 + 44032)] ELSE CAST([] AS VARCHAR[]) END),
 list_transform(CAST({lit(initials)} AS INTEGER[][])[cho + 1], lambda c: chr((c * 21 + jung) * 28 + jong + 44032))) AS made FROM {out}_c),
{out}_b AS (SELECT *, coalesce(sum(len(made)) OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {out}_m),
{out}_v AS (SELECT word, i, k, substr(word, 1, i - 1) || s || substr(word, i + 1) AS variant FROM (SELECT word, i, unnest(range(1, len(made) + 1)) AS k, unnest(made) AS s FROM {out}_b WHERE before < {3 * limit})),
{out}_f AS (SELECT word, variant, min(i * 1000 + k) AS place FROM {out}_v WHERE variant <> word GROUP BY word, variant),
{out} AS (SELECT word, t, variant FROM (SELECT word, variant, row_number() OVER (PARTITION BY word ORDER BY place) - 1 AS t FROM {out}_f) WHERE t < {limit})"""


def _letters(x: str) -> str:
    one = f"CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN substr({lit(hangul.CHO)}, (unicode(c) - 44032) // 588 + 1, 1) || substr({lit(hangul.JUNG)}, ((unicode(c) - 44032) % 588) // 28 + 1, 1) || {lit(hangul.JONG)}[(unicode(c) - 44032) % 28 + 1] ELSE c END"
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(array_to_string(list_transform(string_split({x}, ''), lambda c: {one}), ''), '') END"


def distances(source: str, out: str) -> str:
    """out(a, b, d, longest): the weighted distance of source(a, b), diagonal by diagonal. Needs WITH RECURSIVE."""
    both = lambda pairs: sorted({p for x in pairs for p in (x, x[::-1])})
    confused = both(hangul.CONFUSED)
    near = sorted(set(both([row[i : i + 2] for row in hangul.KEY_ROWS for i in range(len(row) - 1)] + hangul.KEY_COLUMNS + hangul.SHIFTED)) - set(confused))
    cost = f"CASE WHEN x[i] = y[k + 1 - i] THEN 0.0 WHEN list_contains({lit(confused)}, x[i] || y[k + 1 - i]) THEN {hangul.CONFUSED_COST} WHEN list_contains({lit(near)}, x[i] || y[k + 1 - i]) THEN {hangul.NEXT_KEY_COST} ELSE 1.0 END"
    return f"""{out}_r(a, b, x, y, k, p2, p1) AS (SELECT a, b, {_letters('a')}, {_letters('b')}, 0, CAST([] AS DOUBLE[]), CAST([0.0] AS DOUBLE[]) FROM (SELECT DISTINCT a, b FROM {source})
 UNION ALL SELECT a, b, x, y, k + 1, p1, list_transform(range(0, len(x) + 1), lambda i: CAST(CASE WHEN k + 1 - i < 0 OR k + 1 - i > len(y) THEN NULL WHEN i = 0 THEN k + 1 WHEN k + 1 = i THEN i ELSE least(p1[i] + 1, p1[i + 1] + 1, p2[i] + {cost}) END AS DOUBLE)) FROM {out}_r WHERE k < len(x) + len(y)),
{out} AS (SELECT a, b, p1[len(x) + 1] AS d, greatest(len(x), len(y)) AS longest FROM {out}_r WHERE k = len(x) + len(y))"""


def _inflectable(w: str) -> str:
    return f"(length({w}) >= 2 AND regexp_full_match({w}, '[가-힣]+') AND NOT regexp_matches({w}, '(하다|되다|다|음|함|기)$'))"


def lexicon_ctes(seeds: dict = lexicon.SEEDS) -> str:
    """made(rule, a, b, c, surface, canon), clusters(n, head, member) and words(surface, canon, origin, len): the rules over the seeds."""
    members = [(n, h, m) for n, (h, m) in enumerate((h, m) for h, ms in seeds["clusters"].items() for m in [h, *ms.split()])]
    pairs = lambda name: [(n, a, b) for n, (a, b) in enumerate(seeds[name].items())]
    forms = [(i, "", s) for i, s in enumerate(lexicon.SUFFIXES)] + [(len(lexicon.SUFFIXES) + i, p, "") for i, p in enumerate(lexicon.PREFIXES)]
    based = lambda name: f"{name}_b AS (SELECT t.n, t.surface, t.stands, coalesce(base, stands) AS base FROM {name} t LEFT JOIN canon_of o ON o.word = t.stands)"
    order = lambda names, x: "CASE " + " ".join(f"WHEN {x} = {lit(r)} THEN {i}" for i, r in enumerate(names)) + " END"
    caps = " ".join(f"WHEN rule = {lit(r)} THEN {c}" for r, c in lexicon.BUDGET if c)
    heads = ", ".join(map(lit, lexicon.HEADS))
    return f"""{values('clusters', 'n, head, member', members)}, {values('mistyped', 'n, word', list(enumerate(seeds['mistyped'])))}, {values('spellings', 'n, surface, stands', pairs('spellings'))}, {values('slang', 'n, surface, stands', pairs('slang'))}, {values('short', 'n, surface, stands', pairs('short'))},
{values('stems', 'n, stem', list(enumerate(lexicon.STEMS)))}, {values('endings', 'e, ending', list(enumerate(lexicon.INFLECTIONS)))}, {values('forms', 'f, pre, post', forms)},
canon_of AS (SELECT member AS word, arg_min(head, n) AS base, min(n) AS a FROM clusters GROUP BY member), {based('spellings')}, {based('slang')}, {based('short')},
affixed AS (SELECT n, f, stem, pre || stem || post AS word FROM stems, forms),
met AS (SELECT 0 AS g, a, word, base AS canon FROM canon_of UNION ALL SELECT 1, n, surface, base FROM spellings_b UNION ALL SELECT 2, n, surface, base FROM slang_b UNION ALL SELECT 3, n, surface, base FROM short_b),
targets AS (SELECT 0 AS g, a, word, base AS canon FROM canon_of UNION ALL SELECT -1, n, word, word FROM mistyped UNION ALL SELECT 1, n, stands, base FROM spellings_b UNION ALL SELECT 2, n, stands, base FROM short_b),
once AS (SELECT word, g * 100000 + a AS place, canon FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY g, a) AS k FROM targets) WHERE k = 1),
{typos('once', 'wrong', lexicon.TYPOS)},
every AS (SELECT 'seed' AS rule, n AS a, 0 AS b, 0 AS c, member AS surface, head AS canon FROM clusters UNION ALL SELECT 'variant', n, 0, 0, stands, base FROM spellings_b UNION ALL SELECT 'variant', n, 1, 0, surface, base FROM spellings_b
 UNION ALL SELECT 'collo', n, 0, 0, surface, base FROM slang_b UNION ALL SELECT 'abbr', n, 0, 0, stands, base FROM short_b UNION ALL SELECT 'abbr', n, 1, 0, surface, base FROM short_b
 UNION ALL SELECT 'affix-stem', n, 0, 0, stem, stem FROM stems UNION ALL SELECT 'affix', n, f, 0, word, stem FROM affixed
 UNION ALL SELECT 'infl', g * 100000 + a, e, 0, word || ending, canon FROM met, endings WHERE canon IN ({heads}) AND {_inflectable('word')}
 UNION ALL SELECT 'affix+infl', n, f, e, word || ending, stem FROM affixed, endings WHERE regexp_matches(word, '[화성]$') AND {_inflectable('word')}
 UNION ALL SELECT 'collo+infl', n, e, 0, surface || ending, base FROM slang_b, endings WHERE {_inflectable('surface')}
 UNION ALL SELECT 'typo', place, t, 0, variant, canon FROM wrong JOIN once USING (word)),
made AS (SELECT * FROM every WHERE surface <> ''),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY {order(lexicon.GENERATION, 'rule')}, a, b, c) AS k FROM made) WHERE k = 1),
within AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY a, b, c, surface) AS nth FROM own) WHERE nth <= CASE {caps} ELSE 1000000000 END),
words AS (SELECT surface, canon, rule AS origin, CAST(length(surface) AS INTEGER) AS len FROM (SELECT *, row_number() OVER (ORDER BY {order([r for r, _ in lexicon.BUDGET], 'rule')}, nth) AS seat FROM within) WHERE seat <= {lexicon.TARGET})"""


def canon_ctes(source: str) -> str:
    """named(token, t, canon) of source(token), after lexicon_ctes."""
    return f"named AS (SELECT token, t, coalesce(a.canon, b.canon, t) AS canon FROM (SELECT token, {token_sql('token')} AS t, lower(trim(token)) AS p FROM {source}) x LEFT JOIN words a ON a.surface = t LEFT JOIN words b ON b.surface = p)"
