"""DuckDB SQL for the library's queries, built from the same fixed values."""

from __future__ import annotations

from textloom import constants as C
from textloom.operators.report import ENGLISH_HINTS, SPANISH_HINTS


def q(text: str) -> str:
    return text.replace("'", "''")


SPACE, DELETED, WORD = q(C.SPACE), q(C.DELETED), q(C.WORD_RE2)

FORM = "translate(lower({}), '’ʼ‐‑', '''''--')"


def normal(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace({t}, '[{DELETED}]', '', 'g'), '[{SPACE}]+', ' ', 'g'))"


def listed(words) -> str:
    return "(" + ", ".join(f"'{q(w)}'" for w in words) + ")"


def merged(word: str) -> str:
    base = f"left({word}, length({word}) - 2)"
    return f"CASE WHEN length({word}) > 2 AND ends_with({word}, '''s') AND {base} NOT IN {listed(C.CONTRACTION_HOSTS)} THEN {base} ELSE {word} END"


def blocks(table: str = "documents", keys: str = "doc_id") -> str:
    """CTE body: keys, pos, t."""
    lines = f"SELECT {keys}, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table}"
    return f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS pos, t FROM (SELECT {keys}, i, {normal('l')} AS t FROM ({lines})) WHERE t <> ''"


def words(keys: str = "doc_id", possessive: bool = False, source: str = "b") -> str:
    form = FORM.format("w")
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}{merged('word') if possessive else 'word'} AS word FROM (SELECT {head}{form} AS word FROM (SELECT {head}unnest(regexp_extract_all(t, '{WORD}')) AS w FROM {source}))"


def runs(t: str = "t") -> str:
    return rf"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}]+'))"


def found(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, '(?i){q(pattern)}')"


def heading(t: str = "t") -> str:
    letters = rf"regexp_replace({t}, '[^\p{{L}}]', '', 'g')"
    return f"""CASE WHEN length({t}) > 80 THEN false
      WHEN {runs(t)} = 0 OR {runs(t)} > 12 THEN false
      WHEN {found(t, C.CHAPTER + chr(92) + 'b')} THEN NOT regexp_matches({t}, '[,;]$')
      WHEN regexp_matches({t}, '^[IVXLCDM]{{1,7}}\\.?$') AND {t} NOT IN ('I', 'I.') THEN true
      WHEN regexp_matches({t}, '^[0-9]{{1,3}}\\.?$') THEN true
      WHEN len(regexp_extract_all({t}, '[0-9]')) > 2 THEN false
      WHEN length({letters}) >= 3 AND {runs(t)} <= 8 AND {letters} = upper({letters}) AND {letters} <> lower({letters})
        THEN NOT regexp_matches({t}, '[.!?,;:]$') OR regexp_matches({t}, '^[IVXLCDM0-9]+\\.$')
      ELSE false END"""


def number(word: str, language: str = "en") -> str:
    known = listed(C.number_words(language))
    pattern = q(C.NUMERAL.replace(r"\A", "^").replace(r"\z", "$"))
    return f"(regexp_matches({word}, '{pattern}') OR {word} IN {known} OR (contains({word}, '-') AND len(list_filter(string_split({word}, '-'), lambda p: p NOT IN {known})) = 0))"


def function_class(word: str, language: str = "en") -> str:
    table = C.function_words(language)
    cases = "".join(f" WHEN {word} IN {listed([w for w, c in table.items() if c == cls])} THEN '{cls}'" for cls in C.FUNCTION_CLASSES)
    return f"CASE WHEN {number(word, language)} THEN 'numbers'{cases} END"


def marks(t: str) -> str:
    return " + ".join(f"{found(t, p)}::INT" for p in C.COPYRIGHT_MARKS)


B = f"WITH b AS ({blocks()})"
COUNTED = "SELECT word, count(*)::BIGINT AS count FROM w GROUP BY word"
FREQ = "SELECT word, count, count / sum(count) OVER () * 100 AS pct FROM c"


def freq(possessive: bool = False) -> str:
    return f"{B}, w AS ({words('', possessive)}), c AS ({COUNTED}), f AS (SELECT word, count, count / (sum(count) OVER ())::DOUBLE * 100 AS pct FROM c)"


def reading(words_: str, wpm: int) -> str:
    m = f"greatest(1, floor({words_} / {float(wpm)} + 0.5))::BIGINT"
    return f"CASE WHEN {words_} = 0 THEN '00:00' ELSE printf('%02d:%02d', {m} // 60, {m} % 60) END"


STATS = f"""SELECT doc_id, count(*)::BIGINT AS blocks, sum(len(regexp_extract_all(t, '{WORD}')))::BIGINT AS words,
  sum(length(t))::BIGINT AS chars_with_spaces, sum(length(regexp_replace(t, '[{SPACE}]', '', 'g')))::BIGINT AS chars_no_spaces FROM b GROUP BY doc_id"""


def language(ui: str = "en", table: str = "documents", key: str = "doc_id") -> str:
    return f"""WITH k AS (SELECT {key}, list_transform(regexp_extract_all(text, '{WORD}')[1:{C.LANGUAGE_TOKENS}], lambda x: lower(x)) AS w FROM {table}),
s AS (SELECT {key}, len(list_filter(w, lambda x: x IN {listed(ENGLISH_HINTS)}))::BIGINT AS en,
  (len(list_filter(w, lambda x: x IN {listed(SPANISH_HINTS)})) + 2 * len(list_filter(w, lambda x: regexp_matches(x, '[ñáéíóú¿¡]'))))::BIGINT AS es FROM k)
SELECT {key}, en, es, CASE WHEN en = es THEN '{ui}' WHEN es > en THEN 'es' ELSE 'en' END AS language FROM s"""


def tokens() -> str:
    """Places of words: what stands before a word is all words and gaps before it."""
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws, string_split_regex(text, '{WORD}') AS gaps FROM documents),
w AS (SELECT doc_id, unnest(ws) AS token, unnest(gaps[1:len(ws)]) AS gap, generate_subscripts(ws, 1) AS i FROM t),
e AS (SELECT doc_id, i, token, sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM w)
SELECT doc_id, (i - 1)::INT AS pos, (e - length(token))::INT AS start, e::INT AS "end", token FROM e"""


def csv_blocks(table: str = "documents", key: str = "doc_id", text: str = "text", delimiter: str | None = None) -> str:
    """Rows by one expression for each delimiter, then cells of each row."""
    quoted = '(?:"(?:[^"]|"")*(?:"|\\z))?'

    def rows(d: str, source: str) -> str:
        d = "\\" + d if d == "|" else d
        cell = f"{quoted}[^{d}\\r\\n]*"
        split = f"regexp_extract_all({text}, '(?s){cell}(?:{d}{cell})*(?:\\r\\n|\\r|\\n|\\z)')"
        return f"SELECT {key}, generate_subscripts(rs, 1) AS i, regexp_extract_all(unnest(rs), '(?s){cell}') AS cells FROM (SELECT {key}, {split} AS rs FROM {source})"

    marks = [(",", "','"), (";", "';'"), ("\\t", "chr(9)"), ("|", "'|'")]
    sniffed = f"""l AS (SELECT {key}, {text}, string_split_regex({text}[1:20000], '\\r?\\n')[1:20] AS ls FROM {table}),
m AS (SELECT {key}, unnest([',', ';', chr(9), '|']) AS d, unnest([1, 2, 3, 4]) AS o, ls FROM l),
c AS (SELECT {key}, d, o, list_filter(list_transform(ls, lambda x: length(x) - length(replace(x, d, ''))), lambda n: n > 0) AS ns FROM m),
s AS (SELECT {key}, coalesce(arg_min(d, (-score, o)) FILTER (score > 0), ',') AS d FROM (SELECT {key}, d, o, CASE WHEN len(ns) > 0 THEN len(list_filter(ns, lambda n: n = ns[1])) * 10 + ns[1] ELSE 0 END AS score FROM c) GROUP BY {key}),
j AS (SELECT {key}, {text}, d FROM {table} JOIN s USING ({key})),
"""
    parts = [rows(delimiter, table)] if delimiter else [rows(d, f"(SELECT * FROM j WHERE d = {shown})") for d, shown in marks]
    trim = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    value = f"""CASE WHEN starts_with(c, '"') THEN replace(regexp_extract(c, '(?s)^"((?:[^"]|"")*)', 1), '""', '"') || substr(c, length(regexp_extract(c, '(?s)^"((?:[^"]|"")*)', 1)) + 3) ELSE c END"""
    joined = f"array_to_string(list_filter(list_transform(cells, lambda c: {trim(value)}), lambda c: c <> ''), ' ')"
    return f"""WITH {"" if delimiter else sniffed}r AS ({" UNION ALL ".join(parts)}), b AS (SELECT {key}, i, {normal(joined)} AS t FROM r)
SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, t FROM b WHERE t <> ''"""


COPYRIGHT_PAGE = ("Copyright © 2001 by the author", "ISBN 0 00 000000 0", "All rights reserved.")
EDITION = "First edition, printed in 1999"


def _books() -> str:
    """Documents made up as books, with a section for each part."""
    entries = lambda n: f"list_transform(ts[1:{n}], lambda t, i: rtrim(left(t, 24)) || ' ' || i)"
    front = f"CASE WHEN v % 4 <> 0 THEN list_concat(['Contents'], {entries('v % 9')}) ELSE [] END"
    page = f"CASE v % 3 WHEN 0 THEN {list(COPYRIGHT_PAGE)!r} WHEN 1 THEN ['{EDITION}'] ELSE [] END"
    back = f"CASE WHEN v % 5 <> 0 THEN list_concat(['Index'], {entries('v % 7')}) ELSE [] END"
    parts = ", ".join(f"list_transform({p}, lambda t: {{'t': t, 's': {s}}})" for s, p in enumerate((front, page, "list_concat(['Chapter One'], ts)", back)))
    return f"""v AS (SELECT doc_id, list(t ORDER BY pos) AS ts, length(arg_min(t, pos)) AS v FROM b GROUP BY doc_id),
c AS (SELECT doc_id, flatten([{parts}]) AS bs FROM v),
x0 AS (SELECT doc_id, generate_subscripts(bs, 1) - 1 AS pos, unnest(bs).t AS t, unnest(bs).s AS s FROM c)"""


def structure(last: str, composed: bool = True) -> str:
    """Blocks with roles (``r3``) by joins, windows and a recursive walk along contents."""
    key = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '[.…·_\s-]{2,}\s*[0-9]+\s*$', ''), '\s+[0-9]+\s*$', ''), '[^\p{L}\p{N}]+', ' ', 'g'))"
    entry = rf"({runs()} <= 14 OR {runs()} <= 25 AND (regexp_matches(t, '(\.{{2,}}|…)\s*[0-9]+\s*$') OR regexp_matches(t, '\s[0-9]{{1,4}}$')))"
    source = _books() if composed else "x0 AS (SELECT doc_id, pos, t, 0 AS s FROM b)"
    return rf"""WITH RECURSIVE b AS ({blocks()}), {source},
x AS MATERIALIZED (SELECT doc_id, pos, t, s, {runs()} AS runs, count(*) OVER (PARTITION BY doc_id) AS n, {found('t', C.TOC_TITLE)} AS is_toc, {found('t', C.INDEX_TITLE)} AS is_index, {key} AS key, {entry} AS entry FROM x0),
walk AS (SELECT doc_id, pos AS since, pos AS till, []::VARCHAR[] AS seen FROM x WHERE is_toc AND pos < greatest(60, floor(n * 0.3))
  UNION ALL SELECT w.doc_id, w.since, x.pos, CASE WHEN x.key = '' THEN w.seen ELSE list_append(w.seen, x.key) END FROM walk w JOIN x ON x.doc_id = w.doc_id AND x.pos = w.till + 1
  WHERE x.pos < w.since + 600 AND NOT list_contains(w.seen, x.key) AND x.entry),
toc AS (SELECT doc_id, min(since) AS since, arg_min(till, since) AS till FROM (SELECT doc_id, since, max(till) AS till FROM walk GROUP BY ALL) WHERE till - since >= 2 GROUP BY doc_id),
r1 AS (SELECT x.*, CASE WHEN pos BETWEEN since AND till THEN 'toc' END AS r FROM x LEFT JOIN toc USING (doc_id)),
h AS (SELECT *, CASE WHEN r IS NULL AND {heading()} THEN 'h' ELSE 'p' END AS k, coalesce(min(CASE WHEN runs > 30 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS stop,
  sum((runs <= 3 OR regexp_matches(t, '[0-9]'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS listed FROM r1),
idx AS (SELECT h.doc_id, max(h.pos) AS first, arg_max(h.stop, h.pos) AS stop FROM h JOIN h e ON e.doc_id = h.doc_id AND e.pos = h.stop - 1 WHERE h.is_index AND h.pos >= floor(h.n * 0.6) AND e.listed - h.listed >= 3 GROUP BY h.doc_id),
r2 AS (SELECT h.doc_id, pos, t, s, k, runs, coalesce(r, CASE WHEN pos >= first AND pos < idx.stop THEN 'index' END) AS r FROM h LEFT JOIN idx USING (doc_id)),
w AS (SELECT *, sum(runs) OVER (PARTITION BY doc_id ORDER BY pos) - runs AS before, sum(runs) OVER (PARTITION BY doc_id) AS total, {marks('t')} AS m,
  (pos = 0 OR k = 'h' OR s <> lag(s) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS begins FROM r2),
g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS seg, greatest(total * 0.25, 1500) AS front, total * 0.9 AS back FROM w),
seg AS (SELECT doc_id, seg, sum(runs) AS words, min(before) AS seen, any_value(front) AS front, any_value(back) AS back, bool_or(r IS NOT NULL) AS known, string_agg(t, chr(10) ORDER BY pos) || chr(10) AS t FROM g GROUP BY doc_id, seg),
page AS (SELECT doc_id, seg FROM seg WHERE (seen <= front OR seen >= back) AND words <= 700 AND NOT known AND ({marks('t')} >= 3 OR {marks('t')} = 2 AND {found('t', '©|copyright|all rights reserved')})),
marked AS (SELECT doc_id, pos, m, before, runs, (pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 3) IS NOT TRUE AS apart FROM g WHERE before <= front AND r IS NULL AND runs <= 120 AND m > 0 AND doc_id NOT IN (SELECT doc_id FROM page)),
island AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM marked),
cluster AS (SELECT doc_id, min(pos) AS a, max(pos) AS z FROM island GROUP BY doc_id, i HAVING sum(m) >= 2 AND max(before + runs) - min(before) <= 700),
r3 AS (SELECT g.doc_id, g.pos, g.k, CASE WHEN page.seg IS NOT NULL THEN 'copyright' WHEN g.r IS NULL AND cluster.a IS NOT NULL THEN 'copyright' ELSE g.r END AS r
  FROM g LEFT JOIN page ON page.doc_id = g.doc_id AND page.seg = g.seg LEFT JOIN cluster ON cluster.doc_id = g.doc_id AND g.pos BETWEEN cluster.a AND cluster.z)
{last}"""


LEXICON_BUILD = """WITH f AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, lang FROM documents), t AS (SELECT word, CASE lang WHEN 'en' THEN 'nouns' WHEN 'fr' THEN 'verbs' WHEN 'de' THEN 'adjectives' ELSE 'adverbs' END AS cls, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT word, sum(n) AS total FROM t GROUP BY word)
SELECT word, string_agg(cls || CASE WHEN total >= 5 AND n / total::DOUBLE < 0.05 THEN '?' ELSE '' END, ',' ORDER BY list_position(['nouns', 'verbs', 'adjectives', 'adverbs'], cls)) AS classes FROM t JOIN s USING (word) GROUP BY word"""


def lexicon_classes_es() -> str:
    """Spanish look-ups: the word, -mente, attached pronouns, the last part of a hyphened word."""
    ending = "(nos|las|los|les|me|te|se|os|lo|la|le)$"
    cuts = "".join(
        f"""s{i} AS (SELECT word, left(base, length(base) - length(cut)) AS base, cut || removed AS removed FROM (SELECT *, regexp_extract(base, '{ending}') AS cut FROM s{i - 1}) WHERE cut <> '' AND length(base) - length(cut) >= 2),
"""
        for i in (1, 2, 3)
    )
    last = "string_split(w.word, '-')[-1]"
    return f"""WITH lex AS (SELECT word, string_split(classes, ',') AS c FROM ({LEXICON_BUILD})), b AS ({blocks()}), w AS (SELECT DISTINCT word FROM ({words('')})),
s0 AS (SELECT word, word AS base, '' AS removed FROM w WHERE word NOT IN (SELECT word FROM lex)),
{cuts}cut AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), form AS (SELECT word, base AS f FROM cut UNION ALL SELECT word, base || 's' FROM cut WHERE starts_with(removed, 'nos')),
verbal AS (SELECT DISTINCT word FROM (SELECT word, f FROM form UNION ALL SELECT word, strip_accents(f) FROM form) WHERE f IN (SELECT word FROM lex WHERE list_contains(c, 'verbs'))),
k AS (SELECT w.word, {function_class('w.word', 'es')} AS fn, coalesce(lex.c, CASE WHEN ends_with(w.word, 'mente') AND length(w.word) > 7 THEN ['adverbs'] WHEN verbal.word IS NOT NULL THEN ['verbs'] END,
  CASE WHEN contains(w.word, '-') THEN CASE WHEN {function_class(last, 'es')} IS NOT NULL THEN [{function_class(last, 'es')}] ELSE tail.c END END, []) AS c
  FROM w LEFT JOIN lex USING (word) LEFT JOIN verbal USING (word) LEFT JOIN lex tail ON contains(w.word, '-') AND tail.word = {last}),
m AS (SELECT word, fn, list_transform(list_filter(c, lambda x: NOT ends_with(x, '?') OR (fn IS NULL AND x IN ('nouns?', 'verbs?', 'adjectives?', 'adverbs?'))), lambda x: replace(x, '?', '')) AS c FROM k),
a AS (SELECT word, list_filter(list_concat(c, CASE WHEN fn IS NULL THEN [] ELSE [fn] END), lambda x: NOT (coalesce(fn, '') = 'articles' AND x = 'determiners') AND NOT (coalesce(fn, '') = 'numbers' AND x = 'nouns')) AS c FROM m)
SELECT word, CASE WHEN len(c) = 0 THEN 'other' ELSE array_to_string(list_filter({C.CLASSES[:-1]!r}, lambda x: list_contains(c, x)), ',') END AS classes FROM a"""


def formats() -> str:
    """Numbers by DuckDB's own formatting; the Spanish marks take the places of the English ones."""
    es = lambda x: f"translate({x}, ',.', '.,')"
    whole = "format('{:,}', n)"
    share = "CASE WHEN p >= 0.01 THEN printf('%.2f', round(p, 2)) ELSE printf('%.4f', round(p, 4)) END"

    def size(group) -> str:
        unit = lambda power, name: f"CASE WHEN z / {1024**power}.0 < 10 THEN @(regexp_replace(printf('%.1f', round(z / {1024**power}.0::DOUBLE, 1)), '\\.0$', '')) ELSE {group(f'floor(z / {1024**power}.0 + 0.5)::BIGINT')} END || ' {name}'"
        return f"CASE WHEN z < 1024 THEN z || ' B' WHEN z < {1024**2} THEN {unit(1, 'KB')} WHEN z < {1024**3} THEN {unit(2, 'MB')} ELSE {unit(3, 'GB')} END"

    en_size = size(lambda v: f"format('{{:,}}', {v})").replace("@(", "(")
    es_size = size(lambda v: f"CASE WHEN {v} >= 10000 THEN {es(f"format('{{:,}}', {v})")} ELSE ({v})::VARCHAR END").replace("@(", "translate(").replace("'\\.0$', '')", "'\\.0$', ''), '.', ','")
    return f"""WITH d AS (SELECT doc_id, n_chars AS n, n_chars::DECIMAL(15,0) * 0.001::DECIMAL(4,3) AS p, n_chars * n_chars AS z FROM documents)
SELECT doc_id, {whole} AS whole_en, {share} || '%' AS share_en, {en_size} AS size_en, {es(whole)} AS whole_es, {es(share)} || ' %' AS share_es, {es_size} AS size_es FROM d"""


def messages() -> str:
    """Templates stated by hand; a count of one takes its own form."""
    return """WITH d AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n,
  CASE WHEN starts_with(text, 'CONT') THEN 'kfx' WHEN lang = 'de' THEN 'notZip' WHEN lang = 'fr' THEN 'badKindle' WHEN lang = 'es' THEN 'badPdf' ELSE 'txt' END AS kind FROM documents)
SELECT doc_id, kind,
  CASE kind WHEN 'kfx' THEN 'This is a KFX book, whose format is closed. Convert a copy without protection to EPUB or AZW3.'
    WHEN 'notZip' THEN 'The .docx file is no ZIP package: it is damaged or of another kind.' WHEN 'badKindle' THEN 'No header of a Kindle book (MOBI, AZW) was found.'
    WHEN 'badPdf' THEN 'The file does not begin as a PDF does.' ELSE format('{:,}', n) || CASE n WHEN 1 THEN ' block of text' ELSE ' blocks of text' END END AS message_en,
  CASE kind WHEN 'kfx' THEN 'Es un libro KFX, un formato cerrado. Convierta una copia sin protección a EPUB o AZW3.'
    WHEN 'notZip' THEN 'El archivo .docx no es un paquete ZIP: está dañado o es de otro tipo.' WHEN 'badKindle' THEN 'Falta la cabecera de un libro Kindle (MOBI, AZW).'
    WHEN 'badPdf' THEN 'El archivo no empieza como un PDF.' ELSE replace(format('{:,}', n), ',', '.') || CASE n WHEN 1 THEN ' bloque de texto' ELSE ' bloques de texto' END END AS message_es FROM d"""
