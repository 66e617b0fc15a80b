"""SQL of queries that mark, release, copy and decide: the same steps on the same tables, put together from parts.

Look-arounds, which the SQL engine's patterns lack, become signs: every run of word characters, or of digits, stands between
two control characters that offsets don't count.
"""

from __future__ import annotations

from shinglemill.functions import release as R
from shinglemill.functions.release import CENTURY_YEAR, SALT

_OPEN, _SHUT = "\x01", "\x02"
_TOKEN = r"\[[A-Z_0-9]+\]|[\p{L}\p{N}_]+"
_EMAIL, _PHONE = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", r"\+?\p{Nd}[\p{Nd} ()-]{7,}\p{Nd}"
_IP = rf"(?:{_OPEN}\p{{Nd}}{{1,3}}{_SHUT}\.){{3}}{_OPEN}\p{{Nd}}{{1,3}}{_SHUT}"
_NAME = rf"{_OPEN}[A-Z][a-z]+{_SHUT}(?:\s+{_OPEN}[A-Z][a-z]+{_SHUT}){{1,2}}"
_YEAR = rf"{_OPEN}(?:19\p{{Nd}}\p{{Nd}}|20(?:0\p{{Nd}}|1\p{{Nd}}|2[0-6])){_SHUT}"
_NUMBER = rf"{_OPEN}\p{{Nd}}{{1,6}}{_SHUT}/{_OPEN}\p{{Nd}}{{2}}{_SHUT}"
#: Type, text column (plain, words signed, digits signed) and pattern of every detector.
_DETECTORS = {
    "contact": (("EMAIL_ADDRESS", "text", _EMAIL), ("PHONE_NUMBER", "text", _PHONE), ("IP_ADDRESS", "wt", _IP)),
    "rules": (("PERSON", "wt", _NAME), ("DATETIME", "nt", _YEAR), ("CODE", "wt", _NUMBER), ("CODE", "text", _EMAIL), ("CODE", "text", _PHONE), ("CODE", "wt", _IP)),
}
_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_SPANS = 'STRUCT(s BIGINT, e BIGINT, "type" VARCHAR, surface VARCHAR)[]'


def _bare(x: str) -> str:
    return f"replace(replace({x}, '{_OPEN}', ''), '{_SHUT}', '')"


def _matches(column: str, pattern: str, kind: str, source: str) -> str:
    """Rows ``(doc_id, s, e, type, surface)`` of all matches."""
    return f"""SELECT doc_id, s, s + length(surface) AS e, '{kind}' AS "type", surface FROM (
SELECT doc_id, m AS surface, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m))::BIGINT AS s
FROM (SELECT doc_id, k, {_bare("g")} AS g, {_bare("m")} AS m FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g
FROM (SELECT doc_id, regexp_extract_all({column}, '{pattern}') AS ms, regexp_split_to_array({column}, '{pattern}') AS gs FROM {source}))))"""


def _found(detector: str, rows: str, name: str) -> str:
    """CTEs up to ``s_name (doc_id, spans)`` of ``rows (doc_id, text)``. Longest spans first, then the earliest."""
    found = " UNION ALL ".join(_matches(column, pattern, kind, f"t_{name}") for kind, column, pattern in _DETECTORS[detector])
    word, digits = r"([\p{L}\p{N}_]+)", r"(\p{Nd}+)"
    free = "len(list_filter(acc, lambda a: a.s < x[1].e AND x[1].s < a.e)) = 0"
    return f"""t_{name} AS (SELECT doc_id, text, regexp_replace(text, '{word}', '{_OPEN}\\1{_SHUT}', 'g') AS wt, regexp_replace(text, '{digits}', '{_OPEN}\\1{_SHUT}', 'g') AS nt FROM ({rows})),
f_{name} AS (SELECT DISTINCT * FROM ({found})),
l_{name} AS (SELECT doc_id, list([{{'s': s, 'e': e, 'type': "type", 'surface': surface}}] ORDER BY e - s DESC, s, "type") AS l FROM f_{name} GROUP BY doc_id),
s_{name} AS (SELECT doc_id, list_sort(list_reduce(l, lambda acc, x: CASE WHEN {free} THEN list_concat(acc, x) ELSE acc END))::{_SPANS} AS spans FROM l_{name})"""


def _marked(detector: str, name: str = "o") -> str:
    """CTEs up to ``name (idx, key, case_, is_copy, text, spans)`` of the originals."""
    return f"""{_found(detector, "SELECT doc_id, coalesce(text, '') AS text FROM documents", name)},
{name} AS (SELECT doc_id AS idx, doc_id::VARCHAR AS key, doc_id AS case_, false AS is_copy, text, coalesce(spans, []::{_SPANS}) AS spans FROM t_{name} LEFT JOIN s_{name} USING (doc_id))"""


_PARTS = r"regexp_extract_all(text, '[^\n]*\n+|[^\n]+') || CASE WHEN text = '' OR ends_with(text, chr(10)) THEN [''] ELSE [] END"


_SOME = "(SELECT (count(*) + 9) // 10 FROM o)"


def corpus(detector: str, seed: int = 1) -> str:
    """CTEs up to ``d``: originals, and copies of some of them that lack some paragraphs; spans inside a kept paragraph move along."""
    draw = _DRAW.format(f"'{seed}|' || idx || '|' || {{}}")
    return f"""{_marked(detector)},
chosen AS (SELECT * FROM o ORDER BY md5('{seed}|' || idx) LIMIT {_SOME}),
cp AS (SELECT *, {_PARTS} AS ps, [0.05, 0.10, 0.15, 0.20][{draw.format("'rate'")} % 4 + 1] AS rate, {draw.format("'drop'")} AS dr FROM chosen),
ck AS (SELECT *, list_transform(range(0, len(ps)), lambda i: i = 0 OR {draw.format("i")} / 4294967296.0 > rate) AS keep FROM cp),
cg AS (SELECT *, CASE WHEN len(ps) > 2 AND list_bool_and(keep) THEN dr % (len(ps) - 1) + 1 ELSE -1 END AS gone FROM ck),
ci AS (SELECT *, unnest(list_filter(range(0, len(ps)), lambda i: keep[i + 1] AND i <> gone)) AS i FROM cg),
cq AS (SELECT *, coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) AS first, length(ps[i + 1]) AS n FROM ci),
cw AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM cq),
ct AS (SELECT idx, string_agg(ps[i + 1], '' ORDER BY i) AS text FROM cw GROUP BY idx),
cx AS (SELECT idx, first, n, pos, unnest(spans) AS x FROM cw),
cs AS (SELECT idx, list({{'s': x.s - first + pos, 'e': x.e - first + pos, 'type': x."type", 'surface': x.surface}} ORDER BY x.s) AS spans FROM cx WHERE first <= x.s AND x.e <= first + n GROUP BY idx),
d AS (SELECT * FROM o UNION ALL SELECT c.idx + (SELECT max(idx) + 1 FROM o), c.key || '#copy', c.case_, true, coalesce(ct.text, ''), coalesce(cs.spans, []::{_SPANS}) FROM chosen c LEFT JOIN ct ON ct.idx = c.idx LEFT JOIN cs ON cs.idx = c.idx)"""


#: Fixed by the generator of second sources: names, dates and substitutions, in order.
_WHO = "['Ada Berg', 'Ben Cole', 'Cleo Diaz', 'Dov Eames', 'Elin Frost', 'Finn Gray', 'Gwen Holt', 'Hugo Imber']"
_WHEN = "['03 March 2021', '11 May 2022', '19 July 2023', '27 September 2024']"
_FRAMES = {
    "email": ("who || ' passed this along to ' || whom || ', ' || day || ':'", "'Reach me at +1 555 ' || phone || ' (' || who || ')'"),
    "web": ("day || ' | notes kept by ' || who", "'Mirror of ' || right(day, 4) || ', questions to ' || who"),
}


def second_source(source: str, domain: str, seed: int, name: str = "ss") -> str:
    """CTEs up to ``name (idx, text)``: rows of ``source`` as another source would hold them."""
    draw = lambda what: _DRAW.format(f"'{seed}|' || idx || '|' || {what}")
    misread = "CASE " + " ".join(f"WHEN contains(w, '{a}') THEN substr(w, 1, instr(w, '{a}') - 1) || '{b}' || substr(w, instr(w, '{a}') + {len(a)})" for a, b in (("l", "1"), ("O", "0"), ("rn", "m"), ("e", "c"), ("i", "l"))) + " ELSE w END"
    head, foot = _FRAMES[domain]
    return f"""{name}a AS (SELECT idx, list_filter(regexp_split_to_array(text, '\n+'), lambda p: trim(p, ' ') <> '') AS ps FROM {source}),
{name}b AS (SELECT idx, list_filter(range(0, len(ps)), lambda i: i = 0 OR {draw("i")} / 4294967296.0 > [0.0, 0.05, 0.10][{draw("i || '|rate'")} % 3 + 1]) AS keep, ps FROM {name}a),
{name}c AS (SELECT idx, string_split(translate(array_to_string(list_transform(keep, lambda i: ps[i + 1]), chr(10)), '“”’', '""' || chr(39)), ' ') AS ws FROM {name}b),
{name}d AS (SELECT idx, array_to_string(list_transform(range(0, len(ws)), lambda i: CASE WHEN {draw("i || '|ocr'")} / 4294967296.0 < 0.005 THEN list_transform([ws[i + 1]], lambda w: {misread})[1] ELSE ws[i + 1] END), ' ') AS body,
{_WHO}[{draw("'who'")} % 8 + 1] AS who, {_WHO}[{draw("'to'")} % 8 + 1] AS whom, {_WHEN}[{draw("'when'")} % 4 + 1] AS day, lpad(({draw("'phone'")} % 10000000)::VARCHAR, 7, '0') AS phone FROM {name}c),
{name} AS (SELECT idx, {head} || chr(10) || body || chr(10) || {foot} AS text FROM {name}d)"""


def _token(word: str) -> str:
    """A word's keyed token from the pads ``ip`` and ``op``."""
    powers = "[" + ", ".join(f"{26**k}::UBIGINT" for k in range(10)) + "]"
    return f"list_transform([sha256(op || unhex(sha256(ip || encode(lower({word})))))], lambda h: 'zq' || array_to_string(list_transform({powers}, lambda p: chr((97 + (('0x' || substr(h, 1, 16))::UBIGINT // p) % 26)::INT)), ''))[1]"


_WORD = r"[\p{L}\p{N}_]+"
_SURROGATE = f"array_to_string(list_transform(range(1, len(ws) + 1), lambda j: gs[j] || {_token('ws[j]')}), '') || gs[len(ws) + 1]"
_SCOPES = {"SUR-DOC": "key", "SUR-CORPUS": "'CORPUS'", "SUR-SUBJECT": "'SUBJECT|' || case_"}
_CONSTANT = {"DROP": "''", "MASK": "'[PII]'", "TYPE": "'[' || \"type\" || ']'", "RAW": "surface"}
_ALIAS = "'[' || \"type\" || '_' || dense_rank() OVER (PARTITION BY idx, \"type\" ORDER BY first_i) || ']'"
_HASH = f"sha256(encode(surface) || unhex(sha256('{SALT}|' || key || '|' || (i - 1))))"


def _pool(names: list[str], seed: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][({seed}) % {len(names)} + 1]"


#: What stands for a span of each type under FAKER-DOC, from the 60 bits ``seed``.
_FAKE = f"""CASE type WHEN 'PERSON' THEN {_pool(R._FIRST, "seed")} || ' ' || {_pool(R._LAST, "seed >> 8")}
WHEN 'DATETIME' THEN CASE WHEN regexp_matches(surface, '[0-9]') THEN lpad((seed % 28 + 1)::VARCHAR, 2, '0') || ' ' || {_pool(R._MONTHS, "seed >> 6")} || ' ' || ((seed >> 12) % 60 + 1960) ELSE {_pool(R._DAYS, "seed")} END
WHEN 'CODE' THEN CASE WHEN regexp_matches(surface, '[0-9]') THEN array_to_string(list_transform(string_split(surface, ''), lambda c: CASE WHEN regexp_matches(c, '[0-9]') THEN substr(rpad(seed::VARCHAR, 20, '7'), ascii(c) * 7 % 19 + 1, 1) ELSE c END), '') ELSE 'XQ-' || lpad((seed % 10000)::VARCHAR, 4, '0') END
WHEN 'EMAIL_ADDRESS' THEN lower({_pool(R._FIRST, "seed")}) || '.' || lower({_pool(R._LAST, "seed >> 8")}) || '@example.org'
WHEN 'PHONE_NUMBER' THEN '+1 555 ' || lpad((seed % 10000000)::VARCHAR, 7, '0')
WHEN 'IP_ADDRESS' THEN '10.' || (seed % 256) || '.' || ((seed >> 8) % 256) || '.' || ((seed >> 16) % 256) END"""


def values(strategy: str, source: str = "d") -> str:
    """CTEs up to ``v (idx, i, case_, is_copy, type, surface, value)``: what stands for every span."""
    out = f"""x AS (SELECT idx, key, case_, is_copy, i, spans[i]."type" AS "type", spans[i].surface AS surface FROM (SELECT *, unnest(range(1, len(spans) + 1)) AS i FROM {source})),
"""
    if strategy in _SCOPES:
        pad = lambda byte: f"unhex(array_to_string(list_transform(range(1, 65), lambda b: format('{{:02x}}', xor(CASE WHEN b <= length(mac) THEN ascii(mac[b]) ELSE 0 END, {byte}))), ''))"
        return out + f"""xk AS (SELECT DISTINCT idx, '{SALT}|' || {_SCOPES[strategy]} AS mac FROM x), xp AS (SELECT idx, {pad(54)} AS ip, {pad(92)} AS op FROM xk),
xw AS (SELECT x.*, ip, op, regexp_extract_all(surface, '{_WORD}') AS ws, regexp_split_to_array(surface, '{_WORD}') AS gs FROM x JOIN xp USING (idx)),
v AS (SELECT idx, i, case_, is_copy, "type", surface, {_SURROGATE} AS value FROM xw)"""
    if strategy == "ALIAS-DOC":
        return out + f"""xf AS (SELECT *, min(i) OVER (PARTITION BY idx, "type", lower(surface)) AS first_i FROM x), v AS (SELECT idx, i, case_, is_copy, "type", surface, {_ALIAS} AS value FROM xf)"""
    if strategy == "FAKER-DOC":
        return out + f"""xf AS (SELECT *, ('0x' || substr(sha256('{SALT}|' || key || '|' || type || chr(1) || lower(surface)), 1, 15))::BIGINT AS seed FROM x),
v AS (SELECT idx, i, case_, is_copy, "type", surface, {_FAKE} AS value FROM xf)"""
    return out + f"""v AS (SELECT idx, i, case_, is_copy, "type", surface, {_HASH if strategy == "HASH-ENTITY" else _CONSTANT[strategy]} AS value FROM x)"""


#: What derived strategies make of another's text.
_DERIVED = {
    "SUR-DOC-COLLAPSED": ("SUR-DOC", r"\bzq[a-z]{10}\b", "[PII]"), "SUR-DOC-SKIP": ("SUR-DOC", r"\bzq[a-z]{10}\b", " "),
    "HASH-SKIP": ("HASH-ENTITY", r"\b[0-9a-f]{64}\b", " "), "HASH-COLLAPSED": ("HASH-ENTITY", r"\b[0-9a-f]{64}\b", "[PII]"),
}


def released(strategy: str, source: str = "d", r: str = "r") -> str:
    """CTEs up to ``{r} (doc_id, case_, is_copy, text)``: texts under a strategy."""
    if strategy == "RAW":
        return f"{r} AS (SELECT idx AS doc_id, case_, is_copy, text FROM {source})"
    base, pattern, put = _DERIVED.get(strategy, (strategy, None, None))
    years = base.startswith("YEAR")
    base = {"YEAR": "SUR-DOC", "YEAR-FAKER": "FAKER-DOC"}.get(base, base)
    text = """array_to_string(list_transform(range(1, len(spans) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE spans[i - 1].e + 1 END, spans[i].s - CASE WHEN i = 1 THEN 0 ELSE spans[i - 1].e END) || vs[i]), '')
|| substr(text, CASE WHEN len(spans) = 0 THEN 1 ELSE spans[len(spans)].e + 1 END)"""
    if pattern:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"""{values(base, source)},
vl AS (SELECT idx, list({f"CASE WHEN type = 'DATETIME' THEN array_to_string(regexp_extract_all(surface, '{CENTURY_YEAR}'), ' ') ELSE value END" if years else "value"} ORDER BY i) AS vs FROM v GROUP BY idx),
{r} AS (SELECT {source}.idx AS doc_id, case_, is_copy, {text} AS text FROM {source} LEFT JOIN vl ON vl.idx = {source}.idx)"""


def release_sql(strategy: str, detector: str = "contact") -> str:
    return f"WITH {_marked(detector)}, {released(strategy, 'o')} SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM r"


def graph(name: str, theta: float, n: int = 5, r: str = "r") -> str:
    """CTEs from ``r`` to pairs ``p{name}`` with their similarity and components ``c{name} (doc_id, component)``."""
    tokens = f"list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda w: CASE WHEN starts_with(w, '[') THEN w ELSE lower(w) END)"
    return f"""w{name} AS (SELECT doc_id, {tokens} AS w FROM {r}),
h{name} AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - {n - 1}) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS s FROM w{name}),
u{name} AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM h{name}),
p{name} AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS jaccard FROM u{name} a JOIN u{name} b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e{name} AS (SELECT i, j FROM p{name} WHERE jaccard >= {theta} UNION ALL SELECT j, i FROM p{name} WHERE jaccard >= {theta}),
g{name} AS (SELECT doc_id AS a, doc_id AS b FROM {r} UNION SELECT g{name}.a, e{name}.j FROM g{name} JOIN e{name} ON g{name}.b = e{name}.i),
c{name} AS (SELECT a AS doc_id, min(b) AS component FROM g{name} GROUP BY a),
m{name} AS (SELECT {r}.doc_id, case_, is_copy, component FROM {r} JOIN c{name} USING (doc_id)),
q{name} AS (SELECT y.doc_id, y.case_, y.component = z.component AS detected, coalesce(jaccard, 0) >= {theta} AS hit FROM m{name} y JOIN m{name} z ON y.case_ = z.case_ AND y.is_copy AND NOT z.is_copy LEFT JOIN p{name} ON i = z.doc_id AND j = y.doc_id)"""


def decide_sql(strategy: str, n: int = 5, detector: str = "rules", theta: float = 0.7, made: str = "") -> str:
    return f"""WITH RECURSIVE {made or corpus(detector)}, {released(strategy)}, {graph("", theta, n)},
k AS (SELECT case_, count(*) AS n FROM m WHERE doc_id = component GROUP BY case_)
SELECT count(*) AS copies, round(avg(detected::INT), 6) AS pipeline_recall, round(avg(hit::INT), 6) AS pair_recall, (SELECT count(DISTINCT case_) FROM m WHERE case_ NOT IN (SELECT case_ FROM k)) AS lost,
(SELECT count(*) FROM m JOIN k USING (case_) WHERE is_copy AND k.n >= 2) AS residual, (SELECT count(*) FROM m WHERE doc_id = component) AS kept FROM q"""


_NORM = f"CASE WHEN starts_with(value, '[') THEN value ELSE array_to_string(regexp_extract_all(lower(value), '{_TOKEN}'), ' ') END"
_TRUE = f"array_to_string(regexp_extract_all(lower(surface), '{_TOKEN}'), ' ')"


def _links(*keys: str) -> str:
    by, used = ", ".join(keys), " AND ".join(f"{k} <> ''" for k in keys)
    return f"(SELECT coalesce(sum(p), 0)::BIGINT FROM (SELECT ((sum(n) * sum(n) - sum(n * n)) / 2)::BIGINT AS p FROM (SELECT {by}, case_, count(*) AS n FROM y WHERE {used} GROUP BY {by}, case_) GROUP BY {by}))"


def _linkage_of(items: str) -> str:
    return f"""y AS ({items}), n AS (SELECT {_links("truth")} AS truth, {_links("released")} AS predicted, {_links("released", "truth")} AS correct)
SELECT truth, predicted, correct, CASE WHEN truth > 0 THEN round(correct / truth::DOUBLE, 6) END AS recall, CASE WHEN predicted > 0 THEN round(correct / predicted::DOUBLE, 6) END AS precision FROM n"""


def linkage_sql(strategy: str) -> str:
    return f"WITH {_marked('contact')}, {values(strategy, 'o')}, {_linkage_of(f'SELECT case_, {_NORM} AS released, {_TRUE} AS truth FROM v')}"


_COPIED = f"WITH RECURSIVE {corpus('contact')}, {released('RAW')}, {graph('', 0.7)}"
_MARKED = f"""WITH {_marked("contact")}"""
_TOKENS_AT = _matches("text", _WORD, "T", "t_o")

ORACLES = {f"decide_{s.lower().replace('-', '_')}": decide_sql(s) for s in ("RAW", "DROP", "MASK", "TYPE", "ALIAS-DOC", "SUR-DOC", "SUR-CORPUS", "SUR-SUBJECT", "HASH-ENTITY", "FAKER-DOC")}
ORACLES |= {"decide_raw_n2": decide_sql("RAW", 2)}
ORACLES |= {f"release_{s.lower().replace('-', '_')}": release_sql(s) for s in ("ALIAS-DOC", "SUR-DOC", "SUR-CORPUS", "SUR-SUBJECT", "HASH-ENTITY", "FAKER-DOC", "SUR-DOC-COLLAPSED", "SUR-DOC-SKIP", "HASH-SKIP", "YEAR", "YEAR-FAKER")}
ORACLES |= {f"linkage_{s.lower().replace('-', '_')}": linkage_sql(s) for s in ("TYPE", "SUR-DOC", "SUR-CORPUS", "HASH-ENTITY")}
ORACLES |= {
    "rule_entities": f"""WITH {_marked("rules")} SELECT idx AS doc_id, x.s::INT AS start, x.e::INT AS "end", x."type" AS "type", x.surface AS surface FROM (SELECT idx, unnest(spans) AS x FROM o)""",
    "second_source_copies": f"""WITH {_marked("contact")}, {second_source("o", "email", 4)} SELECT idx AS doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM ss""",
    "copy_manifest": f"""WITH {corpus("contact")}, picked AS (SELECT * FROM o ORDER BY md5('2|' || idx) LIMIT {_SOME}), {second_source("picked", "web", 2)}
SELECT key || '#para' AS key, 'para' AS copy_kind, sha256(coalesce(ct.text, '')) AS sha256 FROM chosen LEFT JOIN ct USING (idx) UNION ALL SELECT idx || '#real', 'real', sha256(text) FROM ss""",
    "decide_second_source": decide_sql("RAW", made=f"""{_marked("contact")}, chosen AS (SELECT * FROM o ORDER BY md5('1|' || idx) LIMIT {_SOME}), {second_source("chosen", "web", 1)},
d AS (SELECT idx, case_, is_copy, text FROM o UNION ALL SELECT idx + (SELECT max(idx) + 1 FROM o), idx, true, text FROM ss)"""),
    "false_merges": f"""{_COPIED}, b AS (SELECT i, j, x.case_ AS a, y.case_ AS b FROM p JOIN r x ON x.doc_id = i JOIN r y ON y.doc_id = j WHERE jaccard >= 0.7 AND x.case_ <> y.case_)
SELECT (SELECT count(*) FROM b) AS pairs, (SELECT count(*) FROM (SELECT a FROM b UNION SELECT b FROM b)) AS cases""",
    "removal_skew": f"""WITH RECURSIVE {_marked("contact")}, {released("RAW", "o")}, {graph("", 0.7)}
SELECT lang AS value, count(*) AS corpus, sum((component <> doc_id)::INT)::BIGINT AS lost FROM m JOIN documents USING (doc_id) GROUP BY lang""",
    "touched_recall": f"""WITH RECURSIVE {corpus("rules")}, {released("SUR-CORPUS")}, {graph("", 0.7)}
SELECT count(*) AS n, round(avg(detected::INT), 6) AS recall FROM q WHERE case_ IN (SELECT case_ FROM d WHERE len(spans) > 0)""",
    "released_linkage": f"""WITH RECURSIVE {corpus("rules")}, {released("RAW")}, {graph("", 0.7)}, {values("SUR-CORPUS")},
{_linkage_of(f"SELECT case_, {_NORM} AS released, {_TRUE} AS truth FROM v WHERE type = 'PERSON' AND idx IN (SELECT doc_id FROM m WHERE doc_id = component)")}""",
    "marking_density": f"""{_MARKED}, tk AS ({_TOKENS_AT}), tm AS (SELECT doc_id, s, len(list_filter(spans, lambda x: tk.s < x.e AND x.s < tk.e)) > 0 AS m FROM tk JOIN o ON o.idx = doc_id),
tl AS (SELECT doc_id, list(m ORDER BY s) AS m FROM tm GROUP BY doc_id), tw AS (SELECT doc_id, m, CASE WHEN len(m) < 5 THEN [] ELSE list_transform(range(1, len(m) - 3), lambda i: list_bool_or(m[i:i + 4])) END AS w FROM tl)
SELECT idx AS doc_id, coalesce(round(len(list_filter(m, lambda x: x)) / len(m)::DOUBLE, 6), 0.0) AS token_share, CASE WHEN coalesce(len(w), 0) = 0 THEN 0.0 ELSE round(len(list_filter(w, lambda x: x)) / len(w)::DOUBLE, 6) END AS window_share FROM o LEFT JOIN tw ON doc_id = idx""",
    "detector_quality": f"""WITH {_marked("contact")}, {_marked("rules", "z")},
ga AS (SELECT idx, k, unnest(range(x.s, x.e)) AS c FROM (SELECT idx, unnest(range(1, len(spans) + 1)) AS k, unnest(spans) AS x FROM z)), gc AS (SELECT DISTINCT idx, c FROM ga),
fc AS (SELECT DISTINCT idx, unnest(range(x.s, x.e)) AS c FROM (SELECT idx, unnest(spans) AS x FROM o)), n AS (SELECT (SELECT count(*) FROM gc JOIN fc USING (idx, c)) AS tp, (SELECT count(*) FROM gc) AS g, (SELECT count(*) FROM fc) AS f),
u AS (SELECT DISTINCT idx, k FROM ga LEFT JOIN fc USING (idx, c) WHERE fc.c IS NULL)
SELECT tp, f - tp AS fp, g - tp AS fn, round(tp / nullif(f, 0)::DOUBLE, 6) AS precision, round(tp / nullif(g, 0)::DOUBLE, 6) AS recall, (SELECT count(*) FROM u) AS direct_missed FROM n""",
    "order_difference": f"""WITH RECURSIVE {corpus("contact")}, {released("RAW")}, {released("MASK", r="r2")}, {graph("1", 0.7)}, {graph("2", 0.7, r="r2")},
b AS (SELECT doc_id, max(f) AS f, max(s) AS s FROM (SELECT doc_id, 1 AS f, 0 AS s FROM m1 WHERE doc_id <> component UNION ALL SELECT doc_id, 0, 1 FROM m2 WHERE doc_id <> component) GROUP BY doc_id)
SELECT CASE WHEN f = 1 AND s = 1 THEN 'both' WHEN f = 1 THEN 'first_only' ELSE 'second_only' END AS removed_by, count(*) AS documents, median(len(w)) AS median_words FROM b JOIN w1 USING (doc_id) GROUP BY ALL""",
    "union_partition": f"""WITH RECURSIVE {_marked("contact")}, {released("RAW", "o")}, {released("MASK", "o", "r2")}, {graph("1", 0.7)}, {graph("2", 0.5, r="r2")},
e AS (SELECT doc_id AS i, component AS j FROM m1 WHERE doc_id <> component UNION SELECT doc_id, component FROM m2 WHERE doc_id <> component), f AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
g AS (SELECT i AS a, i AS b FROM f UNION SELECT g.a, f.j FROM g JOIN f ON g.b = f.i) SELECT a AS doc_id, min(b) AS component FROM g GROUP BY a""",
    "omission": f"""{_MARKED}, x AS (SELECT idx, k - 1 AS k, spans[k]."type" || chr(1) || lower(spans[k].surface) AS ent FROM (SELECT idx, spans, unnest(range(1, len(spans) + 1)) AS k FROM o)),
b AS (SELECT 'entity' AS mode, idx, ent, ent AS unit FROM x UNION ALL SELECT 'mention', idx, ent, k::VARCHAR FROM x),
u AS (SELECT mode, idx, unit, row_number() OVER (PARTITION BY mode ORDER BY md5('5|' || idx || '|' || unit)) AS r, count(*) OVER (PARTITION BY mode) AS units FROM (SELECT DISTINCT mode, idx, unit FROM b)),
g AS (SELECT *, r <= round_even(0.2 * units, 0) AS gone FROM u), e AS (SELECT mode, idx, ent, count(*) AS n, sum((NOT gone)::INT) AS k FROM b JOIN g USING (mode, idx, unit) GROUP BY ALL),
s AS (SELECT mode, sum(n)::BIGINT AS mentions, sum(n - k)::BIGINT AS mentions_dropped, sum(n * (n - 1) / 2)::BIGINT AS entity_pairs, sum(k * (n - k))::BIGINT AS inconsistent_pairs FROM e GROUP BY mode),
totals AS (SELECT mode, max(units) AS units, sum(gone::INT)::BIGINT AS units_dropped FROM g GROUP BY mode)
SELECT mode, units, units_dropped, mentions, mentions_dropped, entity_pairs, inconsistent_pairs, coalesce(inconsistent_pairs / nullif(entity_pairs, 0)::DOUBLE, 0.0) AS inconsistent_share FROM totals JOIN s USING (mode)""",
    "keyed_shingles": f"""WITH {_marked("contact")}, {released("RAW", "o")}, {graph("", 0.7).split("u AS")[0].rstrip().rstrip(",")} SELECT doc_id, len(s) AS n_ids FROM h""",
    "random_pair_similarity": f"""WITH {_marked("contact")}, {released("RAW", "o")}, {graph("", 0.7).split("u AS")[0].rstrip().rstrip(",")},
k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('6|' || doc_id)) - 1 AS k FROM r), n AS (SELECT count(*) AS n FROM r),
a AS (SELECT id, ('0x' || substr(md5('6|' || id || '|a'), 1, 12))::BIGINT % n AS x, ('0x' || substr(md5('6|' || id || '|b'), 1, 12))::BIGINT % (n - 1) AS y FROM (SELECT unnest(range(20000)) AS id), n),
b AS (SELECT x, y + (y >= x)::INT AS y FROM a),
j AS (SELECT len(list_intersect(f.s, g.s)) AS common, len(f.s) AS nf, len(g.s) AS ng FROM b JOIN k kf ON kf.k = x JOIN k kg ON kg.k = y JOIN h f ON f.doc_id = kf.doc_id JOIN h g ON g.doc_id = kg.doc_id)
SELECT count(*) AS pairs, round(avg((common / (nf + ng - common)::DOUBLE >= 0.7)::INT), 6) AS share FROM j""",
}
