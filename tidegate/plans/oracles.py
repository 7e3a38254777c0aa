"""DuckDB statements that compute the catalog's results independently of Spark.

They share the seeding expressions and the bank *data* with the catalog, nothing else: matching
is restated for RE2 (boundaries consumed instead of looked around, longest keyword first).
"""

from __future__ import annotations

from tidegate.functions.text import WHITESPACE
from tidegate.model import CLINICAL_LABELS, INJECTION_LABELS
from tidegate.plans import seeds
from tidegate.sources.banks import Banks, KeywordBank

_BANKS = Banks.load()
_CLINICAL_MODEL = "stand-in/clinical"
_INJECTION_MODEL = "stand-in/injection"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLANKS = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)
_SPACE_CLASS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_WORD = r"[^\p{L}\p{N}_]"


def _re2(pattern: str) -> str:
    """Boundaries become consumed neighbours; good for patterns whose ``\\b`` are outermost."""
    parts = pattern.replace(r"\s", _SPACE_CLASS).replace(r"\w", r"[\p{L}\p{N}_]").split(r"\b")
    out = parts[0]
    for index, part in enumerate(parts[1:]):
        opening = out == "" or out.endswith("|")
        out += (f"(?:^|{_NOT_WORD})" if opening else f"(?:$|{_NOT_WORD})") + part
    return out


def _matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quoted('(?i)' + _re2(pattern))})"


def _alternation(words: list[str]) -> str:
    longest = sorted(set(words), key=lambda w: (-len(w), w))
    return "|".join("".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}" for c in w) for w in longest)


def _first_keyword(column: str, bank: KeywordBank) -> str:
    body = _alternation([e.folded for e in bank.entries])
    pattern = _quoted(f"(^|[^0-9a-z_])({body})($|[^0-9a-z_])")
    hit = f"nullif(regexp_extract({column}, {pattern}, 2), '')"
    odd = [e for e in bank.entries if e.folded != e.keyword]
    for e in odd:
        hit = f"(CASE WHEN {hit} = {_quoted(e.folded)} THEN {_quoted(e.keyword)} ELSE {hit} END)"
    return hit


def _all_keywords(column: str, bank: KeywordBank) -> str:
    """Every separator is doubled first, so that neighbouring hits can each consume one."""
    def double(text: str) -> str:
        return "".join(c if c.isalnum() or c == "_" else c + c for c in text)

    doubled = f"regexp_replace({column}, '([^0-9a-z_])', '\\1\\1', 'g')"
    body = _alternation([double(e.folded) for e in bank.entries])
    pattern = _quoted(f"(^|[^0-9a-z_])({body})($|[^0-9a-z_])")
    halves = "x"
    for sep in sorted({c for e in bank.entries for c in e.folded if not (c.isalnum() or c == "_")}):
        halves = f"replace({halves}, {_quoted(sep + sep)}, {_quoted(sep)})"
    for e in bank.entries:
        if e.folded != e.keyword:
            halves = f"(CASE WHEN {halves} = {_quoted(e.folded)} THEN {_quoted(e.keyword)} ELSE {halves} END)"
    return f"list_transform(regexp_extract_all({doubled}, {pattern}, 2), lambda x: {halves})"


def _case(column: str, table: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in table.items())
    return f"CASE upper({column}) {arms} ELSE {default} END"


# --- shared relations ---------------------------------------------------------------------------


def _docs(text: str = seeds.DOCUMENT_TEXT, extra: str = "") -> str:
    return f"""(SELECT CAST(doc_id AS VARCHAR) AS prompt_id, {text} AS text, {seeds.SESSION} AS session_id,
        source{extra} FROM documents)"""


_TURNS = f"""(SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS prompt_id,
    {seeds.TURN_TEXT} AS text, CAST(conv_id AS VARCHAR) AS session_id, role AS source FROM conversations)"""

_EVERYTHING = f"""(SELECT 'd' || prompt_id AS prompt_id, text, session_id, source FROM {_docs()}
    UNION ALL SELECT prompt_id, text, session_id, source FROM {_TURNS}
    UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html, NULL, 'pages' FROM pages
    UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), text, NULL, 'benchmark' FROM benchmark)"""

_REASON = f"""CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'too_short'
    WHEN length(text) > 8192 THEN 'too_long' WHEN trim(text, {_BLANKS}) = '' THEN 'blank' END"""


def _accepted(relation: str) -> str:
    return f"""(SELECT * REPLACE (trim(text, {_BLANKS}) AS text), lower(trim(text, {_BLANKS})) AS l
        FROM {relation} WHERE text IS NOT NULL AND length(text) BETWEEN 1 AND 8192
        AND trim(text, {_BLANKS}) <> '')"""


def _whole(relation: str) -> str:
    """Every text that is there, whole, as the matchers take it."""
    return f"(SELECT *, lower(text) AS l FROM {relation} WHERE text IS NOT NULL)"


def _rules(relation: str, texts=_accepted) -> str:
    """Prompts with the rule stage's label and trigger."""
    bypass = " ".join(f"WHEN {_matches('l', p.pattern)} THEN '{p.id}'" for p in _BANKS.patterns.patterns)
    return f"""(SELECT *, CASE WHEN bp IS NOT NULL THEN 'Malign' WHEN ck IS NOT NULL THEN 'Crisis'
            WHEN mk IS NOT NULL THEN 'Malign' ELSE 'Valid' END AS rl,
        CASE WHEN bp IS NOT NULL THEN 'bypass:' || bp WHEN ck IS NOT NULL THEN 'keyword:' || ck
            WHEN mk IS NOT NULL THEN 'keyword:' || mk END AS rt
        FROM (SELECT *, CASE {bypass} END AS bp, {_first_keyword('l', _BANKS.crisis)} AS ck,
            {_first_keyword('l', _BANKS.malign)} AS mk FROM {texts(relation)}))"""


_CODE = "CASE {} WHEN 'Valid' THEN 100 WHEN 'Malign' THEN 400 WHEN 'Crisis' THEN 406 ELSE 500 END"


def _code(label: str) -> str:
    return f"CAST({_CODE.format(label)} AS INTEGER)"


_PREDICTIONS = f""", {seeds.CLINICAL_SHAPE} AS shape, {seeds.CLINICAL_LABEL} AS craw,
    {seeds.CLINICAL_SCORE} AS cscore, {seeds.ATTACK_LABEL} AS araw, {seeds.ATTACK_SCORE} AS ascore"""


def _model(prefix: str, labels: dict[str, str], threshold: float, failed: str) -> str:
    """Columns <prefix>fail, <prefix>label for one model stage."""
    mapped = f"({_case(prefix + 'raw', labels, _quoted('Valid'))})"
    gated = f"CASE WHEN {prefix}score < {threshold} AND {mapped} <> 'Valid' THEN 'Valid' ELSE {mapped} END"
    return f"""({failed}) AS {prefix}fail, {gated} AS {prefix}label"""


_CFAIL = "shape <> 9 OR cscore < 0 OR cscore > 1"
_AFAIL = "ascore < 0 OR ascore > 1"


def _modelled(clinical: float = 0.75, attack: float = 0.75) -> str:
    """Accepted documents with the rule result and both model results."""
    return f"""(SELECT *, {_model('c', CLINICAL_LABELS, clinical, _CFAIL)},
        {_model('a', INJECTION_LABELS, attack, _AFAIL)},
        'model:{_CLINICAL_MODEL}|raw_label:' || craw AS ctrig,
        'model:{_INJECTION_MODEL}|raw_label:' || araw AS atrig
        FROM {_rules(_docs(extra=_PREDICTIONS))})"""


def _verdict(relation: str, stages: int = 3) -> str:
    """Chain of rules, clinical, injection (the first ``stages`` of them)."""
    third = stages > 2
    attack_fail = "WHEN afail THEN 'E'" if third else ""
    attack_block = "WHEN alabel <> 'Valid' THEN 'A'" if third else ""
    return f"""(SELECT *, CASE won WHEN 'E' THEN 'Server Error' WHEN 'R' THEN rl WHEN 'C' THEN clabel
            WHEN 'A' THEN alabel ELSE 'Valid' END AS label
        FROM (SELECT *, CASE WHEN rl <> 'Valid' THEN 'R' WHEN cfail THEN 'E' WHEN clabel <> 'Valid' THEN 'C'
            {attack_fail} {attack_block} ELSE 'V' END AS won FROM {relation}))"""


_FLAT = f"""SELECT prompt_id, {_code('label')} AS code, label,
    CASE won WHEN 'E' THEN NULL WHEN 'C' THEN 'semantic_bert' WHEN 'A' THEN 'attack_detection'
        ELSE 'deterministic' END AS stage,
    CASE won WHEN 'R' THEN rt WHEN 'C' THEN ctrig WHEN 'A' THEN atrig END AS triggered_by,
    CASE won WHEN 'E' THEN 'System integrity error' END AS reason,
    CASE won WHEN 'E' THEN CAST(0 AS DOUBLE) WHEN 'C' THEN cscore WHEN 'A' THEN ascore
        ELSE CAST(1 AS DOUBLE) END AS score,
    CASE won WHEN 'E' THEN '' ELSE text END AS processed_text FROM """

_DEFAULT = f"""(SELECT prompt_id, session_id, source, {_code('rl')} AS code, rl AS label,
    'deterministic' AS stage, rt AS triggered_by, CAST(1 AS DOUBLE) AS score, text FROM {{}})"""


def _default(relation: str = _EVERYTHING) -> str:
    return _DEFAULT.format(_rules(relation))


# Registered stages of the full chain with the condition under which each ran.
_RAN = f"""(SELECT *, true AS r_ran, rl = 'Valid' AS c_ran,
    rl = 'Valid' AND NOT cfail AND clabel = 'Valid' AS a_ran FROM {_modelled()})"""


def _long(relation: str) -> str:
    """One row per prompt and stage that ran."""
    return f"""(SELECT prompt_id, 0 AS ord, 'deterministic' AS stage, rl AS label, CAST(1 AS DOUBLE) AS score,
            rt AS trig, false AS failed FROM {relation} WHERE r_ran
        UNION ALL SELECT prompt_id, 1, 'semantic_bert', clabel, cscore, ctrig, cfail FROM {relation} WHERE c_ran
        UNION ALL SELECT prompt_id, 2, 'attack_detection', alabel, ascore, atrig, afail FROM {relation} WHERE a_ran)"""


_RANK = "CASE label WHEN 'Valid' THEN 0 WHEN 'Server Error' THEN 1 WHEN 'Malign' THEN 2 ELSE 3 END"


def _merge(long: str) -> str:
    """Verdict per prompt from long rows: failure first, then rank, then the earliest stage."""
    return f"""SELECT prompt_id, {_code('label')} AS code, label, stage,
        trig AS triggered_by, score FROM (
        SELECT prompt_id, CASE WHEN bad THEN 'Server Error' ELSE label END AS label,
            CASE WHEN bad THEN NULL ELSE stage END AS stage, CASE WHEN bad THEN NULL ELSE trig END AS trig,
            CASE WHEN bad THEN CAST(0 AS DOUBLE) ELSE score END AS score
        FROM (SELECT *, bool_or(failed) OVER (PARTITION BY prompt_id) AS bad,
            row_number() OVER (PARTITION BY prompt_id ORDER BY {_RANK} DESC, ord) AS place FROM {long})
        WHERE place = 1)"""


_STUBS = f"""(SELECT prompt_id, CAST(prompt_id AS BIGINT) AS n FROM {_accepted(_docs())})"""
_STUB_ROWS = f"""(SELECT prompt_id, 0 AS ord, 'first' AS stage,
        CASE WHEN n % 3 = 0 THEN 'Malign' ELSE 'Valid' END AS label,
        CAST(n % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS trig, false AS failed
        FROM {_STUBS}
    UNION ALL SELECT prompt_id, 1, 'second', CASE n % 5 WHEN 0 THEN 'Crisis' WHEN 1 THEN 'Server Error'
        ELSE 'Valid' END, CAST(0.5 AS DOUBLE), NULL, n % 31 = 0 FROM {_STUBS}
    UNION ALL SELECT prompt_id, 2, 'third', CASE WHEN n % 2 = 0 THEN 'Malign' ELSE 'Valid' END,
        CAST(0.25 AS DOUBLE), NULL, false FROM {_STUBS} WHERE n % 31 <> 0)"""


def _letters(letters: str, text: str = "text") -> str:
    kept = " + ".join(f"(length({text}) - length(replace({text}, '{c}', '')))" for c in letters)
    return f"CAST({kept} AS DOUBLE) / CAST(length({text}) AS DOUBLE)"


_TENSE = """CASE WHEN (length(text) - length(replace(text, 'th', ''))) > (length(text) - length(replace(text, 'en', '')))
    THEN 'LABEL_1' ELSE 'LABEL_0' END"""


def _classified(error: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"""SELECT prompt_id, CASE WHEN e IS NULL THEN 'semantic_bert' END AS stage_name,
        CASE WHEN e IS NULL THEN (CASE WHEN raw = 'LABEL_1' AND score >= 0.4 THEN 'Crisis' ELSE 'Valid' END) END AS label,
        CASE WHEN e IS NULL THEN score END AS confidence,
        CASE WHEN e IS NULL THEN 'model:{_CLINICAL_MODEL}|raw_label:' || raw END AS triggered_by,
        CASE WHEN e IS NULL THEN raw = 'LABEL_1' AND score >= 0.4 END AS short_circuit, e AS error_type
        FROM (SELECT prompt_id, {_TENSE} AS raw, {_letters('aeiou')} AS score, {error} AS e
              FROM {_accepted(_docs())})"""


def _stage_columns(prefix: str, name: str, error: str) -> str:
    fail = f"{prefix}fail"
    return f"""SELECT prompt_id, CASE WHEN NOT {fail} THEN '{name}' END AS stage_name,
        CASE WHEN NOT {fail} THEN {prefix}label END AS label, CASE WHEN NOT {fail} THEN {prefix}score END AS confidence,
        CASE WHEN NOT {fail} THEN {prefix}trig END AS triggered_by,
        CASE WHEN NOT {fail} THEN {prefix}label <> 'Valid' END AS short_circuit,
        CASE WHEN {fail} THEN '{error}' END AS error_type FROM {_modelled(attack=0.85)}"""


def _usage() -> str:
    lists = ", ".join(
        f"list_distinct({_all_keywords('l', bank)}) AS {bank.name}" for bank in (_BANKS.crisis, _BANKS.malign)
    )
    entries = ", ".join(
        f"('{bank.name}', '{e.category}', {e.level if e.level is not None else 'NULL'}, {_quoted(e.keyword)})"
        for bank in (_BANKS.crisis, _BANKS.malign)
        for e in bank.entries
    )
    return f"""WITH found AS (SELECT prompt_id, {lists} FROM {_whole(_docs())}),
        hits AS (SELECT prompt_id, 'crisis' AS bank, unnest(crisis) AS keyword FROM found
            UNION ALL SELECT prompt_id, 'malign', unnest(malign) FROM found),
        bank AS (SELECT bank, category, CAST(level AS INTEGER) AS level, keyword
            FROM (VALUES {entries}) v(bank, category, level, keyword)),
        usage AS (SELECT b.bank, b.category, b.level, b.keyword, count(h.prompt_id) AS prompts
            FROM bank b LEFT JOIN hits h ON h.bank = b.bank AND h.keyword = b.keyword
            GROUP BY b.bank, b.category, b.level, b.keyword) """


def _pattern_usage() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS ord, '{p.id}' AS id, {_quoted(p.pattern)} AS pattern,
            count(*) FILTER (WHERE {_matches('l', p.pattern)}) AS prompts FROM a"""
        for i, p in enumerate(_BANKS.patterns.patterns)
    )
    return f"WITH a AS (SELECT l FROM {_whole(_docs())}) {rows}"


def _all_patterns() -> str:
    ids = ", ".join(
        f"CASE WHEN {_matches('l', p.pattern)} THEN '{p.id}' END"
        for p in (*_BANKS.patterns.patterns, *seeds.prose_patterns().patterns)
    )
    return f"""SELECT prompt_id, concat_ws(',', {ids}) AS hits FROM {_whole(_EVERYTHING)}"""


def _pattern_table() -> str:
    """Documents and the patterns of the table that they match."""
    fixed = [*seeds.PROSE_PATTERNS, (seeds.CONDITIONAL[0], seeds.CONDITIONAL[2])]
    plain = " UNION ALL ".join(
        f"SELECT prompt_id, '{name}' AS id, {n} AS ord FROM d WHERE {_matches('l', body)}" for n, (name, body) in enumerate(fixed)
    )
    return f"""WITH d AS (SELECT prompt_id, l FROM {_whole(_docs())}),
        w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
        places AS (SELECT item_id, w, unnest(range(len(w) - 2)) AS z FROM w),
        p AS (SELECT 'b' || item_id || '-' || z AS id, 1000 + 1000000 * CAST(item_id AS BIGINT) + z AS ord,
            w[z + 1] AS a, w[z + 2] AS b, w[z + 3] AS c FROM places),
        hits AS ({plain} UNION ALL SELECT prompt_id, id, ord FROM d JOIN p
            ON contains(l, a) AND contains(l, b) AND contains(l, c)
            AND regexp_matches(l, '(^|[^a-z])' || a || '[^a-z]+' || b || '[^a-z]+' || c || '($|[^a-z])')) """


_RAW = f"""(SELECT CAST(doc_id AS VARCHAR) AS prompt_id, {seeds.CLINICAL_LABEL} AS raw_label,
    {seeds.CLINICAL_SCORE} AS score FROM documents)"""
_MAPPED = f"(SELECT *, {_case('raw_label', CLINICAL_LABELS, _quoted('Valid'))} AS mapped FROM {_RAW})"


def _gate(threshold: float) -> str:
    return f"CASE WHEN score < {threshold} AND mapped <> 'Valid' THEN 'Valid' ELSE mapped END"


_BODY_KIND = "doc_id % 9"
_JSON = f"""SELECT CAST(doc_id AS VARCHAR) AS prompt_id,
    CASE WHEN {_BODY_KIND} IN (4, 6, 7, 8) THEN text END AS text,
    CASE WHEN {_BODY_KIND} = 4 THEN source WHEN {_BODY_KIND} = 1 THEN 'only' END AS session_id,
    CASE {_BODY_KIND} WHEN 0 THEN 'not_text' WHEN 1 THEN 'missing' WHEN 2 THEN 'malformed'
        WHEN 3 THEN 'bad_session' WHEN 5 THEN 'malformed'
        ELSE (CASE WHEN length(text) > 8192 THEN 'too_long' END) END AS reject_reason FROM documents"""

_DIGEST = "sha256(prompt_id || chr(31) || text)"
_UUID = " || '-' || ".join(f"substring({_DIGEST}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

_PARSE = f"""SELECT CAST(doc_id AS VARCHAR) AS prompt_id,
    CASE WHEN k IN (6, 7) THEN 'toxic' WHEN k > 8 THEN {seeds.CLINICAL_LABEL} END AS label,
    CASE WHEN k = 6 THEN CAST(0.5 AS DOUBLE) WHEN k = 7 THEN CAST(1 AS DOUBLE)
        WHEN k > 8 THEN {seeds.CLINICAL_SCORE} END AS score,
    k NOT IN (6, 7, 9, 10, 11) AS failed FROM (SELECT *, doc_id % 12 AS k FROM documents)"""

_GUARD = f"""SELECT prompt_id, {_code('label')} AS code, label,
    CASE WHEN label = 'Server Error' THEN CAST(0 AS DOUBLE) ELSE s END AS score,
    CASE WHEN label = 'Server Error' THEN 'System integrity error' END AS reason
    FROM (SELECT *, CASE WHEN n % 6 IN (0, 1, 2) THEN 'Server Error'
              WHEN s < 0.75 THEN 'Valid' ELSE {_case('craw', CLINICAL_LABELS, _quoted('Valid'))} END AS label
        FROM (SELECT *, CAST(prompt_id AS BIGINT) AS n,
            CASE CAST(prompt_id AS BIGINT) % 6 WHEN 3 THEN CAST(1 AS DOUBLE) WHEN 4 THEN CAST(0 AS DOUBLE)
            ELSE cscore END AS s FROM {_accepted(_docs(extra=_PREDICTIONS))}))"""

# Clinical model first, rules second: an error hides everything.
_CLINICAL_FIRST = f"""SELECT prompt_id, {_code('label')} AS code, label,
    CASE WHEN cfail THEN NULL WHEN clabel <> 'Valid' OR rl = 'Valid' THEN 'semantic_bert'
        ELSE 'deterministic' END AS stage,
    CASE WHEN cfail THEN NULL WHEN clabel <> 'Valid' OR rl = 'Valid' THEN ctrig ELSE rt END AS triggered_by,
    CASE WHEN cfail THEN 'System integrity error' END AS reason,
    CASE WHEN cfail THEN CAST(0 AS DOUBLE) WHEN clabel <> 'Valid' OR rl = 'Valid' THEN cscore
        ELSE CAST(1 AS DOUBLE) END AS score,
    CASE WHEN cfail THEN '' ELSE text END AS processed_text
    FROM (SELECT *, CASE WHEN cfail THEN 'Server Error' WHEN clabel <> 'Valid' THEN clabel ELSE rl END AS label
        FROM {_modelled()})"""

_CUSTOM = f"""SELECT prompt_id, {_code('label')} AS code, label,
    CASE w WHEN 'E' THEN NULL WHEN 'S' THEN 'shouting' ELSE 'deterministic' END AS stage,
    CASE w WHEN 'R' THEN rt WHEN 'S' THEN 'shouting' END AS triggered_by,
    CASE w WHEN 'E' THEN 'System integrity error' END AS reason,
    CASE w WHEN 'E' THEN CAST(0 AS DOUBLE) WHEN 'S' THEN least(CAST(1 AS DOUBLE), CAST(t AS DOUBLE) / CAST(64 AS DOUBLE))
        ELSE CAST(1 AS DOUBLE) END AS score,
    CASE w WHEN 'E' THEN '' ELSE text END AS processed_text
    FROM (SELECT *, CASE w WHEN 'E' THEN 'Server Error' WHEN 'S' THEN 'Malign' ELSE rl END AS label
        FROM (SELECT *, CASE WHEN rl <> 'Valid' THEN 'R' WHEN session_id = 'src7' THEN 'E' WHEN t > 8 THEN 'S'
            ELSE 'R' END AS w FROM (SELECT *, length(text) - length(replace(text, 'T', '')) AS t
            FROM {_rules(_docs())})))"""

_BRITTLE = """CASE WHEN length(text) % 11 = 0 THEN 'RuntimeError' WHEN length(text) % 11 IN (1, 2, 3, 4)
    THEN 'ValueError' END"""
_HANG = "CASE WHEN length(text) % 101 = 0 THEN 'TimeoutError' END"

_SCORED = f"""(SELECT *, false AS cfail, false AS afail,
    CASE WHEN craw = 'LABEL_1' AND cscore >= 0.4 THEN 'Crisis' ELSE 'Valid' END AS clabel,
    CASE WHEN araw = 'INJECTION' AND ascore >= 0.25 THEN 'Malign' ELSE 'Valid' END AS alabel,
    'model:{_CLINICAL_MODEL}|raw_label:' || craw AS ctrig, 'model:{_INJECTION_MODEL}|raw_label:' || araw AS atrig
    FROM (SELECT *, {_TENSE} AS craw, {_letters('aeiou')} AS cscore,
        CASE WHEN (length(text) - length(replace(text, 'o', ''))) > (length(text) - length(replace(text, 'i', '')))
            THEN 'INJECTION' ELSE 'SAFE' END AS araw, {_letters('ntrs')} AS ascore FROM {_rules(_docs())}))"""

_TRACE = f"""WITH long AS {_long(_RAN)}, failed AS (SELECT prompt_id FROM long WHERE failed)
    SELECT prompt_id, CAST(ord AS INTEGER) AS ord, stage, label, score, trig AS triggered_by,
        label IN ('Crisis', 'Malign') AS short_circuit FROM long
    WHERE prompt_id NOT IN (SELECT prompt_id FROM failed)"""

_SKIPPED = f"""(SELECT prompt_id, unnest(list_filter(['deterministic', 'semantic_bert', 'attack_detection'],
        lambda s: bad OR (s = 'semantic_bert' AND NOT c_ran) OR (s = 'attack_detection' AND NOT a_ran))) AS stage,
        bad_stage FROM (SELECT *, (c_ran AND cfail) OR (a_ran AND afail) AS bad,
            CASE WHEN c_ran AND cfail THEN 'semantic_bert' WHEN a_ran AND afail THEN 'attack_detection' END AS bad_stage
        FROM {_RAN}))"""

_REORDERED = f"""SELECT prompt_id, {_code('label')} AS code,
    CAST(CASE WHEN bad THEN 0 WHEN first <> 'Valid' THEN 1 WHEN clabel <> 'Valid' THEN 2 ELSE 3 END AS INTEGER) AS executed,
    CASE WHEN bad THEN 'attack_detection,semantic_bert,attack_detection'
        WHEN first <> 'Valid' THEN 'semantic_bert' ELSE '' END AS skipped, CAST(3 AS INTEGER) AS total_stages
    FROM (SELECT *, afail OR (first = 'Valid' AND cfail) AS bad,
        CASE WHEN afail OR (first = 'Valid' AND cfail) THEN 'Server Error' WHEN first <> 'Valid' THEN first
            WHEN clabel <> 'Valid' THEN clabel ELSE 'Valid' END AS label
        FROM (SELECT *, alabel AS first FROM {_modelled()}))"""

_TIMING = f"""SELECT stage, executed, CASE stage WHEN 'deterministic' THEN 0 ELSE executed END AS timed,
    CASE stage WHEN 'deterministic' THEN NULL ELSE true END AS measured
    FROM (SELECT 'deterministic' AS stage, count(*) AS executed FROM {_rules(_docs())}
        UNION ALL SELECT 'semantic_bert', count(*) FILTER (WHERE rl = 'Valid') FROM {_rules(_docs())})"""

# Multinomial naive Bayes over words, with one added to each count.
_WORD_MODEL = f"""WITH bags AS (
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS word FROM documents WHERE text IS NOT NULL
    ), learnt AS (
        SELECT l.doc_id, l.toxic FROM labels l JOIN documents d USING (doc_id)
        WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL
    ), counts AS (
        SELECT word, count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1
        FROM bags JOIN learnt USING (doc_id) GROUP BY word
    ), weights AS (
        SELECT word, ln(n0 + 1) - ln(sum(n0) OVER () + count(*) OVER ()) AS w0,
               ln(n1 + 1) - ln(sum(n1) OVER () + count(*) OVER ()) AS w1 FROM counts
    ), priors AS (
        SELECT ln(count(*) FILTER (toxic = 0) + 1) AS p0, ln(count(*) FILTER (toxic = 1) + 1) AS p1 FROM learnt
    ), sums AS (
        SELECT doc_id, sum(w0) AS s0, sum(w1) AS s1 FROM bags JOIN weights USING (word) GROUP BY doc_id
    ), odds AS (
        SELECT CAST(d.doc_id AS VARCHAR) AS prompt_id, p1 - p0 + coalesce(s1 - s0, 0) AS x
        FROM documents d CROSS JOIN priors LEFT JOIN sums USING (doc_id) WHERE d.text IS NOT NULL
    ), scored AS (
        SELECT prompt_id, x > 0 AS dark, 1 / (1 + exp(-abs(x))) AS score FROM odds
    )
    SELECT prompt_id, CASE WHEN dark AND score >= 0.75 THEN 'Crisis' ELSE 'Valid' END AS label,
        'model:{_CLINICAL_MODEL}|raw_label:' || CASE WHEN dark THEN 'LABEL_1' ELSE 'LABEL_0' END AS triggered_by,
        round(score, 6) AS score FROM scored"""

ORACLES: dict[str, str] = {
    "profile_default": f"""SELECT prompt_id, source, code, label, stage, triggered_by, score FROM {_default()}""",
    "profile_clinical": _FLAT + _verdict(_modelled(clinical=0.9), 2),
    "profile_full": _FLAT + _verdict(_modelled()),
    "profile_full_scored": _FLAT + _verdict(_SCORED),
    "validate_prompts": f"""SELECT prompt_id, session_id, text, CAST(length(text) AS INTEGER) AS chars
        FROM {_accepted(_docs(seeds.RAW_TEXT))}""",
    "rejected_prompts": f"""SELECT prompt_id, {_REASON} AS reject_reason, CAST(length(text) AS INTEGER) AS raw_chars
        FROM {_docs(seeds.RAW_TEXT)} WHERE {_REASON} IS NOT NULL""",
    "json_intake": _JSON,
    "correlation_id": f"""SELECT prompt_id, CASE WHEN source = 'system' THEN 'req-' || prompt_id ELSE {_UUID} END
        AS correlation_id FROM {_TURNS}""",
    "keyword_bank": _usage() + "SELECT bank, category, level, keyword, prompts FROM usage",
    "pattern_bank": _pattern_usage(),
    "bank_inventory": _usage() + """SELECT bank, category, max(level) AS level, count(DISTINCT keyword) AS keywords,
        count(*) FILTER (WHERE prompts > 0) AS keywords_hit, CAST(sum(prompts) AS BIGINT) AS hits
        FROM usage GROUP BY bank, category""",
    "pattern_first_hit": f"SELECT prompt_id, bp AS hit FROM {_rules(_docs(), _whole)}",
    "pattern_all_hits": _all_patterns(),
    "pattern_table_hits": _pattern_table() + "SELECT DISTINCT prompt_id, id, CAST(NULL AS VARCHAR) AS error FROM hits",
    "pattern_table_first": _pattern_table() + "SELECT prompt_id, arg_min(id, ord) AS id FROM hits GROUP BY prompt_id",
    "crisis_first_hit": f"SELECT prompt_id, ck AS hit FROM {_rules(_docs(), _whole)}",
    "malign_first_hit": f"SELECT prompt_id, mk AS hit FROM {_rules(_docs(), _whole)}",
    "keyword_all_hits": f"""SELECT prompt_id, array_to_string({_all_keywords('l', seeds.prose_bank())}, '|') AS hits
        FROM {_whole(_docs())}""",
    "keyword_ngram_join": f"""SELECT * FROM (SELECT prompt_id, ck AS crisis, mk AS malign,
        {_first_keyword('l', seeds.prose_bank())} AS prose FROM {_rules(_docs(), _whole)})
        WHERE crisis IS NOT NULL OR malign IS NOT NULL OR prose IS NOT NULL""",
    "dictionary_odd_keywords": f"""SELECT * FROM (SELECT prompt_id, ck AS crisis,
        {_first_keyword('l', seeds.odd_bank())} AS odd FROM {_rules(_docs(), _whole)})
        WHERE crisis IS NOT NULL OR odd IS NOT NULL""",
    "rule_stage": f"""SELECT prompt_id, 'deterministic' AS stage_name, rl AS label, CAST(1 AS DOUBLE) AS confidence,
        rt AS triggered_by, rl <> 'Valid' AS short_circuit FROM {_rules(_docs())}""",
    "dictionary_rule_stage": f"""SELECT prompt_id, rl AS label, rt AS triggered_by FROM {_rules(_docs())}""",
    "dictionary_rule_shuffled": f"""SELECT prompt_id, rl AS label, rt AS triggered_by FROM {_rules(_docs())}""",
    "verdicts_of_source": f"""SELECT prompt_id, source, code, label, stage, triggered_by, score FROM {_default()}
        WHERE source = 'src3'""",
    "prediction_table": f"""SELECT d.prompt_id, CASE WHEN l.toxic = 1 THEN 'Malign' WHEN l.toxic = 0 THEN 'Valid' END AS label,
        CASE WHEN l.toxic IS NULL THEN true ELSE false END AS failed
        FROM {_accepted(_docs())} d LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = d.prompt_id""",
    "trace_json": f"""WITH t AS ({_TRACE}) SELECT f.prompt_id, f.code, f.label, coalesce(max(t.ord) + 1, 0)::INTEGER AS executed,
        max(CASE WHEN t.ord = 0 THEN t.label END) AS first_label, CAST(3 AS INTEGER) AS total_stages
        FROM ({_FLAT + _verdict(_modelled())}) f LEFT JOIN t USING (prompt_id) GROUP BY f.prompt_id, f.code, f.label""",
    "severity_enrichment": _usage() + """SELECT h.bank, h.keyword, h.prompt_id, b.category, b.level
        FROM hits h LEFT JOIN bank b ON b.bank = h.bank AND b.keyword = h.keyword""",
    "prediction_parse": _PARSE,
    "label_normalise": f"""SELECT prompt_id, raw_label, mapped AS clinical,
        {_case('raw_label', INJECTION_LABELS, _quoted('Valid'))} AS injection FROM {_MAPPED}""",
    "threshold_gate": f"""SELECT prompt_id, mapped, score, {_gate(0.5)} AS at_50, {_gate(0.75)} AS at_75,
        {_gate(0.85)} AS at_85 FROM {_MAPPED}""",
    "score_guard": _GUARD,
    "semantic_stage": _stage_columns("c", "semantic_bert", "ValueError"),
    "attack_stage": _stage_columns("a", "attack_detection", "ValueError"),
    "ml_scored": _WORD_MODEL,
    "score_text": _classified(),
    "scorer_errors": _classified(_BRITTLE),
    "scorer_timeout": _classified(_HANG),
    "short_circuit": f"""SELECT prompt_id, CAST(ord AS INTEGER) AS ord, CASE WHEN failed THEN NULL ELSE stage END AS stage_name,
        CASE WHEN failed THEN NULL ELSE label END AS label, failed FROM {_long(_RAN)}""",
    "merge_wide": _merge(_STUB_ROWS),
    "merge_long": _merge(_STUB_ROWS),
    "audit_all_stages": _merge(_long(
        f"(SELECT *, true AS r_ran, true AS c_ran, NOT cfail AS a_ran FROM {_modelled()})")),
    "fail_closed": _CLINICAL_FIRST,
    "custom_stage": _CUSTOM,
    "verdict_json": f"""SELECT prompt_id, session_id, code, label, text AS processed_text, score, stage, triggered_by
        FROM {_default(_TURNS)}""",
    "trace_flat": _TRACE,
    "skipped_stages": f"""SELECT prompt_id, CAST(3 AS INTEGER) AS total_stages,
        CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY CASE stage WHEN 'deterministic' THEN 0
            WHEN 'semantic_bert' THEN 1 ELSE 2 END) - 1 AS INTEGER) AS ord, stage FROM {_SKIPPED}""",
    "fail_closed_trace": _REORDERED,
    "stage_timing": _TIMING,
    "verdict_rollup": f"""SELECT source, label, CAST(grouping(source, label) AS INTEGER) AS level, count(*) AS prompts
        FROM {_default()} GROUP BY ROLLUP (source, label)""",
    "verdict_counts": f"SELECT label, code, count(*) AS prompts FROM {_default()} GROUP BY label, code",
    "stage_funnel": f"""WITH trace AS ({_TRACE}), skipped AS {_SKIPPED}
        SELECT stage, CAST(sum(x) AS BIGINT) AS executed, CAST(sum(b) AS BIGINT) AS blocked,
            CAST(sum(s) AS BIGINT) AS skipped, CAST(sum(f) AS BIGINT) AS failed
        FROM (SELECT stage, 1 AS x, CAST(short_circuit AS INTEGER) AS b, 0 AS s, 0 AS f FROM trace
            UNION ALL SELECT stage, 0, 0, 1, CASE WHEN stage = bad_stage THEN 1 ELSE 0 END FROM skipped)
        GROUP BY stage""",
    "observed_funnel": f"""WITH trace AS ({_TRACE}), skipped AS {_SKIPPED}
        SELECT stage, CAST(sum(x) AS BIGINT) AS executed, CAST(sum(b) AS BIGINT) AS blocked,
            CAST(sum(s) AS BIGINT) AS skipped, CAST(sum(f) AS BIGINT) AS failed
        FROM (SELECT stage, 1 AS x, CAST(short_circuit AS INTEGER) AS b, 0 AS s, 0 AS f FROM trace
            UNION ALL SELECT stage, 0, 0, 1, CASE WHEN stage = bad_stage THEN 1 ELSE 0 END FROM skipped)
        GROUP BY stage""",
    "top_triggers": f"""SELECT triggered_by, label, count(*) AS prompts FROM {_default()}
        WHERE triggered_by IS NOT NULL GROUP BY triggered_by, label ORDER BY prompts DESC, triggered_by, label LIMIT 10""",
    "length_profile": f"""SELECT label, count(*) AS prompts, CAST(min(n) AS INTEGER) AS min_chars,
        CAST(max(n) AS INTEGER) AS max_chars, CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_chars,
        quantile_cont(CAST(n AS DOUBLE), 0.5) AS p50_chars, quantile_cont(CAST(n AS DOUBLE), 0.95) AS p95_chars
        FROM (SELECT label, CASE won WHEN 'E' THEN 0 ELSE length(text) END AS n FROM {_verdict(_modelled())})
        GROUP BY label""",
    "unmapped_labels": f"""SELECT raw_label, count(*) AS prompts FROM {_RAW}
        WHERE upper(raw_label) NOT IN ({', '.join(map(_quoted, CLINICAL_LABELS))}) GROUP BY raw_label""",
    "gate_report": f"""SELECT mapped, count(*) FILTER (WHERE {_gate(0.75)} = mapped) AS kept,
        count(*) FILTER (WHERE {_gate(0.75)} <> mapped) AS downgraded FROM {_MAPPED} GROUP BY mapped""",
    "stream_screen": f"SELECT prompt_id, code, label, stage, triggered_by, score FROM {_default(_docs())}",
    "stream_dictionary": f"SELECT prompt_id, code, label, stage, triggered_by, score FROM {_default(_docs())}",
    "stream_rejects": f"""SELECT prompt_id, {_REASON} AS reject_reason FROM {_docs(seeds.RAW_TEXT)}
        WHERE {_REASON} IS NOT NULL""",
    "stream_counts": f"SELECT label, code, count(*) AS prompts FROM {_default(_docs())} GROUP BY label, code",
}
