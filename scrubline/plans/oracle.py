"""The registered queries in DuckDB SQL, to check results against.

DuckDB's pattern engine knows only ASCII word characters.  To check whole texts
all the same, each non-ASCII word character (and the underscore itself) is first
spelled as ``_00e9_``: a run of ASCII word characters no rule can match into.
That puts every word boundary where the Unicode rules have it.  The results are
spelled back at the end.
"""

from __future__ import annotations

from scrubline.functions import policy, prompts, risk
from scrubline.functions.rules import CATEGORIES, ENTITY_DEFAULT, ENTITY_TYPES, PASSES, RULES, SPAN_TOKENS, rule
from scrubline.operators.gate import (
    EMPTY_REPLY_TEXT,
    FALLBACK_MODEL,
    NOT_CONFIGURED_TEXT,
)
from scrubline.operators.access import MATRIX
from scrubline.operators.metrics import LATENCY_BOUNDS
from scrubline.plans import inputs

SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"


def lit(text: str) -> str:
    """A SQL string; line breaks are spelled out."""
    pieces = ["'" + piece.replace("'", "''") + "'" for piece in text.split("\n")]
    return "(" + " || chr(10) || ".join(pieces) + ")" if len(pieces) > 1 else pieces[0]


def pattern(java: str) -> str:
    """A rule's pattern as the SQL engine needs it over spelled-out text."""
    java = java.replace("[A-Za-z0-9._%+-]+", "(?:[A-Za-z0-9.%+-]|_00005f_)+")
    out, in_class, i = "", False, 0
    while i < len(java):
        two = java[i:i + 2]
        if two == r"\s":
            out += SPACES if in_class else f"[{SPACES}]"
            i += 2
        elif two.startswith("\\"):
            out += two
            i += 2
        else:
            in_class = java[i] == "[" or (in_class and java[i] != "]")
            out += java[i]
            i += 1
    return lit(out)


def spelled(text: str) -> str:
    return (
        f"CASE WHEN regexp_matches({text}, '[^\\x00-\\x7F]|_') THEN array_to_string(list_transform("
        f"string_split({text}, ''), lambda c: CASE WHEN c <> '' AND regexp_matches(c, '[^\\x00-\\x7F]|_') "
        f"AND regexp_matches(c, '{WORD}') THEN printf('_%06x_', unicode(c)) ELSE c END), '') ELSE {text} END"
    )


def restored(text: str) -> str:
    return (
        f"CASE WHEN contains({text}, '_') THEN array_to_string(list_transform("
        f"regexp_extract_all({text}, '(?s)_[0-9a-f]{{6}}_|[^_]+'), lambda p: CASE WHEN p[1] = '_' "
        f"THEN chr(('0x' || p[2:7])::INTEGER) ELSE p END), '') ELSE {text} END"
    )


def replaced(text: str, r) -> str:
    token = r.token.replace("$1", r"\1")
    return f"regexp_replace({text}, {pattern(r.pattern)}, {lit(token)}, 'g')"


def count_column(category: str) -> str:
    return f"n_{category}"


def scrubbed(source: str, text: str = "text", rules=RULES) -> str:
    """Common table expressions ending in ``done``.

    ``source`` is a query; ``done`` has its columns, ``t`` (scrubbed, spelled),
    ``scrubbed``, one count per category, ``redaction_count`` and ``cats``.
    """
    categories = [*CATEGORIES, *dict.fromkeys(r.category for r in rules if r.category not in CATEGORIES)]
    zeros = ", ".join(f"0 AS {count_column(c)}" for c in categories)
    steps = [f"src AS ({source})", f"s0 AS (SELECT *, {spelled(text)} AS t, {zeros} FROM src)"]
    at = 0
    for _ in range(PASSES):
        for r in rules:
            n = count_column(r.category)
            steps.append(
                f"s{at + 1} AS (SELECT * REPLACE ({replaced('t', r)} AS t, "
                f"{n} + len(regexp_extract_all(t, {pattern(r.pattern)})) AS {n}) FROM s{at})"
            )
            at += 1
    total = " + ".join(count_column(c) for c in categories)
    cats = ", ".join(f"CASE WHEN {count_column(c)} > 0 THEN '{c}' END" for c in categories)
    steps.append(
        f"done AS (SELECT *, {restored('t')} AS scrubbed, CAST({total} AS BIGINT) AS redaction_count, "
        f"concat_ws(',', {cats}) AS cats FROM s{at})"
    )
    return ",\n".join(steps)


def finds(text: str, java: str) -> str:
    return f"regexp_matches({text}, {pattern(java)})"


def name_pair(spelled_text: str) -> str:
    listed = "|".join(risk.CLINICAL_ALLOWLIST)
    return (
        f"list_filter(regexp_extract_all({spelled_text}, {pattern(risk.POSSIBLE_NAME)}), lambda m: "
        f"NOT regexp_matches(m, {pattern(f'(?i)^(?:{listed})' + chr(92) + 's')}) AND "
        f"NOT regexp_matches(m, {pattern('(?i)' + chr(92) + f's(?:{listed})$')}))[1]"
    )


def assessed(relation: str, spelled_text: str, plain_text: str, untouched: str) -> str:
    """``warned`` and ``rated``, on top of a relation that is already named."""
    warnings = ", ".join(
        [
            f"CASE WHEN {finds(spelled_text, risk.POSSIBLE_SSN)} THEN '{risk.SSN_WARNING}' END",
            f"CASE WHEN {finds(spelled_text, risk.POSSIBLE_PHONE)} THEN '{risk.PHONE_WARNING}' END",
            f"CASE WHEN {finds(spelled_text, risk.POSSIBLE_EMAIL)} THEN '{risk.EMAIL_WARNING}' END",
            f"'{risk.NAME_WARNING}' || {name_pair(spelled_text)}",
            f"CASE WHEN {untouched} AND strlen({plain_text}) > {risk.LONG_TEXT_BYTES} "
            f"THEN '{risk.UNTOUCHED_WARNING}' END",
        ]
    )
    return (
        f"warned AS (SELECT *, concat_ws('|', {warnings}) AS warnings FROM {relation}),\n"
        f"rated AS (SELECT *, CASE WHEN starts_with(warnings, '{risk.SSN_WARNING}') THEN 'high' "
        f"WHEN warnings = '' THEN 'low' ELSE 'medium' END AS residual_risk FROM warned)"
    )


# --- inputs -----------------------------------------------------------------

NOTES = (
    "SELECT o_orderkey AS note_id, o_custkey, o_orderdate, o_orderpriority AS source, "
    + inputs.NOTE_TEXT.format(us_date="strftime(o_orderdate, '%m/%d/%Y')")
    + " AS text FROM orders"
)
RAW_REQUESTS = f"""SELECT note_id AS request_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS ts,
  concat('user-', o_custkey) AS actor, 'operator' AS role, {inputs.PROMPT_TEXT} AS prompt, {inputs.SKILL} AS skill,
  {inputs.MODEL} AS model, {inputs.MODEL_ERROR} AS model_error, {inputs.UPSTREAM_STATUS} AS upstream_status,
  {inputs.UPSTREAM_BODY} AS upstream_body, {inputs.AUDIT_ERROR} AS audit_error,
  (note_id % 1000)::DOUBLE / 8 AS latency_ms FROM ({NOTES})"""
REQUESTS = f"SELECT * REPLACE (coalesce(skill, '{policy.DEFAULT_SKILL}') AS skill) FROM ({RAW_REQUESTS})"
AUDIT_EVENTS = f"""SELECT event_id, event_id + 1 AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ts,
  concat('user-', user_id) AS actor, CASE user_id % 2 WHEN 0 THEN 'operator' ELSE 'auditor' END AS role,
  event_type AS action, 'vault-answer' AS resource, {inputs.OUTCOME} AS outcome, {inputs.METADATA} AS metadata_json,
  concat('{{"actor":{{"a":null,"b":true}},"deid_warnings":[', CASE WHEN event_type = 'view'
    THEN '"possible_name_remainder:Nora Quill"' ELSE '' END, '],"latency_ms":',
    CASE WHEN event_id % 50 = 0 THEN '12.0' ELSE concat(value, '') END,
    ',"prompt_len":', event_id, ',"z":', replace(props, ' ', ''), '}}') AS canonical, value FROM events"""


def entry_hash(metadata: str = "canonical", outcome: str = "outcome") -> str:
    return (
        f"""sha256(concat('{{"action":"', action, '","actor":"', actor, '","metadata":', {metadata}, """
        f"""',"outcome":"', {outcome}, '","resource":"', resource, '","role":"', role, '","ts":"', ts, '"}}'))"""
    )


AUDIT = f"SELECT *, {entry_hash()} AS entry_hash FROM ({AUDIT_EVENTS})"
TAMPERED = f"""SELECT * REPLACE (CASE WHEN value < 20 THEN 'ok-edited' ELSE outcome END AS outcome,
  CASE WHEN value > 400 THEN NULL ELSE canonical END AS canonical), value >= 20 AND value <= 400 AS hash_valid
  FROM ({AUDIT})"""
EARLY = f"SELECT * FROM ({AUDIT}) WHERE ts < '{inputs.CUTOVER}'"
DOUBLED = f"""SELECT * FROM ({AUDIT}) UNION ALL
  SELECT * REPLACE (id + 1000000000 AS id) FROM ({AUDIT}) WHERE action = 'error'"""
MISSING = f"""SELECT min(id) AS id, entry_hash FROM ({DOUBLED})
  WHERE entry_hash NOT IN (SELECT entry_hash FROM ({EARLY})) GROUP BY entry_hash"""
ACCESS = f"""SELECT ts, {inputs.HANDLER} AS handler, {inputs.STATUS} AS status, value / 25 AS latency_s,
  {inputs.OUTCOME} AS outcome FROM events"""
# a row of the last file is late if its hour had closed before that file came, two hours late being in time
CLOSED = f"""placed AS (
  SELECT *, last_file AND hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_id % {inputs.LATE_EACH} <> 0) - INTERVAL 2 HOUR AS late,
    hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS closed
  FROM (SELECT date_trunc('hour', ts) AS hour, event_id % {inputs.LATE_EACH} = 0 AS last_file, {inputs.HANDLER} AS handler, {inputs.STATUS} AS status FROM events))"""
REPLIES = f"""SELECT conv_id, turn, {inputs.REPLY_MODEL} AS model, {inputs.REPLY_TEXT} AS text,
  {inputs.RETRY_TEXT} AS retry_text FROM conversations WHERE role = 'assistant'"""


def entities(relation: str, id_col: str, text: str) -> str:
    found = [
        f"SELECT {id_col}, '{kind}' AS entity_type, instr({text}, '{word}') - 1 AS s, "
        f"instr({text}, '{word}') - 1 + {len(word)} AS e FROM {relation} WHERE instr({text}, '{word}') > 0"
        for word, kind in inputs.ENTITY_WORDS
    ]
    found.append(f"SELECT {id_col}, 'URL' AS entity_type, 0 AS s, length({text}) + 5 AS e FROM {relation}")
    return " UNION ALL ".join(found)


def entity_category(column: str = "entity_type") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENTITY_TYPES.items())
    return f"CASE {column} {cases} ELSE '{ENTITY_DEFAULT}' END"


def span_redaction(relation: str, id_col: str, text: str) -> str:
    """``spanned``: texts rebuilt from the pieces between disjoint spans."""
    tokens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPAN_TOKENS.items())
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES))
    return f"""found AS ({entities(relation, id_col, text)}),
spans AS (SELECT f.*, d.{text} AS body, {entity_category()} AS category,
  lag(e, 1, 0) OVER (PARTITION BY f.{id_col} ORDER BY s) AS before
  FROM found f JOIN {relation} d ON f.{id_col} = d.{id_col} WHERE e > s AND e <= length(d.{text})),
pieces AS (SELECT {id_col}, count(*) AS span_count, max(e) AS last_end,
  string_agg(substr(body, before + 1, s - before) || CASE category {tokens} END, '' ORDER BY s) AS head,
  list(DISTINCT category) AS found_categories FROM spans GROUP BY {id_col}),
spanned AS (SELECT d.*, coalesce(p.span_count, 0) AS span_count,
  coalesce(head, '') || substr(d.{text}, coalesce(last_end, 0) + 1) AS span_text,
  coalesce(list_sort(list_transform(found_categories, lambda c: CASE c {order} END)), []) AS span_ordinals
  FROM {relation} d LEFT JOIN pieces p ON d.{id_col} = p.{id_col})"""


# the stretches of the documents, and whether there is a span on them
MARKS = f"""places AS (
  SELECT doc_id, text, length(text) AS size, unnest(range(CAST((length(text) - 1) // {inputs.MARK_STRIDE} + 1 AS BIGINT))) AS k
  FROM documents WHERE text <> ''),
stretches AS (
  SELECT *, substr(text, k * {inputs.MARK_STRIDE} + 1, {inputs.MARK_STRIDE}) AS seg,
    [{", ".join(f"'{k}'" for k in inputs.MARK_KINDS)}][(k + doc_id) % {len(inputs.MARK_KINDS)} + 1] AS entity_type,
    k % 3 = 0 AND (k + 1) * {inputs.MARK_STRIDE} + {inputs.MARK_SIZE} <= size AS reaching,
    (k % 3 = 0 AND k * {inputs.MARK_STRIDE} + {inputs.MARK_ALONE} <= size)
      OR (k % 3 = 1 AND k * {inputs.MARK_STRIDE} + {inputs.MARK_SIZE} <= size) AS marked
  FROM places)"""


def overlapping_spans() -> str:
    """Documents put together from stretches and tokens; a token that a span reaches into loses as many characters."""
    tokens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPAN_TOKENS.items())
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES))
    return f"""WITH {MARKS},
named AS (SELECT *, CASE WHEN marked THEN {entity_category()} END AS category FROM stretches),
pieces AS (
  SELECT *, CASE WHEN NOT marked THEN seg
    WHEN reaching THEN CASE category {tokens} END
    WHEN k % 3 = 0 THEN CASE category {tokens} END || substr(seg, {inputs.MARK_ALONE} + 1)
    ELSE substr(CASE category {tokens} END, {inputs.MARK_REACH} + 1) || substr(seg, {inputs.MARK_SIZE} + 1) END AS piece
  FROM named),
built AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY k) AS span_text, count(category) AS span_count,
    list_sort(list(DISTINCT CASE category {order} END) FILTER (category IS NOT NULL)) AS ordinals,
    count(*) FILTER (reaching) AS overlap_count
  FROM pieces GROUP BY doc_id)
SELECT d.doc_id, coalesce(span_text, d.text) AS span_text, coalesce(span_count, 0) AS span_count,
  {ordinals_as_text("coalesce(ordinals, [])")} AS span_categories, coalesce(overlap_count, 0) AS overlap_count
FROM documents d LEFT JOIN built USING (doc_id)"""


def ordinals_as_text(ordinals: str) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
    return f"array_to_string(list_transform({ordinals}, lambda i: {names}[i + 1]), ',')"


# --- gate -------------------------------------------------------------------


def skill_reason() -> str:
    names = ", ".join(f"'{s}'" for s in policy.ALLOWED_SKILLS)
    return f"CASE WHEN skill NOT IN ({names}) THEN '{policy.SKILL_REASON}' END"


def block_reason(text: str) -> str:
    found = " OR ".join(finds(text, p) for p in (policy.BLOCK_SSN, policy.BLOCK_EMAIL, policy.BLOCK_PHONE))
    return f"CASE WHEN {found} THEN '{policy.PATTERN_REASON}' END"


SIZE_ERROR = (
    f"CASE WHEN strlen(prompt) > {policy.PROMPT_BYTES} THEN '{policy.PROMPT_TOO_LONG}' "
    f"WHEN strlen(skill) > {policy.SKILL_BYTES} THEN '{policy.SKILL_TOO_LONG}' END"
)


def mentions(text: str, phrases: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({text}), {lit(p)})" for p in phrases) + ", false)"


def error_text(kind: str, status: str, body: str) -> str:
    return (
        f"CASE {kind} WHEN 'not_configured' THEN '{NOT_CONFIGURED_TEXT}' WHEN 'http' THEN 'http error: ' || coalesce({body}, '') "
        f"WHEN 'api' THEN concat('api error (', coalesce(CAST({status} AS VARCHAR), 'unknown'), '): ', coalesce({body}, '')) WHEN 'empty' THEN '{EMPTY_REPLY_TEXT}' END"
    )


def gated(fallback: bool = False) -> str:
    """``rated`` with decision, outcome and model of every request."""
    source = f"""SELECT *, CASE WHEN size_error IS NOT NULL THEN 'rejected' WHEN policy_reason IS NOT NULL THEN 'blocked'
      ELSE 'allowed' END AS decision,
      CASE WHEN size_error IS NULL AND policy_reason IS NULL THEN prompt ELSE '' END AS text
    FROM (SELECT *, CASE WHEN size_error IS NULL THEN coalesce({skill_reason()}, {block_reason(spelled('prompt'))})
      END AS policy_reason FROM (SELECT *, {SIZE_ERROR} AS size_error FROM ({REQUESTS})))"""
    stands_in = (
        f"(decision = 'allowed' AND model_error IN ('api', 'http') AND "
        f"{mentions('upstream_body', prompts.FALLBACK_ERRORS)})" if fallback else "false"
    )
    return (
        scrubbed(source) + ",\n" + assessed("done", "t", "scrubbed", "redaction_count = 0") + f""",
failed AS (SELECT * REPLACE (CASE WHEN decision <> 'allowed' OR {stands_in} THEN NULL ELSE model_error END AS model_error,
  CASE WHEN decision <> 'allowed' THEN NULL WHEN model_error IS NULL THEN model
       WHEN {stands_in} THEN '{FALLBACK_MODEL}' END AS model) FROM rated),
decided AS (SELECT *, CASE WHEN decision = 'blocked' THEN 'blocked' WHEN model_error IS NOT NULL THEN 'error'
  WHEN decision = 'allowed' THEN 'ok' END AS outcome FROM failed)"""
    )


def string_list(text: str, separator: str) -> str:
    """A joined text as a JSON array of strings."""
    return (
        f"CASE WHEN {text} = '' THEN '[]' ELSE '[\"' || array_to_string(string_split({text}, '{separator}'), "
        f"'\",\"') || '\"]' END"
    )


METADATA = (
    "CASE WHEN decision <> 'rejected' THEN concat('{\"deid_categories\":', " + string_list("cats", ",")
    + ", ',\"deid_prompt_len\":', strlen(scrubbed), ',\"deid_redaction_count\":', redaction_count, "
    "',\"deid_residual_risk\":\"', residual_risk, '\",\"deid_warnings\":', " + string_list("warnings", "|")
    + ", CASE WHEN model_error IS NOT NULL THEN concat(',\"error\":\"', "
    + error_text("model_error", "upstream_status", "upstream_body")
    + ", '\"') ELSE '' END, ',\"latency_ms\":', round(latency_ms * 100) / 100, "
    "CASE WHEN policy_reason IS NOT NULL THEN concat(',\"policy_reason\":\"', policy_reason, '\"') "
    "WHEN model_error IS NOT NULL THEN ',\"model\":null' ELSE concat(',\"model\":\"', model, '\"') END, "
    "',\"prompt_len\":', strlen(prompt), '}') END"
)
# policy_reason sorts before prompt_len, model before both: the order above holds.

# --- prompts ----------------------------------------------------------------


def trimmed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{SPACES}]+', ''), '[{SPACES}]+$', '')"


def prompt_parts() -> str:
    separator, prefix = lit(prompts.QUESTION_SEPARATOR), lit(prompts.CONTEXT_PREFIX)
    line = f"regexp_replace(l, {pattern(prompts.HEADER)}, '{prompts.HEADER_REPLACEMENT}')"
    line = trimmed(f"regexp_replace({line}, {lit(prompts.TOKEN)}, '', 'g')")
    line = trimmed(f"trim({line}, '|')")
    soft = "task"
    for find, put in prompts.SOFTENED:
        soft = f"replace({soft}, {lit(find)}, {lit(put)})"
    return scrubbed(f"SELECT request_id, prompt, skill FROM ({REQUESTS})", "prompt") + f""",
cut AS (SELECT *, instr(scrubbed, {separator}) AS cut_at FROM done),
halves AS (SELECT *, CASE WHEN cut_at > 0 THEN substr(scrubbed, 1, cut_at - 1) ELSE scrubbed END AS head,
  CASE WHEN cut_at > 0 THEN substr(scrubbed, cut_at + {len(prompts.QUESTION_SEPARATOR)}) END AS tail FROM cut),
parts AS (SELECT request_id, skill,
  {trimmed(f"CASE WHEN cut_at > 0 AND starts_with(head, {prefix}) THEN substr(head, {len(prompts.CONTEXT_PREFIX) + 1}) ELSE head END")} AS context,
  CASE WHEN cut_at > 0 THEN {trimmed('tail')} ELSE {lit(prompts.DEFAULT_TASK)} END AS task FROM halves),
cleaned AS (SELECT *, array_to_string(list_filter(list_transform(string_split(context, chr(10)), lambda l: {line}),
  lambda l: l <> ''), chr(10)) AS stripped, {soft} AS softened FROM parts)"""


def filled(template: str, **values: str) -> str:
    text = lit(template)
    for name, column in values.items():
        text = f"replace({text}, '{{{name}}}', {column})"
    return text


# --- the queries ------------------------------------------------------------


def _flat_scrub(source: str, *keys: str, text: str = "text", rules=RULES) -> str:
    return (
        f"WITH {scrubbed(source, text, rules)} SELECT {', '.join(keys)}, scrubbed, redaction_count, cats AS categories FROM done"
    )


def _hits(source: str, key: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS category, CAST({count_column(c)} AS BIGINT) AS n FROM marked WHERE {count_column(c)} > 0"
        for c in CATEGORIES
    )
    return f"WITH {scrubbed(source)}, marked AS MATERIALIZED (SELECT * FROM done), hits AS ({rows})"


def _report(source: str, *keys: str) -> str:
    by = ", ".join(keys)
    shares = ", ".join(f"count(*) FILTER (WHERE {count_column(c)} > 0) AS with_{c}" for c in CATEGORIES)
    return f"""WITH {scrubbed(source)} SELECT {by}, count(*) AS documents,
      count(*) FILTER (WHERE redaction_count > 0) AS documents_hit,
      CAST(sum(redaction_count) AS BIGINT) AS redactions, round(avg(redaction_count), 6) AS avg_redactions,
      {shares} FROM done GROUP BY {by}"""


def _risk(source: str, key: str, select: str = "warnings, residual_risk") -> str:
    return (
        f"WITH {scrubbed(source)},\n{assessed('done', 't', 'scrubbed', 'redaction_count = 0')}\n"
        f"SELECT {key}, {select} FROM rated"
    )


def _raw_risk(select: str) -> str:
    return (
        f"WITH src AS (SELECT *, {spelled('text')} AS t FROM ({NOTES})),\n"
        f"{assessed('src', 't', 'text', 'true')}\nSELECT note_id, {select} FROM rated"
    )


def _rates(source: str, ts: str, keys: str, seconds: int, starts: str) -> str:
    return f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, {keys}, count(*) AS events,
      round(count(*)::DOUBLE / {seconds}, 9) AS per_second
      FROM (SELECT *, {starts} AS w FROM (SELECT * REPLACE ({ts} AS ts) FROM ({source}))) GROUP BY w, {keys}"""


def _histogram() -> str:
    bounds = [(str(b), f"latency_s <= {b}") for b in LATENCY_BOUNDS] + [("+Inf", "true")]
    rows = " UNION ALL ".join(
        f"SELECT outcome, '{le}' AS le, count(*) FILTER (WHERE {test}) AS cumulative, "
        f"round(sum(latency_s), 4) AS latency_sum, count(*) AS latency_count FROM a GROUP BY outcome"
        for le, test in bounds
    )
    return f"WITH a AS ({ACCESS}) {rows}"


def _quantile() -> str:
    bounds = ", ".join(map(str, LATENCY_BOUNDS))
    return f"""WITH a AS ({ACCESS}), b AS (SELECT unnest([{bounds}])::DOUBLE AS le),
      c AS (SELECT outcome, le, count(*) FILTER (WHERE latency_s <= le) AS n, count(*) AS total FROM a, b GROUP BY ALL),
      l AS (SELECT *, lag(n, 1, 0) OVER w AS below, lag(le, 1, 0.0) OVER w AS low FROM c WINDOW w AS (PARTITION BY outcome ORDER BY le)),
      f AS (SELECT outcome, min_by(low + (le - low) * (0.95 * total - below) / (n - below), le) AS q FROM l
            WHERE n >= 0.95 * total AND n > below GROUP BY outcome)
      SELECT a.outcome, count(*) AS latency_count, round(coalesce(any_value(q), {LATENCY_BOUNDS[-1]}), 6) AS bucket_quantile,
        round(quantile_cont(latency_s, 0.95), 6) AS exact_quantile FROM a LEFT JOIN f ON a.outcome = f.outcome GROUP BY a.outcome"""


def _access(tokens: bool) -> str:
    permitted = " OR ".join(f"(endpoint = '{e}' AND role = '{r}')" for e, r, ok in MATRIX if ok)
    wrong_key = "WHEN credential = 'key' THEN 401" if tokens else ""
    return f"""SELECT event_id, endpoint, credential, role, CAST(CASE WHEN credential IN ('none', 'invalid') THEN 401
      WHEN {permitted} THEN 200 {wrong_key} ELSE 403 END AS BIGINT) AS status
      FROM (SELECT event_id, {inputs.ENDPOINT} AS endpoint, {inputs.CREDENTIAL} AS credential, {inputs.EVENT_ROLE} AS role FROM events)"""


def oracle_sql() -> dict[str, str]:
    one_minute = "date_trunc('minute', ts)"
    five_minutes = "time_bucket(INTERVAL 5 MINUTE, ts)"
    requests_rate = _rates(ACCESS, "ts", "handler, status", 60, one_minute).replace(
        "handler, status, count", "handler, CAST(status AS BIGINT) AS status, count"
    )
    audit_ts = "strptime(ts[1:26], '%Y-%m-%dT%H:%M:%S.%f')"
    append_rate = _rates(AUDIT_EVENTS, audit_ts, "action", 300, five_minutes)
    sliding = _rates(
        AUDIT_EVENTS, audit_ts, "action", 300,
        "unnest([date_trunc('minute', ts) - to_minutes(k) for k in range(5)])",
    )
    documents = "SELECT * FROM documents"
    scrub_conversations = _flat_scrub("SELECT conv_id, turn, text FROM conversations", "conv_id", "turn")
    groups = f"list_concat(coalesce({inputs.CLAIM_GROUPS}, []), coalesce({inputs.CLAIM_ROLES}, []))".replace(
        "array(", "list_value("
    )
    holds = lambda names: "list_has_any(all_groups, [" + ", ".join(f"'{n}'" for n in names) + "])"
    refused, retry_refused = mentions("text", prompts.REFUSALS), mentions("retry_text", prompts.REFUSALS)
    medical = mentions("model", prompts.MEDICAL_MODELS)
    dates = "text"
    for name in ("r06", "r07", "r08"):
        dates = replaced(dates, rule(name))
    ages = replaced(replaced("text", rule("r09")), rule("r10"))
    gate = gated()
    return {
        "read_requests": f"SELECT request_id, ts, actor, role, prompt, skill FROM ({REQUESTS})",
        "broken_scenarios": f"""SELECT CASE k % 7 WHEN 3 THEN 'no JSON' ELSE 'no scenarios' END AS reason, count(*) AS documents
            FROM (SELECT DISTINCT note_id // {inputs.SCENARIO_SPAN} AS k FROM ({NOTES})) WHERE k % 7 IN (3, 5) GROUP BY reason""",
        "read_scenarios": f"""SELECT concat('group ', note_id // {inputs.SCENARIO_SPAN}) AS title, concat('s', note_id) AS id, source AS label, 'vault-answer' AS skill,
            concat({lit(prompts.CONTEXT_PREFIX)}, text, {lit(prompts.QUESTION_SEPARATOR)}, 'What next?') AS prompt,
            note_id % 5 = 0 AS expect_blocked FROM ({NOTES}) WHERE note_id // {inputs.SCENARIO_SPAN} % 7 NOT IN (3, 5)""",
        "scan_audit": f"SELECT id, ts, action, canonical AS metadata_json FROM ({TAMPERED}) ORDER BY id",
        "append_audit": f"""SELECT row_number() OVER (ORDER BY ts, entry_hash) AS id, ts, actor, action, outcome, entry_hash
            FROM ({AUDIT})""",
        "merge_audit": f"""WITH m AS ({MISSING}) SELECT id, entry_hash, (SELECT count(*) FROM m) AS inserted, 0::BIGINT AS again
            FROM (SELECT id, entry_hash FROM ({EARLY}) UNION ALL SELECT id, entry_hash FROM m)""",
        "prefiltered_merge": """SELECT count(*) AS target_rows, count(*) FILTER (event_type = 'signup') AS shared, 0::BIGINT AS lost,
            true AS few_others FROM events""",
        "scrub_notes": _flat_scrub(NOTES, "note_id"),
        "scrub_with_own_rules": _flat_scrub(NOTES, "note_id", rules=inputs.WARD_RULES),
        "scrub_documents": _flat_scrub(documents, "doc_id"),
        "scrub_pages": _flat_scrub("SELECT page_id, html FROM pages", "page_id", text="html"),
        "scrub_conversations": scrub_conversations,
        "category_hits": _hits(NOTES, "note_id") + " SELECT * FROM hits",
        "category_totals": _hits(NOTES, "note_id") + f""", dim AS (SELECT unnest(range({len(CATEGORIES)})) AS ordinal,
            unnest([{", ".join(f"'{c}'" for c in CATEGORIES)}]) AS slug)
            SELECT ordinal, slug, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits, count(n) AS notes
            FROM dim LEFT JOIN hits ON slug = category GROUP BY ordinal, slug""",
        "categories_in_order": _hits(f"SELECT o_custkey AS custkey, text FROM ({NOTES})", "custkey") + f"""
            SELECT custkey, {ordinals_as_text("list_sort(list(DISTINCT CASE category "
            + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES)) + " END))")} AS categories
            FROM hits GROUP BY custkey""",
        "generalise_dates": f"SELECT note_id, {dates} AS text FROM ({NOTES})",
        "bucket_ages": f"SELECT note_id, {ages} AS text FROM ({NOTES})",
        "map_entity_types": f"""WITH n AS ({NOTES}), found AS ({entities("n", "note_id", "text")})
            SELECT entity_type, {entity_category()} AS category, count(*) AS n FROM found GROUP BY ALL""",
        "map_all_entity_types": f"""WITH {MARKS} SELECT entity_type, {entity_category()} AS category, count(*) AS n
            FROM stretches WHERE marked GROUP BY ALL""",
        "redact_overlapping_spans": overlapping_spans(),
        "redact_spans": f"""WITH n AS ({NOTES}), {span_redaction("n", "note_id", "text")}
            SELECT note_id, span_text, span_count, {ordinals_as_text("span_ordinals")} AS span_categories,
            0::BIGINT AS overlap_count FROM spanned""",
        "scrub_hybrid": f"""WITH {scrubbed(NOTES)}, n AS MATERIALIZED (SELECT * FROM done),
            {span_redaction("n", "note_id", "scrubbed")},
            total AS (SELECT note_id, span_text, redaction_count + span_count AS redaction_count,
              list_sort(list_distinct(list_concat(span_ordinals,
                [i for i in range({len(CATEGORIES)}) if [{", ".join(count_column(c) for c in CATEGORIES)}][i + 1] > 0]))) AS ordinals
              FROM spanned),
            {assessed("total", "span_text", "span_text", "redaction_count = 0")}
            SELECT note_id, span_text AS scrubbed, redaction_count, {ordinals_as_text("ordinals")} AS categories,
            warnings, residual_risk FROM rated""",
        "deid_report": _report(NOTES, "source"),
        "deid_report_documents": _report(documents, "source", "lang"),
        "residual_risk_raw": _raw_risk("warnings, residual_risk"),
        "residual_risk_scrubbed": _risk(NOTES, "note_id"),
        "residual_risk_documents": _risk(documents, "doc_id"),
        "first_name_pair": f"SELECT doc_id, {name_pair(spelled('text'))} AS pair FROM documents",
        "risk_levels_by_category": f"""WITH {scrubbed(NOTES)}, {assessed("done", "t", "scrubbed", "redaction_count = 0")},
            u AS (SELECT unnest(string_split(cats, ',')) AS category, residual_risk, redaction_count FROM rated WHERE cats <> '')
            SELECT category, residual_risk, count(*) AS notes, CAST(sum(redaction_count) AS BIGINT) AS redactions
            FROM u GROUP BY category, residual_risk""",
        "block_high_risk": _raw_risk("residual_risk = 'high' AS blocked, false AS blocked_by_default"),
        "check_skill": f"SELECT request_id, {skill_reason()} AS reason FROM ({REQUESTS})",
        "hard_block": f"""SELECT request_id, {finds('t', policy.BLOCK_SSN)} AS has_ssn, {finds('t', policy.BLOCK_EMAIL)} AS has_email,
            {finds('t', policy.BLOCK_PHONE)} AS has_phone, {block_reason('t')} AS reason
            FROM (SELECT *, {spelled('prompt')} AS t FROM ({REQUESTS}))""",
        "hard_block_documents": f"""SELECT doc_id, {block_reason('t')} AS reason
            FROM (SELECT *, {spelled('text')} AS t FROM documents)""",
        "policy_reason": f"""SELECT request_id, coalesce({skill_reason()}, {block_reason('t')}) AS reason
            FROM (SELECT *, {spelled('prompt')} AS t FROM ({REQUESTS}))""",
        "size_guard": f"SELECT request_id, {SIZE_ERROR} AS error FROM ({REQUESTS})",
        "size_guard_documents": f"""SELECT doc_id, {SIZE_ERROR} AS error
            FROM (SELECT doc_id, text AS prompt, source AS skill FROM documents)""",
        "gate_requests": f"""WITH {gated(True)} SELECT request_id, decision, size_error, policy_reason, outcome, model, scrubbed,
            redaction_count, cats AS categories, residual_risk FROM decided""",
        "gate_hybrid": f"""WITH {gate}, n AS MATERIALIZED (SELECT request_id, decision, scrubbed, redaction_count,
            {", ".join(count_column(c) for c in CATEGORIES)} FROM decided),
            {span_redaction("n", "request_id", "scrubbed")},
            total AS (SELECT request_id, decision, span_text, redaction_count + span_count AS redaction_count,
              list_sort(list_distinct(list_concat(span_ordinals,
                [i for i in range({len(CATEGORIES)}) if [{", ".join(count_column(c) for c in CATEGORIES)}][i + 1] > 0]))) AS ordinals
              FROM spanned),
            {assessed("total", "span_text", "span_text", "redaction_count = 0").replace("warned", "warned2").replace("rated", "rated2")}
            SELECT request_id, decision, span_text AS scrubbed, redaction_count, {ordinals_as_text("ordinals")} AS categories,
            residual_risk FROM rated2""",
        "status_and_detail": f"""WITH {gate} SELECT request_id, CAST(CASE WHEN decision = 'rejected' THEN 400
            WHEN audit_error IS NOT NULL THEN 500 WHEN decision = 'blocked' THEN 403
            WHEN model_error = 'not_configured' THEN 503 WHEN model_error = 'api' AND upstream_status IN (400, 402) THEN 400
            WHEN model_error IS NOT NULL THEN 502 ELSE 200 END AS BIGINT) AS status,
            CASE WHEN decision = 'rejected' THEN 'api error (400): ' || size_error
            WHEN audit_error IS NOT NULL THEN audit_error
            WHEN policy_reason IS NOT NULL THEN 'request blocked by policy: ' || policy_reason
            ELSE {error_text("model_error", "upstream_status", "upstream_body")} END AS detail FROM decided""",
        "audit_metadata": f"WITH {gate} SELECT request_id, {METADATA} AS metadata_json FROM decided",
        "audit_metadata_without_matches": f"""WITH {gate} SELECT request_id, CASE WHEN decision <> 'rejected' THEN
            {string_list(r"regexp_replace(warnings, ':[^|]*', '', 'g')", "|")} END AS warnings FROM decided""",
        "audit_from_gate": f"""WITH {gate}, rows AS (SELECT *, 'inference' AS action, skill AS resource, {METADATA} AS canonical
            FROM decided WHERE decision <> 'rejected') SELECT actor, outcome, {entry_hash()} AS entry_hash FROM rows""",
        "canonical_metadata": f"SELECT event_id, canonical FROM ({AUDIT_EVENTS})",
        "entry_hash": f"SELECT id, entry_hash FROM ({AUDIT})",
        "entry_hash_in_field_order": f"""SELECT event_id, sha256(concat('{{"ts":"', ts, '","actor":"', actor, '","role":"', role,
            '","action":"', action, '","resource":"', resource, '","outcome":"', outcome, '","metadata":', canonical, '}}'))
            AS entry_hash FROM ({AUDIT_EVENTS})""",
        "assign_ids": "SELECT 500 + row_number() OVER (ORDER BY ts, event_id) AS id, event_id FROM events",
        "verify_audit": f"SELECT id, hash_valid FROM ({TAMPERED})",
        "verify_ids": f"""SELECT a.id, coalesce(hash_valid, false) AS hash_valid
            FROM (SELECT event_id * 2 AS id FROM events) a LEFT JOIN ({TAMPERED}) t ON a.id = t.id""",
        "list_latest": f"""SELECT id, actor, outcome, canonical AS metadata_json, entry_hash, hash_valid
            FROM ({TAMPERED}) ORDER BY id DESC LIMIT 200""",
        "list_latest_stored": f"""SELECT id, actor, outcome, canonical AS metadata_json, entry_hash, hash_valid
            FROM ({TAMPERED}) ORDER BY id DESC LIMIT 200""",
        "audit_panel_stored": f"""SELECT id, ts, actor, role, action, resource, outcome, hash_valid FROM ({TAMPERED})
            ORDER BY id DESC LIMIT 50""",
        "high_water_marks": f"""SELECT ts[1:10] AS day, count(*) AS rows, min(id) AS first_id, max(id) AS last_id
            FROM (SELECT ts, row_number() OVER (ORDER BY ts, entry_hash) AS id FROM ({AUDIT})) GROUP BY day""",
        "export_audit": f"""SELECT id, ts, action, resource, outcome, entry_hash, 'auditor' AS exported_by
            FROM ({AUDIT}) ORDER BY id DESC LIMIT 500""",
        "export_audit_summary": "SELECT least(count(*), 500) AS count, 'auditor' AS exported_by FROM events",
        "export_audit_whole": f"""SELECT id, ts, action, resource, outcome, entry_hash, 'auditor' AS exported_by FROM ({AUDIT})""",
        "audit_metrics": f"""WITH g AS (SELECT action, count(*) AS n, count(*) FILTER (WHERE outcome <> 'ok') AS f
            FROM ({AUDIT_EVENTS}) GROUP BY action) SELECT CAST(sum(n) AS BIGINT) AS total_entries,
            CAST(sum(f) AS BIGINT) AS failure_count, string_agg(action || '=' || n, ',' ORDER BY action) AS by_action FROM g""",
        "missing_entries": MISSING,
        "id_conflicts": f"""SELECT id, entry_hash AS source_hash, {entry_hash(outcome="'ok-edited'")} AS target_hash
            FROM ({AUDIT}) WHERE value < 20""",
        "next_id": "SELECT max(event_id) + 1 AS max_id, max(event_id) + 2 AS next_id FROM events",
        "leaky_metadata": """SELECT event_id + 1 AS id, 'possible_name_remainder:Nora Quill' AS leaks FROM events
            WHERE event_type = 'view'""",
        "audit_between": f"""SELECT event_id, ts, action FROM ({AUDIT_EVENTS})
            WHERE ts >= '2024-01-10T06:00:00' AND ts < '2024-01-12T18:30:00'""",
        "audit_totals": f"""SELECT count(*) AS audit_entries, count(*) FILTER (WHERE outcome <> 'ok') AS audit_failures
            FROM ({AUDIT_EVENTS})""",
        "appends_by_action_outcome": f"SELECT action, outcome, count(*) AS appends FROM ({AUDIT_EVENTS}) GROUP BY ALL",
        "latency_histogram": _histogram(),
        "latency_p95": _quantile(),
        "latency_sketches": f"""SELECT outcome, count(*) AS latency_count, count(DISTINCT CAST(ts AS DATE)) AS windows,
            true AS merged_holds, true AS whole_holds FROM ({ACCESS}) WHERE latency_s IS NOT NULL GROUP BY outcome""",
        "stream_closed_windows": f"""WITH {CLOSED} SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS window_start, handler,
            CAST(status AS BIGINT) AS status, count(*) AS events FROM placed WHERE NOT late AND closed GROUP BY ALL""",
        "stream_late_rows": f"WITH {CLOSED} SELECT handler, count(*) AS rows FROM placed WHERE late GROUP BY ALL",
        "auth_failures": f"""SELECT CAST(status AS BIGINT) AS status, count(*) AS failures FROM ({ACCESS})
            WHERE status IN (401, 403) GROUP BY status""",
        "request_rate": requests_rate,
        "append_rate": append_rate,
        "append_rate_sliding": sliding,
        "appends_by_action": "SELECT event_type AS action, count(*) AS appends FROM events GROUP BY event_type",
        "audit_panel": f"""SELECT id, ts, actor, role, action, resource, outcome, hash_valid FROM ({TAMPERED})
            ORDER BY id DESC LIMIT 50""",
        "review_claims": f"""SELECT sub, array_to_string(all_groups, ',') AS all_groups,
            CASE WHEN {holds(inputs.OPERATOR_GROUPS)} THEN 'operator' WHEN {holds(inputs.AUDITOR_GROUPS)} THEN 'auditor' END AS role,
            coalesce(email, preferred_username, sub) AS actor
            FROM (SELECT concat('sub-', c_custkey) AS sub,
              CASE WHEN c_custkey % 3 <> 0 THEN concat('c', c_custkey, '@ward.test') END AS email,
              CASE WHEN c_custkey % 2 = 0 THEN c_name END AS preferred_username, {groups} AS all_groups FROM customer)""",
        "access_decision": _access(False),
        "access_decision_with_tokens": _access(True),
        "split_prompt": f"WITH {prompt_parts()} SELECT request_id, context, task FROM cleaned",
        "strip_tokens": f"WITH {prompt_parts()} SELECT request_id, stripped FROM cleaned",
        "soften_task": f"WITH {prompt_parts()} SELECT request_id, softened FROM cleaned",
        "facts_prompt": f"""WITH {prompt_parts()} SELECT request_id, {filled(prompts.FACTS_TEMPLATE, task="softened",
            facts="CASE WHEN stripped = '' THEN '' ELSE '- ' || replace(stripped, chr(10), chr(10) || '- ') END")} AS prompt
            FROM cleaned""",
        "clinical_prompt": f"""WITH {prompt_parts()} SELECT request_id,
            {filled(prompts.CLINICAL_TEMPLATE, skill="skill", context="stripped", task="softened")} AS prompt,
            {filled(prompts.CLINICAL_SYSTEM_TEMPLATE, skill="skill")} AS system,
            {filled(prompts.HOSTED_SYSTEM_TEMPLATE, skill="skill")} AS hosted_system FROM cleaned""",
        "minimal_prompt": f"""WITH {prompt_parts()} SELECT request_id,
            {filled(prompts.MINIMAL_TEMPLATE, context="stripped")} AS prompt FROM cleaned""",
        "refusals": f"SELECT conv_id, turn, {refused} AS refused FROM ({REPLIES})",
        "medical_models": f"SELECT model, {medical} AS medical, count(*) AS n FROM ({REQUESTS}) GROUP BY ALL",
        "fallback_errors": f"""SELECT request_id, {mentions("upstream_body", prompts.FALLBACK_ERRORS)} AS eligible
            FROM ({REQUESTS})""",
        "reply_outcome": f"""SELECT *, CASE outcome WHEN 'refused' THEN CAST(422 AS BIGINT) END AS status,
            CASE outcome WHEN 'refused' THEN '{prompts.REFUSAL_BODY}' END AS body, outcome = 'refused' AS eligible
            FROM (SELECT conv_id, turn, CASE WHEN NOT {refused} THEN 'ok' WHEN {medical} OR {retry_refused} THEN 'refused'
            ELSE 'ok_after_retry' END AS outcome FROM ({REPLIES}))""",
        "stream_scrub": f"""WITH {scrubbed("SELECT conv_id, turn, text FROM conversations")},
            {assessed("done", "t", "scrubbed", "redaction_count = 0")}
            SELECT conv_id, turn, residual_risk, scrubbed, redaction_count, cats AS categories FROM rated""",
        "stream_gate": f"WITH {gate} SELECT request_id, decision, policy_reason, scrubbed, residual_risk FROM decided",
        "stream_audit_append": f"""SELECT row_number() OVER (ORDER BY ts, entry_hash) AS id, ts, action, entry_hash
            FROM ({AUDIT})""",
        "stream_request_rate": requests_rate,
        "stream_latency_histogram": f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, outcome,
            {", ".join(f"count(*) FILTER (WHERE latency_s <= {b}) AS le_{i}" for i, b in enumerate(LATENCY_BOUNDS))},
            count(*) AS latency_count, round(sum(latency_s), 4) AS latency_sum FROM ({ACCESS}) GROUP BY ALL""",
    }
