"""The checks of ``checks.queries`` as DuckDB SQL, written independently.

DuckDB's regular expressions have ASCII word boundaries, so the patterns here
are the plain ones; positions come from splitting and unnesting, redaction from
window functions.
"""

from __future__ import annotations

from checks.spikes import CONVERSATIONS, DOCUMENTS, NUMBERS, PAGES

WS = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"

# --- fixed values: ordinal, name, category, severity, message, description, group, pattern
RULES = [
    (0, "email", "pii", "medium", "Email address detected", "Email addresses (RFC 5322)", 0,
     rf"[a-zA-Z0-9.!#$%&''*+/=?^_`{{|}}~-]+@{LABEL}(?:\.{LABEL})*"),
    (1, "phone-number", "pii", "medium", "Phone number detected", "International phone numbers", 0,
     rf"\+[1-9]\d{{0,2}}[{WS}.-]?\(?\d{{1,4}}\)?[{WS}.-]?\d{{1,4}}[{WS}.-]?\d{{2,9}}"),
    (2, "ssn", "pii", "high", "Social Security Number detected", "US Social Security Numbers", 0,
     r"\b\d{3}-\d{2}-\d{4}\b"),
    (3, "credit-card", "pii", "high", "Credit card number detected (Luhn validated)",
     "Credit card numbers (Luhn validated)", 0, r"\b(?:\d[ -]*?){13,19}\b"),
    (4, "aws-access-key", "secret", "critical", "AWS Access Key ID detected", "AWS Access Key IDs",
     0, r"\bAKIA[0-9A-Z]{16}\b"),
    (5, "aws-secret-key", "secret", "critical", "AWS Secret Access Key detected",
     "AWS Secret Access Keys", 1,
     rf"(?:aws_secret_access_key|AWS_SECRET_ACCESS_KEY)[\"'']?[{WS}]*[=:][{WS}]*[\"'']?([A-Za-z0-9/+=]{{40}})"),
    (6, "github-pat", "secret", "critical", "GitHub Personal Access Token detected",
     "GitHub Personal Access Tokens", 0,
     r"\b(?:ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,})\b"),
    (7, "stripe-key", "secret", "critical", "Stripe API key detected", "Stripe API keys", 0,
     r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,}\b"),
    (8, "google-api-key", "secret", "high", "Google API key detected", "Google API keys", 0,
     r"\bAIza[0-9A-Za-z_-]{35}"),
    (9, "google-oauth-secret", "secret", "critical", "Google OAuth client secret detected",
     "Google OAuth client secrets", 1,
     rf"(?:client_secret|GOOGLE_CLIENT_SECRET)[\"'']?[{WS}]*[=:][{WS}]*[\"'']?([A-Za-z0-9_-]{{24,}})"),
    (10, "ssh-private-key", "secret", "critical", "SSH private key detected",
     "SSH private keys (RSA, ED25519)", 0,
     r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    (11, "jwt", "token", "high", "JWT token detected", "JWT tokens", 0,
     r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    (12, "db-connection-string", "credential", "critical", "Database connection string detected",
     "Database connection strings", 0,
     rf"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^{WS}''\"`,}}{{)]+"),
    (13, "high-entropy-string", "secret", "medium", "High-entropy string detected",
     "High-entropy strings (Shannon > 4.5)", 0, r"[A-Za-z0-9+/=_-]{20,200}"),
]
RULE = {rule[1]: rule for rule in RULES}
RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}

CHARS = "string_split(v, '')"
ENTROPY = f"coalesce(round(list_aggregate({CHARS}, 'entropy'), 12), 0)"
REJECTION = rf"""CASE
    WHEN len(list_distinct({CHARS})) < 4 THEN 'few-distinct'
    WHEN regexp_matches(v, '^[A-Za-z0-9+/]*={{2,}}$') THEN 'base64-padding'
    WHEN length(regexp_replace(v, '[^a-z]', '', 'g')) / length(v) > 0.85 THEN 'mostly-lower-case'
    WHEN regexp_matches(v, '^[0-9a-fA-F]+$') AND length(v) <= 64 THEN 'hex-digest' END"""
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"""(length({DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(
    range(1, length({DIGITS}) + 1), lambda p: CASE
        WHEN (length({DIGITS}) - p) % 2 = 0 THEN cast(substr({DIGITS}, p, 1) AS int)
        WHEN cast(substr({DIGITS}, p, 1) AS int) > 4 THEN cast(substr({DIGITS}, p, 1) AS int) * 2 - 9
        ELSE cast(substr({DIGITS}, p, 1) AS int) * 2 END)) % 10 = 0)"""
ISSUER = f"""CASE WHEN NOT length({DIGITS}) BETWEEN 13 AND 19 THEN NULL
    WHEN {DIGITS}[1:1] = '4' THEN 'visa'
    WHEN cast({DIGITS}[1:2] AS int) BETWEEN 51 AND 55 THEN 'mastercard'
    WHEN cast({DIGITS}[1:4] AS int) BETWEEN 2221 AND 2720 THEN 'mastercard'
    WHEN {DIGITS}[1:2] = '34' OR {DIGITS}[1:2] = '37' THEN 'amex'
    WHEN {DIGITS}[1:4] = '6011' OR {DIGITS}[1:2] = '65' THEN 'discover' END"""

DOCS = f"SELECT doc_id, {DOCUMENTS} AS text FROM documents"
PAGE = f"SELECT page_id, {PAGES} AS text FROM pages"
CONV = f"SELECT conv_id, turn, role, {CONVERSATIONS} AS text FROM conversations"
RAW_DOCS = "SELECT doc_id, text FROM documents"


def candidates(keys: str, name: str) -> str:
    """All matches of one pattern in ``src``: n-th match, value and end."""
    *_, group, pattern = RULE[name]
    return f"""SELECT {keys}, text, i, v[i] AS v,
        (list_sum(list_transform(g[1:i], lambda x: length(x)))
         + list_sum(list_transform(m[1:i], lambda x: length(x))))::INT AS e
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT {keys}, text, regexp_extract_all(text, '{pattern}') AS m,
          regexp_extract_all(text, '{pattern}', {group}) AS v,
          regexp_split_to_array(text, '{pattern}') AS g FROM src))"""


def chosen(names=None, min_severity="low"):
    return [
        r[1] for r in RULES
        if (names is None or r[1] in names) and RANK[r[3]] >= RANK[min_severity]
    ]


def ctes(src: str, keys: str, names=None, min_severity: str = "low") -> str:
    """``WITH src, found``: every finding with its span."""
    parts = []
    for name in chosen(names, min_severity):
        ordinal, _, category, severity, message, *_ = RULE[name]
        text, keep = f"'{message}'", "true"
        if name == "credit-card":
            keep = f"({ISSUER}) IS NOT NULL AND {LUHN}"
        if name == "high-entropy-string":
            keep = f"({REJECTION}) IS NULL AND {ENTROPY} > 4.5"
            text = f"'High-entropy string detected (entropy: ' || printf('%.2f', round({ENTROPY}, 2)) || ')'"
        parts.append(
            f"""SELECT {keys}, '{name}' AS type, '{category}' AS category, '{severity}' AS severity,
            e - length(v)::INT AS "start", e AS "end", {text} AS message, v AS value,
            {ordinal}::INT AS ordinal FROM ({candidates(keys, name)}) WHERE {keep}"""
        )
    return f"WITH src AS ({src}), found AS ({' UNION ALL '.join(parts)})"


def flat(src: str, keys: str, names=None, min_severity="low") -> str:
    return f"{ctes(src, keys, names, min_severity)} SELECT * FROM found"


def using(keys: str) -> str:
    return f"USING ({keys})"


REDACT_SAFE = """
  marked AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" DESC, ordinal
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM picked),
  numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" >= before THEN 1 ELSE 0 END)
      OVER (PARTITION BY {keys} ORDER BY "start", "end" DESC, ordinal) AS grp FROM marked),
  spans AS (SELECT {keys}, grp, min("start") AS s, max("end") AS e,
      first(type ORDER BY "start", "end" DESC, ordinal) AS type FROM numbered GROUP BY {keys}, grp),
  gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {keys} ORDER BY s), 0) AS prev FROM spans),
  rebuilt AS (SELECT {keys}, string_agg(substr(text, prev + 1, s - prev) || '[' || upper(type) ||
      '_REDACTED]', '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS redacted
      FROM gaps JOIN src USING ({keys}) GROUP BY {keys}),
  tally AS (SELECT {keys}, count(*)::INT AS n_redacted FROM picked GROUP BY {keys})
"""


def redact_safe(src: str, keys: str, select: str, pick: str = "true", min_severity="low") -> str:
    return f"""{ctes(src, keys, None, min_severity)},
      picked AS (SELECT * FROM found WHERE {pick}), {REDACT_SAFE.format(keys=keys)}
      SELECT {select} FROM src LEFT JOIN rebuilt USING ({keys}) LEFT JOIN tally USING ({keys})"""


def lined(src: str, keys: str) -> str:
    prefix = 'substr(text, 1, "start")'
    return f"""{ctes(src, keys)}, lined AS (SELECT found.*, text,
        (1 + length({prefix}) - length(replace({prefix}, chr(10), '')))::INT AS line,
        length(string_split({prefix}, chr(10))[-1])::INT AS col
      FROM found JOIN src USING ({keys}))"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    spiked_one = {
        "q_ssn": "ssn",
        "q_aws_access_key": "aws-access-key",
        "q_aws_secret_key": "aws-secret-key",
        "q_github_pat": "github-pat",
        "q_stripe_key": "stripe-key",
        "q_google_api_key": "google-api-key",
        "q_google_oauth": "google-oauth-secret",
        "q_ssh_key": "ssh-private-key",
        "q_jwt": "jwt",
        "q_db_url": "db-connection-string",
        "q_entropy": "high-entropy-string",
    }
    for query, name in spiked_one.items():
        sql[query] = flat(DOCS, "doc_id", [name])
    for query, name in {"q_email": "email", "q_phone": "phone-number",
                        "q_credit_card": "credit-card"}.items():
        sql[query] = flat(RAW_DOCS, "doc_id", [name])
        sql[f"{query}_spiked"] = flat(DOCS, "doc_id", [name])

    sql["q_luhn"] = f"""WITH src AS ({DOCS}), c AS ({candidates("doc_id", "credit-card")})
      SELECT doc_id, i::INT AS nth, {DIGITS} AS digits, {LUHN} AS valid FROM c"""
    sql["q_card_prefix"] = f"""WITH src AS ({DOCS}), c AS ({candidates("doc_id", "credit-card")})
      SELECT coalesce({ISSUER}, 'none') AS issuer, {LUHN} AS luhn, count(*) AS n FROM c GROUP BY ALL"""
    sql["q_shannon"] = """SELECT doc_id,
      coalesce(round(list_aggregate(regexp_extract_all(text, '(?s).'), 'entropy'), 9), 0) AS bits
      FROM documents"""
    sql["q_entropy_filters"] = f"""WITH src AS ({DOCS}),
      c AS ({candidates("doc_id", "high-entropy-string")})
      SELECT coalesce({REJECTION}, 'kept') AS reason, count(*) AS n,
        count(*) FILTER (WHERE {ENTROPY} > 4.5) AS n_above FROM c GROUP BY ALL"""
    sql["q_entropy_low_threshold"] = f"""WITH src AS ({DOCS}),
      c AS ({candidates("doc_id", "high-entropy-string")})
      SELECT doc_id, e - length(v)::INT AS "start", e AS "end", {ENTROPY} AS bits FROM c
      WHERE ({REJECTION}) IS NULL AND {ENTROPY} > 3.5"""

    sql["q_scan_documents"] = flat(DOCS, "doc_id")
    sql["q_scan_pages"] = flat(PAGE, "page_id")
    sql["q_scan_conversations"] = flat(CONV, "conv_id, turn")
    sql["q_scan_nested"] = f"""{ctes(DOCS, "doc_id")}, n AS (
        SELECT doc_id, count(*) AS c, string_agg(type || '@' || "start" || '-' || "end", ','
          ORDER BY "start", ordinal) AS spans FROM found GROUP BY doc_id)
      SELECT doc_id, length(text)::INT AS text_length, coalesce(c, 0)::INT AS n_findings,
        coalesce(spans, '') AS spans FROM src LEFT JOIN n USING (doc_id)"""
    sql["q_offsets"] = f"""{ctes(DOCS, "doc_id")}
      SELECT doc_id, type, "start", "end",
        substr(text, "start" + 1, "end" - "start") = value AS holds,
        ("start" + length(regexp_replace(substr(text, 1, "start"), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INT
          AS start_utf16
      FROM found JOIN src USING (doc_id)"""
    sql["q_scan_only_email"] = flat(DOCS, "doc_id", ["email"])
    sql["q_min_severity_high"] = flat(DOCS, "doc_id", None, "high")
    sql["q_min_severity_critical"] = flat(DOCS, "doc_id", None, "critical")
    sql["q_ordered_findings"] = f"""{ctes(DOCS, "doc_id")}
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY "start", ordinal))::INT AS nth,
        type, "start" FROM found ORDER BY doc_id, "start", ordinal"""
    sql["q_overlaps"] = f"""{ctes(DOCS, "doc_id")},
      marked AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, ordinal
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
      numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" >= before THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, ordinal) AS grp FROM marked),
      opened AS (SELECT *, first_value(type) OVER w AS opened_by, first_value("start") OVER w AS opened_at
        FROM numbered WINDOW w AS (PARTITION BY doc_id, grp ORDER BY "start", "end" DESC, ordinal))
      SELECT doc_id, type, "start", "end", opened_by, opened_at FROM opened WHERE "start" < before"""
    rules = ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', '{r[5]}')" for r in RULES)
    sql["q_detector_catalog"] = f"""{ctes(DOCS, "doc_id")},
      catalog(ordinal, name, category, severity, description) AS (VALUES {rules})
      SELECT c.ordinal::INT AS ordinal, name, c.category, c.severity, description,
        count(found.type) AS n_findings
      FROM catalog c LEFT JOIN found ON found.type = c.name GROUP BY ALL"""
    sql["q_scheme_filter"] = f"""{ctes(
        f"SELECT page_id, {PAGES} AS text FROM pages WHERE url LIKE 'https:%'", "page_id")}
      SELECT * FROM found"""
    sql["q_custom_detector"] = r"""WITH src AS (SELECT doc_id, text FROM documents),
      c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+tion\b')) AS value FROM src)
      SELECT doc_id, 'capital-tion' AS type, 'low' AS severity, value FROM c WHERE length(value) % 2 = 0"""

    redaction = "doc_id, coalesce(redacted, text) AS redacted, coalesce(n_redacted, 0)::INT AS n_redacted"
    sql["q_redact_documents"] = redact_safe(DOCS, "doc_id", redaction)
    sql["q_redact_only_pii"] = redact_safe(DOCS, "doc_id", redaction, "category = 'pii'")
    sql["q_redacted_corpus"] = redact_safe(
        PAGE, "page_id",
        "page_id, coalesce(redacted, text) AS html, coalesce(n_redacted, 0) > 0 AS changed",
    )
    sql["q_redact_exact"] = f"""{ctes(DOCS, "doc_id")},
      lists AS (SELECT doc_id, list({{'s': "start", 'e': "end", 'p': '[' || upper(type) || '_REDACTED]'}}
        ORDER BY "start" DESC, ordinal) AS ds FROM found GROUP BY doc_id)
      SELECT doc_id, CASE WHEN ds IS NULL THEN text ELSE list_reduce(
          list_transform(ds, lambda d: {{'s': d.s, 'e': d.e, 'p': d.p}}),
          lambda acc, d: {{'s': 0, 'e': 0, 'p': substr(acc.p, 1, d.s) || d.p || substr(acc.p, d.e + 1)}},
          {{'s': 0, 'e': 0, 'p': text}}).p END AS redacted,
        coalesce(len(ds), 0)::INT AS n_redacted
      FROM src LEFT JOIN lists USING (doc_id)"""

    sql["q_finding_lines"] = f"""{lined(DOCS, "doc_id")}
      SELECT doc_id, type, "start", line, col FROM lined"""
    line_text = "string_split(text, chr(10))[line]"
    marks = f"""repeat(' ', col) || repeat('^', greatest(1,
        least("end" - ("start" - col), length({line_text})) - col))"""
    sql["q_caret_report"] = f"""{lined(DOCS, "doc_id")}
      SELECT doc_id, type, "start", line, col, {marks} AS marks,
        '  ' || rpad('[' || upper(severity) || ']', 10, ' ') || ' ' || message || chr(10) ||
        '    ' || doc_id || ':' || line || '  ' || type || chr(10) ||
        '    ' || {line_text} || chr(10) || '    ' || {marks} || chr(10) AS entry
      FROM lined"""
    sql["q_headlines"] = f"""{ctes(DOCS, "doc_id")}
      SELECT doc_id, CASE WHEN count(type) = 0 THEN doc_id || ': clean'
        ELSE doc_id || ': ' || count(type) || ' finding(s)' END AS headline
      FROM src LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
    sql["q_json_report"] = f"""{lined(DOCS, "doc_id")},
      lists AS (SELECT doc_id, list({{'type': type, 'category': category, 'severity': severity,
        'start': "start", 'end': "end", 'message': message, 'line': line}} ORDER BY "start", ordinal) AS ds
        FROM lined GROUP BY doc_id)
      SELECT doc_id, CASE WHEN ds IS NULL
          THEN '{{"source":"' || doc_id || '","detections":[],"clean":true}}'
          ELSE '{{"source":"' || doc_id || '","clean":false,"detections":' || to_json(ds)::VARCHAR || '}}'
        END AS report
      FROM src LEFT JOIN lists USING (doc_id)"""
    emoji = f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '\U0001f600\U0001f680 ' ELSE '' END || text
      AS text FROM ({DOCS})"""
    units = lambda at: f"{at} + len(regexp_extract_all(substr(text, 1, {at}), '[\\x{{10000}}-\\x{{10FFFF}}]'))"  # noqa: E731, E501
    end = '"end"'
    start = '"start"'
    sql["q_json_report_utf16"] = f"""{lined(emoji, "doc_id")},
      lists AS (SELECT doc_id, list({{'type': type, 'category': category, 'severity': severity,
        'start': {units(start)}, 'end': {units(end)}, 'message': message, 'line': line}}
        ORDER BY "start", ordinal) AS ds FROM lined GROUP BY doc_id)
      SELECT doc_id, CASE WHEN ds IS NULL
          THEN '{{"source":"' || doc_id || '","detections":[],"clean":true}}'
          ELSE '{{"source":"' || doc_id || '","clean":false,"detections":' || to_json(ds)::VARCHAR || '}}'
        END AS report
      FROM src LEFT JOIN lists USING (doc_id)"""
    sql["q_token_estimate_utf16"] = """SELECT conv_id, count(*) AS n_messages,
        sum(ceil((length(text) + CASE WHEN conv_id % 3 = 0 THEN 5 ELSE 0 END) / 4))::BIGINT AS n_tokens
      FROM conversations GROUP BY conv_id"""
    for name, severity, hit in (
        ("q_verdicts", "low", 1), ("q_verdicts_hook", "low", 2), ("q_gate_critical", "critical", 2)
    ):
        sql[name] = f"""{ctes(DOCS, "doc_id", None, severity)}
          SELECT doc_id, (CASE WHEN doc_id IN (SELECT doc_id FROM found) THEN {hit} ELSE 0 END)::INT
            AS verdict FROM src"""
    sql["q_corpus_gate"] = f"""{ctes(DOCS, "doc_id")}, v AS (
        SELECT CASE WHEN doc_id IN (SELECT doc_id FROM found) THEN 1 ELSE 0 END AS verdict FROM src)
      SELECT max(verdict)::INT AS verdict, count(*) AS n_sources,
        count(*) FILTER (WHERE verdict > 0) AS n_not_clean FROM v"""
    sql["q_unreadable_sources"] = f"""{ctes(DOCS, "doc_id")}, v AS (
        SELECT CASE WHEN o_orderkey NOT IN (SELECT doc_id FROM src) THEN 3
          WHEN o_orderkey IN (SELECT doc_id FROM found) THEN 1 ELSE 0 END AS verdict
        FROM (SELECT DISTINCT o_orderkey FROM orders))
      SELECT verdict::INT AS verdict, count(*) AS n FROM v GROUP BY ALL"""

    per_conv = ctes(CONV, "conv_id, turn")
    sql["q_intercept_warn"] = f"""{per_conv},
      totals AS (SELECT conv_id, count(*) AS n_total FROM found GROUP BY conv_id)
      SELECT conv_id, turn, role, text, coalesce(n_total, 0) AS n_total,
        CASE WHEN n_total > 0 THEN n_total || ' sensitive value(s) detected.' END AS notice
      FROM src LEFT JOIN totals USING (conv_id)"""
    sql["q_intercept_redact"] = redact_safe(
        CONV, "conv_id, turn",
        "conv_id, turn, role, coalesce(redacted, text) AS text, coalesce(n_redacted, 0)::INT AS n_findings",
    )
    sql["q_intercept_block"] = f"""{per_conv},
      first_turn AS (SELECT conv_id, min(turn) AS turn FROM found GROUP BY conv_id),
      hits AS (SELECT found.* FROM found JOIN first_turn USING (conv_id, turn)),
      types AS (SELECT conv_id, turn, type, count(*) AS n, min("start") AS s, arg_min(ordinal, "start") AS o
        FROM hits GROUP BY conv_id, turn, type)
      SELECT conv_id, turn AS blocked_turn, sum(n)::INT AS n_findings,
        string_agg('- **' || type || '**: ' || n, chr(10) ORDER BY s, o) AS summary
      FROM types GROUP BY conv_id, turn"""
    sql["q_forwarded_conversations"] = f"""{per_conv}
      SELECT * FROM src WHERE conv_id NOT IN (SELECT conv_id FROM found)"""
    sql["q_forward_roles"] = """SELECT conv_id, turn,
        CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role,
        text || chr(10) || role AS text FROM conversations"""
    users = f"SELECT * FROM ({CONV}) WHERE role = 'user'"
    sql["q_prompt_check"] = f"""{ctes(users, "conv_id, turn", None, "medium")},
      picked AS (SELECT * FROM found), {REDACT_SAFE.format(keys="conv_id, turn")},
      types AS (SELECT conv_id, turn, type, severity, count(*) AS n, min("start") AS s,
        arg_min(ordinal, "start") AS o FROM found GROUP BY ALL),
      lines AS (SELECT conv_id, turn, string_agg('- $(' || CASE WHEN severity = 'critical' THEN 'error'
          ELSE 'warning' END || ') **' || type || ' (' || severity || ')**: ' || n || ' occurrence' ||
          CASE WHEN n > 1 THEN 's' ELSE '' END, chr(10) ORDER BY s, o) AS summary
        FROM types GROUP BY conv_id, turn)
      SELECT conv_id, turn, CASE WHEN n_redacted > 0 THEN 'ask' ELSE 'forward' END AS action,
        coalesce(n_redacted, 0)::INT AS n_findings, summary, text AS original,
        coalesce(redacted, text) AS redacted
      FROM src LEFT JOIN rebuilt USING (conv_id, turn) LEFT JOIN tally USING (conv_id, turn)
        LEFT JOIN lines USING (conv_id, turn)"""
    sql["q_token_estimate"] = """SELECT conv_id, sum(ceil(length(text) / 4))::BIGINT AS n_tokens,
        count(*) AS n_messages FROM conversations GROUP BY conv_id"""

    sql["q_count_by_type"] = f"""{ctes(DOCS, "doc_id")}
      SELECT type, count(*) AS n_findings FROM found GROUP BY type"""
    sql["q_first_seen_types"] = f"""{ctes(DOCS, "doc_id")},
      types AS (SELECT doc_id, type, count(*) AS n, min("start") AS s, arg_min(ordinal, "start") AS o
        FROM found GROUP BY doc_id, type)
      SELECT doc_id, string_agg('- **' || type || '**: ' || n, chr(10) ORDER BY s, o) AS summary
      FROM types GROUP BY doc_id"""
    sql["q_count_by_type_severity"] = f"""{ctes(DOCS, "doc_id")},
      g AS (SELECT type, severity, count(*) AS n FROM found GROUP BY ALL)
      SELECT type, severity, n AS n_findings,
        '- $(' || CASE WHEN severity = 'critical' THEN 'error' ELSE 'warning' END || ') **' || type ||
        ' (' || severity || ')**: ' || n || ' occurrence' || CASE WHEN n > 1 THEN 's' ELSE '' END AS line
      FROM g"""
    sql["q_count_per_doc"] = f"""{ctes(DOCS, "doc_id")}
      SELECT doc_id, count(type)::INT AS n_findings FROM src LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
    sql["q_display_levels"] = f"""{ctes(DOCS, "doc_id")}
      SELECT CASE WHEN category = 'pii' THEN 'warning' ELSE 'error' END AS level, count(*) AS n_findings
      FROM found GROUP BY ALL"""

    sql["q_debounce_events"] = """WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id
        ORDER BY ts, event_id) AS following FROM events)
      SELECT event_id, user_id, ts, event_type FROM n
      WHERE following IS NULL OR following > ts + INTERVAL 2 HOURS"""
    sql["q_debounce_sessions"] = sql["q_debounce_events"]
    sql["q_debounce_stream"] = """WITH e AS (SELECT event_id, user_id,
        CASE WHEN event_id % 50 <> 1 THEN ts END AS ts,
        CASE WHEN event_id % 10 = 0 THEN 2 ELSE event_id % 2 END AS part FROM events),
      marks AS (SELECT p.part, (SELECT max(ts) FROM e WHERE e.part < p.part) - INTERVAL 36 HOURS AS mark
        FROM (SELECT DISTINCT part FROM e) p),
      judged AS (SELECT e.*, CASE WHEN ts IS NULL THEN 'no_time'
        WHEN ts <= date_trunc('milliseconds', mark) THEN 'late' ELSE 'on_time' END AS lateness
        FROM e JOIN marks USING (part)),
      n AS (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following
        FROM judged WHERE lateness = 'on_time')
      SELECT event_id, lateness, coalesce(n.event_id IS NOT NULL
        AND (following IS NULL OR following > n.ts + INTERVAL 2 HOURS), false) AS is_last
      FROM judged LEFT JOIN n USING (event_id)"""
    sql["q_latest_state"] = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY ts DESC, event_id DESC) AS rn FROM events)
      SELECT user_id, event_id, ts, event_type, value FROM n WHERE rn = 1 AND event_type <> 'error'"""
    sql["q_rescan_policy"] = f"""{ctes(DOCS, "doc_id", None, "critical")}
      SELECT doc_id, count(type)::INT AS n_findings FROM src LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
    numbered = f"SELECT doc_id, {NUMBERS} AS text FROM documents"
    # --- fixed values: characters of account numbers by country
    lengths = """15 NO, 16 BE, 18 DK FI FO GL NL, 19 MK SI, 20 AT BA EE KZ LT LU XK, 21 CH CR HR LI LV,
        22 BG BH DE GB GE IE ME RS, 23 AE GI IL IQ TL, 24 AD CZ ES MD PK RO SA SE SK TN VG, 25 PT ST, 26 IS TR,
        27 FR GR IT MC MR SM, 28 AL AZ BY CY DO GT HU LB PL SV, 29 BR PS QA UA, 30 JO KW MU, 31 MT SC, 32 LC"""
    by_length = [entry.split() for entry in lengths.split(",")]
    accounts = "|".join(
        rf"(?:{'|'.join(countries)})[0-9]{{2}}(?: ?[A-Z0-9]){{{int(n) - 4}}}" for n, *countries in by_length
    )
    sql["q_iban"] = rf"""WITH c AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:{accounts})\b')) AS value FROM ({numbered})),
      m AS (SELECT *, replace(value, ' ', '') AS v FROM c),
      r AS (SELECT *, list_reduce([0] || list_transform(string_split(substr(v, 5) || v[1:4], ''),
        lambda x: CASE WHEN x <= '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END),
        lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) AS rest FROM m)
      SELECT doc_id, 'iban' AS type, 'high' AS severity, value, count(*) AS n FROM r WHERE rest = 1 GROUP BY ALL"""
    sql["q_ipv6"] = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z_:.]+')) AS token
        FROM ({numbered})),
      c AS (SELECT doc_id, regexp_extract(token, '^([0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,8}}(?:(?:[.][0-9]{{1,3}}){{3}})?)(?:[^0-9A-Za-z_:]|$)', 1)
        AS value FROM t),
      p AS (SELECT *, contains(value, '.') AS dotted, string_split(regexp_extract(value, '[0-9.]+$'), '.') AS octets,
        regexp_replace(value, '[0-9]+([.][0-9]+){{3}}$', '0:0') AS v FROM c WHERE value <> ''),
      h AS (SELECT *, string_split(v, '::') AS halves FROM p),
      g AS (SELECT *, list_concat(CASE WHEN halves[1] = '' THEN [] ELSE string_split(halves[1], ':') END,
        CASE WHEN len(halves) < 2 OR halves[2] = '' THEN [] ELSE string_split(halves[2], ':') END) AS groups FROM h)
      SELECT doc_id, 'ipv6-address' AS type, 'medium' AS severity, value, count(*) AS n FROM g
      WHERE len(halves) <= 2 AND len(list_filter(groups, lambda x: NOT regexp_full_match(x, '[0-9A-Fa-f]{{1,4}}'))) = 0
        AND ((len(halves) = 1 AND len(groups) = 8) OR (len(halves) = 2 AND len(groups) BETWEEN 1 AND 7))
        AND (NOT dotted OR (len(octets) = 4 AND list_max(list_transform(octets, lambda x: cast(x AS int))) <= 255))
      GROUP BY ALL"""
    sql["q_allowed"] = f"""{ctes(DOCS, "doc_id")},
      f AS (SELECT *, 'docs/' || (doc_id % 5) || '/' || doc_id AS path FROM found),
      allow AS (SELECT DISTINCT value, CASE WHEN doc_id % 2 = 0 THEN type END AS type,
        CASE WHEN doc_id % 4 = 0 THEN 'docs/1' END AS path FROM f WHERE doc_id % 3 = 0)
      SELECT doc_id, type, "start", value FROM f
      WHERE NOT (type = 'ssn' AND doc_id % 5 = 2) AND doc_id % 5 <> 3
        AND NOT EXISTS (SELECT 1 FROM allow a WHERE a.value = f.value
          AND (a.type IS NULL OR a.type = f.type) AND (a.path IS NULL OR f.path LIKE a.path || '/%'))"""
    sql["q_weekly_rollup"] = f"""{ctes(DOCS, "doc_id")},
      d AS (SELECT src.doc_id, user_id % 7 AS team, user_id AS member, date_trunc('week', ts)::DATE AS week
        FROM src LEFT JOIN events ON event_id = src.doc_id),
      n AS (SELECT doc_id, type, count(*) AS n FROM found GROUP BY ALL),
      k AS (SELECT d.*, type, n FROM d JOIN n USING (doc_id) UNION ALL
        SELECT d.*, 'all', coalesce(s, 0) FROM d LEFT JOIN (SELECT doc_id, sum(n) AS s FROM n GROUP BY ALL) USING (doc_id)),
      l AS (SELECT unnest([0, 2, 6, 1, 3, 7]) AS level)
      SELECT CASE WHEN level & 4 = 0 THEN team END AS team, CASE WHEN level & 2 = 0 THEN member END AS member,
        CASE WHEN level & 1 = 0 THEN week END AS week, type, level::INT AS level, sum(n)::BIGINT AS n_findings,
        count(*) AS n_documents, count(*) FILTER (WHERE n > 0) AS n_with_findings
      FROM k, l GROUP BY ALL"""
    sql["q_audit_log"] = f"""{ctes(DOCS, "doc_id")},
      e AS (SELECT DISTINCT doc_id, type, severity, "start", "end", value FROM found),
      b AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS batch, 'scanner' AS actor FROM e
          WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
        UNION ALL SELECT *, 2, 'gate' FROM e WHERE doc_id % 5 = 0)
      SELECT batch::INT AS batch, actor, 'found' AS action, type, severity, count(*) AS n, count(*) AS n_events
      FROM b GROUP BY ALL"""
    sql["q_file_run"] = f"""{ctes(DOCS, "doc_id")}
      SELECT doc_id, doc_id % 97 = 0 OR text = '' AS is_empty, (CASE WHEN doc_id % 97 <> 0
        AND doc_id IN (SELECT doc_id FROM found) THEN 1 ELSE 0 END)::INT AS verdict
      FROM src UNION ALL SELECT -1, NULL, 3"""
    sql["q_feed_scan"] = flat(DOCS, "doc_id")
    sql["q_sinks"] = redact_safe(
        DOCS, "doc_id",
        "doc_id, coalesce(n_redacted, 0)::INT AS n_findings, coalesce(n_redacted, 0) = 0 AS clean, "
        "coalesce(redacted, text) AS redacted",
    )
    sql["q_stream_scan"] = flat(CONV, "conv_id, turn")
    sql["q_block_latch"] = f"""{per_conv},
      first_turn AS (SELECT conv_id, min(turn) AS t FROM found GROUP BY conv_id)
      SELECT conv_id, turn, coalesce(turn >= t, false) AS held FROM src LEFT JOIN first_turn USING (conv_id)"""
    sql["q_latest_findings"] = f"""{ctes(
        f"SELECT * FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM ({CONV})) WHERE rn = 1 AND role <> 'user'",
        "conv_id, turn", None, "medium")}
      SELECT conv_id, turn, count(type)::INT AS n_findings FROM src LEFT JOIN found USING (conv_id, turn)
      GROUP BY conv_id, turn"""
    return sql
