"""DuckDB SQL of the queries that SQL can express, written on its own: nothing
is imported from the code under test, fixed values stand here a second time."""

from __future__ import annotations

# The signs of each language, for RE2.
TS = (
    r"\bimport\s+.*\bfrom\s+['\"]", r"\bexport\s+(default\s+)?(class|function|const|interface|type)\b", r":\s*(string|number|boolean|void)\b",
    r"=>\s*[{(]", r"\binterface\s+\w+", r"\bconst\s+\w+\s*:\s*\w+",
)
PY = (r"(?m)^def\s+\w+\s*\(", r"(?m)^class\s+\w+.*:", r"(?m)^from\s+\w+\s+import\b", r"(?m)^import\s+\w+", r"(?m)^\s+self\.", r"(?m):\s*$\n\s+")
PHP = (r"(?m)^<\?php\b", r"\bnamespace\s+[\w\\]+;", r"\buse\s+[\w\\]+;", r"\bfunction\s+\w+\s*\(", r"\$this->", r"\bpublic\s+(static\s+)?(function|readonly)\b")
GO = (r"(?m)^package\s+\w+", r"(?m)^func\s+(\(\w+\s+\*?\w+\)\s+)?\w+\s*\(", r"\bfmt\.\w+", r"\b:=\s", r"(?m)^import\s+\(", r"\berr\s*!=\s*nil\b")
GENERIC = (r"[{}\[\]();]", r"\b(function|class|return|if|else|for|while)\b", r"(?m)//.+$", r"(?m)^\s{2,}\S")
# Code, name, token multiplier, confidence, patterns of each language.
PROFILES = (
    ("en", "English", 1.0, 1.0, (
        r"[a-zA-Z]{2,}",
        r"\b(the|is|are|was|were|have|has|had|do|does|did|a|an|and|or|but|in|on|at|to|for|of|with|be|this|that|from|as|by|they|we|you|he|she|it|not|can|will|would|could|should|may|might|must|hello|world)\b",
    )),
    ("es", "Spanish", 1.7, 0.9, ("[áéíóúüñ¿¡]", r"\b(el|la|los|las|un|una|de|en|que|y|es|por)\b")),
    ("fr", "French", 1.8, 0.9, ("[àâäéèêëïîôùûüÿç]", r"\b(le|la|les|un|une|de|et|est|à|en|que)\b")),
    ("de", "German", 1.6, 0.9, ("[äöüß]", r"\b(der|die|das|den|dem|des|ein|eine|und|ist|in)\b")),
    ("zh", "Chinese", 2.0, 0.95, ("[\u4e00-\u9fff]", "[\u3400-\u4dbf]")),
    ("ja", "Japanese", 2.5, 0.9, ("[\u3040-\u309f]", "[\u30a0-\u30ff]", "[\u4e00-\u9fff]")),
    ("ko", "Korean", 2.3, 0.9, ("[\uac00-\ud7af]", "[\u1100-\u11ff]")),
    ("ar", "Arabic", 3.0, 0.85, ("[\u0600-\u06ff]", "[\u0750-\u077f]")),
    ("ta", "Tamil", 4.5, 0.8, ("[\u0b80-\u0bff]",)),
    ("hi", "Hindi", 3.5, 0.85, ("[\u0900-\u097f]",)),
    ("ru", "Russian", 1.9, 0.9, ("[\u0400-\u04ff]", r"\b(и|в|не|на|я|что|он|с|как|а)\b")),
    ("pt", "Portuguese", 1.7, 0.9, ("[àáâãäèéêëìíîïòóôõöùúûü]", r"\b(o|a|os|as|de|em|que|e|é|do|da)\b")),
    ("th", "Thai", 4.0, 0.8, ("[\u0e00-\u0e7f]",)),
    ("vi", "Vietnamese", 1.5, 0.9, (
        "[àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ]",
        r"\b(và|của|có|là|này|được|trong|cho|người|từ|để|với|một|những|các|không|khi|trên)\b",
    )),
    ("id", "Indonesian", 1.4, 0.85, (r"\b(yang|dan|di|ke|dari|ini|itu|untuk|dengan|pada|adalah|tidak|ada|atau|akan|juga|oleh|dalam)\b",)),
)
#: Characters of the cached prefix without the tool's name and the format.
PREFIX_CHARS = 689


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FULL = "list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '\\S'))"
COMMAS = "(length({x}) - length(replace({x}, ',', '')))"


def _score(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(s, {_q(p)}) AS INTEGER)" for p in patterns)


def units(x: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


LOGS = """
e AS (SELECT event_id AS k, event_type AS et, event_id // 200 AS payload_id FROM events),
logs AS (
  SELECT payload_id, k * 16 + c AS pos,
    CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'src/' || et || '.ts:' || (k % 90 + 1) || ':5 - error TS2322: bad ' || CASE k % 2 WHEN 0 THEN ' ' ELSE '' END || et
      WHEN 2 THEN (k % 40) || ' | value' WHEN 3 THEN '    at handler (/app/' || et || '.js:10:3)' WHEN 4 THEN '      ^^^^'
      ELSE 'warn: ' || et END AS line
  FROM e, LATERAL (SELECT unnest(range(1, k % 9 + 2)) AS c) r
)
"""
CODE_LINES = """
code AS (
  SELECT p_partkey // 200 AS payload_id, p_partkey % 200 AS pos,
    CASE WHEN p_partkey % 11 < 8 THEN 'import p' || p_partkey WHEN p_partkey % 97 = 9 THEN 'return'
      ELSE 'const part' || p_partkey || ' = ''' || p_brand || '''' END AS line
  FROM part
)
"""


def _runs(source: str, key: str, least: int, head: int, tail: int, note: str, line: str = "line") -> str:
    """Gaps and islands: row numbers over the payload less those over the key's runs."""
    return f"""
keyed AS (SELECT payload_id, pos, line, {key} AS k FROM {source}),
flagged AS (SELECT *, CASE WHEN k IS NULL OR lag(k) OVER w IS NULL OR lag(k) OVER w <> k THEN 1 ELSE 0 END AS f FROM keyed WINDOW w AS (PARTITION BY payload_id ORDER BY pos)),
islands AS (SELECT *, sum(f) OVER (PARTITION BY payload_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM flagged),
sized AS (SELECT *, count(*) OVER (PARTITION BY payload_id, i) AS n, row_number() OVER (PARTITION BY payload_id, i ORDER BY pos) AS r FROM islands)
SELECT payload_id, pos, 0 AS part, {line} FROM sized WHERE k IS NULL OR n < {least} OR r <= {head} OR r > n - {tail}
UNION ALL
SELECT payload_id, pos, 1 AS part, {line.replace('line', note, 1) if line != 'line' else note + ' AS line'} FROM sized WHERE k IS NOT NULL AND n >= {least} AND r = {head}
"""


def _times(n: str) -> str:
    return f"({n}) || CASE WHEN {n} > 1 THEN ' more times' ELSE ' more time' END"


STRUCTURE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(line, '[''\"][^''\"]*[''\"]', '\"…\"', 'g'), '\\b\\d+\\b', 'N', 'g'),"
    " '\\b[a-z][a-zA-Z0-9]*\\d+\\b', 'ID', 'g'))"
)

_PATTERNS = ", ".join(
    f"({i}, {_q(code)}, {m}, {c}, {len(patterns)}, {_q(p)})" for i, (code, _, m, c, patterns) in enumerate(PROFILES) for p in patterns
)
CODES = ", ".join(
    f"CASE WHEN regexp_matches(s, {_q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))}) THEN {_q(code)} END" for code, _, _, _, patterns in PROFILES
)
MULTIPLIER = "CASE x " + " ".join(f"WHEN {_q(c)} THEN {m}::DOUBLE" for c, _, m, _, _ in PROFILES) + " END"
MIXED = """
hits AS (SELECT payload_id, text, list_filter([{codes}], lambda x: x IS NOT NULL) AS a, regexp_matches(s, '[\u3040-\u30ff]') AS kana
  FROM (SELECT payload_id, text, substr(coalesce(text, ''), 1, 500) AS s FROM texts)),
codes AS (SELECT payload_id, text, CASE WHEN list_contains(a, 'zh') AND NOT kana THEN list_filter(a, lambda x: x <> 'ja') ELSE a END AS a FROM hits),
mults AS (SELECT payload_id, text, a, [{multiplier} FOR x IN a] AS m FROM codes),
mixed AS (SELECT payload_id, text, a, CASE len(m) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN m[1] ELSE 0.4::DOUBLE * (list_sum(m) / len(m)) + 0.6::DOUBLE * list_max(m) END AS v FROM mults)
""".format(codes=CODES, multiplier=MULTIPLIER)
TEXTS = "texts AS (SELECT doc_id AS payload_id, text FROM documents)"
TURNS = "texts AS (SELECT conv_id * 1000 + turn AS payload_id, text FROM conversations)"
LANGUAGE = f"""
patterns(seq, code, multiplier, base, total, p) AS (VALUES {_PATTERNS}),
samples AS (SELECT payload_id, text, substr(coalesce(text, ''), 1, 500) AS s FROM texts),
counts AS (SELECT payload_id, seq, code, multiplier, base, total, greatest({units('s')}, 1) AS n, len(regexp_extract_all(s, p)) AS c FROM samples, patterns),
shares AS (
  SELECT payload_id, seq, code, multiplier, base, count(*) FILTER (WHERE c > 0) * 1.0::DOUBLE / any_value(total) AS share,
    least(sum(c)::DOUBLE / (any_value(n) / 5.0::DOUBLE), 1.0::DOUBLE) AS density
  FROM counts GROUP BY payload_id, seq, code, multiplier, base
),
confs AS (
  SELECT payload_id, seq, code, multiplier,
    least((share * w + density * (1 - w)) * greatest(CASE WHEN share >= 1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN density > 0.95 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END), 1.0::DOUBLE) * base::DOUBLE AS conf
  FROM (SELECT *, CASE WHEN density > 0.9 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS w FROM shares)
),
best AS (SELECT * FROM confs QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY conf DESC, seq DESC) = 1),
found AS (
  SELECT s.payload_id, s.text,
    CASE WHEN NOT regexp_matches(s.s, '\\S') OR b.conf < 0.1 THEN 'en' ELSE b.code END AS code,
    CASE WHEN NOT regexp_matches(coalesce(s.text, ''), '\\S') THEN 0.0::DOUBLE WHEN b.conf < 0.1 THEN 0.5::DOUBLE ELSE b.conf END AS confidence,
    CASE WHEN NOT regexp_matches(s.s, '\\S') OR b.conf < 0.1 THEN 1.0::DOUBLE ELSE b.multiplier::DOUBLE END AS multiplier
  FROM samples s JOIN best b USING (payload_id)
)
"""

ORDERS = """
rows_ AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
made AS (
  SELECT k,
    '{' || chr(10) || '  "order" : ' || k || ',' || chr(10) || '  "items" : [ ' || string_agg('{' || chr(10) || '    "l_linenumber" : ' || n || ',' || chr(10)
      || '    "l_partkey" : ' || p || ',' || chr(10) || '    "l_quantity" : ' || q || '.0,' || chr(10) || '    "l_returnflag" : "' || f || '"' || chr(10) || '  }', ', ' ORDER BY n, p, q, f)
      || ' ]' || chr(10) || '}' AS json,
    'order: ' || k || chr(10) || 'items[' || count(*) || ']{l_linenumber,l_partkey,l_quantity,l_returnflag}:'
      || string_agg(chr(10) || '  ' || n || ',' || p || ',' || q || ',' || f, '' ORDER BY n, p, q, f) AS toon,
    '[' || count(*) || ']{line,part,quantity,flag}:' || string_agg(chr(10) || '  "' || n || '","' || p || '","' || q || '.0",' || f, '' ORDER BY n, p, q, f) AS from_csv
  FROM rows_ GROUP BY k
),
sized AS (SELECT *, CAST(ceil(length(json) / 4.0) AS BIGINT) AS o, CAST(ceil(length(toon) / 4.0) AS BIGINT) AS c FROM made)
"""

REQUESTS = """
log AS (SELECT event_type AS tool_name, sha256(event_type || ':' || user_id) AS key, event_id, epoch_us(ts) // 1000 AS ts_ms FROM events)
"""
ENTRIES = """
entries AS (SELECT key, max(tool_name) AS value, min(ts_ms) AS created, max(ts_ms) AS last_accessed, count(*) - 1 AS access_count, min(ts_ms) + 86400000 AS expires_at FROM log GROUP BY key)
"""
METRICS = """
facts AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, event_type AS tool_name, event_id % 100 + 50 AS o, event_id % 40 AS saved,
    (event_id % 40)::DOUBLE / (event_id % 100 + 50) * 100 AS pct, event_id % 40 > 10 AS done, event_id % 17 = 0 AS hit, event_id % 5 AS cs
  FROM events
)
"""
STATS = """
  count(*) AS total_requests, count(*) FILTER (WHERE done) AS optimized_requests, count(*) FILTER (WHERE NOT done) AS skipped_requests,
  CAST(sum(o) AS BIGINT) AS tokens_before, CAST(sum(o - saved) AS BIGINT) AS tokens_after, CAST(sum(saved) AS BIGINT) AS total_savings,
  round(CASE WHEN count(*) FILTER (WHERE done) > 0 THEN sum(saved)::DOUBLE / sum(o) * 100 ELSE 0 END, 6) AS average_savings_percentage,
  count(*) FILTER (WHERE hit) AS cache_hits, count(*) FILTER (WHERE NOT hit AND done) AS cache_misses,
  round(CASE WHEN count(*) FILTER (WHERE hit OR done) > 0 THEN count(*) FILTER (WHERE hit)::DOUBLE / count(*) FILTER (WHERE hit OR done) ELSE 0 END, 6) AS cache_hit_rate,
  CAST(sum(cs) AS BIGINT) AS cache_savings, max(stamp) AS last_updated_at,
  arg_max(tool_name, (stamp, event_id)) AS last_tool_name, arg_max(CASE WHEN done THEN 'json' ELSE '~' END, (stamp, event_id)) AS lf,
  arg_max(done, (stamp, event_id)) AS last_was_optimized, arg_max(CASE WHEN done THEN '~' ELSE 'Not structured data' END, (stamp, event_id)) AS lr,
  arg_max(saved, (stamp, event_id)) AS last_savings, round(arg_max(pct, (stamp, event_id)), 6) AS last_savings_percentage
"""


def _stats(group: str) -> str:
    head = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"WITH {METRICS} SELECT * EXCLUDE (lf, lr), nullif(lf, '~') AS last_format, nullif(lr, '~') AS last_reason FROM (SELECT {head}{STATS} FROM facts{tail})"


def oracle_sql() -> dict[str, str]:
    yaml_full = FULL.format(t="coalesce(text, '')")
    count = lambda p: f"len(list_filter(l[1:20], lambda x: regexp_matches(x, {_q(p)})))"
    repeated = "[regexp_replace(regexp_replace(trim(x), '\\d+', '#', 'g'), '\\s+', ' ', 'g') FOR x IN l]"
    dynamic = "CASE WHEN t >= 1024 THEN chr(10) || '[DATA]' || chr(10) || text ELSE '[TOON-JSON]' || chr(10) || text END"
    prefix = PREFIX_CHARS
    kind = f"CASE WHEN {_score(TS)} >= 2 THEN 'code-ts' WHEN {_score(PY)} >= 2 THEN 'code-py' WHEN {_score(PHP)} >= 2 THEN 'code-php' WHEN {_score(GO)} >= 2 THEN 'code-go' WHEN {_score(GENERIC)} >= 3 THEN 'code-generic' ELSE 'none' END"
    blank = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
    rate = "printf('%.1f', optimized_requests * 100.0 / total_requests)"
    return {
        "detect_json_events": """
            SELECT event_type AS tool_name, CASE WHEN json_valid(props) AND json_type(props) IN ('OBJECT', 'ARRAY') THEN 'json' ELSE 'unknown' END AS format,
              count(*) AS n, CAST(sum(ceil(length(props) / 4.0)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2""",
        "detect_yaml_gate": f"""
            SELECT payload_id, n >= 3 AND (k >= 3 OR (i >= 2 AND d >= 2)) AND (k + i)::DOUBLE / least(n, 20) >= 0.3 AS is_yaml FROM (
              SELECT conv_id * 1000 + turn AS payload_id, len(l) AS n, {count('^\\s*[\\w][\\w\\s.-]*:\\s*.+')} AS k, {count('^\\s*-\\s+')} AS i, {count('^\\s{2,}\\S')} AS d
              FROM (SELECT conv_id, turn, {yaml_full} AS l FROM conversations))""",
        "detect_csv_gate": f"""
            SELECT doc_id AS payload_id, coalesce(len(l) >= 2 AND {COMMAS.format(x='l[1]')} > 0
              AND len(list_filter(l[2:10], lambda x: {COMMAS.format(x='x')} = {COMMAS.format(x='l[1]')})) >= least(len(l) - 1, 7), false) AS is_csv
            FROM (SELECT doc_id, {yaml_full} AS l FROM documents)""",
        "detect_code_scores": f"""
            SELECT page_id AS payload_id, {_score(TS)} AS ts, {_score(PY)} AS py, {_score(PHP)} AS php, {_score(GO)} AS go, {_score(GENERIC)} AS generic
            FROM (SELECT page_id, array_to_string(string_split(coalesce(html, ''), chr(10))[1:50], chr(10)) AS s FROM pages)""",
        "detect_debug_score": f"""
            WITH {LOGS}, texts AS (SELECT payload_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM logs GROUP BY payload_id),
            parts AS (SELECT *, {FULL.format(t='t')} AS l FROM texts),
            scored AS (SELECT payload_id, CASE WHEN len(l) < 4 THEN 0 ELSE
                CASE WHEN regexp_matches(t, '(?m)\\berror TS\\d+:') THEN 2 ELSE 0 END
              + CASE WHEN regexp_matches(t, '(?m)^\\s*at\\s+.+:\\d+:\\d+') THEN 2 ELSE 0 END
              + CASE WHEN len(list_filter({repeated}, lambda x: length(x) >= 12)) > len(list_distinct(list_filter({repeated}, lambda x: length(x) >= 12))) THEN 1 ELSE 0 END
              + CASE WHEN len(regexp_extract_all(t, '\\b[\\w./-]+\\.(ts|tsx|js|jsx|py|go|php):\\d+:\\d+\\b')) >= 2 THEN 1 ELSE 0 END END AS score FROM parts)
            SELECT payload_id, CAST(score AS INTEGER) AS score, round(least(0.92, 0.55 + 0.05 * score), 6)::DOUBLE AS confidence FROM scored""",
        "skip_tool_filter": """
            SELECT event_type AS tool_name, regexp_matches(event_type, '^c') OR regexp_matches(event_type, 'sign') AS skipped, count(*) AS n FROM events GROUP BY 1, 2""",
        "admission_reasons": f"""
            SELECT CASE WHEN text IS NULL THEN 'Invalid input: content must be a string'
              WHEN u > 5000 THEN 'Content too large: ' || printf('%.1f', u / 1048576.0) || 'MB exceeds 10MB limit'
              WHEN regexp_matches(source, '^src1$') OR regexp_matches(source, 'src2') THEN 'Tool ' || source || ' in skip list'
              WHEN u < 50 OR ceil(u / 4.0) < 50 THEN 'Too small' ELSE 'admitted' END AS reason, count(*) AS n FROM (SELECT *, {units('text')} AS u FROM documents) GROUP BY 1""",
        "evaluate_chars4": f"""
            SELECT payload_id, o AS original_tokens, o - c AS savings_tokens, round(CASE WHEN o > 0 THEN (o - c)::DOUBLE / o * 100 ELSE 0 END, 6) AS savings_pct,
              CASE WHEN o > 0 THEN (o - c)::DOUBLE / o * 100 ELSE 0 END >= 10 AS worth
            FROM (SELECT doc_id AS payload_id, CAST(ceil({units("text")} / 4.0) AS BIGINT) AS o, CAST(ceil({units("regexp_replace(text, '[|!]', '', 'g')")} / 4.0) AS BIGINT) AS c FROM documents)""",
        "merge_blank_lines": """
            SELECT doc_id AS payload_id, sha256(regexp_replace(regexp_replace(text, '\\. ', '.' || repeat(chr(10), 4), 'g'), '\\n{3,}', repeat(chr(10), 2), 'g')) AS digest FROM documents""",
        "drop_pointer_lines": f"WITH {LOGS} SELECT payload_id, count(*) AS n_lines FROM logs WHERE NOT regexp_matches(line, '^\\s*[|]?\\s*(\\^+|~+)\\s*$') GROUP BY payload_id",
        "collapse_duplicate_lines": f"""
            WITH doc_lines AS (SELECT doc_id AS payload_id, i - 1 AS pos, parts[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
              LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) r), {_runs('doc_lines', 'line', 2, 1, 0, "'[compact] repeated ' || " + _times('n - 1'), 'sha256(line) AS digest')}""",
        "collapse_log_lines": f"WITH {LOGS}, {_runs('logs', 'line', 2, 1, 0, _q('[compact] repeated ') + ' || ' + _times('n - 1'))}",
        "collapse_similar_diagnostics": f"""
            WITH {LOGS}, numbered AS (SELECT payload_id, row_number() OVER (PARTITION BY payload_id ORDER BY pos) - 1 AS pos, line FROM logs),
            marked AS (SELECT *, regexp_matches(line, '\\S') AS full_, CASE WHEN regexp_matches(line, ' - error TS2322: ') THEN regexp_replace(regexp_extract(line, 'error TS2322: .*$'), '\\s+', ' ', 'g') END AS k,
              max(pos) OVER (PARTITION BY payload_id) AS final FROM numbered),
            solid AS (SELECT *, lag(k) OVER w AS bk, pos - lag(pos) OVER w - 1 AS gap FROM marked WHERE full_ WINDOW w AS (PARTITION BY payload_id ORDER BY pos)),
            islands AS (SELECT *, sum(CASE WHEN k IS NOT NULL AND bk = k AND gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY payload_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM solid),
            heads AS (SELECT payload_id, i, min(pos) AS pos, max(pos) AS last, count(*) AS n, any_value(k) AS k, arg_min(line, pos) AS line, any_value(final) AS final FROM islands GROUP BY payload_id, i),
            nexts AS (SELECT *, lead(pos) OVER (PARTITION BY payload_id ORDER BY pos) AS nxt FROM heads),
            pieces AS (
              SELECT payload_id, pos, 0 AS part, line FROM nexts
              UNION ALL SELECT payload_id, pos, 1, '[compact] similar diagnostic repeated ' || {_times('n - 1')} FROM nexts WHERE k IS NOT NULL AND n > 1
              UNION ALL SELECT payload_id, pos, 2, '' FROM nexts WHERE k IS NOT NULL AND nxt IS NOT NULL AND nxt - last > 1
              UNION ALL SELECT m.payload_id, m.pos, 0, m.line FROM marked m LEFT JOIN nexts h ON h.payload_id = m.payload_id AND h.pos < m.pos AND (h.nxt IS NULL OR m.pos < h.nxt)
                WHERE NOT m.full_ AND (h.pos IS NULL OR h.k IS NULL))
            SELECT payload_id, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY pos, part) - 1 AS INTEGER) AS pos, line FROM pieces""",
        "collapse_stack": f"""WITH {LOGS}, {_runs('logs', "CASE WHEN regexp_matches(ltrim(line), '^at\\s+.+') THEN 'frame' END", 6, 4, 1,
            "'[compact] ' || (n - 5) || CASE WHEN n - 5 > 1 THEN ' more stack frames' ELSE ' more stack frame' END || ' omitted'")}""",
        "shorten_imports": """SELECT p_partkey, 'import { p } from ''…/mod' || p_partkey || '''' AS line FROM part""",
        "summarise_imports": f"WITH {CODE_LINES}, {_runs('code', _q('x') + " WHERE false UNION ALL SELECT payload_id, pos, line, CASE WHEN starts_with(line, 'import ') THEN 'import' END AS k", 6, 3, 0, "'// ... ' || (n - 3) || ' more imports'")}".replace(
            "'x' WHERE false UNION ALL SELECT payload_id, pos, line, CASE", "CASE"
        ).replace("END AS k AS k", "END AS k"),
        "collapse_repetitive": f"""WITH {CODE_LINES}, {_runs('code', f"CASE WHEN length({STRUCTURE}) > 10 THEN {STRUCTURE} END", 5, 3, 0, "'// ... ' || (n - 2) || ' more similar lines'")}""",
        "toon_tabular": """
            SELECT n_regionkey, 'nations[' || count(*) || ']{id,name}:' || chr(10) || string_agg('  ' || n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS toon
            FROM nation GROUP BY n_regionkey""",
        "detect_language": f"WITH {TEXTS}, {LANGUAGE} SELECT payload_id, code, round(confidence, 6) AS confidence FROM found",
        "adjusted_tokens": f"""
            WITH {TEXTS}, {LANGUAGE} SELECT code, count(*) AS n, CAST(sum(b) AS BIGINT) AS base, CAST(sum(CASE WHEN confidence < 0.3 THEN b ELSE ceil(b * multiplier) END) AS BIGINT) AS adjusted
            FROM (SELECT *, ceil({units('text')} / 4.0) AS b FROM found) GROUP BY code""",
        "mixed_multiplier": f"""
            WITH {TEXTS}, {MIXED} SELECT payload_id, array_to_string(a, ',') AS codes, round(v, 6) AS multiplier, CAST(ceil(ceil({units('text')} / 4.0) * v) AS BIGINT) AS tokens FROM mixed""",
        "language_analysis": f"""
            WITH {TURNS}, {LANGUAGE}, {MIXED} SELECT f.payload_id, f.code AS primary, array_to_string(m.a, ',') AS languages, round(m.v, 6) AS multiplier, len(m.a) > 1 AS is_mixed,
              CAST(ceil(ceil({units('f.text')} / 4.0) * f.multiplier) AS BIGINT) AS tokens, CAST(ceil({units('f.text')} / 4.0) AS BIGINT) AS base_tokens
            FROM found f JOIN mixed m USING (payload_id)""",
        "detect_code_type": f"""
            WITH parts AS (SELECT p_partkey // 50 AS n, p_partkey AS k, p_brand AS b, p_size AS z, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS r FROM part),
            typed AS (SELECT page_id AS payload_id, CASE WHEN len(string_split(coalesce(html, ''), chr(10))) >= 3 THEN {kind} ELSE 'none' END AS code_type
              FROM (SELECT page_id, html, array_to_string(string_split(coalesce(html, ''), chr(10))[1:50], chr(10)) AS s FROM pages)),
            files AS (SELECT DISTINCT unnest([n * 2, n * 2 + 1]) AS payload_id, unnest(['code-ts', 'code-py']) AS code_type FROM parts)
            SELECT code_type, count(*) AS n, CAST(sum(payload_id) AS BIGINT) AS ids FROM (SELECT * FROM typed UNION ALL SELECT * FROM files) GROUP BY code_type""",
        "cleanup_lines": f"""
            SELECT conv_id * 1000 + turn AS payload_id, sha256(regexp_replace(t, '^{blank}+|{blank}+$', '', 'g') || chr(10)) AS digest
            FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(u, '[\\t\\x0b\\f\\r \\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+(\\n|$)', chr(92) || '1', 'g'), '\\n{{3,}}', repeat(chr(10), 2), 'g') AS t
              FROM (SELECT conv_id, turn, chr(160) || chr(10) || replace(coalesce(text, ''), ', ', ', ' || chr(9) || repeat(chr(10), 4)) || ' ' || chr(65279) AS u FROM conversations))""",
        "drop_excerpts": f"""
            WITH {LOGS} SELECT payload_id, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY pos) - 1 AS INTEGER) AS pos, line FROM logs WHERE NOT regexp_matches(line, '^\\d+ +[|]')""",
        "strip_comments": """
            WITH parts AS (SELECT p_partkey // 50 AS n, p_partkey AS k, p_brand AS b, p_size AS z, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS r FROM part)
            SELECT n * 2 AS payload_id, string_agg('import { p' || k || ' } from ''../../lib/deep/parts''' || chr(10), '' ORDER BY r) FILTER (WHERE r <= 8) || chr(10)
              || string_agg('const part' || k || ': number = ' || z || ';' || chr(10), '' ORDER BY r) || 'export const done = true' AS content FROM parts GROUP BY n
            UNION ALL
            SELECT n * 2 + 1, 'import os' || chr(10) || 'import re' || chr(10) || 'def build(x):' || chr(10) || '    \"\"\"Builds.' || string_agg(chr(10) || '    y = ''' || b || '#''', '' ORDER BY r) FROM parts GROUP BY n""",
        "csv_read": f"WITH {ORDERS} SELECT k AS payload_id, 'csv' AS format, 0.8::DOUBLE AS confidence, from_csv AS toon FROM made",
        "toon_nested": f"WITH {ORDERS} SELECT k AS payload_id, 'json' AS format, toon FROM made",
        "optimize_orders": f"""
            WITH {ORDERS} SELECT k AS payload_id, CASE WHEN good THEN 'json' END AS format, good AS optimized, o AS original_tokens, CASE WHEN good THEN c END AS optimized_tokens,
              CASE WHEN good THEN o - c END AS savings_tokens, CASE WHEN good THEN 'toon-encode' END AS layers, sha256(CASE WHEN good THEN '[TOON-JSON]' || chr(10) || toon ELSE json END) AS digest,
              CAST(0 AS BIGINT) AS cached_savings FROM (SELECT *, (o - c) * 100.0 / o >= 10 AS good FROM sized)""",
        "hook_orders": f"""
            WITH {ORDERS} SELECT k AS payload_id, good AS optimized, sha256(CASE WHEN good THEN '{{"continue":true,"suppressOutput":true,"hookSpecificOutput":{{"hookEventName":"PostToolUse","additionalContext":"'
              || replace('[TOON-JSON]' || chr(10) || toon, chr(10), chr(92) || 'n') || '"}}}}' ELSE '{{"continue":true}}' END) AS digest
            FROM (SELECT *, length(json) >= 50 AND o >= 50 AND (length(json) - length(toon)) * 100.0 / length(json) >= 30 AS good FROM sized)""",
        "metrics_of_pipeline": f"""
            WITH {ORDERS} SELECT 'orders_json' AS tool_name, count(*) AS total_requests, count(*) FILTER (WHERE good) AS optimized_requests, CAST(sum(o) AS BIGINT) AS tokens_before,
              CAST(sum(CASE WHEN good THEN c ELSE o END) AS BIGINT) AS tokens_after, count(*) FILTER (WHERE good) AS cache_misses FROM (SELECT *, (o - c) * 100.0 / o >= 30 AS good FROM sized)""",
        "optimize_memoised": """
            SELECT event_id AS payload_id, 'json' AS format, true AS optimized, CAST(ceil(length(props) / 4.0) AS BIGINT) AS original_tokens,
              CAST(ceil(length('k: ' || json_extract_string(props, '$.k')) / 4.0) AS BIGINT) AS optimized_tokens FROM events""",
        "optimize_cache_hits": """
            SELECT event_id AS payload_id, event_type IN ('click', 'error') AS was_cached, 'json' AS format, '[TOON-JSON]' || chr(10) || 'k: ' || json_extract_string(props, '$.k') AS optimized_content,
              CAST(ceil(length(props) / 4.0) - ceil(length('k: ' || json_extract_string(props, '$.k')) / 4.0) AS BIGINT) AS savings_tokens FROM events""",
        "cache_replay_lru": f"""
            WITH {REQUESTS}, r AS (SELECT tool_name, event_id AS seq, lag(event_id) OVER (PARTITION BY tool_name, key ORDER BY event_id) AS prev FROM log),
            between_ AS (SELECT a.tool_name, a.seq, count(b.seq) AS others FROM r a LEFT JOIN r b ON b.tool_name = a.tool_name AND b.seq > a.prev AND b.seq < a.seq AND (b.prev IS NULL OR b.prev < a.prev)
              WHERE a.prev IS NOT NULL GROUP BY a.tool_name, a.seq),
            judged AS (SELECT r.tool_name, r.seq, coalesce(w.others < 100, false) AS hit FROM r LEFT JOIN between_ w ON w.tool_name = r.tool_name AND w.seq = r.seq)
            SELECT tool_name, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM judged GROUP BY tool_name""",
        "cache_put": f"""
            WITH {REQUESTS}, {ENTRIES}, set_ AS (SELECT DISTINCT key FROM log WHERE tool_name = 'click'),
            after AS (SELECT key, value, access_count, expires_at FROM entries WHERE key NOT IN (SELECT key FROM set_) UNION ALL SELECT key, 'set again', 0, 1800003600000 FROM set_)
            SELECT value, count(*) AS n, CAST(sum(access_count) AS BIGINT) AS accesses, max(expires_at) AS expires_at FROM after GROUP BY value""",
        "cache_probe": f"""
            WITH {REQUESTS}, {ENTRIES}, alive AS (SELECT key FROM entries WHERE expires_at >= (SELECT max(created) FROM entries)),
            asked AS (SELECT tool_name, key IN (SELECT key FROM alive) AS hit FROM log)
            SELECT tool_name, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE hit) AS there FROM asked GROUP BY tool_name""",
        "response_envelope": f"""
            SELECT doc_id AS payload_id, '{{' || chr(10) || CASE WHEN text IS NULL OR text = '' THEN
                '  "success" : false,' || chr(10) || '  "error" : {{' || chr(10) || '    "code" : "INVALID_INPUT",' || chr(10) || '    "message" : "content must be a non-empty string"'
              ELSE '  "success" : true,' || chr(10) || '  "data" : {{' || chr(10) || '    "tokens" : ' || CAST(ceil({units('text')} / 4.0) AS BIGINT) END || chr(10) || '  }}' || chr(10) || '}}' AS response
            FROM documents""",
        "dashboard_text": f"""
            WITH {METRICS}, s AS (SELECT {STATS}, sum(saved)::DOUBLE / sum(o) * 100 AS average, count(*) FILTER (WHERE hit)::DOUBLE / count(*) FILTER (WHERE hit OR done) * 100 AS cached,
              arg_max(pct, (stamp, event_id)) AS last_pct FROM facts)
            SELECT 'Token compaction statistics' || chr(10) || 'Total requests: ' || total_requests || chr(10) || 'Optimized: ' || optimized_requests || ' (' || {rate} || '%)' || chr(10) || chr(10)
              || 'Tokens before: ' || format('{{:,}}', tokens_before) || chr(10) || 'Tokens after: ' || format('{{:,}}', tokens_after) || chr(10) || 'Total savings: ' || format('{{:,}}', total_savings)
              || ' (' || printf('%.1f', average) || '%)' || chr(10) || chr(10) || 'Prompt caching' || chr(10) || 'Cache hits: ' || cache_hits || chr(10) || 'Cache misses: ' || cache_misses || chr(10)
              || 'Hit rate: ' || printf('%.1f', cached) || '%' || chr(10) || 'Additional cache savings: ' || format('{{:,}}', cache_savings) || ' tokens' || chr(10) || chr(10)
              || 'Cost savings at $3 a million input tokens: $' || printf('%.2f', (total_savings + cache_savings)::DOUBLE / 1000000 * 3) AS dashboard,
              'Health: active' || chr(10) || 'Requests: ' || total_requests || chr(10) || 'Optimized: ' || optimized_requests || ' (' || {rate} || '%)' || chr(10) || 'Skipped: ' || skipped_requests || chr(10)
              || 'Tokens saved: ' || format('{{:,}}', total_savings) || chr(10) || CASE WHEN last_was_optimized
                THEN 'Last optimized: ' || last_tool_name || ' as ' || lf || chr(10) || 'Saved: ' || format('{{:,}}', last_savings) || ' tokens (' || printf('%.1f', last_pct) || '%)'
                ELSE 'Last skipped: ' || last_tool_name || chr(10) || 'Reason: ' || lr END || chr(10) || 'Last update: ' || last_updated_at AS status
            FROM s""",
        "cache_key_dedup": "SELECT sha256('tool:' || coalesce(text, '')) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
        "cache_hit_rate": f"""
            WITH {REQUESTS} SELECT tool_name, count(*) - count(DISTINCT key) AS hits, count(DISTINCT key) AS misses,
              round((count(*) - count(DISTINCT key))::DOUBLE / count(*), 6) AS hit_rate FROM log GROUP BY tool_name""",
        "cache_replay_ttl": f"""
            WITH RECURSIVE {REQUESTS}, ordered AS (SELECT key, event_id, ts_ms, row_number() OVER (PARTITION BY key ORDER BY ts_ms, event_id) AS r FROM log),
            walk AS (SELECT key, event_id, r, ts_ms AS made, false AS hit FROM ordered WHERE r = 1
              UNION ALL SELECT o.key, o.event_id, o.r, CASE WHEN o.ts_ms <= w.made + 86400000 THEN w.made ELSE o.ts_ms END, o.ts_ms <= w.made + 86400000
              FROM walk w JOIN ordered o ON o.key = w.key AND o.r = w.r + 1)
            SELECT key, event_id, hit FROM walk""",
        "lru_top_k": f"WITH {REQUESTS}, {ENTRIES} SELECT key, last_accessed, access_count FROM entries ORDER BY last_accessed DESC, created DESC, key LIMIT 100",
        "ttl_expire": f"WITH {REQUESTS}, {ENTRIES} SELECT value, count(*) AS n FROM entries WHERE expires_at < (SELECT max(created) FROM entries) GROUP BY value",
        "cache_stats": f"WITH {REQUESTS}, {ENTRIES} SELECT count(*) AS size, 0.75::DOUBLE AS hit_rate, round(sum(access_count)::DOUBLE / count(*), 6) AS average_access_count FROM entries",
        "token_stats": _stats(""),
        "token_stats_by_tool": _stats("tool_name"),
        "dashboard_cost": f"WITH {METRICS} SELECT tool_name, round(sum(saved + cs)::DOUBLE / 1000000 * 3, 6) AS cost_savings FROM facts GROUP BY tool_name",
        "savings_stats_rollup": f"""
            WITH {METRICS} SELECT tool_name, count(*) AS n, round(avg(pct), 6) AS mean, round(min(pct), 6) AS lowest, round(max(pct), 6) AS highest,
              round(quantile_cont(pct, 0.5), 6) AS median, round(list_sort(list(pct))[count(*) // 2 + 1], 6) AS upper_median, min(event_id) AS first_seen
            FROM facts GROUP BY ROLLUP (tool_name)""",
        "prompt_cache_wrap": f"""
            SELECT payload_id, t >= 1024 AS breakpoint, CASE WHEN t >= 1024 THEN {prefix} + length(source) + 4 ELSE 0 END AS prefix_chars, sha256({dynamic}) AS digest,
              CASE WHEN t >= 1024 THEN ({prefix} + length(source) + 4)::DOUBLE / 4 END AS estimated_size
            FROM (SELECT doc_id AS payload_id, source, text, ceil(length(text) / 4.0) AS t FROM documents)""",
        "prompt_cache_formats": f"""
            SELECT doc_id AS payload_id, CASE WHEN ceil(length(text) / 4.0) >= 500 THEN 2 ELSE 1 END AS n_blocks,
              CASE WHEN ceil(length(text) / 4.0) >= 500 THEN {prefix} + length(source) + 3 ELSE length('Process the following TOON-formatted data:') END AS system_chars FROM documents""",
        "language_profiles": "SELECT * FROM (VALUES "
        + ", ".join(f"({_q(c)}, {_q(n)}, {m}::DOUBLE, {b}::DOUBLE, {len(p)})" for c, n, m, b, p in PROFILES)
        + ") t(code, name, multiplier, confidence, n_patterns)",
    }
