"""DuckDB SQL of the library's stages, as named parts that queries put together."""

from __future__ import annotations

from .operators import baselines, choose, classify, evaluate, graphs, score
from .sources.tables import QUESTIONS

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ITEM = r"regexp_matches({0}, '^(\d+\.\s|[*-]\s)')"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def strip(x: str) -> str:
    return _STRIP.format(x)


def item(x: str) -> str:
    return _ITEM.format(x)


def words(x: str) -> str:
    return _WORDS.format(x)


def tokens(x: str) -> str:
    return f"CAST(CASE WHEN {strip(x)} = '' THEN 0 ELSE greatest(1, ceil(length({x}) / 4.0)) END AS INTEGER)"


def _case(pairs, value, default):
    return "CASE " + " ".join(f"WHEN {value} = '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {default} END"


_cues = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + f" THEN '{kind}'" for kind, cues in classify.CUES)
CUES = _cues + " WHEN lower(text) LIKE '%?' OR contains(lower(text), 'open question') THEN 'question' ELSE 'fact' END"
_label = r"'(?i)^(?:#+\s*)?([\p{L}\p{N}_\s-]+):\s*(.*)'"
_tag = r"'(?i)^(?:-\s*)?\[([A-Z]+)-\d+\]\s*([^:]+):\s*(.*)'"
_kind = _case(classify.LABELS, "label", f"CASE WHEN label IN ({', '.join(map(repr, classify.WEIGHTS))}) THEN label ELSE 'fact' END")
WEIGHT = _case(classify.WEIGHTS, "unit_type", str(classify.OTHER_WEIGHT))
MARKERS = " OR ".join(f"contains(lower(a.text), '{m}')" for m in graphs.MARKERS)
_back = " OR ".join("(unit_type = '{}' AND back IN ({}))".format(k, ", ".join(map(repr, v))) for k, v in graphs.LOOKS_BACK.items())
_plain = "replace(replace(replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r'), chr(8), chr(92) || 'b'), chr(12), chr(92) || 'f')"
_unit16 = "chr(92) || 'u' || lower(lpad(to_hex({0}), 4, '0'))"
#: A JSON string's inside: characters that are not printable ASCII as one or two UTF-16 code units.
_json = f"array_to_string(list_transform(string_split({_plain}, ''), lambda c: CASE WHEN c = '' OR ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN {_unit16.format('ord(c)')} ELSE {_unit16.format('(55296 + (ord(c) - 65536) // 1024)')} || {_unit16.format('(56320 + (ord(c) - 65536) % 1024)')} END), '')"
_shapes = {
    0: "'# ' || line", 1: "'- ' || line", 2: "'- ' || line", 3: "'1. ' || line", 4: "'Decision: ' || line", 5: "'[CON-01] Limit: ' || line", 6: "'[REA-02] Why: ' || line",
    7: "'We selected this because ' || lower(line)", 8: "'Requirement:'", 9: "line", 10: "'Goal: ' || line", 11: "'Services must never stop. ' || line",
    12: "'Task: implement the pipeline v2.1'", 13: "'---'", 14: "'Is AGENT-INT-03 ready?'", 15: "'Compare versus SOC2. ' || line",
}
#: Questions of the answer queries: each kind that is answered in its own way.
ANSWERED = ("Who asks about the request?", "What is in the answer?", "Where is the answer to the question?", "When was the request made?", "Why is this the answer?", "Compare the answers")
_said = ", ".join(f"('q{k}', '{q}')" for k, q in enumerate(ANSWERED))
_asked = ", ".join(f"('q{k}', '{q}')" for k, q in enumerate(QUESTIONS))

#: In order: each part may use those before it.
PARTS = {
    "docs": "SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(text, '') AS text FROM documents",
    "raw": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "shaped": "SELECT doc_id, idx, (doc_id * 7 + idx) % 16 AS k, line FROM raw",
    "sdocs": "SELECT CAST(doc_id AS VARCHAR) AS document_id, string_agg(CASE WHEN idx = 0 THEN '' WHEN k IN (2, 3, 9) THEN chr(10) ELSE chr(10) || chr(10) END || CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in _shapes.items()) + " END, '' ORDER BY idx) AS text FROM shaped GROUP BY doc_id",
    "asked": f"SELECT * FROM (VALUES {_asked}) t(query_id, query)",
    "lines": "SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM sdocs",
    "labels1": f"SELECT *, {strip('line')} AS lab, {strip('lead(line) OVER (PARTITION BY document_id ORDER BY pos)')} AS aft FROM lines",
    "labels2": f"SELECT *, coalesce(lab LIKE '%:' AND length(lab) - length(replace(lab, ':', '')) = 1 AND aft <> '' AND NOT {item('aft')}, false) AS can FROM labels1",
    "labels3": "SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY pos) AS run FROM labels2",
    "labels4": "SELECT *, can AND (row_number() OVER (PARTITION BY document_id, run, can ORDER BY pos)) % 2 = 1 AS merges FROM labels3",
    "labels5": "SELECT *, coalesce(lag(merges) OVER (PARTITION BY document_id ORDER BY pos), false) AS taken FROM labels4",
    "merged": r"SELECT document_id, pos, CASE WHEN merges THEN regexp_extract(line, '^\s*') || lab || ' ' || aft ELSE line END AS line FROM labels5 WHERE NOT taken",
    "mtexts": "SELECT document_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM merged GROUP BY document_id",
    "paras0": f"SELECT document_id, {strip('unnest(string_split(text, chr(10) || chr(10)))')} AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS ppos FROM mtexts",
    "paras": f"SELECT *, len(list_filter(string_split(p, chr(10)), lambda l: {item(strip('l'))})) > 0 AS listed FROM paras0 WHERE p <> ''",
    "pieces0": f"SELECT document_id, ppos, {strip('unnest(string_split(p, chr(10)))')} AS piece, generate_subscripts(string_split(p, chr(10)), 1) AS lpos FROM paras WHERE listed",
    "pieces": f"SELECT document_id, ppos, lpos, piece, {item('piece')} OR piece LIKE '%:' AS whole FROM pieces0 WHERE piece <> '' UNION ALL SELECT document_id, ppos, 0, p, false FROM paras WHERE NOT listed",
    "cuts": r"SELECT *, CASE WHEN whole THEN [piece] ELSE string_split(regexp_replace(piece, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS parts FROM pieces",
    "split": "SELECT document_id, ppos, lpos, unnest(parts) AS text, generate_subscripts(parts, 1) AS spos FROM cuts",
    "sentences": rf"SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ppos, lpos, spos) - 1 AS INTEGER) AS sentence_index, text FROM split WHERE {strip('text')} <> ''",
    "h1": f"SELECT document_id, sentence_index, {strip('text')} AS text, starts_with({strip('text')}, '# ') AS is_h1 FROM sentences",
    "h2": "SELECT *, is_h1 AND NOT coalesce(lag(is_h1) OVER (PARTITION BY document_id ORDER BY sentence_index), false) AS begins FROM h1",
    "h3": "SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY document_id ORDER BY sentence_index) AS island FROM h2",
    "headed": r"SELECT document_id, sentence_index, text, coalesce(string_agg(CASE WHEN is_h1 THEN regexp_replace(text, '^[# \t]+|[# \t]+$', '', 'g') END, ' | ') OVER (PARTITION BY document_id, island ORDER BY sentence_index ROWS UNBOUNDED PRECEDING), '') AS context_header FROM h3",
    "w1": rf"SELECT *, {item('text')} AND NOT regexp_matches(text, '^(?:-\s*)?\[[A-Z]+-\d+\]') AS it, regexp_matches(text, '^[-*=_\s]{{3,}}$') AS ru FROM headed",
    "w2": "SELECT *, it AND NOT coalesce(lag(it) OVER (PARTITION BY document_id ORDER BY sentence_index), false) AS starts, coalesce(lag(NOT it AND NOT ru) OVER (PARTITION BY document_id ORDER BY sentence_index), false) AS led FROM w1",
    "w3": "SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY document_id ORDER BY sentence_index) AS run FROM w2",
    "w4": "SELECT *, CASE WHEN starts THEN list(text) OVER (PARTITION BY document_id, run, it ORDER BY sentence_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS steps FROM w3",
    "w5": "SELECT *, lead(steps) OVER (PARTITION BY document_id ORDER BY sentence_index) AS nsteps FROM w4",
    "w6": r"SELECT *, NOT it AND NOT ru AND nsteps IS NOT NULL AS header FROM w5",
    "w7": rf"SELECT document_id, sentence_index, context_header, CASE WHEN header THEN {strip(chr(114) + 'egexp_replace(text, ' + chr(39) + ':+$' + chr(39) + ', ' + chr(39) * 2 + ')')} WHEN it THEN 'Unnamed Workflow' END AS workflow_name, CASE WHEN header THEN nsteps WHEN it THEN steps END AS steps, CASE WHEN header THEN text || chr(10) || array_to_string(nsteps, chr(10)) WHEN it THEN array_to_string(steps, chr(10)) ELSE text END AS text FROM w6 WHERE NOT it OR (starts AND NOT led)",
    "k1": rf"SELECT *, regexp_matches(text, {_tag}) AS tagged, regexp_matches(text, {_label}) AND regexp_extract(text, {_label}, 2) <> '' AS labelled, lower(replace(trim(regexp_replace(regexp_extract(text, {_label}, 1), '\s+', ' ', 'g')), ' ', '_')) AS label FROM w7",
    "units": f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY sentence_index) - 1 AS INTEGER) AS unit_pos, sentence_index, text, context_header, workflow_name, steps,
        CASE WHEN workflow_name IS NOT NULL THEN 'workflow' WHEN tagged THEN {_case(classify.TAGS, f"upper(regexp_extract(text, {_tag}, 1))", "'fact'")} WHEN labelled THEN {_kind} ELSE {CUES} END AS unit_type,
        CASE WHEN workflow_name IS NULL AND tagged THEN {strip(f"regexp_extract(text, {_tag}, 2)")} ELSE '' END AS subject, '' AS relation,
        CASE WHEN workflow_name IS NOT NULL THEN '' WHEN tagged THEN {strip(f"regexp_extract(text, {_tag}, 3)")} WHEN labelled THEN regexp_extract(text, {_label}, 2) ELSE text END AS object,
        CASE WHEN workflow_name IS NULL THEN text ELSE '{{' || chr(10) || '  "type": "workflow",' || chr(10) || '  "name": "' || {_json.format("workflow_name")} || '",' || chr(10) || '  "steps": [' || chr(10) || array_to_string(list_transform(steps, lambda s: '    "' || {_json.format("s")} || '"'), ',' || chr(10)) || chr(10) || '  ]' || chr(10) || '}}' END AS render_text FROM k1""",
    "knodes": "SELECT document_id, unit_pos, sentence_index, unit_type, unnest(list_distinct([lower(subject), lower(object)])) AS node FROM units",
    "kedges": "SELECT DISTINCT document_id, node, sentence_index AS sentence_idx FROM knodes WHERE node <> '' AND unit_type <> 'workflow'",
    "conn": "SELECT u.document_id, u.unit_pos, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS connectivity FROM units u LEFT JOIN (SELECT * FROM knodes WHERE node <> '') k USING (document_id, unit_pos) LEFT JOIN (SELECT document_id, node, count(*) AS n FROM kedges GROUP BY ALL) s ON s.document_id = u.document_id AND s.node = k.node GROUP BY u.document_id, u.unit_pos",
    "backs": "SELECT DISTINCT unit_type AS back FROM (VALUES ('constraint'), ('decision'), ('goal'), ('reason'), ('requirement')) t(unit_type)",
    "slinks": f"SELECT document_id, sentence_index AS source_idx, (SELECT b.sentence_index FROM units b WHERE b.document_id = a.document_id AND b.unit_pos < a.unit_pos AND b.unit_type = back ORDER BY b.unit_pos DESC LIMIT 1) AS target_idx FROM units a, backs WHERE {_back}",
    "sedges": f"SELECT DISTINCT * FROM (SELECT document_id, source_idx, target_idx FROM slinks WHERE abs(source_idx - target_idx) <= {graphs.FARTHEST} UNION ALL SELECT document_id, target_idx, source_idx FROM slinks WHERE abs(source_idx - target_idx) <= {graphs.FARTHEST})",
    "llinks": f"SELECT a.document_id, a.sentence_index AS source_idx, b.sentence_index AS target_idx FROM units a JOIN units b ON a.document_id = b.document_id AND a.unit_pos <> b.unit_pos AND abs(a.unit_pos - b.unit_pos) <= {graphs.NEAR_UNITS} AND abs(a.sentence_index - b.sentence_index) <= {graphs.NEAR_SENTENCES} WHERE {MARKERS}",
    "ledges": "SELECT DISTINCT * FROM (SELECT document_id, source_idx, target_idx FROM llinks UNION ALL SELECT document_id, target_idx, source_idx FROM llinks)",
    "redges": "SELECT DISTINCT * FROM (SELECT * FROM sedges UNION ALL SELECT * FROM ledges)",
    "uterms": f"SELECT DISTINCT document_id, unit_pos, unnest({words('text')}) AS term FROM units",
    "idf": "SELECT document_id, term, ln(n / (1.0 + df)) + 1 AS idf FROM (SELECT document_id, term, count(*) AS df FROM uterms WHERE length(term) >= 2 GROUP BY ALL) JOIN (SELECT document_id, count(*) AS n FROM units GROUP BY ALL) USING (document_id)",
    "features": rf"SELECT query_id, query, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(query, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2), lambda w: lower(w)))) AS terms, list_sort(list_distinct(regexp_extract_all(query, '{score.IDENTIFIER}'))) AS ids, array_to_string({words('query')}, ' ') AS phrase FROM asked",
    "hits": "SELECT u.document_id, u.unit_pos, query_id, sum(coalesce(i.idf, 1.0)) * pow(1.5, count(*) - 1) AS lexical FROM units u, (SELECT query_id, unnest(terms) AS term FROM features) f LEFT JOIN idf i ON i.document_id = u.document_id AND i.term = f.term WHERE contains(lower(u.text), f.term) GROUP BY ALL",
    "scored": f"""SELECT document_id, unit_pos, query_id, sentence_index, text, lexical, phrase, intent, hard, CASE WHEN unit_type IN ({', '.join(map(repr, score.PRESERVED))}) AND (lexical > 0 OR hard > 0) THEN 2.5 ELSE 0.0 END AS priority,
        round(CAST({WEIGHT} * 2.0 + lexical + phrase + least(connectivity * 0.1, 1.0) + intent + hard + CASE WHEN unit_type IN ({', '.join(map(repr, score.PRESERVED))}) AND (lexical > 0 OR hard > 0) THEN 2.5 ELSE 0.0 END AS DOUBLE), 9) AS score FROM (
        SELECT u.document_id, u.unit_pos, f.query_id, u.sentence_index, u.text, u.unit_type, connectivity, coalesce(h.lexical, 0.0) AS lexical, CASE WHEN length(phrase) > 4 AND contains(lower(u.text), phrase) THEN 5.0 ELSE 0.0 END AS phrase,
        CASE WHEN list_has_any(string_split(u.unit_type, '_'), terms) THEN 3.0 ELSE 0.0 END + CASE WHEN u.unit_type = 'workflow' AND list_has_any(terms, {list(score.PROCESS_WORDS)}) THEN 3.0 ELSE 0.0 END AS intent,
        len(list_filter(ids, lambda x: contains(u.text, x) OR contains(lower(u.text), lower(x)))) * 15.0 AS hard FROM units u JOIN conn USING (document_id, unit_pos), features f LEFT JOIN hits h ON h.document_id = u.document_id AND h.unit_pos = u.unit_pos AND h.query_id = f.query_id)""",
    "plines": f"SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS INTEGER) AS line_no, line FROM (SELECT document_id, {strip('unnest(string_split(text, chr(10)))')} AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs) WHERE line <> ''",
    "bq": "SELECT CAST(item_id AS VARCHAR) AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM benchmark",
    "bpairs": "SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id % (SELECT count(*) FROM benchmark) AS VARCHAR) AS query_id FROM documents",
    "btf": r"SELECT document_id, line_no, term, count(*) AS tf FROM (SELECT document_id, line_no, unnest(regexp_extract_all(line, '\S+')) AS term FROM plines) GROUP BY ALL",
    "bsize": "SELECT document_id, line_no, sum(tf) AS size FROM btf GROUP BY ALL",
    "bmean": "SELECT document_id, count(*) AS n, sum(size) / count(*) AS mean FROM bsize GROUP BY ALL",
    "braw": "SELECT document_id, term, mean, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT document_id, term, count(*) AS df FROM btf GROUP BY ALL) JOIN bmean USING (document_id)",
    "bidf": f"SELECT document_id, term, mean, CASE WHEN raw < 0 THEN floor_w ELSE raw END AS idf FROM braw JOIN (SELECT document_id, avg(raw) * {baselines.EPSILON} AS floor_w FROM braw GROUP BY ALL) USING (document_id)",
    "bm25": f"SELECT document_id, line_no, query_id, sum(idf * tf * {baselines.K1 + 1} / (tf + {baselines.K1} * (1 - {baselines.B} + {baselines.B} * size / mean))) AS score FROM btf JOIN (SELECT query_id, unnest(regexp_extract_all(query, '\\S+')) AS term FROM bq) USING (term) JOIN bpairs USING (document_id, query_id) JOIN bidf USING (document_id, term) JOIN bsize USING (document_id, line_no) GROUP BY ALL",
    "bfull": "SELECT l.document_id, l.line_no, p.query_id, coalesce(b.score, 0) AS score FROM plines l JOIN bpairs p USING (document_id) LEFT JOIN bm25 b ON b.document_id = l.document_id AND b.line_no = l.line_no AND b.query_id = p.query_id",
    "steps": "SELECT document_id, unit_pos, step_no, first, second FROM (SELECT *, lead(first) OVER (PARTITION BY document_id, unit_pos ORDER BY step_no) AS second FROM (SELECT document_id, unit_pos, unnest(steps) AS first, CAST(generate_subscripts(steps, 1) - 1 AS INTEGER) AS step_no FROM units WHERE steps IS NOT NULL)) WHERE second IS NOT NULL",
    "said": f"SELECT * FROM (VALUES {_said}) t(query_id, query)",
    "ctx": f"SELECT CAST(c.conv_id AS VARCHAR) AS document_id, 'q' || (conv_id % {len(ANSWERED)}) AS query_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS context FROM conversations c GROUP BY conv_id",
}


_KEYS = "document_id, query_id"
_both = "len(list_intersect(a.words, b.words))"
PARTS["known"] = f"SELECT document_id, unit_pos, sentence_index, text, render_text, context_header, concat_ws(chr(31), unit_type, lower(subject), lower(relation), lower(object)) AS same, list_distinct({words('text')}) AS words, {tokens('render_text')} AS tokens FROM units"
PARTS["bars"] = f"SELECT a.document_id, a.unit_pos, list(b.unit_pos) AS barred FROM known a JOIN known b ON a.document_id = b.document_id AND a.unit_pos <> b.unit_pos AND (a.same = b.same OR (len(a.words) > 0 AND len(b.words) > 0 AND {_both} / (len(a.words) + len(b.words) - {_both}) > {choose.REPEATS})) GROUP BY ALL"
PARTS["ranked"] = f"SELECT s.document_id, s.query_id, s.unit_pos, k.tokens, coalesce(b.barred, []) AS barred, row_number() OVER (PARTITION BY s.document_id, s.query_id ORDER BY s.score DESC, s.unit_pos) AS place FROM scored s JOIN known k USING (document_id, unit_pos) LEFT JOIN bars b USING (document_id, unit_pos)"
PARTS["dmeta"] = f"SELECT d.document_id, CAST(length(d.text) AS INTEGER) AS original_chars, CAST(n AS INTEGER) AS original_sentences, {tokens('d.text')} AS original_estimated_tokens FROM sdocs d JOIN (SELECT document_id, count(*) AS n FROM sentences GROUP BY ALL) USING (document_id)"


def choice(tag: str, most: int, max_tokens: int | None = None, floor: int = 250, window: int = 1) -> None:
    """Adds the parts of one setting of the engine: walk, chosen, near, reached, kept, line and reduced, each with the tag."""
    over = f"total + tokens > {max_tokens}" if max_tokens else "false"
    enough = f"(total + tokens >= {floor}" + (f" OR total + tokens >= {max_tokens})" if max_tokens else ")")
    PARTS[f"walk{tag}"] = f"""SELECT {_KEYS}, CAST(0 AS BIGINT) AS place, CAST([] AS INTEGER[]) AS pos, CAST(0 AS BIGINT) AS total, false AS done FROM ranked GROUP BY ALL UNION ALL
        SELECT {_KEYS}, place, CASE WHEN repeats OR {over} THEN pos ELSE list_append(pos, unit_pos) END, CASE WHEN repeats OR {over} THEN total ELSE total + tokens END, NOT repeats AND ({over} OR (len(pos) + 1 >= {most} AND {enough}))
        FROM (SELECT w.document_id, w.query_id, r.place, w.pos, w.total, r.unit_pos, r.tokens, list_has_any(w.pos, r.barred) AS repeats FROM walk{tag} w JOIN ranked r ON r.document_id = w.document_id AND r.query_id = w.query_id AND r.place = w.place + 1 WHERE NOT w.done)"""
    PARTS[f"picked{tag}"] = f"SELECT {_KEYS}, arg_max(pos, place) AS pos FROM walk{tag} GROUP BY ALL"
    PARTS[f"chosen{tag}"] = f"SELECT p.document_id, p.query_id, k.unit_pos, k.sentence_index, k.same FROM (SELECT {_KEYS}, unnest(pos) AS unit_pos FROM picked{tag}) p JOIN known k USING (document_id, unit_pos)"
    PARTS[f"near{tag}"] = f"""SELECT {_KEYS}, unit_pos, sentence_index FROM chosen{tag} UNION SELECT {_KEYS}, min(unit_pos), arg_min(sentence_index, unit_pos) FROM (
        SELECT c.document_id, c.query_id, k.unit_pos, k.sentence_index, k.same FROM chosen{tag} c JOIN known k ON k.document_id = c.document_id AND abs(k.sentence_index - c.sentence_index) <= {window}) n
        WHERE NOT EXISTS (SELECT 1 FROM chosen{tag} c WHERE c.document_id = n.document_id AND c.query_id = n.query_id AND c.same = n.same) GROUP BY {_KEYS}, same"""
    for own, from_, column in ((f"hop{tag}", f"near{tag}", "sentence_index"), (f"reached{tag}", f"hop{tag}", "i")):
        PARTS[own] = f"SELECT {_KEYS}, {column} AS i FROM {from_} UNION SELECT h.document_id, h.query_id, e.target_idx FROM {from_} h JOIN redges e ON e.document_id = h.document_id AND e.source_idx = h.{column}"
    PARTS[f"kept{tag}"] = f"SELECT r.document_id, r.query_id, k.* EXCLUDE (document_id) FROM reached{tag} r JOIN known k ON k.document_id = r.document_id AND k.sentence_index = r.i QUALIFY row_number() OVER (PARTITION BY r.document_id, r.query_id, k.same ORDER BY k.unit_pos) = 1"
    PARTS[f"first{tag}"] = f"SELECT *, context_header <> '' AND NOT starts_with(text, '#') AS headed FROM kept{tag} QUALIFY row_number() OVER (PARTITION BY {_KEYS}, sentence_index ORDER BY unit_pos) = 1"
    PARTS[f"line{tag}"] = f"SELECT *, coalesce(last_value(CASE WHEN headed THEN context_header END IGNORE NULLS) OVER (PARTITION BY {_KEYS} ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM first{tag}"
    headed = "CASE WHEN headed AND context_header <> before THEN '[' || context_header || ']' || chr(10) ELSE '' END || render_text"
    PARTS[f"context{tag}"] = f"SELECT {_KEYS}, {strip(f'string_agg({headed}, chr(10) ORDER BY sentence_index)')} AS context FROM line{tag} GROUP BY ALL"
    PARTS[f"reduced{tag}"] = f"""SELECT {_KEYS}, coalesce(context, '') AS context, original_sentences, CAST(coalesce(n, 0) AS INTEGER) AS reduced_sentences, CAST(len(pos) AS INTEGER) AS selected_sentence_count, original_chars,
        CAST(length(coalesce(context, '')) AS INTEGER) AS reduced_chars, original_estimated_tokens, {tokens("coalesce(context, '')")} AS reduced_estimated_tokens, round(1 - length(coalesce(context, '')) / greatest(original_chars, 1), 4) AS reduction_ratio
        FROM picked{tag} JOIN dmeta USING (document_id) LEFT JOIN context{tag} USING ({_KEYS}) LEFT JOIN (SELECT {_KEYS}, count(*) AS n FROM kept{tag} GROUP BY ALL) USING ({_KEYS})"""


choice("4", 4)
choice("6", 6)
choice("4t", 4, max_tokens=120)
choice("4a", 4, window=0)


_CHAIN = "lines labels1 labels2 labels3 labels4 labels5 merged mtexts paras0 paras pieces0 pieces cuts split sentences h1 h2 h3 headed w1 w2 w3 w4 w5 w6 w7 k1 units slinks sedges llinks ledges redges steps".split()


def again(tag: str, source: str) -> None:
    """Adds the parts from lines to redges and steps once more, with the tag, for other documents than sdocs."""
    import re

    for name in _CHAIN:
        body = PARTS[name]
        for own in _CHAIN:
            body = re.sub(rf"(FROM|JOIN) {own}\b", rf"\1 {own}{tag}", body)
        PARTS[f"{name}{tag}"] = body.replace("FROM sdocs", f"FROM ({source})")


#: The contexts of reduced4, and the first half and the whole of each document, as documents of their own.
PARTS["found"] = "SELECT document_id, query_id, context FROM reduced4 UNION ALL SELECT document_id, 'half', substr(text, 1, length(text) // 2) FROM sdocs UNION ALL SELECT document_id, 'whole', text FROM sdocs"
again("r", "SELECT document_id || chr(31) || query_id AS document_id, context AS text FROM found")


def likeness(a: str, b: str) -> str:
    x, y = (f"list_distinct({words(c)})" for c in (a, b))
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / sqrt(CAST(len({x}) AS DOUBLE) * len({y})) END"


_split = "split_part(document_id, chr(31), 1) AS document_id, split_part(document_id, chr(31), 2) AS query_id"
_w = f"list_distinct({words('text')}) AS w"
PARTS["alike"] = f"SELECT r.document_id, r.query_id, r.unit_pos, r.sentence_index, u.unit_pos AS place, u.sentence_index AS mapped, CASE WHEN len(r.w) = 0 OR len(u.w) = 0 THEN 0 ELSE len(list_intersect(r.w, u.w)) / sqrt(CAST(len(r.w) AS DOUBLE) * len(u.w)) END AS score FROM (SELECT * EXCLUDE (document_id), {_split}, {_w} FROM unitsr) r JOIN (SELECT *, {_w} FROM units) u ON u.document_id = r.document_id"
PARTS["mapping"] = "SELECT document_id, query_id, sentence_index, arg_max(mapped, unit_pos) AS mapped FROM (SELECT * FROM alike QUALIFY row_number() OVER (PARTITION BY document_id, query_id, unit_pos ORDER BY score DESC, place) = 1) WHERE score >= 0.8 GROUP BY ALL"


def sql(select: str, **instead: str) -> str:
    """The statement, with the parts that it uses, directly or not; ``instead`` gives parts another statement."""
    import re

    given = PARTS | instead
    parts: dict[str, str] = {}

    def need(statement: str, *above: str) -> None:
        for name in re.findall(r"\b\w+\b", statement):
            if name in given and name not in parts and name not in above:
                need(given[name], *above, name)
                parts[name] = given[name]

    need(select)
    listed = ", ".join(f"{k} AS ({v})" for k, v in parts.items())
    return f"WITH RECURSIVE {listed} {select}" if parts else select
