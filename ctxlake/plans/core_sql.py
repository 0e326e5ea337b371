"""The core queries in SQL, written independently, for the oracle."""

from __future__ import annotations

_WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PAGES = "pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id) AS rn FROM page_results) WHERE rn = 1)"


def _len(x: str) -> str:
    """Code points: length counts some joined signs as one, so every code point becomes one letter first."""
    return f"length(regexp_replace({x}, '(?s).', 'a', 'g'))"


def _tok(x: str) -> str:
    return f"CASE WHEN coalesce({_len(x)}, 0) = 0 THEN 0 ELSE greatest(1, round_even({_len(x)} / 4.0, 0)) END::BIGINT"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _img(w: str, h: str) -> str:
    s = f"(1568.0::DOUBLE / greatest({w}, {h})::DOUBLE)"
    side = lambda x: f"(CASE WHEN greatest({w}, {h}) <= 1568 THEN ({x})::DOUBLE ELSE greatest(1.0, round_even(({x})::DOUBLE * {s}, 0)) END)"
    return f"(CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0 ELSE greatest(1.0, round_even({side(w)} * {side(h)} / 750.0::DOUBLE, 0)) END)::BIGINT"


def _norm(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g'))"


_FIG = "CASE WHEN coalesce(len(figures), 0) = 0 THEN coalesce(text, '') WHEN coalesce(text, '') = '' THEN {b} ELSE text || chr(10) || chr(10) || {b} END".format(
    b="array_to_string(list_transform(range(1, len(figures) + 1), lambda i: '[figure ' || i || ' on page ' || (page_index + 1) || '] ' || figures[i]), chr(10) || chr(10))"
)
_PLIST = "array_to_string(list_transform({c}[1:8], lambda p: (p + 1)::VARCHAR), ', ') || CASE WHEN len({c}) > 8 THEN ' and ' || (len({c}) - 8) || ' others' ELSE '' END"
_DOCS = f"""{_PAGES},
dc AS (SELECT doc_key, count(*) AS page_count, sum(coalesce(raw_tokens_est, 0))::BIGINT AS raw_tokens, sum(coalesce(distilled_tokens_est, 0))::BIGINT AS distilled_tokens,
  count(*) FILTER (method = 'native_text') AS pages_native, count(*) FILTER (method IN ('ocr', 'ocr_degraded')) AS pages_ocr, count(*) FILTER (method = 'vision') AS pages_vision, count(*) FILTER (method = 'ocr_degraded') AS pages_degraded,
  avg(ocr_confidence) AS mean_confidence, sum(coalesce(len(figures), 0))::BIGINT AS figure_count,
  coalesce(list(page_index ORDER BY page_index) FILTER (method = 'native_text' AND coalesce(image_count, 0) > 0 AND coalesce(len(figures), 0) = 0), []) AS uncaptured,
  coalesce(list(page_index ORDER BY page_index) FILTER (coalesce(len(figures), 0) > 0), []) AS described,
  coalesce(array_to_string(flatten(list(coalesce(warnings, []) ORDER BY page_index)), '|'), '') AS warnings,
  string_agg({_FIG}, chr(10) || chr(10) ORDER BY page_index) AS text FROM pg GROUP BY doc_key),
d AS (SELECT *, raw_tokens / greatest(1, distilled_tokens)::DOUBLE AS ratio,
  CASE WHEN len(described) > 0 THEN figure_count || ' figure(s) of ' || len(described) || ' page(s) stand in the text as [figure N on page M]: pages ' || {_PLIST.format(c="described")} END AS figures_note,
  CASE WHEN len(uncaptured) > 0 THEN 'images of ' || len(uncaptured) || ' page(s) have no text here: pages ' || {_PLIST.format(c="uncaptured")} END AS uncaptured_note FROM dc)"""
_RUNS = f"{_DOCS}, runs AS (SELECT d.*, x.created_at AS ts, x.source_path, x.source_type, x.duration_ms FROM d JOIN distillations x ON x.content_hash = d.doc_key)"
_SAVED = "SELECT count(*) AS runs, coalesce(sum(raw_tokens), 0)::BIGINT AS raw_tokens, coalesce(sum(distilled_tokens), 0)::BIGINT AS distilled_tokens, greatest(0, coalesce(sum(raw_tokens), 0) - coalesce(sum(distilled_tokens), 0))::BIGINT AS saved_tokens, round(CASE WHEN coalesce(sum(distilled_tokens), 0) = 0 THEN 0.0 ELSE sum(raw_tokens)::DOUBLE / sum(distilled_tokens) END, 6) AS ratio FROM runs"

_BOIL = f"""{_PAGES},
ln AS (SELECT page_id, doc_key, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM pg),
st AS (SELECT *, {_strip("raw")} AS line FROM ln),
np AS (SELECT doc_key, count(*) AS pages FROM pg GROUP BY doc_key),
bp AS (SELECT s.doc_key, s.line, count(DISTINCT s.page_id) AS n_pages FROM st s JOIN np USING (doc_key) WHERE s.line <> '' AND {_len("s.line")} <= 120 GROUP BY s.doc_key, s.line, np.pages HAVING np.pages >= 3 AND count(DISTINCT s.page_id) >= greatest(3.0::DOUBLE, np.pages * 0.8::DOUBLE)),
mf AS (SELECT st.doc_key, st.line, count(*) AS occurrences FROM st JOIN bp ON bp.doc_key = st.doc_key AND bp.line = st.line GROUP BY st.doc_key, st.line)"""

_Q = "(VALUES (1, 'northern harbour library'), (2, 'the signature of the contract'), (3, 'backup snapshot tokenizer'), (4, 'zzqqxx'), (5, 'pump pump valve')) v(q, question)"
_BM25 = f"""tk AS (SELECT chunk_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM chunks),
dl AS (SELECT doc, len(t) AS dl FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
po AS (SELECT doc, term, count(*) AS f FROM (SELECT doc, unnest(t) AS term FROM tk) GROUP BY doc, term),
i0 AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM po GROUP BY term),
id AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM i0) ELSE idf0 END AS idf FROM i0),
qt AS (SELECT q, term, count(*) AS m FROM (SELECT q::BIGINT AS q, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM {_Q}) GROUP BY q, term),
sc AS (SELECT qt.q, po.doc, sum(qt.m * id.idf * po.f * 2.5 / (po.f + 1.5 * (0.25 + 0.75 * dl.dl / (SELECT avgdl FROM st)))) AS s FROM qt JOIN po USING (term) JOIN id USING (term) JOIN dl ON dl.doc = po.doc GROUP BY qt.q, po.doc),
nm AS (SELECT q, doc, CASE WHEN max(s) OVER (PARTITION BY q) > 0 THEN s / max(s) OVER (PARTITION BY q) ELSE 0.0 END AS score FROM sc)"""
_VEC = """v AS (SELECT chunk_id AS doc, model, vector::DOUBLE[] AS x FROM chunk_embeddings WHERE (model = 'lattice-64' AND len(vector) = 64) OR (model = 'lattice-48' AND len(vector) = 48)),
q0 AS (SELECT * FROM (SELECT model, x AS y, row_number() OVER (PARTITION BY model ORDER BY doc) AS q FROM v) WHERE q <= 5),
cs AS (SELECT q, v.model, doc, CASE WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0.0 ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END AS cos FROM v JOIN q0 ON q0.model = v.model)"""

_EV = r"ev AS (SELECT seq, any_value(session_id) AS session_id, any_value(regexp_replace(lower(regexp_replace(bucket, '[\s_-]', '', 'g')), '^bash(test|git|infra)$', 'bash_\1')) AS bucket, any_value(tool_name) AS tool_name FROM activity_log GROUP BY seq), rc AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS recency FROM ev WHERE session_id IS NOT NULL), gl AS (SELECT seq, NULL::VARCHAR AS session_id, bucket, tool_name, row_number() OVER (ORDER BY seq DESC) AS recency FROM ev), rg AS (SELECT * FROM rc UNION ALL SELECT * FROM gl)"
_MODE = f"""{_EV}, c AS (SELECT session_id, count(*) AS n, count(*) FILTER (bucket = 'edit') AS e, count(*) FILTER (bucket = 'read') AS r, count(*) FILTER (bucket = 'bash_test') AS t, count(*) FILTER (bucket IN ('bash_git', 'bash_infra')) AS g FROM rg WHERE recency <= 10 GROUP BY session_id)
SELECT session_id, n, CASE WHEN t >= 2 AND e >= 1 THEN 'debug' WHEN e >= greatest(1, n // 3) THEN 'code' WHEN r >= greatest(1, floor(n * 0.6::DOUBLE)) AND e = 0 THEN 'review' WHEN g >= greatest(1, floor(n * 0.5::DOUBLE)) THEN 'infra' ELSE 'general' END AS mode FROM c"""
_RE = "r1 AS (SELECT id, any_value(session_id) AS session_id, any_value(content_hash) AS content_hash, any_value(seen_at) AS seen_at FROM session_reads GROUP BY id), rr AS (SELECT *, session_id IS NOT NULL AND row_number() OVER (PARTITION BY session_id, content_hash ORDER BY seen_at, id) > 1 AS reread FROM r1)"

_LINES = r"ls AS (SELECT doc_id, text, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a0 FROM documents WHERE text IS NOT NULL), la AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] WHEN a0[-1] = '' THEN a0[1:len(a0) - 1] ELSE a0 END AS a FROM ls)"
_RUNL = f"""{_LINES}, lx AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM la),
ch AS (SELECT *, CASE WHEN i = 0 OR line <> lag(line) OVER w THEN 1 ELSE 0 END AS c FROM lx WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
gr AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ch),
rn AS (SELECT doc_id, g, min(line) AS line, count(*) AS n FROM gr GROUP BY doc_id, g),
cl AS (SELECT la.doc_id, la.text, coalesce(flatten(list(CASE WHEN n > 1 THEN [line, '    (same line, ' || (n - 1) || ' times more)'] ELSE [line] END ORDER BY g) FILTER (rn.doc_id IS NOT NULL)), []) AS a FROM la LEFT JOIN rn ON rn.doc_id = la.doc_id GROUP BY la.doc_id, la.text)"""
_TRUNC = "array_to_string(CASE WHEN len(a) - 45 <= 0 THEN a ELSE a[1:40] || ['    (' || (len(a) - 45) || ' lines left out)'] || a[len(a) - 4:len(a)] END, chr(10))"
_GITRE = rf"regexp_matches(text, '(?m)^\?\?[{_WS}]|^[{_WS}]?[MADRCU][{_WS}]+[^{_WS}]') OR (contains(text, 'On branch ') AND regexp_matches(text, '(modified:|new file:|deleted:|Untracked files:|nothing to commit)'))"
_KIND = rf"CASE WHEN {_GITRE} THEN 'git-status' WHEN regexp_matches(text, '=+ (test session starts|FAILURES|short test summary)') OR regexp_matches(text, '(?m)^\d+ (passed|failed)') THEN 'pytest' WHEN regexp_matches(text, '(?m)^(Collecting|Downloading|Requirement already satisfied|added \d+ packages)') THEN 'install' ELSE 'generic' END"
_HUM = rf"^(modified|new file|deleted|renamed|copied|both modified):[{_WS}]+(.+)$"
_COD = rf"^([MADRCU?!]{{1,2}})[{_WS}]+(.+)$"
_GIT = rf"""{_LINES}, gs AS (SELECT doc_id, text, a FROM la WHERE {_GITRE}),
gx AS (SELECT doc_id, unnest(a) AS raw, unnest(range(len(a))) AS i FROM gs), gy AS (SELECT *, {_strip("raw")} AS s FROM gx),
gz AS (SELECT *, s = '' OR starts_with(s, '(') AS skip, regexp_matches(s, '{_HUM}') AS hum, regexp_matches(s, '{_COD}') AS cod FROM gy),
gh AS (SELECT *, CASE WHEN NOT skip AND NOT hum AND ends_with(s, ':') THEN CASE WHEN contains(lower(s), 'untracked') THEN 'untracked' WHEN contains(lower(s), 'unmerged') THEN 'unmerged' ELSE '-' END END AS head FROM gz),
gc AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sec FROM gh),
ge AS (SELECT doc_id, i, CASE WHEN skip THEN NULL WHEN hum THEN CASE regexp_extract(s, '{_HUM}', 1) WHEN 'new file' THEN 'added' WHEN 'both modified' THEN 'unmerged' ELSE regexp_extract(s, '{_HUM}', 1) END WHEN ends_with(s, ':') THEN NULL
  WHEN cod THEN CASE left(regexp_extract(s, '{_COD}', 1), 1) WHEN 'M' THEN 'modified' WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'copied' WHEN 'U' THEN 'unmerged' WHEN '?' THEN 'untracked' ELSE 'ignored' END
  WHEN regexp_matches(raw, '^[\t ]') AND sec <> '-' THEN sec END AS label,
  CASE WHEN hum THEN {_strip(f"regexp_extract(s, '{_HUM}', 2)")} WHEN cod THEN {_strip(f"regexp_extract(s, '{_COD}', 2)")} ELSE s END AS path FROM gc),
gl AS (SELECT doc_id, label, list(path ORDER BY i) AS p FROM ge WHERE label IS NOT NULL GROUP BY doc_id, label),
gt AS (SELECT doc_id, sum(len(p)) AS n, string_agg('  ' || label || ' (' || len(p) || '): ' || array_to_string(p[1:5], ', ') || CASE WHEN len(p) > 5 THEN ' and ' || (len(p) - 5) || ' others' ELSE '' END, chr(10) ORDER BY label) AS body FROM gl GROUP BY doc_id)
SELECT gs.doc_id, CASE WHEN gt.n IS NULL THEN gs.text ELSE CASE WHEN regexp_matches(text, '(?m)^(?:On branch |## )[^{_WS}]+') THEN 'branch ' || string_split(regexp_extract(text, '(?m)^(?:On branch |## )([^{_WS}]+)', 1), '...')[1] || '; ' ELSE '' END || gt.n::BIGINT || ' paths in all' || chr(10) || body END AS out FROM gs LEFT JOIN gt ON gt.doc_id = gs.doc_id"""
_TREE = r"""tr AS (SELECT chunk_id, substr(source_path, 2) || '.' || chunk_id || regexp_extract(source_path, '(\.[a-z]+)$', 1) AS path, text FROM chunks WHERE text IS NOT NULL
  UNION ALL SELECT NULL, CASE p_partkey % 6 WHEN 2 THEN 'odd/.pytest_cache/f' || p_partkey || '.txt' ELSE 'odd/f' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.db' WHEN 1 THEN '.bin' WHEN 3 THEN '.SQLITE3' WHEN 4 THEN '.mov' ELSE '.txt' END END, p_name FROM part),
tf AS (SELECT *, regexp_replace(text, '\r\n?', chr(10), 'g') AS body FROM tr)"""
_GIT_CTES, _GIT_LAST = _GIT[len(_LINES) + 2 :].rsplit("\nSELECT gs.doc_id", 1)
_GIT_LAST = "SELECT gs.doc_id" + _GIT_LAST
#: The kind of a file is told from its first 1,024 bytes, so a letter cut there makes it no text.
_CUT = "(octet_length(encode(text)) > 1024 AND hex(encode(text)[1025:1025]) BETWEEN '80' AND 'BF')"
_SUF = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"
_DIST = "('.jpg', '.jpeg', '.png', '.heic', '.heif', '.tiff', '.tif', '.bmp', '.webp', '.pdf')"
_EXCL = r"(regexp_matches(path, '(?:^|/)(\.git|\.venv|venv|__pycache__|node_modules|dist|build|[^/]*\.egg-info|\.pytest_cache)/') OR regexp_matches(path, '(?:^|/)[^/]*\.pyc(/|$)'))"
_NOTEXT = rf"({_CUT} OR {_SUF} IN ('.zip', '.tar', '.gz', '.exe', '.dll', '.so', '.dylib', '.bin', '.db', '.sqlite', '.sqlite3', '.mp4', '.mp3', '.mov', '.ico'))"
_PACK = rf"""{_TREE}, sel AS (SELECT * FROM tf WHERE NOT {_EXCL}),
pk AS (SELECT path, CASE WHEN {_SUF} IN {_DIST} THEN CASE WHEN chunk_id % 7 = 0 OR chunk_id % 5 = 0 THEN 'skip' ELSE 'distill' END WHEN {_NOTEXT} THEN 'skip' ELSE 'text' END AS route,
  CASE WHEN {_SUF} IN {_DIST} THEN CASE WHEN chunk_id % 7 = 0 THEN 'not distilled' WHEN chunk_id % 5 = 0 THEN 'not distilled: broken file' END WHEN {_NOTEXT} THEN 'no text' END AS reason,
  CASE WHEN {_SUF} IN {_DIST} THEN CASE WHEN chunk_id % 7 > 0 AND chunk_id % 5 > 0 THEN text || chr(10) || '(read)' END WHEN NOT {_NOTEXT} THEN body END AS text,
  CASE WHEN {_SUF} IN {_DIST} THEN CASE WHEN chunk_id % 7 = 0 OR chunk_id % 5 = 0 THEN 0 ELSE chunk_id % 100 END WHEN {_NOTEXT} THEN 0 ELSE {_tok('body')} END::BIGINT AS tokens FROM sel)"""
_MD = "'## ' || path || CASE WHEN route = 'distill' THEN ' (distilled)' ELSE '' END || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10)"
_XML = "'  <file path=\"' || replace(replace(replace(path, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') || '\"' || CASE WHEN route = 'distill' THEN ' distilled=\"true\"' ELSE '' END || '>' || chr(10) || '    <![CDATA[' || replace(text, ']]>', ']]]]><![CDATA[>') || ']]>' || chr(10) || '  </file>'"
_LOGS = """k AS (SELECT *, lpad(l_orderkey::VARCHAR, 12, '0') || '.' || l_linenumber AS k FROM lineitem),
fl AS (SELECT l_suppkey, count(*) AS n, list('  FAILED tests/part_' || l_partkey || ' - wrong' ORDER BY k, 'FAILED tests/part_' || l_partkey || ' - wrong') AS fl, list('  E   row ' || k ORDER BY k) AS e, list('ERROR: row ' || k ORDER BY k) FILTER (l_quantity > 30) AS er, count(*) FILTER (l_quantity <= 30) AS there FROM k GROUP BY l_suppkey)"""
_NOTES = """nt AS (SELECT 'memory/' || c_name || '.md' AS path, 'nothing' AS text, c_name AS stem FROM customer UNION ALL SELECT 'memory/' || s_name || '.md', '', s_name FROM supplier
  UNION ALL SELECT 'memory/' || n_name || '.md', 'about ' || n_name || ' and xSupplier#' || lpad((n_nationkey + 1)::VARCHAR, 9, '0') || 'x', n_name FROM nation)"""
_DUPL = f"p AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p, unnest(range(len(string_split(coalesce(text, ''), chr(10) || chr(10))))) AS i FROM documents), n AS (SELECT path, i, {_norm('p')} AS norm FROM p), h AS (SELECT sha1(norm) AS hash, path, i, path || ': ' || regexp_extract(norm, '(?s)^.{{0,60}}') || '...' AS place FROM n WHERE {_len('norm')} >= 40)"
_ORPHANS = "SELECT path FROM nt WHERE NOT EXISTS (SELECT 1 FROM ot WHERE ot.path <> nt.path AND contains(ot.text, nt.stem))"


_HEAD6 = "regexp_extract({x}, '(?s)^.{{{{0,1000}}}}.{{{{0,1000}}}}.{{{{0,1000}}}}.{{{{0,1000}}}}.{{{{0,1000}}}}.{{{{0,1000}}}}')".replace("{{{{", "{").replace("}}}}", "}")


def _told(head: str, text: str, hint: str, reread: str) -> tuple[str, str]:
    """Branch and text of an answered read."""
    nl = "chr(10) || chr(10)"
    large = f"{_tok(text)} > 8000"
    cut = _HEAD6.replace("{x}", text)
    return (
        f"CASE WHEN {reread} THEN 'again' WHEN {large} THEN 'large' ELSE 'whole' END",
        f"CASE WHEN {reread} THEN {head} || {nl} || 'This session has read the same content before; it is left out here. ' || {hint} WHEN {large} THEN {head} || {nl} || 'A long document, of which the first 1500 tokens or so follow; the rest is kept. ' || {hint} || {nl} || {cut} || {nl} || '[cut here] ' || {hint} ELSE {head} || {nl} || {text} END",
    )


_BRANCH, _BODY = _told("head", "shown", "hint", "reread")
_DECIDED = f"""WITH {_DOCS}, b AS (SELECT d.*, x.id AS handle, x.source_path, from_json(x.boilerplate_json, '[{{"line":"VARCHAR","occurrences":"INTEGER"}}]') AS bp FROM d JOIN distillations x ON x.content_hash = d.doc_key),
s AS (SELECT *, CASE WHEN len(bp) > 0 THEN '[ctxlake] lines of most pages, given here once:' || chr(10) || array_to_string(list_transform(bp, lambda e: '  (' || e.occurrences || 'x) ' || e.line), chr(10)) || chr(10) || chr(10) || text ELSE text END AS shown,
  '[ctxlake] ' || source_path || ': ' || raw_tokens || ' -> ' || distilled_tokens || ' tokens (' || printf('%.1f', ratio) || 'x); pages by method: ' || concat_ws(', ', CASE WHEN pages_native > 0 THEN 'native_text ' || pages_native END, CASE WHEN pages_ocr > pages_degraded THEN 'ocr ' || (pages_ocr - pages_degraded) END, CASE WHEN pages_degraded > 0 THEN 'ocr_degraded ' || pages_degraded END, CASE WHEN pages_vision > 0 THEN 'vision ' || pages_vision END) || '.'
    || CASE WHEN figures_note IS NULL THEN '' ELSE ' Figures: ' || figures_note || '.' END || CASE WHEN uncaptured_note IS NULL THEN '' ELSE ' Missing: ' || uncaptured_note || '.' END AS head, 'All of it: expand ' || handle || '.' AS hint FROM b),
r1 AS (SELECT id, any_value(session_id) AS session_id, any_value(content_hash) AS content_hash, any_value(seen_at) AS seen_at FROM session_reads GROUP BY id),
g AS (SELECT r1.*, CASE WHEN id % 11 = 0 OR content_hash IS NULL THEN 'suffix' WHEN id % 7 = 0 THEN 'range' WHEN content_hash NOT IN (SELECT doc_key FROM s) THEN 'failed' END AS gate FROM r1),
rr AS (SELECT *, gate IS NULL AND session_id IS NOT NULL AND row_number() OVER (PARTITION BY session_id, content_hash, gate IS NULL ORDER BY seen_at, id) > 1 AS reread FROM g),
o AS (SELECT rr.id, gate, {_BRANCH} AS branch, {_BODY} AS body FROM rr LEFT JOIN s ON s.doc_key = rr.content_hash)"""


#: Pages of the made files: their stripped lines, and what distilling makes of them.
_FILES = rf"""f AS (SELECT doc_id, doc_id % 10 AS kind, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.,]+', ' ', 'g')) AS t, '/in/' || doc_id || CASE doc_id % 10 WHEN 0 THEN '.PNG' WHEN 2 THEN '.gif' ELSE '.pdf' END AS path, sha256(doc_id::VARCHAR) AS h FROM documents),
pp AS (SELECT *, unnest(range(greatest(1, ceil(length(t) / 300.0)::BIGINT)))::INTEGER AS page_index FROM f WHERE kind NOT IN (0, 1, 2)),
pt AS (SELECT *, {_strip("array_to_string(list_filter([substr(t, page_index * 300 + 1, 100), substr(t, page_index * 300 + 101, 100), substr(t, page_index * 300 + 201, 100)], lambda x: x <> ''), chr(10))")} AS text, CASE WHEN (doc_id + page_index) % 3 = 0 THEN 1 ELSE 0 END AS image FROM pp),
rp AS (SELECT h, path, page_index, 'native_text' AS method, text, NULL::DOUBLE AS ocr_confidence, NULL::INTEGER AS ocr_word_count, 2534 + {_tok("text")} AS raw, '' AS warnings, image AS image_count, CASE WHEN image = 1 THEN 'figure 833 1700 1055 1922' ELSE '' END AS figures, NULL AS error FROM pt WHERE length(text) >= 20
  UNION ALL SELECT h, path, page_index, CASE WHEN page_index % 2 = 0 THEN 'vision' ELSE 'ocr_degraded' END, CASE WHEN page_index % 2 = 0 THEN 'seen page ' || page_index ELSE 'page ' || page_index || ' again' END, 60.0, 3, 2534, CASE WHEN page_index % 2 = 0 THEN '' ELSE 'low confidence and no vision service' END, 0, '', NULL FROM pt WHERE length(text) < 20
  UNION ALL SELECT h, path, 0, 'ocr', {_strip("substr('image of ' || t, 1, 40)")}, 95.0, 9, 2534, '', 0, '', NULL FROM f WHERE kind = 0
  UNION ALL SELECT h, path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError' FROM f WHERE kind IN (1, 2)),
rt AS (SELECT *, {_tok("text")} + CASE WHEN figures = '' THEN 0 ELSE {_tok("figures")} END AS distilled, ascii(h[1]) % 2 = 0 AND ascii(h[2]) % 2 = 1 AND error IS NULL AS cached FROM rp)"""
_CALLS = "ev AS (SELECT *, seq % 10 = 0 AS broken FROM activity_log), tc AS (SELECT CASE WHEN NOT broken THEN session_id END AS session_id, CASE WHEN NOT broken THEN tool_name END AS tool_name, CASE WHEN NOT broken THEN '/f/' || seq || '.md' END AS file_path, CASE WHEN NOT broken AND seq % 3 = 0 THEN seq % 50 END::INTEGER AS \"offset\" FROM ev) SELECT *, CASE WHEN tool_name IN ('Edit', 'Write', 'NotebookEdit') THEN 'edit' WHEN tool_name IN ('Read', 'Glob', 'Grep') THEN 'read' WHEN tool_name = 'Bash' THEN 'bash_test' WHEN tool_name IN ('WebFetch', 'WebSearch') THEN 'web' ELSE 'other' END AS bucket FROM tc"
#: Chunks: paragraphs are packed while they fit, longer ones cut between words, both by recursion; the tails come last.
_CHUNKS = rf"""WITH RECURSIVE pa AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS j FROM documents WHERE text IS NOT NULL),
pb AS MATERIALIZED (SELECT doc_id, p, {_len("p")} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM pa WHERE {_strip("p")} <> ''),
pk AS (SELECT doc_id, i, 1 AS g, n AS held, n > 2000 AS long FROM pb WHERE i = 1
  UNION ALL SELECT b.doc_id, b.i, CASE WHEN pk.long OR b.n > 2000 OR pk.held + 2 + b.n > 2000 THEN g + 1 ELSE g END, CASE WHEN pk.long OR b.n > 2000 OR pk.held + 2 + b.n > 2000 THEN b.n ELSE pk.held + 2 + b.n END, b.n > 2000 FROM pk JOIN pb b ON b.doc_id = pk.doc_id AND b.i = pk.i + 1),
wl AS MATERIALIZED (SELECT doc_id, g, i, list_filter(string_split_regex(p, '[{_WS}]+'), lambda x: x <> '') AS w FROM pk JOIN pb USING (doc_id, i) WHERE long),
we AS MATERIALIZED (SELECT *, list_prepend(0, list_transform(range(1, len(w) + 1), lambda k: list_sum(list_transform(w[1:k], lambda x: {_len("x")} + 1))::BIGINT)) AS e FROM wl),
ct AS (SELECT doc_id, g, 0 AS c, 0::BIGINT AS lo, greatest(1, len(list_filter(e[2:], lambda x: x <= 2000))) AS k FROM we
  UNION ALL SELECT z.doc_id, z.g, z.c + 1, z.nlo, greatest(z.nlo + 1, z.nlo + len(list_filter(z.e[z.nlo + 2:], lambda x: x - z.e[z.nlo + 1] <= 2000))) FROM
    (SELECT ct.doc_id, ct.g, ct.c, we.e, we.w, ct.k, ct.k - len(list_filter(we.e[ct.lo + 1:ct.k], lambda x: we.e[ct.k + 1] - x <= 200)) AS nlo FROM ct JOIN we ON we.doc_id = ct.doc_id AND we.g = ct.g WHERE ct.k < len(we.w)) z),
ba AS (SELECT doc_id, g, 0 AS c, {_strip("string_agg(p, chr(10) || chr(10) ORDER BY i)")} AS t FROM pk JOIN pb USING (doc_id, i) WHERE NOT long GROUP BY doc_id, g
  UNION ALL SELECT ct.doc_id, ct.g, ct.c, array_to_string(we.w[ct.lo + 1:ct.k], ' ') FROM ct JOIN we ON we.doc_id = ct.doc_id AND we.g = ct.g),
nb AS (SELECT *, (row_number() OVER o - 1)::INTEGER AS chunk_index, lag(t) OVER o AS before FROM ba WINDOW o AS (PARTITION BY doc_id ORDER BY g, c)),
oc AS (SELECT doc_id, chunk_index, CASE WHEN before IS NULL THEN t ELSE regexp_extract(before, '(?s).{{0,200}}$') || chr(10) || chr(10) || t END AS text FROM nb)
SELECT doc_id, chunk_index, text, {_tok("text")} AS token_count FROM oc"""


def oracle_sql() -> dict[str, str]:
    box = "SELECT l_orderkey, l_linenumber, (l_suppkey % 600)::DOUBLE AS x0, (l_partkey % 700)::DOUBLE AS y0, l_suppkey % 600 + l_quantity * 3 AS x1, l_partkey % 700 + l_linenumber * 20.0::DOUBLE AS y1 FROM lineitem"
    hold = lambda v, m: f"least(greatest(trunc({v})::BIGINT, 0), {m})"
    k = "(150.0::DOUBLE / 72.0::DOUBLE)"
    pw, ph = "greatest(1.0, round_even((page_id % 700 + 300)::DOUBLE * 150.0 / 72.0, 0))", "greatest(1.0, round_even((page_id % 500 + 400.5)::DOUBLE * 150.0 / 72.0, 0))"
    return {
        "chunk_text": _CHUNKS,
        "index_tree": f"WITH RECURSIVE {_PACK}, " + _CHUNKS[len("WITH RECURSIVE ") :].replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT path AS doc_id, text FROM pk WHERE route <> 'skip')").replace("SELECT doc_id, chunk_index, text, ", "SELECT doc_id AS source_path, chunk_index, sha256(text) AS sha, ").replace("pk AS (SELECT doc_id, i, 1", "gr AS (SELECT doc_id, i, 1").replace("pk.", "gr.").replace("FROM pk JOIN", "FROM gr JOIN"),
        "runs_of_misses": f"WITH {_FILES} SELECT h AS doc_key, path AS source_path, 'read' AS trigger, CASE WHEN max(error) IS NULL THEN count(*) END AS page_count, CASE WHEN max(error) IS NULL THEN count(*) FILTER (method = 'native_text') END AS pages_native, CASE WHEN max(error) IS NULL THEN count(*) FILTER (method IN ('ocr', 'ocr_degraded')) END AS pages_ocr, CASE WHEN max(error) IS NULL THEN count(*) FILTER (method = 'vision') END AS pages_vision, CASE WHEN max(error) IS NULL THEN 'ok' ELSE 'error' END AS status, max(error) AS error FROM rt WHERE NOT cached GROUP BY h, path",
        "file_results": f"WITH {_FILES} SELECT path, bool_and(cached) AS cached, CASE WHEN max(error) IS NULL THEN count(*) END AS page_count, CASE WHEN max(error) IS NULL THEN count(*) FILTER (figures <> '') END AS figures, max(error) AS error FROM rt GROUP BY path",
        "pdf_pages": f"""WITH {_FILES} SELECT path, page_index, sha256(text) AS sha, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, CASE WHEN image = 1 THEN '[{{"x0":300.0,"y0":100.0,"x1":380.0,"y1":180.0}}]' ELSE '[]' END AS boxes, NULL::VARCHAR AS error FROM pt
            UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, 'ValueError' FROM f WHERE kind = 1""",
        "loaded_images": "SELECT '/im/' || p_partkey || '.ppm' AS path, CASE WHEN p_partkey % 9 > 0 THEN 2 * (p_size % 6 + 1) END::INTEGER AS width, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 5 + 1 END::INTEGER AS height, CASE WHEN p_partkey % 9 > 0 THEN sha256(repeat(repeat('!', 3 * (p_size % 6 + 1)::BIGINT) || repeat('z', 3 * (p_size % 6 + 1)::BIGINT), (p_partkey % 5 + 1)::BIGINT)) END AS sha, CASE WHEN p_partkey % 9 = 0 THEN 'ValueError' END AS error FROM part",
        "prepared_images": "SELECT '/im/' || p_partkey || '.ppm' AS path, (4 * (p_size % 6 + 1))::INTEGER AS width, (2 * (p_partkey % 5 + 1))::INTEGER AS height, sha256(unhex(repeat(repeat('00', 2 * (p_size % 6 + 1)::BIGINT) || repeat('FF', 2 * (p_size % 6 + 1)::BIGINT), 2 * (p_partkey % 5 + 1)::BIGINT))) AS sha FROM part WHERE p_partkey % 9 > 0",
        "read_pages": f"WITH {_FILES} SELECT path, page_index, method, sha256(text) AS sha, ocr_confidence, ocr_word_count, raw::INTEGER AS raw_tokens_est, CASE WHEN error IS NULL THEN distilled END::INTEGER AS distilled_tokens_est, warnings, image_count::INTEGER AS image_count, figures, error FROM rt",
        "distill_cached": f"WITH {_FILES} SELECT path, page_index, cached, sha256(text) AS sha, CASE WHEN error IS NULL THEN distilled ELSE 0 END::INTEGER AS distilled_tokens_est FROM rt",
        "scan_totals": f"WITH {_FILES} SELECT count(DISTINCT h) FILTER (error IS NULL) AS ok, count(DISTINCT h) FILTER (error IS NOT NULL) AS failed, sum(raw)::BIGINT AS raw_tokens, sum(CASE WHEN error IS NULL THEN distilled ELSE 0 END)::BIGINT AS distilled_tokens FROM rt",
        "tool_events": f"WITH {_CALLS}",
        "stream_tool_events": f"WITH {_CALLS}",
        "text_tokens": f"SELECT doc_id, {_tok('text')} AS tokens FROM documents",
        "image_tokens": f"SELECT p_partkey, {_img('(p_size * 97 - 60)', '(p_partkey % 3000 - 2)')} AS tokens FROM part",
        "downscaled": "SELECT p_partkey, " + ", ".join(f"(CASE WHEN greatest(p_size * 97, p_partkey % 3000 + 1) <= 1568 THEN {x} ELSE greatest(1.0, round_even(({x})::DOUBLE * (1568.0::DOUBLE / greatest(p_size * 97, p_partkey % 3000 + 1)), 0)) END)::BIGINT AS {n}" for x, n in (("p_size * 97", "w"), ("p_partkey % 3000 + 1", "h"))) + " FROM part",
        "page_host_tokens": f"WITH {_PAGES} SELECT page_id, {_img(pw, ph)} + {_tok('text')} AS tokens FROM pg",
        "figure_boxes": f"SELECT l_orderkey, l_linenumber, CASE WHEN x1 - x0 >= 48 AND y1 - y0 >= 48 THEN 1 ELSE 0 END::INTEGER AS kept FROM ({box})",
        "crop_geometry": f"WITH b AS ({box}), c AS (SELECT l_orderkey, l_linenumber, {hold(f'x0 * {k}', 1275)} AS l, {hold(f'x1 * {k}', 1275)} AS r, {hold(f'(792.0 - y1) * {k}', 1650)} AS t, {hold(f'(792.0 - y0) * {k}', 1650)} AS m FROM b) SELECT l_orderkey, l_linenumber, CASE WHEN r <= l OR m <= t THEN 0 ELSE l END AS \"left\", CASE WHEN r <= l OR m <= t THEN 0 ELSE t END AS top, CASE WHEN r <= l OR m <= t THEN 1275 ELSE r END AS \"right\", CASE WHEN r <= l OR m <= t THEN 1650 ELSE m END AS bottom FROM c",
        "otsu_threshold": """WITH h AS (SELECT p_brand, p_size * 5 % 256 AS l, count(*)::DOUBLE AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, sum(n) AS tot, sum(n * l) AS mass FROM h GROUP BY p_brand),
            f AS (SELECT t.p_brand, tot, mass, r.l, coalesce(h.n, 0) AS n FROM t CROSS JOIN (SELECT unnest(range(256)) AS l) r LEFT JOIN h ON h.p_brand = t.p_brand AND h.l = r.l),
            c AS (SELECT *, sum(n) OVER w AS w0, sum(n * l) OVER w AS s0 FROM f WINDOW w AS (PARTITION BY p_brand ORDER BY l ROWS UNBOUNDED PRECEDING)),
            v AS (SELECT p_brand, l, w0 * (tot - w0) * (s0 / w0 - (mass - s0) / (tot - w0)) * (s0 / w0 - (mass - s0) / (tot - w0)) AS x FROM c WHERE w0 > 0 AND tot - w0 > 0), m AS (SELECT *, max(x) OVER (PARTITION BY p_brand) AS b FROM v),
            z AS (SELECT p_brand, (min(l) + max(l)) // 2 AS th FROM m WHERE x = b AND x > 0 GROUP BY p_brand) SELECT t.p_brand, coalesce(z.th, 128)::INTEGER AS threshold FROM t LEFT JOIN z ON z.p_brand = t.p_brand""",
        "doc_compression": f"WITH {_DOCS} SELECT doc_key, page_count, raw_tokens, distilled_tokens, round(ratio, 6) AS ratio FROM d",
        "method_counts": f"WITH {_PAGES} SELECT doc_key, method, count(*) AS n FROM pg GROUP BY doc_key, method",
        "mean_confidence": f"WITH {_DOCS} SELECT doc_key, round(mean_confidence, 4) AS mean_confidence FROM d",
        "doc_text": f"WITH {_DOCS} SELECT doc_key, text FROM d",
        "doc_notes": f"WITH {_DOCS} SELECT doc_key, figure_count, figures_note, uncaptured_note, warnings FROM d",
        "native_pages": f"WITH {_PAGES} SELECT page_id FROM pg WHERE {_len('text')} >= 20",
        "uncaptured_pages": f"WITH {_PAGES} SELECT doc_key, page_index FROM pg WHERE method = 'native_text' AND image_count > 0 AND coalesce(len(figures), 0) = 0",
        "ocr_route": f"WITH {_PAGES} SELECT page_id, CASE WHEN NOT (coalesce(ocr_confidence, 0) < 70 OR coalesce(ocr_word_count, 0) < 5) OR page_id % 3 = 0 THEN 'ocr' WHEN page_id % 2 = 0 AND text IS NOT NULL THEN 'vision' ELSE 'ocr_degraded' END AS route, NOT (ocr_confidence >= 80 AND ocr_word_count >= 3) AS retry FROM pg WHERE (ocr_confidence >= 80 AND ocr_word_count >= 3) IS NOT NULL",
        "ocr_best_of_two": f"WITH {_PAGES} SELECT page_id, CASE WHEN distilled_tokens_est % 200 > ocr_word_count OR (distilled_tokens_est % 200 = ocr_word_count AND 75.0 > ocr_confidence) THEN 'retry' ELSE 'raw' END AS kept FROM pg WHERE ocr_word_count IS NOT NULL AND ocr_confidence IS NOT NULL",
        "page_recount": f"WITH {_PAGES}, f AS (SELECT page_id, sum({_tok('x')}) AS n FROM (SELECT page_id, unnest(figures) AS x FROM pg) GROUP BY page_id) SELECT pg.page_id, ({_tok('text')} + coalesce(f.n, 0))::INTEGER AS distilled_tokens_est FROM pg LEFT JOIN f ON f.page_id = pg.page_id",
        "run_log": f"WITH {_RUNS} SELECT ts, doc_key, r.source_path, r.source_type, r.duration_ms, 'scan' AS trigger, page_count, pages_native, pages_ocr, pages_vision, round(mean_confidence, 4) AS mean_confidence, CASE WHEN pages_vision > 0 THEN 'vision' WHEN pages_ocr > 0 THEN 'ocr' ELSE 'native_text' END AS method, raw_tokens, distilled_tokens, 'code points / 4, images by area' AS estimate, round(ratio, 4) AS ratio, pages_vision AS vision_calls, 'ok' AS status FROM runs r",
        "runs_recent": f"WITH {_RUNS} SELECT ts, doc_key, source_path, CASE WHEN pages_vision > 0 THEN 'vision' WHEN pages_ocr > 0 THEN 'ocr' ELSE 'native_text' END AS method, round(ratio, 4) AS ratio FROM runs WHERE ts >= TIMESTAMP '2009-03-04' ORDER BY ts DESC, doc_key DESC LIMIT 50",
        "result_json": f"WITH {_RUNS} SELECT doc_key, 'source_path,source_type,page_count,method_counts,raw_tokens_est,distilled_tokens_est,compression_ratio,duration_ms,warnings,pages_with_uncaptured_images,pages_with_described_figures,figure_count,text' AS keys, page_count, nullif(pages_native, 0) AS native, nullif(pages_degraded, 0) AS degraded, round(ratio, 2) AS ratio, figure_count AS figures, sha256(text) AS sha FROM runs",
        "words_read": "WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'w' || l_partkey END AS t, CASE WHEN l_partkey % 5 = 0 OR l_partkey % 7 = 0 THEN -1 ELSE l_partkey % 100 END AS c FROM lineitem) SELECT l_orderkey, coalesce(string_agg(t, ' ' ORDER BY l_linenumber, ' ' || t || ' ') FILTER (t <> '' AND c >= 0), '') AS text, round(coalesce(avg(c) FILTER (t <> '' AND c >= 0), 0.0), 6) AS confidence, (count(*) FILTER (t <> '' AND c >= 0))::INTEGER AS words FROM w GROUP BY l_orderkey",
        "savings_report": f"WITH {_RUNS} {_SAVED}",
        "savings_since": f"WITH {_RUNS} {_SAVED} WHERE ts >= TIMESTAMP '2009-03-04'",
        "boilerplate_lines": f"WITH {_BOIL} SELECT doc_key, line, n_pages FROM bp",
        "boilerplate_strip": f"WITH {_BOIL}, kp AS (SELECT st.page_id, string_agg(st.raw, chr(10) ORDER BY st.i) AS t FROM st LEFT JOIN bp ON bp.doc_key = st.doc_key AND bp.line = st.line WHERE bp.line IS NULL GROUP BY st.page_id) SELECT pg.page_id, CASE WHEN pg.doc_key IN (SELECT doc_key FROM bp) THEN {_strip('coalesce(kp.t, chr(32))')} ELSE pg.text END AS text FROM pg LEFT JOIN kp ON kp.page_id = pg.page_id",
        "boilerplate_manifest": f"WITH {_BOIL} SELECT doc_key, line, occurrences FROM mf",
        "boilerplate_rendered": f"WITH {_DOCS}, {_BOIL.split('AS (', 1)[1].split('WHERE rn = 1),', 1)[1]}, m AS (SELECT doc_key, '[ctxlake] lines of most pages, given here once:' || chr(10) || string_agg('  (' || occurrences || 'x) ' || line, chr(10) ORDER BY line) AS man FROM mf GROUP BY doc_key) SELECT d.doc_key, sha256(CASE WHEN man IS NULL THEN d.text ELSE man || chr(10) || chr(10) || d.text END) AS sha FROM d LEFT JOIN m ON m.doc_key = d.doc_key",
        "boilerplate_tally": f"WITH {_BOIL} SELECT doc_key, count(*) AS n_lines, sum(occurrences)::BIGINT AS n_occurrences FROM mf GROUP BY doc_key",
        "index_postings": f"WITH {_BM25} SELECT po.doc, dl.dl, term, f FROM po JOIN dl ON dl.doc = po.doc",
        "term_stats": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM id",
        "bm25_scores": f"WITH {_BM25} SELECT q, doc, round(score, 6) AS score FROM nm",
        "bm25_topk": f"WITH {_BM25}, al AS (SELECT q0.q::BIGINT AS q, dl.doc, coalesce(nm.score, 0.0) AS score FROM (SELECT q FROM {_Q}) q0 CROSS JOIN dl LEFT JOIN nm ON nm.q = q0.q AND nm.doc = dl.doc), rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM al) SELECT q, doc, round(score, 4) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= 5",
        "index_totals": f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st",
        "cosine_topk": f"WITH {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY q, model ORDER BY round(cos, 4) DESC, doc) AS rank FROM cs) SELECT q, model, doc, round(cos, 4) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10",
        "search_answers": f"WITH {_BM25}, al AS (SELECT q0.q::BIGINT AS q, dl.doc, coalesce(nm.score, 0.0) AS score FROM (SELECT q FROM {_Q}) q0 CROSS JOIN dl LEFT JOIN nm ON nm.q = q0.q AND nm.doc = dl.doc), rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM al) SELECT q, doc, round(score, 4) AS score, rank::INTEGER AS rank, source_path, chunk_index, {_strip("regexp_extract(text, '(?s)^.{0,300}')")} || CASE WHEN {_len('text')} > 300 THEN '...' ELSE '' END AS preview FROM rk JOIN chunks ON chunk_id = doc WHERE rank <= 5",
        "hybrid_topk": f"WITH {_BM25}, {_VEC}, al AS (SELECT q0.q::BIGINT AS q, dl.doc, CASE WHEN cos IS NULL THEN coalesce(score, 0) ELSE 0.5 * coalesce(score, 0) + 0.5 * cos END AS score FROM (SELECT q FROM {_Q}) q0 CROSS JOIN dl LEFT JOIN nm ON nm.doc = dl.doc AND nm.q = q0.q LEFT JOIN cs ON cs.doc = dl.doc AND cs.q = q0.q), rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM al) SELECT q, doc, round(score, 4) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= 10",
        "reindex_replace": f"WITH n AS (SELECT * FROM chunks WHERE source_path LIKE '%7.pdf' AND chunk_index = 0) SELECT chunk_id, source_path, chunk_index, {_tok('text')} AS tokens FROM chunks WHERE source_path IS NULL OR source_path NOT IN (SELECT source_path FROM n) UNION ALL SELECT chunk_id + 100000000, source_path, chunk_index, {_tok("(text || ' (new)')")} FROM n",
        "vectors_left": "WITH n AS (SELECT source_path FROM chunks WHERE source_path LIKE '%7.pdf' AND chunk_index = 0) SELECT e.chunk_id, e.model FROM chunk_embeddings e JOIN chunks c USING (chunk_id) WHERE c.source_path NOT IN (SELECT source_path FROM n)",
        "compress_kind": f"SELECT doc_id, {_KIND} AS kind FROM documents WHERE text IS NOT NULL",
        "compress_repeats": f"WITH {_RUNL} SELECT doc_id, array_to_string(a, chr(10)) AS out FROM cl",
        "compress_truncate": f"WITH {_LINES} SELECT doc_id, {_TRUNC} AS out FROM la",
        "compress_generic": f"WITH {_RUNL}, g AS (SELECT doc_id, text, {_TRUNC} AS out FROM cl) SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^{_WS}]') THEN text WHEN {_len('out')} < {_len('text')} THEN out ELSE text END AS out FROM g",
        "compress_git_status": f"WITH {_GIT}",
        "compress_pytest": f"WITH {_LOGS} SELECT l_suppkey, n || ' tests failed:' || chr(10) || array_to_string(fl[1:20], chr(10)) || CASE WHEN n > 20 THEN chr(10) || '  and ' || (n - 20) || ' others' ELSE '' END || chr(10) || 'the first one:' || chr(10) || array_to_string(e[1:8], chr(10)) || chr(10) || n || ' failed, 3 passed in 0.12s' AS out FROM fl",
        "compress_install": f"WITH {_LOGS} SELECT l_suppkey, 'packages: ' || n || CASE WHEN there > 0 THEN chr(10) || 'already there: ' || there ELSE '' END || CASE WHEN len(er) > 0 THEN chr(10) || array_to_string(er[1:10], chr(10)) ELSE '' END || chr(10) || 'Successfully installed pkg' AS out FROM fl",
        "compress_stats": f"WITH {_RUNL}, g AS (SELECT doc_id, text, {_TRUNC} AS out FROM cl), h AS (SELECT doc_id, text, CASE WHEN NOT regexp_matches(text, '[^{_WS}]') THEN text WHEN {_len('out')} < {_len('text')} THEN out ELSE text END AS out FROM g) SELECT doc_id, {_tok('text')} AS before, {_tok('out')} AS after, CASE WHEN {_tok('text')} > 0 THEN round_even((1 - {_tok('out')} / ({_tok('text')})::DOUBLE) * 100, 0) ELSE 0 END::INTEGER AS saved FROM h",
        "compress_auto": f"""WITH {_RUNL}, gn AS (SELECT doc_id, text, {_TRUNC} AS out FROM cl), {_GIT_CTES}, gi AS ({_GIT_LAST}), un AS (SELECT gn.doc_id, gn.text, coalesce(gi.out, gn.out) AS out FROM gn LEFT JOIN gi ON gi.doc_id = gn.doc_id)
            SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^{_WS}]') THEN text WHEN {_len('out')} < {_len('text')} THEN out ELSE text END AS out FROM un""",
        "activity_buckets": f"WITH {_EV}, c AS (SELECT seq, tool_name, CASE seq % 3 WHEN 0 THEN 'git push' WHEN 1 THEN 'run pytest -q' ELSE '' END AS c FROM ev) SELECT seq, CASE WHEN tool_name IN ('Edit', 'Write', 'NotebookEdit') THEN 'edit' WHEN tool_name IN ('Read', 'Glob', 'Grep') THEN 'read' WHEN tool_name = 'Bash' THEN CASE WHEN contains(c, 'pytest') THEN 'bash_test' WHEN starts_with(c, 'git ') THEN 'bash_git' ELSE 'bash_infra' END WHEN tool_name IN ('WebFetch', 'WebSearch') THEN 'web' ELSE 'other' END AS bucket FROM c",
        "activity_window": f"WITH {_EV} SELECT session_id, seq, recency::INTEGER AS recency FROM rg WHERE recency <= 10",
        "activity_counts": f"WITH {_EV} SELECT session_id, bucket, count(*) AS n FROM rg WHERE recency <= 10 GROUP BY session_id, bucket",
        "activity_mode": f"WITH {_MODE}",
        "stream_activity_mode": f"SELECT * FROM (WITH {_MODE}) WHERE session_id IS NOT NULL",
        "activity_retention": f"WITH {_EV} SELECT seq FROM ev ORDER BY seq DESC LIMIT 500",
        "activity_recorded": f"WITH {_EV}, top AS (SELECT max(seq) AS m FROM ev), nw AS (SELECT session_id, seen_at AS ts, CASE WHEN id % 2 = 0 THEN 'Read' ELSE 'Bash' END AS tool_name, CASE WHEN id % 3 = 0 THEN 'go test ./...' END AS command FROM session_reads ORDER BY 2 DESC NULLS LAST, 3 DESC, 1 DESC NULLS LAST, 4 DESC NULLS LAST LIMIT 500), nn AS (SELECT row_number() OVER (ORDER BY ts NULLS FIRST, tool_name, session_id NULLS FIRST, command NULLS FIRST) + (SELECT m FROM top) + (SELECT greatest(count(*) - 500, 0) FROM session_reads) AS seq, session_id, tool_name, CASE WHEN tool_name = 'Read' THEN 'read' WHEN command IS NULL THEN 'bash_infra' ELSE 'bash_test' END AS bucket FROM nw) SELECT * FROM (SELECT seq, session_id, tool_name, bucket FROM ev UNION ALL SELECT * FROM nn) ORDER BY seq DESC LIMIT 500",
        "stream_activity_recorded": f"WITH {_EV}, top AS (SELECT max(seq) AS m FROM ev), nw AS (SELECT session_id, seen_at AS ts, CASE WHEN id % 2 = 0 THEN 'Read' ELSE 'Bash' END AS tool_name, CASE WHEN id % 3 = 0 THEN 'go test ./...' END AS command FROM session_reads ORDER BY 2 DESC NULLS LAST, 3 DESC, 1 DESC NULLS LAST, 4 DESC NULLS LAST LIMIT 500), nn AS (SELECT row_number() OVER (ORDER BY ts NULLS FIRST, tool_name, session_id NULLS FIRST, command NULLS FIRST) + (SELECT m FROM top) + (SELECT greatest(count(*) - 500, 0) FROM session_reads) AS seq, session_id, tool_name, CASE WHEN tool_name = 'Read' THEN 'read' WHEN command IS NULL THEN 'bash_infra' ELSE 'bash_test' END AS bucket FROM nw) SELECT * FROM (SELECT seq, session_id, tool_name, bucket FROM ev UNION ALL SELECT * FROM nn) ORDER BY seq DESC LIMIT 500",
        "read_gate": f"SELECT chunk_id, lower(regexp_extract(source_path, '(\\.[^./]+)$', 1)) IN {_DIST} AND CASE WHEN chunk_id % 4 = 0 THEN chunk_index END IS NULL AS answered FROM chunks",
        "rereads": f"WITH {_RE} SELECT id, reread FROM rr",
        "stream_rereads": f"WITH {_RE} SELECT id, reread FROM rr WHERE session_id IS NOT NULL AND seen_at IS NOT NULL",
        "read_response": f"{_DECIDED} SELECT id, branch, sha256(body) AS sha FROM o WHERE gate IS NULL",
        "read_decision": f"{_DECIDED} SELECT id, CASE WHEN gate IS NULL THEN 'deny' ELSE 'pass' END AS decision, coalesce(gate, branch) AS branch, CASE WHEN gate IS NULL THEN sha256(body) END AS sha FROM o",
        "stream_read_decision": f"{_DECIDED} SELECT id, CASE WHEN gate IS NULL THEN 'deny' ELSE 'pass' END AS decision, coalesce(gate, branch) AS branch, CASE WHEN gate IS NULL THEN sha256(body) END AS sha FROM o",
        "expand": f"{_DECIDED}, h AS (SELECT id + CASE WHEN id % 2 = 0 THEN 10000000 ELSE 0 END AS handle FROM distillations WHERE id % 3 = 0) SELECT h.handle, s.shown IS NOT NULL AS found, sha256(s.shown) AS sha FROM h LEFT JOIN s ON s.handle = h.handle",
        "cache_entry": "SELECT id, source_path, content_hash FROM distillations WHERE id = 7",
        "response_json": """SELECT n_nationkey, '{"hookSpecificOutput":{"hookEventName":"PreToolUse","permissionDecision":"deny","permissionDecisionReason":"' || n_name || '"}}' AS json FROM nation""",
        "large_doc_head": "WITH t AS (SELECT doc_id, repeat(text || chr(10), 60) AS text, doc_id % 5 = 0 AS reread, CASE WHEN doc_id % 3 > 0 THEN 'All of it: expand ' || doc_id || '.' ELSE '' END AS hint FROM documents WHERE text IS NOT NULL) SELECT doc_id, {} AS branch, sha256({}) AS sha FROM t".format(*_told("'head'", "text", "hint", "reread")),
        "duplicate_paragraphs": f"WITH {_DUPL} SELECT hash, count(*) AS occurrences, arg_min(place, struct_pack(a := path, b := i)) AS snippet, list(place ORDER BY path, i)[1:20] AS locations FROM h GROUP BY hash HAVING count(*) > 1",
        "duplicate_places": f"WITH {_DUPL} SELECT hash, path, i::INTEGER AS i FROM h",
        "orphan_files": f"WITH {_NOTES}, ot AS (SELECT 'o' || o_orderkey AS path, 'see Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || ' and more' AS text FROM orders UNION ALL SELECT 'n' || n_nationkey, 'in ' || n_name || '.' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT path, text FROM nt) {_ORPHANS}",
        "audit_report": f"""WITH {_NOTES}, dd AS (SELECT doc_id::VARCHAR AS path, text FROM documents), ot AS (SELECT path, text FROM dd WHERE text IS NOT NULL UNION ALL SELECT path, text FROM nt),
            {_DUPL.replace("FROM documents", "FROM (SELECT path AS doc_id, text FROM dd UNION ALL SELECT path, text FROM nt)")}, du AS (SELECT arg_min(place, struct_pack(a := path, b := i)) AS k, count(*) AS n FROM h GROUP BY hash HAVING count(*) > 1), op AS ({_ORPHANS})
            SELECT 0 AS section, 'size' AS kind, (SELECT count(*) FROM dd) AS n, path || ': ' || strlen(coalesce(text, '')) || ' bytes, ~' || {_tok('text')} || ' tokens, ' || len(string_split(coalesce(text, ''), chr(10))) || ' lines' AS finding FROM dd
            UNION ALL SELECT * FROM (SELECT 2, 'repeated', (SELECT count(*) FROM du), n || 'x: ' || k FROM du ORDER BY k LIMIT 10) UNION ALL SELECT * FROM (SELECT 1, 'orphan', (SELECT count(*) FROM op), path FROM op ORDER BY path LIMIT 10)""",
        "file_audit": f"SELECT doc_id::VARCHAR AS path, strlen(coalesce(text, '')) AS bytes, {_tok('text')} AS tokens, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents",
        "cache_hits": "WITH r AS (SELECT id, any_value(content_hash) AS h FROM session_reads GROUP BY id) SELECT id, coalesce(h IN (SELECT content_hash FROM distillations), false) AS hit FROM r",
        "cache_misses": "WITH r AS (SELECT id, any_value(content_hash) AS h FROM session_reads GROUP BY id) SELECT id FROM r WHERE NOT coalesce(h IN (SELECT content_hash FROM distillations), false)",
        "cache_latest": "SELECT source_path, max(id) AS id, arg_max(content_hash, id) AS content_hash FROM distillations GROUP BY source_path",
        "cache_list": "SELECT id, source_path FROM distillations ORDER BY id DESC LIMIT 50",
        "content_hash": f"SELECT doc_id, sha256(text) AS sha, sha1({_norm('text')}) AS norm FROM documents",
        "pack_route": f"WITH {_TREE} SELECT path, CASE WHEN {_SUF} IN {_DIST} THEN 'distill' WHEN {_NOTEXT} THEN 'skip' ELSE 'text' END AS route, CASE WHEN {_SUF} IN {_DIST} OR {_NOTEXT} THEN 0 ELSE {_tok('body')} END AS tokens FROM tf WHERE NOT {_EXCL} AND NOT regexp_matches(path, '(?s)^.*copy/.*$')",
        "pack_include": rf"WITH {_TREE} SELECT path FROM tf WHERE NOT CASE WHEN regexp_matches(path, '(?:^|/)[^/]*1\.md(?:/|$)') THEN true WHEN regexp_matches(path, '^data/[^/]*/keep\.md(?:/|$)') THEN false WHEN regexp_matches(path, '(?:^|/)data/') THEN true ELSE {_EXCL} END AND ends_with(path, '.md')",
        "pack_sections": f"WITH {_TREE} SELECT path, '## ' || path || chr(10) || chr(10) || '```' || chr(10) || body || chr(10) || '```' || chr(10) AS md, '  <file path=\"' || replace(replace(replace(path, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') || '\">' || chr(10) || '    <![CDATA[' || replace(body, ']]>', ']]]]><![CDATA[>') || ']]>' || chr(10) || '  </file>' AS xml FROM tf WHERE NOT {_EXCL} AND NOT {_NOTEXT} AND {_SUF} NOT IN {_DIST}",
        "pack_head": f"WITH {_TREE} SELECT '# Packed tree: ' || count(*) || ' files, about ' || sum({_tok('body')})::BIGINT || ' tokens' || chr(10) AS head FROM tf WHERE NOT {_EXCL} AND NOT {_NOTEXT} AND {_SUF} NOT IN {_DIST}",
        "pack_distilled": f"WITH {_PACK} SELECT path, route, reason, tokens, sha256(text) AS sha FROM pk",
        "pack_skipped": f"WITH {_PACK} SELECT path, reason FROM pk WHERE route = 'skip' ORDER BY string_split(path, '/') LIMIT 20",
        "pack_document": f"WITH {_PACK} SELECT 0 AS part, '' AS path, sha256('# Packed tree: ' || count(*) || ' files, about ' || sum(tokens)::BIGINT || ' tokens' || chr(10)) AS sha FROM pk WHERE route <> 'skip' UNION ALL SELECT 1, path, sha256({_MD}) FROM pk WHERE route <> 'skip'",
        "pack_document_xml": f"WITH {_PACK} SELECT 0 AS part, '' AS path, sha256('<packed_tree>') AS sha UNION ALL SELECT 2, '', sha256('</packed_tree>') UNION ALL SELECT 1, path, sha256({_XML}) FROM pk WHERE route <> 'skip'",
        "path_sort": "SELECT DISTINCT source_path AS path FROM chunks",
        "parsed_pages": "SELECT id, (p->>'page_index')::INTEGER AS page_index, p->>'method' AS method, p->>'text' AS text, coalesce((p->>'image_count')::INTEGER, 0) AS image_count, coalesce(json_array_length(p->'figures'), 0)::INTEGER AS figures FROM (SELECT id, unnest(from_json(pages_json, '[\"JSON\"]')) AS p FROM distillations)",
    }
