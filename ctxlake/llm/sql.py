"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from ctxlake.llm import lookalike

_RUNS = r"""
WITH e AS (
  SELECT seq, min(struct_pack(t := ts, s := session_id, k := k)) AS m FROM (
    SELECT seq, ts, session_id, lower(regexp_replace(bucket, '\P{L}', '', 'g')) AS k FROM activity_log
    WHERE session_id IS NOT NULL AND bucket IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL)
  WHERE k <> '' GROUP BY seq),
o AS (SELECT seq, m.t AS ts, m.s AS session_id, m.k AS k,
        lag(m.k) OVER w AS pk, lag(m.t) OVER w AS pt FROM e WINDOW w AS (PARTITION BY m.s ORDER BY m.t, seq)),
r AS (SELECT *, sum(CASE WHEN pk = k AND ts - pt <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END)
        OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM o),
g AS (SELECT session_id, k AS bucket, arg_min(seq, struct_pack(a := ts, b := seq)) AS first_seq,
        arg_max(seq, struct_pack(a := ts, b := seq)) AS last_seq, min(ts) AS first_ts, max(ts) AS last_ts,
        count(*) AS n_events, epoch_us(max(ts) - min(ts)) / 1000000.0::DOUBLE AS duration_s
      FROM r GROUP BY session_id, run, k)
"""

_RECORDS = r"""
WITH RECURSIVE it AS (
  SELECT 'chunk' AS item_kind, chunk_id AS id, text FROM chunks
  UNION ALL
  SELECT 'distillation', id, array_to_string(list_transform(from_json(pages_json, '[{"text":"VARCHAR"}]'), lambda p: coalesce(p.text, '')), chr(10) || chr(10)) FROM distillations),
w AS (SELECT item_kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM it WHERE text IS NOT NULL),
"""

_P1 = _RECORDS + r"""
s AS (SELECT DISTINCT item_kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
n AS (SELECT item_kind, id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.item_kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.item_kind = b.item_kind AND a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT p.item_kind, id_a, id_b FROM p JOIN n x ON x.item_kind = p.item_kind AND x.id = id_a JOIN n y ON y.item_kind = p.item_kind AND y.id = id_b WHERE c * 2 >= x.n + y.n - c
"""

_P1_CLASSES = _RECORDS + r"""
k AS (SELECT item_kind, id, list_sort(list_distinct(list_transform(range(1, len(w) - {last}), lambda i: array_to_string(w[i:i + {more}], ' ')))) AS k FROM w WHERE len(w) >= 20),
m AS (SELECT item_kind, id, k, min(id) OVER (PARTITION BY item_kind, k) AS rep, count(*) OVER (PARTITION BY item_kind, k) AS n FROM k),
s AS (SELECT item_kind, id, unnest(k) AS s FROM m WHERE id = rep),
c AS (SELECT item_kind, id, len(k) AS n FROM m WHERE id = rep),
p AS (SELECT a.item_kind, a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.item_kind = b.item_kind AND a.s = b.s AND a.id <> b.id GROUP BY ALL),
l AS (SELECT p.item_kind, a, b FROM p JOIN c x ON x.item_kind = p.item_kind AND x.id = a JOIN c y ON y.item_kind = p.item_kind AND y.id = b WHERE c * {den} >= {num} * (x.n + y.n - c)),
r AS (SELECT item_kind, a, a AS b FROM (SELECT DISTINCT item_kind, a FROM l) UNION SELECT r.item_kind, r.a, l.b FROM r JOIN l ON l.item_kind = r.item_kind AND l.a = r.b),
g AS (SELECT item_kind, a, min(b) AS g FROM r GROUP BY ALL), d AS (SELECT item_kind, a, count(*) AS links FROM l GROUP BY ALL)
SELECT m.item_kind, m.id AS item_id, rep AS class_id, n, coalesce(links, 0) AS links, coalesce(g, rep) AS group_id
FROM m LEFT JOIN d ON d.item_kind = m.item_kind AND d.a = rep LEFT JOIN g ON g.item_kind = m.item_kind AND g.a = rep
"""


def _groups(words: int, num: int, den: int) -> str:
    """Classes and groups at a similarity of num / den."""
    return _P1_CLASSES.replace("{last}", str(words - 2)).replace("{more}", str(words - 1)).replace("{num}", str(num)).replace("{den}", str(den))


_P5 = r"""
WITH u AS (SELECT model, arg_max(d, struct_pack(n := n, m := -d)) AS d FROM (SELECT model, len(vector) AS d, count(*) AS n FROM chunk_embeddings WHERE len(vector) > 0 GROUP BY ALL) GROUP BY model),
v AS (SELECT chunk_id AS id, e.model, vector::DOUBLE[] AS x FROM chunk_embeddings e JOIN u ON u.model = e.model AND u.d = len(e.vector) WHERE list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0),
p AS (SELECT a.id AS q, b.id AS o, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.model = b.model AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, o) AS k FROM p)
SELECT DISTINCT least(q, o) AS chunk_id_a, greatest(q, o) AS chunk_id_b FROM r WHERE k <= 5 AND c >= 0.9
"""



def _ranges(chars: str) -> str:
    """The characters as ranges of a regular expression."""
    out, points = [], sorted(map(ord, chars))
    for i in points:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def _forms() -> str:
    """doc_id, text and the one form of all texts that print something."""
    src, dst, gone, _ = lookalike.mapping()
    src, dst = (x.replace("'", "''") for x in (src, dst))
    form = f"translate(regexp_replace(text, '[{_ranges(gone)}]', '', 'g'), '{src}', '{dst}')"
    for a, b in lookalike.spelt_letters():
        form = f"replace({form}, '{a}', '{b}')"
    return rf"""
WITH f AS (SELECT doc_id, text, nfc_normalize({form}) AS form FROM documents WHERE text IS NOT NULL),
s AS (SELECT * FROM f WHERE NOT regexp_full_match(form, '[{_WS}]*'))
"""


_WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _cut(b: str) -> str:
    """Where the piece that begins at ``b`` is cut: the last of the strongest places in the second half of its window, else in the rest, else at the limit."""
    last = lambda lo, hi: f"{hi} - list_position(list_reverse(st[{lo} + 1:{hi} + 1]), list_max(st[{lo} + 1:{hi} + 1])) + 1"
    half, rest = (f"({b} + 1001)", f"({b} + 2002)"), (f"({b} + 201)", f"({b} + 1000)")
    return f"CASE WHEN n - {b} <= 2002 THEN n WHEN list_max(st[{half[0]} + 1:{half[1]} + 1]) > 0 THEN {last(*half)} WHEN list_max(st[{rest[0]} + 1:{rest[1]} + 1]) > 0 THEN {last(*rest)} ELSE {b} + 2002 END"


_PIECES = rf"""WITH RECURSIVE big AS (SELECT chunk_id, source_path, chunk_index, regexp_extract_all(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '(?s).') AS c FROM chunks WHERE text IS NOT NULL AND length(text) > 1500),
ov AS (SELECT * FROM big WHERE len(c) > 2002),
ch AS (SELECT chunk_id, unnest(c) AS x, unnest(range(len(c))) AS i FROM ov),
cs AS (SELECT *, regexp_matches(x, '[{_WS}]') AS space FROM ch),
cw AS (SELECT *, lag(space) OVER w AS after, sum(CASE WHEN x = chr(10) THEN 1 ELSE 0 END) OVER w AS nl, max(CASE WHEN NOT space THEN i END) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM cs WINDOW w AS (PARTITION BY chunk_id ORDER BY i)),
cb AS (SELECT a.chunk_id, a.i, a.space, a.after, a.nl - b.nl AS breaks, b.x AS x1, CASE WHEN b.x IN (')', ']', '»', '”', '"', chr(39)) AND b.i > 0 THEN z.x ELSE b.x END AS x2
  FROM cw a LEFT JOIN cw b ON b.chunk_id = a.chunk_id AND b.i = a.last LEFT JOIN cw z ON z.chunk_id = a.chunk_id AND z.i = a.last - 1),
sl AS (SELECT chunk_id, list(CASE WHEN space OR after IS NOT TRUE THEN 0 WHEN breaks >= 2 THEN 6 WHEN breaks = 1 THEN 5 WHEN x2 IN ('.', '!', '?', '…', '。') THEN 4 WHEN x1 IN (',', ';', ':', ')', ']', '»', '”') THEN 3 ELSE 2 END ORDER BY i) AS st FROM cb GROUP BY chunk_id),
t AS MATERIALIZED (SELECT ov.*, len(c) AS n, st || [0] AS st FROM ov JOIN sl USING (chunk_id)),
pc AS (SELECT chunk_id, 0 AS k, 0::BIGINT AS lo, ({_cut("0")})::BIGINT AS hi FROM t
  UNION ALL SELECT chunk_id, k + 1, nlo, ({_cut("nlo")})::BIGINT FROM (SELECT t.*, pc.k, (CASE WHEN coalesce(list_position(list_transform(st[pc.hi - 200 + 1:pc.hi], lambda x: x > 0), true), 0) > 0 THEN pc.hi - 201 + list_position(list_transform(st[pc.hi - 200 + 1:pc.hi], lambda x: x > 0), true) WHEN st[pc.hi + 1] = 0 THEN pc.hi - 200 ELSE pc.hi END)::BIGINT AS nlo FROM pc JOIN t ON t.chunk_id = pc.chunk_id WHERE pc.hi < t.n)),
tx AS (SELECT pc.chunk_id, source_path, chunk_index AS parent_index, k::INTEGER AS chunk_index, lo AS "begin", hi AS "end", regexp_replace(array_to_string(c[lo + 1:hi], ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS text FROM pc JOIN t ON t.chunk_id = pc.chunk_id)
SELECT *, greatest(1, round_even(len(regexp_extract_all(text, '(?s).')) / 4.0, 0))::BIGINT AS token_count FROM tx"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_classes": _groups(5, 4, 5),
        "p1_groups": _groups(3, 1, 2),
        "p5_found": _P5,
        "p2_pieces": _PIECES,
        "p2_found": f"SELECT chunk_id FROM chunks WHERE round_even(length(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')) / 4.0, 0) > 500",
        "p9_found": _forms() + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
        "p9_forms": _forms() + """, c AS (SELECT form, min(doc_id) AS class_id FROM s GROUP BY form)
SELECT d.doc_id, c.class_id, o.text AS canonical FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.form = s.form LEFT JOIN documents o ON o.doc_id = c.class_id""",
        "p3_found": _RUNS + "SELECT session_id, first_seq, last_seq FROM g WHERE n_events > 1",
        "p3_runs": _RUNS + "SELECT session_id, bucket, first_seq, last_seq, first_ts, last_ts, n_events, duration_s FROM g",
    }
