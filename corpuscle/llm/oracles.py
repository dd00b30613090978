"""DuckDB SQL for the training-data queries that SQL can express: plain quadratic forms, for small tables."""

from __future__ import annotations

from . import chat
from .common import WORD

_LINKED = """
r AS (SELECT x AS node, x AS reach FROM l UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reach),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY 1),
k AS (SELECT x, count(*) AS n FROM l GROUP BY 1)"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
u AS (SELECT DISTINCT doc_id, md5(s) AS s FROM g), c AS (SELECT doc_id, count(*) AS n FROM u GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM u a JOIN u b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE i >= 0.8 * (cx.n + cy.n - i)), {_LINKED}
SELECT doc_id, coalesce(component, doc_id) AS class_id, CASE WHEN len(ws) > 0 THEN min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) ELSE doc_id END AS copy_id,
  coalesce(k.n, 0)::BIGINT AS n_links, len(ws)::BIGINT AS n_words, doc_id = coalesce(component, doc_id) AS kept
FROM w LEFT JOIN m ON m.node = doc_id LEFT JOIN k ON k.x = doc_id"""

EGO_JOIN = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b USING (label) WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98), {_LINKED}
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM v LEFT JOIN m ON m.node = vec_id LEFT JOIN k ON k.x = vec_id"""


def _escaped(column: str, role: bool = False) -> str:
    out = f"replace({column}, '{chat.ESC}', '{chat.ESC}0')"
    for string, code in zip(chat.CONTROL, chat.CODES, strict=False):
        out = f"replace({out}, '{string}', '{chat.ESC}{code}')"
    return f"replace({out}, chr(10), '{chat.ESC}n')" if role else out


CHAT_FORMAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) p(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{chat.TURN}' || {_escaped('role', True)} || chr(10) || {_escaped('text')} || '{chat.END}'))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM t GROUP BY 1"""


def source_mix(weights: dict[str, int], fraction: tuple[int, int], epochs: int, seed: int) -> str:
    """The mixture by domain, language and source."""
    known = ", ".join(f"('{k}', {w})" for k, w in weights.items())
    n, d = fraction
    keys = ["domain", "lang", "source"]
    parts = []
    for depth in range(3, 0, -1):
        own, path = ", ".join(keys[:depth]), " || '/' || ".join(keys[:depth])
        source, cap = (f"c{depth + 1}", "sum(cap)") if depth < 3 else ("leaf", f"sum({epochs} * tokens)")
        parts.append(f"""
g{depth} AS (SELECT {own}, {path} AS p, {cap}::BIGINT AS cap, sum(tokens)::BIGINT AS tokens FROM {source} GROUP BY {own}),
c{depth} AS (SELECT g{depth}.* EXCLUDE (cap, p), coalesce(w, 1)::BIGINT AS weight, CASE WHEN coalesce(w, 1) > 0 THEN cap ELSE 0 END AS cap FROM g{depth} LEFT JOIN (VALUES {known}) k(p, w) USING (p))""")
    for depth in range(1, 4):
        own, up = ", ".join(keys[:depth]), ", ".join(keys[: depth - 1])
        by = f"PARTITION BY {up} " if up else ""
        name = keys[depth - 1]
        budget = f"SELECT c{depth}.*, b.budget FROM c{depth} JOIN s{depth - 1} b USING ({up})" if up else f"SELECT *, least((sum(tokens) OVER () // {d}) * {n} + (sum(tokens) OVER () % {d}) * {n} // {d}, sum(cap) OVER ())::BIGINT AS budget FROM c1"
        parts.append(f"""
n{depth} AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight::DOUBLE ELSE 'inf'::DOUBLE END AS ratio FROM ({budget})),
f{depth} AS (SELECT *, weight > 0 AND cap::HUGEINT * (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER o, 0)) <= (budget - coalesce(sum(cap) OVER o, 0)) * weight AS filled FROM n{depth} WINDOW o AS ({by}ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r{depth} AS (SELECT *, (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}))::BIGINT AS rest, nullif(sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}), 0)::BIGINT AS open FROM f{depth}),
x{depth} AS (SELECT *, CASE WHEN filled THEN cap ELSE coalesce(rest // open * weight + rest % open * weight // open, 0) END AS low, CASE WHEN filled THEN 0 ELSE rest % open * weight % open END AS part FROM r{depth}),
y{depth} AS (SELECT *, budget - sum(low) OVER ({by}) AS spare, row_number() OVER ({by}ORDER BY (NOT filled AND weight > 0) DESC, part DESC NULLS LAST, {name}) AS turn FROM x{depth}),
s{depth} AS (SELECT {own}, least(low + CASE WHEN NOT filled AND weight > 0 AND turn <= spare THEN 1 ELSE 0 END, cap)::BIGINT AS budget FROM y{depth})""")
    return f"""
WITH docs AS (SELECT doc_id, CASE WHEN substr(md5(source), 1, 1) < '6' THEN 'web' WHEN substr(md5(source), 1, 1) < 'b' THEN 'books' ELSE 'code' END AS domain, lang, source, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs WHERE n_tokens > 0 GROUP BY 1, 2, 3), {','.join(parts)},
t AS (SELECT docs.*, tokens, budget // tokens AS full_epochs, budget % tokens AS rest FROM docs JOIN leaf USING (domain, lang, source) JOIN s3 USING (domain, lang, source) WHERE n_tokens > 0),
x AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}-' || full_epochs || '-' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM t)
SELECT doc_id, domain, lang, source, unnest(range(full_epochs))::INTEGER AS epoch, n_tokens, n_tokens AS take_tokens FROM t
UNION ALL SELECT doc_id, domain, lang, source, full_epochs::INTEGER, n_tokens, least(n_tokens, rest - before)::BIGINT FROM x WHERE before < rest"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

TERM_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), b AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM b),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM b) GROUP BY 1, 2, 3),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), s),
i AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
x AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM i JOIN w USING (t) JOIN p USING (t), s GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
