"""The memory-store views in DuckDB's SQL, for the statements that must give a query's rows."""

from __future__ import annotations

from recollect.model import EDGE_FACTORS, EDGE_TYPES, NODE_TYPES, NOW


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def cut(c: str, end: str) -> str:
    head = f"regexp_replace(substr({c}, 1, 60), ' [^ ]*$', '')"
    return f"CASE WHEN length({c}) <= 60 THEN {c} WHEN {head} = '' THEN substr({c}, 1, 60) ELSE {head} || '{end}' END"


def title(c: str) -> str:
    return cut(strip(f"split_part({strip(c)}, chr(10), 1)"), "…")


def dot(a: str, b: str) -> str:
    return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


MOMENT = f"TIMESTAMP '{NOW}'"


def days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


EV = "ev AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id)"
NODES = f"""{EV}, nodes AS (SELECT d.doc_id AS id, list_extract({text_list(NODE_TYPES)}, CAST(d.doc_id % 10 + 1 AS INT)) AS type,
CASE WHEN d.doc_id % 10 = 0 THEN 'core' WHEN d.doc_id % 10 >= 8 THEN 'archival' ELSE 'working' END AS tier, d.source AS space, {title("d.text")} AS title, d.text AS content,
TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS updated, coalesce(last, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id)) AS last_accessed,
CAST(coalesce(n, 0) AS BIGINT) AS access_count, CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence, round((d.doc_id % 17) / 16.0::DOUBLE, 4) AS importance,
CASE WHEN toxic = 1 THEN TIMESTAMP '2024-01-15' END AS valid_until, least(30.0::DOUBLE, greatest(1.0::DOUBLE, 2.0::DOUBLE * coalesce(n, 0))) AS stability,
CASE WHEN d.doc_id % 7 = 0 THEN [lang, 'about_self'] ELSE [lang] END AS tags
FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN ev ON ev.user_id = d.doc_id)"""


def pairs(threshold: float) -> str:
    return f"SELECT a.vec_id AS a, b.vec_id AS b, {dot('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {dot('a.embedding', 'b.embedding')} >= {threshold}"


EDGES = f"""edges AS (SELECT a AS source_id, b AS target_id, list_extract({text_list(EDGE_TYPES)}, CAST((a + b) % 11 + 1 AS INT)) AS edge_type, round(s, 3) AS weight, TIMESTAMP '2024-01-01' + to_minutes(b) AS created FROM ({pairs(0.30)})),
both_ways AS (SELECT source_id AS id, target_id AS other, edge_type, weight FROM edges UNION ALL SELECT target_id, source_id, edge_type, weight FROM edges)"""


def knn(k: int) -> str:
    return f"""knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM
(SELECT a.vec_id AS id, b.vec_id AS other, round({dot("a.embedding", "b.embedding")}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= {k})"""


FACTOR = "CASE edge_type " + " ".join(f"WHEN '{t}' THEN {f}::DOUBLE" for t, f in EDGE_FACTORS.items()) + " ELSE 0.5::DOUBLE END"
TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"


def tokens(c: str) -> str:
    return TOKENS.format(c=c)


def bm25(terms: list[str], name: str = "found", mode: str = "and_or") -> str:
    """CTEs ending in `name` (id, score) over nodes; single-word terms."""
    tf = ", ".join(f"CAST(list_count(list_filter(ft, lambda t: t = '{t}')) + 5 * list_count(list_filter(fc, lambda t: t = '{t}')) + 3 * list_count(list_filter(fg, lambda t: t = '{t}')) AS DOUBLE) AS t{k}" for k, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN t{k} > 0 THEN 1 ELSE 0 END) AS d{k}" for k in range(len(terms)))
    every, some = " AND ".join(f"t{k} > 0" for k in range(len(terms))), " OR ".join(f"t{k} > 0" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((docs - d{k} + 0.5) / (d{k} + 0.5)), CASE WHEN ln((docs - d{k} + 0.5) / (d{k} + 0.5)) > 0 THEN ln((docs - d{k} + 0.5) / (d{k} + 0.5)) ELSE 1e-6 END) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * n / mean))" for k in range(len(terms)))
    wanted = {"and": every, "or": some, "and_or": f"(({every}) OR NOT some_all) AND ({some})"}[mode]
    return f"""tk AS (SELECT id, {tokens("title")} AS ft, {tokens("content")} AS fc, {tokens("array_to_string(tags, ' ')")} AS fg FROM nodes),
tf AS (SELECT id, len(ft) + len(fc) + len(fg) AS n, {tf} FROM tk),
st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, CAST(avg(n) AS DOUBLE) AS mean, bool_or({every}) AS some_all, {df} FROM tf),
{name} AS (SELECT id, round(CAST({score} AS DOUBLE), 6) AS score FROM tf, st WHERE {wanted})"""


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '\s+'), lambda w: w <> '')"


def recall(terms: list[str], query: str, question: bool, vector: int, limit: int, threshold: float, condition: str = "TRUE", name: str = "result", overfetch: int = 3) -> str:
    """CTEs ending in `name` (id, score, and the node's columns) as operators.search.recall computes it."""
    k = limit * overfetch
    wt, wv, blend = (0.4 * 0.3, 0.6 * 1.5, 0.85) if question else (0.4, 0.6, 0.5)
    asked = text_list(sorted(set(query.lower().split())))
    boost = "1.0" if question else f"(1 + 2.0 * len(list_intersect(list_filter({asked}, lambda w: length(w) > 2), {words('title')})) / len({asked}))"
    return f"""{bm25(terms)},
fl AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM found QUALIFY rank <= {k}),
qv AS (SELECT embedding FROM embeddings WHERE vec_id = {vector}),
vl AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM (SELECT vec_id AS id, round({dot("e.embedding", "qv.embedding")}, 6) AS similarity FROM embeddings e, qv) WHERE similarity >= {threshold} QUALIFY rank <= {k}),
fu AS (SELECT id, sum(part) AS rrf FROM (SELECT id, {wt}::DOUBLE / (60 + rank) AS part FROM fl UNION ALL SELECT id, {wv}::DOUBLE / (60 + rank) FROM vl) GROUP BY id),
nm AS (SELECT id, CASE WHEN hi > 0 AND hi - lo > hi * 0.05 THEN (rrf - lo) / (hi - lo) WHEN hi > 0 THEN rrf / hi ELSE rrf END AS rrf FROM (SELECT *, max(rrf) OVER () AS hi, min(rrf) OVER () AS lo FROM fu)),
ba AS (SELECT n.*, round(CASE WHEN coalesce(similarity, 0) > 0 THEN (1 - {blend}::DOUBLE) * rrf + {blend}::DOUBLE * similarity * CASE WHEN length(content) > 300 THEN greatest(0.1::DOUBLE, 300.0::DOUBLE / length(content)) ELSE 1.0::DOUBLE END ELSE rrf * 0.5::DOUBLE END, 9) AS base
  FROM nodes n JOIN nm USING (id) LEFT JOIN vl USING (id) WHERE (valid_until IS NULL OR valid_until > {MOMENT}) AND ({condition})),
cu AS (SELECT *, base * {boost} * (0.4::DOUBLE + 0.6::DOUBLE * confidence) AS adj FROM ba ORDER BY base DESC, id LIMIT {limit}),
{name} AS (SELECT *, round(adj * CASE tier WHEN 'core' THEN 1.1::DOUBLE WHEN 'archival' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END + adj * 0.05::DOUBLE * exp(-greatest({days(MOMENT, "last_accessed")}, 0) * 0.6931471805599453::DOUBLE / 7.0::DOUBLE) + adj * 0.05::DOUBLE * ln(1 + access_count) / 3.044522437723423::DOUBLE, 6) AS score FROM cu)"""


def recall_all(prompts: str, stop: list[str], identity: list[str], question: str, threshold: float, limit: int = 10, overfetch: int = 3) -> str:
    """CTEs ending in `activated` for prompts(pid, query, after, before, only_time, embedding), as operators.batch computes it."""
    k, asked = limit * overfetch, question.replace("'", "''").replace("(?i)", "")
    pair = lambda f: f"len(list_filter(range(1, len({f})), lambda i: {f}[i] = 'about' AND {f}[i + 1] = 'self'))"
    raw = rf"list_filter(regexp_split_to_array(lower(regexp_replace(query, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda w: w <> '')"
    return f"""prompts AS ({prompts}), pr AS (SELECT *, regexp_matches(query, '{asked}', 'i') AS asks, {raw} AS raw FROM prompts),
pl AS (SELECT *, list_filter(raw, lambda w: length(w) > 1) AS long, list_filter(raw, lambda w: length(w) > 1 AND NOT list_contains({text_list(stop)}, w)) AS topical FROM pr),
pk AS (SELECT *, CASE WHEN len(topical) > 0 THEN topical ELSE long END AS own FROM pl),
pt AS (SELECT pid, unnest(CASE WHEN len(own) > 0 AND list_has_any(raw, {text_list(identity)}) THEN list_append(own, 'about self') ELSE own END) AS term FROM pk),
mt AS (SELECT pid, term, count(*) AS m FROM pt GROUP BY ALL), nt AS (SELECT pid, count(*) AS terms FROM mt GROUP BY pid),
tk AS (SELECT id, {tokens("title")} AS ft, {tokens("content")} AS fc, {tokens("array_to_string(tags, ' ')")} AS fg FROM nodes),
ln AS (SELECT id, len(ft) + len(fc) + len(fg) AS n FROM tk), st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, CAST(avg(n) AS DOUBLE) AS mean FROM ln),
ps AS (SELECT term, id, sum(w)::DOUBLE AS tf FROM (SELECT id, unnest(ft) AS term, 1 AS w FROM tk UNION ALL SELECT id, unnest(fc), 5 FROM tk UNION ALL SELECT id, unnest(fg), 3 FROM tk) GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT 'about self', id, CAST({pair("ft")} + 5 * {pair("fc")} + 3 * {pair("fg")} AS DOUBLE) AS tf FROM tk) WHERE tf > 0),
df AS (SELECT term, CASE WHEN ln((docs - d + 0.5) / (d + 0.5)) > 0 THEN ln((docs - d + 0.5) / (d + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*) AS d FROM ps GROUP BY term), st),
bm AS (SELECT pid, id, round(sum(m * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score, count(*) = any_value(terms) AS every
  FROM mt JOIN nt USING (pid) JOIN ps USING (term) JOIN df USING (term) JOIN ln USING (id), st GROUP BY pid, id),
tl AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, id) AS rank FROM (SELECT *, bool_or(every) OVER (PARTITION BY pid) AS some_all FROM bm) WHERE every OR NOT some_all QUALIFY rank <= {k}),
vl AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY similarity DESC, id) AS rank FROM (SELECT pid, vec_id AS id, round({dot("e.embedding", "p.embedding")}, 6) AS similarity FROM embeddings e, prompts p WHERE p.embedding IS NOT NULL) WHERE similarity >= {threshold} QUALIFY rank <= {k}),
fu AS (SELECT pid, id, sum(part) AS rrf FROM (SELECT pid, id, CASE WHEN asks THEN 0.4 * 0.3::DOUBLE ELSE 0.4::DOUBLE END / (60 + rank) AS part FROM tl JOIN pr USING (pid) UNION ALL SELECT pid, id, CASE WHEN asks THEN 0.6::DOUBLE * 1.5 ELSE 0.6::DOUBLE END / (60 + rank) FROM vl JOIN pr USING (pid)) GROUP BY pid, id),
nm AS (SELECT pid, id, CASE WHEN hi > 0 AND hi - lo > hi * 0.05 THEN (rrf - lo) / (hi - lo) WHEN hi > 0 THEN rrf / hi ELSE rrf END AS rrf FROM (SELECT *, max(rrf) OVER (PARTITION BY pid) AS hi, min(rrf) OVER (PARTITION BY pid) AS lo FROM fu)),
ba AS (SELECT n.*, pid, asks, query, CASE WHEN asks THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS bl, round(CASE WHEN coalesce(similarity, 0) > 0 THEN (1 - bl) * rrf + bl * similarity * CASE WHEN length(content) > 300 THEN greatest(0.1::DOUBLE, 300.0::DOUBLE / length(content)) ELSE 1.0::DOUBLE END ELSE rrf * 0.5::DOUBLE END, 9) AS base
  FROM nodes n JOIN nm USING (id) JOIN pr USING (pid) LEFT JOIN vl USING (pid, id) WHERE (valid_until IS NULL OR valid_until > {MOMENT}) AND (after IS NULL OR created BETWEEN after AND before)),
cu AS (SELECT *, list_distinct({words("query")}) AS asked, base * CASE WHEN asks OR len(asked) = 0 THEN 1.0 ELSE 1 + 2.0 * len(list_intersect(list_filter(asked, lambda w: length(w) > 2), list_distinct({words("title")}))) / len(asked) END * (0.4::DOUBLE + 0.6::DOUBLE * confidence) AS adj FROM ba QUALIFY row_number() OVER (PARTITION BY pid ORDER BY base DESC, id) <= {limit}),
hy AS (SELECT pid, id, round(adj * CASE tier WHEN 'core' THEN 1.1::DOUBLE WHEN 'archival' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END + adj * 0.05::DOUBLE * exp(-greatest({days(MOMENT, "last_accessed")}, 0) * 0.6931471805599453::DOUBLE / 7.0::DOUBLE) + adj * 0.05::DOUBLE * ln(1 + access_count) / 3.044522437723423::DOUBLE, 6) AS score
  FROM cu WHERE pid NOT IN (SELECT pid FROM prompts WHERE only_time AND after IS NOT NULL)),
hv AS (SELECT pid, after, before, count(hy.id) AS have FROM prompts LEFT JOIN hy USING (pid) WHERE after IS NOT NULL GROUP BY ALL HAVING count(hy.id) < {limit}),
mo AS (SELECT pid, id FROM (SELECT pid, n.id, have, row_number() OVER (PARTITION BY pid ORDER BY created DESC, n.id) AS r FROM hv JOIN nodes n ON n.created BETWEEN after AND before ANTI JOIN hy ON hy.pid = hv.pid AND hy.id = n.id) WHERE r <= {limit} - have),
res AS (SELECT pid, id, score, 'hybrid' AS source FROM hy UNION ALL SELECT pid, id, 0.001::DOUBLE, 'temporal' FROM mo),
sd AS (SELECT pid, id AS seed, score AS ss FROM res QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, id) <= 5),
mx AS (SELECT pid, seed, other AS id, edge_type, round(ss * weight * {FACTOR} * 0.5::DOUBLE, 6) AS score FROM sd JOIN both_ways w ON w.id = seed ANTI JOIN res ON res.pid = sd.pid AND res.id = w.other),
tp AS (SELECT * FROM mx QUALIFY row_number() OVER (PARTITION BY pid, seed ORDER BY score DESC, id, edge_type) <= 3),
ac AS (SELECT * FROM tp WHERE id IN (SELECT id FROM nodes) QUALIFY row_number() OVER (PARTITION BY pid, id ORDER BY score DESC, seed, edge_type DESC) = 1),
activated AS (SELECT pid, id, score, source, CAST(NULL AS BIGINT) AS activated_by FROM res UNION ALL SELECT pid, id, score, CASE edge_type WHEN 'contradicts' THEN 'conflict' ELSE 'activated' END, seed FROM ac)"""


def identity(self_id: int) -> str:
    return f"own_ids AS (SELECT id FROM nodes WHERE id = {self_id} UNION SELECT target_id FROM edges WHERE source_id = {self_id} AND edge_type = 'defines' UNION SELECT id FROM nodes WHERE list_contains(tags, 'about_self'))"


def first_sentence(c: str, most: str) -> str:
    t = strip(c)
    ends = " ".join(f"WHEN strpos({t}, {e}) - 1 BETWEEN 1 AND {most} - 1 THEN substr({t}, 1, strpos({t}, {e}))" for e in ("'. '", "'.' || chr(10)", "'; '", "chr(10)"))
    return f"CASE WHEN length({t}) <= {most} THEN {t} {ends} ELSE substr({t}, 1, {most}) END"


def whisper(results: str, least: float, gate: float) -> str:
    """CTEs ending in `said` (pid, section, place, id, type, score, content) from results (pid, id, score, source, temporal)."""
    return f"""w0 AS (SELECT * FROM ({results}) WHERE (score >= CASE WHEN temporal THEN least(0.30::DOUBLE, {least}::DOUBLE) ELSE {least}::DOUBLE END OR source = 'temporal') AND (temporal OR score >= {gate}::DOUBLE)),
w1 AS (SELECT w0.*, n.type, n.tier, n.created, n.content, id IN (SELECT id FROM own_ids) AS own FROM w0 JOIN nodes n USING (id)),
w2 AS (SELECT *, CASE WHEN own AND type IN ('person', 'preference') THEN 0 WHEN own THEN 1 ELSE 2 END AS k FROM w1 QUALIFY bool_or(NOT own) OVER (PARTITION BY pid) OR max(CASE WHEN own THEN score END) OVER (PARTITION BY pid) >= {least}::DOUBLE),
w3 AS (SELECT *, row_number() OVER (PARTITION BY pid, k ORDER BY CASE WHEN temporal THEN epoch_us(created) ELSE 0 END DESC, CASE WHEN temporal THEN 0 ELSE score END DESC, id) AS n, sum(CAST(k = 0 AS INT)) OVER (PARTITION BY pid) AS fixed FROM w2),
w4 AS (SELECT *, sum(CAST(k < 2 AS INT)) OVER (PARTITION BY pid) AS own_n FROM (SELECT * FROM w3 WHERE k <> 1 OR n <= greatest(5 - fixed, 0))),
w5 AS (SELECT *, CAST(least(600, greatest(100, 1500 // (count(*) OVER (PARTITION BY pid)))) AS INT) AS most, CASE WHEN k < 2 THEN 'identity' WHEN tier = 'core' THEN 'core' ELSE 'working' END AS section FROM (SELECT * FROM w4 WHERE k < 2 OR n <= greatest(8 - own_n, 0))),
said AS (SELECT pid, section, row_number() OVER (PARTITION BY pid, section ORDER BY k, n) AS place, id, type, score, {first_sentence("content", "most")} AS content FROM w5)"""
