"""The SQL of graph_queries, for DuckDB."""

from __future__ import annotations

# White space as in graphloom.functions.text, for RE2.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTERS = "list_transform(range(26), lambda k: CAST(length({0}) - length(replace({0}, chr(CAST(97 + k AS INT)), '')) AS DOUBLE))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _collapse(c: str) -> str:
    return _strip(f"regexp_replace({c}, '{_SPACE}+', ' ', 'g')")


def _letters(c: str) -> str:
    return _LETTERS.format(f"lower({c})")


def _tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, text FROM documents WHERE text IS NOT NULL)"
_SENTS = f"""{_DOCS}, parts AS (
  SELECT file_id, text, string_split(regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM docs
), trimmed AS (
  SELECT file_id, list_filter(list_transform(p, lambda x: {_strip('x')}), lambda x: length(x) > 0) AS s FROM parts
), sents AS (SELECT file_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos, len(s) AS n FROM trimmed)"""
_CONTEXT = f"""{_SENTS}, ctx AS (
  SELECT file_id, pos, n, string_agg(sentence, ' ') OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context
  FROM sents)"""
_DISTANCE = f"""{_CONTEXT}, emb AS (SELECT file_id, pos, n, {_letters('context')} AS e FROM ctx WHERE n > 24),
normed AS (SELECT *, sqrt({_DOT.format('e', 'e')}) AS l FROM emb),
paired AS (SELECT *, lead(e) OVER w AS e2, lead(l) OVER w AS l2 FROM normed WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
dist AS (
  SELECT file_id, pos, n, 1.0 - CASE WHEN l = 0 OR l2 = 0 THEN 0.0 ELSE {_DOT.format('e', 'e2')} / (l * l2) END AS d
  FROM paired WHERE e2 IS NOT NULL)"""
_THRESHOLD = f"""{_DISTANCE}, sorted AS (SELECT file_id, list_sort(list(d)) AS s FROM dist GROUP BY file_id),
ranked AS (SELECT file_id, s, (len(s) - 1) * CAST(90 AS DOUBLE) / CAST(100 AS DOUBLE) AS r FROM sorted),
thr AS (
  SELECT file_id, s[CAST(floor(r) AS INT) + 1] * (CAST(1 AS DOUBLE) - (r - floor(r))) + s[least(CAST(floor(r) AS INT) + 1, len(s) - 1) + 1] * (r - floor(r)) AS t
  FROM ranked)"""
_LATEST = """latest AS (
  SELECT chunk_id, file_id, pos, text, is_deleted, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) AS r FROM chunks
), cur AS (SELECT chunk_id, file_id, pos, text FROM latest WHERE r = 1 AND NOT coalesce(is_deleted, false))"""

_OFFSETS = f"""{_DOCS}, raw AS (
  SELECT file_id, regexp_extract_all(text, '(?s).*?(?:[.!?]{_SPACE}|\\z)') AS p FROM docs
), flat AS (SELECT file_id, unnest(p) AS part, unnest(range(len(p))) AS i FROM raw),
spans AS (
  SELECT file_id, i, part, {_strip('part')} AS sentence,
    coalesce(sum(length(part)) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(part) - length(regexp_replace(part, '^{_SPACE}+', '')) AS char_start FROM flat),
offs AS (
  SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i) - 1 AS INT) AS pos, CAST(char_start AS INT) AS char_start,
    CAST(char_start + length(sentence) AS INT) AS char_end, sentence
  FROM spans WHERE length(sentence) > 0)"""
_EVIDENCE = f"""{_OFFSETS}, ranges AS (SELECT * FROM (VALUES (1, 1, 3), (2, 5, 6)) AS t(number, first, last)),
spans2 AS (
  SELECT d.file_id, d.text, r.number, a.char_start, b.char_end FROM docs d, ranges r
  JOIN offs a ON a.file_id = d.file_id AND a.pos = r.first - 1 JOIN offs b ON b.file_id = d.file_id AND b.pos = r.last - 1),
evi AS (
  SELECT 'q' || file_id AS qid, 'q' || file_id || '_e0' || number AS evidence_id, file_id, char_start, char_end,
    sha256(substring(text, char_start + 1, char_end - char_start)) AS text_sha256,
    substring({_collapse('substring(text, char_start + 1, char_end - char_start)')}, 1, 240) AS text_preview FROM spans2)"""
# Where collapsed positions lie in the source: one row per token of every document.
_LOCATED = f"""{_LATEST}, flatdocs AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, text, {_collapse('text')} AS flat FROM documents),
tried AS (
  SELECT c.chunk_id, c.file_id, {_collapse('c.text')} AS sub, d.flat, d.text AS source FROM cur c LEFT JOIN flatdocs d USING (file_id)
), placed AS (SELECT *, CASE WHEN length(sub) > 0 THEN coalesce(instr(flat, sub), 0) ELSE 0 END AS p FROM tried),
stat AS (
  SELECT *, CASE WHEN p = 0 THEN 'missing' WHEN instr(substring(flat, p + 1), sub) > 0 THEN 'ambiguous' ELSE 'ok' END AS status FROM placed),
runs AS (
  SELECT chunk_id, unnest(regexp_extract_all(source, '{_SPACE}+|[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+')) AS run,
    generate_subscripts(regexp_extract_all(source, '{_SPACE}+|[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), 1) AS i
  FROM stat WHERE status = 'ok'),
toks AS (
  SELECT chunk_id, run, i, coalesce(sum(length(run)) OVER w, 0) AS s, coalesce(sum(CASE WHEN blank THEN 0 ELSE length(run) + 1 END) OVER w, 0) AS c, blank
  FROM (SELECT *, regexp_matches(run, '^{_SPACE}') AS blank FROM runs)
  WINDOW w AS (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (
  SELECT t.chunk_id,
    max(CASE WHEN t.c <= x.p - 1 AND x.p - 1 < t.c + length(t.run) THEN t.s + (x.p - 1 - t.c) END) AS char_start,
    max(CASE WHEN t.c <= x.p + length(x.sub) - 2 AND x.p + length(x.sub) - 2 < t.c + length(t.run) THEN t.s + (x.p + length(x.sub) - 2 - t.c) + 1 END) AS char_end
  FROM toks t JOIN stat x USING (chunk_id) WHERE NOT t.blank GROUP BY t.chunk_id),
located AS (
  SELECT chunk_id, file_id, status, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end FROM stat LEFT JOIN ends USING (chunk_id))"""

_VEC = """vecs AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
asked AS (SELECT id AS qid, v AS q, label FROM vecs WHERE CAST(id AS BIGINT) % 50 = 0)"""
_ENT = """live AS (SELECT * FROM entities WHERE NOT coalesce(is_deleted, false) AND length(name) > 0),
esrc AS (
  SELECT file_id, name, string_agg(s, ',' ORDER BY o) AS source_id, list(s ORDER BY o) AS source_list FROM (
    SELECT file_id, name, s, min(o) AS o FROM (
      SELECT file_id, name, unnest(source_id) AS s, row_id * 1000 + unnest(range(len(source_id))) AS o FROM live) GROUP BY ALL) GROUP BY ALL),
ent AS (
  SELECT e.file_id, e.name, coalesce(arg_min_null(type, row_id), '') AS type,
    coalesce(string_agg(description, ' | ' ORDER BY row_id) FILTER (WHERE description <> ''), '') AS description,
    coalesce(any_value(x.source_id), '') AS source_id, any_value(x.source_list) AS source_list
  FROM live e LEFT JOIN esrc x ON x.file_id = e.file_id AND x.name = e.name GROUP BY e.file_id, e.name)"""
_REL = """rlive AS (
  SELECT *, least(source, target) || '||' || greatest(source, target) AS k FROM relations WHERE length(source) > 0 AND length(target) > 0),
rsrc AS (
  SELECT file_id, k, string_agg(s, ',' ORDER BY o) AS source_id, list(s ORDER BY o) AS source_list FROM (
    SELECT file_id, k, s, min(o) AS o FROM (
      SELECT file_id, k, unnest(source_id) AS s, row_id * 1000 + unnest(range(len(source_id))) AS o FROM rlive) GROUP BY ALL) GROUP BY ALL),
rkey AS (
  SELECT file_id, k, list(s ORDER BY o) AS keywords FROM (
    SELECT file_id, k, s, min(o) AS o FROM (
      SELECT file_id, k, unnest(keywords) AS s, row_id * 1000 + unnest(range(len(keywords))) AS o FROM rlive) GROUP BY ALL) GROUP BY ALL),
rel AS (
  SELECT r.file_id, r.k AS rel_key, arg_min_null(source, row_id) AS source, arg_min_null(target, row_id) AS target,
    coalesce(any_value(w.keywords), []) AS keywords,
    coalesce(string_agg(description, ' | ' ORDER BY row_id) FILTER (WHERE description <> ''), '') AS description,
    coalesce(any_value(x.source_id), '') AS source_id, any_value(x.source_list) AS source_list, min(row_id) AS first_seen
  FROM rlive r LEFT JOIN rsrc x ON x.file_id = r.file_id AND x.k = r.k LEFT JOIN rkey w ON w.file_id = r.file_id AND w.k = r.k
  GROUP BY r.file_id, r.k),
edges AS (
  SELECT file_id, source AS node, target AS neighbour, rel_key FROM rel
  UNION ALL SELECT file_id, target, source, rel_key FROM rel WHERE source <> target),
ends AS (SELECT file_id, source AS name FROM rel UNION ALL SELECT file_id, target FROM rel)"""

_INDEX = f"""{_LATEST}, {_ENT}, {_REL},
cvec AS (SELECT chunk_id AS id, text, {_letters('text')} AS v FROM cur),
evec AS (SELECT file_id || ':' || name AS id, file_id, name, source_list, {_letters("(name || ' ' || description)")} AS v FROM ent),
rvec AS (
  SELECT file_id || ':' || rel_key AS id, file_id, rel_key, source, target, keywords, description, source_list, first_seen,
    {_letters("(array_to_string(keywords, ' ') || ' ' || description)")} AS v,
    {_tokens("('source: ' || source || '; target: ' || target || '; keywords: ' || array_to_string(keywords, ', ') || '; description: ' || description)")} AS toks FROM rel),
qvec AS (SELECT id AS qid, {_letters('question')} AS q, {_tokens('question')} AS toks FROM gold_questions WHERE length(question) > 0),
cn AS (SELECT *, sqrt({_DOT.format('v', 'v')}) AS l FROM cvec), en AS (SELECT *, sqrt({_DOT.format('v', 'v')}) AS l FROM evec),
rn AS (SELECT *, sqrt({_DOT.format('v', 'v')}) AS l FROM rvec), qn AS (SELECT *, sqrt({_DOT.format('q', 'q')}) AS ql FROM qvec)"""


def _top(name: str, table: str, k: int) -> str:
    return f"""{name} AS (
  SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INT) AS rank
  FROM (SELECT qid, id, list_dot_product(q, v) / (ql * l) AS s FROM qn, {table} WHERE l > 0 AND ql > 0) QUALIFY rank <= {k})"""


def _rerank(name: str, candidates: str) -> str:
    return f"""{name}_d AS (
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r1
  FROM (SELECT c.qid, c.id, list_dot_product(q, v) / (ql * l) AS s FROM {candidates} c JOIN qn USING (qid) JOIN rn USING (id) WHERE l > 0 AND ql > 0) QUALIFY r1 <= 20),
{name}_s AS (
  SELECT d.qid, d.id, d.r1, len(list_intersect(qn.toks, rn.toks)) AS common, len(qn.toks) + len(rn.toks) - len(list_intersect(qn.toks, rn.toks)) AS everything
  FROM {name}_d d JOIN qn USING (qid) JOIN rn USING (id)),
{name} AS (
  SELECT qid, id, r1, rerank, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, r1) AS INT) AS rank
  FROM (SELECT *, CASE WHEN everything = 0 THEN 0.0 ELSE common / everything END AS rerank FROM {name}_s) QUALIFY rank <= 5)"""


def _chunks(name: str, sources: str) -> str:
    return f"""{name}_f AS (SELECT qid, stage, rank, unnest(source_list) AS id, unnest(range(len(source_list))) AS i FROM ({sources})),
{name} AS (
  SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY p) AS INT) AS rank
  FROM (SELECT qid, id, min((stage, rank, i)) AS p FROM {name}_f WHERE id IN (SELECT chunk_id FROM cur) GROUP BY qid, id))"""


_LOCAL = ",\n".join(
    [
        _top("lent", "en", 5),
        "lnear AS (SELECT DISTINCT t.qid, e2.file_id || ':' || e2.rel_key AS id FROM lent t JOIN en ON en.id = t.id JOIN edges e2 ON e2.file_id = en.file_id AND e2.node = en.name)",
        _rerank("lrel", "lnear"),
        _chunks("lchk", "SELECT t.qid, 0 AS stage, t.rank, x.source_list FROM lent t JOIN en x USING (id) UNION ALL SELECT t.qid, 1, t.rank, x.source_list FROM lrel t JOIN rn x USING (id)"),
        "ltrace AS (SELECT qid, 'local' AS mode, 'entity' AS kind, rank, id FROM lent UNION ALL SELECT qid, 'local', 'relation', rank, id FROM lrel UNION ALL SELECT qid, 'local', 'chunk', rank, id FROM lchk)",
    ]
)
_GLOBAL = ",\n".join(
    [
        _top("grel", "rn", 5),
        """gends AS (
  SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY p) AS INT) AS rank FROM (
    SELECT qid, id, min((rank, o)) AS p FROM (
      SELECT t.qid, t.rank, 0 AS o, x.file_id || ':' || x.source AS id FROM grel t JOIN rn x USING (id)
      UNION ALL SELECT t.qid, t.rank, 1, x.file_id || ':' || x.target FROM grel t JOIN rn x USING (id))
    WHERE id IN (SELECT id FROM en) GROUP BY qid, id))""",
        _chunks("gchk", "SELECT t.qid, 0 AS stage, t.rank, x.source_list FROM grel t JOIN rn x USING (id)"),
        "gtrace AS (SELECT qid, 'global' AS mode, 'entity' AS kind, rank, id FROM gends UNION ALL SELECT qid, 'global', 'relation', rank, id FROM grel UNION ALL SELECT qid, 'global', 'chunk', rank, id FROM gchk)",
    ]
)
_NAMES = f"""bare AS (
  SELECT DISTINCT 1 AS o, regexp_replace({_collapse('g')}, '^["'']+|["'']+$', '', 'g') AS spelling, regexp_replace({_collapse('g')}, '^["'']+|["'']+$', '', 'g') AS canonical
  FROM (SELECT unnest(gold_entities) AS g FROM carol_canonical)
  UNION SELECT 0, regexp_replace({_collapse('e.key')}, '^["'']+|["'']+$', '', 'g'), regexp_replace({_collapse('e.value')}, '^["'']+|["'']+$', '', 'g')
  FROM (SELECT unnest(map_entries(entity_aliases)) AS e FROM carol_canonical)),
names AS (SELECT replace(lower(spelling), 'ß', 'ss') AS folded, arg_min(canonical, (o, canonical)) AS canonical FROM bare GROUP BY folded)"""


def _normal(c: str) -> str:
    return f"regexp_replace({_collapse(c)}, '^[\"'']+|[\"'']+$', '', 'g')"


_EVAL = f"""{_VEC}, hits AS (
  SELECT qid, id AS chunk_id, label AS vlabel, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank
  FROM (SELECT qid, id, vecs.label, list_cosine_similarity(q, v) AS s FROM asked, vecs) QUALIFY rank <= 10),
shows AS (SELECT qid, id AS chunk_id, 'e' || v.label || '_' || (CAST(id AS BIGINT) % 3) AS evidence_id FROM asked a JOIN vecs v ON a.label = v.label),
known AS (SELECT qid, count(DISTINCT evidence_id) AS gold_evidence FROM shows GROUP BY qid),
runs AS (SELECT m.mode, h.* FROM hits h, (VALUES ('top5', 5), ('top10', 10)) AS m(mode, k) WHERE h.rank <= m.k),
covered AS (SELECT mode, r.qid, r.rank, r.chunk_id, s.evidence_id, min(CASE WHEN s.evidence_id IS NOT NULL THEN r.rank END) OVER (PARTITION BY mode, r.qid, s.evidence_id) AS fr
  FROM runs r LEFT JOIN shows s ON s.qid = r.qid AND s.chunk_id = r.chunk_id),
-- every retrieved chunk is on the list, with or without evidence; so is every vector of the label
listed AS (SELECT qid, count(*) AS n FROM (SELECT qid, chunk_id FROM shows UNION SELECT qid, chunk_id FROM hits) GROUP BY qid),
per AS (
  SELECT mode, qid, count(*) AS retrieved_chunks, count(evidence_id) AS relevant_chunks,
    count(*) FILTER (WHERE evidence_id IS NOT NULL AND fr = rank) AS novel_chunks,
    CAST(min(rank) FILTER (WHERE evidence_id IS NOT NULL) AS INT) AS first_relevant_rank,
    coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE evidence_id IS NOT NULL), 0) AS dcg, count(DISTINCT evidence_id) AS matched_evidence
  FROM covered GROUP BY mode, qid),
scored AS (
  SELECT mode, qid, CAST(3 AS BIGINT) AS answer_points, retrieved_chunks, relevant_chunks, novel_chunks, first_relevant_rank, l.n AS listed_chunks, matched_evidence, gold_evidence,
    matched_evidence AS matched_points, relevant_chunks / retrieved_chunks AS chunk_precision, matched_evidence / gold_evidence AS evidence_recall, matched_evidence / 3 AS answer_point_recall,
    dcg / list_sum(list_transform(range(1, CAST(least(retrieved_chunks, l.n) + 1 AS BIGINT)), lambda i: 1 / log2(i + 1))) AS ndcg,
    coalesce(1.0 / first_relevant_rank, 0) AS reciprocal_rank, relevant_chunks - novel_chunks AS redundant_chunks,
    CASE WHEN relevant_chunks = 0 THEN 0 ELSE (relevant_chunks - novel_chunks) / relevant_chunks END AS redundancy_rate,
    CASE WHEN relevant_chunks = 0 THEN 0 ELSE novel_chunks / relevant_chunks END AS novelty_rate, relevant_chunks > 0 AS chunk_hit
  FROM per JOIN known USING (qid) JOIN listed l USING (qid)),
evald AS (SELECT *, CASE WHEN chunk_precision + evidence_recall = 0 THEN 0.0 ELSE 2 * chunk_precision * evidence_recall / (chunk_precision + evidence_recall) END AS coverage_f1 FROM scored)"""

_MACRO = ("chunk_precision", "evidence_recall", "answer_point_recall", "coverage_f1", "ndcg", "reciprocal_rank", "redundancy_rate", "novelty_rate")

def _folded(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def _named(rows: str) -> str:
    """(qid, name) normalised as names."""
    return f"SELECT DISTINCT r.qid, coalesce(n.canonical, b) AS item FROM (SELECT *, {_normal('name')} AS b FROM ({rows})) r LEFT JOIN names n ON n.folded = {_folded('b')}"


def _paired(rows: str) -> str:
    """(qid, name) normalised as a||b keys."""
    return f"""SELECT DISTINCT qid, CASE WHEN len(p) <> 2 THEN {_collapse('name')} WHEN {_folded('a')} <= {_folded('b')} THEN a || '||' || b ELSE b || '||' || a END AS item
  FROM (SELECT s.*, coalesce(f.canonical, x) AS a, coalesce(g.canonical, y) AS b
    FROM (SELECT *, string_split(name, '||') AS p, {_normal("string_split(name, '||')[1]")} AS x, {_normal("string_split(name, '||')[2]")} AS y FROM ({rows})) s
    LEFT JOIN names f ON f.folded = {_folded('x')} LEFT JOIN names g ON g.folded = {_folded('y')})"""


def _sets(kind: str) -> str:
    return f"""{kind}_c AS (
  SELECT q.mode, q.qid, coalesce(m.n, 0) AS {kind}_matched_count, coalesce(m.l, '') AS {kind}_matched, coalesce(w.n, 0) AS {kind}_gold_count, coalesce(g.n, 0) AS {kind}_retrieved_count
  FROM every q
  LEFT JOIN (SELECT g.mode, g.qid, count(*) AS n, string_agg(item, ';' ORDER BY item) AS l FROM {kind}_got g JOIN {kind}_want w USING (qid, item) GROUP BY ALL) m USING (mode, qid)
  LEFT JOIN (SELECT qid, count(*) AS n FROM {kind}_want GROUP BY ALL) w USING (qid)
  LEFT JOIN (SELECT mode, qid, count(*) AS n FROM {kind}_got GROUP BY ALL) g USING (mode, qid)),
{kind}_r AS (SELECT *, CASE WHEN {kind}_gold_count = 0 THEN 0.0 ELSE {kind}_matched_count / {kind}_gold_count END AS {kind}_recall,
  CASE WHEN {kind}_retrieved_count = 0 THEN 0.0 ELSE {kind}_matched_count / {kind}_retrieved_count END AS {kind}_precision, {kind}_matched_count > 0 AS {kind}_hit FROM {kind}_c),
{kind}_m AS (SELECT *, CASE WHEN {kind}_recall + {kind}_precision = 0 THEN 0.0 ELSE 2 * {kind}_recall * {kind}_precision / ({kind}_recall + {kind}_precision) END AS {kind}_f1 FROM {kind}_r)"""


_PLACES = _LOCATED.replace("ends AS (", "cends AS (").replace("LEFT JOIN ends", "LEFT JOIN cends").removeprefix(f"{_LATEST}, ")
_EVALUATION = f"""WITH {_INDEX}, {_LOCAL}, {_GLOBAL}, {_top('nhits', 'cn', 5)}, {_NAMES}, {_PLACES},
hboth AS (SELECT 0 AS b, * FROM ltrace UNION ALL SELECT 1, * FROM gtrace),
hmarked AS (SELECT hboth.*, CASE WHEN kind = 'chunk' THEN c.text ELSE hboth.id END AS same FROM hboth LEFT JOIN cur c ON hboth.kind = 'chunk' AND c.chunk_id = hboth.id),
hfirsts AS (SELECT qid, kind, arg_min(id, (b, rank)) AS id, min((b, rank)) AS p FROM hmarked GROUP BY qid, kind, same),
trace AS (
  SELECT qid, mode, kind, rank, id FROM ltrace UNION ALL SELECT qid, mode, kind, rank, id FROM gtrace UNION ALL SELECT qid, 'naive', 'chunk', rank, id FROM nhits
  UNION ALL SELECT qid, 'hybrid', kind, CAST(row_number() OVER (PARTITION BY qid, kind ORDER BY p) AS INT), id FROM hfirsts),
every AS (SELECT mode, id AS qid, len(gold_answer_points) AS points FROM gold_questions, (VALUES ('naive'), ('local'), ('global'), ('hybrid')) AS m(mode) WHERE length(question) > 0),
entity_got AS (SELECT DISTINCT split_part(qid, chr(31), 1) AS mode, split_part(qid, chr(31), 2) AS qid, item FROM (
  {_named("SELECT mode || chr(31) || qid AS qid, en.name FROM trace JOIN en USING (id) WHERE kind = 'entity'")})),
relation_got AS (SELECT DISTINCT split_part(qid, chr(31), 1) AS mode, split_part(qid, chr(31), 2) AS qid, item FROM (
  {_paired("SELECT mode || chr(31) || qid AS qid, rn.rel_key AS name FROM trace JOIN rn USING (id) WHERE kind = 'relation'")})),
entity_want AS ({_named('SELECT id AS qid, unnest(gold_entities) AS name FROM gold_questions')}),
relation_want AS ({_paired('SELECT id AS qid, unnest(gold_relations) AS name FROM gold_questions')}),
{_sets('entity')}, {_sets('relation')},
spans AS (SELECT id AS qid, unnest(gold_evidence_spans) AS s FROM gold_questions),
qfiles AS (SELECT DISTINCT qid, ent.file_id FROM (SELECT id AS qid, unnest(gold_entities) AS name FROM gold_questions) JOIN ent USING (name)),
shows AS (
  SELECT DISTINCT qid, l.chunk_id, s.evidence_id FROM spans JOIN qfiles USING (qid) JOIN located l USING (file_id)
  WHERE status = 'ok' AND greatest(l.char_start, s.char_start) < least(l.char_end, s.char_end)),
shown_n AS (SELECT qid, count(DISTINCT chunk_id) AS listed FROM shows GROUP BY ALL),
got AS (SELECT mode, qid, id AS chunk_id, row_number() OVER (PARTITION BY mode, qid ORDER BY rank) AS rank FROM trace WHERE kind = 'chunk'),
seen AS (SELECT g.*, s.evidence_id, min(rank) OVER (PARTITION BY mode, qid, evidence_id) AS fr FROM got g JOIN shows s USING (qid, chunk_id)),
chunk_r AS (SELECT mode, qid, chunk_id, rank, bool_or(fr = rank) AS novel FROM seen GROUP BY ALL),
chunk_a AS (
  SELECT mode, qid, count(*) AS relevant, count(*) FILTER (WHERE novel) AS novel, min(rank) AS first_rank, sum(1 / log2(rank + 1)) AS dcg,
    string_agg(chunk_id, ';' ORDER BY rank) AS relevant_ids, string_agg(chunk_id, ';' ORDER BY rank) FILTER (WHERE novel) AS novel_ids FROM chunk_r GROUP BY mode, qid),
ev_a AS (SELECT mode, qid, count(DISTINCT evidence_id) AS n, string_agg(DISTINCT evidence_id, ';' ORDER BY evidence_id) AS ids FROM seen GROUP BY ALL),
pt AS (SELECT DISTINCT mode, e.qid, p FROM (SELECT DISTINCT mode, qid, evidence_id FROM seen) e JOIN (SELECT qid, s.evidence_id AS evidence_id, unnest(s.supports_answer_points) AS p FROM spans) x USING (qid, evidence_id)),
pt_a AS (SELECT mode, qid, count(*) AS n, string_agg(CAST(p AS VARCHAR), ';' ORDER BY p) AS ids FROM pt GROUP BY ALL),
gold_a AS (SELECT qid, count(DISTINCT s.evidence_id) AS n FROM spans GROUP BY ALL),
got_a AS (SELECT mode, qid, count(*) AS n FROM got GROUP BY ALL),
base AS (
  SELECT q.mode, q.qid, coalesce(g.n, 0) AS k, coalesce(c.relevant, 0) AS rel, coalesce(c.novel, 0) AS nov, c.first_rank, coalesce(c.dcg, 0.0) AS dcg, coalesce(sn.listed, 0) AS listed,
    coalesce(c.relevant_ids, '') AS relevant_ids, coalesce(c.novel_ids, '') AS novel_ids, coalesce(e.n, 0) AS ev, coalesce(e.ids, '') AS ev_ids, coalesce(ga.n, 0) AS gold,
    CAST(q.points AS BIGINT) AS points, coalesce(p.n, 0) AS pts, coalesce(p.ids, '') AS pt_ids
  FROM every q LEFT JOIN got_a g USING (mode, qid) LEFT JOIN chunk_a c USING (mode, qid) LEFT JOIN shown_n sn USING (qid) LEFT JOIN ev_a e USING (mode, qid)
  LEFT JOIN gold_a ga USING (qid) LEFT JOIN pt_a p USING (mode, qid)),
rates AS (
  SELECT *, CASE WHEN k = 0 THEN 0.0 ELSE rel / k END AS cp, CASE WHEN gold = 0 THEN 0.0 ELSE ev / gold END AS er, CASE WHEN points = 0 THEN 0.0 ELSE pts / points END AS ap,
    CASE WHEN rel = 0 THEN 0.0 ELSE (rel - nov) / rel END AS red, coalesce(1.0 / first_rank, 0.0) AS rr,
    CASE WHEN least(k, listed) = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, CAST(least(k, listed) + 1 AS BIGINT)), lambda i: 1 / log2(i + 1))) END AS nd FROM base),
rated AS (SELECT *, CASE WHEN cp + er = 0 THEN 0.0 ELSE 2 * cp * er / (cp + er) END AS f FROM rates),
evaluated AS (
  SELECT mode, qid, entity_m.* EXCLUDE (mode, qid), relation_m.* EXCLUDE (mode, qid), cp AS chunk_precision, er AS evidence_recall, f AS coverage_f1, ap AS answer_point_recall, rel > 0 AS chunk_hit, k,
    cp AS precision_at_k, er AS evidence_recall_at_k, ap AS answer_point_recall_at_k, rr AS reciprocal_rank, nd AS ndcg_at_k, CAST(first_rank AS INT) AS first_relevant_rank, red AS redundancy_rate,
    k AS retrieved_count, rel AS relevant_retrieved_count, nov AS novel_relevant_count, rel - nov AS redundant_relevant_count, gold AS gold_evidence_count, ev AS matched_evidence_count,
    points AS gold_answer_point_count, pts AS matched_answer_point_count, relevant_ids AS relevant_chunk_ids, novel_ids AS novel_relevant_chunk_ids, ev_ids AS matched_evidence_ids, pt_ids AS matched_answer_point_indices
  FROM rated JOIN entity_m USING (mode, qid) JOIN relation_m USING (mode, qid))"""
_RATES = [f"{kind}_{m}" for kind in ("entity", "relation") for m in ("recall", "precision", "f1")] + [
    "chunk_precision", "evidence_recall", "coverage_f1", "answer_point_recall", "precision_at_k", "evidence_recall_at_k", "answer_point_recall_at_k",
    "reciprocal_rank", "ndcg_at_k", "redundancy_rate",
]
_MEANS = {f"avg_{kind}_{m}": f"{kind}_{m}" for kind in ("entity", "relation") for m in ("recall", "precision", "f1")} | {
    "avg_chunk_precision": "chunk_precision", "avg_evidence_recall": "evidence_recall", "avg_answer_point_recall": "answer_point_recall", "avg_coverage_f1": "coverage_f1",
    "mean_reciprocal_rank": "reciprocal_rank", "avg_ndcg_at_k": "ndcg_at_k", "avg_chunk_redundancy_rate": "redundancy_rate",
    "entity_hit_rate": "CAST(entity_hit AS INT)", "relation_hit_rate": "CAST(relation_hit AS INT)", "chunk_hit_rate": "CAST(chunk_hit AS INT)",
}

SQL: dict[str, str] = {
    "evaluation_rows": f"{_EVALUATION} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _RATES)}) FROM evaluated",
    "evaluation_summary": f"""{_EVALUATION}, s AS (
  SELECT mode, count(*) AS count, 'canonical evidence coverage' AS metric_protocol, {', '.join(f'round(avg({c}), 6) AS {n}' for n, c in _MEANS.items())},
    CASE WHEN sum(k) = 0 THEN 0.0 ELSE sum(relevant_retrieved_count) / sum(k) END AS p, CASE WHEN sum(gold_evidence_count) = 0 THEN 0.0 ELSE sum(matched_evidence_count) / sum(gold_evidence_count) END AS r,
    CASE WHEN sum(gold_answer_point_count) = 0 THEN 0.0 ELSE sum(matched_answer_point_count) / sum(gold_answer_point_count) END AS a FROM evaluated GROUP BY mode)
SELECT * EXCLUDE (p, r, a), round(p, 6) AS micro_chunk_precision, round(r, 6) AS micro_evidence_recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS micro_coverage_f1,
  round(a, 6) AS micro_answer_point_recall FROM s""",
    "chunk_fixed": f"""WITH {_DOCS}, w AS (SELECT file_id, text, unnest(range(0, length(text), 2200)) AS i FROM docs WHERE length(text) > 0)
SELECT file_id || '_chunk_' || (i // 2200 + 1) AS chunk_id, file_id, CAST(i // 2200 + 1 AS INT) AS pos, substring(text, i + 1, 2400) AS text FROM w""",
    "chunk_fixed_stats": f"""WITH {_DOCS}, w AS (SELECT file_id, text, unnest(range(0, length(text), 2200)) AS i FROM docs WHERE length(text) > 0)
SELECT file_id, count(*) AS chunks, CAST(sum(length(substring(text, i + 1, 2400))) AS BIGINT) AS chars FROM w GROUP BY file_id""",
    "sentences": f"WITH {_SENTS} SELECT file_id, CAST(pos AS INT) AS pos, sentence FROM sents",
    "sentence_offsets": f"WITH {_OFFSETS} SELECT * FROM offs",
    "chunk_sentence_window": f"""WITH {_SENTS.replace(', sents AS', ', sents_ AS')}, starts AS (
  SELECT file_id, s, CASE WHEN len(s) <= 8 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, len(s) - 8 + 1, 6), len(s) - 8))) END AS st FROM trimmed WHERE len(s) > 0
), w AS (SELECT file_id, s, unnest(st) AS i, unnest(range(1, len(st) + 1)) AS pos FROM starts)
SELECT file_id || '_chunk_' || pos AS chunk_id, file_id, CAST(pos AS INT) AS pos, array_to_string(s[i + 1 : i + 8], ' ') AS text FROM w""",
    "sentence_context": f"WITH {_CONTEXT} SELECT file_id, CAST(pos AS INT) AS pos, context FROM ctx",
    "semantic_distances": f"WITH {_DISTANCE} SELECT file_id, CAST(pos AS INT) AS pos, round(d, 9) AS distance FROM dist",
    "semantic_threshold": f"WITH {_THRESHOLD} SELECT file_id, round(t, 9) AS threshold FROM thr",
    "chunk_semantic": f"""WITH RECURSIVE {_THRESHOLD}, scan AS (
  SELECT d.file_id, d.pos AS i, d.n, CAST(0 AS BIGINT) AS start, (1 >= 8 AND d.d >= t.t) OR 1 >= 24 AS cut FROM dist d JOIN thr t USING (file_id) WHERE d.pos = 0
  UNION ALL
  SELECT s.file_id, d.pos, s.n, CASE WHEN s.cut THEN s.i + 1 ELSE s.start END,
    (d.pos - (CASE WHEN s.cut THEN s.i + 1 ELSE s.start END) + 1 >= 8 AND d.d >= t.t) OR d.pos - (CASE WHEN s.cut THEN s.i + 1 ELSE s.start END) + 1 >= 24
  FROM scan s JOIN dist d ON d.file_id = s.file_id AND d.pos = s.i + 1 JOIN thr t ON t.file_id = s.file_id
), cuts AS (SELECT file_id, any_value(n) AS n, coalesce(list(i ORDER BY i) FILTER (WHERE cut), []) AS c FROM scan GROUP BY file_id),
ends AS (
  SELECT file_id, list_append(CASE WHEN len(c) > 0 AND n - (c[-1] + 1) < 8 THEN c[1 : len(c) - 1] ELSE c END, n - 1) AS e FROM cuts
  UNION ALL SELECT file_id, [n - 1] FROM (SELECT DISTINCT file_id, n FROM sents WHERE n <= 24)),
flat AS (SELECT file_id, unnest(e) AS last, coalesce(unnest(list_prepend(-1, e[1 : len(e) - 1])), -1) + 1 AS first, unnest(range(1, len(e) + 1)) AS pos FROM ends)
SELECT file_id || '_chunk_' || pos AS chunk_id, file_id, CAST(pos AS INT) AS pos, array_to_string(s[first + 1 : last + 1], ' ') AS text FROM flat JOIN trimmed USING (file_id)""",
    "ws_normalize": f"SELECT CAST(doc_id AS VARCHAR) AS file_id, {_collapse('text')} AS normal FROM documents",
    "doc_sha256": "SELECT CAST(doc_id AS VARCHAR) AS file_id, sha256(text) AS sha256 FROM documents",
    "kv_latest": f"WITH {_LATEST} SELECT * FROM cur",
    "locate_passages": f"WITH {_LOCATED} SELECT * FROM located",
    "evidence_spans": f"WITH {_EVIDENCE} SELECT * FROM evi",
    "evidence_overlap": f"""WITH {_LOCATED.replace('ends AS (', 'cends AS (').replace('LEFT JOIN ends', 'LEFT JOIN cends')}, {_EVIDENCE}
SELECT DISTINCT qid, chunk_id, evidence_id FROM located l JOIN evi e USING (file_id) WHERE status = 'ok' AND greatest(l.char_start, e.char_start) < least(l.char_end, e.char_end)""",
    "evidence_guards": """WITH q AS (
  SELECT id, coalesce(len(gold_answer_points), 0) AS answer_points, len(gold_evidence_spans) AS spans,
    len(list_filter(gold_evidence_spans, lambda s: s.sentence_start < 1 OR s.sentence_end < s.sentence_start OR s.char_end <= s.char_start)) AS bad_ranges,
    flatten(list_transform(gold_evidence_spans, lambda s: s.supports_answer_points)) AS sup FROM gold_questions),
c AS (SELECT *, len(list_filter(sup, lambda p: p < 1 OR p > answer_points)) AS bad_supports, len(list_filter(range(1, answer_points + 1), lambda p: NOT list_contains(sup, p))) AS unsupported FROM q)
SELECT id, answer_points, spans, bad_ranges, bad_supports, unsupported, spans > 0 AND bad_ranges = 0 AND bad_supports = 0 AND unsupported = 0 AS ok FROM c""",
    "gold_relation_pairs": f"""WITH p AS (SELECT id, list_transform(string_split(unnest(gold_relations), '||'), lambda x: {_strip('x')}) AS parts FROM gold_questions)
SELECT q.id, coalesce(string_agg(DISTINCT array_to_string(list_sort(parts), '||'), ';' ORDER BY array_to_string(list_sort(parts), '||')) FILTER (WHERE len(parts) = 2), '') AS relations
FROM gold_questions q LEFT JOIN p USING (id) GROUP BY q.id""",
    "knn_topk": f"""WITH {_VEC} SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INT) AS rank, round(s, 6) AS score
FROM (SELECT qid, id, list_cosine_similarity(q, v) AS s FROM asked, vecs) QUALIFY rank <= 5""",
    "knn_topk_restricted": f"""WITH {_VEC} SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INT) AS rank, round(s, 6) AS score
FROM (SELECT qid, id, list_cosine_similarity(q, v) AS s FROM asked a JOIN vecs b ON a.label = b.label) QUALIFY rank <= 5""",
    "vector_lookup": f"""WITH {_VEC}, k AS (SELECT qid AS id FROM asked UNION ALL SELECT 'no such id')
SELECT id, CAST(coalesce(len(v), 0) AS INT) AS size, round(v[1], 6) AS head FROM k LEFT JOIN vecs USING (id)""",
    "entity_merge": f"WITH {_ENT} SELECT file_id, name, type, description, source_id FROM ent",
    "relation_merge": f"WITH {_REL} SELECT file_id, rel_key, source, target, array_to_string(keywords, ',') AS keywords, description, source_id FROM rel",
    "ordered_distinct": "SELECT file_id, name, min(row_id) AS row_id FROM entities WHERE length(name) > 0 GROUP BY file_id, name",
    "graph_vertices": f"""WITH {_ENT}, {_REL}, e AS (SELECT DISTINCT * FROM ends)
SELECT coalesce(e.file_id, ent.file_id) AS file_id, coalesce(e.name, ent.name) AS name, ent.name IS NOT NULL AS known FROM e FULL JOIN ent ON e.file_id = ent.file_id AND e.name = ent.name""",
    "dangling_endpoints": f"WITH {_ENT}, {_REL} SELECT DISTINCT file_id, name FROM ends e WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.file_id = e.file_id AND ent.name = e.name)",
    "node_style": f"""WITH {_ENT}, {_REL}, deg AS (SELECT file_id, name, count(*) AS degree FROM ends GROUP BY ALL),
v AS (SELECT coalesce(e.file_id, ent.file_id) AS file_id, coalesce(e.name, ent.name) AS name, coalesce(degree, 0) AS degree, ent.name IS NOT NULL AS known, type, source_list
  FROM deg e FULL JOIN ent ON e.file_id = ent.file_id AND e.name = ent.name)
SELECT file_id, name, degree, round(10 + sqrt(degree) * 4, 6) AS size,
  CASE type WHEN 'Artifact' THEN '#d73027' WHEN 'Person' THEN '#fc8d59' WHEN 'Concept' THEN '#fee090' WHEN 'Location' THEN '#4575b4' WHEN 'NaturalObject' THEN '#91bfdb'
    WHEN 'Content' THEN '#ac667e' WHEN 'Creature' THEN '#8e44ad' WHEN 'Event' THEN '#f9ae78' WHEN 'Organization' THEN '#12685d' WHEN 'Method' THEN '#00a391' WHEN 'Data' THEN '#63bbb0'
    ELSE '#999999' END AS colour, coalesce(len(source_list), 0) AS chunks FROM v""",
    "edge_style": f"WITH {_REL} SELECT file_id, rel_key, len(keywords) + 1 AS width, description AS title FROM rel",
    "graph_neighbours": f"WITH {_REL} SELECT file_id, node, neighbour FROM edges",
    "graph_one_hop": f"""WITH {_ENT}, {_REL}, seeds AS (SELECT DISTINCT id AS qid, unnest(gold_entities) AS name FROM gold_questions)
SELECT DISTINCT s.qid, e.file_id, x.rel_key FROM seeds s JOIN ent e USING (name) JOIN edges x ON x.file_id = e.file_id AND x.node = e.name""",
    "retrieve_naive": f"WITH {_INDEX}, {_top('hits', 'cn', 5)} SELECT qid, 'naive' AS mode, 'chunk' AS kind, rank, id FROM hits",
    "retrieve_local": f"WITH {_INDEX}, {_LOCAL} SELECT * FROM ltrace",
    "retrieve_global": f"WITH {_INDEX}, {_GLOBAL} SELECT * FROM gtrace",
    "retrieve_hybrid": f"""WITH {_INDEX}, {_LOCAL}, {_GLOBAL}, both_ AS (
  SELECT 0 AS b, * FROM ltrace UNION ALL SELECT 1, * FROM gtrace),
marked AS (SELECT both_.*, CASE WHEN kind = 'chunk' THEN c.text ELSE both_.id END AS same FROM both_ LEFT JOIN cur c ON both_.kind = 'chunk' AND c.chunk_id = both_.id),
firsts AS (SELECT qid, kind, arg_min(id, (b, rank)) AS id, min((b, rank)) AS p FROM marked GROUP BY qid, kind, same)
SELECT qid, 'hybrid' AS mode, kind, CAST(row_number() OVER (PARTITION BY qid, kind ORDER BY p) AS INT) AS rank, id FROM firsts""",
    "rerank_two_stage": f"""WITH {_INDEX}, {_top('found', 'en', 5)},
near AS (SELECT DISTINCT f.qid, r.id FROM found f JOIN en USING (id) JOIN rn r ON r.file_id = en.file_id), {_rerank('out_', 'near')}
SELECT qid, id, rank, CAST(r1 AS INT) AS r1, round(rerank, 6) AS rerank FROM out_""",
    "context_lines": f"""WITH {_INDEX}, {_GLOBAL}
SELECT qid, 'entity' AS kind, rank, CAST(json_object('name', e.name, 'type', e.type, 'description', e.description) AS VARCHAR) AS line
FROM gends g JOIN ent e ON g.id = e.file_id || ':' || e.name
UNION ALL SELECT qid, 'relation', rank, CAST(json_object('source', source, 'target', target, 'keywords', keywords, 'description', description) AS VARCHAR) FROM grel JOIN rn USING (id)
UNION ALL SELECT qid, 'chunk', rank, CAST(json_object('content', text) AS VARCHAR) FROM gchk g JOIN cur c ON g.id = c.chunk_id""",
    "json_extract_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "parse_entities": f"""WITH {_LATEST}, n AS (SELECT chunk_id, regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\\b') AS a FROM cur),
f AS (SELECT chunk_id, unnest(a) AS name, unnest(range(len(a))) AS i FROM n), d AS (SELECT chunk_id, name, min(i) AS i FROM f GROUP BY ALL)
SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1 AS INT) AS item, name, 'Other' AS type, chunk_id AS source_id FROM d""",
    "parse_relations": f"""WITH {_LATEST}, n AS (SELECT chunk_id, regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\\b') AS a FROM cur),
f AS (SELECT chunk_id, unnest(a) AS name, unnest(range(len(a))) AS i FROM n), d AS (SELECT chunk_id, name, min(i) AS i FROM f GROUP BY ALL),
p AS (SELECT chunk_id, name AS source, lead(name) OVER w AS target, row_number() OVER w - 1 AS item FROM d WINDOW w AS (PARTITION BY chunk_id ORDER BY i))
SELECT chunk_id, CAST(item AS INT) AS item, source, target, 'near,beside' AS keywords FROM p WHERE target IS NOT NULL""",
    "entity_normalize": f"""WITH {_NAMES}, e AS (SELECT row_id, {_normal('name')} AS b FROM entities WHERE length(name) > 0)
SELECT row_id, coalesce(n.canonical, b) AS canonical FROM e LEFT JOIN names n ON n.folded = replace(lower(b), 'ß', 'ss')""",
    "relation_key_normalize": f"""WITH {_NAMES}, r AS (SELECT row_id, rel_key, string_split(rel_key, '||') AS p FROM relations WHERE rel_key IS NOT NULL),
s AS (SELECT *, {_normal('p[1]')} AS x, CASE WHEN len(p) = 2 THEN {_normal('p[2]')} END AS y FROM r),
t AS (SELECT s.*, coalesce(a.canonical, x) AS a, coalesce(b.canonical, y) AS b FROM s LEFT JOIN names a ON a.folded = replace(lower(x), 'ß', 'ss') LEFT JOIN names b ON b.folded = replace(lower(y), 'ß', 'ss'))
SELECT row_id, CASE WHEN len(p) <> 2 THEN {_collapse('rel_key')} WHEN replace(lower(a), 'ß', 'ss') <= replace(lower(b), 'ß', 'ss') THEN a || '||' || b ELSE b || '||' || a END AS canonical FROM t""",
    "set_metrics": f"""WITH {_INDEX}, {_GLOBAL}, {_NAMES},
got AS (SELECT DISTINCT t.qid, coalesce(n.canonical, {_normal('x.name')}) AS item FROM gends t JOIN en x USING (id) LEFT JOIN names n ON n.folded = replace(lower({_normal('x.name')}), 'ß', 'ss')),
want AS (SELECT DISTINCT qid, coalesce(n.canonical, {_normal('g')}) AS item FROM (SELECT id AS qid, unnest(gold_entities) AS g FROM gold_questions) LEFT JOIN names n ON n.folded = replace(lower({_normal('g')}), 'ß', 'ss')),
c AS (SELECT q.id AS qid, (SELECT count(*) FROM got JOIN want USING (qid, item) WHERE qid = q.id) AS matched_count,
  (SELECT count(*) FROM want WHERE qid = q.id) AS gold_count, (SELECT count(*) FROM got WHERE qid = q.id) AS retrieved_count FROM gold_questions q),
m AS (SELECT *, CASE WHEN gold_count = 0 THEN 0.0 ELSE matched_count / gold_count END AS recall, CASE WHEN retrieved_count = 0 THEN 0.0 ELSE matched_count / retrieved_count END AS precision FROM c)
SELECT qid, coalesce((SELECT string_agg(item, ';' ORDER BY item) FROM got JOIN want w USING (qid, item) WHERE w.qid = m.qid), '') AS matched, matched_count, gold_count, retrieved_count, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2 * recall * precision / (recall + precision) END, 6) AS f1, matched_count > 0 AS hit FROM m""",
    "evidence_metrics": f"""WITH {_EVAL} SELECT mode, qid, answer_points, retrieved_chunks, relevant_chunks, novel_chunks, first_relevant_rank, listed_chunks, matched_evidence, gold_evidence,
  matched_points, {', '.join(f'round({c}, 6) AS {c}' for c in _MACRO)}, redundant_chunks, chunk_hit FROM evald""",
    "summary_macro_micro": f"""WITH {_EVAL}, s AS (
  SELECT mode, count(*) AS questions, {', '.join(f'round(avg({c}), 6) AS macro_{c}' for c in _MACRO)}, round(avg(CAST(chunk_hit AS DOUBLE)), 6) AS macro_chunk_hit,
    sum(relevant_chunks) / sum(retrieved_chunks) AS p, sum(matched_evidence) / sum(gold_evidence) AS r, sum(matched_points) / sum(answer_points) AS a FROM evald GROUP BY mode)
SELECT * EXCLUDE (p, r, a), round(p, 6) AS micro_precision, round(r, 6) AS micro_evidence_recall, round(2 * p * r / (p + r), 6) AS micro_f1, round(a, 6) AS micro_answer_point_recall FROM s""",
}
