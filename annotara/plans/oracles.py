"""The queries of the catalogue as SQL over the same tables, written on its own."""

from __future__ import annotations

SQL: dict[str, str] = {}


def h(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den}) ELSE 0.0 END"


PRF = """round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1"""


def prf(tp: str, gold: str, system: str) -> str:
    return f"{ratio(tp, system)} AS p, {ratio(tp, gold)} AS r"


# -- retrieval

POOL = r"""
pool AS (SELECT doc_id AS row_idx, upper(lang) AS doctype, text, trim(regexp_replace(string_split(text, chr(10))[1], '[\x20\x09-\x0D]+', ' ', 'g')) AS title FROM documents),
tok AS (SELECT row_idx, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM pool),
tf AS (SELECT term, row_idx, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT row_idx, sum(tf) AS dl FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM pool) AS n, (SELECT sum(tf) FROM tf)::DOUBLE / (SELECT count(*) FROM pool) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words,
             ['EN', 'FR', 'DE', 'ES', 'XX'][(item_id % 5 + 1)::INT] AS qtype FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(words) AS term FROM q) GROUP BY ALL),
sc AS (SELECT item_id, row_idx, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (row_idx), st GROUP BY ALL)
"""
TOP = """top AS (SELECT * FROM (SELECT item_id, row_idx, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_idx) AS rank
       FROM (SELECT q.item_id, pool.row_idx, coalesce(sc.score, 0.0) AS score FROM q CROSS JOIN pool LEFT JOIN sc ON sc.item_id = q.item_id AND sc.row_idx = pool.row_idx)) WHERE rank <= 3)"""
SQL["bm25_topk"] = f"WITH {POOL}, {TOP} SELECT item_id, row_idx, score, rank FROM top"
TYPED = """typed AS (SELECT item_id, row_idx, score, rank FROM (
  SELECT q.item_id, pool.row_idx, coalesce(sc.score, 0.0) AS score, row_number() OVER (PARTITION BY q.item_id ORDER BY coalesce(sc.score, 0.0) DESC, pool.row_idx) AS rank
  FROM q JOIN pool ON doctype = qtype OR qtype NOT IN (SELECT DISTINCT doctype FROM pool) LEFT JOIN sc ON sc.item_id = q.item_id AND sc.row_idx = pool.row_idx) WHERE rank <= 3)"""
SQL["bm25_topk_doctype"] = f"WITH {POOL}, {TYPED} SELECT item_id, row_idx, score, rank FROM typed"
#: Queries of a word that no document has, alone or with the text's first words.
SPARSE = POOL.replace("regexp_extract_all(lower(text), '[a-z0-9]+') AS words", "regexp_extract_all('qqzz' || item_id || CASE WHEN item_id % 3 = 0 THEN ' ' || lower(text) ELSE '' END, '[a-z0-9]+')[:3] AS words")
SQL["bm25_topk_unshared"] = f"WITH {SPARSE}, {TOP} SELECT item_id, row_idx, score, rank FROM top"
SQL["bm25_topk_doctype_unshared"] = f"WITH {SPARSE}, {TYPED} SELECT item_id, row_idx, score, rank FROM typed"
SQL["bm25_corpus_stats"] = f"WITH {POOL} SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["resolution_mapping"] = f"""WITH {POOL}, {TOP}
SELECT item_id, arg_min(row_idx, rank) AS candidate_id, arg_min(score, rank) AS score, arg_min(title, rank) AS candidate_title,
       string_agg(row_idx || ':' || printf('%.6f', score), '|' ORDER BY rank) AS topk
FROM top JOIN pool USING (row_idx) GROUP BY item_id"""

DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COS = f"{DOT} / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def vectors(score: str, k: int = 3, where: str = "true") -> str:
    return f"""SELECT query_id, vec_id, score, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round({score}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({score}, 6) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {where}) WHERE rank <= {k}"""


SQL["vector_topk_cosine"] = vectors(COS)
SQL["vector_topk_blocks"] = vectors(COS)
SQL["vector_topk_dot"] = vectors(DOT)
SQL["vector_topk_label_filter"] = vectors(COS, where="a.label = b.label")
SQL["score_threshold_resolution"] = f"SELECT count(*) FILTER (score >= 0.9) AS resolved, count(*) FILTER (score < 0.9) AS unresolved FROM ({vectors(COS, 2)}) WHERE rank = 2"

# -- tokens

W = r"\p{L}\p{N}\p{M}_"
TOKEN = rf"""(<[^>]*>)|(\s+)|([.,;:!?()\[\]{{}}"''`‑–—])|([{W}]+)|([^{W}\s<>])"""
SQL["token_kind_counts"] = rf"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '{TOKEN}')) AS t FROM documents)
SELECT lang, CASE WHEN regexp_matches(t, '^<[^>]*>$') THEN 'tag' WHEN regexp_matches(t, '^\s') THEN 'space'
  WHEN regexp_matches(t, '^[.,;:!?()\[\]{{}}"''`‑–—]$') THEN 'punctuation' WHEN regexp_matches(t, '^[{W}]') THEN 'word' ELSE 'other' END AS kind,
  count(*) AS n, sum(length(t))::BIGINT AS chars FROM t GROUP BY ALL"""
SQL["token_freq_topk"] = rf"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents),
n AS (SELECT lang, token, count(*) AS n FROM t GROUP BY ALL)
SELECT * FROM (SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM n) WHERE rank <= 20"""
CLEAN = rf"regexp_extract_all(regexp_replace(html, '<[^>]*>', '', 'g'), '{TOKEN}')"
SQL["clean_token_counts"] = f"SELECT page_id, len({CLEAN})::BIGINT AS n_tokens FROM pages"
SQUEEZED = r"trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'))"
BODY = r"CASE WHEN regexp_extract(html, '(?is)<body\b.*</body>') <> '' THEN regexp_extract(html, '(?is)<body\b.*</body>') ELSE html END"
SQL["strip_tags_text_len"] = f"SELECT page_id, length({SQUEEZED.format(f'regexp_replace({BODY}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS n_chars FROM pages"
SQL["tag_name_counts"] = r"""
WITH t AS (SELECT unnest(regexp_extract_all(html, '<[^>]*>')) AS t FROM pages)
SELECT lower(trim(regexp_replace(regexp_replace(t, '^</?|/?>$', '', 'g'), '\s+[^\s=]+\s*=[\s\S]*$', ''))) AS tag, t LIKE '</%' AS closing, count(*) AS n FROM t WHERE length(t) >= 3 GROUP BY ALL"""
SQL["whitespace_normalise"] = rf"SELECT page_id, md5(array_to_string(list_transform({CLEAN}, lambda t: CASE WHEN regexp_matches(t, '^\s\s+$') THEN ' ' ELSE t END), '')) AS digest FROM pages"
SQL["upper_context_window"] = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents),
p AS (SELECT doc_id, t, doc_id * 7919 % greatest(len(t), 1) + 1 AS pos FROM t)
SELECT doc_id, array_to_string(t[greatest(pos - 20, 1):pos - 1], '') AS context FROM p"""
SQL["word_counts_by_split"] = r"SELECT source AS split, count(*) AS documents, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS words FROM documents GROUP BY 1"

# -- spans

LABELS = "['decision', 'legislation', 'secondary sources', 'title', 'citation', 'fragment', 'source', 'authors']"
PARENTS = "('decision', 'legislation', 'secondary sources')"
LINES = rf"""
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
lines AS (SELECT doc_id, seq, {SQUEEZED.format('line')} AS norm FROM raw_lines WHERE {SQUEEZED.format('line')} <> '')"""
GOLD = f"""{LINES},
hashed AS (SELECT *, doc_id || ':' || seq AS k, {h("doc_id || ':' || seq")} AS h FROM lines),
gold AS (SELECT doc_id, seq, {LABELS}[(h % 8 + 1)::INT] AS labelname, norm AS text, lower(norm) AS context,
  'D' || (h // 8 % 20) AS docid, CASE WHEN h % 8 > 2 THEN NULL WHEN h % 11 = 0 THEN 'none' ELSE 'https://ex.org/' || (h % 50) END AS uri, 't' || (h % 3) AS titletype, h, k FROM hashed)"""


def system(name: str, salt: str) -> str:
    return f"""{name}_e AS (SELECT *, {h(f"k || '{salt}'")} % 10 AS e FROM gold),
{name} AS (SELECT doc_id, seq, CASE WHEN e = 1 THEN {LABELS}[((h + 1) % 8 + 1)::INT] ELSE labelname END AS labelname,
  CASE WHEN e = 2 THEN substr(text, 1, 20) ELSE text END AS text, context, docid,
  CASE WHEN e = 3 THEN uri || 'x' WHEN e = 4 THEN NULL ELSE uri END AS uri,
  CASE WHEN e = 5 THEN upper(titletype) WHEN e = 6 THEN 't9' ELSE titletype END AS titletype FROM {name}_e WHERE e <> 0
  UNION ALL SELECT doc_id, seq + 100000, labelname, 'spurious ' || seq, context, docid, uri, titletype FROM gold WHERE h % 17 = 0)"""


def numbered(name: str, of: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, labelname, text, context ORDER BY seq) AS nth FROM {of})"


KEYS = "doc_id, labelname, text, context"


def counts(gold: str, sys: str, name: str = "counts") -> str:
    return f"""{name} AS (SELECT doc_id, labelname, sum(least(g, s))::BIGINT AS tp, sum(g)::BIGINT AS n_gold, sum(s)::BIGINT AS n_system FROM
  (SELECT {KEYS}, sum(g) AS g, sum(s) AS s FROM (SELECT {KEYS}, 1 AS g, 0 AS s FROM {gold} UNION ALL SELECT {KEYS}, 0, 1 FROM {sys}) GROUP BY ALL) GROUP BY ALL)"""


SPANS = f"{GOLD}, {system('sys', 's')}"
COUNTS = f"WITH {SPANS}, {counts('gold', 'sys')}"
SUMS = "sum(tp)::BIGINT AS tp, sum(n_gold)::BIGINT AS n_gold, sum(n_system)::BIGINT AS n_system"
SQL["span_match_counts"] = f"{COUNTS} SELECT * FROM counts"


def scored(keys: str) -> str:
    return f"{COUNTS}, t AS (SELECT {keys}, {SUMS} FROM counts GROUP BY ALL), u AS (SELECT *, {prf('tp', 'n_gold', 'n_system')} FROM t) SELECT * EXCLUDE (p, r), {PRF} FROM u"


SQL["span_prf_per_label"] = scored("labelname")
SQL["span_prf_per_doc"] = scored("doc_id")
SQL["span_prf_rollup"] = f"""{COUNTS},
c AS (SELECT doc_id::VARCHAR AS doc, labelname, CASE WHEN labelname IN {PARENTS} THEN 'parent' ELSE 'child' END AS level, tp, n_gold, n_system FROM counts),
t AS (SELECT 'all' AS doc, 'all' AS labelname, 'all' AS level, {SUMS} FROM c UNION ALL SELECT doc, 'all', 'all', {SUMS} FROM c GROUP BY doc
  UNION ALL SELECT 'all', labelname, 'all', {SUMS} FROM c GROUP BY labelname UNION ALL SELECT 'all', 'all', level, {SUMS} FROM c GROUP BY level),
u AS (SELECT *, {prf('tp', 'n_gold', 'n_system')} FROM t) SELECT doc, labelname, level, tp, n_gold, n_system, {PRF} FROM u"""
SQL["span_macro_f1"] = f"""{COUNTS}, t AS (SELECT doc_id, {SUMS} FROM counts GROUP BY 1), u AS (SELECT {prf('tp', 'n_gold', 'n_system')} FROM t)
SELECT round(avg({ratio('2 * p * r', 'p + r')}), 6) AS macro_f1, count(*) AS documents FROM u"""


def anti(a: str, b: str) -> str:
    return f"SELECT a.doc_id, a.seq, a.labelname, a.text FROM {a} a ANTI JOIN {b} b USING (doc_id, labelname, text, context, nth)"


NUMBERED = f"WITH {SPANS}, {numbered('gn', 'gold')}, {numbered('sn', 'sys')}"
SQL["span_fn"] = f"{NUMBERED} {anti('gn', 'sn')}"
SQL["span_fp"] = f"{NUMBERED} {anti('sn', 'gn')}"
SQL["anchoring_rate"] = f"""{NUMBERED}, {system('llm', 'l')},
extra AS (SELECT a.* FROM sn a ANTI JOIN gn b USING (doc_id, labelname, text, context, nth)), {counts('llm', 'extra')},
t AS (SELECT labelname, sum(tp)::BIGINT AS anchored, sum(n_system)::BIGINT AS extra FROM counts GROUP BY 1)
SELECT *, round({ratio('anchored', 'extra')}, 6) AS rate FROM t WHERE extra > 0"""
ATTRIBUTES = f"""{NUMBERED},
m AS (SELECT g.doc_id, g.labelname, g.docid AS gd, s.docid AS sd, g.uri AS gu, s.uri AS su, g.titletype AS gt, s.titletype AS ss FROM gn g JOIN sn s USING (doc_id, labelname, text, context, nth)),
a AS (SELECT doc_id, labelname, 'docid' AS attr, gd AS g, sd AS s FROM m UNION ALL SELECT doc_id, labelname, 'uri', gu, su FROM m UNION ALL SELECT doc_id, labelname, 'titletype', gt, ss FROM m),
rows AS (SELECT doc_id, labelname, attr, coalesce(lower(trim(g)) = lower(trim(s)), false)::INT AS agree FROM a WHERE g IS NOT NULL OR s IS NOT NULL)"""
AGREE = "sum(agree)::BIGINT AS agree, count(*) AS total, round(sum(agree)::DOUBLE / count(*), 6) AS accuracy"
CATEGORY = f"CASE WHEN labelname IN {PARENTS} THEN labelname ELSE 'other' END AS category"
SQL["attr_agreement_by_label_attr"] = f"{ATTRIBUTES} SELECT labelname, attr, {AGREE} FROM rows GROUP BY ALL"
SQL["attr_agreement_by_category"] = f"{ATTRIBUTES} SELECT {CATEGORY}, attr, {AGREE} FROM rows GROUP BY ALL"
SQL["attr_macro"] = f"{ATTRIBUTES} SELECT round(avg(a), 6) AS macro_accuracy, count(*) AS documents FROM (SELECT avg(agree) AS a FROM rows GROUP BY doc_id)"
OUTCOMES = f"""{NUMBERED},
o AS (SELECT g.doc_id, g.labelname, CASE WHEN g.uri IS NULL OR lower(trim(g.uri)) IN ('', 'none') THEN 'skipped_gold_none' WHEN s.doc_id IS NULL THEN 'fn_missed_extraction'
    WHEN trim(coalesce(s.uri, '')) = '' THEN 'fn_missing_sys_uri' WHEN lower(trim(g.uri)) = lower(trim(s.uri)) THEN 'tp' ELSE 'fn_wrong' END AS outcome
  FROM gn g LEFT JOIN sn s USING (doc_id, labelname, text, context, nth)
  UNION ALL SELECT a.doc_id, a.labelname, 'fp_spurious' FROM sn a ANTI JOIN gn b USING (doc_id, labelname, text, context, nth) WHERE a.uri IS NOT NULL AND lower(trim(a.uri)) NOT IN ('', 'none'))"""
SQL["uri_outcomes"] = f"{OUTCOMES} SELECT labelname, outcome, count(*) AS n FROM o GROUP BY ALL"


def uri_scores(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    names = ("tp", "fn_wrong", "fn_missing_sys_uri", "fn_missed_extraction", "fp_spurious", "skipped_gold_none")
    n = ", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in names)
    return f"""{OUTCOMES}, c AS (SELECT {k}{n} FROM (SELECT *, {CATEGORY} FROM o) {f'GROUP BY {keys}' if keys else ''}),
u AS (SELECT *, {ratio('tp', 'tp + fn_wrong + fp_spurious')} AS p, {ratio('tp', 'tp + fn_wrong + fn_missing_sys_uri + fn_missed_extraction')} AS r FROM c)
SELECT * EXCLUDE (p, r), {PRF}, round({ratio('tp', 'tp + fn_wrong')}, 6) AS accuracy FROM u"""


SQL["uri_prf_overall"] = uri_scores("")
SQL["uri_prf_by_category"] = uri_scores("category")

# -- links and metadata


def audit(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '^http://', 'https://'), '^https://www\\.', 'https://'), '/+$', '')"


SQL["uri_audit_missing"] = f"""
WITH l AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN upper(url) || '/' WHEN 1 THEN url || '/missing' ELSE 'None' END AS uri FROM pages)
SELECT page_id, uri FROM l WHERE lower(trim(uri)) NOT IN ('', 'none', 'null', 'nan') AND {audit('uri')} NOT IN (SELECT {audit('url')} FROM pages)"""
SQL["uri_unique_counts"] = f"""WITH {GOLD}, r AS (SELECT uri, coalesce(lower(trim(uri)) NOT IN ('', 'none'), false) AS real FROM gold)
SELECT count(*) AS total, count(*) FILTER (NOT real) AS without, count(*) FILTER (real) AS with_uri, count(DISTINCT uri) FILTER (real) AS unique_uris FROM r"""
SQL["uri_path_normalise"] = r"""
WITH p AS (SELECT url, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT CASE WHEN path <> '' THEN path ELSE url END AS path, min(url) AS first_url, count(*) AS urls FROM p GROUP BY 1"""
SQL["pool_combine_shuffle"] = """
WITH u AS (SELECT 'benchmark/' || item_id AS url, 'benchmark' AS pool FROM benchmark UNION ALL SELECT 'documents/' || doc_id, 'documents' FROM documents)
SELECT url, pool, row_number() OVER (ORDER BY md5('42:' || url), url) AS rank FROM u"""
SQL["metadata_json_explode"] = "SELECT event_type, (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL"
SQL["range_slice"] = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n BETWEEN 11 AND 60"

# -- registry

MENTIONS = """
w AS (SELECT conv_id AS doc_id, turn AS mention_id, role AS doc_type, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
mentions AS (SELECT doc_id, mention_id, substr(w[1], 1, 1) AS docid, doc_type, w[2] AS title, w[3] AS citation, CASE WHEN len(w) > 3 THEN array_to_string(w[4:], ' ') END AS fragment FROM w WHERE len(w) > 0)"""
VALUES = f"""{MENTIONS},
v AS (SELECT doc_id, docid, mention_id, 'title' AS field, title AS value FROM mentions UNION ALL SELECT doc_id, docid, mention_id, 'citation', citation FROM mentions
  UNION ALL SELECT doc_id, docid, mention_id, 'fragment', fragment FROM mentions),
f AS (SELECT doc_id, docid, field, value, min(mention_id) AS first_seen_id FROM v WHERE trim(coalesce(value, '')) <> '' GROUP BY ALL),
vals AS (SELECT *, row_number() OVER (PARTITION BY doc_id, docid, field ORDER BY first_seen_id, value) AS ord FROM f)"""
PROFILES = f"""{VALUES},
base AS (SELECT doc_id, docid, arg_min(doc_type, mention_id) AS doc_type, min(mention_id) AS first_seen_id, count(*) AS n_mentions FROM mentions GROUP BY doc_id, docid),
lists AS (SELECT doc_id, docid, {', '.join(f"string_agg(value || '@' || first_seen_id, '|' ORDER BY ord) FILTER (field = '{f}') AS {f}s, list(value ORDER BY ord) FILTER (field = '{f}') AS {f}_list, list(value || '@' || first_seen_id ORDER BY ord) FILTER (field = '{f}') AS {f}_at" for f in ('title', 'citation', 'fragment'))} FROM vals GROUP BY ALL),
profiles AS (SELECT base.*, title_list[1] AS main_title, coalesce(titles, '') AS titles, coalesce(citations, '') AS citations, coalesce(fragments, '') AS fragments, title_list, citation_list, fragment_list, fragment_at
  FROM base LEFT JOIN lists USING (doc_id, docid))"""
SQL["registry_values_first_seen"] = f"WITH {VALUES} SELECT doc_id, 'd:' || docid AS profile, field, value, first_seen_id, ord FROM vals"
SQL["registry_profiles"] = f"WITH {PROFILES} SELECT doc_id, docid, doc_type, first_seen_id, n_mentions, main_title, titles, citations, fragments FROM profiles"
SQL["registry_snapshot_before"] = f"""WITH {VALUES}, p AS (SELECT doc_id, docid, min(mention_id) AS first_seen_id FROM mentions GROUP BY ALL)
SELECT doc_id, mention_id, (SELECT count(*) FROM p WHERE p.doc_id = m.doc_id AND p.first_seen_id < m.mention_id) AS profiles_before,
  (SELECT count(*) FROM vals WHERE vals.doc_id = m.doc_id AND vals.first_seen_id < m.mention_id) AS values_before FROM mentions m"""
SQL["registry_query_text"] = f"""WITH {PROFILES} SELECT doc_id, docid, array_to_string(list_filter(list_concat([doc_type, main_title],
  coalesce(title_list[2:], []), coalesce(citation_list, []), CASE WHEN fragment_list IS NULL THEN [] ELSE ['[' || array_to_string(fragment_list, ', ') || ']'] END), lambda x: coalesce(x, '') <> ''), ' | ') AS query_text FROM profiles"""
SQL["registry_last_fragments"] = f"WITH {PROFILES} SELECT doc_id, docid, coalesce(array_to_string(fragment_at[greatest(len(fragment_at) - 1, 1):len(fragment_at)], '|'), '') AS fragments FROM profiles"

# -- clusters

SQL["clusters_from_mapping"] = f"""WITH {MENTIONS}, k AS (SELECT doc_id, mention_id, CASE WHEN mention_id % 5 <> 4 THEN 'd:' || docid ELSE 'm:' || mention_id END AS cluster FROM mentions)
SELECT doc_id, cluster, string_agg(mention_id::VARCHAR, ',' ORDER BY mention_id) AS members, count(*) AS size FROM k GROUP BY ALL"""


def coref(of: str, drop: bool) -> str:
    label = "label % 10" if of == "10" else f"vec_id % {of}"
    return f"""e AS (SELECT vec_id // 50 AS doc_id, vec_id AS mention_id, {label} AS label, {h('vec_id::VARCHAR')} AS h FROM embeddings),
cg AS (SELECT doc_id, mention_id, label AS cluster FROM e {'WHERE h % 13 <> 1' if drop else ''}),
cs AS (SELECT doc_id, mention_id, CASE WHEN h % 5 = 0 THEN (label + 1) % {of} ELSE label END AS cluster FROM e {'WHERE h % 13 <> 0' if drop else ''}),
pair AS (SELECT doc_id, mention_id, cg.cluster AS gold, cs.cluster AS system FROM cg FULL JOIN cs USING (doc_id, mention_id))"""


SQL["mention_alignment_stats"] = f"""WITH {coref('10', True)}, t AS (SELECT doc_id, count(gold) AS n_gold, count(system) AS n_system, count(*) FILTER (gold IS NOT NULL AND system IS NOT NULL) AS matched FROM pair GROUP BY 1),
u AS (SELECT *, {prf('matched', 'n_gold', 'n_system')} FROM t) SELECT * EXCLUDE (p, r), {PRF} FROM u"""


def side(name: str, this: str, other: str) -> str:
    return f"""{name}_o AS (SELECT doc_id, {other}, sum(n) AS osize FROM tab GROUP BY ALL),
{name}_c AS (SELECT doc_id, {this} AS c, sum(n) AS size, count(*) AS parts, sum(n * n) AS sq, sum(n * (n - 1) / 2) AS links, max((osize = 1)::INT) AS alone FROM tab JOIN {name}_o USING (doc_id, {other}) GROUP BY ALL),
{name} AS (SELECT doc_id, sum(size - parts)::DOUBLE AS muc_num, sum(size - 1)::DOUBLE AS muc_den, sum(sq::DOUBLE / size) AS b3_num, sum(size)::DOUBLE AS b3_den,
  sum(size * CASE WHEN size = 1 THEN alone::DOUBLE ELSE links / (size * (size - 1) / 2) END) AS lea_num, sum(size)::DOUBLE AS lea_den FROM {name}_c GROUP BY 1)"""


LINKS = f"""WITH {coref('10', True)}, sp AS (SELECT doc_id, coalesce(gold::VARCHAR, 'only:' || mention_id) AS gold, coalesce(system::VARCHAR, 'only:' || mention_id) AS system FROM pair),
tab AS (SELECT doc_id, gold, system, count(*) AS n FROM sp GROUP BY ALL), {side('rec', 'gold', 'system')}, {side('pre', 'system', 'gold')}"""


def finalised(metric: str) -> str:
    return f"""{LINKS}, t AS (SELECT doc_id, pre.{metric}_num AS p_num, pre.{metric}_den AS p_den, rec.{metric}_num AS r_num, rec.{metric}_den AS r_den FROM pre JOIN rec USING (doc_id)),
u AS (SELECT *, {ratio('p_num', 'p_den')} AS p, {ratio('r_num', 'r_den')} AS r FROM t)
SELECT doc_id, round(p_num, 6) AS p_num, round(p_den, 6) AS p_den, round(r_num, 6) AS r_num, round(r_den, 6) AS r_den, {PRF} FROM u"""


for _m in ("muc", "b3", "lea"):
    SQL[f"coref_{_m}"] = finalised(_m)
SQL["coref_micro_conll_parts"] = f"""{LINKS}, t AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, sum(pre.{m}_num) AS p_num, sum(pre.{m}_den) AS p_den, sum(rec.{m}_num) AS r_num, sum(rec.{m}_den) AS r_den FROM pre JOIN rec USING (doc_id)" for m in ('muc', 'b3', 'lea'))}),
u AS (SELECT metric, {ratio('p_num', 'p_den')} AS p, {ratio('r_num', 'r_den')} AS r FROM t) SELECT metric, {PRF} FROM u"""
SQL["coref_ceafe"] = f"""WITH RECURSIVE {coref('6', False)}, tab AS (SELECT doc_id, gold, system, count(*) AS n FROM pair GROUP BY ALL),
gs AS (SELECT doc_id, gold, sum(n) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY gold) AS i FROM tab GROUP BY doc_id, gold),
ss AS (SELECT doc_id, system, sum(n) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY system) AS j FROM tab GROUP BY doc_id, system),
phi AS (SELECT gs.doc_id, i, j, coalesce(2.0 * tab.n / (gs.n + ss.n), 0.0)::DOUBLE AS v FROM gs JOIN ss USING (doc_id) LEFT JOIN tab ON tab.doc_id = gs.doc_id AND tab.gold = gs.gold AND tab.system = ss.system),
state AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS mask, 0.0::DOUBLE AS total FROM gs
  UNION ALL SELECT doc_id, i, mask, max(total) AS total FROM (
    SELECT s.doc_id, s.i + 1 AS i, s.mask | (1 << (p.j - 1)::INT)::BIGINT AS mask, s.total + p.v AS total FROM state s JOIN phi p ON p.doc_id = s.doc_id AND p.i = s.i + 1 WHERE (s.mask & (1 << (p.j - 1)::INT)::BIGINT) = 0
    UNION ALL SELECT s.doc_id, s.i + 1, s.mask, s.total FROM state s JOIN gs ON gs.doc_id = s.doc_id AND gs.i = s.i + 1) GROUP BY ALL),
best AS (SELECT doc_id, max(total) AS num FROM state GROUP BY 1),
t AS (SELECT doc_id, num AS p_num, (SELECT count(*) FROM ss WHERE ss.doc_id = best.doc_id)::DOUBLE AS p_den, num AS r_num, (SELECT count(*) FROM gs WHERE gs.doc_id = best.doc_id)::DOUBLE AS r_den FROM best),
u AS (SELECT *, {ratio('p_num', 'p_den')} AS p, {ratio('r_num', 'r_den')} AS r FROM t)
SELECT doc_id, round(p_num, 6) AS p_num, p_den, round(r_num, 6) AS r_num, r_den, {PRF} FROM u"""

# -- chunks

SQL["chunk_paragraph_merge"] = f"""WITH RECURSIVE {LINES},
s AS (SELECT doc_id, len(string_split(norm, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM lines),
fold AS (SELECT doc_id, i, n::BIGINT AS size, 0::BIGINT AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN f.size >= 100 THEN s.n ELSE f.size + s.n END, f.chunk + (f.size >= 100)::INT FROM fold f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
SELECT fold.doc_id, chunk, count(*) AS paragraphs, sum(n)::BIGINT AS tokens FROM fold JOIN s USING (doc_id, i) GROUP BY ALL"""
SQL["citation_sections"] = rf"""WITH RECURSIVE {LINES},
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i,
  CASE WHEN length(norm) < 10 THEN 0.0 ELSE 100.0 * length(regexp_replace(norm, '[^.0-9]', '', 'g')) / length(norm) END >= 4.0 AS dense FROM lines),
fold AS (SELECT doc_id, -1::BIGINT AS i, NULL::BIGINT AS first, NULL::BIGINT AS last, 0 AS below, false AS closed FROM (SELECT DISTINCT doc_id FROM s)
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN f.first IS NULL AND dense AND NOT closed THEN s.i ELSE f.first END, CASE WHEN dense AND NOT closed THEN s.i ELSE f.last END,
    CASE WHEN dense AND NOT closed THEN 0 WHEN f.first IS NOT NULL AND NOT closed THEN below + 1 ELSE below END,
    closed OR (f.first IS NOT NULL AND NOT dense AND below + 1 >= 3) FROM fold f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
SELECT doc_id, max(first) AS first, max(last) AS last FROM fold GROUP BY doc_id HAVING max(first) IS NOT NULL"""

# -- patterns


def frequencies(rows: str) -> str:
    return f"""{rows}, n AS (SELECT key, pattern, count(*) AS n, min(seq) AS first FROM rows GROUP BY ALL),
s AS (SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY key), 2) AS score FROM n)
SELECT key, pattern, n, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, first) AS rank FROM s"""


SQL["pattern_fragment_freq"] = frequencies("""WITH rows AS (SELECT p_brand AS key, p_partkey AS seq,
  ['SECTION', 'SECTION', 'SECTION', 'PARA', 'ARTICLE', 'PP', 'RULE', 'SCHEDULE ROMAN ,'][(p_partkey % 8 + 1)::INT] || ' ' ||
  CASE p_partkey % 3 WHEN 0 THEN 'NUM(PAREN)' WHEN 1 THEN 'NUM.NUM' ELSE 'NUM TO NUM' END AS pattern FROM part)""")
CITATION = "'[' || (p_size + 1950) || '] ' || ['2 S.C.R. ', 'SCC ', 'O.R. (2d) ', 'CanLII '][(p_partkey % 4 + 1)::INT] || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' (C.A.)' ELSE '' END"
for _pattern, _new in (
    (r"\(\s*\d+(?:st|nd|rd|d|th)\s*\)", "(ORDINAL)"), (r"\[\s*(19|20)\d{2}\s*\]", "YEAR"), (r"\b(CanLII|[A-Z]{2,4}(?:CA|CS|SC|QB|KB|HCJ|PC)?)\s+(\d+)\b", "TRIBUNAL NUM"), (r"\b(19|20)\d{2}\b", "YEAR"),
    (r"\(\s*[A-Z][a-zA-Z.]*\.(?:\s*[A-Z][a-zA-Z.]*\.?)*\s*\)", "(COURT)"), (r"\b[A-Z](?:\.[A-Z]){1,5}\.?\b", "REPORTER"), (r"\b\d+\b", "NUM"),
):
    CITATION = f"regexp_replace({CITATION}, '{_pattern}', '{_new}', 'g')"
SQL["pattern_citation_freq"] = frequencies(f"WITH rows AS (SELECT p_brand AS key, p_partkey AS seq, {CITATION} AS pattern FROM part)")
SQL["pattern_title_freq"] = frequencies("""WITH rows AS (SELECT p_brand AS key, p_partkey AS seq,
  ['PARTY V PARTY', 'PARTY V PARTY', 'PARTY CASE_SEP PARTY', 'PARTY'][(p_partkey % 4 + 1)::INT] || CASE WHEN p_partkey % 4 = 3 THEN ' YEAR' ELSE '' END AS pattern FROM part)""")
SQL["structural_pattern_freq"] = frequencies("""WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
rows AS (SELECT 'conversation' AS key, string_agg(role, ' > ' ORDER BY turn) AS pattern, conv_id AS seq FROM l WHERE before IS NULL OR before <> role GROUP BY conv_id)""")
ITEMS = """items AS (SELECT doc_id AS example, unnest(['lang=' || lang, 'source=' || source, 'size=' || (n_chars // 1000)]) AS item FROM documents),
weights AS (SELECT item, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 2) AS weight FROM items GROUP BY 1)"""


def step(i: int) -> str:
    before = " UNION ALL ".join(f"SELECT example FROM s{j}" for j in range(1, i))
    left = f"WHERE item NOT IN (SELECT item FROM items WHERE example IN ({before}))" if before else ""
    return f"s{i} AS (SELECT example, round(sum(weight), 6) AS gain FROM items JOIN weights USING (item) {left} GROUP BY 1 ORDER BY gain DESC, example LIMIT 1)"


SQL["greedy_coverage_3"] = f"WITH {ITEMS}, {step(1)}, {step(2)}, {step(3)} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS step, example, gain FROM s{i}" for i in (1, 2, 3))
SQL["coverage_curve"] = f"""WITH {ITEMS}, f AS (SELECT item, min(example) AS step FROM items GROUP BY 1),
g AS (SELECT step, sum(weight) AS gain FROM f JOIN weights USING (item) GROUP BY 1)
SELECT step, round(sum(coalesce(gain, 0.0)) OVER (ORDER BY step), 6) AS covered FROM (SELECT DISTINCT example AS step FROM items) LEFT JOIN g USING (step)"""

# -- statistics

SQL["bootstrap_micro_f1"] = f"""{COUNTS}, docs AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS nth FROM (SELECT doc_id, {SUMS} FROM counts GROUP BY 1)),
n AS (SELECT count(*) AS n FROM docs), drawn AS (SELECT b, {h("b || '|' || i || '|42'")} % n + 1 AS nth FROM range(200) x(b), range((SELECT n FROM n)) y(i), n),
f AS (SELECT b, round({ratio('2.0 * sum(tp)', 'sum(n_gold) + sum(n_system)')}, 9) AS f1 FROM drawn JOIN docs USING (nth) GROUP BY 1)
SELECT (SELECT round({ratio('2.0 * sum(tp)', 'sum(n_gold) + sum(n_system)')}, 6) FROM docs) AS f1, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high FROM f"""
SQL["productivity_rates"] = f"""WITH d AS (SELECT user_id, user_id % 4 AS team, count(*) AS words, count(*) FILTER (event_type = 'purchase') AS spans, round(sum(value) / 3600, 9) AS hours FROM events GROUP BY user_id)
SELECT team, count(*) AS documents, round({ratio('sum(words)', 'sum(hours)')}, 4) AS words_per_hour, round({ratio('sum(spans)', 'sum(hours)')}, 4) AS spans_per_hour,
  round(avg(CASE WHEN hours > 0 THEN words / hours END), 4) AS mean_words_per_hour, round(avg(CASE WHEN hours > 0 THEN spans / hours END), 4) AS mean_spans_per_hour FROM d GROUP BY team"""
SQL["component_coverage"] = """SELECT role AS kind, count(DISTINCT conv_id) AS covered, (SELECT count(DISTINCT conv_id) FROM conversations) AS parents,
  round(count(DISTINCT conv_id) * 100.0::DOUBLE / (SELECT count(DISTINCT conv_id) FROM conversations), 4) AS percent FROM conversations GROUP BY 1"""
SQL["label_distribution_pivot"] = "SELECT lang, count(*) FILTER (quality = 0) AS low, count(*) FILTER (quality = 1) AS high FROM labels JOIN documents USING (doc_id) GROUP BY 1"
SQL["label_totals_rollup"] = "SELECT coalesce(lang, 'all') AS lang, coalesce(toxic::VARCHAR, 'all') AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, toxic)"
SQL["history_summary"] = """WITH r AS (SELECT CASE WHEN event_type <> 'purchase' THEN event_type ELSE 'none' END AS error_type, event_id % 3 = 0 AS used, value > 50 AS ok FROM events)
SELECT error_type, count(*) AS chunks, count(*) FILTER (used) AS fallbacks, count(*) FILTER (used AND ok) AS recovered FROM r GROUP BY 1"""
