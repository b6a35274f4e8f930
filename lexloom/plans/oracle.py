"""DuckDB SQL of the queries, written apart from their Spark plans."""

from __future__ import annotations

from lexloom.functions.text import GENERAL_STOPWORDS, STOPWORDS
from lexloom.operators.answers import FALLBACK, PADDING
from lexloom.operators.dedup import BANDS, CONSTANTS, HASHES, PRIME

_P = r"[!-/:-@\[-`{-~]"


def _toks(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '{_P}', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_BASE = f"""
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_toks('text')}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, len({_toks('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_toks('text')}) AS term FROM benchmark) GROUP BY ALL)"""
_BM = "qtf * log10(n / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))"


def _top(scores: str, k: int, extra: str = "") -> str:
    return f"SELECT query_id, doc_id, score, rank{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM ({scores})) WHERE rank <= {k}"


_BM25 = f"SELECT query_id, doc_id, round(sum({_BM}), 5) AS score FROM p JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL"


def _vsm(scheme: str) -> str:
    d, q = scheme.split(".")
    tf = lambda c, k: f"{c}::DOUBLE" if k == "n" else f"(1 + log10({c}))"
    idf = lambda k: "idf" if k == "t" else "1.0"
    norm = lambda c, k: f"/ CASE WHEN {c} > 0 THEN {c} ELSE 1 END" if k == "c" else ""
    return f"""WITH {_BASE}, qw AS (SELECT query_id, term, idf, {tf('qtf', q[0])} * {idf(q[1])} AS wq FROM (SELECT query_id, term, qtf, CASE WHEN df IS NULL THEN 0.0 ELSE log10(n / df) END AS idf FROM q LEFT JOIN df USING (term), st)),
nq AS (SELECT query_id, sqrt(sum(wq * wq)) AS nq FROM qw GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(wd * wq) AS s, sqrt(sum(wd * wd)) AS nd FROM (SELECT query_id, doc_id, wq, {tf('tf', d[0])} * {idf(d[1])} AS wd FROM p JOIN qw USING (term)) GROUP BY ALL)
{_top(f"SELECT query_id, doc_id, round(s {norm('nd', d[2])} {norm('nq', q[2])}, 5) AS score FROM s JOIN nq USING (query_id)", 10)}"""


def _lm(kind: str) -> str:
    """Over all documents with one of the words and all of the query's words, as the definition says."""
    prob = {
        "naive": "CASE WHEN tf IS NULL THEN cf / c ELSE tf / dl END",
        "bayes": "(coalesce(tf, 0) + 0.5 * c * cf / c) / (dl + 0.5 * c)",
        "mixture": "0.5 * coalesce(tf, 0) / dl + 0.5 * cf / c",
    }[kind]
    return f"""WITH {_BASE}, tot AS (SELECT sum(tf) AS c FROM p), bad AS (SELECT query_id, count(*) FILTER (cf IS NULL) AS unseen FROM q LEFT JOIN df USING (term) GROUP BY 1),
cand AS (SELECT DISTINCT query_id, doc_id FROM p JOIN q USING (term)),
s AS (SELECT cand.query_id, cand.doc_id, sum(qtf * ln({prob})) AS s FROM cand JOIN q USING (query_id) JOIN df USING (term) JOIN dl ON dl.doc_id = cand.doc_id LEFT JOIN p ON p.doc_id = cand.doc_id AND p.term = q.term, tot GROUP BY ALL)
{_top("SELECT query_id, doc_id, CASE WHEN unseen > 0 THEN -9999.0 ELSE round(s, 4) END AS score FROM s JOIN bad USING (query_id)", 10)}"""


_FIELDS = f"""
f AS (SELECT doc_id, 'description' AS field, {_toks('text')} AS w FROM documents UNION ALL SELECT doc_id, 'genres', {_toks('lang')} FROM documents UNION ALL SELECT doc_id, 'characters', {_toks('source')} FROM documents),
fp AS (SELECT field, term, doc_id, count(*) AS tf FROM (SELECT field, doc_id, unnest(w) AS term FROM f) GROUP BY ALL),
fdl AS (SELECT field, doc_id, len(w)::BIGINT AS dl FROM f),
fst AS (SELECT field, count(*) AS n, avg(dl) AS avg_dl FROM fdl GROUP BY 1),
fdf AS (SELECT field, term, count(*) AS df FROM fp GROUP BY ALL),
fq AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_toks("text || ' en src1'")}) AS term FROM benchmark) GROUP BY ALL)"""


def _fielded(part: str) -> str:
    weight = "CASE field WHEN 'description' THEN 0.4 ELSE 0.3 END"
    return f"""WITH {_FIELDS}, s AS (SELECT field, query_id, doc_id, round(sum({part}), 5) AS s FROM fp JOIN fq USING (term) JOIN fdf USING (field, term) JOIN fdl USING (field, doc_id) JOIN fst USING (field) GROUP BY ALL)
{_top(f"SELECT query_id, doc_id, round(sum(s::DECIMAL(20, 5) * {weight}), 4)::DOUBLE AS score FROM s GROUP BY ALL", 10)}"""


_TIER = "CASE field WHEN 'characters' THEN CASE WHEN tf >= 3 THEN 1 WHEN tf >= 2 THEN 2 ELSE 3 END WHEN 'genres' THEN 1 ELSE CASE WHEN tf >= 10 THEN 1 WHEN tf >= 5 THEN 2 ELSE 3 END END"
_SH = f"""
w AS (SELECT doc_id, {_toks('text')} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w))"""
_SIG = f"""{_SH}, x AS (SELECT doc_id, ('0x' || substr(md5(shingle), 1, 7))::BIGINT AS x FROM sh),
sig AS (SELECT doc_id, {', '.join(f'min((x * {a} + {b}) % {PRIME}) AS h{i}' for i, (a, b) in enumerate(CONSTANTS))} FROM x GROUP BY doc_id)"""
_ROWS = HASHES // BANDS
_BANDS = f"""{_SIG}, bands AS ({' UNION ALL '.join(f"SELECT doc_id, {b} AS band, concat_ws('_', {', '.join(f'h{b * _ROWS + r}' for r in range(_ROWS))}) AS sig FROM sig" for b in range(BANDS))}),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.sig = y.sig AND x.doc_id < y.doc_id)"""

_GRAMS = "list_distinct(list_transform(range(1, len(word) + 2), lambda i: substr('$' || word || '$', i, 2)))"
_SPELL = f"""
vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS word FROM documents) GROUP BY 1),
unknown AS (SELECT DISTINCT word FROM (SELECT unnest({_toks('text')}) AS word FROM benchmark) WHERE word NOT IN (SELECT word FROM vocab)),
ug AS (SELECT word, unnest({_GRAMS}) AS gram, len({_GRAMS}) AS m FROM unknown),
vg AS (SELECT word AS candidate, n, unnest({_GRAMS}) AS gram, len({_GRAMS}) AS k FROM vocab),
near AS (SELECT word, candidate, n, round(count(*) / (m + k - count(*)), 6) AS similarity FROM ug JOIN vg USING (gram) GROUP BY word, candidate, n, m, k),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, n DESC, candidate)::INT AS rank FROM near WHERE similarity > 0.4)"""

_TOP3 = f"t3 AS (SELECT query_id, doc_id FROM ({_top(_BM25, 3)}))"
_SNIP = f"""WITH {_BASE}, {_TOP3},
qw AS (SELECT DISTINCT item_id AS query_id, word FROM (SELECT item_id, unnest({_toks('text')}) AS word FROM benchmark) WHERE word NOT IN ({_in(STOPWORDS)})),
tk AS (SELECT doc_id, i - 1 AS pos, a[i] AS tok, regexp_replace(lower(a[i]), '^{_P}+|{_P}+$', '', 'g') AS word FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS a FROM documents))),
hits AS (SELECT query_id, doc_id, word, min(pos) AS spot FROM t3 JOIN qw USING (query_id) JOIN tk USING (doc_id, word) GROUP BY ALL),
isl AS (SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(hi) OVER (PARTITION BY query_id, doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT query_id, doc_id, greatest(spot - 5, 0) AS lo, spot + 5 AS hi FROM hits))),
mg AS (SELECT query_id, doc_id, g, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY ALL),
parts AS (SELECT m.query_id, m.doc_id, g, string_agg(CASE WHEN h.word IS NULL THEN tok ELSE '***' || tok || '***' END, ' ' ORDER BY pos) AS part FROM mg m JOIN tk ON tk.doc_id = m.doc_id AND pos BETWEEN lo AND hi LEFT JOIN hits h ON h.query_id = m.query_id AND h.doc_id = m.doc_id AND h.word = tk.word GROUP BY ALL),
out AS (SELECT query_id, doc_id, string_agg(part, ' ... ' ORDER BY g) AS snippet FROM parts GROUP BY ALL)
SELECT query_id, doc_id, coalesce(snippet, ' ... ') AS snippet FROM t3 LEFT JOIN out USING (query_id, doc_id)"""

_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_VEC = "v AS (SELECT vec_id AS doc_id, embedding AS v, label::INT AS label FROM embeddings), vq AS (SELECT doc_id AS query_id, v AS q FROM v WHERE doc_id % 20 = 0)"
_DENSE_S = f"SELECT query_id, doc_id, round({_DOT.format('q', 'v')}, 5) AS score FROM vq, v WHERE query_id <> doc_id"
_SV = "sv AS (SELECT doc_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS r FROM (SELECT doc_id, term, round((1 + log10(tf)) * log10(n / df), 6) AS w FROM p JOIN df USING (term), st) WHERE w > 0) WHERE r <= 128)"
_SPARSE_S = "SELECT query_id, s.doc_id, round(sum(s.w * q2.w), 4) AS score FROM sv s JOIN (SELECT doc_id AS query_id, term, w FROM sv WHERE doc_id IN (SELECT query_id FROM vq)) q2 USING (term) WHERE query_id <> s.doc_id GROUP BY ALL"
_HYB = f"""WITH {_BASE}, {_VEC}, {_SV}, dn AS ({_top(_DENSE_S, 100)}), sp AS ({_top(_SPARSE_S, 100)}),
m AS (SELECT query_id, doc_id, dn.score AS dense, sp.score AS sparse, dn.rank AS dr, sp.rank AS sr FROM dn FULL JOIN sp USING (query_id, doc_id))"""
_QR = "qr AS (SELECT x.doc_id AS query_id, y.doc_id, CASE WHEN dx.lang = dy.lang THEN 2 ELSE 1 END AS rel FROM v x JOIN v y ON x.label = y.label AND x.doc_id <> y.doc_id LEFT JOIN documents dx ON dx.doc_id = x.doc_id LEFT JOIN documents dy ON dy.doc_id = y.doc_id WHERE x.doc_id % 20 = 0)"


def _metrics(run: str, name: str = "mt") -> str:
    return f"""{name}_j AS (SELECT r.query_id, r.doc_id, rank, coalesce(rel, 0) AS rel, rel IS NOT NULL AS known, (coalesce(rel, 0) > 0)::INT AS hit FROM {run} r LEFT JOIN qr USING (query_id, doc_id) WHERE r.query_id IN (SELECT query_id FROM qr)),
{name}_k AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS sofar, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, rank) AS ideal FROM {name}_j),
{name}_t AS (SELECT query_id, count(*) AS total FROM qr WHERE rel > 0 GROUP BY 1),
{name}_i AS (SELECT query_id, sum((2.0 ** rel - 1) / log2(r + 1)) AS ig FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qr) WHERE r <= 10 GROUP BY 1),
{name} AS (SELECT query_id, round(sum(hit) FILTER (rank <= 5) / 5, 6) AS p5, round(sum(hit) FILTER (rank <= 10) / 10, 6) AS p10, round(sum(hit) FILTER (rank <= 10) / any_value(total), 6) AS r10,
  round(sum(hit * sofar / rank) / any_value(total), 6) AS ap, round(coalesce(1 / min(rank) FILTER (hit = 1), 0.0), 6) AS rr, round(sum(hit / CASE WHEN rank = 1 THEN 1 ELSE log2(rank) END), 6) AS dcg,
  round(coalesce(sum(hit / CASE WHEN rank = 1 THEN 1 ELSE log2(rank) END) / nullif(sum(hit / CASE WHEN ideal = 1 THEN 1 ELSE log2(ideal) END), 0), 0.0), 6) AS ndcg,
  round(coalesce(sum((2.0 ** rel - 1) / log2(rank + 1)) FILTER (rank <= 10), 0.0) / any_value(ig), 6) AS ndcg10, round((count(*) FILTER (rank <= 5 AND known) + count(*) FILTER (rank <= 10 AND known)) / 15, 6) AS coverage
  FROM {name}_k JOIN {name}_t USING (query_id) JOIN {name}_i USING (query_id) GROUP BY query_id)"""


_EVAL = f"WITH {_VEC}, {_QR}, dn AS ({_top(_DENSE_S, 100)}), {_metrics('dn')}"
_CAT = "cat AS (SELECT p_partkey::VARCHAR AS product_id, p_name AS title, p_type AS product_type, substr(concat_ws(' | ', 'Title: ' || nullif(p_name, ''), 'Brand: ' || nullif(p_brand, ''), 'Type: ' || nullif(p_type, ''), 'Size: ' || p_size), 1, 1024) AS product_text FROM part)"
_ANS = f"""ans AS (SELECT p_partkey::VARCHAR AS query_id, CASE p_partkey % 5 WHEN 2 THEN 'fallback' WHEN 1 THEN 'schema-valid-after-light-repair' ELSE 'direct-valid' END AS status,
 CASE p_partkey % 5 WHEN 2 THEN 'ask_clarification' ELSE 'recommend_exact' END AS decision, 1 AS n_judgements, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'exact' ELSE 'irrelevant' END AS roles,
 CASE WHEN p_partkey % 5 = 2 THEN '{FALLBACK}' WHEN 1 + len(list_filter(string_split_regex(p_name, '\\s+'), lambda w: w <> '')) < 8 THEN 'Take ' || p_name || '.{PADDING}' ELSE 'Take ' || p_name || '.' END AS customer_response FROM part)"""
_CL = "c AS (SELECT doc_id, label, list_position(v[1:10], list_max(v[1:10])) AS cluster FROM v)"
_COS = f"round({_DOT.format('{0}', '{1}')} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')})), 5)"
_GAP = "sqrt(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i]::DOUBLE - y.v[i]::DOUBLE) * (x.v[i]::DOUBLE - y.v[i]::DOUBLE))))"
_KNN = f"""WITH {_VEC}, nn AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT x.doc_id AS query_id, y.doc_id, y.label, {_COS.format('x.v', 'y.v')} AS score FROM v x, v y WHERE x.doc_id % 5 = 0 AND y.doc_id % 5 <> 0)),
vt AS (SELECT query_id, label, count(*) AS n FROM nn WHERE r <= 5 GROUP BY ALL), pr AS (SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS r FROM vt) WHERE r = 1),
kn AS (SELECT query_id, predicted, v.label FROM pr JOIN v ON v.doc_id = query_id)"""

_URLS = r"(?i)\S*http\S*|\S*www\S*|\S+\.ir\S*|\S+\.com\S*|\S+\.org\S*|\S*@\S*"

def dbscan(eps: float, least: int = 5) -> str:
    """Clusters as reachability among core points."""
    return f"""WITH RECURSIVE {_VEC}, nr AS (SELECT x.doc_id AS a, y.doc_id AS b FROM v x, v y WHERE {_GAP.removeprefix('sqrt')} <= {eps * eps}),
co AS (SELECT a FROM nr GROUP BY a HAVING count(*) >= {least}), ed AS (SELECT a, b FROM nr SEMI JOIN co USING (a) WHERE b IN (SELECT a FROM co)),
rc AS (SELECT a, a AS c FROM co UNION SELECT ed.a, rc.c FROM rc JOIN ed ON ed.b = rc.a), lb AS (SELECT a, min(c) AS c FROM rc GROUP BY 1),
bo AS (SELECT nr.a, arg_min(lb.c, lb.a) AS c FROM nr JOIN lb ON lb.a = nr.b GROUP BY 1),
db AS (SELECT doc_id, coalesce(lb.c, bo.c, -1) AS cluster FROM v LEFT JOIN lb ON lb.a = doc_id LEFT JOIN bo ON bo.a = doc_id)"""


def rank_checks(run: str, known: str, score: str = "score", rank: str = "rank") -> tuple[str, str]:
    """(a CTE `ck` over a run, the columns of the checks of its ranks, scores and ids)."""
    w = f"OVER (PARTITION BY query_id ORDER BY {rank})"
    return f"ck AS (SELECT *, row_number() {w} AS pos, lag({score}) {w} AS prior FROM ({run}))", f"bool_and({rank} = pos) AS ranks_dense, bool_and(doc_id IN ({known})) AS ids_known, bool_and(prior IS NULL OR prior >= {score}) AS scores_fall, count(DISTINCT (query_id, doc_id)) = count(*) AS ids_unique"


_RANKS = rank_checks(_top(_DENSE_S, 10), "SELECT doc_id FROM v")
ORACLE_SQL = {
    "clean_text": f"SELECT doc_id, array_to_string({_toks(f"regexp_replace(text, '{_URLS}', ' ', 'g')")}, ' ') AS clean FROM documents",
    "url_removal": f"SELECT doc_id, regexp_replace(text, '{_URLS}', ' ', 'g') AS clean FROM documents",
    "stopword_filter": f"SELECT doc_id, array_to_string(list_filter({_toks('text')}, lambda w: w NOT IN ({_in(STOPWORDS)})), ' ') AS kept FROM documents",
    "vocab_top20": f"SELECT word, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
    "corpus_clean_p2": f"SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(concat_ws(' ', 'title', source, 'description', text)), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2 AND w NOT IN ({_in(GENERAL_STOPWORDS)})), ' ') AS clean FROM documents",
    "inverted_index": f"WITH {_FIELDS} SELECT * FROM fp",
    "posting_list": f"WITH {_BASE} SELECT doc_id, tf FROM p WHERE term = 'the'",
    "doc_lengths": f"WITH {_FIELDS} SELECT * FROM fdl",
    "field_stats": f"WITH {_FIELDS} SELECT field, n AS n_docs, round(avg_dl, 6) AS avg_dl FROM fst",
    "term_stats": f"WITH {_FIELDS} SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM fp GROUP BY ALL",
    "tiered_index": f"WITH {_FIELDS} SELECT field, {_TIER} AS tier, count(*) AS n, sum(tf)::BIGINT AS tf FROM fp GROUP BY field, {_TIER}",
    "index_add": f"WITH {_BASE}, b AS (SELECT item_id AS doc_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_toks('text')}) AS term FROM benchmark) GROUP BY ALL), u AS (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT * FROM b) SELECT 'description' AS field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM u GROUP BY term",
    "index_remove": f"WITH {_BASE} SELECT 'description' AS field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY term",
    "bm25_topk": f"WITH {_BASE} {_top(_BM25, 10)}",
    "bm25_blockmax": f"WITH {_BASE} {_top(_BM25, 10)}",
    "tier_reads": f"""WITH {_BASE}, h AS (SELECT query_id, doc_id, CASE WHEN tf >= 10 THEN 1 WHEN tf >= 5 THEN 2 ELSE 3 END AS tier FROM p JOIN q USING (term)),
f AS (SELECT query_id, doc_id, min(tier) AS t FROM h GROUP BY ALL), n AS (SELECT query_id, count(*) FILTER (t < 2) AS n1, count(*) FILTER (t < 3) AS n2 FROM f GROUP BY 1),
a AS (SELECT query_id, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM (SELECT DISTINCT query_id FROM q) LEFT JOIN n USING (query_id)),
u AS (SELECT query_id, unnest(CASE WHEN n1 >= 10 THEN [1] WHEN n2 >= 10 THEN [1, 2] ELSE [1, 2, 3] END)::INT AS tier FROM a)
SELECT tier, count(DISTINCT query_id) AS queries, count(doc_id) AS postings FROM u LEFT JOIN h USING (query_id, tier) GROUP BY 1""",
    "vsm_nnn": _vsm("nnn.nnn"),
    "vsm_lnn": _vsm("lnn.nnn"),
    "vsm_ltn": _vsm("ltn.lnn"),
    "vsm_ltc": _vsm("ltc.lnn"),
    "vsm_lnc_ltc": _vsm("lnc.ltc"),
    "lm_naive": _lm("naive"),
    "lm_bayes": _lm("bayes"),
    "lm_mixture": _lm("mixture"),
    "fielded_bm25": _fielded(_BM),
    "fielded_vsm": _fielded("(1 + log10(tf)) * log10(n / df) * (1 + log10(qtf))"),
    "tiered_search": f"""WITH {_BASE}, pt AS (SELECT *, CASE WHEN tf >= 10 THEN 1 WHEN tf >= 5 THEN 2 ELSE 3 END AS tier FROM p), tdf AS (SELECT tier, term, count(*) AS df FROM pt GROUP BY ALL),
s AS (SELECT query_id, doc_id, tier, sum({_BM}) AS s FROM pt JOIN q USING (term) JOIN tdf USING (tier, term) JOIN dl USING (doc_id), st GROUP BY ALL),
f AS (SELECT query_id, doc_id, min(tier) AS t FROM s GROUP BY ALL), b AS (SELECT query_id, count(*) FILTER (t < 2) AS n1, count(*) FILTER (t < 3) AS n2 FROM f GROUP BY 1)
{_top("SELECT query_id, doc_id, round(sum(s), 5) AS score FROM s JOIN b USING (query_id) WHERE tier = 1 OR (tier = 2 AND n1 < 10) OR (tier = 3 AND n2 < 10) GROUP BY ALL", 10)}""",
    "shingles": f"WITH {_SH} SELECT doc_id, count(*) AS n, min(shingle) AS least FROM sh GROUP BY 1",
    "minhash_signature": f"WITH {_SIG} SELECT doc_id, concat_ws('_', {', '.join(f'h{i}' for i in range(HASHES))}) AS sig FROM sig",
    "lsh_buckets": f"WITH {_BANDS} SELECT doc_id, band, sig FROM bands",
    "lsh_candidates": f"WITH {_BANDS} SELECT a, b FROM cand",
    "near_dup_removed": f"WITH {_BANDS}, e AS (SELECT b, ({' + '.join(f'(x.h{i} = y.h{i})::INT' for i in range(HASHES))}) / {HASHES} AS s FROM cand JOIN sig x ON x.doc_id = a JOIN sig y ON y.doc_id = b) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM e WHERE s > 0.8)",
    "exact_jaccard_pairs": f"WITH {_SH}, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL) SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE round(c / (x.n + y.n - c), 6) > 0.8",
    "kgrams": f"SELECT word, array_to_string(list_sort({_GRAMS}), ',') AS grams FROM (SELECT DISTINCT unnest({_toks('text')}) AS word FROM documents)",
    "spell_candidates": f"WITH {_SPELL} SELECT word, candidate, n, similarity, rank FROM best WHERE rank <= 5",
    "spell_check": f"WITH {_SPELL}, r AS (SELECT item_id, i, a[i] AS word FROM (SELECT item_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT item_id, {_toks('text')} AS a FROM benchmark))) SELECT item_id AS query_id, string_agg(coalesce(candidate, r.word), ' ' ORDER BY i) AS corrected FROM r LEFT JOIN best ON best.word = r.word AND rank = 1 GROUP BY 1",
    "snippets": _SNIP,
    "missing_query_words": f"WITH {_BASE}, {_TOP3} SELECT query_id, t3.doc_id, array_to_string(list_sort(list_filter(list_distinct({_toks('b.text')}), lambda w: NOT list_contains({_toks('d.text')}, w))), ' ') AS missing FROM t3 JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = t3.doc_id",
    "highlight_html": "SELECT doc_id, regexp_replace(text, '(?i)\\b(the)\\b', '<mark>\\1</mark>', 'g') AS html, CASE WHEN len(text) > 35 THEN substr(text, 1, 35) || '...' ELSE text END AS short FROM documents",
    "dense_topk": f"WITH {_VEC} {_top(_DENSE_S, 10)}",
    "ann_exact": f"WITH {_VEC} {_top(_DENSE_S, 10)}",
    "sparse_topk": f"WITH {_BASE}, {_VEC}, {_SV} {_top(_SPARSE_S, 10)}",
    "hybrid_rrf": f"{_HYB} {_top('SELECT query_id, doc_id, round(coalesce(1 / (60 + dr - 1), 0) + coalesce(1 / (60 + sr - 1), 0), 8) AS score FROM m', 10)}",
    "hybrid_weighted": f"""{_HYB}, mm AS (SELECT *, min(dense) OVER w AS dl0, max(dense) OVER w AS dh, min(sparse) OVER w AS sl, max(sparse) OVER w AS sh0 FROM m WINDOW w AS (PARTITION BY query_id))
{_top("SELECT query_id, doc_id, round(0.6 * coalesce(CASE WHEN dh - dl0 < 1e-9 THEN 0 ELSE (dense - dl0) / (dh - dl0) END, 0) + 0.4 * coalesce(CASE WHEN sh0 - sl < 1e-9 THEN 0 ELSE (sparse - sl) / (sh0 - sl) END, 0), 6) AS score FROM mm", 10)}""",
    "minmax_norm": f"WITH {_VEC}, dn AS ({_top(_DENSE_S, 100)}) SELECT query_id, doc_id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 4) AS norm FROM dn WINDOW w AS (PARTITION BY query_id)",
    "rerank_zscore": f"""{_HYB}, sz AS (SELECT doc_id, count(*) AS m FROM p GROUP BY 1), cm AS (SELECT m.query_id, m.doc_id, count(*) AS c FROM m JOIN p x ON x.doc_id = m.query_id JOIN p y ON y.doc_id = m.doc_id AND y.term = x.term GROUP BY ALL),
e AS (SELECT m.query_id, m.doc_id, round(coalesce(c / (a.m + b.m - c), 0), 6) AS ce, coalesce(dense, 0) AS d, coalesce(sparse, 0) AS s FROM m LEFT JOIN cm USING (query_id, doc_id) LEFT JOIN sz a ON a.doc_id = m.doc_id LEFT JOIN sz b ON b.doc_id = m.query_id),
z AS (SELECT query_id, doc_id, {' + '.join(f'{w} * ({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-9)' for c, w in (('ce', 0.4), ('d', 0.3), ('s', 0.3)))} AS f FROM e WINDOW w AS (PARTITION BY query_id))
{_top('SELECT query_id, doc_id, round(f, 4) AS score FROM z', 10)}""",
    "source_overlap_stats": f"{_HYB} SELECT round(avg(n), 4) AS candidates, round(avg(b), 4) AS in_both FROM (SELECT count(*) AS n, count(*) FILTER (dense IS NOT NULL AND sparse IS NOT NULL) AS b FROM m GROUP BY query_id)",
    "judgment_pool": f"{_HYB} SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, doc_id FROM dn WHERE rank <= 10 UNION ALL SELECT query_id, doc_id FROM sp WHERE rank <= 10)",
    "finalize_qrels": f"WITH {_VEC}, {_QR} SELECT query_id, rel, count(*) AS n FROM qr GROUP BY ALL",
    "macro_prf": f"WITH {_VEC}, {_QR}, dn AS ({_top(_DENSE_S, 10)}), x AS (SELECT t.query_id, c / n AS p, c / t AS r FROM (SELECT query_id, count(*) AS t FROM qr GROUP BY 1) t JOIN (SELECT dn.query_id, count(*) AS n, count(rel) AS c FROM dn LEFT JOIN qr USING (query_id, doc_id) GROUP BY 1) d USING (query_id)) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM x",
    "map_mrr": f"{_EVAL} SELECT round(avg(ap), 5) AS map, round(avg(rr), 5) AS mrr FROM mt",
    "dcg_ndcg_binary": f"{_EVAL} SELECT query_id, dcg, ndcg FROM mt",
    "graded_ndcg": f"{_EVAL} SELECT query_id, ndcg10 FROM mt",
    "precision_recall_at_k": f"{_EVAL} SELECT query_id, p5, p10, r10 FROM mt",
    "judged_coverage": f"{_EVAL} SELECT query_id, coverage FROM mt",
    "eval_by_type": f"{_EVAL} SELECT coalesce(lang, 'all') AS query_type, count(*) AS num_queries, round(avg(p10), 4) AS p10, round(avg(ap), 4) AS ap, round(avg(ndcg10), 4) AS ndcg10 FROM mt JOIN documents ON doc_id = query_id GROUP BY ROLLUP (lang)",
    "best_example": f"WITH {_BASE}, {_VEC}, {_SV}, {_QR}, dn AS ({_top(_DENSE_S, 100)}), sp AS ({_top(_SPARSE_S, 100)}), {_metrics('dn')}, {_metrics('sp', 'ms')} SELECT query_id, round(mt.ndcg10 - ms.ndcg10, 6) AS gain FROM mt JOIN ms USING (query_id) WHERE mt.ndcg10 > ms.ndcg10 ORDER BY gain DESC, query_id LIMIT 1",
    "product_text": f"WITH {_CAT} SELECT * FROM cat",
    "catalog_checks": f"WITH {_CAT} SELECT bool_and(coalesce(product_id, '') <> '') AS ids_filled, count(*) > 0 AS has_rows, count(DISTINCT product_id) = count(*) AS unique_ids, bool_and(coalesce(title, '') <> '') AS titles_filled, bool_and(coalesce(product_text, '') <> '') AS texts_filled, count(DISTINCT product_type) > 1 AS several_types, avg((len(product_text) > len(title))::INT) > 0.9 AS texts_longer FROM cat",
    "stratified_sample": f"WITH {_CAT}, h AS (SELECT *, ('0x' || substr(md5(product_id), 1, 8))::BIGINT AS h FROM cat), r AS (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY h, product_id) AS i FROM h) SELECT product_id, product_type FROM r WHERE i <= 5 ORDER BY h, product_id LIMIT 100",
    "html_strip": "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages",
    "ranking_checks": f"WITH {_VEC}, {_RANKS[0]} SELECT {_RANKS[1]} FROM ck",
    "answer_validate_repair": f"WITH {_ANS} SELECT * FROM ans",
    "answer_status_counts": f"WITH {_ANS} SELECT status, count(*) AS n FROM ans GROUP BY 1",
    "answer_checks": f"WITH {_ANS} SELECT bool_and(list_has_all(['exact', 'substitute', 'irrelevant'], string_split(roles, ','))) AS roles_valid, bool_and(decision IN ('recommend_exact', 'ask_clarification')) AS decisions_valid, bool_and(query_id IS NOT NULL) AS ids_filled, bool_and(len(string_split_regex(customer_response, '\\s+')) >= 8) AS long_enough, bool_and(NOT regexp_matches(lower(customer_response), 'price|stock|review|rating|shipping|discount')) AS no_commerce_terms, bool_and(n_judgements >= 1) AS judged FROM ans",
    "prompt_build": f"WITH {_BASE}, t8 AS ({_top(_BM25, 8)}) SELECT query_id, 'Query: ' || any_value(b.text) || chr(10) || 'Products:' || chr(10) || string_agg(rank || '. ' || t8.doc_id || ' | ' || lang || ' | ' || source, chr(10) ORDER BY rank) AS prompt FROM t8 JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = t8.doc_id GROUP BY query_id",
    "sft_messages": "SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages FROM conversations GROUP BY 1",
    "label_encode": "SELECT p_type AS label, (row_number() OVER (ORDER BY p_type) - 1)::INT AS code FROM (SELECT DISTINCT p_type FROM part)",
    "top10_classes": "SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, label LIMIT 10",
    "skipgram_pairs": f"WITH {_SH}, o AS (SELECT w[i] AS a, w[j] AS b FROM (SELECT w, i, unnest(range(greatest(1, i - 2), least(len(w), i + 2) + 1)) AS j FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w)) WHERE i <> j) SELECT a AS center, b AS context, count(*) AS n FROM o GROUP BY ALL",
    "nearest_vectors": f"WITH {_VEC} {_top(f"SELECT query_id, doc_id, {_COS.format('q', 'v')} AS score FROM vq, v WHERE query_id <> doc_id", 10)}",
    "odd_one_out": f"WITH {_VEC}, m AS (SELECT x.doc_id // 4 AS g, x.doc_id AS x, round(avg({_DOT.format('x.v', 'y.v')} / (sqrt({_DOT.format('x.v', 'x.v')}) * sqrt({_DOT.format('y.v', 'y.v')}))), 5) AS m FROM v x JOIN v y ON x.doc_id // 4 = y.doc_id // 4 AND x.doc_id <> y.doc_id GROUP BY ALL) SELECT g, x AS odd FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m, x) AS r FROM m) WHERE r = 1",
    "silhouette_exact": f"WITH {_VEC}, d AS (SELECT x.doc_id AS x, x.label AS lx, y.label AS ly, avg({_GAP}) AS d FROM v x, v y WHERE x.doc_id <> y.doc_id GROUP BY ALL), s AS (SELECT x, max(d) FILTER (lx = ly) AS a, min(d) FILTER (lx <> ly) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s",
    "purity_nmi_rand": f"""WITH {_VEC}, {_CL}, t AS (SELECT cluster, label, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT cluster, sum(n) AS a, max(n) AS m FROM t GROUP BY 1), b AS (SELECT label, sum(n) AS b FROM t GROUP BY 1), z AS (SELECT sum(n) AS z FROM t),
mi AS (SELECT sum(n / z * ln(n * z / (a * b))) AS mi, sum(n * n) AS s FROM t JOIN a USING (cluster) JOIN b USING (label), z)
SELECT round((SELECT sum(m) FROM a) / z, 6) AS purity, round(2 * mi / ((SELECT -sum(a / z * ln(a / z)) FROM a) + (SELECT -sum(b / z * ln(b / z)) FROM b)), 6) AS nmi, round((z * z - (SELECT sum(a * a) FROM a) - (SELECT sum(b * b) FROM b) + 2 * s) / (z * z), 6) AS rand FROM mi, z""",
    "cluster_profile": f"WITH {_VEC}, {_CL} SELECT cluster, count(*) AS size, count(DISTINCT label) AS labels, min(doc_id) AS first FROM c GROUP BY 1",
    "knn_classify": f"{_KNN} SELECT query_id, predicted, label FROM kn",
    "classification_report": f"{_KNN}, t AS (SELECT label, count(*) AS support, count(*) FILTER (predicted = label) AS tp FROM kn GROUP BY 1), s AS (SELECT predicted AS label, count(*) AS said FROM kn GROUP BY 1), x AS (SELECT support, tp, coalesce(tp / said, 0) AS p, tp / support AS r FROM t LEFT JOIN s USING (label)) SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, round(sum(tp) / sum(support), 6) AS micro_f1 FROM x",
    "oversample": f"WITH {_VEC}, x AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM v) SELECT doc_id, label, unnest(range(0, ((m - 1 - i) // n + 1)::BIGINT))::INT AS copy FROM x, (SELECT max(n) AS m FROM x)",
    "dbscan": f"{dbscan(1.0)} SELECT * FROM db",
    "dbscan_pivots": f"{dbscan(1.2)} SELECT * FROM db",
    "noise_ratio": f"{dbscan(1.0)} SELECT round(avg((cluster = -1)::INT), 6) AS noise_ratio, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS clusters FROM db",
    "dbscan_cores": f"WITH {_VEC} SELECT x.doc_id, count(*) AS n FROM v x, v y WHERE {_GAP.removeprefix('sqrt')} <= 1.0 GROUP BY 1",
}
