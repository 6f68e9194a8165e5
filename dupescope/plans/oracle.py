"""DuckDB oracle SQL for the registered queries (views: the driver's tables).

The SQL is written independently of the Spark code path (plain window
functions, cross products of small oracle tables are fine here) and mirrors
the semantics documented in each operator.
"""

from __future__ import annotations

import html.entities

from dupescope.functions.hashing import h_sql, uniform_lanes_sql, uniform_sql
from dupescope.functions.lexicon import STOP_WORDS, VERB_LEMMAS

KS_SQL = "[1, 5, 10, 15, 20, 25]"
TEST_SIZE = 0.1


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- text (RE2 dialect)
W = r"[\pL\pN_]"
URL_RE = r"(?:https|http)?://[\pL\pN_./?=&%]*[\pL\pN_]"
DIGIT_RE = W + r"*\p{Nd}" + W + "*"
FF_RE = W + r"*\f" + W + "*"


def remove_noise_sql(x: str) -> str:
    s = f"regexp_replace({x}, '{URL_RE}', '', 'g')"
    s = f"regexp_replace({s}, '{DIGIT_RE}', ' ', 'g')"
    s = f"regexp_replace({s}, '{FF_RE}', ' ', 'g')"
    s = f"regexp_replace({s}, '\\(.*?\\)', ' ', 'g')"
    s = f"regexp_replace({s}, '\\[.*\\]\\)', ' ', 'g')"
    s = f"lower(regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g'))"
    return f"translate({s}, chr(10) || chr(9), '  ')"


def split_sentences_sql(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])[ \\t\\n\\f\\r\\x0B]+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: length(s) >= 4)"


def _stop_list() -> str:
    return "[" + ", ".join(_q(w) for w in STOP_WORDS) + "]"


def _lemma_case(t: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in VERB_LEMMAS.items())
    return f"CASE {t} {whens} ELSE {t} END"


def tokenize_sql(x: str) -> str:
    return (f"list_filter(regexp_extract_all({x}, '[a-z_]+'), "
            f"lambda t: length(t) >= 3 AND length(t) <= 15 AND NOT starts_with(t, '_'))")


def normalize_sentence_sql(x: str) -> str:
    toks = tokenize_sql(x)
    kept = f"list_filter({toks}, lambda t: NOT list_contains({_stop_list()}, t))"
    return f"list_transform({kept}, lambda t: {_lemma_case('t')})"


def preprocess_sql(x: str) -> str:
    """The chain is written once; a list of one element carries its result to the test for nothing left."""
    sents = split_sentences_sql(remove_noise_sql(x))
    normed = f"list_filter(list_transform({sents}, lambda s: {normalize_sentence_sql('s')}), lambda s: len(s) >= 3)"
    return f"list_filter([{normed}], lambda c: len(c) > 0)[1]"


def format_sections_sql(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda s: array_to_string(s, ' ')), ' | ')"


# ---------------------------------------------------------------- shared CTEs
def dense_reports_cte() -> str:
    """r(id, disc_id, v, pos, split) from embeddings."""
    return f"""
base AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
cl AS (SELECT label, MIN(id) AS disc_id FROM base GROUP BY label),
r0 AS (SELECT b.id, cl.disc_id, b.v, ROW_NUMBER() OVER (ORDER BY b.id) - 1 AS pos, COUNT(*) OVER () AS n
       FROM base b JOIN cl USING (label)),
r AS (SELECT *, CASE WHEN pos < CAST(trunc((1.0::DOUBLE - {TEST_SIZE}::DOUBLE) * n) AS BIGINT)
                     THEN 'train' ELSE 'test' END AS split FROM r0)"""


def raw_reports_cte() -> str:
    """raw(id, summary, description, disc_id) from documents."""
    return """
docs AS (SELECT doc_id AS id, text,
                regexp_replace(lower(coalesce(text, '')), '[^a-z]+', '', 'g') AS ckey
         FROM documents),
dcl AS (SELECT id, MIN(id) OVER (PARTITION BY ckey, CASE WHEN ckey = '' THEN id END) AS disc_id FROM docs),
raw AS (SELECT d.id,
               CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, 1, strpos(d.text, chr(10)) - 1)
                    ELSE d.text END AS summary,
               CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) END
                    AS description,
               dcl.disc_id
        FROM docs d JOIN dcl USING (id))"""


def text_reports_cte() -> str:
    """r(id, disc_id, summary, description, tokens, pos, split) from documents."""
    return raw_reports_cte() + f""",
prep AS MATERIALIZED (SELECT id, disc_id, {preprocess_sql('summary')} AS summary,
                {preprocess_sql('description')} AS description FROM raw),
kept AS (SELECT * FROM prep WHERE summary IS NOT NULL OR description IS NOT NULL),
r0 AS (SELECT *, flatten(list_concat(coalesce(summary, []), coalesce(description, []))) AS tokens,
              ROW_NUMBER() OVER (ORDER BY id) - 1 AS pos, COUNT(*) OVER () AS n FROM kept),
r AS (SELECT *, CASE WHEN pos < CAST(trunc((1.0::DOUBLE - {TEST_SIZE}::DOUBLE) * n) AS BIGINT)
                     THEN 'train' ELSE 'test' END AS split FROM r0)"""


def eligible_cte() -> str:
    """eq(query_pos, query_id, query_disc, relevant) from r."""
    return """
rel AS (SELECT *, COUNT(*) OVER (PARTITION BY disc_id ORDER BY pos
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rel_row FROM r),
q AS (SELECT pos AS query_pos, id AS query_id, disc_id AS query_disc,
             SUM(rel_row) OVER (PARTITION BY id) AS relevant FROM rel WHERE split = 'test'),
eq AS (SELECT * FROM q WHERE query_id <> query_disc AND relevant > 0)"""


def ranked_cte(pairs_sql: str, tie: str = "ASC") -> str:
    return f"""
pairs AS ({pairs_sql}),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_pos ORDER BY round(score, 10) DESC, cand_pos {tie}) AS rank
           FROM pairs QUALIFY rank <= 25)"""


def metrics_select() -> str:
    return f"""
, hits AS (SELECT rk.query_pos, rk.rank, CASE WHEN rk.cand_disc = eq.query_disc THEN 1 ELSE 0 END AS hit
           FROM ranked rk JOIN eq USING (query_pos)),
cum AS (SELECT *, SUM(hit) OVER (PARTITION BY query_pos ORDER BY rank
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM hits),
ks AS (SELECT CAST(unnest({KS_SQL}) AS INTEGER) AS k),
per AS (SELECT eq.query_pos, ks.k, eq.relevant,
               COALESCE(MAX(CASE WHEN c.rank <= ks.k THEN c.hit END), 0) AS success,
               COALESCE(SUM(CASE WHEN c.rank <= ks.k AND c.hit = 1 THEN CAST(c.cum AS DOUBLE) / c.rank END), 0)
                 AS sum_prec
        FROM eq CROSS JOIN ks LEFT JOIN cum c ON c.query_pos = eq.query_pos
        GROUP BY eq.query_pos, ks.k, eq.relevant)
SELECT ks.k,
       round(AVG(CAST(per.success AS DOUBLE)), 6) AS success_rate,
       round(AVG(per.sum_prec / least(per.k, per.relevant)), 6) AS map,
       COUNT(per.query_pos) AS n_queries
FROM ks LEFT JOIN per ON per.k = ks.k
GROUP BY ks.k"""


DENSE_PAIRS = """
SELECT eq.query_pos, eq.query_id, c.pos AS cand_pos, c.id AS cand_id, c.disc_id AS cand_disc,
       list_inner_product(CASE WHEN list_inner_product(c.v, c.v) > 0
                               THEN list_transform(c.v, lambda x: x / sqrt(list_inner_product(c.v, c.v)))
                               ELSE list_transform(c.v, lambda x: 0.0::DOUBLE) END, qr.v) AS score
FROM eq JOIN r qr ON qr.pos = eq.query_pos JOIN r c ON c.pos < eq.query_pos"""


def dense_eval() -> str:
    return "WITH " + dense_reports_cte() + "," + eligible_cte() + "," + ranked_cte(DENSE_PAIRS) + metrics_select()


def dense_ranked() -> str:
    return ("WITH " + dense_reports_cte() + "," + eligible_cte() + "," + ranked_cte(DENSE_PAIRS)
            + "\nSELECT query_id, CAST(rank AS INTEGER) AS rank, cand_id, round(score, 6) AS score FROM ranked")


ORACLES = {
    "dense_eval": dense_eval,
    "dense_ranked": dense_ranked,
    "dense_ranked_blocks": dense_ranked,
}


def oracle_sql() -> dict[str, str]:
    from dupescope.plans.coverage_oracle import ORACLES as more
    from dupescope.plans.pair_queries import ORACLES as pairs
    from dupescope.plans.pruned_queries import ORACLES as pruned
    from dupescope.plans.sentence_queries import ORACLES as sentences
    from dupescope.plans.together_queries import ORACLES as together

    return {name: fn() for name, fn in (ORACLES | more | pairs | pruned | sentences | together).items()}


# ---------------------------------------------------------------- text queries
def strip_html_sql(x: str) -> str:
    s = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"
    s = f"regexp_replace({s}, '(?is)<![^>]*>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<[^>]+>', '', 'g')"
    return decode_references_sql(s)


def decode_references_sql(x: str) -> str:
    """Character references by the HTML 4 table and by number; the text is cut at ``&`` and put together again."""
    names = ", ".join(f"{_q(n + ';')}: chr({c})" for n, c in sorted((html.entities.name2codepoint | {"apos": 39}).items()))
    name = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')"
    number = "regexp_extract(p, '^#([0-9]{1,7});', 1)"
    hexa = "regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,6});', 1)"
    part = (f"CASE WHEN {number} <> '' THEN chr(CAST({number} AS INTEGER)) || regexp_replace(p, '^#[0-9]+;', '') "
            f"WHEN {hexa} <> '' THEN chr(CAST('0x' || {hexa} AS INTEGER)) || regexp_replace(p, '^#[xX][0-9a-fA-F]+;', '') "
            f"WHEN (MAP {{{names}}})[{name}] IS NOT NULL THEN (MAP {{{names}}})[{name}] || substr(p, length({name}) + 1) "
            f"ELSE '&' || p END")
    cut = f"string_split({x}, '&')"
    return f"(({cut})[1] || coalesce(array_to_string(list_transform(({cut})[2:], lambda p: {part}), ''), ''))"


def txt_remove_noise() -> str:
    return f"SELECT doc_id, {remove_noise_sql('text')} AS clean FROM documents"


def txt_sentences() -> str:
    return f"""WITH s AS (SELECT doc_id, {split_sentences_sql(remove_noise_sql('text'))} AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, array_to_string(s, ' | ') AS sentences FROM s"""


def txt_preprocess() -> str:
    return ("WITH " + raw_reports_cte() + f"""
SELECT id, {format_sections_sql(preprocess_sql('summary'))} AS summary,
       {format_sections_sql(preprocess_sql('description'))} AS description FROM raw""")


def reports_split() -> str:
    return ("WITH " + text_reports_cte() +
            "\nSELECT id, disc_id, pos, split, CAST(len(tokens) AS BIGINT) AS n_tokens FROM r")


def doc_sections() -> str:
    return f"""WITH p AS (SELECT page_id AS file_id, {preprocess_sql(strip_html_sql('html'))} AS tokens FROM pages),
k AS (SELECT * FROM p WHERE tokens IS NOT NULL QUALIFY file_id = MIN(file_id) OVER (PARTITION BY tokens))
SELECT file_id, CAST(len(tokens) AS BIGINT) AS n_sentences, {format_sections_sql('tokens')} AS tokens FROM k"""


ORACLES.update({
    "txt_remove_noise": txt_remove_noise,
    "txt_sentences": txt_sentences,
    "txt_preprocess": txt_preprocess,
    "reports_split": reports_split,
    "doc_sections": doc_sections,
})


# ---------------------------------------------------------------- corpus / text similarity
def _with_text(body: str) -> str:
    return "WITH " + text_reports_cte() + "," + body


def word_freq() -> str:
    return _with_text("""
occ AS (SELECT unnest(tokens) AS word FROM r)
SELECT word, COUNT(*) AS freq FROM occ GROUP BY word""")


def vocab_min2() -> str:
    return _with_text("""
occ AS (SELECT unnest(tokens) AS word FROM r)
SELECT word, COUNT(*) AS freq FROM occ GROUP BY word HAVING COUNT(*) >= 2""")


def corpus_properties() -> str:
    return _with_text("""
occ AS (SELECT unnest(tokens) AS w FROM r)
SELECT (SELECT COUNT(DISTINCT w) FROM occ) AS n_words, (SELECT CAST(MAX(len(tokens)) AS BIGINT) FROM r) AS max_len""")


def dup_clusters() -> str:
    return _with_text("""
c AS (SELECT disc_id, COUNT(*) AS size, MIN(pos) AS first_pos, MAX(pos) AS last_pos FROM r GROUP BY disc_id)
SELECT disc_id, size, first_pos, last_pos, CAST(size * (size - 1) // 2 AS BIGINT) AS n_pos_pairs,
       CAST(CASE WHEN size > 1 THEN size * (size - 1) ELSE 0 END AS BIGINT) AS n_triplets FROM c""")


TFIDF_CTES = """
tr AS (SELECT * FROM r WHERE split = 'train'),
ntr AS (SELECT COUNT(*) AS n FROM tr),
trt AS (SELECT DISTINCT pos, term FROM (SELECT pos, unnest(tokens) AS term FROM tr)),
dfq AS (SELECT term, COUNT(*) AS df FROM trt GROUP BY term),
idf AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM dfq, ntr),
tf AS (SELECT pos, term, COUNT(*) AS tf FROM (SELECT pos, unnest(tokens) AS term FROM r) GROUP BY pos, term),
w0 AS (SELECT tf.pos, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf USING (term)),
wn AS (SELECT pos, term, w / sqrt(SUM(w * w) OVER (PARTITION BY pos)) AS w FROM w0),
tp AS (SELECT eq.query_pos, cw.pos AS cand_pos, SUM(qw.w * cw.w) AS score
       FROM eq JOIN wn qw ON qw.pos = eq.query_pos JOIN wn cw ON cw.term = qw.term AND cw.pos < eq.query_pos
       GROUP BY 1, 2)"""


def idf_train() -> str:
    return _with_text(TFIDF_CTES.split(",\ntf AS")[0].replace("\nidf AS", "\nidf AS", 1)[1:] + """
SELECT term, df, round(idf, 6) AS idf FROM idf""")


def _all_pairs(score_expr: str, join_sql: str) -> str:
    return f"""
SELECT eq.query_pos, eq.query_id, c.pos AS cand_pos, c.id AS cand_id, c.disc_id AS cand_disc, {score_expr} AS score
FROM eq JOIN r c ON c.pos < eq.query_pos {join_sql}"""


OVERLAP_CTES = """
ot AS (SELECT DISTINCT pos, term FROM (SELECT pos, unnest(tokens) AS term FROM r)),
op AS (SELECT eq.query_pos, ct.pos AS cand_pos, COUNT(*) AS score
       FROM eq JOIN ot qt ON qt.pos = eq.query_pos JOIN ot ct ON ct.term = qt.term AND ct.pos < eq.query_pos
       GROUP BY 1, 2)"""

OVERLAP_PAIRS = _all_pairs("COALESCE(CAST(op.score AS DOUBLE), 0.0)",
                           "LEFT JOIN op ON op.query_pos = eq.query_pos AND op.cand_pos = c.pos")
TFIDF_PAIRS = _all_pairs("COALESCE(tp.score, 0.0)",
                         "LEFT JOIN tp ON tp.query_pos = eq.query_pos AND tp.cand_pos = c.pos")

RANKED_OUT = "\nSELECT query_id, CAST(rank AS INTEGER) AS rank, cand_id, round(score, 6) AS score FROM ranked"


def overlap_ranked() -> str:
    return _with_text(eligible_cte() + "," + OVERLAP_CTES + "," + ranked_cte(OVERLAP_PAIRS, "DESC") + RANKED_OUT)


def overlap_eval() -> str:
    return _with_text(eligible_cte() + "," + OVERLAP_CTES + "," + ranked_cte(OVERLAP_PAIRS, "DESC")
                      + metrics_select())


def tfidf_ranked() -> str:
    return _with_text(eligible_cte() + "," + TFIDF_CTES + "," + ranked_cte(TFIDF_PAIRS) + RANKED_OUT)


VEC_DIM = 300
VEC_CTES = f"""
trv AS (SELECT DISTINCT unnest(tokens) AS word FROM r WHERE split = 'train'),
wv AS (SELECT word, i, {uniform_lanes_sql('word', lane='i')} AS x FROM trv, range({VEC_DIM}) t(i)),
occ AS (SELECT pos, word, COUNT(*) AS tf FROM (SELECT pos, unnest(tokens) AS word FROM r) GROUP BY 1, 2),
mv AS (SELECT o.pos, wv.i, SUM(o.tf * wv.x) / SUM(o.tf) AS x FROM occ o JOIN wv USING (word) GROUP BY 1, 2),
vec AS (SELECT pos, list(x ORDER BY i) AS v FROM mv GROUP BY pos),
rv AS (SELECT r.pos, r.id, COALESCE(vec.v, list_transform(range({VEC_DIM}), lambda i: 0.0::DOUBLE)) AS v,
              sqrt(list_inner_product(COALESCE(vec.v, [0.0::DOUBLE]), COALESCE(vec.v, [0.0::DOUBLE]))) AS nrm
       FROM r LEFT JOIN vec USING (pos))"""

BLEND_W = 0.7
BLEND_PAIRS = f"""
SELECT eq.query_pos, eq.query_id, c.pos AS cand_pos, c.id AS cand_id, c.disc_id AS cand_disc,
       {BLEND_W}::DOUBLE * COALESCE(tp.score, 0.0)
       + (1.0::DOUBLE - {BLEND_W}::DOUBLE) * CASE WHEN cv.nrm > 0 AND qv.nrm > 0
             THEN list_inner_product(list_transform(cv.v, lambda x: x / cv.nrm), list_transform(qv.v, lambda x: x / qv.nrm))
             ELSE 0.0 END AS score
FROM eq JOIN r c ON c.pos < eq.query_pos
JOIN rv cv ON cv.pos = c.pos JOIN rv qv ON qv.pos = eq.query_pos
LEFT JOIN tp ON tp.query_pos = eq.query_pos AND tp.cand_pos = c.pos"""


def mean_vectors_random() -> str:
    return _with_text(VEC_CTES[1:] + "\nSELECT id, list_transform(v, lambda x: round(x, 6)) AS vector FROM rv")


def blend_ranked() -> str:
    return _with_text(eligible_cte() + "," + TFIDF_CTES + "," + VEC_CTES + "," + ranked_cte(BLEND_PAIRS) + RANKED_OUT)


def blend_eval() -> str:
    return _with_text(eligible_cte() + "," + TFIDF_CTES + "," + VEC_CTES + "," + ranked_cte(BLEND_PAIRS)
                      + metrics_select())


ORACLES.update({
    "word_freq": word_freq,
    "vocab_min2": vocab_min2,
    "corpus_properties": corpus_properties,
    "dup_clusters": dup_clusters,
    "idf_train": idf_train,
    "overlap_ranked": overlap_ranked,
    "overlap_eval": overlap_eval,
    "tfidf_ranked": tfidf_ranked,
    "mean_vectors_random": mean_vectors_random,
    "blend_ranked": blend_ranked,
    "blend_eval": blend_eval,
})


# ---------------------------------------------------------------- documentation examples
def _h(*parts: str) -> str:
    return h_sql(*parts)


def _u(*parts: str) -> str:
    return uniform_sql(*parts)


def doc_sentences_cte() -> str:
    return f"""
ds0 AS (SELECT conv_id AS section_id, turn AS sent_idx,
               flatten(coalesce({preprocess_sql('text')}, CAST([] AS VARCHAR[][]))) AS tokens FROM conversations),
ds1 AS (SELECT * FROM ds0 WHERE len(tokens) > 0),
s AS (SELECT ROW_NUMBER() OVER (ORDER BY section_id, sent_idx) - 1 AS seq, section_id,
             ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY sent_idx) - 1 AS idx_in_section,
             array_to_string(tokens, ' ') AS sentence, tokens FROM ds1),
tot AS (SELECT COUNT(*) AS total FROM s)"""


def doc_sentence_table() -> str:
    return "WITH " + doc_sentences_cte() + "\nSELECT seq, section_id, idx_in_section, sentence FROM s"


def nsp_pairs() -> str:
    return "WITH " + doc_sentences_cte() + f""",
b AS (SELECT s.seq, s.sentence AS sentence_a, {_u("'nsp'", 's.seq')} AS coin,
             greatest(s.seq - 10, 0) AS lo, least(s.seq + 10, total - 1) AS hi, total
      FROM s, tot WHERE s.seq < total - 1),
c AS (SELECT *, total - (hi - lo + 1) AS room, {_h("'nsp_neg'", 'seq')} AS d FROM b),
e AS (SELECT seq, sentence_a, CASE WHEN coin >= 0.5 THEN 0 ELSE 1 END AS label,
             CASE WHEN coin >= 0.5 THEN seq + 1
                  WHEN room > 0 THEN CASE WHEN d % room >= lo THEN d % room + (hi - lo + 1) ELSE d % room END
             END AS b_seq FROM c)
SELECT e.seq, e.b_seq, e.label, e.sentence_a, s2.sentence AS sentence_b
FROM e JOIN s s2 ON s2.seq = e.b_seq"""


def sase_pairs() -> str:
    return "WITH " + doc_sentences_cte() + f""",
sec AS (SELECT section_id, COUNT(*) AS sec_len FROM s GROUP BY section_id),
rk AS (SELECT section_id, sec_len, ROW_NUMBER() OVER (ORDER BY section_id) - 1 AS sec_rank,
              COUNT(*) OVER () AS n_sections FROM sec),
me AS (SELECT s.seq, s.section_id, s.idx_in_section, s.sentence AS sentence_a, rk.sec_rank, rk.n_sections,
              CASE WHEN {_u("'sase'", 's.seq')} >= 0.5 THEN 0 ELSE 1 END AS label,
              {_h("'sase_sec'", 's.seq')} AS d
       FROM s JOIN rk USING (section_id) WHERE s.idx_in_section < rk.sec_len - 1),
pos AS (SELECT me.seq, s2.seq AS b_seq, me.label, me.sentence_a, s2.sentence AS sentence_b
        FROM me JOIN s s2 ON s2.section_id = me.section_id AND s2.idx_in_section = me.idx_in_section + 1
        WHERE me.label = 0),
nn AS (SELECT *, CASE WHEN n_sections - 1 > 0 THEN
                   CASE WHEN d % (n_sections - 1) >= sec_rank THEN d % (n_sections - 1) + 1 ELSE d % (n_sections - 1) END
                 END AS other_rank FROM me WHERE label = 1),
neg AS (SELECT nn.seq, s2.seq AS b_seq, nn.label, nn.sentence_a, s2.sentence AS sentence_b
        FROM nn JOIN rk t ON t.sec_rank = nn.other_rank
        JOIN s s2 ON s2.section_id = t.section_id AND s2.idx_in_section = {_h("'sase_idx'", 'nn.seq')} % t.sec_len)
SELECT * FROM pos UNION ALL SELECT * FROM neg"""


def sts_pairs() -> str:
    return "WITH " + doc_sentences_cte() + f""",
p AS (SELECT s.seq, s.seq + 1 AS b_seq, 1.0::DOUBLE AS label, s.sentence AS sentence_a FROM s, tot
      WHERE s.seq < total - 1
      UNION ALL
      SELECT s.seq, s.seq + 10 + {_h("'sts'", 's.seq')} % (total - 1 - s.seq - 10) AS b_seq, 0.0::DOUBLE AS label,
             s.sentence AS sentence_a FROM s, tot WHERE s.seq + 10 < total - 1)
SELECT p.seq, p.b_seq, p.label, p.sentence_a, s2.sentence AS sentence_b FROM p JOIN s s2 ON s2.seq = p.b_seq"""


def mlm_masks() -> str:
    u = _u("'mlm'", "s.seq", "k - 1")
    return "WITH " + doc_sentences_cte() + f"""
SELECT s.seq, array_to_string(list_transform(tokens, lambda t, k: CASE WHEN {u} < 0.15 THEN '[MASK]' ELSE t END), ' ')
         AS masked, array_to_string(tokens, ' ') AS labels FROM s"""


def tsdae_pairs() -> str:
    u = _u("'tsdae'", "s.seq", "k - 1")
    return "WITH " + doc_sentences_cte() + f""",
f AS (SELECT s.seq, s.sentence, s.tokens, list_filter(tokens, lambda t, k: {u} > 0.6) AS kept FROM s)
SELECT seq, array_to_string(CASE WHEN len(kept) > 0 THEN kept
                                 ELSE [tokens[{_h("'tsdae_keep'", 'seq')} % len(tokens) + 1]] END, ' ') AS noisy,
       sentence AS target FROM f"""


ORACLES.update({
    "doc_sentence_table": doc_sentence_table,
    "nsp_pairs": nsp_pairs,
    "sase_pairs": sase_pairs,
    "sts_pairs": sts_pairs,
    "mlm_masks": mlm_masks,
    "tsdae_pairs": tsdae_pairs,
})


ORACLES.update({
    "online_dense_ranked": dense_ranked,    # the stream must equal the batch lists
    "online_dense_metrics": dense_eval,
    "online_overlap_ranked": overlap_ranked,
    "online_blend_metrics": blend_eval,
})


def results_table_dense() -> str:
    return ("WITH m AS (" + dense_eval() + ")\nSELECT k, success_rate AS \"TASK_SuccessRate@k\", "
            "map AS \"TASK_MAP@k\" FROM m")


ORACLES["results_table_dense"] = results_table_dense
