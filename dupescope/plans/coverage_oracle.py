"""DuckDB SQL of ``coverage_queries``, written on its own from the described results."""

from __future__ import annotations

from dupescope.functions.hashing import h_sql, uniform_lanes_sql
from dupescope.functions.lexicon import VERB_LEMMAS
from dupescope.plans import oracle as O

DIM = 300
KS = [1, 5, 10, 15, 20, 25]


def _odd() -> str:
    return ("'see https://a.b/c?d=' || doc_id || ' now [x] y]) z' || chr(12) || 'q' || chr(12) || 'r tail' || chr(10) "
            "|| coalesce(text, '') || chr(12) || 'end'")


def txt_noise_built() -> str:
    return f"SELECT doc_id, {O.remove_noise_sql('(' + _odd() + ')')} AS clean FROM documents"


def markdown_cte() -> str:
    """md(file_id, tokens) of the built Markdown files, before repeated files go. The built code fence is
    cut out, the built markup is removed from the head, and the documents' own text goes through the same patterns."""
    head = r"""'# Head *one*' || chr(10) || chr(10) || '```py' || chr(10) || 'x = dropped' || chr(10) || '```' || chr(10)
 || '> [link text](http://x/y) and `code`' || chr(10) || chr(10)"""
    raw = f"({head} || CASE WHEN doc_id % 3 = 0 THEN '<b>bold</b> &lt;kept&gt;' || chr(10) ELSE '' END || coalesce(text, ''))"
    plain = "c"
    for pattern, to in ((r"(?m)^[ \t]*#{1,6}[ \t]*", ""), (r"(?m)^[ \t]*>[ \t]?", ""), (r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1"),
                        (r"[*_]{1,3}([^*_\n]+)[*_]{1,3}", r"\1"), (r"`([^`\n]*)`", r"\1")):
        plain = f"regexp_replace({plain}, '{pattern}', '{to}', 'g')"
    return rf"""
src AS (SELECT doc_id AS file_id, {raw} AS content FROM documents),
fenced AS (SELECT file_id, content, regexp_matches(content, '<[a-zA-Z][^>]*>') AS tagged,
                  regexp_replace(content, '(?s)```[^\S\r\n]*[a-z]*\n.*?\n```', '', 'g') AS f FROM src),
text0 AS (SELECT file_id, tagged, {O.strip_html_sql('f')} AS c FROM fenced),
text1 AS (SELECT file_id, CASE WHEN tagged THEN c ELSE {plain} END AS x FROM text0),
md AS (SELECT file_id, {O.preprocess_sql('x')} AS tokens FROM text1),
mdk AS (SELECT * FROM md WHERE tokens IS NOT NULL QUALIFY file_id = MIN(file_id) OVER (PARTITION BY tokens))"""


def markdown_sections() -> str:
    return "WITH " + markdown_cte() + f"""
SELECT file_id, CAST(len(tokens) AS BIGINT) AS n_sentences, {O.format_sections_sql('tokens')} AS tokens FROM mdk"""


def markdown_files() -> str:
    return "WITH " + markdown_cte() + """,
u AS (SELECT file_id, unnest(range(len(tokens))) AS i, tokens FROM mdk)
SELECT file_id, CAST(i AS INTEGER) AS sent_idx, array_to_string(tokens[i + 1], ' ') AS sentence FROM u"""


def lemmas_cte() -> str:
    """lem(word, lemma) over voc(word)."""
    irregular = ", ".join(f"('{w}', '{b}')" for w, b in VERB_LEMMAS.items())
    tries = []
    for i, (cut, base) in enumerate((("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))):
        tries.append(f"SELECT word, {i} AS i, left(word, -{len(cut)}) || '{base}' AS lemma FROM voc WHERE ends_with(word, '{cut}')")
    return f"""
voc AS MATERIALIZED (SELECT DISTINCT unnest(tokens) AS word FROM r),
tries AS ({' UNION ALL '.join(tries)}),
reg AS MATERIALIZED (SELECT t.word, arg_min(t.lemma, t.i) AS lemma FROM tries t SEMI JOIN voc ON voc.word = t.lemma
        WHERE length(t.lemma) >= 3 AND t.lemma <> t.word GROUP BY t.word),
irr(word, lemma) AS (VALUES {irregular}),
lem AS MATERIALIZED (SELECT voc.word, coalesce(irr.lemma, reg.lemma) AS lemma FROM voc LEFT JOIN irr USING (word) LEFT JOIN reg USING (word)
        WHERE coalesce(irr.lemma, reg.lemma) <> voc.word)"""


def lemma_words() -> str:
    return O._with_text(lemmas_cte() + "\nSELECT word, lemma FROM lem")


def lemma_reports() -> str:
    return O._with_text(lemmas_cte() + """,
t AS (SELECT id, tokens, generate_subscripts(tokens, 1) AS i FROM r),
w AS (SELECT t.id, t.i, coalesce(lem.lemma, tokens[i]) AS word FROM t LEFT JOIN lem ON lem.word = t.tokens[i])
SELECT id, string_agg(word, ' ' ORDER BY i) AS tokens FROM w GROUP BY id""")


def report_sentence_rows() -> str:
    return O._with_text("""
s AS (SELECT pos, list_concat(coalesce(summary, []), coalesce(description, [])) AS s FROM r),
u AS (SELECT pos, s, unnest(range(len(s))) AS i FROM s)
SELECT pos, CAST(i AS INTEGER) AS sent_idx, array_to_string(s[i + 1], ' ') AS sentence FROM u""")


def tokens_min2() -> str:
    return O._with_text("""
f AS (SELECT word FROM (SELECT unnest(tokens) AS word FROM r) GROUP BY word HAVING count(*) >= 2),
t AS (SELECT id, tokens, generate_subscripts(tokens, 1) AS i FROM r),
k AS (SELECT t.id, string_agg(tokens[i], ' ' ORDER BY i) AS tokens FROM t JOIN f ON f.word = t.tokens[i] GROUP BY t.id)
SELECT r.id, coalesce(k.tokens, '') AS tokens FROM r LEFT JOIN k USING (id)""")


def first_sentences() -> str:
    return "WITH " + O.doc_sentences_cte() + "\nSELECT seq, sentence FROM s WHERE seq < 100"


def shuffled_sentences() -> str:
    return "WITH " + O.doc_sentences_cte() + f"""
SELECT seq, ROW_NUMBER() OVER (ORDER BY {h_sql('seq')}, seq) - 1 AS place FROM s"""


def validation_split() -> str:
    return "WITH " + O.dense_reports_cte() + """,
t AS (SELECT *, COUNT(*) OVER () AS m FROM r WHERE split = 'train')
SELECT id, CASE WHEN pos < CAST(trunc((1.0::DOUBLE - 0.1::DOUBLE) * m) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM t"""


def corpus_sizes() -> str:
    return O._with_text(O.doc_sentences_cte() + """,
z AS (SELECT 'report' AS source, count(*) AS n_rows, sum(len(tokens))::BIGINT AS n_tokens FROM r
      UNION ALL SELECT 'doc', count(*), sum(len(tokens))::BIGINT FROM s)
SELECT train_type, z.* FROM z, (VALUES ('TASK'), ('PT_TASK'), ('DOC_TASK'), ('PT_DOC_TASK')) t(train_type)
WHERE source = 'report' OR train_type LIKE '%DOC_TASK'""")


def split_files() -> str:
    return O._with_text("x AS (SELECT 1)") + "\nSELECT id, disc_id, pos, CAST(len(tokens) AS INTEGER) AS n_tokens FROM r WHERE split = 'test'"


def raw_csv_reports() -> str:
    return "WITH " + O.raw_reports_cte() + """
SELECT id, nullif(summary, '') AS summary, nullif(description, '') AS description, disc_id FROM raw"""


def example_counts() -> str:
    of = {"mlm": O.mlm_masks, "nsp": O.nsp_pairs, "sase": O.sase_pairs, "sts": O.sts_pairs, "tsdae": O.tsdae_pairs}
    return " UNION ALL ".join(f"SELECT '{task}' AS task, count(*) AS n FROM ({sql()})" for task, sql in of.items())


def _vectors(words: str, seed: int = 42, centred: bool = False) -> str:
    draws = [uniform_lanes_sql("word", lane=str(i), seed=seed) for i in range(DIM)]
    return f"SELECT word, [{', '.join(f'(({d}) - 0.5) / {DIM}' if centred else d for d in draws)}] AS v FROM {words}"


WORDS = """
tw AS (SELECT DISTINCT unnest(tokens) AS word FROM r WHERE split = 'train'),
aw AS (SELECT DISTINCT unnest(tokens) AS word FROM r),
sw AS (SELECT DISTINCT unnest(tokens) AS word FROM r WHERE split = 'test')"""


def _digest(bits: int = 32, v: str = "v") -> str:
    whole = f"list_transform({v}, lambda x: CAST(floor(x * {1 << bits}) AS BIGINT))"
    return (f"CAST(len({v}) AS BIGINT) AS n, {whole}[1] AS first, "
            f"CAST(list_sum(list_transform({whole}, lambda x, i: x * i)) AS BIGINT) AS checksum")


def centred_vectors() -> str:
    return O._with_text(WORDS + f", v AS ({_vectors('tw', centred=True)}) SELECT word, {_digest(40)} FROM v")


def overlay_vectors() -> str:
    other = "(SELECT word FROM aw WHERE contains(word, 'e'))"
    return O._with_text(WORDS + f""",
own AS ({_vectors('tw')}), pre AS ({_vectors(other, seed=7)}),
j AS (SELECT coalesce(pre.word, own.word) AS word, coalesce(pre.v, own.v) AS v FROM own FULL JOIN pre ON own.word = pre.word)
SELECT word, {_digest()} FROM j""")


def _grams(word: str) -> str:
    s = f"('<' || {word} || '>')"
    return (f"list_distinct(flatten(list_transform([3, 4, 5, 6], lambda n: list_transform(range(1, greatest(length({s}) - n + 2, 1)), "
            f"lambda i: substr({s}, i, n)))))")


def unseen_word_vectors() -> str:
    """The mean is linear, so both sums over the 300 numbers may be taken before the averages."""
    return O._with_text(WORDS + f""",
own AS ({_vectors('tw')}),
osum AS (SELECT word, list_sum(v) AS a, list_sum(list_transform(v, lambda x, i: x * i)) AS b FROM own),
og AS (SELECT unnest({_grams('word')}) AS gram, a, b FROM osum),
gv AS (SELECT gram, avg(a) AS a, avg(b) AS b FROM og GROUP BY gram),
un AS (SELECT word FROM sw WHERE word NOT IN (SELECT word FROM tw)),
ug AS (SELECT word, unnest({_grams('word')}) AS gram FROM un)
SELECT word, CAST({DIM} AS BIGINT) AS n, round(avg(a), 4) AS total, round(avg(b), 2) AS weighted FROM ug JOIN gv USING (gram) GROUP BY word""")


def pooled_vectors() -> str:
    return """
WITH e AS (SELECT label, CASE WHEN label <> 0 AND vec_id % 3 > 0 THEN 1 ELSE 0 END AS m, embedding, generate_subscripts(embedding, 1) AS i
           FROM embeddings),
p AS (SELECT label, i, sum(m * embedding[i]::DOUBLE) / greatest(sum(m), 1e-9) AS x FROM e GROUP BY label, i)
SELECT label, list(round(x, 6) ORDER BY i) AS vector FROM p GROUP BY label"""


def vector_files() -> str:
    return O._with_text(WORDS + f""",
v AS ({_vectors('tw')}),
w AS (SELECT word, kind, CASE WHEN kind = 'text' THEN CAST(CAST(CAST(v AS VARCHAR[]) AS FLOAT[]) AS DOUBLE[]) ELSE v END AS v
      FROM v, (VALUES ('text'), ('json'), ('parquet')) k(kind))
SELECT word, kind, {_digest(12)} FROM w""")


def approaches_ranked() -> str:
    return f"""
SELECT 'intersection' AS approach, * FROM ({O.overlap_ranked()}) UNION ALL
SELECT 'tf_idf' AS approach, * FROM ({O.blend_ranked()})"""


def _half() -> str:
    return O.dense_eval().replace("CAST(embedding AS DOUBLE[])", "CAST(embedding[1:32] AS DOUBLE[])")


def results_table_two() -> str:
    return f"""
WITH a AS ({O.dense_eval()}), b AS ({_half()})
SELECT k, a.success_rate AS "TASK_SuccessRate@k", b.success_rate AS "PT_TASK_SuccessRate@k", a.map AS "TASK_MAP@k", b.map AS "PT_TASK_MAP@k"
FROM a JOIN b USING (k)"""


def results_by_task() -> str:
    return f"""
WITH a AS ({O.dense_eval()}), b AS ({_half()})
SELECT k, a.map AS "TASK_MAP@k", b.map AS "DOC(mlm)_TASK_MAP@k", b.map AS "DOC(nsp)_TASK_MAP@k", b.success_rate AS "DOC(nsp)_TASK_SuccessRate@k"
FROM a JOIN b USING (k)"""


def best_model() -> str:
    return f"""
WITH m AS (SELECT 'TASK' AS run, map FROM ({O.dense_eval()}) WHERE k = 25
           UNION ALL SELECT 'PT_TASK', map FROM ({_half()}) WHERE k = 25)
SELECT run, map FROM m ORDER BY map DESC, run LIMIT 1"""


def validation_metrics() -> str:
    return "WITH " + O.dense_reports_cte() + f""",
q AS (SELECT * FROM r WHERE split = 'test'), c AS (SELECT * FROM r WHERE split = 'train'),
nrel AS (SELECT q.pos AS query_pos, count(*) AS n_rel FROM q JOIN c ON q.disc_id = c.disc_id GROUP BY q.pos),
sc AS (SELECT q.pos AS query_pos, c.pos AS cand_pos, CASE WHEN q.disc_id = c.disc_id THEN 1 ELSE 0 END AS hit,
              list_inner_product(list_transform(c.v, lambda x: x / sqrt(list_inner_product(c.v, c.v))), q.v) AS score FROM q, c),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_pos ORDER BY round(score, 10) DESC, cand_pos) AS rank FROM sc QUALIFY rank <= 25),
cu AS (SELECT rk.*, n_rel, SUM(hit) OVER (PARTITION BY query_pos ORDER BY rank) AS cum FROM rk JOIN nrel USING (query_pos)),
ks AS (SELECT unnest({KS}) AS k),
per AS (SELECT query_pos, k, n_rel, max(CASE WHEN rank <= k THEN hit ELSE 0 END) AS acc, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS n_hit,
               sum(CASE WHEN rank <= k AND hit = 1 THEN cum::DOUBLE / rank ELSE 0 END) AS sp FROM cu, ks GROUP BY query_pos, k, n_rel),
one AS (SELECT query_pos, n_rel, CASE WHEN min(CASE WHEN hit = 1 THEN rank END) <= 10 THEN 1.0 / min(CASE WHEN hit = 1 THEN rank END) ELSE 0 END AS rr,
               coalesce(sum(CASE WHEN hit = 1 AND rank <= 10 THEN 1.0 / log2(rank + 1) END), 0) AS dcg FROM cu GROUP BY query_pos, n_rel),
ideal AS (SELECT i, sum(1.0 / log2(j + 1)) AS idcg FROM range(1, 11) a(i), range(1, 11) b(j) WHERE j <= i GROUP BY i),
two AS (SELECT query_pos, rr, dcg / idcg AS nd FROM one JOIN ideal ON i = least(n_rel, 10))
SELECT k, round(avg(acc), 6) AS accuracy, round(avg(n_hit / k), 6) AS precision, round(avg(n_hit / n_rel), 6) AS recall,
       round(avg(sp / least(k, n_rel)), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(nd), 6) AS ndcg
FROM per JOIN two USING (query_pos) GROUP BY k"""


ORACLES = {f.__name__: f for f in (
    txt_noise_built, markdown_sections, markdown_files, lemma_words, lemma_reports, report_sentence_rows, tokens_min2,
    first_sentences, shuffled_sentences, validation_split, corpus_sizes, example_counts, split_files, raw_csv_reports, centred_vectors,
    overlay_vectors, unseen_word_vectors, pooled_vectors, vector_files, approaches_ranked, results_table_two,
    results_by_task, best_model, validation_metrics)}
