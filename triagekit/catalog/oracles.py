"""The same results as plain SQL, written independently of the Spark jobs: dense, row by row, with
global windows. Built from shared fragments, one per step."""

from __future__ import annotations

from triagekit.constants import (
    CONFIDENCE_THRESHOLD, GRID_ALPHA, GRID_MIN_DF, GRID_NGRAM, HOLDOUT_SHARE, MAX_TEXT_CHARS, N_CONFUSED_PAIRS,
    N_FOLDS, N_MEASURED, N_WORST_ERRORS, PRECISION_TARGET, QUALITY_FLOOR, SEED, STOP_WORDS, TOKEN_PATTERN,
)

WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}]"

VIEWS = {
    "t_lang": "SELECT doc_id, text AS ticket_text, lang AS category FROM documents",
    "t_quality": "SELECT doc_id, text AS ticket_text, quality::VARCHAR AS category FROM documents JOIN labels USING (doc_id)",
    "t_role": "SELECT conv_id * 1000 + turn AS doc_id, text AS ticket_text, role AS category FROM conversations",
}

SENTENCES = r"""
SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]')) AS ticket_text, quality::VARCHAR AS category
FROM documents LEFT JOIN labels USING (doc_id)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def base(view: str) -> str:
    return (
        f"base AS (SELECT doc_id, {strip('ticket_text')} AS ticket_text, {strip('category')} AS category "
        f"FROM ({VIEWS[view]}) WHERE ticket_text IS NOT NULL AND category IS NOT NULL "
        f"AND {strip('ticket_text')} <> '' AND {strip('category')} <> '')"
    )


def split(holdout: tuple[int, int] = HOLDOUT_SHARE, k: int = N_FOLDS) -> str:
    num, den = holdout
    size = lambda f: f"((off + dev + {k} - 1 - {f}) // {k} - (off + {k} - 1 - {f}) // {k})"
    upto = lambda f: " + ".join(size(g) for g in range(f + 1))
    fold = " ".join(f"WHEN r <= {upto(f)} THEN {f}" for f in range(k))
    return f"""cc AS (SELECT category, count(*) AS n FROM base GROUP BY category),
q0 AS (SELECT *, (sum(n) OVER ())::BIGINT AS total FROM cc),
q1 AS (SELECT *, total - (total * {num} + {den} - 1) // {den} AS dev_total FROM q0),
q2 AS (SELECT *, n * dev_total // total AS fq, n * dev_total % total AS rem FROM q1),
q3 AS (SELECT *, fq + CASE WHEN row_number() OVER (ORDER BY rem DESC, category) <= dev_total - sum(fq) OVER () THEN 1 ELSE 0 END AS dev FROM q2),
q4 AS (SELECT category, dev::BIGINT AS dev, (sum(dev) OVER (ORDER BY category) - dev)::BIGINT AS off FROM q3),
rk AS (SELECT b.*, dev, off, row_number() OVER (PARTITION BY b.category ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) AS r
       FROM base b JOIN q4 USING (category)),
sp AS (SELECT doc_id, ticket_text, category, CASE WHEN r <= dev THEN 'dev' ELSE 'holdout' END AS split,
       CASE WHEN r > dev THEN NULL {fold} END AS fold FROM rk)"""


STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
ALL_TOKENS = f"regexp_extract_all(lower(ticket_text), '{TOKEN_PATTERN}')"
TOKENS = f"list_filter({ALL_TOKENS}, lambda x: NOT list_contains({STOP}, x))"


def terms_of(ngram: int) -> str:
    if ngram == 1:
        return "t"
    return "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"


def tf(source: str, ngram: int) -> str:
    """Term counts of the rows of ``source``."""
    return f"""tk AS (SELECT doc_id, {TOKENS} AS t FROM {source}),
te AS (SELECT doc_id, unnest({terms_of(ngram)}) AS term FROM tk),
tf AS (SELECT doc_id, term, count(*) AS tf FROM te GROUP BY doc_id, term)"""


def weights(parts: int, ngram: int, min_df: int, tag: str = "") -> str:
    """TF-IDF per part, from ``docs (doc_id, category, part)`` and ``tf``."""
    gram = "" if ngram > 1 else "AND term NOT LIKE '% %'"
    return f"""ps{tag} AS (SELECT unnest(range({parts})) AS p),
nn{tag} AS (SELECT p, count(*)::DOUBLE AS n FROM docs, ps{tag} WHERE part <> p GROUP BY p),
df{tag} AS (SELECT p, term, count(*) AS df FROM tf JOIN docs USING (doc_id), ps{tag}
       WHERE part <> p {gram} GROUP BY p, term HAVING count(*) >= {min_df}),
uu{tag} AS (SELECT p, doc_id, term, tf, tf * (ln((n + 1) / (df + 1)) + 1) AS u FROM tf JOIN df{tag} USING (term) JOIN nn{tag} USING (p)),
ww{tag} AS (SELECT p, doc_id, term, tf, u / sqrt(sum(u * u) OVER (PARTITION BY p, doc_id)) AS w FROM uu{tag})"""


def bayes(parts: int, ngram: int = 2, min_df: int = 1, alpha: float = 0.1, tag: str = "") -> str:
    """Ranked class probabilities ``pr (doc_id, category, probability, place)`` for rows with a
    part of their own."""
    return f"""{weights(parts, ngram, min_df, tag)},
ss{tag} AS (SELECT p, d.category, term, sum(w) AS s FROM ww{tag} JOIN docs d USING (doc_id) WHERE part <> p GROUP BY p, d.category, term),
vv{tag} AS (SELECT p, count(*) AS v FROM df{tag} GROUP BY p),
cl{tag} AS (SELECT p, category, count(*) AS n FROM docs, ps{tag} WHERE part <> p GROUP BY p, category),
hd{tag} AS (SELECT c.p, c.category, ln(c.n / nn.n) AS prior, coalesce(d.d, 0) + {alpha}::DOUBLE * v.v AS den
       FROM cl{tag} c JOIN nn{tag} nn USING (p) JOIN vv{tag} v USING (p)
       LEFT JOIN (SELECT p, category, sum(s) AS d FROM ss{tag} GROUP BY p, category) d ON d.p = c.p AND d.category = c.category),
hit{tag} AS (SELECT x.doc_id, h.category, sum(w * (ln(coalesce(s, 0) + {alpha}::DOUBLE) - ln(den))) AS ll
       FROM ww{tag} x JOIN docs q ON q.doc_id = x.doc_id AND q.part = x.p JOIN hd{tag} h ON h.p = x.p
       LEFT JOIN ss{tag} s ON s.p = x.p AND s.term = x.term AND s.category = h.category
       GROUP BY x.doc_id, h.category),
sc{tag} AS (SELECT q.doc_id, q.part, q.category AS true_label, h.category, prior + coalesce(ll, 0) AS score
       FROM docs q JOIN hd{tag} h ON h.p = q.part LEFT JOIN hit{tag} t ON t.doc_id = q.doc_id AND t.category = h.category),
sm{tag} AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM sc{tag}),
sn{tag} AS (SELECT doc_id, part, true_label, category, round(e / sum(e) OVER (PARTITION BY doc_id), 12) AS probability FROM sm{tag}),
pr{tag} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, category) AS place FROM sn{tag}),
oof{tag} AS (SELECT doc_id, part AS fold, true_label AS category, category AS predicted_label, probability AS confidence FROM pr{tag} WHERE place = 1)"""


DEV = "docs AS (SELECT doc_id, category, fold AS part FROM sp WHERE split = 'dev')"
#: Every row is held out once, by a fit that has all classes and no slope left.
OPTIMAL = "SELECT doc_id, category, part AS fold, (SELECT count(DISTINCT category) FROM docs) AS classes, TRUE AS optimal FROM docs"
EMBEDDED = "base AS (SELECT vec_id AS doc_id, '' AS ticket_text, label::VARCHAR AS category FROM embeddings)"
DEV_TEXTS = "dt AS (SELECT doc_id, ticket_text FROM sp WHERE split = 'dev')"


def study_oof(view: str, ngram: int = 2, min_df: int = 1, alpha: float = 0.1) -> list[str]:
    return [base(view), split(), DEV, DEV_TEXTS, tf("dt", ngram), bayes(N_FOLDS, ngram, min_df, alpha)]


MAJORITY = f"""mp AS (SELECT unnest(range({N_FOLDS})) AS p),
mc AS (SELECT p, category, count(*) AS n FROM docs, mp WHERE part <> p GROUP BY p, category),
mj AS (SELECT p, category AS predicted_label FROM mc QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, category) = 1),
mo AS (SELECT doc_id, part AS fold, category, predicted_label FROM docs JOIN mj ON p = part)"""


def f1(source: str, by: str, name: str) -> str:
    """Macro-F1 per group of ``by`` over classes that are true or predicted."""
    return f"""{name}_l AS (SELECT DISTINCT {by}, category AS label FROM {source} UNION SELECT DISTINCT {by}, predicted_label FROM {source}),
{name}_c AS (SELECT l.{by}, l.label, count(*) FILTER (category = label AND predicted_label = label) AS tp,
       count(*) FILTER (category <> label AND predicted_label = label) AS fp,
       count(*) FILTER (category = label AND predicted_label <> label) AS fn
       FROM {name}_l l JOIN {source} s ON s.{by} = l.{by} GROUP BY l.{by}, l.label),
{name} AS (SELECT {by}, avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) AS macro_f1 FROM {name}_c GROUP BY {by})"""


SWEEP = """th AS (SELECT i::INT AS idx, i * 0.01::DOUBLE AS t FROM range(100) r(i)),
sw AS (SELECT idx, round(t, 2) AS threshold, count(*) FILTER (confidence >= t) AS accepted,
       count(*) FILTER (confidence >= t) / count(*) AS coverage,
       count(*) FILTER (confidence >= t AND category = predicted_label) / nullif(count(*) FILTER (confidence >= t), 0) AS precision
       FROM th, oof GROUP BY idx, t)"""

# Holdout rows are part 0; development rows belong to no part.
FINAL = "docs AS (SELECT doc_id, category, CASE WHEN split = 'dev' THEN -1 ELSE 0 END AS part FROM sp)"


def answers() -> list[str]:
    """All documents answered by the model of conversation roles."""
    reason = f"CASE WHEN text IS NULL OR {strip('text')} = '' THEN 'empty' WHEN length(text) > {MAX_TEXT_CHARS} THEN 'too_long' END"
    return [
        base("t_role"),
        split(),
        f"rq AS (SELECT doc_id, {strip('text')} AS ticket_text, {reason} AS reject_reason FROM documents)",
        # Requests get negative ids so that they cannot meet ids of training rows.
        """docs AS (SELECT doc_id, category, -1 AS part FROM sp WHERE split = 'dev'
       UNION ALL SELECT -1 - doc_id, NULL, 0 FROM rq WHERE reject_reason IS NULL)""",
        """dt AS (SELECT doc_id, ticket_text FROM sp WHERE split = 'dev'
       UNION ALL SELECT -1 - doc_id, ticket_text FROM rq WHERE reject_reason IS NULL)""",
        tf("dt", 2),
        bayes(1),
        f"""an AS (SELECT r.doc_id, CASE WHEN a.probability < {CONFIDENCE_THRESHOLD} THEN 'needs_review' ELSE a.category END AS category,
       round(a.probability, 4) AS confidence, a.probability < {CONFIDENCE_THRESHOLD} AS needs_review, reject_reason,
       CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN a.probability < {CONFIDENCE_THRESHOLD} THEN 'needs_review' ELSE 'accepted' END AS route,
       a.category AS category_1, round(a.probability, 4) AS probability_1, b.category AS category_2,
       round(b.probability, 4) AS probability_2, c.category AS category_3, round(c.probability, 4) AS probability_3
       FROM rq r LEFT JOIN pr a ON a.doc_id = -1 - r.doc_id AND a.place = 1
       LEFT JOIN pr b ON b.doc_id = -1 - r.doc_id AND b.place = 2 LEFT JOIN pr c ON c.doc_id = -1 - r.doc_id AND c.place = 3)""",
    ]


def _grid() -> str:
    parts = [base("t_role"), split(), DEV, DEV_TEXTS, tf("dt", 2)]
    rows, spec = [], 0
    for a in GRID_ALPHA:
        for m in GRID_MIN_DF:
            for n in GRID_NGRAM:
                parts += [bayes(N_FOLDS, n, m, a, f"_{spec}"), f1(f"oof_{spec}", "fold", f"f_{spec}")]
                rows.append(
                    f"SELECT {spec} AS spec, {a}::DOUBLE AS alpha, {m} AS min_df, {n} AS ngram_max, "
                    f"avg(macro_f1) AS mean, stddev_pop(macro_f1) AS std FROM f_{spec}"
                )
                spec += 1
    return ctes(*parts, "al AS (" + "\nUNION ALL ".join(rows) + ")") + (
        "SELECT spec, alpha, min_df, ngram_max, round(mean, 6) AS mean, round(std, 6) AS std, "
        "row_number() OVER (ORDER BY round(mean, 12) DESC, spec) AS rank FROM al"
    )


def _choice() -> str:
    out = []
    for view in ("t_role", "t_quality"):
        for target in (0.6, PRECISION_TARGET):
            out.append(
                "SELECT * FROM (" + ctes(*study_oof(view), SWEEP, f"ok AS (SELECT min(idx) AS idx FROM sw WHERE precision > {target})")
                + f"SELECT '{view}' AS view, {target}::DOUBLE AS target, threshold, accepted, round(coverage, 6) AS coverage, "
                "round(precision, 6) AS precision FROM ok LEFT JOIN sw USING (idx))"
            )
    return "\nUNION ALL ".join(out)


REASON = f"CASE WHEN text IS NULL OR {strip('text')} = '' THEN 'empty' WHEN length(text) > {MAX_TEXT_CHARS} THEN 'too_long' END"


def oracle_sql() -> dict[str, str]:
    role = study_oof("t_role")
    done = answers()
    flat = (
        "SELECT doc_id, category, confidence, needs_review, reject_reason, route, category_1, probability_1, "
        "category_2, probability_2, category_3, probability_3 FROM an"
    )
    summary = lambda source: f"SELECT round(avg(macro_f1), 6) AS mean, round(stddev_pop(macro_f1), 6) AS std, count(*) AS folds FROM {source}"
    one_word = [base("t_lang"), "docs AS (SELECT doc_id, category, -1 AS part FROM base)"]
    top3 = ", ".join(
        f"max(p.category) FILTER (place = {i}) AS category_{i}, round(max(probability) FILTER (place = {i}), 6) AS probability_{i}"
        for i in (1, 2, 3)
    )
    histogram = "SELECT lang AS category, count(*) AS count FROM documents GROUP BY lang"
    nb_model = (
        ctes(base("t_role"), split(), FINAL, tf("sp", 2), bayes(1))
        + "SELECT term, s.category, round(s, 6) AS weight_sum, round(ln(s + 0.1::DOUBLE) - ln(den), 6) AS log_likelihood "
        "FROM ss s JOIN hd h ON h.p = s.p AND h.category = s.category"
    )
    return {
        "clean_filter": f"""SELECT doc_id, {strip('ticket_text')} AS ticket_text, {strip('category')} AS category FROM ({SENTENCES})
WHERE ticket_text IS NOT NULL AND category IS NOT NULL AND {strip('ticket_text')} <> '' AND {strip('category')} <> ''""",
        "union_labeled": """SELECT md5(text) AS text_md5, lang AS category, source, NULL::BIGINT AS turn FROM documents
UNION ALL SELECT md5(text), role, NULL, turn FROM conversations""",
        "tag_and_append": """SELECT md5(text) AS text_md5, 'document' AS category FROM documents
UNION ALL SELECT md5(text), 'turn' FROM conversations UNION ALL SELECT md5(text), 'item' FROM benchmark
UNION ALL SELECT md5(html), 'page' FROM pages""",
        "rename_and_select": "SELECT md5(text) AS text_md5, lang AS category FROM documents",
        "class_histogram": histogram,
        "report_csv": histogram,
        "cache_reuse": histogram,
        "metric_report": "SELECT lang || '=' || printf('%.4f', avg(length(text))) AS line FROM documents GROUP BY lang",
        "csv_round_trip": ctes(base("t_lang")) + "SELECT md5(ticket_text) AS text_md5, category FROM base",
        "oof_by_conversation": """SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id END AS doc_id, role AS category, count(*) AS rows
FROM conversations GROUP BY ALL""",
        "class_extremes": """WITH c AS (SELECT lang AS l, count(*) AS n FROM documents GROUP BY lang)
SELECT sum(n)::BIGINT AS row_count, count(*) AS class_count, min(n) AS min_count,
(SELECT l FROM c ORDER BY n, l LIMIT 1) AS min_category, max(n) AS max_count,
(SELECT l FROM c ORDER BY n DESC, l LIMIT 1) AS max_category FROM c""",
        "sorted_labels": "SELECT DISTINCT role AS category FROM conversations",
        "duplicate_rate": """SELECT count(*) AS row_count, count(DISTINCT text) AS distinct_count,
round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_rate FROM documents""",
        "median_by_group": "SELECT event_type, count(value) AS row_count, round(median(value), 6) AS median FROM events GROUP BY event_type",
        "display_labels": r"""WITH l AS (SELECT lower(replace(p_type, ' ', '_')) AS label FROM part UNION ALL SELECT url FROM pages),
g AS (SELECT label, replace(label, '_', ' ') AS s, count(*) AS count FROM l GROUP BY label)
SELECT label, array_to_string(list_transform(range(1, length(s) + 1), lambda i:
CASE WHEN regexp_matches(s[i], '[a-z]') AND (i = 1 OR NOT regexp_matches(s[i - 1], '[A-Za-z0-9_]')) THEN upper(s[i]) ELSE s[i] END), '') AS shown,
count FROM g""",
        "measuring_sample": f"SELECT doc_id, length(text) AS n_chars FROM documents ORDER BY doc_id LIMIT {N_MEASURED}",
        "request_parse": f"""WITH r AS (SELECT 'c' || conv_id || '-' || turn AS request_id, text FROM conversations
UNION ALL SELECT 'e' || event_id, json_extract_string(props, '$.text') FROM events)
SELECT request_id, {REASON} AS reject_reason, CASE WHEN {REASON} IS NULL THEN md5({strip('text')}) END AS text_md5 FROM r""",
        "request_validation": f"""WITH r AS (SELECT doc_id, text, 'document' AS kind FROM documents
UNION ALL SELECT doc_id, ticket_text, 'sentence' FROM ({SENTENCES}))
SELECT doc_id, kind, {REASON} AS reject_reason, CASE WHEN {REASON} IS NULL THEN length({strip('text')}) END AS clean_chars,
CASE WHEN {REASON} IS NULL THEN md5({strip('text')}) END AS text_md5 FROM r""",
        "holdout_split": ctes(base("t_lang"), split()) + "SELECT doc_id, category, split FROM sp",
        "fold_assign": ctes(base("t_role"), split((0, 100))) + "SELECT doc_id, category, fold FROM sp",
        "lr_certificate": ctes(base("t_role"), split(), DEV) + OPTIMAL,
        "embedding_certificate": ctes(EMBEDDED, split(), DEV) + OPTIMAL,
        "dev_folds": ctes(base("t_quality"), split()) + "SELECT category, split, fold, count(*) AS count FROM sp GROUP BY category, split, fold",
        "tokens": ctes(base("t_lang")) + f"""SELECT doc_id, len({ALL_TOKENS}) AS n_all, len({TOKENS}) AS n_kept,
array_to_string({TOKENS}, ' ') AS tokens FROM base""",
        "ngrams": ctes(base("t_role"), f"tk AS (SELECT doc_id, {TOKENS} AS t FROM base)")
        + f"SELECT doc_id, len({terms_of(2)}) AS n_terms, array_to_string({terms_of(2)}, '|') AS terms FROM tk",
        "term_counts": ctes(base("t_lang"), tf("base", 1)) + "SELECT doc_id, term, tf FROM tf",
        "doc_freq": ctes(*one_word, tf("base", 2), weights(1, 2, 2))
        + "SELECT term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM df JOIN nn USING (p)",
        "tfidf": ctes(*one_word, tf("base", 1), weights(1, 1, 1)) + "SELECT doc_id, term, tf, round(w, 6) AS weight FROM ww",
        "tfidf_holdout": ctes(base("t_lang"), split(), FINAL, tf("sp", 2), weights(1, 2, 3))
        + "SELECT doc_id, term, tf, round(w, 6) AS weight FROM ww JOIN docs USING (doc_id) WHERE part = 0",
        "nb_model": nb_model,
        "saved_model": nb_model,
        "nb_oof_topk": ctes(*study_oof("t_lang"))
        + f"SELECT o.doc_id, o.category, o.fold, o.predicted_label, round(o.confidence, 6) AS confidence, {top3} "
        "FROM oof o JOIN pr p ON p.doc_id = o.doc_id GROUP BY o.doc_id, o.category, o.fold, o.predicted_label, o.confidence",
        "majority_oof": ctes(base("t_quality"), split(), DEV, MAJORITY) + "SELECT doc_id, category, fold, predicted_label FROM mo",
        "macro_f1_by_fold": ctes(*study_oof("t_quality"), MAJORITY, f1("oof", "fold", "fa"), f1("mo", "fold", "fb"))
        + "SELECT 'naive_bayes' AS model, fold, round(macro_f1, 6) AS macro_f1 FROM fa UNION ALL "
        "SELECT 'baseline_most_frequent', fold, round(macro_f1, 6) FROM fb",
        "cv_summary": ctes(*role, MAJORITY, f1("oof", "fold", "fa"), f1("mo", "fold", "fb"))
        + f"SELECT 'naive_bayes' AS model, * FROM ({summary('fa')}) UNION ALL SELECT 'baseline_most_frequent', * FROM ({summary('fb')})",
        "class_f1": ctes(*role, "o1 AS (SELECT *, 1 AS one FROM oof)", f1("o1", "one", "fa"))
        + "SELECT label, tp, fp, fn, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM fa_c",
        "confusion_long": ctes(*role)
        + "SELECT category AS true_label, predicted_label, count(*) AS count FROM oof GROUP BY category, predicted_label",
        "confusion_wide": ctes(*role)
        + """SELECT category AS true_label, count(*) FILTER (predicted_label = 'assistant') AS as_assistant,
count(*) FILTER (predicted_label = 'system') AS as_system, count(*) FILTER (predicted_label = 'user') AS as_user FROM oof GROUP BY category""",
        "confused_pairs": ctes(*role)
        + f"""SELECT category AS true_label, predicted_label, count(*) AS count FROM oof WHERE category <> predicted_label
GROUP BY category, predicted_label ORDER BY count(*) DESC, category, predicted_label LIMIT {N_CONFUSED_PAIRS}""",
        "worst_errors": ctes(*role)
        + f"""SELECT o.doc_id, ticket_text, o.category AS true_label, predicted_label, round(confidence, 6) AS confidence
FROM oof o JOIN sp USING (doc_id) WHERE o.category <> predicted_label ORDER BY o.confidence DESC, o.doc_id LIMIT {N_WORST_ERRORS}""",
        "threshold_sweep": ctes(*role, SWEEP)
        + "SELECT idx, threshold, accepted, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM sw",
        "threshold_choice": _choice(),
        "sweep_display": ctes(*study_oof("t_quality"), SWEEP)
        + "SELECT threshold, accepted, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM sw WHERE idx % 10 = 0",
        "review_flags": ctes(*role)
        + f"""SELECT doc_id, confidence < {CONFIDENCE_THRESHOLD} AS needs_review, confidence >= {CONFIDENCE_THRESHOLD} AS accepted,
category = predicted_label AS correct, round_even(confidence * 100, 0)::INT AS percent FROM oof""",
        "model_select": ctes(
            *role, f1("oof", "fold", "fa"), bayes(N_FOLDS, 1, 2, 1.0, "_c"), f1("oof_c", "fold", "fb"),
            "x AS (SELECT avg(macro_f1) AS dm, stddev_pop(macro_f1) AS ds FROM fa)",
            "y AS (SELECT avg(macro_f1) AS cm, stddev_pop(macro_f1) AS cs FROM fb)",
        )
        + """SELECT round(abs(dm - cm), 6) AS gap, round(greatest(ds, cs), 6) AS bar, abs(dm - cm) > greatest(ds, cs) AS "distinct",
CASE WHEN abs(dm - cm) > greatest(ds, cs) AND cm > dm THEN 'naive_bayes_smooth' ELSE 'naive_bayes' END AS chosen FROM x, y""",
        "holdout_eval": ctes(base("t_role"), split(), FINAL, tf("sp", 2), bayes(1), f1("oof", "fold", "fa"))
        + """SELECT (SELECT round(macro_f1, 6) FROM fa) AS macro_f1, count(*) AS rows,
count(*) FILTER (category = predicted_label) AS correct FROM oof""",
        "quality_gate": ctes(*study_oof("t_lang"), MAJORITY, f1("oof", "fold", "fa"), f1("mo", "fold", "fb"))
        + f"""SELECT model, round(m, 6) AS value, {QUALITY_FLOOR}::DOUBLE AS floor, m > {QUALITY_FLOOR} AS passed FROM (
SELECT 'naive_bayes' AS model, avg(macro_f1) AS m FROM fa UNION ALL SELECT 'baseline_most_frequent', avg(macro_f1) FROM fb)""",
        "nb_grid": _grid(),
        "tuning_report": f"""SELECT 'naive_bayes' AS model, 'alpha=' || alpha || ', min_df=' || min_df || ', ngram_max=' || ngram_max AS best_params,
mean, std FROM ({_grid()}) WHERE rank = 1""",
        "classify_batch": ctes(*done) + flat,
        "stream_classify": ctes(*done) + flat,
        "route_counts": ctes(*done) + "SELECT route, count(*) AS count FROM an GROUP BY route",
        "summary_lines": ctes(*done)
        + """SELECT doc_id, CASE WHEN needs_review THEN 'NEEDS REVIEW (top guess ''' || category_1 || ''' at only ' || round_even(confidence * 100, 0)::INT || '% confidence)'
ELSE 'Predicted category: ' || category_1 || ' (' || round_even(confidence * 100, 0)::INT || '% confidence)' END AS summary FROM an WHERE reject_reason IS NULL""",
        "response_json": ctes(*done)
        + """SELECT doc_id, category, confidence, needs_review, category_1 || '=' || round(probability_1 * 10000)::INT || '|' || category_2 || '='
|| round(probability_2 * 10000)::INT || '|' || category_3 || '=' || round(probability_3 * 10000)::INT AS top FROM an WHERE reject_reason IS NULL""",
        "encode_batch": "SELECT doc_id, "
        + ", ".join(
            f"round(((length(text) - length(replace(text, '{x}', ''))) / length(text))::FLOAT::DOUBLE, 4) AS v{i}"
            for i, x in enumerate("aeio")
        )
        + " FROM documents",
    }
