"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from ..schemas import FEATURES
from .queries import BAD, BIAS, LOSSES, NUMERIC, PENALTY, SAMPLE, WEIGHTS

_BASE = r"""
WITH toks AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS t FROM documents),
postings AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS frequency FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
stats AS (SELECT coalesce(avg(len(t)), 0) AS avg_doc_length, count(*) AS doc_count FROM toks),
q AS (SELECT item_id AS query_id, list_slice(regexp_extract_all(coalesce(text, ''), '\S+'), 1, 3) AS terms FROM benchmark),
qt AS (SELECT query_id, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM q),
qd AS (SELECT DISTINCT query_id, term FROM qt),
idfs AS (SELECT t.term, ln(CAST(any_value(s.doc_count) AS DOUBLE) / (count(p.doc_id) + 1)) AS idf FROM (SELECT DISTINCT term FROM qd) t CROSS JOIN stats s LEFT JOIN postings p ON p.term = t.term GROUP BY t.term),
meta AS (SELECT d.doc_id, CAST(len(k.t) AS INTEGER) AS doc_length, coalesce(p.url, '') AS url FROM documents d JOIN toks k ON k.doc_id = d.doc_id {how} JOIN pages p ON p.page_id = d.doc_id),
tf AS (SELECT qd.query_id, p.doc_id, qd.term, sum(p.frequency) AS tf FROM qd JOIN postings p USING (term) GROUP BY ALL),
cand AS (SELECT DISTINCT query_id, doc_id FROM tf),
grid AS (SELECT c.query_id, c.doc_id, qt.pos, qt.term, CAST(coalesce(tf.tf, 0) AS DOUBLE) AS tf, tf.tf IS NOT NULL AS present, i.idf, coalesce(m.doc_length, 0) AS doc_length, coalesce(m.url, '') AS url, m.doc_id IS NOT NULL AS has_meta
  FROM cand c JOIN qt USING (query_id) LEFT JOIN tf ON tf.query_id = c.query_id AND tf.doc_id = c.doc_id AND tf.term = qt.term JOIN idfs i ON i.term = qt.term LEFT JOIN meta m ON m.doc_id = c.doc_id),
scored AS (SELECT query_id, doc_id, CASE WHEN any_value(has_meta) THEN coalesce(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_length / s.avg_doc_length))) FILTER (present), 0) ELSE 0 END AS bm25 FROM grid CROSS JOIN stats s GROUP BY query_id, doc_id),
tgt AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS h FROM pages),
each_h AS (SELECT page_id, unnest(list_distinct(h)) AS x FROM tgt),
known AS (SELECT x, count(*) - 1 AS others FROM each_h GROUP BY x),
inward AS (SELECT page_id, sum(others) AS n FROM each_h JOIN known USING (x) GROUP BY page_id),
links AS (SELECT url, CAST(1.0 AS DOUBLE) / (1 + page_id) AS page_rank, CAST(coalesce(n, 0) AS INTEGER) AS in_link_count, CAST(len(h) AS INTEGER) AS out_link_count FROM tgt LEFT JOIN inward USING (page_id) WHERE page_id % 2 = 0)
"""
BASE = _BASE.replace("{how}", "LEFT")

_RID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
_ROWS = f"""
WITH r AS (SELECT {_RID} AS rid, CAST((l_linenumber - 1) % 5 AS INTEGER) AS relevance, l_orderkey AS qid,
  CAST(trunc(l_quantity) AS INTEGER) AS q, l_extendedprice AS x, l_discount + 0.0 AS d FROM lineitem),
pairs AS (SELECT a.qid, a.rid AS i, b.rid AS j, a.q - b.q AS q, a.x - b.x AS x, a.d - b.d AS d, CASE WHEN a.relevance < b.relevance THEN -1 ELSE 1 END AS y
  FROM r a JOIN r b ON a.qid = b.qid AND a.rid <> b.rid AND abs(a.relevance - b.relevance) >= 3),
chosen AS (SELECT * FROM pairs ORDER BY md5(concat_ws(':', '42', qid, i, j)), qid, i, j LIMIT {SAMPLE}),
mixed AS (SELECT *, CAST(row_number() OVER (ORDER BY md5(concat_ws(':', 'shuffle42', qid, i, j)), qid, i, j) AS INTEGER) AS position FROM chosen)
"""
_NUM = f"""
WITH n AS (SELECT {_RID} AS rid, {', '.join(f'{c} + 0.0 AS {c}' for c in NUMERIC)}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y FROM lineitem),
f AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}' for c in NUMERIC)} FROM n),
z AS (SELECT rid, y, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in NUMERIC)} FROM n CROSS JOIN f),
p AS (SELECT *, 1 / (1 + exp(-({' + '.join(f'{c} * CAST({w} AS DOUBLE)' for c, w in zip(NUMERIC, WEIGHTS, strict=True))} + CAST({BIAS} AS DOUBLE)))) AS p, CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END AS t FROM z)
"""


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _five(value: str, where: str = "TRUE") -> str:
    x = f"SELECT query_id, doc_id, pos, {value} AS v FROM grid WHERE {where}"
    return f"{BASE} SELECT query_id, doc_id, {_r('sum(v)')} AS \"sum\", {_r('min(v)')} AS \"min\", {_r('max(v)')} AS \"max\", {_r('avg(v)')} AS mean, {_r('var_pop(v)')} AS variance FROM ({x}) GROUP BY query_id, doc_id"


def _features(how: str = "LEFT", links: str = "TRUE") -> str:
    ntf = "CASE WHEN doc_length > 0 THEN tf / doc_length ELSE 0 END"
    agg = {"CoveredQueryTermNumber": "CAST(count(*) FILTER (present) AS INTEGER)", "CoveredQueryTermRatio": _r("CAST(count(*) FILTER (present) AS DOUBLE) / count(*)"), "StreamLength": "CAST(any_value(doc_length) AS INTEGER)"}
    for v, suffix in (("tf", "TermFrequency"), (ntf, "StreamLengthNormalizedTF"), ("tf * idf", "TFIDF")):
        for f, name in (("sum", "Sum"), ("min", "Min"), ("max", "Max"), ("avg", "Mean"), ("var_pop", "Variance")):
            agg[name + suffix] = f"CAST({f}({v}) AS INTEGER)" if suffix == "TermFrequency" and name in ("Sum", "Min", "Max") else _r(f"{f}({v})")
    agg |= {"BM25": _r("any_value(s.bm25)"), "NumSlashesInURL": "CAST(len(any_value(g.url)) - len(replace(any_value(g.url), '/', '')) AS INTEGER)", "LengthOfURL": "CAST(strlen(any_value(g.url)) AS INTEGER)"}
    agg |= {"InlinkCount": "coalesce(any_value(l.in_link_count), 0)", "OutlinkCount": "coalesce(any_value(l.out_link_count), 0)", "PageRank": _r("coalesce(any_value(l.page_rank), 0)")}
    columns = ", ".join(f"CASE WHEN any_value(has_meta) THEN {agg[n]} ELSE 0 END AS {n}" for n in FEATURES)
    return f"{_BASE.replace('{how}', how)} SELECT g.query_id, g.doc_id, {columns} FROM grid g JOIN scored s ON s.query_id = g.query_id AND s.doc_id = g.doc_id LEFT JOIN (SELECT * FROM links WHERE {links}) l ON l.url = g.url GROUP BY g.query_id, g.doc_id"


def _unpivot(items: list[tuple[str, ...]], names: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {n}" for v, n in zip(item, names, strict=True)) + f" FROM {source}" for item in items)


_RANKED = f"{BASE}, ranked AS (SELECT query_id, doc_id, round(bm25, 9) AS b, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS INTEGER) AS rank FROM scored)"
_CONF = "WITH l AS (SELECT CASE WHEN quality = 1 THEN 1 ELSE -1 END AS a, CASE WHEN toxic = 1 THEN 1 ELSE -1 END AS p FROM labels), c AS (SELECT count(*) FILTER (a = 1 AND p = 1) AS tp, count(*) FILTER (a = -1 AND p = 1) AS fp, count(*) FILTER (a = -1 AND p = -1) AS tn, count(*) FILTER (a = 1 AND p = -1) AS fn FROM l)"


def _report() -> str:
    base = "WITH c AS (SELECT " + ", ".join(f"count(*) FILTER (quality = {c} AND toxic = {c}) AS h{c}, count(*) FILTER (toxic = {c}) AS s{c}, count(*) FILTER (quality = {c}) AS t{c}" for c in (0, 1)) + " FROM labels)"
    base += ", m AS (SELECT *, " + ", ".join(f"CASE WHEN s{c} = 0 THEN 0 ELSE h{c} / s{c} END AS p{c}, CASE WHEN t{c} = 0 THEN 0 ELSE h{c} / t{c} END AS r{c}" for c in (0, 1)) + " FROM c)"
    base += ", f AS (SELECT *, " + ", ".join(f"CASE WHEN p{c} + r{c} = 0 THEN 0 ELSE 2 * p{c} * r{c} / (p{c} + r{c}) END AS f{c}" for c in (0, 1)) + ", CAST(h0 + h1 AS DOUBLE) / (t0 + t1) AS a, t0 + t1 AS n FROM m)"
    lines = [(f"'{c}'", _r(f"p{c}"), _r(f"r{c}"), _r(f"f{c}"), f"t{c}") for c in (0, 1)] + [("'accuracy'", *[_r("a")] * 3, "n")]
    lines += [("'macro avg'", *[_r(f"({x}0 + {x}1) / 2") for x in "prf"], "n"), ("'weighted avg'", *[_r(f"({x}0 * t0 + {x}1 * t1) / n") for x in "prf"], "n")]
    return base + " " + _unpivot(lines, ("class", "precision", "recall", "f1", "support"), "f")


def _anova() -> str:
    g = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in NUMERIC)
    base = f"{_NUM}, g AS (SELECT y, count(*) AS k, {g} FROM n GROUP BY y), t AS (SELECT sum(k) AS n, count(*) AS groups, {', '.join(f'sum(k * m_{c}) / sum(k) AS a_{c}' for c in NUMERIC)} FROM g)"
    return base + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'sum(k * (m_{c} - a_{c}) ** 2) / (max(groups) - 1) / (sum(k * v_{c}) / (max(n) - max(groups)))')} AS f FROM g CROSS JOIN t" for c in NUMERIC)


_VECTOR = " || ',' || ".join({"SumTermFrequency": "CAST(q * 100 AS BIGINT)", "BM25": "CAST(round(x * 100) AS BIGINT)", "PageRank": "CAST(round(d * 100) AS BIGINT)"}.get(n, "'0'") for n in FEATURES)
_BAD_REASONS = ["fewer than two fields", "fewer than two fields", "relevance", "qid", "feature without one colon", "feature id", "feature value"]
assert len(_BAD_REASONS) == len(BAD) - 1


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(f"({i}, {x})" for i, x in enumerate(LOSSES))
    return {
        "tokenize": BASE + "SELECT query_id, CAST(pos AS INTEGER) AS pos, term FROM qt",
        "query_terms_distinct": BASE + "SELECT query_id, term FROM qd",
        "validate_queries": BASE + "SELECT CAST(query_id AS VARCHAR) AS query_id, len(terms) > 0 AS is_valid FROM q UNION ALL VALUES ('', FALSE), ('x', FALSE)",
        "scan_postings_term": BASE + "SELECT doc_id, frequency FROM postings WHERE term = 'the'",
        "query_postings": BASE + "SELECT query_id, term, doc_id, frequency FROM qd LEFT JOIN postings USING (term)",
        "json_decode_postings": "SELECT * FROM (VALUES ('a', 'd1', 3), ('a', 'd2', 2), ('c', 'd3', 0)) v(term, doc_id, frequency)",
        "scan_metadata": r"""SELECT d.doc_id, CAST(len(regexp_extract_all(coalesce(d.text, ''), '\S+')) AS INTEGER) AS doc_length, '2024-01-01T00:00:00Z' AS time_last_updated, d.source AS doc_type,
            CAST(coalesce(len(regexp_extract_all(p.html, '<img')), 0) AS INTEGER) AS image_count, coalesce(regexp_extract(p.html, '(?s)<title>(.*?)</title>', 1), '') AS doc_title, coalesce(p.url, '') AS url
            FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""",
        "scan_links": BASE + f"SELECT url, {_r('page_rank')} AS page_rank, in_link_count, out_link_count FROM links",
        "corpus_stats": BASE + f"SELECT {_r('avg_doc_length')} AS avg_doc_length, doc_count FROM stats",
        "doc_freq": BASE + "SELECT term, count(*) AS df FROM postings GROUP BY term",
        "idf": BASE + f"SELECT term, {_r('idf')} AS idf FROM idfs",
        "doc_term_freq": BASE + "SELECT query_id, doc_id, term, CAST(tf AS BIGINT) AS tf FROM tf",
        "term_coverage": BASE + f"SELECT query_id, doc_id, CAST(count(*) FILTER (present) AS INTEGER) AS covered, {_r('CAST(count(*) FILTER (present) AS DOUBLE) / count(*)')} AS ratio FROM grid GROUP BY query_id, doc_id",
        "tf_stats": _five("tf"),
        "norm_tf_stats": _five("CASE WHEN doc_length > 0 THEN tf / doc_length ELSE 0 END"),
        "tfidf_stats": _five("tf * idf"),
        "bm25": BASE + f"SELECT query_id, doc_id, {_r('bm25')} AS bm25 FROM scored",
        "url_features": "SELECT page_id, CAST(len(coalesce(url, '')) - len(replace(coalesce(url, ''), '/', '')) AS INTEGER) AS num_slashes, CAST(strlen(coalesce(url, '')) AS INTEGER) AS url_length FROM pages",
        "features_all": _features(),
        "features_missing_metadata": _features("INNER"),
        "features_missing_links": _features(links="FALSE"),
        "rank_documents": _RANKED + f"SELECT query_id, doc_id, {_r('b')} AS bm25, rank FROM ranked WHERE rank <= 1000",
        "top_k": _RANKED + "SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10",
        "rank_no_match": "SELECT CAST(0 AS BIGINT) AS n",
        "letor_parse": _ROWS + f"SELECT rid, relevance, qid, q AS SumTermFrequency, {_r('x')} AS BM25, {_r('d')} AS PageRank, CAST(0 AS INTEGER) AS CoveredQueryTermNumber FROM r",
        "letor_bad_rows": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_BAD_REASONS)) + ") v(line_no, reason)",
        "qid_group_sizes": _ROWS + "SELECT qid, count(*) AS n FROM r GROUP BY qid",
        "pair_join": _ROWS + "SELECT qid, i, j FROM pairs",
        "pair_features": _ROWS + f"SELECT qid, i, j, q AS SumTermFrequency, {_r('x')} AS BM25, {_r('d')} AS PageRank FROM pairs",
        "pair_label": _ROWS + "SELECT qid, i, j, y FROM pairs",
        "reservoir_sample": _ROWS + "SELECT qid, i, j FROM chosen",
        "shuffle_pairs": _ROWS + "SELECT position, qid, i, j FROM mixed",
        "pairwise_examples": _ROWS + f"SELECT position, qid, i, j, q AS SumTermFrequency, {_r('x')} AS BM25, {_r('d')} AS PageRank, y FROM mixed",
        "csv_format": _ROWS + "SELECT i, j, CAST(q AS VARCHAR) AS SumTermFrequency, printf('%.6f', x) AS BM25, printf('%.6f', d) AS PageRank, CAST(y AS VARCHAR) AS y FROM pairs",
        "pairs_roundtrip": _ROWS + 'SELECT y AS "Y", count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM pairs GROUP BY y',
        "csv_roundtrip": _ROWS + 'SELECT y AS "Y", count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM pairs GROUP BY y',
        "feature_vector": _ROWS + f"SELECT rid, {_VECTOR} AS vector FROM r",
        "label_encode": _NUM + "SELECT rid, CAST(CASE WHEN y = 1 THEN 1 ELSE 0 END AS DOUBLE) AS encoded, CAST((y + 1) // 2 AS INTEGER) AS halved FROM n",
        "feature_mean_std": _NUM + _unpivot([(f"'{c}'", _r(f"m_{c}"), _r(f"s_{c}")) for c in NUMERIC], ("feature", "mean", "std"), "f"),
        "standardize": _NUM + f"SELECT rid, {', '.join(f'{_r(c)} AS {c}' for c in NUMERIC)} FROM z",
        "sigmoid": f"SELECT range AS id, {_r('1 / (1 + exp(-(CAST(range AS DOUBLE) / 2)))')} AS p FROM range(-20, 21)",
        "lr_predict": _NUM + f"SELECT rid, {_r('p')} AS p, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS class FROM p",
        "logloss": _NUM + f"SELECT {_r(f'avg(-(t * ln(p + 1e-15) + (1 - t) * ln(1 - p + 1e-15))) + {0.5 * PENALTY * sum(w * w for w in WEIGHTS)}')} AS loss FROM p",
        "lr_gradient_step": _NUM + _unpivot([(f"'{c}'", _r(f"avg((p - t) * {c}) + {PENALTY * w}")) for c, w in zip(NUMERIC, WEIGHTS, strict=True)] + [("'bias'", _r(f"avg(p - t) + {PENALTY * BIAS}"))], ("param", "gradient"), "p"),
        "kfold_assign": _NUM + "SELECT rid, CAST(least((row_number() OVER (ORDER BY rid) - 1) // greatest(1, (SELECT count(*) FROM n) // 5), 4) AS INTEGER) AS fold FROM n",
        "train_val_split": _NUM + "SELECT rid, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '42', rid))) <= round((SELECT count(*) FROM n) * 0.8) THEN 'train' ELSE 'val' END AS split FROM n",
        "batches": _NUM + "SELECT rn // 16384 AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY rid) - 1 AS rn FROM n) GROUP BY 1",
        "confusion_matrix": _CONF + " SELECT * FROM c",
        "confusion_table": "SELECT quality AS actual, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1 FROM labels GROUP BY quality",
        "accuracy": _CONF + f" SELECT {_r('CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) * 100')} AS accuracy FROM c",
        "classification_report": _report(),
        "early_stop_trace": f"""WITH l AS (SELECT * FROM (VALUES {stop}) v(epoch, loss)), m AS (SELECT epoch, CAST(loss AS DOUBLE) AS loss, coalesce(loss < lag(loss) OVER (ORDER BY epoch), TRUE) AS up,
            coalesce(loss < min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM l)
            SELECT epoch, loss, min(loss) OVER (ORDER BY epoch) AS best, epoch - max(CASE WHEN up THEN epoch END) OVER (ORDER BY epoch) >= 5 AS stop_previous, epoch - max(CASE WHEN is_best THEN epoch END) OVER (ORDER BY epoch) >= 3 AS stop_best FROM m""",
        "robust_scale_fit": _NUM + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'quantile_cont({c}, 0.5)')} AS median, {_r(f'CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END')} AS iqr FROM n" for c in NUMERIC),
        "robust_scale": _NUM + f", e AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS d_{c}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS i_{c}' for c in NUMERIC)} FROM n) SELECT rid, {', '.join(f'{_r(f"({c} - d_{c}) / i_{c}")} AS {c}' for c in NUMERIC)} FROM n CROSS JOIN e",
        "anova_f": _anova(),
        "feature_selection": f"SELECT feature, TRUE AS selected FROM ({_anova()})",
        "ce_smoothed": _NUM + f"SELECT {_r('avg(-((t * 0.9 + 0.05) * ln(p) + (1 - (t * 0.9 + 0.05)) * ln(1 - p)))')} AS loss FROM p",
    }
