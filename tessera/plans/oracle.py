"""The registered queries once more as SQL for an independent engine.

Each statement is put together from common table expressions over the raw
tables; it shares no code with the plans it checks.
"""

from __future__ import annotations

#: Fixed values, written out here once more so that a wrong one shows.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does
doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me
more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their
theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves
""".split()
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli":
    "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness":
    "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
K1_GRID = [0.0, 0.3, 0.6, 0.9, 1.2, 1.5, 1.8, 2.1, 2.5, 3.0]
B_GRID = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0]
JOINT_K1 = [0.6, 0.8, 0.9, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0]
JOINT_B = [0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9]
RM3_GRID = [(2.0, 0.6, docs, terms, alpha) for docs in (10, 20, 30, 40, 50) for terms in (10, 20, 30, 50) for alpha in (0.3, 0.4, 0.5, 0.6)]
CONFIGS = [
    (0.9, 0.4), (1.2, 0.75), (1.5, 0.75), (2.0, 0.6),
    (1.2, 0.75, 10, 10, 0.5), (1.2, 0.75, 10, 20, 0.6), (1.2, 0.75, 40, 30, 0.4),
    (2.0, 0.6, 10, 10, 0.5), (2.0, 0.6, 10, 20, 0.6), (2.0, 0.6, 40, 30, 0.4),
]

TOPK = 10
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

_COLLECTION = "coll as (select doc_id, ord, coalesce(text, '') as text from (select *, row_number() over (partition by doc_id order by ord) as nth from corpus) where nth = 1)"
_TOPICS = "topics as (select qid, coalesce(min(query_text), '') as text from queries_dev group by qid)"
_QRELS = "judged as (select qid, doc_id, rel from (select *, row_number() over (partition by qid, doc_id order by judged_at desc nulls last, rel desc) as nth from qrels where rel is not null) where nth = 1)"
_RUN = """given as (select qid, run_tag, doc_id, score, row_number() over (partition by run_tag, qid order by score desc, doc_id) as rank
  from dev_run where qid is not null and run_tag is not null and doc_id is not null and score is not null and not isnan(score))"""


def _tokens(of: str, key: str, source: str, boost: int = 1) -> str:
    text = "text"
    if boost > 1:
        title = r"case when regexp_matches(text, '[.!?\n]') then regexp_extract(text, '^[^.!?\n]*') else substr(text, 1, 120) end"
        text = f"case when {title} = '' then text else text || repeat(' ' || {title}, {boost - 1}) end"
    return f"{of} as (select {key}, unnest(l) as token, unnest(range(len(l))) as pos from (select {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') as l from {source}))"


def _shape(x: str) -> str:
    e = f"regexp_replace(regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(4):
        e = f"replace(replace({e}, 'Vy', 'VC'), 'Cy', 'CV')"
    return e


def _porter(vocabulary: str) -> list[str]:
    """Staged steps from ``vocabulary(token)`` to ``stems(token, term)``."""
    cvc = lambda x, s: f"right({s}, 3) = 'CVC' and right({x}, 1) not in ('w', 'x', 'y')"
    step = lambda rules: " ".join(
        f"when x like '%{a}' then case when contains(left(s, -{len(a)}), 'VC') then left(x, -{len(a)}) || '{b}' else x end" for a, b in sorted(rules.items(), key=lambda r: -len(r[0]))
    )
    cut = " ".join(
        f"when {'regexp_matches(x, ' + repr('[st]ion$') + ')' if a == 'ion' else 'x like ' + repr('%' + a)} then case when left(s, -{len(a)}) like '%VC%VC%' then left(x, -{len(a)}) else x end"
        for a in sorted(STEP_4, key=lambda a: -len(a))
    )
    shaped = lambda name, source: f"{name} as (select token, x, {_shape('x')} as s from {source})"
    return [
        f"p1 as (select token, case when x like '%sses' or x like '%ies' then left(x, -2) when x like '%ss' then x when x like '%s' then left(x, -1) else x end as x from (select token, token as x from {vocabulary} where length(token) > 2))",
        shaped("p1s", "p1"),
        """p2 as (select token, case when x like '%eed' then case when contains(left(s, -3), 'VC') then left(x, -1) else x end
          when x like '%ed' and contains(left(s, -2), 'V') then left(x, -2) when x like '%ing' and contains(left(s, -3), 'V') then left(x, -3) else x end as x,
          x not like '%eed' and ((x like '%ed' and contains(left(s, -2), 'V')) or (x like '%ing' and contains(left(s, -3), 'V'))) as went from p1s)""",
        f"p2s as (select *, {_shape('x')} as s from p2)",
        f"""p3 as (select token, case when not went then x when x like '%at' or x like '%bl' or x like '%iz' then x || 'e'
          when length(x) > 1 and right(x, 1) = left(right(x, 2), 1) and right(s, 1) = 'C' and right(x, 1) not in ('l', 's', 'z') then left(x, -1)
          when s like '%VC%' and s not like '%VC%VC%' and {cvc("x", "s")} then x || 'e' else x end as x from p2s)""",
        f"p4 as (select token, case when x like '%y' and contains({_shape('left(x, -1)')}, 'V') then left(x, -1) || 'i' else x end as x from p3)",
        shaped("p4s", "p4"),
        f"p5 as (select token, case {step(STEP_2)} else x end as x from p4s)",
        shaped("p5s", "p5"),
        f"p6 as (select token, case {step(STEP_3)} else x end as x from p5s)",
        shaped("p6s", "p6"),
        f"p7 as (select token, case {cut} else x end as x from p6s)",
        shaped("p7s", "p7"),
        f"p8 as (select token, case when x like '%e' and (left(s, -1) like '%VC%VC%' or (left(s, -1) like '%VC%' and not ({cvc('left(x, -1)', 'left(s, -1)')}))) then left(x, -1) else x end as x from p7s)",
        shaped("p8s", "p8"),
        f"stems as (select token, case when x like '%ll' and s like '%VC%VC%' then left(x, -1) else x end as term from p8s union all select token, token from {vocabulary} where length(token) <= 2)",
    ]


def _index(stem: bool = True, stop: bool = True, boost: int = 1) -> list[str]:
    """coll, docs(ord, doc_id, dl), dterm(ord, term, tf, first_pos, dl), terms(term, df, cf), size(n, total, avgdl), topics, qterm(qid, term, qtf)."""
    out = [_COLLECTION, _TOPICS, _tokens("dall", "ord", "coll", boost), _tokens("qall", "qid", "topics")]
    for t in ("d", "q"):
        key = "ord" if t == "d" else "qid"
        kept = f"where token not in ({_STOP})" if stop else ""
        out.append(f"{t}tok as (select {key}, token, row_number() over (partition by {key} order by pos) - 1 as pos from {t}all {kept})")
    if stem:
        out += ["vocab as (select token from dtok union select token from qtok)", *_porter("vocab")]
        out += [f"{t}occ as (select {'ord' if t == 'd' else 'qid'}, term, pos from {t}tok join stems using (token))" for t in "dq"]
    else:
        out += [f"{t}occ as (select {'ord' if t == 'd' else 'qid'}, token as term, pos from {t}tok)" for t in "dq"]
    return [
        *out,
        "dcount as (select ord, term, count(*) as tf, min(pos) as first_pos from docc group by ord, term)",
        "docs as (select ord, doc_id, coalesce(dl, 0)::bigint as dl from coll left join (select ord, sum(tf) as dl from dcount group by ord) using (ord))",
        "dterm as (select d.*, dl from dcount d join docs using (ord))",
        "terms as (select term, count(*) as df, sum(tf)::bigint as cf from dcount group by term)",
        "size as (select count(*) as n, coalesce(sum(dl), 0)::bigint as total, coalesce(sum(dl), 0) / greatest(count(*), 1)::double as avgdl from docs)",
        "qterm as (select qid, term, count(*) as qtf from qocc group by qid, term)",
        "idfs as (select term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from terms, size)",
        "qweight as (select qid, term, qtf::double as weight from qterm join terms using (term))",
    ]


def _scored(name: str, weights: str, k1: float, b: float) -> str:
    return f"""{name} as (select qid, ord, sum(weight * idf * (tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)))) as score
      from (select qid, term, weight, idf from {weights} join idfs using (term) where weight > 0) join dterm using (term), size group by qid, ord)"""


def _top(name: str, scored: str, k: int = TOPK, by: str = "qid") -> str:
    return f"""{name} as (select {by}, ord, doc_id, score, rank from (select {by}, ord, score, row_number() over (partition by {by} order by round(score, 6) desc, ord) as rank
      from {scored} where score > 0) join docs using (ord) where rank <= {k})"""


def _measured(name: str, run: str, by: str = "", k: int = TOPK) -> list[str]:
    """name(by.., qid, ndcg_10, map_10, mrr, p_k, num_ranked) of run(by.., qid, doc_id, rank)."""
    g = f"{by}, " if by else ""
    asked = f"(select * from (select distinct {by} from {run}), {name}_ideal)" if by else f"{name}_ideal"
    return [
        f"{name}_one as (select {g}qid, doc_id, row_number() over (partition by {g}qid order by min(rank), doc_id) as rank from {run} group by {g}qid, doc_id)",
        f"{name}_rel as (select {g}qid, doc_id, rank, coalesce(rel, 0) as rel from {name}_one left join judged using (qid, doc_id))",
        f"{name}_hits as (select *, sum(case when rel > 0 then 1 else 0 end) over (partition by {g}qid order by rank rows unbounded preceding) as hits from {name}_rel)",
        f"""{name}_sum as (select {g}qid, sum(case when rank <= 10 then (pow(2.0, rel) - 1) / log2(rank + 1) end) as dcg, sum(case when rank <= 10 and rel > 0 then hits / rank::double end) as precisions,
          min(case when rel > 0 then rank end) as first, sum(case when rank <= {k} and rel > 0 then 1 else 0 end) as found, count(*) as num_ranked from {name}_hits group by {g}qid)""",
        f"{name}_best as (select qid, rel, row_number() over (partition by qid order by rel desc, doc_id) as place from judged)",
        f"""{name}_ideal as (select qid, sum(case when place <= 10 then (pow(2.0, rel) - 1) / log2(place + 1) else 0 end) as idcg, sum(case when rel > 0 then 1 else 0 end) as n_relevant from {name}_best group by qid)""",
        f"""{name} as (select {g}qid, case when idcg <> 0 then coalesce(dcg / idcg, 0) else 0 end as ndcg_10, case when n_relevant > 0 then coalesce(precisions / n_relevant, 0) else 0 end as map_10,
          coalesce(1.0 / first, 0) as mrr, coalesce(found / {k}.0, 0) as p_k, coalesce(num_ranked, 0) as num_ranked, n_relevant from {asked} left join {name}_sum using ({g}qid))""",
    ]


def _sql(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


_MEANS = "round(coalesce(avg(ndcg_10), 0) + 1e-9, 6) as ndcg_10, round(coalesce(avg(map_10), 0) + 1e-9, 6) as map_10, round(coalesce(avg(mrr), 0) + 1e-9, 6) as mrr, round(coalesce(avg(p_k), 0) + 1e-9, 6) as p_k, count(*) as num_queries"
_RANKED = "select qid, doc_id, round(score, 4) as score, rank from "
_TITLE = _index(boost=2)
_ENTRY = [*_TITLE, _scored("s", "qweight", 1.5, 0.75), _top("top", "s")]
_VSM = [
    "vidf as (select term, df, log10(n / df) as vidf from terms, size)",
    "norms as (select ord, case when coalesce(norm, 0) > 0 then norm else 1 end as norm from docs left join (select ord, sqrt(sum(pow((1 + log10(tf)) * vidf, 2))) as norm from dterm join vidf using (term) group by ord) using (ord))",
    "vq as (select *, sqrt(sum(qw * qw) over (partition by qid)) as qn from (select qid, term, vidf, (1 + log10(qtf)) * vidf as qw from qterm join vidf using (term)))",
    "vs as (select qid, ord, dot / (norm * qn) as score from (select qid, ord, sum(qw * (1 + log10(tf)) * vidf) as dot, any_value(qn) as qn from vq join dterm using (term) where qn > 0 group by qid, ord) join norms using (ord))",
]


def _rm3(k1: float = 1.5, b: float = 0.75, whole: bool = False) -> list[str]:
    """``whole``: with all terms of the feedback documents, else with the 24 of the forward index."""
    kept = "" if whole else " where rank <= 24"
    return [
        *_index(),
        _scored("s1", "qweight", k1, b),
        _top("top1", "s1", 40),
        "fb as (select qid, ord, score / sum(score) over (partition by qid) as p from top1)",
        f"fwd as (select ord, term, tf, dl from (select *, row_number() over (partition by ord order by tf desc, first_pos) as rank from dterm){kept})",
        "model as (select qid, term, sum(p * tf / dl) as weight from fb join fwd using (ord) group by qid, term)",
        "kept as (select qid, term, weight from (select m.*, row_number() over (partition by qid order by round(weight, 9) desc, term) as place from model m join idfs using (term) where idf >= 0.5) where place <= 30)",
        """expanded as (select qid, term, sum(weight) as weight from (
          select qid, term, 0.4 * weight / sum(weight) over (partition by qid) as weight from qweight where qid in (select qid from kept)
          union all select qid, term, 0.6 * weight / sum(weight) over (partition by qid) from kept) group by qid, term)""",
        "both_ways as (select qid, term, weight from expanded union all select qid, term, weight from qweight where qid not in (select qid from kept))",
        _scored("s2", "both_ways", k1, b),
        _top("top2", "s2"),
    ]


_BYTES = """list_transform(range(0, {w}), lambda j: ((({v}) >> (7 * ({w} - 1 - j))) & 127) + case when j = {w} - 1 then 128 else 0 end)"""
_WIDTH = "case when {v} < 128 then 1 when {v} < 16384 then 2 when {v} < 2097152 then 3 when {v} < 268435456 then 4 else 5 end"
_GAPS = "gaps as (select term, ord, tf, ord - coalesce(lag(ord) over (partition by term order by ord), 0) as gap from dterm)"


def _bytes(v: str) -> str:
    return _BYTES.format(v=v, w=f"({_WIDTH.format(v=v)})")


def _sweep(points: list[tuple[float, float]], select: str) -> str:
    values = ", ".join(f"({k1}::double, {b}::double)" for k1, b in points)
    return _sql(
        [
            *_index(),
            _QRELS,
            f"points(k1, b) as (values {values})",
            "hits as (select qid, ord, tf, dl, sum(weight * idf) as w from qweight join idfs using (term) join dterm using (term) group by qid, ord, tf, dl)",
            "ss as (select k1, b, qid, ord, sum(w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))) as score from hits, points, size group by k1, b, qid, ord)",
            _top("top", "ss", TOPK, "k1, b, qid"),
            *_measured("m", "top", "k1, b"),
            f"swept as (select k1, b, {_MEANS} from m group by k1, b)",
        ],
        select,
    )


def _label(config: tuple) -> str:
    return f"bm25 {config[0]}/{config[1]}" + (f" rm3 {config[2]}/{config[3]}/{config[4]}" if len(config) > 2 else "")


def _configured(configs: list[tuple], boost: int = 1) -> list[str]:
    """m(config, qid, ndcg_10, map_10 ...) and cfg(config, k1, b, docs, terms, alpha) of several configurations, without feedback where docs is null."""
    rows = ", ".join(f"('{_label(c)}', {c[0]}::double, {c[1]}::double, " + (", ".join(map(str, c[2:])) if len(c) > 2 else "null, null, null") + ")" for c in configs)
    return [
        *_index(boost=boost),
        _QRELS,
        f"cfg(config, k1, b, docs, terms, alpha) as (values {rows})",
        "points as (select distinct k1, b from cfg)",
        "hits as (select qid, ord, tf, dl, sum(weight * idf) as w from qweight join idfs using (term) join dterm using (term) group by qid, ord, tf, dl)",
        "ss as (select k1, b, qid, ord, sum(w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))) as score from hits, points, size group by k1, b, qid, ord)",
        _top("top1", "ss", 50, "k1, b, qid"),
        "fb as (select config, qid, ord, score / sum(score) over (partition by config, qid) as p from top1 join cfg using (k1, b) where rank <= docs)",
        "fwd as (select ord, term, tf, dl from (select *, row_number() over (partition by ord order by tf desc, first_pos) as rank from dterm) where rank <= 24)",
        "model as (select config, qid, term, sum(p * tf / dl) as weight from fb join fwd using (ord) group by config, qid, term)",
        """kept as (select config, qid, term, weight from (select m.*, terms, row_number() over (partition by config, qid order by round(weight, 9) desc, term) as place
          from model m join idfs using (term) join cfg using (config) where idf >= 0.5) where place <= terms)""",
        "grown as (select distinct config, qid from kept)",
        """wide as (select config, qid, term, sum(weight) as weight from (
          select config, qid, term, alpha * weight / sum(weight) over (partition by config, qid) as weight from qweight join grown using (qid) join cfg using (config)
          union all select config, qid, term, (1 - alpha) * weight / sum(weight) over (partition by config, qid) from kept join cfg using (config)) group by config, qid, term
          union all select config, qid, term, weight from qweight, cfg where docs is not null and (config, qid) not in (select (config, qid) from grown))""",
        """s2 as (select config, qid, ord, sum(weight * idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))) as score
          from wide join idfs using (term) join cfg using (config) join dterm using (term), size where weight > 0 group by config, qid, ord)""",
        _top("top2", "s2", TOPK, "config, qid"),
        "runs as (select config, qid, doc_id, rank from top2 union all select config, qid, doc_id, rank from top1 join cfg using (k1, b) where docs is null and rank <= 10)",
        *_measured("m", "runs", "config"),
    ]


def _analysis(whole: bool = False) -> list[str]:
    """topic rows with both models' nDCG, the grades of the second and what it added."""
    return [
        *_rm3(2.0, 0.6, whole), _QRELS,
        "base10 as (select * from top1 where rank <= 10)", *_measured("ma", "base10"), *_measured("mb", "top2"),
        "qlist as (select qid, string_agg(term, ' ' order by pos) as query_terms from qocc group by qid)",
        "nrel as (select qid, sum(case when rel > 0 then 1 else 0 end) as n_relevant from judged group by qid)",
        "graded as (select qid, string_agg(coalesce(rel, 0)::varchar, ' ' order by rank) as top_grades, sum(case when rel is null then 1 else 0 end) as unjudged from top2 left join judged using (qid, doc_id) group by qid)",
        """added as (select qid, string_agg(term, ' ' order by place) as expansion from (select qid, term, row_number() over (partition by qid order by round(weight, 9) desc, term desc) as place
          from kept where (qid, term) not in (select (qid, term) from qweight)) where place <= 12 group by qid)""",
        """analysis as (select qid, text, coalesce(query_terms, '') as query_terms, coalesce(nrel.n_relevant, 0) as n_relevant, round(coalesce(ma.ndcg_10, 0), 6) as ndcg_bm25, round(coalesce(mb.ndcg_10, 0), 6) as ndcg_rm3,
          round(coalesce(mb.ndcg_10, 0) - coalesce(ma.ndcg_10, 0), 6) as delta, coalesce(top_grades, '') as top_grades, coalesce(unjudged, 0) as unjudged, coalesce(expansion, '') as expansion
          from topics left join qlist using (qid) left join nrel using (qid) left join ma using (qid) left join mb using (qid) left join graded using (qid) left join added using (qid))""",
    ]


def oracle_sql() -> dict[str, str]:
    plain, stemmed = _index(stem=False), _index()
    measured = [_QRELS, _RUN, "runs as (select run_tag, qid, doc_id, rank from given)", *_measured("m", "runs", "run_tag")]
    grid = [
        *_configured(RM3_GRID),
        "judged_qids as (select qid, (row_number() over (order by qid) - 1) % 5 as fold from (select distinct qid from judged))",
        "parts as (select config, fold, sum(ndcg_10) as s, count(*) as n from m join judged_qids using (qid) group by config, fold)",
        "each as (select *, docs as fb_docs, terms as fb_terms from parts join cfg using (config))",
    ]
    datasets = " union all ".join(f"select * from ({_sql(_configured(CONFIGS, boost), f'select config, {name!r} as dataset, avg(ndcg_10) as ndcg_10, avg(map_10) as map_10 from m group by config')})" for name, boost in (("plain", 1), ("titled", 2)))
    sql = {
        "bm25_top10_nostem": _sql([*plain, _scored("s", "qweight", 1.2, 0.75), _top("top", "s")], _RANKED + "top"),
        "tokenize_counts": _sql([_COLLECTION, _tokens("t", "doc_id", "coll")], "select doc_id, count(*) as n_tokens, count(distinct token) as n_types from t group by doc_id"),
        "stopword_filter_counts": _sql([_COLLECTION, _tokens("t", "doc_id", "coll")], f"select doc_id, count(*) as n_tokens, count(*) filter (token not in ({_STOP})) as n_kept from t group by doc_id"),
        "title_boost_tokens": _sql([_COLLECTION, _tokens("t", "doc_id", "coll", 2)], "select doc_id, token, count(*) as tf from t group by doc_id, token"),
        "porter_stem_vocab": _sql([_COLLECTION, _tokens("t", "doc_id", "coll"), "vocab as (select distinct token from t)", *_porter("vocab")], "select token, term from stems"),
        "analyze_terms": _sql(stemmed, "select ord, pos, term from docc"),
        "postings": _sql(stemmed, "select term, ord, tf from dterm"),
        "doc_lengths": _sql(stemmed, "select doc_id, dl from docs"),
        "dictionary_df": _sql(stemmed, "select term, df, cf, row_number() over (order by term) - 1 as term_id from terms"),
        "collection_stats": _sql(stemmed, "select n as n_docs, total as total_length, round(avgdl, 6) as mean_length, (select count(*) from terms) as n_terms from size"),
        "term_rank_by_df": _sql(stemmed, "select term, df, row_number() over (order by df desc, term) - 1 as df_rank from terms"),
        "forward_index_top24": _sql(stemmed, "select ord, term, tf, rank from (select *, row_number() over (partition by ord order by tf desc, first_pos) as rank from dterm) where rank <= 24"),
        "document_frequency_lookup": _sql(
            [*stemmed, "asked as (select distinct word from (select unnest(string_split(text, ' ')) as word from topics))", _tokens("wt", "word", "(select word, word as text from asked)"), f"wk as (select word, token from wt where token not in ({_STOP}))", "ws as (select word, count(*) as n, any_value(term) as term from wk join stems using (token) group by word)"],
            "select word, coalesce(df, 0) as df from asked left join (select word, df from ws join terms using (term) where n = 1) using (word)",
        ),
        "postings_lookup": _sql(stemmed, "select term, ord, tf from dterm where term in (select term from qterm)"),
        "forward_lookup": _sql([*stemmed, _QRELS], "select doc_id, term, tf from (select *, row_number() over (partition by ord order by tf desc, first_pos) as rank from dterm) join docs using (ord) where rank <= 24 and doc_id in (select doc_id from judged)"),
        "boolean_and": _sql(stemmed, "select qid, doc_id from (select qid, ord, count(*) as held from qterm join dterm using (term) group by qid, ord) join (select qid, count(*) as needed from qterm group by qid) using (qid) join docs using (ord) where held = needed"),
        "boolean_or": _sql(stemmed, "select distinct qid, doc_id from qterm join dterm using (term) join docs using (ord)"),
        "vsm_doc_norms": _sql([*stemmed, *_VSM], "select ord, round(norm, 6) as norm from norms"),
        "vsm_top10": _sql([*stemmed, *_VSM, _top("top", "vs")], _RANKED + "top"),
        "bm25_idf": _sql(stemmed, "select term, df, round(idf, 6) as idf from idfs"),
        "bm25_impacts": _sql(stemmed, "select term, ord, round(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as impact from dterm join idfs using (term), size"),
        "bm25_top10": _sql([*stemmed, _scored("s", "qweight", 1.2, 0.75), _top("top", "s")], _RANKED + "top"),
        "bm25_title2_top10": _sql(_ENTRY, _RANKED + "top"),
        "bm25_k1_zero": _sql([*stemmed, _scored("s", "qweight", 0.0, 0.75), _top("top", "s")], _RANKED + "top"),
        "bm25_b_zero": _sql([*stemmed, _scored("s", "qweight", 1.2, 0.0), _top("top", "s")], _RANKED + "top"),
        "rm3_feedback_weights": _sql(_rm3(), "select qid, ord, round(p, 6) as p from fb"),
        "rm3_relevance_model": _sql(_rm3(whole=True), "select qid, term, round(weight, 6) as weight from kept"),
        "rm3_expanded_query": _sql(_rm3(whole=True), "select qid, term, round(weight, 6) as weight from expanded"),
        "rm3_top10": _sql(_rm3(whole=True), "select qid, doc_id, round(score, 4) as score, rank, qid in (select qid from kept) as expanded from top2"),
        "fill_to_k": _sql(
            [*_ENTRY, "filler as (select ord, doc_id, row_number() over (order by dl desc, ord) - 1 as place from docs)", "state as (select qid, count(score) as n, coalesce(min(score), 1.0) as floor from topics left join top using (qid) group by qid)",
             "free as (select qid, doc_id, floor * 1e-6 - place * 1e-9 as score, n + row_number() over (partition by qid order by place) as rank from state, (select * from filler where place < 20) f where n < 10 and (qid, ord) not in (select (qid, ord) from top))"],
            "select qid, doc_id, round(score, 4) as score, rank from (select qid, doc_id, score, rank from top union all select qid, doc_id, score, rank from free where rank <= 10)",
        ),
        "validate_run_duplicates": _sql([_RUN], "select run_tag, qid, count(*) as n, count(distinct doc_id) as docs from given group by run_tag, qid having count(*) > 100 or count(distinct doc_id) < count(*)"),
        "trec_run_lines": _sql(_ENTRY, "select qid, rank, qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.4f', round(score, 4)) || ' tessera' as value from top"),
        "trec_run_roundtrip": _sql([_RUN], "select run_tag, qid, doc_id, row_number() over (partition by run_tag, qid order by round(score, 6) desc, rank) as rank from given"),
        "qrels_parse": _sql([_QRELS], "select qid, doc_id, rel from judged"),
        "queries_parse": _sql([_TOPICS], "select qid, replace(text, chr(10), ' ') as text from topics"),
        "dedup_keep_first": _sql(measured, "select run_tag, qid, doc_id, rank from m_one"),
        "evaluate_run_aggregate": _sql(measured, f"select run_tag, {_MEANS} from m group by run_tag"),
        "run_report": _sql(measured, f"select run_tag, {_MEANS}, count(*) as listed, count(*) filter (mrr = 1) as first_relevant from m group by run_tag"),
        "rm3_cv_folds": _sql(
            [*grid, "trained as (select *, (sum(s) over (partition by config) - s) / (sum(n) over (partition by config) - n) as others from each)",
             "best as (select *, row_number() over (partition by fold order by round(others, 9) desc, fb_docs, fb_terms, alpha) as place from trained)",
             _scored("sb", "qweight", 2.0, 0.6), _top("tb", "sb"), *_measured("mb", "tb"), "plain as (select fold, avg(ndcg_10) as baseline_ndcg from mb join judged_qids using (qid) group by fold)"],
            "select fold, fb_docs, fb_terms, alpha::double as alpha, round(others, 6) as train_ndcg, round(s / n, 6) as held_out_ndcg, round(baseline_ndcg, 6) as baseline_ndcg from best join plain using (fold) where place = 1",
        ),
        "rm3_robust_pick": _sql(
            [*grid, "pts as (select fb_docs, fb_terms, alpha, sum(s) / sum(n) as mean_ndcg, min(s / n) as worst_fold from each group by fb_docs, fb_terms, alpha)",
             "placed as (select *, row_number() over (order by round(mean_ndcg, 9) desc, fb_docs, fb_terms, alpha) as place, row_number() over (order by round(worst_fold, 9) desc, fb_docs, fb_terms, alpha) = 1 as robust from pts)"],
            "select fb_docs, fb_terms, alpha::double as alpha, round(mean_ndcg, 6) as mean_ndcg, round(worst_fold, 6) as worst_fold, place, robust from placed where place <= 12 or robust",
        ),
        "cross_dataset_table": f"select config, dataset, round(ndcg_10, 6) as ndcg_10, round(map_10, 6) as map_10 from ({datasets})",
        "cross_dataset_summary": f"select config, round(avg(ndcg_10), 6) as mean_ndcg, round(min(ndcg_10), 6) as worst_ndcg from ({datasets}) group by config",
        "error_analysis_per_query": _sql(_analysis(whole=True), "select * from analysis"),
        "rm3_worst_topics": _sql(_analysis(), "select * from analysis order by ndcg_rm3, qid limit 10"),
        "rm3_regressions": _sql(_analysis(), "select * from analysis order by delta, qid limit 10"),
        "skipped_no_qrels": "select distinct qid from queries_dev where qid not in (select qid from qrels where rel is not null)",
        "provisional_score": _sql([_QRELS, _RUN, "runs as (select run_tag, qid, doc_id, rank from given)", *_measured("m", "runs", "run_tag")], "select run_tag, round(0.7 * avg(ndcg_10) + 0.1 * avg(map_10), 6) as provisional from m group by run_tag"),
        "efficiency_modifier": _sql(
            [_RUN, "cost as (select run_tag, count(*)::double as build, count(distinct qid)::double as latency from given group by run_tag)", "med as (select median(build) as mb, median(latency) as ml from cost)"],
            "select run_tag, round(((greatest(-1, least(1, 1 - build / mb / 2)) * 2 - 1) + (greatest(-1, least(1, 1 - latency / ml / 2)) * 2 - 1)) / 2 * 0.1, 6) as modifier from cost, med",
        ),
        "index_size_score": _sql(
            [_RUN, "cost as (select run_tag, count(*)::double as size from given group by run_tag)", "med as (select median(size) as ms from cost)"],
            "select run_tag, round(case when size / ms <= 0.5 then 0.1 when size / ms >= 2 then 0 else (1 - (size / ms - 0.5) / 1.5) * 0.1 end, 6) as size_score from cost, med",
        ),
        "beats_baseline": _sql(
            [*stemmed, _QRELS, _scored("sa", "qweight", 1.5, 0.75), _top("ta", "sa"), _scored("sb", "qweight", 0.9, 0.4), _top("tb", "sb"), *_measured("ma", "ta"), *_measured("mb", "tb"), "a as (select avg(ndcg_10) as n, avg(map_10) as m from ma)", "b as (select avg(ndcg_10) as n, avg(map_10) as m from mb)"],
            "select round(a.n, 6) as ndcg_10, round(a.m, 6) as map_10, round(0.7 * a.n + 0.1 * a.m, 6) as provisional, round(b.n, 6) as baseline_ndcg_10, round(b.m, 6) as baseline_map_10, a.n > b.n as beats_ndcg_10, a.m > b.m as beats_map_10 from a, b",
        ),
        "dgap_postings": _sql([*stemmed, _GAPS], "select term, ord, gap, tf from gaps"),
        "vbyte_widths": _sql([*stemmed, _GAPS], f"select width, count(*) as n from (select {_WIDTH.format(v='gap')} as width from gaps) group by width"),
        "vbyte_encode_bytes": _sql([*stemmed, _GAPS], f"select term, ord, array_to_string({_bytes('gap')}, ' ') as bytes from gaps"),
        "vbyte_roundtrip": _sql([*stemmed, _GAPS], "select term, ord, gap from gaps"),
        "gap_tf_flag_streams": _sql(
            [*stemmed, _GAPS, f"flagged as (select term, ord, array_to_string({_bytes('gap * 2 + case when tf > 1 then 1 else 0 end')}, ' ') as g, case when tf > 1 then array_to_string({_bytes('tf - 2')}, ' ') end as t from gaps)"],
            "select term, ord // 256 as block, string_agg(g, ' ' order by ord) as gap_stream, coalesce(string_agg(t, ' ' order by ord), '') as tf_stream from flagged group by term, ord // 256",
        ),
        "interleaved_streams": _sql(
            [*stemmed, _GAPS, f"pairs as (select term, ord, array_to_string({_bytes('gap')}, ' ') || ' ' || array_to_string({_bytes('tf')}, ' ') as d from gaps)"],
            "select term, ord // 256 as block, string_agg(d, ' ' order by ord) as data from pairs group by term, ord // 256",
        ),
        "gap_stream_decode": _sql(stemmed, "select term, ord, tf from dterm"),
        "interleaved_decode": _sql(stemmed, "select term, ord, tf from dterm"),
        "sweep_k1": _sweep([(k1, 0.75) for k1 in K1_GRID], "select * from swept"),
        "sweep_b": _sweep([(1.2, b) for b in B_GRID], "select * from swept"),
        "grid_best": _sweep([(k1, b) for k1 in JOINT_K1 for b in JOINT_B], "select * from swept order by ndcg_10 desc, k1, b limit 1"),
        "model_comparison": _sql(
            [*_rm3(), _QRELS, *_VSM, _top("tv", "vs"), _scored("sb", "qweight", 1.2, 0.75), _top("tb", "sb"), "runs as (select 'vsm' as model, qid, doc_id, rank from tv union all select 'bm25', qid, doc_id, rank from tb union all select 'rm3', qid, doc_id, rank from top2)", *_measured("m", "runs", "model")],
            f"select model, {_MEANS} from m group by model",
        ),
        "dataset_stats": _sql(
            [*stemmed, _QRELS, "per as (select qid, sum(case when rel > 0 then 1 else 0 end) as n from judged where qid in (select qid from topics) group by qid)"],
            "select (select n from size) as docs, count(*) as queries, round((select avgdl from size), 1) as avgdl, round(coalesce(sum(n), 0) / greatest(count(*), 1)::double, 1) as rel_per_query from per",
        ),
    }
    for name, metric in (("ndcg_at_10", "ndcg_10"), ("map_at_10", "map_10"), ("mrr", "mrr"), ("precision_at_10", "p_k")):
        sql[name] = _sql(measured, f"select run_tag, qid, round({metric}, 6) as {metric} from m")
    return sql
