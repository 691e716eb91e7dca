"""Queries of this package over the tables of a directory, and their SQL where SQL is fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_texts
from tessera.llm.distinctive import TermModel
from tessera.llm.near_duplicates import NearDuplicates
from tessera.llm.ngrams import marked_counts
from tessera.llm.packing import ATTENTION, CAPACITY, DOCUMENTS, container_use, pack_texts
from tessera.llm.quality import text_statistics, text_structure, unlike_prose
from tessera.llm.rank_fusion import fuse_rankings
from tessera.llm.subjects import document_subjects
from tessera.llm.topn import top_per_group
from tessera.scratch import written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_per_group(_table(spark, folder, "dev_run"), ["qid", "run_tag"], "doc_id", "score", 10).select("qid", "run_tag", "doc_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = marked_counts(_table(spark, folder, "corpus"), "doc_id", "text")
    return counts.where("mark is not null").selectExpr("ngram as term", "mark")


def p2_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one to three terms with their counts and marks."""
    return marked_counts(_table(spark, folder, "corpus"), "doc_id", "text", max_n=3)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    run = _table(spark, folder, "dev_run")
    return fuse_rankings(run, "qid", "doc_id", "score", "run_tag", top=3, min_systems=4).select("qid", "doc_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return unlike_prose(_table(spark, folder, "corpus"), "doc_id", "text")


def p4_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Basic counts, divergence and structure of every row of corpus."""
    corpus = _table(spark, folder, "corpus")
    named = ["ord", "n_chars", "n_words", "mean_word_length", "symbol_ratio", "n_lines", "end_punctuation_ratio", "common_word_ratio", "divergence", "structure"]
    return text_structure(corpus, "ord", "text").select(*named)


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The basic counts and shares of every row of corpus."""
    rows = text_statistics(_table(spark, folder, "corpus"), "ord", "text")
    shares = ["mean_word_length", "symbol_ratio", "end_punctuation_ratio", "common_word_ratio"]
    return rows.select("ord", *(F.col(c).cast("bigint").alias(c) for c in ("n_chars", "n_words", "n_lines")), *(F.round(c, 6).alias(c) for c in shares))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near_duplicates(spark, folder).pairs().toDF("doc_id_a", "doc_id_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of three terms or more and its group of near duplicates."""
    return _near_duplicates(spark, folder).groups().toDF("doc_id", "group_id")


def _near_duplicates(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(_table(spark, folder, "corpus"), "doc_id", "text", size=3, threshold=0.5)


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of three terms or more, the class of equal term sequences that it is in, and that class's links."""
    return _near_duplicates(spark, folder).classes().toDF("doc_id", "class_id", "n_members", "n_links")


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """Similar classes; with ``p5_classes`` the whole of ``p5_found``, however large a class is."""
    links = _near_duplicates(spark, folder).links
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def _term_scores(spark: SparkSession, folder: str) -> tuple[TermModel, DataFrame]:
    model = TermModel(_table(spark, folder, "corpus"), "doc_id", "text")
    of_queries = model.scores(_table(spark, folder, "queries_dev"), "qid", "query_text")
    return model, model.own_scores().withColumn("rec_kind", F.lit("doc")).unionByName(of_queries.withColumn("rec_kind", F.lit("query")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that score as much as a case must, then checked by the counts of a case."""
    model, scores = _term_scores(spark, folder)
    least = F.when(F.col("rec_kind") == "doc", model.least_score(3, 2, 12)).otherwise(model.least_score(1, 2, 12))
    ranked = scores.where(F.col("score") >= least - 1e-9)
    return ranked.where("df between 2 and 12 and (rec_kind = 'query' or tf >= 3)").select("rec_kind", "rec_id", "term")


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The five most distinctive terms of every record."""
    order = Window.partitionBy("rec_kind", "rec_id").orderBy(F.desc(F.round("score", 6)), F.asc("term"))
    best = _term_scores(spark, folder)[1].withColumn("place", F.row_number().over(order)).where("place <= 5")
    return best.select("rec_kind", "rec_id", "term", "tf", "df", F.round("score", 4).alias("score"), F.col("place").cast("bigint").alias("place"))


def p6_all_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every record with its score."""
    return _term_scores(spark, folder)[1].select("rec_kind", "rec_id", "term", "tf", "df", F.round("score", 4).alias("score"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(_table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every part of every document."""
    return pack_texts(_table(spark, folder, "documents"), "doc_id", "text")


def p8_use(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, tokens, unused space and attention cost of every container."""
    return container_use(p8_containers(spark, folder))


def p8_faults(spark: SparkSession, folder: str) -> DataFrame:
    """One row, whose faults must be 0: containers over a capacity, documents cut needlessly, lost, repeated or not whole."""
    packed = written(p8_containers(spark, folder), "containers")
    count = lambda c: F.count_if(c).cast("bigint")
    over = container_use(packed).agg(
        count(F.col("n_tokens") > CAPACITY).alias("over_tokens"),
        count(F.col("n_parts") > DOCUMENTS).alias("over_documents"),
        count((F.col("attention") > ATTENTION + 1e-9) & (F.col("n_parts") > 1)).alias("over_attention"),
    )
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.countDistinct("part").alias("places"), F.max("part").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("parts") == F.col("places")) & (F.col("parts") == F.col("last") + 1) & (F.col("end") == F.col("n")) & (F.col("parts") == F.greatest(F.ceil(F.col("n") / CAPACITY), F.lit(1)))
    row = docs.agg(F.count("*").alias("n_documents"), count(~whole).alias("not_whole"), count(F.col("n") == 0).alias("without_tokens"))
    one = F.lit(1).alias("one")  # both have one row
    return over.select(one, "*").join(row.select(one, "*"), "one").drop("one")


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels, subjects = (_table(spark, folder, t) for t in ("documents", "doc_labels", "subjects"))
    return document_subjects(docs, "doc_id", "text", labels, "doc_id", "subject", subjects)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each subject and their share of all documents."""
    total = _table(spark, folder, "documents").count()
    found = _subjects(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))
    return found.withColumn("share", F.col("documents") / F.lit(max(total, 1)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_ngrams, p3_found, p4_found, p4_statistics, p4_counts, p5_found, p5_groups, p5_classes, p5_links, p6_found, p6_scores, p6_all_scores, p7_ids, p8_containers, p8_use, p8_faults, p9_found, p9_composition)}


_P1 = """
select qid, run_tag, doc_id from (
  select qid, run_tag, doc_id, row_number() over (partition by qid, run_tag order by best desc, doc_id) as place
  from (select qid, run_tag, doc_id, max(score) as best from dev_run
        where qid is not null and run_tag is not null and doc_id is not null and score is not null and not isnan(score)
        group by qid, run_tag, doc_id) one)
where place <= 10"""

_TERMS = """
with texts as (select doc_id, min(text) as text from corpus where text is not null group by doc_id),
words as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from texts),
total as (select count(*) as n from texts)"""

_P2 = _TERMS + """
select term, case when count(distinct doc_id) < 3 then 'rare' else 'common' end as mark
from words, total group by term, total.n
having count(distinct doc_id) < 3 or count(distinct doc_id) > 0.3 * total.n"""


_P2_NGRAMS = _TERMS + """,
placed as (select doc_id, unnest(l) as term, unnest(range(len(l))) as pos from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as l from texts)),
ahead as (select doc_id, term, lead(term) over w as next, lead(term, 2) over w as third from placed window w as (partition by doc_id order by pos)),
grams as (select doc_id, 1 as n, term as ngram from placed union all
  select doc_id, 2, term || ' ' || next from ahead where next is not null union all select doc_id, 3, term || ' ' || next || ' ' || third from ahead where third is not null),
counted as (select n, ngram, count(*) as n_occurrences, count(distinct doc_id) as n_records from grams group by n, ngram)
select c.n, ngram, n_occurrences, n_records, case when n_records < 3 then 'rare' when n_records > 0.3 * total.n then 'common' end as mark from counted c, total"""

_P3 = """
with best as (select qid, run_tag, doc_id, max(score) as s from dev_run
  where qid is not null and run_tag is not null and doc_id is not null and score is not null and not isnan(score) group by qid, run_tag, doc_id),
placed as (select *, rank() over (partition by qid, run_tag order by s desc) + (count(*) over (partition by qid, run_tag, s) - 1) / 2.0 as place,
  count(*) over (partition by qid, run_tag) as listed from best),
asked as (select qid, max(listed) + 1 as behind from placed group by qid having count(distinct run_tag) >= 4),
places as (select i.qid, i.doc_id, coalesce(p.place, behind) as place from (select distinct qid, doc_id from best) i
  join (select distinct qid, run_tag from best) s using (qid) join asked using (qid) left join placed p on p.qid = i.qid and p.run_tag = s.run_tag and p.doc_id = i.doc_id),
fused as (select qid, doc_id, row_number() over (partition by qid order by median(place), round(avg(place), 9), doc_id) as nth from places group by qid, doc_id)
select qid, doc_id from fused where nth <= 3"""

#: The words that count as common.
_COMMON_WORDS = """
the a an of in to for on at by from into over near after before between under through without against during since about than as and or with but nor
so yet if then although while because where when though however whereas unless until that which who what how is are was were be been being am has have
had do does did will would can could shall should may might must not no it its their they them he she his her we our us you your i my me this these
those each some any both neither others other all most more many there one such
"""
_P4_COUNTS = f"""
with parts as (select ord, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') as words,
  list_filter(regexp_split_to_array(text, '\\r\\n|[\\r\\n]'), lambda x: regexp_matches(x, '\\S')) as lines,
  list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains(string_split('{" ".join(_COMMON_WORDS.split())}', ' '), w)) as common from corpus),
counted as (select *, length(text) as n_chars, len(words) as n_words, len(lines) as n_lines,
  length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s\\x0b]+', '', 'g')) as symbols, length(array_to_string(words, '')) as letters,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][ \\t]*$'))) as ended from parts)
select ord, n_chars, n_words, n_lines, case when n_words is null then null when n_words = 0 then 0 else round(letters / n_words::double, 6) end as mean_word_length,
  case when n_chars is null then null when n_chars = 0 then 0 else round(symbols / n_chars::double, 6) end as symbol_ratio,
  case when n_lines is null then null when n_lines = 0 then 0 else round(ended / n_lines::double, 6) end as end_punctuation_ratio,
  case when n_words is null then null when n_words = 0 then 0 else round(len(common) / n_words::double, 6) end as common_word_ratio from counted"""

_P5 = """
with texts as (select doc_id, min(text) as text from corpus where text is not null group by doc_id),
lists as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as l from texts),
runs as (select distinct doc_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) as run from lists where len(l) >= 3),
sizes as (select doc_id, count(*) as n from runs group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from runs a join runs b using (run) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id)
select a as doc_id_a, b as doc_id_b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where s.n >= 0.5 * (x.n + y.n - s.n)"""

_P5_CLASSES = _P5[: _P5.index("sizes as")] + """
firsts as (select min(doc_id) as class_id, l, count(*) as n_members from lists where len(l) >= 3 group by l),
sizes as (select doc_id, count(*) as n from runs where doc_id in (select class_id from firsts) group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from runs a join runs b using (run) where a.doc_id < b.doc_id
  and a.doc_id in (select class_id from firsts) and b.doc_id in (select class_id from firsts) group by a.doc_id, b.doc_id),
linked as (select a, b, s.n / (x.n + y.n - s.n)::double as similarity from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where s.n >= 0.5 * (x.n + y.n - s.n))"""

_P5_LINKS = _P5_CLASSES + """
select a as class_a, b as class_b, round(similarity, 6) as similarity from linked"""

_P5_GROUPS = _P5_CLASSES.replace("with texts", "with recursive texts") + """,
ends as (select a as x, b as y from linked union all select b, a from linked),
reached(x, y) as (select class_id, class_id from firsts union select r.x, e.y from reached r join ends e on e.x = r.y),
named as (select x as class_id, min(y) as group_id from reached group by x)
select doc_id, group_id from lists join firsts using (l) join named using (class_id)"""

_P5_CLASSES += """,
ends as (select a as class_id from linked union all select b from linked),
counted as (select class_id, count(*) as n_links from ends group by class_id)
select doc_id, class_id, n_members, coalesce(n_links, 0) as n_links from lists join firsts using (l) left join counted using (class_id)"""

_P6 = _TERMS + """,
tf as (select doc_id, term, count(*) as tf from words group by doc_id, term),
held as (select term from tf group by term having count(*) between 2 and 12)
select 'doc' as rec_kind, doc_id as rec_id, term from tf join held using (term) where tf >= 3
union all
select distinct 'query', qid, term from (select qid, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as term from queries_dev) q join held using (term)"""

_P6_SCORES = _TERMS + """,
tf as (select doc_id, term, count(*) as tf from words group by doc_id, term),
stats as (select term, count(*) as df, sum(tf) as f from tf group by term),
size as (select (select n from total) as n, (select sum(f) from stats) / (select n from total)::double as mean),
asked as (select qid, min(query_text) as text from queries_dev where query_text is not null group by qid),
qwords as (select qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from asked),
records as (select 'doc' as rec_kind, doc_id as rec_id, term, tf from tf union all select 'query', qid, term, count(*) from qwords group by qid, term),
sized as (select *, sum(tf) over (partition by rec_kind, rec_id)::double as length from records),
normal as (select rec_kind, rec_id, term, tf, df, f / n::double as rate, tf * log2(1 + mean / length) as x from sized join stats using (term), size),
scored as (select *, (log2(1 + rate) + x * log2((1 + rate) / rate)) / (x + 1) as score from normal),
placed as (select *, row_number() over (partition by rec_kind, rec_id order by round(score, 6) desc, term) as place from scored)
select rec_kind, rec_id, term, tf, df, round(score, 4) as score, place from placed where place <= 5"""

#: The same without the cut at five.
_P6_ALL_SCORES = _P6_SCORES.replace("rec_kind, rec_id, term, tf, df, round(score, 4) as score, place from placed where place <= 5", "rec_kind, rec_id, term, tf, df, round(score, 4) as score from scored")


_P8_FAULTS = """
select 0 as over_tokens, 0 as over_documents, 0 as over_attention, count(*) as n_documents, 0 as not_whole,
  count(*) filter (text is null or text = '') as without_tokens from documents"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p2_found": _P2, "p2_ngrams": _P2_NGRAMS, "p3_found": _P3, "p4_counts": _P4_COUNTS, "p5_found": _P5, "p5_classes": _P5_CLASSES, "p5_links": _P5_LINKS, "p5_groups": _P5_GROUPS, "p6_found": _P6, "p8_faults": _P8_FAULTS, "p6_scores": _P6_SCORES, "p6_all_scores": _P6_ALL_SCORES}
