"""Subject areas of documents by label propagation over a similarity graph.

Two documents are similar as far as they share words that belong to one
subject.  The graph is kept in its factored form, document - word - document:
an edge between documents is never a row, yet every pair that shares a word is
joined through it, with the exact weight, in one step from documents to words
and one back.  A word is verified before it may carry a label: enough labelled
or already reached documents must hold it, and most of them must agree on the
subject.  Words of no subject, which link everything with everything, are
thereby cut out of the graph.

Seeds are the trusted labels: known subjects whose document also shows words of
that subject.  They are clamped in every round, and rounds go on until no label
changes: the first ones settle the words, which then keep their subject while
more words join, as words that may turn drift from the seeds.  Documents keep
all subjects they are reached from, less those that only pass through:
sentences take the subject of their verified words, and a subject that is no
seed goes if no sufficient part of the sentences is about it and its words
either stand in one sentence only or are a small part of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import written

#: Most rows of a word table that is sent to every task; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: A word of a subject: least share of its documents on that subject, least weight of documents (first from seeds, then from all).
PURITY, SEED_WEIGHT, WEIGHT = 0.6, 0.9, 3.0
#: A subject of a document: least sentences and their share, or the share that makes one sentence enough.
SENTENCES, SHARE, ALONE = 2, 0.12, 0.5
#: Share of a document's evidence from which on it passes a subject on.
PASSED = 0.25


def _words(text: Column) -> Column:
    """Runs of three letters or more of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))


def _sized(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if it is small by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _word_subjects(weights: DataFrame, least: float, smoothing: float) -> DataFrame:
    """``(word, subject, share)`` of verified words, from ``(word, subject, weight)``.

    ``share`` is the smoothed part of the word's weight that lies on the subject.
    """
    totals = Window.partitionBy("word")
    shares = weights.withColumn("held", F.sum("weight").over(totals)).where(F.col("held") >= least)
    shares = shares.withColumn("share", F.col("weight") / (F.col("held") + smoothing))
    return shares.where(F.col("share") >= PURITY).select("word", "subject", "share")


def trusted_labels(labels: DataFrame, id_col: str, subject_col: str, subjects: DataFrame) -> DataFrame:
    """``(doc, subject, part)``: known subjects, spelling and case aside, shared equally among a document's labels."""
    known = subjects.select("subject", F.lower(F.trim("subject")).alias("spelt")).dropna().dropDuplicates(["spelt"])
    given = labels.select(F.col(id_col).alias("doc"), F.lower(F.trim(F.col(subject_col))).alias("spelt")).dropna().distinct()
    given = given.join(F.broadcast(known), "spelt") if known.count() <= BROADCAST_ROWS else given.join(known, "spelt")
    return given.select("doc", "subject", (1 / F.count("*").over(Window.partitionBy("doc"))).alias("part"))


def propagate(holds: DataFrame, seeds: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(word, subject, share)`` and ``(doc, subject, part, passed, seed)`` once labels stop changing, both written.

    ``holds``: distinct ``(doc, word)``; ``seeds``: ``(doc, subject, part)``;
    ``rounds``: those in which a word may still change its subject.
    The second table has every subject that a document is reached from: its part
    of the evidence, whether that is enough to be passed on, and whether it is a
    seed that the document bears out.
    """
    first = holds.join(seeds, "doc").groupBy("word", "subject").agg(F.sum("part").alias("weight"))
    model = written(_word_subjects(first, SEED_WEIGHT, 0.5), "words")
    by_doc, step, before = Window.partitionBy("doc"), 0, None
    given = seeds.select("doc", "subject", F.lit(True).alias("given"))
    while True:
        # From words to documents ...
        reached = holds.join(_sized(model), "word").groupBy("doc", "subject").agg(F.sum("share").alias("score"), F.count("*").alias("words"))
        reached = reached.withColumn("part", F.round(F.col("score") / F.sum("score").over(by_doc), 9)).withColumn("all", F.sum("words").over(by_doc))
        reached = reached.withColumn("passed", (F.col("all") >= 2) & (F.col("part") > PASSED))
        # ... with the seeds clamped where their document bears them out ...
        reached = reached.join(given, ["doc", "subject"], "left").withColumn("seed", F.col("passed") & F.col("given").isNotNull())
        reached = written(reached.select("doc", "subject", "part", "passed", "seed"), "reached")
        labels = reached.where("passed").withColumn("seeds", F.count_if("seed").over(by_doc)).where("seeds = 0 or seed")
        state = tuple(labels.agg(F.count("*"), F.bit_xor(F.xxhash64("doc", "subject"))).first())
        if step > rounds and state == before:
            return model, reached
        clamped = labels.select("doc", "subject", F.when(F.col("seeds") > 0, 1 / F.col("seeds")).otherwise(F.col("part") / F.sum("part").over(by_doc)).alias("part"))
        # ... and back to words.
        again = _word_subjects(holds.join(clamped, "doc").groupBy("word", "subject").agg(F.sum("part").alias("weight")), WEIGHT, 1.0)
        if step < rounds:
            model = written(again, "words")
        else:
            more = written(again.join(_sized(model.select("word")), "word", "left_anti"), "words")
            if not more.head(1):
                return model, reached
            model = written(model.unionByName(more), "words")
        step, before = step + 1, state


def document_subjects(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_subject: str, subjects: DataFrame, rounds: int = 2) -> DataFrame:
    """``(id, subject, sentences, share)``: the subjects of every document, none or several.

    ``subjects`` has the column ``subject``; results use its spelling.  Labels
    with a null, unknown or differently spelt subject are dropped or matched
    without case and outer white space; repeated ones count once; labels of
    documents that don't exist have no effect.  Null ids, and null, empty and
    blank texts, give no row, nor do texts without a verified word.  A repeated
    id is taken as one document.  Without labels the result is empty.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).dropna()
    seeds = written(trusted_labels(labels, label_id, label_subject, subjects), "seeds")
    # Words that seeds show to be of no subject never enter the graph; all others do, in every document.
    words = texts.select("doc", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    tried = words.join(seeds, "doc").groupBy("word", "subject").agg(F.sum("part").alias("weight"))
    by_word = Window.partitionBy("word")
    tried = tried.withColumn("held", F.sum("weight").over(by_word)).groupBy("word").agg(F.max("weight").alias("top"), F.first("held").alias("held"))
    general = written(tried.where((F.col("held") >= 8) & (F.col("top") < 0.45 * F.col("held"))).select("word"), "general-words")
    holds = written(words.join(_sized(general), "word", "left_anti"), "holds")
    model, reached = propagate(holds, seeds, rounds)
    sentences = texts.select("doc", F.posexplode(F.split("text", r"[.!?\r\n]+")).alias("at", "sentence"))
    said = sentences.select("doc", "at", F.explode(_words(F.col("sentence"))).alias("word")).join(_sized(model), "word")
    about = said.groupBy("doc", "at", "subject").agg(F.round(F.sum("share"), 6).alias("score"))
    first = F.max(F.struct("score", "subject")).over(Window.partitionBy("doc", "at")).getField("subject")
    about = about.withColumn("won", (F.col("subject") == first).cast("int"))
    counts = about.groupBy("doc", "subject").agg(F.sum("won").alias("sentences"), F.count("*").alias("touched"))
    counts = counts.withColumn("share", F.col("sentences") / F.sum("sentences").over(Window.partitionBy("doc")))
    # The labels are the propagated ones; sentences only take those away that pass through.
    enough = ((F.col("sentences") >= SENTENCES) & (F.col("share") >= SHARE)) | (F.col("share") >= ALONE)
    kept = reached.join(counts, ["doc", "subject"]).where(F.col("seed") | enough | (F.col("passed") & (F.col("touched") > 1)))
    return kept.select(F.col("doc").alias(id_col), "subject", "sentences", "share")
