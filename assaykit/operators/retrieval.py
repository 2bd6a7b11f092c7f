"""Retrieval: BM25 over an inverted index, and rank metrics of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import kernels as K

#: Words too common to search for.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "of", "to", "in", "on", "for", "and", "or", "do", "does", "i", "my", "me",
    "can", "how", "what", "when", "which", "who", "it", "at", "be", "by", "with", "much", "many",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, without stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def bm25(queries: DataFrame, corpus: DataFrame, *, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top ``k`` documents per query: query_id, doc_id, score (6 decimals), rank; ties to the smaller doc_id.

    ``queries``: query_id, text; ``corpus``: doc_id, text and perhaps title, which is searched too. Terms repeated in a query count repeatedly; scores of 0 or
    less drop. The corpus is read and tokenised once, into (term, doc) counts of query terms and a row a document that stands for its
    length; document frequencies, lengths and scores all read that one shuffle. They leave no term out before they
    aggregate, as a filter would be pushed below the shuffle and make another one of it.
    """
    every = "\0"  # no token: what stands for a document as a whole
    q = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    searched = F.concat_ws(" ", "title", "text") if "title" in corpus.columns else F.col("text")
    docs = corpus.select("doc_id", F.coalesce(tokens(searched), F.array().cast("array<string>")).alias("ts")).withColumn("len", F.size("ts"))
    terms = q.select("term").unionByName(corpus.sparkSession.range(1).select(F.lit(every).alias("term"))).distinct()
    tf = docs.select("doc_id", "len", F.explode(F.concat("ts", F.array(F.lit(every)))).alias("term")).join(terms, "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("all_tf"), F.sum(F.col("len") * F.col("tf")).alias("all_len"))
    of_all = lambda c: F.max(F.when(F.col("term") == every, F.col(c)))
    size = stats.agg(of_all("all_tf").alias("n"), (of_all("all_len") / of_all("all_tf")).alias("avg_len"))
    scored = tf.join(stats.select("term", "df"), "term").join(F.broadcast(size))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    hits = scored.select("term", "doc_id", weight.alias("w")).join(q, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 6).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_unique(ids: Column, k: int) -> Column:
    return F.slice(F.array_distinct(ids), 1, k)


def rank_metrics(rows: DataFrame, k: int, *, retrieved: str = "retrieved", grades: str = "grades") -> DataFrame:
    """precision, recall, reciprocal rank and nDCG at k of each row.

    ``retrieved``: array of ids in rank order; ``grades``: map id -> grade of the relevant ids (a listed grade of 0 is
    relevant and gains nothing). Precision is null if nothing is retrieved, recall and nDCG if nothing is relevant.
    """
    top, rel = top_unique(F.col(retrieved), k), F.map_keys(F.col(grades))
    hit = F.size(F.array_intersect(top, rel))
    places = F.transform(top, lambda x, i: F.when(F.array_contains(rel, x), i + 1))
    gain = lambda g: F.pow(F.lit(2.0), g.cast("double")) - 1
    dcg = F.aggregate(F.transform(top, lambda x, i: F.coalesce(gain(F.try_element_at(F.col(grades), x)), F.lit(0.0)) / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    best = F.slice(F.sort_array(F.map_values(F.col(grades)), asc=False), 1, k)
    ideal = F.aggregate(F.transform(best, lambda g, i: gain(g) / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumns(
        {
            "precision": K.rate(hit, F.nullif(F.size(top), F.lit(0))), "recall": K.rate(hit, F.nullif(F.size(rel), F.lit(0))),
            "reciprocal_rank": F.coalesce(1 / F.array_min(places), F.lit(0.0)), "ndcg": F.try_divide(dcg, F.nullif(ideal, F.lit(0.0))),
        }
    )


def match_facts(predicted: DataFrame, reference: DataFrame, key: str, *parts: str) -> DataFrame:
    """One-to-one exact matches by case as multisets: tp, fp, fn, precision, recall, f1.

    Each side is counted by case and fact first, so duplicates are never expanded into pairs.
    """
    p = predicted.groupBy(key, *parts).agg(F.count("*").alias("np"))
    r = reference.groupBy(key, *parts).agg(F.count("*").alias("nr"))
    both = p.join(r, [key, *parts], "full_outer").fillna(0, ["np", "nr"])
    g = both.groupBy(key).agg(F.sum(F.least("np", "nr")).alias("tp"), F.sum("np").alias("predicted"), F.sum("nr").alias("expected"))
    tp, n, m = F.col("tp"), F.col("predicted"), F.col("expected")
    return g.select(key, "tp", (n - tp).alias("fp"), (m - tp).alias("fn"), K.rate(tp, n).alias("precision"), K.rate(tp, m).alias("recall"), K.rate(2 * tp, n + m).alias("f1"))


def class_metrics(pairs: DataFrame, labels: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, support, precision, recall and f1 of each label. A prediction outside ``labels`` counts against the
    expected label and for nobody."""
    g = pairs.groupBy(expected, predicted).agg(F.count("*").alias("n"))
    right = F.col(expected) == F.col(predicted)
    of_expected = g.groupBy(F.col(expected).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("tp"))
    of_predicted = g.groupBy(F.col(predicted).alias("label")).agg(F.sum(F.when(right, 0).otherwise(F.col("n"))).alias("fp"))
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    rows = every.join(of_expected, "label", "left").join(of_predicted, "label", "left").fillna(0, ["support", "tp", "fp"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("support") - F.col("tp")
    return rows.select("label", "support", "tp", "fp", fn.alias("fn"), K.rate(tp, tp + fp).alias("precision"), K.rate(tp, F.col("support")).alias("recall"), K.rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def averaged(per_class: DataFrame) -> DataFrame:
    """Accuracy, micro and macro F1; classes without support are left out of the macro average and counted."""
    s = lambda c: F.sum(c)
    f1 = F.when(F.col("support") > 0, F.coalesce("f1", F.lit(0.0)))
    return per_class.agg(
        K.rate(s("tp"), s("support")).alias("accuracy"), K.rate(2 * s("tp"), 2 * s("tp") + s("fp") + s("fn")).alias("micro_f1"),
        F.avg(f1).alias("macro_f1"), F.count_if(F.col("support") == 0).alias("omitted"),
    )


def win_rate(rows: DataFrame, outcome: str, *keys: str) -> DataFrame:
    """(wins + ties / 2) / (wins + ties + losses); abstentions are counted apart."""
    n = lambda v: F.count_if(F.col(outcome) == v)
    g = rows.groupBy(*keys).agg(n("win").alias("wins"), n("tie").alias("ties"), n("loss").alias("losses"), n("abstain").alias("abstentions"))
    return g.withColumn("win_rate", K.rate(F.col("wins") + F.col("ties") / 2, F.col("wins") + F.col("ties") + F.col("losses")))
