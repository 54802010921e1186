"""An index of the three-letter pieces of texts, for filters that look for any words inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Letters of a piece; texts asked for that are shorter have none and are looked for in every row.
SIZE = 3


def grams(c: Column) -> Column:
    """The distinct pieces of a text in lower case, as they follow each other; empty for null and shorter ones."""
    t = F.lower(F.coalesce(c, F.lit("")))
    at = F.when(F.char_length(t) >= SIZE, F.sequence(F.lit(1), F.char_length(t) - (SIZE - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(t, i, F.lit(SIZE))))


def gram_index(texts: DataFrame, *, key: str = "ord", text_col: str = "search_text") -> tuple[DataFrame, DataFrame]:
    """(gram, key), a row for each text that has the piece, sorted by piece in ranges; and (gram, rows), how many have it.

    A piece that most texts have is as many rows, spread over ranges of (piece, key); readers of one piece skip the row groups of
    others by their bounds.
    """
    rows = texts.select(F.explode(grams(F.col(text_col))).alias("gram"), F.col(key))
    index = stored(rows.repartitionByRange("gram", key).sortWithinPartitions("gram", key), "gram-index")
    return index, stored(index.groupBy("gram").agg(F.count("*").alias("rows")), "gram-counts")


def find_texts(texts: DataFrame, index: tuple[DataFrame, DataFrame], asked: DataFrame, *, key: str = "ord", text_col: str = "search_text", pieces: int = 3) -> DataFrame:
    """(query_id, key): the texts that hold what is asked for (query_id, words), any case, white space trimmed at its ends.

    Of a query's pieces the ``pieces`` rarest are looked up, and texts that have them all are verified by the whole words: the
    same rows as a scan with ``contains`` gives, as a text that holds the words holds every piece of them. A query with a piece that
    no text has is dropped at once. Queries without a whole piece are held against all texts, those of one or two letters
    in one pass; an empty one holds everywhere, a null one nowhere.
    """
    rows, counts = index
    q = asked.select("query_id", F.lower(F.trim(F.regexp_replace("words", r"^\s+|\s+$", ""))).alias("words")).where("words is not null")
    long = F.char_length("words") >= SIZE
    need = q.where(long).select("query_id", F.explode(grams(F.col("words"))).alias("gram")).join(counts, "gram", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rarest = Window.partitionBy("query_id").orderBy("rows", "gram")
    used = stored(need.withColumn("n", F.row_number().over(rarest)).where(F.col("n") <= pieces), "gram-used")
    dead = used.where("rows = 0").select("query_id").distinct()
    used = used.join(dead, "query_id", "left_anti")
    wanted = used.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hits = used.select("query_id", "gram").join(rows, "gram").groupBy("query_id", key).agg(F.count("*").alias("have"))
    few = hits.join(wanted, "query_id").where("have = wanted").select("query_id", key)
    low = texts.select(key, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    checked = few.join(q, "query_id").join(low, key).where(F.col("_t").contains(F.col("words"))).select("query_id", key)
    short = q.where(~long)
    if short.isEmpty():
        return checked
    letters = short.groupBy("words").agg(F.collect_list("query_id").alias("ids"))
    # pieces of one and two letters of each text, and the empty one, meet the short queries by equality
    t, n = F.col("_t"), F.char_length("_t")
    singles = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(t, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    held = low.select(key, F.explode(F.array_distinct(F.concat(singles, pairs, F.array(F.lit(""))))).alias("words"))
    scanned = held.join(letters, "words").select(key, F.explode("ids").alias("query_id")).distinct().select("query_id", key)
    return checked.unionByName(scanned)
