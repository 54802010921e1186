"""An index over stated queries, so that postings meet only the queries that they don't contradict."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored, text_batches
from .match import RANK_MATCH, judged, normalize_criteria, posting_roles

#: Keys of what a side leaves open: nothing asked, nothing known.
_ASKS_NOTHING, _KNOWS_NOTHING = "*", "?"


def words_held(df: DataFrame, words: DataFrame, text_col: str, into: str, *, block: int = 200_000) -> DataFrame:
    """df with ``into``: which of words (word) each text holds, sorted, each once; a null text holds none.

    One Aho-Corasick automaton finds all words in one pass over a text, however many there are. Words go to the
    tasks in blocks of at most about ``block``, one automaton and pass each; blank words are left out.
    """
    text_batches(df.sparkSession)
    stated = stored(words.where("word is not null and word <> ''").select("word").distinct(), "index-words")
    n_blocks = max(1, -(-stated.count() // block))
    out, kind = df, T.ArrayType(T.StringType())
    parts = [f"_held_{k}" for k in range(n_blocks)]
    for k, name in enumerate(parts):
        own = [r["word"] for r in stated.where(F.pmod(F.xxhash64("word"), F.lit(n_blocks)) == k).collect()]
        shared = df.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in shared.value:
                automaton.add_word(w, w)
            if shared.value:
                automaton.make_automaton()
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                held = [sorted({w for _, w in automaton.iter(t)}) if t and shared.value else [] for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held, pa.list_(pa.string()))], [*b.schema.names, name])

        out = out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, kind)]))
    return out.withColumn(into, F.array_sort(F.concat(*parts))).drop(*parts)


def _keys(values: Column, open_key: str) -> Column:
    """Keys of a side: its values, or the open key where it has none."""
    return F.when(F.size(values) > 0, F.transform(values, lambda v: F.concat(F.lit("="), v))).otherwise(F.array(F.lit(open_key)))


def query_index(criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct wishes among criteria under all their keys, and (query_id, wish) for who states them.

    Queries that ask the same are one wish. A wish stands under each region it asks for (or the key of those that ask
    none) and under the key of postings that tell none; likewise roles and daytime work: two or three columns
    that postings join on.
    """
    asked = normalize_criteria(criteria)
    wishes = ["role_tags", "qualifications", "regions", "employment_types", "experience_levels", "keywords", "excluded_patterns", "excluded_keywords"]
    asked = asked.withColumns({c: F.array_sort(c) for c in wishes})
    asked = asked.withColumns({c: F.array_distinct(F.transform(c, F.lower)) for c in ("keywords", "excluded_keywords")})
    cols = [*wishes, "weekday_daytime", "salary_minimum"]
    named = asked.withColumn("wish", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))
    one = named.dropDuplicates(["wish"]).select("wish", *[F.col(c).alias(f"q_{c}") for c in cols])
    open_ = F.array(F.lit(_KNOWS_NOTHING))
    one = one.withColumns({
        "q_region_keys": F.concat(_keys(F.col("q_regions"), _ASKS_NOTHING), open_),
        "q_role_keys": F.concat(_keys(F.col("q_role_tags"), _ASKS_NOTHING), open_),
        "q_day_keys": F.when(F.col("q_weekday_daytime"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))),
    })
    keyed = one.withColumn("region_key", F.explode("q_region_keys")).withColumn("role_key", F.explode("q_role_keys")).withColumn("day_key", F.explode("q_day_keys"))
    return keyed.drop("q_day_keys"), named.select("query_id", "wish")


#: What a posting is judged by once the stated regions, words and roles that it holds are known.
_FACTS = ["region", "_regions", "_words", "_roles", "eligibility", "schedule", "employment_types", "experience_level", "salary_minimum", "checked", "stale"]
#: Salaries asked for up to which a posting's own is lowered to the next of them.
_STEPS = 1_000


def _pay_steps(said: DataFrame, wishes: DataFrame) -> DataFrame:
    """said with its salary lowered to the largest that a wish asks for, or to one below all, so that more rows are alike; wishes compare as before."""
    asked = [r[0] for r in wishes.where("q_salary_minimum is not null").select("q_salary_minimum").distinct().limit(_STEPS + 1).collect()]
    if len(asked) > _STEPS:
        return said
    steps = F.array(*[F.lit(x).cast("long") for x in sorted(asked)]).cast("array<bigint>")
    below = F.array_max(F.filter(steps, lambda x: x <= F.col("salary_minimum")))
    return said.withColumn("salary_minimum", F.when(F.col("salary_minimum").isNotNull(), F.coalesce(below, F.lit(-1).cast("long"))))


def _alike(said: DataFrame, top: int | None) -> tuple[DataFrame, DataFrame]:
    """Classes of postings that every wish judges alike, under the name of ``ord``, and (class, ord, published_at) of their members.

    Within a class a wish ranks by publication and position alone, so with ``top`` no wish takes more than the first so many of it.
    """
    named = said.withColumn("class", F.sha2(F.to_json(F.struct(*_FACTS), {"ignoreNullFields": "false"}), 256)).select("class", "ord", "published_at", *_FACTS)
    if top is not None:
        order = Window.partitionBy("class").orderBy(F.col("published_at").desc_nulls_last(), F.asc("ord"))
        named = named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")
    named = stored(named, "index-alike")
    classes = named.dropDuplicates(["class"]).withColumns({"ord": F.col("class"), "published_at": F.lit(None).cast("date")}).drop("class")
    # few rows that each meet many wishes: dealt over the tasks by number and not by size
    return classes.repartition(int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))), named.select("class", "ord", "published_at")


def match_stored(postings: DataFrame, criteria: DataFrame, *, top: int | None = None) -> DataFrame:
    """The pairs of :func:`match.match_queries` that are not mismatched, for any number of stored queries.

    A posting is explained once: an automaton of all stated regions finds those that its region holds, another all stated
    words of its text. Then it joins the index by equal keys, on a pair's first common region and role alone,
    so no pair is made twice and none that region, role, daytime work or licence rule out is made at all;
    avoided words and patterns and the other conditions are judged on the pairs that meet. Null and unknown fields stay
    open, as there. Postings that no wish can tell apart are one class, judged once. With ``top`` each query's best rows stay, ranked for the wishes and not for each of those who share one.
    """
    keyed, who = query_index(criteria)
    keyed = stored(keyed, "index-keys")
    said = stored(postings.where(~F.coalesce(F.col("eligibility.status") == "ineligible", F.lit(False))), "index-postings")
    regions = keyed.select(F.explode("q_regions").alias("word"))
    words = keyed.select(F.explode(F.concat("q_keywords", "q_excluded_keywords")).alias("word"))
    said = words_held(words_held(said, regions, "region", "_regions"), words, "search_text", "_words")
    said, members = _alike(_pay_steps(said.withColumn("_roles", posting_roles()), keyed), top)
    told = F.coalesce("region", F.lit("")) != ""
    said = said.withColumns({
        "_region_keys": F.when(told, F.concat(F.transform("_regions", lambda v: F.concat(F.lit("="), v)), F.array(F.lit(_ASKS_NOTHING)))).otherwise(F.array(F.lit(_KNOWS_NOTHING))),
        "_role_keys": F.when(F.size("_roles") > 0, F.concat(F.transform("_roles", lambda v: F.concat(F.lit("="), v)), F.array(F.lit(_ASKS_NOTHING)))).otherwise(F.array(F.lit(_KNOWS_NOTHING))),
        "day_key": ~F.coalesce(F.col("schedule.weekday_daytime") == "mismatched", F.lit(False)),
    })
    said = said.withColumn("region_key", F.explode("_region_keys")).withColumn("role_key", F.explode("_role_keys"))
    met = said.join(keyed, ["region_key", "role_key", "day_key"])
    first = (F.array_min(F.array_intersect("_region_keys", "q_region_keys")) == F.col("region_key")) & (F.array_min(F.array_intersect("_role_keys", "q_role_keys")) == F.col("role_key"))
    met = met.where(first & ~F.arrays_overlap("_words", "q_excluded_keywords")).withColumnRenamed("wish", "query_id")
    pairs = judged(met, roles=F.col("_roles"), hits="_words").where("overall <> 'mismatched'").withColumnRenamed("query_id", "wish")
    pairs = pairs.drop("published_at").withColumnRenamed("ord", "class").join(members, "class").drop("class")
    if top is not None:
        order = Window.partitionBy("wish").orderBy(*RANK_MATCH())
        pairs = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.join(who, "wish").drop("wish", "published_at").select("query_id", "ord", *[c for c in pairs.columns if c not in ("wish", "ord", "published_at")])
