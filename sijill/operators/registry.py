"""The citation registry and the upkeep of chunk tables (survey 2.2, 2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sijill.session import materialize


def first_text(*cols: Column) -> Column:
    """The first that isn't null or blank, trimmed; empty where none is."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def citations(chunks: DataFrame) -> DataFrame:
    """One citation for each chunk row with an id and a source: law, article, year, page and a readable reference.

    Rows without an id or a source cite nothing and are left out; repeats stay.
    """
    law, article = first_text(F.col("document_title")), first_text(F.col("article_reference"), F.col("section_title"))
    year = first_text(F.col("year"))
    return chunks.where("trim(coalesce(chunk_id, '')) <> '' AND trim(coalesce(source_file, '')) <> ''").select(
        F.trim("chunk_id").alias("chunk_id"),
        law.alias("law"),
        article.alias("article"),
        year.alias("law_year"),
        F.array_join(F.filter(F.array(law, article), lambda v: v != ""), " ").alias("legal_reference"),
        F.col("page_number"),
        first_text(F.col("document_type"), F.col("block_type")).alias("classification"),
        F.trim("source_file").alias("source_file"),
    )


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order, by a combining aggregate: no key's rows are sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest]))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col("__b")[c].alias(c) for c in rest])


def law_articles(cited: DataFrame) -> DataFrame:
    """How many chunks and which first and last one each law and article has; ids aren't gathered in lists."""
    return cited.groupBy("law", "article").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


def unique_ids(df: DataFrame, key: str, order: str, out: str = "unique_id") -> DataFrame:
    """Repeated ids made unique by a suffix -dup-n in the given order; the first keeps its id."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return df.withColumn(out, F.when(n > 0, F.concat(F.col(key), F.lit("-dup-"), n.cast("string"))).otherwise(F.col(key)))


def numbered(df: DataFrame, key: str, order: str, width: int = 100_000) -> DataFrame:
    """Adds `place`: each row's number within its key, in order of a whole-number column.

    Rows are numbered inside ranges of the order, and the ranges' sizes are added up, so a
    key that a third of all rows share is spread over as many tasks as it has ranges.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = ranged.withColumn("_within", F.row_number().over(W.partitionBy(key, "_range").orderBy(order)))
    return within.join(before, [key, "_range"]).withColumn("place", F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def most_shared(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, search_id, document_id, score): the rows that share most words with each question, and some that share fewer.

    asked: query_id, ws; rows: search_id, document_id, ws, different words each. Exact for
    the best: a first look by each question's two rarest words gives a score s that some
    row reaches; a row that reaches it too has one of the question's n - s + 1 rarest
    words, so frequent words are looked up only where nothing rarer decides.
    """
    postings = rows.select("search_id", F.explode("ws").alias("word"))
    words = asked.select("query_id", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    df = postings.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # a word of no other row decides nothing
    ranked = materialize(words.join(df, "word").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("df", "word"))).withColumn("rare", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("df") < 2, "df", "word"))), "ranked-words")

    def scored(chosen: DataFrame) -> DataFrame:
        pairs = chosen.select("query_id", "word").join(postings, "word").where("search_id <> query_id").select("query_id", "search_id").distinct()
        return pairs.join(asked, "query_id").join(rows.withColumnRenamed("ws", "own"), "search_id").select("query_id", "search_id", "document_id", F.size(F.array_intersect("ws", "own")).cast("long").alias("score"))

    floor = scored(ranked.where("rare <= 2")).groupBy("query_id").agg(F.max("score").alias("floor"))
    return scored(ranked.join(floor, "query_id", "left").where(F.col("rank") <= F.col("n") - F.coalesce("floor", F.lit(1)) + 1))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `current` whose key isn't changed, and all changes; columns by name."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def delete_where(current: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(doomed.select(*keys).distinct(), keys, "left_anti")


def registered(results: DataFrame, entries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The results whose id the registry holds."""
    return results.join(entries.select(key), key, "left_semi")


def unregistered(results: DataFrame, entries: DataFrame, key: str = "chunk_id") -> DataFrame:
    return results.join(entries.select(key), key, "left_anti")


def merge_layers(layers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Candidates of several layers as one row each: the smallest distance with its text, the first layer's title, and the layers' names."""
    union = None
    for i, (name, df) in enumerate(layers):
        part = df.select(F.col(key), "text", "title", "distance", F.lit(name).alias("layer"), F.lit(i).alias("ord"))
        union = part if union is None else union.unionByName(part)
    empty = F.coalesce(F.trim("text"), F.lit("")).eqNullSafe("")
    return union.groupBy(key).agg(
        F.min_by("text", F.struct(empty, "distance", "ord")).alias("text"),
        F.min_by("distance", F.struct(empty, "distance", "ord")).alias("distance"),
        F.min_by("title", "ord").alias("title"),
        F.array_join(F.array_sort(F.collect_set("layer")), "|").alias("layers"),
    )
