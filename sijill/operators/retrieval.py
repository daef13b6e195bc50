"""Search and ranking: BM25, lexical, signal, intent and vector scores, reranking (survey 2.6, 2.8, 2.9)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.operators import best as T
from sijill.operators.best import B, K1
from sijill.session import materialize

#: Queries held by a worker at once; more are scored block after block.
BLOCK = 4_096
#: Vectors that a worker takes at once, and distances that it holds at once.
VECTORS, CELLS = 4_096, 2_000_000
#: Postings of one term that a task takes; those of a term in every text are dealt over salts.
POSTINGS = 200_000
# Weights of the layers' scores and of the rerank.
RERANK_WEIGHTS = {"semantic": 0.25, "bm25": 0.28, "lexical": 0.19, "signal": 0.20, "intent": 0.08}
LAYER_BONUS = {"metadata": 0.08, "lexical": 0.05, "semantic": 0.03}
NEAR_DUPLICATE = 0.85


def term_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): the search tokens of each text, one row for each time a token or variant stands.

    Tokens are exploded before their variants are made, so both steps are compiled
    projections rather than lambdas over arrays.
    """
    raw = df.select(key, F.explode(F.regexp_extract_all(A.normalize_search(F.col(text)), F.lit(A.TOKEN), F.lit(0))).alias("raw"))
    kept = raw.where(~F.col("raw").isin(A.STOP_WORDS) & (F.col("raw").rlike("^[0-9]+$") | (F.length("raw") > 1)))
    return kept.select(key, F.explode(A.token_variants(F.col("raw"))).alias("term"))


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): the inverted index of a table."""
    return term_rows(df, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_part() -> Column:
    """What one term adds to a row's Okapi BM25, from times, n, df, tf, dl and avgdl."""
    return F.col("times") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def scored_postings(asked: DataFrame, index: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, bits, part, w) for each asked term of each row that holds it.

    asked: query_id, term, times, w; index: doc_id, term, tf; docs: doc_id, dl, bits of all
    rows. Only postings of asked terms go further. A term with more than POSTINGS of them
    is dealt over as many salts as that takes; only its askers are copied.
    """
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    postings = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df").withColumn("salts", F.ceil(F.col("df") / POSTINGS).cast("int"))
    weighted = asked.join(df, "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumn("n", F.lit(n)).withColumn("avgdl", F.lit(float(total) / n if n else 0.0))
    dealt = postings.join(df.select("term", "salts"), "term").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts").join(docs, "doc_id")
    return dealt.join(weighted, ["term", "salt"]).select("query_id", "doc_id", "bits", bm25_part().alias("part"), "w")


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = 10) -> DataFrame:
    """(query_id, doc_id, score, place): Okapi BM25 of every text that shares a term, as a share of the query's best.

    queries: query_id, text; docs: doc_id, text. Query terms count as often as they
    stand. Texts without terms count in the averages; queries and texts that share
    nothing give no row. With k, the best rows are found block by block of texts, without
    a row for each pair. Without, the inverted index is written once; only postings of
    terms that some query holds go further, dealt over salts before the join, and the sums
    combine before their shuffle.
    """
    if k is not None:
        return _best_bm25(queries, docs, k)
    index = materialize(term_frequencies(docs, "doc_id", "text"), "index")
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    asked = term_frequencies(queries, "query_id", "text").withColumnRenamed("tf", "times")
    raw = scored_postings(asked.withColumn("w", F.lit(1.0)), index, docs.select("doc_id").join(lengths, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), F.lit(0).alias("bits"))).groupBy("query_id", "doc_id").agg(F.sum("part").alias("raw"))
    best = raw.groupBy("query_id").agg(F.max("raw").alias("best"))
    scored = raw.join(best, "query_id").select("query_id", "doc_id", F.round(F.col("raw") / F.col("best"), 6).alias("score"))
    return top_k(scored, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def _best_bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    asked = materialize(queries.select(F.col("query_id").cast("long").alias("query_id"), A.search_tokens(F.col("text")).alias("listed")), "questions")
    index = T.encode(docs.select("doc_id", A.normalize_search(F.col("text")).alias("norm")), T.asked_terms(asked.select("listed")))
    n, avgdl, df = T.statistics(index)
    weight = T.idf(n, df)

    def questions():
        for r in asked.toLocalIterator():
            yield T.Question(r[0], [(t, times * weight[t], 0.0) for t, times in Counter(index.terms[v] for v in r[1]).items()])

    def settled(found: DataFrame) -> DataFrame:
        scored = found.withColumn("best", F.max("score").over(W.partitionBy("query_id"))).select("query_id", "doc_id", F.round(F.col("score") / F.col("best"), 6).alias("score"))
        return top_k(scored, "query_id", [F.desc("score"), F.asc("doc_id")], k)

    return T.best(index, questions(), n, avgdl, k, relative=True, settle=settled)


def top_k(scored: DataFrame, query: str, order: list[Column], k: int | None) -> DataFrame:
    """The first k rows of each query with their place; the limit works before the shuffle too."""
    out = scored.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(*order)))
    return out if k is None else out.where(F.col("place") <= k)


def lexical_relevance(q_norm: Column, q_tokens: Column, d_norm: Column, d_tokens: Column) -> Column:
    """Share of the query's different tokens found, numbers three times as heavy, a whole match 0.2 more, at most 1."""
    weight = lambda t: F.when(t.rlike("^[0-9]+$"), 3.0).otherwise(1.0)
    zero = F.lit(0.0)
    total = F.aggregate(q_tokens, zero, lambda a, t: a + weight(t))
    hit = F.aggregate(F.array_intersect(q_tokens, d_tokens), zero, lambda a, t: a + weight(t))
    whole = F.when((F.length(q_norm) >= 8) & F.contains(d_norm, q_norm), 0.2).otherwise(0.0)
    return F.when(total > 0, F.least(hit / total + whole, F.lit(1.0))).otherwise(0.0)


def signal_score(q_signals: Column, d_norm: Column, d_tokens: Column) -> Column:
    """Weight of the signals found: 3 with digits, else 2; in full where the text holds them, 0.8 where it holds their tokens. q_signals: array of struct(signal, tokens)."""
    weight = lambda s: F.when(s["signal"].rlike("[0-9]"), 3.0).otherwise(2.0)
    zero = F.lit(0.0)

    def found(s):
        own = s["tokens"]
        return F.when(F.contains(d_norm, s["signal"]), 1.0).when((F.size(own) > 0) & (F.size(F.array_except(own, d_tokens)) == 0), 0.8).otherwise(0.0)

    total = F.aggregate(q_signals, zero, lambda a, s: a + weight(s))
    return F.when(total > 0, F.aggregate(q_signals, zero, lambda a, s: a + weight(s) * found(s)) / total).otherwise(0.0)


def without_near_copies(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, place): the best k, of which none overlaps a better one by NEAR_DUPLICATE; copies fill up where nothing else is left. ranked: query_id, doc_id, score, tokens."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True])
        kept: list[set] = []
        own, rest = [], []
        for i, tokens in enumerate(rows["tokens"]):
            words = set(tokens) if len(kept) < k else set()
            if len(kept) >= k or any((words or x) and len(words & x) / len(words | x) >= NEAR_DUPLICATE for x in kept):
                rest.append(i)
            else:
                kept.append(words)
                own.append(i)
        out = rows[["query_id", "doc_id", "score"]].iloc[(own + rest)[:k]]
        return out.assign(place=np.arange(1, len(out) + 1, dtype=np.int32))

    return ranked.select("query_id", "doc_id", "score", "tokens").groupBy("query_id").applyInPandas(fold, "query_id long, doc_id long, score double, place int")


def vector_top_k(queries: DataFrame, vectors: DataFrame, key: str, field: str, metric: str = "l2", k: int = 10) -> DataFrame:
    """(query_id, vec_id, distance, place): exact nearest vectors, squared Euclidean or cosine.

    queries and vectors: key and array of floats. The query set goes to the workers in
    blocks of BLOCK; each task keeps the k best of its vectors for each query, so what is
    shuffled is k rows a task and query. Distances are worked out CELLS at a time. Null vectors are left out; a zero vector has
    cosine distance 1.
    """
    out = None
    asked = queries.where(F.col(field).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.col(field).alias("v"))
    rows, block = asked.toLocalIterator(), []

    def scan(ids: np.ndarray, block: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((ids, block))

        def run(batches):
            ids, q = shared.value
            qn = np.sqrt((q * q).sum(1))
            # the k best so far of each query: distances, keys
            near, who = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                for part in (batch.slice(i, VECTORS) for i in range(0, batch.num_rows, VECTORS)):
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    x = flat.reshape(len(keys), -1).astype(np.float64)
                    xs = (x * x).sum(1)
                    step = max(1, CELLS // len(keys))
                    for at in range(0, len(ids), step):
                        d = q[at : at + step] @ x.T
                        if metric == "cosine":
                            norm = qn[at : at + step, None] * np.sqrt(xs)[None]
                            np.divide(d, norm, out=d, where=norm > 0)
                            d[norm <= 0] = 0
                            np.subtract(1, d, out=d)
                        else:
                            d = (qn[at : at + step] ** 2)[:, None] + xs[None] - 2 * d
                        last = near[at : at + step, -1]
                        for r in np.flatnonzero((d <= last[:, None] + 0.0001).any(1)):
                            c = np.flatnonzero(d[r] <= last[r] + 0.0001)
                            v = np.round(np.maximum(d[r, c], 0), 4) + 0.0
                            if len(c) > k:
                                c, v = (z[v <= np.partition(v, k - 1)[k - 1]] for z in (c, v))
                            v, w = np.append(near[at + r], v), np.append(who[at + r], keys[c])
                            order = np.lexsort((w, v))[:k]
                            near[at + r], who[at + r] = v[order], w[order]
            there = np.isfinite(near)
            if there.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(1))), pa.array(who[there]), pa.array(near[there])], ["query_id", "vec_id", "distance"])

        own = vectors.where(F.col(field).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(field).alias("v"))
        return own.mapInArrow(run, "query_id long, vec_id long, distance double")

    def add(block):
        nonlocal out
        part = scan(np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block], np.float64))
        out = part if out is None else out.unionByName(part)

    for row in rows:
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            add(block)
            block = []
    if block:
        add(block)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double, place int")
    return top_k(out, "query_id", [F.asc("distance"), F.asc("vec_id")], k)
