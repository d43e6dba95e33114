"""Full-text, vector and hybrid search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import stemming, vectors
from larkspur.operators.windows import numbered

DISTANCES = {"l2": vectors.l2_squared, "cosine": vectors.cosine_distance, "inner": vectors.negative_inner}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def terms_of(query: str) -> list[str]:
    """Words of a query; punctuation is taken out of a word, not a border."""
    return [t for t in (re.sub(r"[^\w]|_", "", w).lower() for w in query.split()) if t]


def match_score(columns: Sequence[Column], query: str, stem: bool = False) -> Column:
    """MATCH ... AGAINST: how many of the query's terms are there, repeats counted. NULL
    columns are empty. ``stem`` compares the stems of English words on both sides, which
    costs a pass through Python; without it everything stays in generated code."""
    words = tokens(F.concat_ws(" ", *columns))
    terms = terms_of(query)
    if stem:
        words, terms = stemming.stems(words), [stemming.stem(t) for t in terms]
    score = F.lit(0)
    for t in terms:
        score = score + F.array_contains(words, t).cast("int")
    return score.cast("bigint")


def match_boolean(columns: Sequence[Column], query: str) -> Column:
    """IN BOOLEAN MODE: ``+term`` must be there, ``-term`` must not, else 0; the score
    counts the terms that are there."""
    words = tokens(F.concat_ws(" ", *columns))
    ok, score = F.lit(True), F.lit(0)
    for w in query.split():
        for t in terms_of(w):
            there = F.array_contains(words, t)
            if w[0] == "-":
                ok = ok & ~there
                continue
            if w[0] == "+":
                ok = ok & there
            score = score + there.cast("int")
    return F.when(ok, score).otherwise(0).cast("bigint")


def postings(df: DataFrame, key: str, columns: Sequence[str], stem: bool = False) -> DataFrame:
    """Inverted index: ``term``, ``key``, each pair once. Write it partitioned or bucketed
    by term for lookups."""
    words = F.array_distinct(tokens(F.concat_ws(" ", *columns)))
    found = df.select(F.explode(words).alias("term"), F.col(key))
    if not stem:
        return found
    # Each different word is stemmed once, however often it stands in the texts.
    stems = found.select("term").distinct().withColumn("_stem", stemming.stems(F.array("term"))[0])
    return found.join(stems, "term").select(F.col("_stem").alias("term"), F.col(key)).distinct()


def write_index(df: DataFrame, key: str, columns: Sequence[str], path: str, stem: bool = False, folders: int = 64) -> str:
    """CREATE FULLTEXT INDEX: the postings stored in folders by the term's hash, sorted by
    term within files, so that a lookup reads one folder and few row groups a term."""
    index = postings(df, key, columns, stem).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int"))
    index = index.repartition("part", F.pmod(F.hash(key), F.lit(4))).sortWithinPartitions("part", "term")
    index.write.mode("overwrite").partitionBy("part").parquet(path)
    return path


def read_index(spark: SparkSession, path: str, key: str, query: str, stem: bool = False, folders: int = 64) -> DataFrame:
    """``key`` and score of the rows that hold any term, from a stored index."""
    terms = [stemming.stem(t) for t in terms_of(query)] if stem else terms_of(query)
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(folders)).cast("int"))
    parts = sorted({r[0] for r in wanted.collect()}) if terms else []
    return lookup(spark.read.parquet(path).where(F.col("part").isin(parts)), key, " ".join(terms))


def lookup(index: DataFrame, key: str, query: str) -> DataFrame:
    """``key`` and score of the rows that hold any term, from an inverted index."""
    terms = terms_of(query)
    weight = F.create_map(*[x for t in set(terms) for x in (F.lit(t), F.lit(terms.count(t)))])
    return index.where(F.col("term").isin(terms)).groupBy(key).agg(F.sum(weight[F.col("term")]).cast("bigint").alias("score"))


def knn(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, metric: str = "l2") -> DataFrame:
    """The k nearest rows to one vector, exact: distances in generated code and a top-k
    that sends k rows a task to the driver's merge. Ties by ``key``; NULL vectors and
    those of another length take no part."""
    d = DISTANCES[metric](F.col(vector), vectors.literal(query))
    ranked = df.where(F.size(vector) == len(query)).withColumn("distance", d)
    return ranked.orderBy("distance", key).limit(k)


def with_hybrid(
    df: DataFrame, columns: Sequence[str], query: str, vector: str, near: Sequence[float], name: str, base: int = 60
) -> DataFrame:
    """The rows with their reciprocal-rank fusion as a column: as ``hybrid``, for rows without
    a key. Equal distances and equal numbers of terms go by the columns' texts."""
    d = vectors.l2_squared(F.col(vector), vectors.literal(near))
    scored = df.withColumns(
        {"_d": F.when(F.size(vector) == len(near), d), "_t": match_score([F.col(c).cast("string") for c in columns], query)}
    )
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    one = numbered(scored, [F.col("_d").asc_nulls_last(), text], "_r")
    two = numbered(one, [F.desc("_t"), text], "_s")
    score = F.when(F.col("_d").isNotNull(), 1 / (base + F.col("_r"))).otherwise(0.0) + F.when(F.col("_t") > 0, 1 / (base + F.col("_s"))).otherwise(0.0)
    return two.withColumn(name, score).drop("_d", "_t", "_r", "_s")


def hybrid(
    df: DataFrame, key: str, columns: Sequence[str], query: str, vector: str, near: Sequence[float], base: int = 60
) -> DataFrame:
    """``key`` and ``score``: reciprocal-rank fusion of the vector rank and the rank by
    matched terms, 1/(base + rank) from rank 1 on. Rows without a matched term have no
    text rank; rows without a usable vector no vector rank.

    Ranks over the whole table need a total order. Only keys and scores take part in it,
    and they are numbered by ranges, not in one task.
    """
    d = vectors.l2_squared(F.col(vector), vectors.literal(near))
    scored = df.select(
        F.col(key),
        F.when(F.size(vector) == len(near), d).alias("_d"),
        match_score([F.col(c) for c in columns], query).alias("_t"),
    )
    by_vector = numbered(scored.where("_d is not null").select(key, "_d"), [F.col("_d"), F.col(key)], "_r").select(key, "_r")
    by_text = numbered(scored.where("_t > 0").select(key, "_t"), [F.desc("_t"), F.col(key)], "_r").select(key, "_r")
    return by_vector.unionAll(by_text).groupBy(key).agg(F.sum(1 / (base + F.col("_r"))).alias("score"))
