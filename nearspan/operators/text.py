"""Texts as vectors: means of word vectors, vocabulary filters, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measured bytes up to which a vocabulary is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


def _sized(vocabulary: DataFrame) -> tuple[DataFrame, bool]:
    """The vocabulary, marked for broadcasting where its measured size is small enough, and whether it is."""
    size = F.lit(16) + F.octet_length("word") + (F.size("vec") * 8 if "vec" in vocabulary.columns else F.lit(0))
    small = (vocabulary.agg(F.sum(size)).collect()[0][0] or 0) <= BROADCAST_BYTES
    return (F.broadcast(vocabulary) if small else vocabulary), small


def tokens(texts: DataFrame, key: str, text: str, pattern: str = " ") -> DataFrame:
    return texts.select(key, F.explode(F.split(F.col(text), pattern)).alias("word"))


def text_vectors(texts: DataFrame, vocabulary: DataFrame, dim: int, key: str = "id", text: str = "text", pattern: str = " ") -> DataFrame:
    """Mean vector of a text's known words, with multiplicity; a zero vector if none is known.

    Words are looked up before anything moves, so unknown ones never do, and a text's words stand
    together, so that one row a text is shuffled, already summed. A vocabulary too large to be
    broadcast is joined after the words are counted by text.
    """
    known, small = _sized(vocabulary.select("word", "vec"))
    rows = texts.select(key, text)
    if small:
        looked = tokens(rows, key, text, pattern).join(known, "word").withColumn("n", F.lit(1))
    else:
        looked = tokens(rows, key, text, pattern).groupBy(key, "word").agg(F.count("*").alias("n")).join(known, "word")
    sums = [F.sum(F.col("n") * F.get("vec", F.lit(i))) for i in range(dim)]
    means = looked.groupBy(key).agg(F.array(*[s / F.sum("n") for s in sums]).alias("vec"), F.sum("n").alias("n_known"))
    zero = F.array(*[F.lit(0.0)] * dim)
    return texts.select(key).join(means, key, "left").select(key, F.coalesce("vec", zero).alias("vec"), F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"))


def with_known_word(texts: DataFrame, vocabulary: DataFrame, key: str = "id", text: str = "text", ignored: str = "Episode") -> DataFrame:
    """The texts that hold a word of the vocabulary other than the ignored one."""
    found = tokens(texts, key, text, r"\s+").where(F.col("word") != ignored).distinct().join(_sized(vocabulary.select("word").distinct())[0], "word", "left_semi")
    return texts.join(found.select(key).distinct(), key, "left_semi")


def cleaned(title: Column) -> Column:
    """A title without anything but word characters and white space."""
    return F.regexp_replace(title, r"[^\w\s]", "")


def clean_dataset(rows: DataFrame, vocabulary: DataFrame, title: str, limit: int | None = None) -> DataFrame:
    """Titles cleaned and filtered by vocabulary; ``limit`` is the first so many by id."""
    out = rows.withColumn(title, cleaned(F.col(title)))
    if limit is not None:
        out = out.orderBy("id").limit(limit)
    return with_known_word(out, vocabulary, text=title)


def embed_dataset(rows: DataFrame, vocabulary: DataFrame, dim: int, title: str, limit: int | None = None) -> DataFrame:
    """Cleaned titles that hold a known word, as vectors: id, vec."""
    return text_vectors(clean_dataset(rows, vocabulary, title, limit), vocabulary, dim, text=title).select("id", "vec")
