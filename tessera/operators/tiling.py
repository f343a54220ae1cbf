"""Tiling sequences into words, fragments and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sampling import order_of


def starts(length: Column, k: int, step: int = 1) -> Column:
    """0-origin starts of the whole windows of k; none if the length is under k."""
    return F.when(length >= k, F.sequence(F.lit(0), length - k, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _chunks(df: DataFrame, text: str, size: int, overlap: int, base: str) -> DataFrame:
    """Long texts in chunks with an overlap, base telling where each begins: taking a word costs a walk from its string's start."""
    at = F.explode(F.when(F.length(text) > overlap, F.sequence(F.lit(0), F.length(text) - 1 - overlap, F.lit(size))).otherwise(F.array().cast("array<int>"))).alias("_at")
    keep = [c for c in df.columns if c not in (text, base)]
    before = F.col(base) if base in df.columns else F.lit(0)
    return df.select(*keep, text, before.alias(base), at).select(*keep, (F.col(base) + F.col("_at")).alias(base), F.expr(f"substring(`{text}`, _at + 1, {size + overlap})").alias(text))


def kmers(df: DataFrame, k: int, text: str = "residues", skip: int = 1) -> DataFrame:
    """One row for each word of k symbols: all columns but the text, pos (0-origin) and word.  skip: every skip-th only.

    A narrow transformation, linear in the text: the number of rows is the symbols', so aggregate by word before any shuffle."""
    keep = [c for c in df.columns if c != text]
    chunks = _chunks(_chunks(df, text, 8192, k - 1, "_base"), text, 128, k - 1, "_base")
    rows = chunks.select(*keep, "_base", text, F.explode(starts(F.length(text), k)).alias("_p")).withColumn("pos", F.col("_base") + F.col("_p"))
    if skip > 1:
        rows = rows.where(F.col("pos") % skip == 0)
    return rows.select(*keep, "pos", F.expr(f"substring(`{text}`, _p + 1, {k})").alias("word"))


def sampled_kmers(df: DataFrame, k: int, n: int, seed: int = 0, text: str = "residues") -> DataFrame:
    """n words of each sequence at most (or all), chosen by the hash of their places: places are drawn from the text's length, and only
    words at drawn places are made."""
    places = starts(F.length(text), k)
    drawn = F.slice(F.array_sort(F.transform(places, lambda p: F.struct(order_of(p, seed).alias("h"), p.alias("p")))), 1, n)
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, text, F.explode(F.transform(drawn, lambda x: x["p"])).alias("pos"))
    return rows.select(*keep, "pos", F.substr(F.col(text), F.col("pos") + 1, F.lit(k)).alias("word"))


def word_array(text: Column, k: int, stride: int = 128) -> Column:
    """All words of k symbols of a bounded text, in order: pieces first, for taking a word costs a walk from its string's start."""
    def cut(t: Column, size: int) -> Column:
        return F.transform(starts(F.length(t), k, size), lambda at: F.substr(t, at + 1, F.lit(size + k - 1)))

    return F.flatten(F.transform(cut(text, stride), lambda piece: F.transform(starts(F.length(piece), k), lambda p: F.substr(piece, p + 1, F.lit(k)))))


def word_counts(df: DataFrame, k: int, text: str = "residues", chunk: int = 1 << 15) -> DataFrame:
    """seq_id, n, n_distinct of the words of k symbols of each sequence that has any.

    Words are counted where the text is, a chunk at a time; what is shuffled is a pair of counts for each chunk.  Only words of sequences of
    several chunks (or several rows) are made distinct by a shuffle."""
    chunks = _chunks(df.select("seq_id", text), text, chunk, k - 1, "_base")
    words = word_array(F.col(text), k)
    counted = chunks.select("seq_id", F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("d"))
    sums = counted.groupBy("seq_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.count("*").alias("chunks"))
    several = sums.where("chunks > 1 and seq_id is not null").select("seq_id")
    exact = kmers(df.select("seq_id", text).join(several, "seq_id", "left_semi"), k, text).groupBy("seq_id").agg(F.count_distinct("word").alias("exact"))
    return sums.where("n > 0").join(exact, "seq_id", "left").select("seq_id", "n", F.coalesce("exact", "d").alias("n_distinct"))


def kmers_within(words: DataFrame, extents: DataFrame, k: int, key: str = "seq_id") -> DataFrame:
    """Words wholly inside an extent (key, start, len)."""
    e = extents.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("len").alias("_n"))
    inside = (F.col(key) == F.col("_k")) & (F.col("pos") >= F.col("_s")) & (F.col("pos") + k <= F.col("_s") + F.col("_n"))
    return words.join(e, inside, "left_semi")


def kmer_counts(df: DataFrame, k: int, text: str = "residues") -> DataFrame:
    """total and most words of a sequence, and the greatest length."""
    n = F.greatest(F.lit(0), F.length(text) - k + 1)
    return df.agg(F.sum(n).alias("total_kmers"), F.max(n).alias("max_kmers"), F.max(F.length(text)).alias("max_length"))


def kmer_index(words: DataFrame, key: str = "seq_id") -> DataFrame:
    """word, instances (array of key, pos; in order), n: instances are gathered, so use `distinct_kmers` where only counts matter."""
    return words.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(key, "pos"))).alias("instances"), F.count("*").alias("n"))


def distinct_kmers(words: DataFrame, key: str = "seq_id") -> DataFrame:
    """word, n (instances), n_seqs."""
    return words.groupBy("word", key).agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_seqs"))


def fragment_count(n: Column, f: int) -> Column:
    return F.when(F.lit(f) >= n, 1).otherwise(F.ceil(n / f)).cast("int")


def fragment_of(pos: Column, n: Column, f: int) -> Column:
    """floor(pos / step); step: f if there is one fragment, else n / count."""
    count = fragment_count(n, f)
    return F.when(count == 1, F.floor(pos / f)).otherwise(F.floor(pos * count / n)).cast("int")


def fragment_starts(n: Column, f: int) -> Column:
    """Rounded starts min(round(i * step), n) of all fragments."""
    count = fragment_count(n, f)
    step = F.when(count == 1, F.lit(float(f))).otherwise(n / count)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.least(F.round(i * step).cast("int"), n))


def fragment_bounds(df: DataFrame, f: int, length: str = "n") -> DataFrame:
    """Rows of frag, begin, end (end excluded) beside df's columns."""
    s = fragment_starts(F.col(length), f)
    pieces = F.transform(s, lambda b, i: F.struct(i.alias("frag"), b.alias("begin"), F.coalesce(F.get(s, i + 1), F.col(length)).alias("end")))
    return df.select("*", F.inline(pieces))


def fragment_pairs(pairs: DataFrame, f: int) -> DataFrame:
    """Sequence pairs (query_id, query_n, subject_id, subject_n) -> all pairs of their fragments (qfrag, sfrag with begins and ends)."""
    q = fragment_bounds(pairs, f, "query_n").select("*", F.struct("frag", "begin", "end").alias("q")).drop("frag", "begin", "end")
    s = fragment_bounds(q, f, "subject_n")
    return s.select("query_id", "subject_id", F.col("q.frag").alias("qfrag"), F.col("q.begin").alias("qbegin"), F.col("q.end").alias("qend"), F.col("frag").alias("sfrag"), F.col("begin").alias("sbegin"), F.col("end").alias("send"))


def dissect(df: DataFrame, length: int, step: int, text: str = "residues") -> DataFrame:
    """Pieces of a fixed length at every step; the last ones may be shorter."""
    at = F.explode(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>")))
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, text, at.alias("start")).select(*keep, "start", F.expr(f"substring(`{text}`, start + 1, {length})").alias("piece"))
