"""The text formats of vocabularies, signatures, rankings, relevance, domains, edges and distributions.

Writers turn a table into lines; a group's line is gathered from rows that belong to one id and are bounded by a top-k, a document's features
or a cluster's members.  Readers parse lines in place.  The native form of every table is Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.alphabets import split_nonempty


def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def words(value: Column | str = "value") -> Column:
    return split_nonempty(F.col(value) if isinstance(value, str) else value, r"\s+")


def number(x: Column) -> Column:
    """A double as text: whole numbers without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def gathered(df: DataFrame, key: str | list[str], item: Column, order: list[str], sep: str) -> DataFrame:
    """key, n, text: the items of each key in order, joined."""
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, F.struct(*order, item.alias("_item")).alias("_r"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_item"]), sep).alias("text"))


# ids and csv


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return text(spark, path).select(F.trim("value").alias("seq_id")).where("seq_id <> ''")


def write_ids(df: DataFrame, path: str, id_: str = "seq_id") -> None:
    df.select(F.col(id_).cast("string").alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, quote=quote, escape=quote, header=header, multiLine=True)


def write_csv(df: DataFrame, path: str, sep: str = ",", quote: str = '"', header: bool = True) -> None:
    df.write.csv(path, sep=sep, quote=quote, escape=quote, header=header)


def dataset_lines(records: DataFrame, tag: str, metadata: dict[str, str]) -> list[str]:
    """Head lines of a tagged dataset: 'tag,N' and 'meta,key,value' each; records follow."""
    return [f"{tag},{records.count()}", *(f"meta,{k},{v}" for k, v in metadata.items())]


def read_dataset(lines: DataFrame, tag: str) -> tuple[DataFrame, dict[str, str]]:
    """Records (value) and metadata of a tagged dataset; metadata lines are few and come to the driver."""
    meta = {k: v for _, k, v in (r["value"].split(",", 2) for r in lines.where(F.col("value").startswith("meta,")).collect())}
    return lines.where(~F.col("value").startswith("meta,") & ~F.col("value").rlike(f"^{tag},[0-9]+$") & (F.trim("value") != "")), meta


# signatures and feature vectors


def signature_lines(sigs: DataFrame) -> DataFrame:
    """seq_id, features (sorted) -> 'id card f1 f2 ...;'."""
    return sigs.select(F.concat(F.concat_ws(" ", F.col("seq_id").cast("string"), F.size("features").cast("string"), F.array_join(F.col("features").cast("array<string>"), " ")), F.lit(";")).alias("value"))


def read_signatures(lines: DataFrame) -> DataFrame:
    w = words(F.regexp_replace("value", ";", " "))
    return lines.where("trim(value) <> ''").select(F.get(w, F.lit(0)).alias("seq_id"), F.slice(w, 3, F.size(w)).cast("array<int>").alias("features"))


def feature_vector_lines(vectors: DataFrame) -> DataFrame:
    """seq_id, features (map key -> weight) -> 'id,card,key,weight,...' in order of key."""
    pairs = F.array_sort(F.map_entries("features"))
    return vectors.select(F.concat_ws(",", F.col("seq_id").cast("string"), F.size("features").cast("string"), F.array_join(F.flatten(F.transform(pairs, lambda p: F.array(p["key"].cast("string"), p["value"].cast("string")))), ",")).alias("value"))


def read_feature_vectors(lines: DataFrame) -> DataFrame:
    w = F.split("value", ",")
    n = F.get(w, F.lit(1)).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    keys, weights = F.transform(at, lambda i: F.get(w, 2 + 2 * i).cast("long")), F.transform(at, lambda i: F.get(w, 3 + 2 * i).cast("double"))
    return lines.where("trim(value) <> ''").select(F.get(w, F.lit(0)).alias("seq_id"), F.map_from_arrays(keys, weights).alias("features"))


# codebooks


def codebook_lines(clusters: DataFrame) -> DataFrame:
    """proto_id, word, distance, instances (array of seq_id, pos), metadata (map) -> (proto_id, value): a cluster's block, head line first."""
    member = F.concat(F.lit("distance:"), F.col("distance").cast("string"), F.lit(";"), F.array_join(F.transform("instances", lambda i: F.concat(i["seq_id"], F.lit(":"), i["pos"].cast("string"), F.lit(";"))), ""))
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit(";"))), "")
    rows = clusters.withColumn("_meta", F.coalesce(meta, F.lit("")))
    body = gathered(rows, ["proto_id", "_meta"], member, ["distance", "word"], "\n")
    return body.select("proto_id", F.concat(F.lit("Cluster,"), F.col("n").cast("string"), F.lit(","), "proto_id", F.lit(":0;"), "_meta", F.lit("\n"), "text").alias("value"))


def read_codebook(blocks: DataFrame) -> DataFrame:
    """blocks (value: a cluster's block, as cut by lineSep '\\nCluster,') -> proto_id, metadata, member, distance, instances."""
    rows = F.split(F.regexp_replace("value", r"^(Codebook,[^\n]*\n)?(Clusters\n)?(Cluster,)?", ""), "\n")
    head = F.get(rows, F.lit(0))
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: F.trim(r) != "")
    fields = split_nonempty(F.substring_index(head, ",", -1), ";")
    meta = F.map_from_entries(F.transform(F.slice(fields, 2, F.greatest(F.size(fields), F.lit(1))), lambda f: F.struct(F.substring_index(f, ":", 1), F.substring_index(f, ":", -1))))
    out = blocks.where("trim(value) <> ''").select(F.substring_index(F.get(fields, F.lit(0)), ":", 1).alias("proto_id"), meta.alias("metadata"), body.alias("lines"))
    out = out.select("proto_id", "metadata", F.posexplode("lines").alias("member", "line"))
    parts = split_nonempty(F.col("line"), ";")
    inst = F.transform(F.filter(parts, lambda p: ~p.startswith("distance:")), lambda p: F.struct(F.substring_index(p, ":", 1).alias("seq_id"), F.substring_index(p, ":", -1).cast("int").alias("pos")))
    return out.select("proto_id", "metadata", "member", F.regexp_extract("line", r"distance:(-?\d+)", 1).cast("int").alias("distance"), inst.alias("instances"))


# relevance


def read_qrels(lines: DataFrame) -> DataFrame:
    """'topic 0 doc rel'."""
    w = words()
    return lines.where(F.size(w) >= 4).select(F.get(w, F.lit(0)).alias("topic"), F.get(w, F.lit(2)).alias("doc"), F.get(w, F.lit(3)).cast("int").alias("rel"))


def qrels_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws(" ", "topic", F.lit("0"), "doc", F.col("rel").cast("string")).alias("value"))


def read_homologs(lines: DataFrame) -> DataFrame:
    """'topic doc doc ...' -> topic, doc; a topic that lists itself alone is kept."""
    w = words()
    return lines.where(F.size(w) >= 1).select(F.get(w, F.lit(0)).alias("topic"), F.explode(F.slice(w, 2, F.size(w))).alias("doc"))


def homolog_lines(homologs: DataFrame) -> DataFrame:
    g = gathered(homologs, "topic", F.col("doc"), ["doc"], " ")
    return g.select(F.concat_ws(" ", "topic", "text").alias("value"))


def qrels_from_families(entries: DataFrame) -> DataFrame:
    """entries (seq_id, classes) -> qrels of all ordered pairs that share a class, each once."""
    e = entries.select("seq_id", F.explode("classes").alias("class"))
    return e.select(F.col("seq_id").alias("topic"), "class").join(e.select(F.col("seq_id").alias("doc"), "class"), "class").select("topic", "doc", F.lit(1).alias("rel")).distinct()


def swissprot_entries(lines: DataFrame) -> DataFrame:
    """lines (line_no, value) of ID and DR records -> seq_id, classes: the Pfam families of each entry, in order."""
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0) if "file" not in lines.columns else Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    id_ = F.last(F.when(F.col("value").startswith("ID "), F.regexp_extract("value", r"^ID\s+(\S+)", 1)), ignorenulls=True).over(w)
    family = F.regexp_extract("value", r"^DR\s+Pfam;\s*([^;]+);", 1)
    rows = lines.select(id_.alias("seq_id"), family.alias("family")).where("family <> '' and seq_id is not null")
    return rows.groupBy("seq_id").agg(F.array_sort(F.collect_set("family")).alias("classes"))


# rankings: query_id, subject_id, score, rank (from 1), hits


def ranking_lines(rankings: DataFrame, dialect: str = "compact") -> DataFrame:
    """compact: 'q s1 score1 ... ___eol___ -100000'; plain: without the end mark; csv: 'q,N,s1,score1,...'; trec: 'q 0 s 0 score hits'."""
    if dialect == "trec":
        hits = F.col("hits") if "hits" in rankings.columns else F.lit(0)
        return rankings.select(F.concat_ws(" ", "query_id", F.lit("0"), "subject_id", F.lit("0"), number(F.col("score")), hits.cast("string")).alias("value"))
    sep = "," if dialect == "csv" else " "
    item = F.concat_ws(sep, F.col("subject_id").cast("string"), number(F.col("score")))
    g = gathered(rankings, "query_id", item, ["rank"], sep)
    if dialect == "csv":
        return g.select(F.concat_ws(",", "query_id", F.col("n").cast("string"), "text").alias("value"))
    return g.select(F.concat(F.concat_ws(" ", "query_id", "text"), F.lit(" ___eol___ -100000" if dialect == "compact" else "")).alias("value"))


def read_rankings(lines: DataFrame, dialect: str = "compact") -> DataFrame:
    """The end mark, where there is one, isn't a document."""
    if dialect == "trec":
        w = words()
        rows = lines.where(F.size(w) >= 5).select(F.get(w, F.lit(0)).alias("query_id"), F.get(w, F.lit(2)).alias("subject_id"), F.get(w, F.lit(4)).cast("double").alias("score"), F.get(w, F.lit(5)).cast("int").alias("hits"))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "subject_id")))
    w = split_nonempty(F.col("value"), ",") if dialect == "csv" else words()
    first = 2 if dialect == "csv" else 1
    n = F.floor((F.size(w) - first) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    items = F.transform(at, lambda i: F.struct(F.get(w, first + 2 * i).alias("subject_id"), F.get(w, first + 1 + 2 * i).cast("double").alias("score")))
    items = F.filter(items, lambda x: x["subject_id"] != "___eol___")
    rows = lines.where((F.size(w) > first) & ~F.col("value").startswith("rankings,"))
    return rows.select(F.get(w, F.lit(0)).alias("query_id"), F.posexplode(items).alias("p", "x")).select("query_id", "x.subject_id", "x.score", (F.col("p") + 1).alias("rank"))


# domains: pfam_id, descr, seq_id, seq_len, extents (0-origin, both ends included)


def read_swisspfam(blocks: DataFrame) -> DataFrame:
    """blocks (value: '>' head with the length last but one, then a line for each domain 'name n (m) id descr b-e b-e'); 1-origin in the file."""
    rows = F.split(F.trim("value"), "\n")
    head = words(F.regexp_replace(F.get(rows, F.lit(0)), "^>", ""))
    out = blocks.where("trim(value) <> ''").select(F.get(head, F.lit(0)).alias("seq_id"), F.element_at(head, -2).cast("int").alias("seq_len"), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))).alias("lines"))
    out = out.select("seq_id", "seq_len", F.explode("lines").alias("line"))
    pfam = F.regexp_extract("line", r"\b(PF\d+)\b", 1)
    spans = F.transform(F.regexp_extract_all("line", F.lit(r"(?<=\s)(\d+-\d+)(?=\s|$)"), F.lit(1)), lambda s: F.struct((F.substring_index(s, "-", 1).cast("int") - 1).alias("begin"), (F.substring_index(s, "-", -1).cast("int") - 1).alias("end")))
    descr = F.trim(F.regexp_extract("line", r"PF\d+(?:\.\d+)?\s+(.*?)(?:\s+\d+-\d+)*\s*$", 1))
    return out.select(pfam.alias("pfam_id"), descr.alias("descr"), "seq_id", "seq_len", spans.alias("extents")).where("pfam_id <> ''")


def domain_lines(domains: DataFrame) -> DataFrame:
    """(pfam_id, value): 'pfam descr n', blanks in descr as '~', then 'seq len m b e b e' for each sequence."""
    item = F.concat_ws(" ", "seq_id", F.col("seq_len").cast("string"), F.size("extents").cast("string"), F.array_join(F.transform("extents", lambda e: F.concat_ws(" ", e["begin"].cast("string"), e["end"].cast("string"))), " "))
    g = gathered(domains, ["pfam_id", "descr"], item, ["seq_id"], "\n")
    return g.select("pfam_id", F.concat("pfam_id", F.lit(" "), F.regexp_replace("descr", " ", "~"), F.lit(" "), F.col("n").cast("string"), F.lit("\n"), "text").alias("value"))


def read_domains(blocks: DataFrame) -> DataFrame:
    """blocks: a domain each, as `domain_lines` makes them."""
    rows = F.split("value", "\n")
    head = words(F.get(rows, F.lit(0)))
    out = blocks.where("trim(value) <> ''").select(F.get(head, F.lit(0)).alias("pfam_id"), F.regexp_replace(F.get(head, F.lit(1)), "~", " ").alias("descr"), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))).alias("lines"))
    out = out.select("pfam_id", "descr", F.explode("lines").alias("line")).where("trim(line) <> ''")
    w = words("line")
    n = F.get(w, F.lit(2)).cast("int")
    spans = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get(w, 3 + 2 * i).cast("int").alias("begin"), F.get(w, 4 + 2 * i).cast("int").alias("end")))
    return out.select("pfam_id", "descr", F.get(w, F.lit(0)).alias("seq_id"), F.get(w, F.lit(1)).cast("int").alias("seq_len"), spans.alias("extents"))


# edges, distributions, mixtures

EDGE = ["id1", "start1", "stop1", "id2", "start2", "stop2"]


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in EDGE]).alias("value"))


def read_edges(lines: DataFrame) -> DataFrame:
    w = F.split("value", "\t")
    rows = lines.where((F.size(w) == 6) & ~F.col("value").startswith("Edges\t"))
    return rows.select(*[F.get(w, F.lit(i)).cast("string" if c.startswith("id") else "int").alias(c) for i, c in enumerate(EDGE)])


def histogram_columns(hist: DataFrame) -> DataFrame:
    """x, p as N lines of 'x<TAB>p'."""
    return hist.orderBy("x").select(F.concat_ws("\t", number(F.col("x")), F.col("p").cast("string")).alias("value"))


def read_histogram_columns(lines: DataFrame) -> DataFrame:
    w = F.split("value", "\t")
    return lines.select(F.get(w, F.lit(0)).try_cast("double").alias("x"), F.get(w, F.lit(1)).try_cast("double").alias("p")).where("x is not null and p is not null")


def histogram_rows(rows: list[tuple[float, float]]) -> str:
    """Two lines: 'x' and its values, 'P' and its values; a distribution is small."""
    return "\t".join(["x", *(f"{x:g}" for x, _ in rows)]) + "\n" + "\t".join(["P", *(repr(p) for _, p in rows)]) + "\n"


def parse_histogram_rows(content: str) -> list[tuple[float, float]]:
    x, p = (line.split("\t")[1:] for line in content.strip().split("\n")[:2])
    return [(float(a), float(b)) for a, b in zip(x, p, strict=True)]


def mixture_text(models: list[dict]) -> str:
    """[{aicc, parts: [(alpha, mu, sigma)]}] as blocks."""
    return "\n".join(f"AIC {m['aicc']!r}\nalpha,mu,sigma\n" + "".join(f"{a!r},{mu!r},{s!r}\n" for a, mu, s in m["parts"]) for m in models)


def parse_mixtures(content: str) -> list[dict]:
    out: list[dict] = []
    for line in content.splitlines():
        if line.startswith("AIC"):
            out.append({"aicc": float(line.split()[-1]), "parts": []})
        elif line.strip() and not line.startswith("alpha") and out:
            out[-1]["parts"].append(tuple(map(float, line.split(","))))
    return out


def partition_text(seed: int, sample_size: int, train: list[str], test: list[str], tag: str = "partition") -> str:
    return "\n".join([tag, f"Seed,{seed}", f"SampleSize,{sample_size}", f"Training set,{len(train)}", *train, f"Test set,{len(test)}", *test]) + "\n"


def parse_partition(content: str) -> dict:
    rows = content.splitlines()
    out: dict = {"tag": rows[0], "seed": int(rows[1].split(",")[1]), "sample_size": int(rows[2].split(",")[1])}
    at = 3
    for name in ("train", "test"):
        n = int(rows[at].split(",")[1])
        out[name], at = rows[at + 1 : at + 1 + n], at + 1 + n
    return out
