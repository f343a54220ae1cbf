"""Sources, tiling, sampling and sequence columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import alphabets as A
from tessera.functions import scalars as S
from tessera.functions.matrices import MATRICES
from tessera.operators import ranking, sampling, sequences, tiling, vocabulary
from tessera.operators.storage import shared_root
from tessera.plans.common import BITS, ITEMS, NATIONS, PARTS, TEXTS, items, nations, parts, sign_bits, table, texts, words
from tessera.sources import fasta, formats

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"with {PARTS} select seq_id, regexp_replace(regexp_replace(residues, '[-\\s]', '', 'g'), '[^arndcqeghilkmfpstwyvbzx*]', '*', 'g') residues, [class] classes from parts")
def fasta_round_trip(spark, sf_dir):
    """Parts as FASTA with class labels, written and read back."""
    path = scratch(spark, "fasta")
    rows = parts(spark, sf_dir)
    fasta.write(rows.select(F.array("seq_id", "class").alias("metadata"), "residues"), path)
    return fasta.read(spark, path, id_index=0, class_index=1).select("seq_id", "residues", "classes")


@query(f"with {PARTS} select seq_id, regexp_replace(residues, '[^arndcqeghilkmfpstwyvbzx*]', '', 'g') residues from parts where regexp_replace(residues, '[^arndcqeghilkmfpstwyvbzx*]', '', 'g') <> ''")
def fasta_drop_unknown(spark, sf_dir):
    """Symbols outside the alphabet are dropped."""
    path = scratch(spark, "fasta")
    fasta.write(parts(spark, sf_dir), path)
    return fasta.read(spark, path, unknown="drop").select("seq_id", "residues")


@query("select n_name proto_id, lower(n_name) word, count(c_custkey) size, n_regionkey::varchar as class from nation left join customer on c_nationkey = n_nationkey group by all")
def prototype_round_trip(spark, sf_dir):
    """Prototypes with sizes and classes as FASTA."""
    path = scratch(spark, "protos")
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).count()
    rows = table(spark, sf_dir, "nation").join(n, "n_nationkey", "left")
    fasta.write_prototypes(rows.select(F.col("n_name").alias("proto_id"), F.lower("n_name").alias("word"), F.coalesce("count", F.lit(0)).alias("size"), F.col("n_regionkey").cast("string").alias("class")), path)
    return fasta.read_prototypes(spark, path, A.DEFAULT)


@query(f"with {TEXTS}, w as ({words('texts', 12)}) select seq_id, count(*) n, count(distinct word) n_distinct from w group by 1")
def kmer_tiling(spark, sf_dir):
    """Words of twelve symbols of every text."""
    return tiling.word_counts(texts(spark, sf_dir), 12)


@query(f"with {PARTS}, w as ({words('parts', 4)}) select word, count(*) n, count(distinct seq_id) n_seqs from w group by 1")
def distinct_kmers(spark, sf_dir):
    """A1: the k-mer index's counts."""
    return tiling.distinct_kmers(tiling.kmers(parts(spark, sf_dir), 4))


@query(f"with {NATIONS}, w as ({words('nations', 3)}) select word, string_agg(seq_id || ':' || pos, ' ' order by seq_id, pos) instances, count(*) n from w group by 1")
def kmer_index(spark, sf_dir):
    """A1: words with their instances."""
    x = tiling.kmer_index(tiling.kmers(nations(spark, sf_dir), 3))
    return x.select("word", F.array_join(F.transform("instances", lambda i: F.concat_ws(":", i["seq_id"], i["pos"].cast("string"))), " ").alias("instances"), "n")


@query(f"with {ITEMS}, w as ({words('items', 8)}) select seq_id, pos, word from w where pos % 5 = 0")
def skipped_kmers(spark, sf_dir):
    """Every fifth word."""
    return tiling.kmers(items(spark, sf_dir), 8, skip=5)


@query(f"with {TEXTS} select seq_id, sum(greatest(0, length(residues) - 19))::bigint total_kmers, max(length(residues))::int max_length from texts group by 1")
def kmer_totals(spark, sf_dir):
    """A23 by sequence."""
    n = F.greatest(F.lit(0), F.length("residues") - 19)
    return texts(spark, sf_dir).groupBy("seq_id").agg(F.sum(n).alias("total_kmers"), F.max(F.length("residues")).alias("max_length"))


@query(f"with {ITEMS}, w as ({words('items', 6)}) select w.seq_id, pos, word from w where pos >= 10 and pos + 6 <= 60")
def kmers_within_extents(spark, sf_dir):
    """Words wholly inside an extent of each sequence."""
    rows = items(spark, sf_dir)
    return tiling.kmers_within(tiling.kmers(rows, 6), rows.select("seq_id", F.lit(10).alias("start"), F.lit(50).alias("len")), 6)


@query(f"""with {TEXTS}, n as (select seq_id, length(residues) n from texts),
c as (select *, case when 500 >= n then 1 else ceil(n / 500.0)::int end c from n),
s as (select *, unnest(range(c)) frag from c)
select seq_id, n::int n, frag::int frag, least(round(frag * case when c = 1 then 500.0 else n / c end)::int, n)::int as "begin",
  case when frag + 1 < c then least(round((frag + 1) * (n / c))::int, n) else n end::int as "end" from s""")
def fragments(spark, sf_dir):
    """Rounded fragment bounds."""
    return tiling.fragment_bounds(texts(spark, sf_dir).select("seq_id", F.length("residues").alias("n")), 500)


@query(f"with {ITEMS}, n as (select *, length(residues) - 5 n from items), w as (select seq_id, n, unnest(range(0, n)) pos from n where n > 0), c as (select *, case when 40 >= n then 1 else ceil(n / 40.0)::int end c from w) select seq_id, (case when c = 1 then pos // 40 else (pos * c) // n end)::int frag, count(*) n from c group by 1, 2")
def fragment_sizes(spark, sf_dir):
    """P5: words to a fragment."""
    w = tiling.kmers(items(spark, sf_dir).withColumn("n", F.length("residues") - 5), 6)
    return w.groupBy("seq_id", tiling.fragment_of(F.col("pos"), F.col("n"), 40).alias("frag")).agg(F.count("*").alias("n"))


@query("""with p as (select n_name q, length(n_name) qn, r_name s, length(r_name) sn from nation, region),
f as (select *, case when 4 >= qn then 1 else ceil(qn / 4.0)::int end qc, case when 4 >= sn then 1 else ceil(sn / 4.0)::int end sc from p)
select q query_id, s subject_id, count(*) pairs from (select q, s, unnest(range(qc)) a, sc from f), lateral (select unnest(range(sc)) b) group by all""")
def fragment_pairs(spark, sf_dir):
    """Fragment pairs of sequence pairs."""
    q = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query_id"), F.length("n_name").alias("query_n"))
    s = table(spark, sf_dir, "region").select(F.col("r_name").alias("subject_id"), F.length("r_name").alias("subject_n"))
    return tiling.fragment_pairs(q.join(F.broadcast(s)), 4).groupBy("query_id", "subject_id").agg(F.count("*").alias("pairs"))


@query(f"with {ITEMS} select seq_id, i::int as start, substr(residues, i + 1, 40) piece from (select *, unnest(range(0, length(residues), 20)) i from items)")
def dissected(spark, sf_dir):
    """Pieces of forty at every twentieth symbol."""
    return tiling.dissect(items(spark, sf_dir), 40, 20)


@query(f"""with {NATIONS} select seq_id, list_sum(list_transform(range(6), lambda i: greatest(instr('arndcqeghilkmfpstwyvbzx*', substr(rpad(residues, greatest(6, length(residues))::int, '*'), i + 1, 1)) - 1, 0) * (24::bigint ** (5 - i))::bigint))::bigint code,
  list_transform(range(length(residues)), lambda i: greatest(instr('arndcqeghilkmfpstwyvbzx*', substr(residues, i + 1, 1)) - 1, 0)::int)::varchar codes from nations""")
def horner_codes(spark, sf_dir):
    """Symbol codes and the Horner code of each name's first six symbols."""
    rows = nations(spark, sf_dir)
    padded = A.pad(F.col("residues"), 6, A.AMINO)
    codes = F.concat(F.lit("["), F.array_join(A.encode(F.col("residues"), A.AMINO).cast("array<string>"), ", "), F.lit("]"))
    return rows.select("seq_id", A.horner(F.substring(padded, 1, 6), A.AMINO).alias("code"), codes.alias("codes"))


@query(f"with {PARTS}, d as (select seq_id, translate(residues, 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacn') residues from parts) select seq_id, residues from d union all select seq_id || '_', reverse(translate(residues, 'acgt', 'tgca')) from d")
def reverse_complements(spark, sf_dir):
    """P18, F9."""
    d = parts(spark, sf_dir).select("seq_id", F.translate("residues", "abcdefghijklmnopqrstuvwxyz ", "acgtacgtacgtacgtacgtacgtacn").alias("residues"))
    return sequences.with_reverse_complements(d)


@query("select c as column_name, count(distinct v) n_values, count(*) n_rows from (select 0 c, c_name v from customer union all select 1, c_mktsegment from customer union all select 2, c_nationkey::varchar from customer) group by 1")
def metadata_counts(spark, sf_dir):
    """Distinct values of each metadata field."""
    rows = table(spark, sf_dir, "customer").select(F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("metadata"))
    return sequences.metadata_counts(rows).withColumnRenamed("column", "column_name")


@query(f"with {TEXTS}, s as (select unnest(string_split(residues, '')) symbol from texts), n as (select symbol, count(*) n from s where symbol <> '' group by 1) select symbol, n, n / (select sum(n) from n) p from n")
def symbol_histogram(spark, sf_dir):
    """A2: shares of symbols in all texts."""
    return sequences.symbol_histogram(texts(spark, sf_dir))


@query(f"with {NATIONS} select a.seq_id topic, b.seq_id doc, 1 rel from nations a join nations b on a.class = b.class")
def family_qrels(spark, sf_dir):
    """Relevance of all pairs that share a class."""
    return formats.qrels_from_families(nations(spark, sf_dir).select("seq_id", F.array("class").alias("classes")))


@query(f"with {NATIONS}, q as (select distinct n_name from supplier join nation on s_nationkey = n_nationkey where s_suppkey <= 5) select a.seq_id topic, b.seq_id doc from nations a join nations b on a.class = b.class where a.seq_id in (from q) and b.seq_id not in (from q)")
def homologs_of_subset(spark, sf_dir):
    """Homologs of the nations of the first five suppliers, without these themselves."""
    n = table(spark, sf_dir, "nation")
    q = table(spark, sf_dir, "supplier").where("s_suppkey <= 5").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name").distinct()
    pairs = formats.qrels_from_families(nations(spark, sf_dir).select("seq_id", F.array("class").alias("classes"))).select("topic", "doc")
    return sampling.homolog_subset(pairs, q)


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def largest(spark, sf_dir):
    """The hundred largest."""
    return sampling.largest(table(spark, sf_dir, "orders"), 100, "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select c_custkey, c_mktsegment, c_acctbal from customer qualify row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) <= 5")
def largest_per_class(spark, sf_dir):
    """K5: five of each class."""
    return sampling.largest_per_class(table(spark, sf_dir, "customer"), 5, "c_mktsegment", "c_acctbal", "c_custkey").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("select o_orderkey, o_custkey, o_totalprice from orders order by md5(o_orderkey || ':7'), o_orderkey limit 200")
def hash_sample(spark, sf_dir):
    """Exactly 200 rows in hash order."""
    return sampling.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 200, "o_orderkey", 7)


@query(f"with {PARTS}, w as ({words('parts', 5)}) select word from (select distinct word from w) order by md5(word || ':0'), word limit 100")
def minhash_words(spark, sf_dir):
    """P10: the hundred words of least hash."""
    return sampling.minhash_sample(tiling.kmers(parts(spark, sf_dir), 5), 100)


@query(f"with {PARTS} select *, row_number() over (order by md5(seq_id || ':3'), seq_id) <= 50 is_test from parts")
def train_test_split(spark, sf_dir):
    """Fifty test sequences."""
    return sampling.split_train_test(parts(spark, sf_dir), 50, seed=3)


@query(f"with {NATIONS}, f as (select seq_id, class, (1 + ('0x' || substr(md5(seq_id || ':1'), 1, 8))::bigint % 4)::int part from nations) select distinct a.seq_id topic, a.part, b.seq_id doc from f a join f b on a.class = b.class and a.part <> b.part")
def cross_folds(spark, sf_dir):
    """Homologs from other folds only."""
    rows = nations(spark, sf_dir).select("seq_id", F.array("class").alias("classes"))
    return sampling.cross_fold_homologs(sampling.folds(rows, 4, seed=1))


@query(f"with {ITEMS} select seq_id, residues from items where seq_id in (select p_partkey::varchar from part where p_size <= 25)")
def listed_queries(spark, sf_dir):
    """Queries of a list of ids, read from text."""
    path = scratch(spark, "ids")
    table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("value")).write.text(path)
    return sampling.query_subset(items(spark, sf_dir), formats.read_ids(spark, path))


@query(f"with {ITEMS}, w as ({words('items', 5)}), n as (select seq_id, word, pos, row_number() over (partition by seq_id order by md5(pos || ':2'), pos) r from w) select seq_id, pos, word from n where r <= 20")
def sampled_tiling(spark, sf_dir):
    """Twenty words of each sequence, by the hash of their places."""
    return tiling.sampled_kmers(items(spark, sf_dir), 5, 20, seed=2)


@query("select a.p_partkey, b.p_partkey other, (select count(*) from (select unnest(range(1, greatest(length(a.p_name), length(b.p_name)) + 1)) i) where substr(a.p_name, i, 1) is distinct from nullif(substr(b.p_name, i, 1), '') and not (substr(a.p_name, i, 1) = substr(b.p_name, i, 1)))::int mismatches from part a join part b on b.p_partkey = a.p_partkey + 1")
def hamming_neighbours(spark, sf_dir):
    """D3: mismatches of neighbouring names."""
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("x"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("other"), F.col("p_name").alias("y"))
    return a.join(b, F.col("other") == F.col("p_partkey") + 1).select("p_partkey", "other", S.hamming(F.col("x"), F.col("y")).alias("mismatches"))


@query(f"""with {BITS}, p as (select a.seq_id vec_id, b.seq_id other, len(list_intersect(a.features, b.features)) both_set, len(list_distinct(list_concat(a.features, b.features))) any_set from bits a join bits b on b.seq_id = a.seq_id + 1)
select vec_id, other, both_set::int both_set, any_set::int any_set, ((any_set - both_set) // 2)::int d, coalesce(both_set / nullif(any_set, 0), 0.0) similarity, (128 - (any_set - both_set)) / 128 equal_share from p""")
def bit_distances(spark, sf_dir):
    """Dense signatures of neighbouring vectors, all their components as bits of two longs."""
    e = sign_bits(spark, sf_dir).select(F.col("seq_id").alias("vec_id"), S.bits_of(F.col("features"), 2).alias("x"))
    o = e.select(F.col("vec_id").alias("other"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return e.join(o, F.col("other") == F.col("vec_id") + 1).select(
        "vec_id", "other", S.bits_and(x, y).alias("both_set"), S.bits_or(x, y).alias("any_set"), F.floor(S.bits_hamming(x, y) / 2).cast("int").alias("d"),
        S.bits_similarity(x, y).alias("similarity"), S.equal_bits(x, y, 128).alias("equal_share"),
    )


#: Names as nucleotides, by their letters' codes.
DNA = "dna as (select p_partkey, array_to_string(list_transform(string_split(lower(p_name), ''), lambda c: substr('acgtn', ascii(c) % 5 + 1, 1)), '') s from part)"


@query(f"with {DNA}, p as (select a.p_partkey, b.p_partkey other, substr(a.s, 1, 8) x, substr(b.s, 1, 8) y from dna a join dna b on b.p_partkey = a.p_partkey + 1) select p_partkey, other, list_sum(list_transform(range(1, 9), lambda i: case when substr(x, i, 1) = substr(y, i, 1) and substr(x, i, 1) <> 'n' then 0 else 1 end))::int d from p where length(x) = 8 and length(y) = 8")
def dna_distances(spark, sf_dir):
    """Mismatches of neighbouring words of eight nucleotides; n matches nothing."""
    code = F.transform(F.split(F.lower("p_name"), ""), lambda c: F.substr(F.lit("acgtn"), F.ascii(c) % 5 + 1, F.lit(1)))
    e = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.array_join(code, ""), 1, 8).alias("x")).where(F.length("x") == 8)
    o = e.select(F.col("p_partkey").alias("other"), F.col("x").alias("y"))
    return e.join(o, F.col("other") == F.col("p_partkey") + 1).select("p_partkey", "other", S.dna_distance(F.col("x"), F.col("y")).alias("d"))


@query("with s as (select unnest(['a', 'c', 'g', 't', 'n']) x), p as (select a.x a, b.x b, case when a.x = 'n' and b.x = 'n' then 1 when a.x = 'n' or b.x = 'n' then 4 when a.x = b.x then 16 else 0 end sim from s a, s b), o as (select x, case when x = 'n' then 1 else 16 end own from s) select a, b, sim::int sim, (p1.own + p2.own - 2 * sim)::int dist from p join o p1 on p1.x = a join o p2 on p2.x = b")
def halperin_distances(spark, sf_dir):
    """sim(x, x) + sim(y, y) - 2 sim(x, y) of the nucleotide matrix."""
    return MATRICES["dna"]().frame(spark, "halperin")


@query(f"with {PARTS}, w as (select distinct class proto_id, word from ({words('parts', 4)}) join parts using (seq_id)), n as (select proto_id, ceil(count(*) / 50) parts from w group by 1) select proto_id, word, (('0x' || substr(md5(word || ':0'), 1, 8))::bigint % parts)::int part from w join n using (proto_id)")
def split_clusters(spark, sf_dir):
    """C11: clusters of over fifty words in parts."""
    p = parts(spark, sf_dir)
    w = tiling.kmers(p, 4).select(F.col("class").alias("proto_id"), "word").distinct()
    return vocabulary.split_large(w, 50)


@query("with b as (select l_orderkey query_id, l_suppkey subject_id, l_linenumber qfrag, l_partkey % 7 sfrag, l_discount similarity, row_number() over (partition by l_orderkey, l_suppkey order by l_discount desc, l_linenumber, l_partkey % 7) r from lineitem) select query_id, subject_id, qfrag, sfrag, -similarity distance, row_number() over (partition by query_id order by -similarity, subject_id)::int as rank from b where r = 1 qualify rank <= 2")
def rank_best_fragments(spark, sf_dir):
    """K6: subjects by their best fragments."""
    li = table(spark, sf_dir, "lineitem")
    f = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("subject_id"), F.col("l_linenumber").alias("qfrag"), (F.col("l_partkey") % 7).alias("sfrag"), F.col("l_discount").alias("similarity"))
    return ranking.rank_fragments(f, 2)
