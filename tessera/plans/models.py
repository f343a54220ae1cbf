"""Distributions, mixtures, domains, edges and the remaining formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.matrices import blosum62
from tessera.operators import distributions as D
from tessera.operators import domains as dom
from tessera.operators import mixtures, tiling
from tessera.operators.sequences import symbol_histogram
from tessera.plans.common import ITEMS, NATIONS, PARTS, items, nations, parts, table, words
from tessera.plans.ranking import LETTERS
from tessera.plans.tiling import scratch
from tessera.sources import formats

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Quantities of line items as a distribution.
PMF = "h as (select l_quantity x, count(*) n from lineitem group by 1), pmf as (select x, n / (select sum(n) from h) p from h), cdf as (select x, p, sum(p) over (order by x) f from pmf)"


def _quantity(spark, sf_dir):
    return D.normalise(D.histogram(table(spark, sf_dir, "lineitem"), "l_quantity"))


@query(f"with {PMF} select x, p from pmf")
def histogram(spark, sf_dir):
    """A3: a normalised histogram."""
    return _quantity(spark, sf_dir)


@query("with h as (select o_orderpriority x, sum(o_totalprice) n from orders group by 1) select x, round(n / (select sum(n) from h), 9) p from h")
def weighted_histogram(spark, sf_dir):
    """A3: weighted."""
    h = D.normalise(D.histogram(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))
    return h.withColumn("p", F.round("p", 9))


@query("select distinct value x, round(cume_dist() over (order by value), 9) F from events where value is not null")
def empirical_cdf(spark, sf_dir):
    """Of event values."""
    return D.ecdf(table(spark, sf_dir, "events"), "value").withColumn("F", F.round("F", 9))


@query(f"with {PMF} select round(sum(x * p), 6) mean, round(sqrt(sum(x * x * p) - sum(x * p) ** 2), 6) sd from pmf")
def moments(spark, sf_dir):
    """Mean and standard deviation of a distribution."""
    return D.moments(_quantity(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"with {PMF}, t as (select unnest([0.1, 0.25, 0.5, 0.9, 0.99])::double t) select t, min(x) x from t join cdf on f >= t - 1e-12 group by 1")
def inverse_cdf(spark, sf_dir):
    """Quantiles of a step distribution."""
    return D.inverse_step(D.with_cdf(_quantity(spark, sf_dir)), [0.1, 0.25, 0.5, 0.9, 0.99])


@query(f"with {PMF}, s as (select lag(x) over (order by x) x0, lag(f) over (order by x) f0, x x1, f f1 from cdf), t as (select unnest([0.1, 0.25, 0.5, 0.9])::double t) select t, round(x0 + (t - f0) * (x1 - x0) / (f1 - f0), 6) x from t join s on f0 < t and t <= f1")
def interpolated_quantiles(spark, sf_dir):
    """Quantiles by linear interpolation."""
    return D.inverse_linear(D.with_cdf(_quantity(spark, sf_dir)), [0.1, 0.25, 0.5, 0.9]).withColumn("x", F.round("x", 6))


@query(f"with {PMF}, f as (select x, 1 - (1 - least(f, 1.0)) ** 5 lo, least(f, 1.0) ** 5 hi from cdf) select x, round(lo, 6) least, round(hi, 6) greatest from f")
def order_statistics(spark, sf_dir):
    """CDFs of the least and greatest of five draws."""
    p = _quantity(spark, sf_dir)
    one, two = D.minimum_of(p, 5).select("x", F.round("F", 6).alias("least")), D.maximum_of(p, 5).select("x", F.round("F", 6).alias("greatest"))
    return one.join(two, "x")


@query(f"with {PMF} select a.x + b.x x, round(sum(a.p * b.p), 9) p from pmf a, pmf b group by 1")
def convolution(spark, sf_dir):
    """A5: the sum of two draws."""
    p = _quantity(spark, sf_dir)
    return D.convolve(p, p).withColumn("p", F.round("p", 9))


@query(f"with {PMF}, c as (select x, p from cdf where f between 0.2 and 0.8) select x, round(p / (select sum(p) from c), 9) p from c")
def conditional_distribution(spark, sf_dir):
    """A9."""
    return D.conditional(_quantity(spark, sf_dir), "F between 0.2 and 0.8").withColumn("p", F.round("p", 9))


@query(f"""with {ITEMS}, s as (select unnest(string_split(residues, '')) symbol from items), n as (select symbol, count(*) n from s where symbol <> '' group by 1), b as (select symbol, n / (select sum(n) from n) p from n),
c as (select symbol, case when contains('abcdefghijklmnopqrstuvwxyz_ 0123456789.,', symbol) then symbol else ',' end s, p from b), o as (select s, sum(p) p from c group by 1),
one as (select sum(p) filter (same) p0, sum(p) filter (not same) p1 from (select a.p * b.p p, a.s = b.s same from o a, o b)), d as (select 0 x, p0 p from one union all select 1, p1 from one)
select (a.x + b.x + c.x + d.x)::bigint x, round(sum(a.p * b.p * c.p * d.p), 9) p from d a, d b, d c, d d group by 1""")
def kmer_distance_distribution(spark, sf_dir):
    """Distances of random words of four symbols (Hamming), from the items' background."""
    known = LETTERS.symbols
    h = symbol_histogram(items(spark, sf_dir)).select(F.when(F.instr(F.lit(known), F.col("symbol")) > 0, F.col("symbol")).otherwise(known[-1]).alias("symbol"), "p")
    h = h.groupBy("symbol").agg(F.sum("p").alias("p"))
    one = D.pair_distances(LETTERS.frame(spark, "edit").select("a", "b", "dist"), h)
    return D.kmer_distances(one, 4).withColumn("p", F.round("p", 9))


@query()
def fragment_distance_distribution(spark, sf_dir):
    """A10: of Hausdorff averages, with BLOSUM62 and a uniform background."""
    one = D.pair_distances(blosum62().frame(spark).select("a", "b", "dist"))
    return D.fragment_average(one, 3, 20, 4)


@query(f"""with {ITEMS}, w as ({words('items', 6)}), o as (select word, md5(concat_ws('|', seq_id, pos, word) || ':5') h from w order by h, word limit 400), r as (select word, row_number() over (order by h, word) - 1 r from o),
p as (select a.word, b.word other from r a join r b on b.r = a.r + 1 and a.r % 2 = 0), l as (select 'abcdefghijklmnopqrstuvwxyz_ 0123456789.,' s)
select word, other, list_sum(list_transform(range(1, 7), lambda i: (case when contains(s, substr(word, i, 1)) then substr(word, i, 1) else ',' end <> case when contains(s, substr(other, i, 1)) then substr(other, i, 1) else ',' end)::int))::int distance from p, l""")
def random_kmer_distances(spark, sf_dir):
    """Distances of sampled word pairs."""
    return D.random_kmer_distances(tiling.kmers(items(spark, sf_dir), 6), 200, LETTERS, "edit", seed=5)


@query("with e as (select distinct o_totalprice x, cume_dist() over (order by o_totalprice) f from orders), r as (select ln(x) u, ln(-ln(1 - f)) v from e where x > 0 and f between 0.01 and 0.99) select round(regr_slope(v, u), 4) shape, round(exp(-regr_intercept(v, u) / regr_slope(v, u)), 1) as scale from r")
def weibull_fit(spark, sf_dir):
    """M5: of order prices."""
    return D.weibull_fit(D.ecdf(table(spark, sf_dir, "orders"), "o_totalprice")).select(F.round("shape", 4).alias("shape"), F.round("scale", 1).alias("scale"))


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) a, round(regr_intercept(l_extendedprice, l_quantity), 2) b from lineitem")
def linear_fit(spark, sf_dir):
    """A27, F12."""
    return D.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("a", 4).alias("a"), F.round("b", 2).alias("b"))


@query("with a as (select distinct l_quantity x, cume_dist() over (order by l_quantity) m from lineitem where l_returnflag = 'R'), b as (select distinct l_quantity x, cume_dist() over (order by l_quantity) s from lineitem where l_returnflag = 'N') select round(max(abs(s - coalesce(m, 0))), 6) greatest, round(avg((s - coalesce(m, 0)) ** 2), 9) mean_square from b asof left join a using (x)")
def goodness_of_fit(spark, sf_dir):
    """Gap of two classes' distributions."""
    li = table(spark, sf_dir, "lineitem")
    one, two = (D.ecdf(li.where(F.col("l_returnflag") == c), "l_quantity") for c in "RN")
    return D.goodness_of_fit(one, two).select(F.round("greatest", 6).alias("greatest"), F.round("mean_square", 9).alias("mean_square"))


def _quantiles(flag: str, name: str) -> str:
    e = f"select distinct l_extendedprice x, cume_dist() over (order by l_extendedprice) f from lineitem where l_returnflag = '{flag}'"
    s = f"select lag(x) over (order by x) x0, lag(f) over (order by x) f0, x x1, f f1 from ({e})"
    return f"{name} as (select t, coalesce(x0 + (t - f0) * (x1 - x0) / (f1 - f0), (select min(x) from ({e}))) x from t left join ({s}) on f0 < t and t <= f1)"


@query(f"with t as (select unnest([0.01, 0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95, 0.99])::double t), {_quantiles('R', 'a')}, {_quantiles('N', 'b')} select t share, round(a.x, 4) model, round(b.x, 4) sample from a join b using (t)")
def quantile_table(spark, sf_dir):
    """Q-Q at eleven shares."""
    li = table(spark, sf_dir, "lineitem")
    one, two = (D.ecdf(li.where(F.col("l_returnflag") == c), "l_extendedprice") for c in "RN")
    return D.quantile_table(one, two).select("share", F.round("model", 4).alias("model"), F.round("sample", 4).alias("sample"))


@query("select l_orderkey query_id, l_linenumber qfrag, min(l_quantity) self_match, round(avg(l_quantity), 9) mean, round(stddev_pop(l_quantity), 9) sd from lineitem group by 1, 2")
def fragment_statistics(spark, sf_dir):
    """A26."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("qfrag"), F.col("l_quantity").alias("d"))
    return D.fragment_statistics(d).withColumn("mean", F.round("mean", 9)).withColumn("sd", F.round("sd", 9))


@query("with d as (select a.vec_id, b.vec_id other, a.label = b.label related, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: ((a.embedding[i] > 0) <> (b.embedding[i] > 0))::int)) d from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select related, d::int x, count(*) n from d group by all")
def related_distances(spark, sf_dir):
    """Distances of related and unrelated neighbours."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2"), F.col("embedding").alias("e2"))
    d = F.aggregate(F.zip_with("embedding", "e2", lambda a, b: ((a > 0) != (b > 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    return e.join(o, "vec_id").select((F.col("label") == F.col("l2")).alias("related"), d.alias("x")).groupBy("related", "x").agg(F.count("*").alias("n"))


@query(f"""with {NATIONS}, l as (select seq_id, class, translate(residues, translate(residues, 'abcdefghijklmnopqrstuvwxyz_ 0123456789.,', ''), ',') residues from nations), w as ({words('l', 4)}),
d as (select a.seq_id q, a.pos i, b.seq_id s, b.pos j, list_sum(list_transform(range(1, 5), lambda x: (substr(a.word, x, 1) <> substr(b.word, x, 1))::int))::int x from w a, w b where a.seq_id <> b.seq_id),
m as (select q, s, min(x) x from d group by q, s, i union all select q, s, min(x) from d group by q, s, j)
select a.class = b.class related, x, count(*) n from m join l a on a.seq_id = q join l b on b.seq_id = s group by all""")
def nearest_word_distances(spark, sf_dir):
    """Minima of sequence pairs, pooled by relatedness."""
    from tessera.operators import pairwise

    n = nations(spark, sf_dir)
    m = pairwise.minima(n, n, 4, LETTERS, "edit")
    c = n.select(F.col("seq_id").alias("query_id"), F.col("class").alias("c1")), n.select(F.col("seq_id").alias("subject_id"), F.col("class").alias("c2"))
    rows = m.join(c[0], "query_id").join(c[1], "subject_id").where("query_id <> subject_id")
    return rows.select((F.col("c1") == F.col("c2")).alias("related"), F.explode(F.concat("row_min", "col_min")).alias("x")).groupBy("related", "x").agg(F.count("*").alias("n"))


@query()
def mixture_models(spark, sf_dir):
    """M1-M3: mixtures of one to three parts of event values."""
    rows = table(spark, sf_dir, "events")
    return mixtures.model_table(rows, mixtures.sweep(rows, "value", 3))


@query()
def mixture_curves(spark, sf_dir):
    """M2, M4: CDFs and densities of the models beside the sample's."""
    rows = table(spark, sf_dir, "lineitem")
    return mixtures.curves(rows, "l_quantity", mixtures.sweep(rows, "l_quantity", 2))


# domains: return flags on orders, an extent for each line

DOMAINS = "d as (select l_returnflag pfam_id, l_orderkey::varchar seq_id, l_linenumber * 20 b, l_linenumber * 20 + l_quantity::int // 5 e from lineitem), inst as (select distinct l_suppkey::varchar proto_id, l_orderkey::varchar seq_id, (l_partkey % 100)::int pos from lineitem)"


def _domains(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.select(F.col("l_returnflag").alias("pfam_id"), F.lit("a flag").alias("descr"), F.col("l_orderkey").cast("string").alias("seq_id"), F.lit(200).alias("seq_len"), F.struct((F.col("l_linenumber") * 20).alias("begin"), (F.col("l_linenumber") * 20 + F.floor(F.col("l_quantity") / 5).cast("int")).alias("end")).alias("e"))
    d = d.groupBy("pfam_id", "descr", "seq_id", "seq_len").agg(F.array_sort(F.collect_list("e")).alias("extents"))
    inst = li.select(F.col("l_suppkey").cast("string").alias("proto_id"), F.col("l_orderkey").cast("string").alias("seq_id"), (F.col("l_partkey") % 100).cast("int").alias("pos")).distinct()
    return d, inst


@query(f"with {DOMAINS}, hit as (select distinct pfam_id, proto_id from inst join d using (seq_id) where b <= pos + 9 and pos <= e) select pfam_id, count(distinct seq_id) n_seqs, (select count(*) from hit where hit.pfam_id = d.pfam_id) n_protos from d group by 1")
def domain_coverage(spark, sf_dir):
    """J10, A24."""
    d, inst = _domains(spark, sf_dir)
    return dom.coverage(inst, d, 10)


@query(f"with {DOMAINS}, p as (select distinct l_partkey::varchar proto_id, l_orderkey::varchar seq_id, (l_partkey % 100)::int pos from lineitem) select distinct proto_id from p where proto_id not in (select proto_id from p join d using (seq_id) where b <= pos + 9 and pos <= e and e - b >= 9)")
def outside_domains(spark, sf_dir):
    """Prototypes (parts) without an instance in a long extent."""
    d, _ = _domains(spark, sf_dir)
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("proto_id"), F.col("l_orderkey").cast("string").alias("seq_id"), (F.col("l_partkey") % 100).cast("int").alias("pos")).distinct()
    long = d.withColumn("extents", F.filter("extents", lambda x: x["end"] - x["begin"] >= 9))
    return dom.outside(p, long, 10)


@query(f"with {DOMAINS}, x as (select pfam_id, seq_id, b, e from d) select pfam_id, seq_id, b as \"begin\", e as \"end\" from x")
def domain_round_trip(spark, sf_dir):
    """Domains written as text and read back."""
    d, _ = _domains(spark, sf_dir)
    path = scratch(spark, "domains")
    formats.domain_lines(d).select(F.concat("value", F.lit("\n")).alias("value")).write.text(path)
    back = formats.read_domains(spark.read.text(path, lineSep="\n\n"))
    return dom.extents(back).select("pfam_id", "seq_id", "begin", "end")


@query("with s as (select p_partkey::varchar seq_id, p_name residues from part), e as (select seq_id, residues, unnest([2, 5]) b, unnest([0, 1]) n from s) select seq_id || '_' || n seq_id, 'PF' pfam_id, substr(residues, b + 1, 4) residues from e")
def domain_subsequences(spark, sf_dir):
    """Subsequences of extents."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("seq_id"), F.col("p_name").alias("residues"))
    d = rows.select(F.lit("PF").alias("pfam_id"), "seq_id", F.expr("array(named_struct('begin', 2, 'end', 5), named_struct('begin', 5, 'end', 8))").alias("extents"))
    return dom.subsequences(rows, d)


@query(f"with {DOMAINS} select seq_id, count(*) n from d where seq_id in (select seq_id from d where pfam_id = 'R') group by 1")
def domain_subset(spark, sf_dir):
    """Domains of sequences that have a wanted one."""
    d, _ = _domains(spark, sf_dir)
    wanted = dom.by_domain(d, spark.createDataFrame([("R",)], "pfam_id string"))
    return dom.sequences_with(dom.extents(d), wanted).groupBy("seq_id").agg(F.count("*").alias("n"))


EDGES = f"{ITEMS}, w as ({words('items', 6)}), e as (select a.seq_id id1, a.pos + 1 start1, b.seq_id id2, b.pos + 1 start2 from w a join w b using (word) where a.seq_id < b.seq_id)"


def _edges(spark, sf_dir):
    w = tiling.kmers(items(spark, sf_dir), 6)
    o = w.select("word", F.col("seq_id").alias("id2"), (F.col("pos") + 1).alias("start2"))
    met = w.join(o, "word").where("seq_id < id2")
    return met.select(F.col("seq_id").alias("id1"), (F.col("pos") + 1).alias("start1"), (F.col("pos") + 6).alias("stop1"), "id2", "start2", (F.col("start2") + 5).alias("stop2"))


@query(f"with {EDGES}, r as (select *, start1 - start2 d, start1 - row_number() over (partition by id1, id2, start1 - start2 order by start1) g from e) select id1, min(start1)::int start1, (max(start1) + 5)::int stop1, id2, min(start2)::int start2, (max(start2) + 5)::int stop2 from r group by id1, id2, d, g")
def merged_edges(spark, sf_dir):
    """Shared words of item pairs, merged along diagonals."""
    return dom.merge_consecutive(_edges(spark, sf_dir))


@query()
def overlapping_edges(spark, sf_dir):
    """Merged in order while starts overlap."""
    return dom.merge_overlapping(_edges(spark, sf_dir))


@query(f"with {PARTS}, w as ({words('parts', 9)}), n as (select word, string_agg(seq_id || ':' || pos || ';', '' order by seq_id, pos) t, count(*) c from w group by 1) select substr(word, 1, 8) proto_id, count(*) member_count, sum(c)::bigint n from n group by 1")
def codebook_round_trip(spark, sf_dir):
    """Clusters written as text and read back."""
    index = tiling.kmer_index(tiling.kmers(parts(spark, sf_dir).select("seq_id", "residues"), 9))
    c = index.select(F.substring("word", 1, 8).alias("proto_id"), "word", F.lit(0).alias("distance"), "instances", F.create_map(F.lit("purity"), F.lit("1")).alias("metadata"))
    back = formats.read_codebook(formats.codebook_lines(c).select("value"))
    return back.groupBy("proto_id").agg(F.count("*").alias("member_count"), F.sum(F.size("instances")).alias("n"))


@query("select c_custkey, c_name, c_acctbal from customer")
def csv_round_trip(spark, sf_dir):
    """RFC 4180 text."""
    path = scratch(spark, "csv")
    formats.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return formats.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("select o_orderkey::varchar topic, l_suppkey::varchar doc, 1 rel from orders join lineitem on l_orderkey = o_orderkey")
def qrels_round_trip(spark, sf_dir):
    """Relevance written as text and read back."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = formats.qrels_lines(rows.select(F.col("o_orderkey").cast("string").alias("topic"), F.col("l_suppkey").cast("string").alias("doc"), F.lit(1).alias("rel")))
    return formats.read_qrels(lines)


@query("select o_custkey::varchar topic, o_orderkey::varchar doc from orders")
def homologs_round_trip(spark, sf_dir):
    """Lists of related ids."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("topic"), F.col("o_orderkey").cast("string").alias("doc"))
    return formats.read_homologs(formats.homolog_lines(rows))


@query("select id1, start1, stop1, id2, start2, stop2 from (select l_orderkey::varchar id1, l_linenumber::int start1, (l_linenumber + 5)::int stop1, l_partkey::varchar id2, 1 start2, 6 stop2 from lineitem)")
def edges_round_trip(spark, sf_dir):
    """S17, Edge: tab-separated edges."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").cast("string").alias("id1"), F.col("l_linenumber").alias("start1"), (F.col("l_linenumber") + 5).alias("stop1"), F.col("l_partkey").cast("string").alias("id2"), F.lit(1).alias("start2"), F.lit(6).alias("stop2"))
    return formats.read_edges(formats.edge_lines(rows))


@query(f"with {PMF} select x, p from pmf")
def histogram_round_trip(spark, sf_dir):
    """A histogram as text."""
    return formats.read_histogram_columns(formats.histogram_columns(_quantity(spark, sf_dir)))


@query("select c_custkey, trim(c_name) name, lower(c_mktsegment) segment, len(list_filter(string_split(c_name, '#'), lambda x: x <> ''))::int pieces, try_cast(regexp_extract(c_name, '([0-9]+)', 1) as bigint) number, round(-(exp(-abs(c_acctbal) / 10000) - 1), 9) share from customer")
def scalar_functions(spark, sf_dir):
    """Text and number functions."""
    from tessera.functions.alphabets import split_nonempty

    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.trimmed(F.col("c_name")).alias("name"), F.lower("c_mktsegment").alias("segment"), F.size(split_nonempty(F.col("c_name"), "#")).alias("pieces"),
        S.parse_int(F.regexp_extract("c_name", "([0-9]+)", 1)).alias("number"), F.round(S.one_minus_exp(-F.abs("c_acctbal") / 10000), 9).alias("share"),
    )
