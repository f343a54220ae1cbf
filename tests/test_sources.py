import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import fasta, formats


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_fasta(spark, tmp_path):
    path = str(tmp_path / "a.faa")
    with open(path, "w") as out:
        out.write(">sp|P1|GENE||PF1;PF2\nMK-v\n  LL\n>sp|P2|none|PF9\n\n>sp|P3|x|PF2;PF2\naj\n")
    got = fasta.read(spark, path, id_index=1, class_index=3).orderBy("seq_id").collect()
    assert [(r["seq_id"], r["residues"], r["classes"]) for r in got] == [("P1", "mkvll", ["PF1", "PF2"]), ("P3", "a*", ["PF2"])]
    assert fasta.read(spark, path, id_index=1, unknown="drop").where("seq_id = 'P3'").first()["residues"] == "a"
    spark.dataSource.register(fasta.FastaDataSource)
    assert {tuple(r) for r in spark.read.format("fasta").load(path).collect()} == {("sp|P1|GENE||PF1;PF2", "mkvll"), ("sp|P3|x|PF2;PF2", "aj")}


def test_rankings(spark):
    r = spark.createDataFrame([("q", "b", -3.5, 1, 2), ("q", "a", -4.0, 2, 0)], "query_id string, subject_id string, score double, rank int, hits int")
    assert [x["value"] for x in formats.ranking_lines(r).collect()] == ["q b -3.5 a -4 ___eol___ -100000"]
    assert [x["value"] for x in formats.ranking_lines(r, "csv").collect()] == ["q,2,b,-3.5,a,-4"]
    for d in ("compact", "plain", "csv", "trec"):
        back = formats.read_rankings(formats.ranking_lines(r, d), d).orderBy("rank").collect()
        assert [(x["query_id"], x["subject_id"], x["score"]) for x in back] == [("q", "b", -3.5), ("q", "a", -4.0)], d
    assert formats.read_rankings(lines(spark, "q ___eol___ -100000")).count() == 0


def test_signatures_and_vectors(spark):
    s = spark.createDataFrame([("s1", [0, 4, 9]), ("s2", [])], "seq_id string, features array<int>")
    assert [r["value"] for r in formats.signature_lines(s).orderBy("value").collect()][0] == "s1 3 0 4 9;"
    assert {(r["seq_id"], tuple(r["features"])) for r in formats.read_signatures(formats.signature_lines(s)).collect()} == {("s1", (0, 4, 9)), ("s2", ())}
    v = spark.createDataFrame([("s1", {4: 3.0, 0: 1.0}), ("s2", {})], "seq_id string, features map<bigint,double>")
    assert {(r["seq_id"], tuple(sorted(r["features"].items()))) for r in formats.read_feature_vectors(formats.feature_vector_lines(v)).collect()} == {("s1", ((0, 1.0), (4, 3.0))), ("s2", ())}


def test_codebook(spark):
    c = spark.createDataFrame([("proto_1", "acg", 0, [("s1", 0)], {"purity": "0.5"}), ("proto_1", "acc", 3, [("s1", 4), ("s2", 1)], {"purity": "0.5"})], "proto_id string, word string, distance int, instances array<struct<seq_id:string,pos:int>>, metadata map<string,string>")
    assert formats.codebook_lines(c).first()["value"] == "Cluster,2,proto_1:0;purity:0.5;\ndistance:0;s1:0;\ndistance:3;s1:4;s2:1;"
    back = formats.read_codebook(lines(spark, "Codebook,3,1\nClusters\nCluster,2,proto_1:0;purity:0.5;\ndistance:0;s1:0;\ndistance:3;s1:4;s2:1;")).orderBy("member").collect()
    assert [(r["proto_id"], r["metadata"], r["distance"], [tuple(i) for i in r["instances"]]) for r in back] == [("proto_1", {"purity": "0.5"}, 0, [("s1", 0)]), ("proto_1", {"purity": "0.5"}, 3, [("s1", 4), ("s2", 1)])]


def test_domains(spark):
    block = ">VAV_HUMAN  |=====| P1.2 845 a.a.\nSH2  1  (10) PF00017.19 SH2 domain  671-745\nSH3_1  2  (9) PF00018.23 SH3 domain  600-650 788-834"
    got = formats.read_swisspfam(lines(spark, block)).orderBy("pfam_id").collect()
    assert [(r["pfam_id"], r["seq_id"], [tuple(e) for e in r["extents"]]) for r in got] == [("PF00017", "VAV_HUMAN", [(670, 744)]), ("PF00018", "VAV_HUMAN", [(599, 649), (787, 833)])]
    assert got[0]["seq_len"] == 845 and got[0]["descr"] == "SH2 domain"
    back = formats.read_domains(formats.domain_lines(formats.read_swisspfam(lines(spark, block))).select("value")).orderBy("pfam_id").collect()
    assert [tuple(r) for r in back] == [(r["pfam_id"], r["descr"], r["seq_id"], r["seq_len"], r["extents"]) for r in got]


def test_swissprot_entries(spark):
    rows = spark.createDataFrame(list(enumerate(["ID   A_X  Reviewed", "DR   Pfam; PF1; x; 1.", "DR   Pfam; PF2; y; 1.", "//", "ID   B_X  Reviewed", "DR   Pfam; PF2; y; 1."])), "line_no int, value string")
    e = formats.swissprot_entries(rows)
    assert {(r["seq_id"], tuple(r["classes"])) for r in e.collect()} == {("A_X", ("PF1", "PF2")), ("B_X", ("PF2",))}
    assert formats.qrels_from_families(e).count() == 4


def test_small_texts(spark, tmp_path):
    models = [{"aicc": 12.5, "parts": [(0.5, 1.0, 2.0), (0.5, 3.0, 1.0)]}, {"aicc": 9.0, "parts": [(1.0, 2.0, 2.0)]}]
    assert formats.parse_mixtures(formats.mixture_text(models)) == models
    assert formats.parse_histogram_rows(formats.histogram_rows([(0, 0.4), (1, 0.6)])) == [(0.0, 0.4), (1.0, 0.6)]
    p = formats.parse_partition(formats.partition_text(7, 2, ["a"], ["b", "c"]))
    assert (p["seed"], p["train"], p["test"]) == (7, ["a"], ["b", "c"])
    ids = spark.createDataFrame([("a",), ("b",)], "seq_id string")
    path = os.path.join(tmp_path, "ids")
    formats.write_ids(ids, path)
    assert {r["seq_id"] for r in formats.read_ids(spark, path).collect()} == {"a", "b"}
    head = formats.dataset_lines(ids, "ids", {"k": "3"})
    assert head == ["ids,2", "meta,k,3"]
    records, meta = formats.read_dataset(lines(spark, *head, "a,1", "b,2"), "ids")
    assert {r["value"] for r in records.collect()} == {"a,1", "b,2"} and meta == {"k": "3"}


def test_csv_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c\nd'), (2, "")], "i int, s string")
    path = str(tmp_path / "csv")
    formats.write_csv(rows, path)
    assert formats.read_csv(spark, path, "i int, s string").where("i = 1").first()["s"] == 'a "b", c\nd'


@pytest.mark.parametrize("text,want", [("t d1 d2", [("t", "d1"), ("t", "d2")]), ("t", []), ("", [])])
def test_homologs(spark, text, want):
    assert [tuple(r) for r in formats.read_homologs(lines(spark, text)).orderBy("doc").collect()] == want


def test_prototypes(spark, tmp_path):
    p = spark.createDataFrame([("proto_1", "acg", 12)], "proto_id string, word string, size long")
    path = str(tmp_path / "p")
    fasta.write_prototypes(p, path)
    got = fasta.read_prototypes(spark, path).select("proto_id", "word", "size", F.coalesce("class", F.lit("-"))).first()
    assert tuple(got) == ("proto_1", "acg", 12, "-")
