import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import alphabets as A
from tessera.functions import matrices as M
from tessera.functions import scalars as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_alphabets(spark):
    assert (A.AMINO.radix, A.DNA.radix, A.by_name("dna"), A.by_name("xyz").symbols) == (24, 5, A.DNA, "xyz")
    assert A.AMINO.word_limit == 13 and A.DNA.word_limit == 27
    assert one(spark, A.clean(F.col("s"), A.AMINO), s="MK-v Zj") == "mkvz*"
    assert one(spark, A.clean(F.col("s"), A.AMINO, "drop"), s="MK-v Zj") == "mkvz"
    assert one(spark, A.pad(F.col("s"), 5, A.DNA), s="ac") == "acnnn"
    assert one(spark, A.pad(F.col("s"), 2, A.DNA), s="acgt") == "acgt"
    assert one(spark, A.encode(F.col("s"), A.DNA), s="nAcq") == [0, 1, 2, 0]
    assert one(spark, A.decode(A.encode(F.col("s"), A.DNA), A.DNA), s="gattaca") == "gattaca"
    assert one(spark, A.horner(F.col("s"), A.DNA), s="ac") == 1 * 5 + 2
    assert one(spark, A.horner_little(F.col("s"), A.DNA), s="ac") == 1 + 5 * 2
    assert one(spark, A.packed_codes(F.col("s"), A.DNA, 2), s="acgt") == [7, 19]
    assert one(spark, A.packed_codes(F.col("s"), A.DNA, 3), s="acgt") is None
    assert one(spark, A.reverse_complement(F.col("s")), s="aacgn") == "ncgtt"
    assert one(spark, A.split_nonempty(F.col("s"), r"\|"), s="a||b") == ["a", "b"]


def test_dna_bits(spark):
    x, y = A.bit_code(F.col("a")), A.bit_code(F.col("b"))
    assert one(spark, S.dna_packed_distance(x, y, 4), a="acgn", b="acgn") == 1
    assert one(spark, S.dna_distance(F.col("a"), F.col("b")), a="acgn", b="acgn") == 1
    assert one(spark, S.hamming(F.col("a"), F.col("b")), a="acgt", b="aggt") == 1


def test_blosum62():
    m = M.blosum62()
    at = m.symbols.index
    assert (m.sim == m.sim.T).all() and m.top == 11
    assert [m.sim[at(a), at(b)] for a, b in ("ww", "ar", "bd", "zq", "xc", "*a", "**", "bz")] == [11, -1, 4, 3, -2, -4, 1, 0]
    assert m.distances("halperin")[at("w"), at("a")] == 11 + 4 + 6
    assert (np.diag(m.distances("halperin")) == 0).all() and m.distances("blosum")[at("a"), at("a")] == 7
    with pytest.raises(ValueError):
        m.distances("other")


def test_matrices_by_id(tmp_path):
    (tmp_path / "BLOSUM45").write_text("# a matrix file\n  a c\na 5 -1\nc -1 12\n")
    assert (M.blosum(62).sim == M.blosum62().sim).all()
    assert M.blosum(45, str(tmp_path)).top == 12 and M.blosum(45, str(tmp_path)).symbols == "ac"
    with pytest.raises(ValueError):
        M.blosum(45)
    dna, rna = M.MATRICES["dna"](), M.MATRICES["rna"]()
    assert (dna.symbols, rna.symbols) == ("acgtn", "acgun") and (dna.sim == rna.sim).all() and [dna.sim[i, j] for i, j in ((0, 0), (0, 1), (0, 4), (4, 4))] == [16, 0, 4, 1]


def test_digram_distances():
    m = M.nucleotides()
    d, two = m.distances(), M.digram_distances(m)
    assert two.shape == (25, 25) and all(two[5 * a + b, 5 * x + y] == d[a, x] + d[b, y] for a in range(5) for b in range(5) for x in range(5) for y in range(5))


def test_matrix_text():
    m = M.match_matrix("acgtn", 2, -1, "n")
    again = M.parse_matrix("# a comment\n" + M.format_matrix(m))
    assert again.symbols == m.symbols and (again.sim == m.sim).all()
    assert (M.parse_matrix("ac\n".replace("ac", "a c") + "1 0\n0 1\n").sim == np.eye(2)).all()
    with pytest.raises(ValueError):
        M.parse_matrix("a c\n1 0\n")


def test_log_odds_and_lambda():
    m = M.log_odds_matrix("ac", {("a", "a"): 40, ("c", "c"): 40, ("a", "c"): 20})
    assert m.sim[0, 0] > 0 > m.sim[0, 1]
    flat = M.match_matrix("acgt", 1, -1)
    found = M.karlin_altschul_lambda(flat, np.full(4, 0.25))
    assert abs(0.25 * np.exp(found) + 0.75 * np.exp(-found) - 1) < 1e-9
    with pytest.raises(ValueError):
        M.karlin_altschul_lambda(M.match_matrix("ac", 1, 1), np.full(2, 0.5))


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(0, 127)), st.sets(st.integers(0, 127)))
def test_bit_sets(spark, a, b):
    row = spark.createDataFrame([(sorted(a), sorted(b))], "a array<int>, b array<int>")
    x, y = S.bits_of(F.col("a"), 2), S.bits_of(F.col("b"), 2)
    got = row.select(S.bits_and(x, y), S.bits_or(x, y), S.bits_hamming(x, y), S.bits_similarity(x, y), S.cardinality(S.bits_remove(x, y)), S.cardinality(S.bits_complement(x)), S.jaccard(F.col("a"), F.col("b")), S.equal_bits(x, y, 128), S.cardinality(S.bits_union(x, y)), S.cardinality(S.bits_intersect(x, y))).first()
    j = len(a & b) / len(a | b) if a | b else 0
    assert tuple(got) == pytest.approx((len(a & b), len(a | b), len(a ^ b), j, len(a - b), 128 - len(a), j, (128 - len(a ^ b)) / 128, len(a | b), len(a & b)))


def test_numbers(spark):
    assert one(spark, S.lerp(F.col("x"), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(5.0)), x=1.0) == 3.0
    assert one(spark, S.at_least_one_of(F.col("p"), 3), p=1e-18) == pytest.approx(3e-18)
    assert one(spark, S.parse_int(F.col("s")), s="x") is None and one(spark, S.parse_double(F.col("s")), s="2.5") == 2.5
