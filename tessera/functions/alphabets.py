"""Alphabets and the symbol-level functions on residue strings, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """symbols in code order; pad: the symbol that stands for unknown ones and fills short sequences."""

    name: str
    symbols: str
    pad: str

    @property
    def radix(self) -> int:
        return len(self.symbols)

    @property
    def word_limit(self) -> int:
        """The longest word whose Horner code fits a signed 64-bit integer."""
        k, top = 0, 1
        while top * self.radix < 1 << 63:
            top, k = top * self.radix, k + 1
        return k


#: The symbols in code order and the default symbol.
AMINO = Alphabet("AA", "arndcqeghilkmfpstwyvbzx*", "*")
DNA = Alphabet("DNA", "nacgt", "n")
RNA = Alphabet("RNA", "nacgu", "n")
DEFAULT = Alphabet("DEFAULT", "".join(map(chr, range(32, 127))), " ")
ALPHABETS = {a.name: a for a in (AMINO, DNA, RNA, DEFAULT)}


def by_name(name: str) -> Alphabet:
    """A built-in alphabet by name, else one made of the name's own characters (the first pads)."""
    return ALPHABETS.get(name.upper()) or Alphabet("custom", name, name[0])


def _in_class(symbols: str) -> str:
    return "[^" + "".join("\\" + c if not c.isalnum() else c for c in symbols) + "]"


def clean(residues: Column, alphabet: Alphabet, unknown: str = "default") -> Column:
    """Drop '-' and blanks and lower-case; symbols outside the alphabet become its pad, or go with unknown='drop'."""
    kept = F.lower(F.regexp_replace(residues, r"[-\s]", "")) if alphabet is not DEFAULT else residues
    return F.regexp_replace(kept, _in_class(alphabet.symbols), "" if unknown == "drop" else alphabet.pad)


def pad(residues: Column, least: int, alphabet: Alphabet) -> Column:
    """Fill up to `least` symbols; longer sequences stay whole."""
    return F.rpad(residues, F.greatest(F.lit(least), F.length(residues)), F.lit(alphabet.pad))


def encode(residues: Column, alphabet: Alphabet) -> Column:
    """Symbol codes, 0 for unknown ones; case doesn't count."""
    return F.transform(F.split(F.lower(residues), ""), lambda c: F.greatest(F.instr(F.lit(alphabet.symbols), c) - 1, F.lit(0)))


def decode(codes: Column, alphabet: Alphabet) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(alphabet.symbols), c + 1, F.lit(1))), "")


def horner(word: Column, alphabet: Alphabet) -> Column:
    """The word's number in base radix, its first symbol highest; exact up to `word_limit` symbols."""
    return F.aggregate(encode(word, alphabet), F.lit(0).cast("long"), lambda acc, c: acc * alphabet.radix + c)


def horner_little(word: Column, alphabet: Alphabet) -> Column:
    """The same with the first symbol lowest."""
    return horner(F.reverse(word), alphabet)


def packed_codes(word: Column, alphabet: Alphabet, per_code: int) -> Column:
    """Horner codes of every `per_code` symbols of a word whose length is a multiple of it; null otherwise."""
    n = F.length(word)
    parts = F.transform(F.sequence(F.lit(0), F.floor(n / per_code) - 1), lambda i: horner(F.substring(word, (i * per_code + 1).cast("int"), F.lit(per_code)), alphabet))
    return F.when((n > 0) & (n % per_code == 0), parts)


def reverse_complement(residues: Column) -> Column:
    """Of DNA: a-t and c-g swapped, read backwards; n stays."""
    return F.reverse(F.translate(residues, "acgtACGT", "tgcaTGCA"))


def bit_code(word: Column) -> Column:
    """DNA in four bits a symbol (a 1, c 2, g 4, t 8, n 0), up to 16 symbols in a long."""
    bits = F.transform(F.split(F.lower(word), ""), lambda c: F.when(c == "a", 1).when(c == "c", 2).when(c == "g", 4).when(c == "t", 8).otherwise(0).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 4).bitwiseOR(b))


def split_nonempty(text: Column, pattern: str) -> Column:
    """Split and drop empty tokens: 'a||b' has two."""
    return F.filter(F.split(text, pattern), lambda t: t != "")
