"""Readers and writers of sequence, vocabulary, ranking, domain and distribution files."""
