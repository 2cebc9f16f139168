"""Operators for training data: code filters, doc pairs, parsing, tokenising, mixing, residue, similar vectors."""
