"""Column functions: ids, residue chemistry, vectors, JSON facts."""
