"""Column functions: derived fields, predicates, n-grams and text cleaning."""
