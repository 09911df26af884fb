"""DataFrame operators: categories, mapping, sampling, vocabulary, evaluation."""
