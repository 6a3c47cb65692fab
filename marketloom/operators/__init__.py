"""Table operators: reshaping, validation, features, labels, diagnostics, statistics."""
