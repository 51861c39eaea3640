"""Column functions: normalisation, indicators, features, scores."""
