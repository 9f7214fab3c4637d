"""Column expressions: calendar keys, bands, ratios and hashes."""
