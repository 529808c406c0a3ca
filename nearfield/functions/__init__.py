"""Column builders: score kernels, filter expressions, hashes."""
