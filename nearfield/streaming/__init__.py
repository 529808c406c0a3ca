"""The change log, as batch fold and as a stream."""
