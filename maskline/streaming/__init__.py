"""Lines as a stream."""
