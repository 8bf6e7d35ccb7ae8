"""Code-concept analytics on Spark: ingest a source tree, extract symbols,
resolve references, embed and cluster symbols into concepts, and query them."""
