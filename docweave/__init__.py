"""Documents to evidence to retrieval-ready chunks, as Spark plans."""
