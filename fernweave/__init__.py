"""fernweave: a provenance graph, search and corpus engine written as Spark plans."""
