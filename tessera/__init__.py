"""tessera: private blocking, candidate pairs and corpus preparation as Spark plans."""
