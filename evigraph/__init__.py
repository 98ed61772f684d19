"""evigraph: evidence-tracked knowledge graphs and question answering over documents, on PySpark."""
