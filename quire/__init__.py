"""quire: analytics over corpora of long text documents, on PySpark."""
