"""Analytics over corpora of electronic publications and web documents, on Spark."""
