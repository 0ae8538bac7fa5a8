"""Analytics over the evidence of retrieval pipelines, on Spark."""
