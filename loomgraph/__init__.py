"""loomgraph: a document-to-knowledge-graph engine made of Spark DataFrames."""
