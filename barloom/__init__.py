"""Bar analytics, labelling, formula search and audits on Spark DataFrames."""
