"""quillspark: auditing, cleaning, profiling and scoring of labelled corpora on Spark."""
