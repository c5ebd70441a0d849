"""Text processing for Chinese-language corpora, and training-data operations, on Spark DataFrames."""
