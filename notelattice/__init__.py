"""A retrieval and analytics engine for folders of notes, built on Spark DataFrames."""
