"""Retrieval and question-answering analytics over tables, expressed as Spark jobs."""
