"""Whole runs: documents to a corpus, questions to prompts."""
