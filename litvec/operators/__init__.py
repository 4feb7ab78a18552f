"""DataFrame operators: documents, passages, ids, vectors, search, prompts."""
