"""Training-data pipeline operators (documents, pages, conversations,
embeddings). Nothing outside this package imports it; ``registry`` holds the
registered queries and their SQL."""
