"""State that outlives a job: a versioned store, the entity index, the text index and the document index."""
