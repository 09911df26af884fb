"""MLlib pipelines: features, embeddings, topics, classifiers."""
