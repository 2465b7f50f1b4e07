"""Training-data operators over the documents, benchmark, labels and conversations tables."""
