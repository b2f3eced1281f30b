"""Training-data operators for text corpora: each module is one operator over a DataFrame of documents."""
