"""Training-data operators over text, token files, vectors and conversations."""
