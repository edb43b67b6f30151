"""Files as they arrive. Decoding has no state of its own between files, so batch operators serve streams as they are."""
