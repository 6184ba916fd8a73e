"""Training-data operators over a documents table. Nothing else in the library imports this."""
