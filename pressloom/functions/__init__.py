"""Part of pressloom."""
