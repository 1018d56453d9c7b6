"""Readers of file formats: bytes to a :class:`~textloom.sources.model.Document`, in plain Python."""
