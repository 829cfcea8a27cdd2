"""streaming of panelloom."""
