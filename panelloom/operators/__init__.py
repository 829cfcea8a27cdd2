"""operators of panelloom."""
