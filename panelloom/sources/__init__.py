"""sources of panelloom."""
