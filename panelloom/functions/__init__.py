"""functions of panelloom."""
