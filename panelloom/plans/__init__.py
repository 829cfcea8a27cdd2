"""plans of panelloom."""
