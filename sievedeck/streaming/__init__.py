"""Pages and documents as streams."""
