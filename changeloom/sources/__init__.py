"""changeloom.sources."""
