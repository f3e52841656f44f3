"""changeloom.streaming."""
