"""changeloom.functions."""
