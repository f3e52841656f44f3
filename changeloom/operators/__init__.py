"""changeloom.operators."""
