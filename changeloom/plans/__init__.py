"""changeloom.plans."""
