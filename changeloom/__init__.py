"""changeloom: change streams as DataFrames, planned by Catalyst."""

__version__ = "0.1.0"
