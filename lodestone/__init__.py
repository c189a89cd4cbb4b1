"""Media index analytics on PySpark: tables of sightings in, derived tables out."""

__version__ = "0.1.0"
