"""Functions on document, instant and duration columns."""
