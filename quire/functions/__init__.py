"""Part of the quire document-analytics engine."""
