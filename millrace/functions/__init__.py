"""Part of the document-mining engine."""
