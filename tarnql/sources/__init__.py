"""Tables: catalog, ingestion, writing, and the check of stored files."""
