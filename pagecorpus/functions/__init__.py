"""Column-to-Column functions; nothing here triggers a job."""
