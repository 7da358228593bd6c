"""Finding, masking and auditing personal data in text at scale, on Spark."""
