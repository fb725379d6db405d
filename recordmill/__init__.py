"""Record curation and audit analytics as Spark DataFrame transformations."""
