"""voxdesk: support-message analytics expressed as Spark DataFrame jobs."""
