"""Text anonymisation and entity analytics expressed as Spark plans."""
