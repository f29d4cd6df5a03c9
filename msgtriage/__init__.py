"""Message triage and text evaluation as Spark DataFrame operators."""
