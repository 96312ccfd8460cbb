"""quillspan: timed-text and interval analytics as Spark DataFrame operators."""
