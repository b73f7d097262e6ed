"""Document-metric analytics on Spark: relational views, text and number functions, and document stages."""
