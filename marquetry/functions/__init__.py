"""Column -> Column helpers; nothing here triggers a Spark job."""
