"""A PySpark engine that turns news articles into scored events and an impact index."""
