"""A PySpark-native engine that turns collections of files and pages into Markdown and tables."""
