"""Study-planning, retrieval and corpus analytics as plain PySpark functions."""
