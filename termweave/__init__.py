"""PySpark-native candidate retrieval, evaluation, routing and review over free text."""
