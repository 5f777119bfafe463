"""Service-assurance and trust analytics as PySpark DataFrame operators."""
