"""maskwright: Spark-native detection, pseudonymisation and verification of sensitive text."""
