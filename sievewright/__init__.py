"""sievewright: a PySpark-native engine for building, retrieving from and scoring QA and conversation data."""
