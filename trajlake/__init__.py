"""trajlake: a PySpark-native engine for agent-trajectory and training-data analytics."""
