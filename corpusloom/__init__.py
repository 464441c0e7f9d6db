"""A PySpark-native engine for preparing, packing, mixing and scoring machine-learning corpora."""
