"""plotweave: a PySpark-native engine for collections of machine layouts and text records."""
