"""Spark-native analytics for DNA data storage: strands, rules, fountain codes, read clustering and recovery."""
