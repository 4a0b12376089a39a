"""Spark-native analytics over governed model traffic: ledgers, policy, audit chains, redaction, caches, streams."""
