"""visitlens: visits, identities and digests from timestamped observations, on Spark."""
