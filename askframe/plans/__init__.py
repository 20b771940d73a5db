"""The typed query plan, its legality rules, decoding and description."""
