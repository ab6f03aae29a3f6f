"""The end-to-end runs: collect a snapshot, verify its labels, score it."""
