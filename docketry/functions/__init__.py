"""Column-level rules, shared by the batch and the streaming operators."""
