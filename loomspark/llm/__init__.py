"""Training-data operators for very large corpora; nothing outside this subpackage imports it."""
