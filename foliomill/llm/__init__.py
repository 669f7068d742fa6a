"""Training-data operators over report text. Nothing outside this subpackage imports it."""
